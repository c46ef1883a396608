"""The driver contract holds with and without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_llm_subpackage():
    code = ("import sys; sys.modules['creditlens.llm'] = None\n"
            "import __spark_entry__ as e\n"
            "q = e.queries()\n"
            "assert len(q) == 73 and set(q) == set(e.oracle_sql()), len(q)\n"
            "assert 'corpus_pipeline' not in sys.modules")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
