import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as cp
from creditlens.llm import mixing, packing
from test_near_dedup import brute as near_brute
from test_quality_rules import brute as measures_brute


def test_run_against_brute_force_stages(spark, sf_dir, tmp_path):
    """Each stage's rows against a plain reading of its rule; the last against the tokenizer."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
        assert name == "packing" or docs.columns == columns
    first, good, exact, near, mix, pieces = kept

    def passes(text):  # too few labels here for any certified cutoff, so the base rule decides
        n, _, _, _, repeats = measures_brute(text)
        return not (n < 50 or 100 * repeats > 50 * n)

    assert sorted(good) == sorted(r for r in first if passes(r.text))
    groups = defaultdict(list)
    for r in good:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text)].append(r)
    assert sorted(exact) == sorted(min(g, key=lambda r: r.doc_id) for g in groups.values())
    component = {i: c for i, _, c in near_brute([(r.doc_id, r.text) for r in exact], 80)}
    assert sorted(r.doc_id for r in near) == sorted(set(component.values()))

    words = {r.doc_id: r.text.split() for r in near}
    taken = {r.doc_id: r.text.split() for r in mix}
    by, total = Counter(), Counter()
    for r in near:
        total[r.source] += len(words[r.doc_id])
        by[r.source] += len(taken.get(r.doc_id, ()))
        count = Counter(taken.get(r.doc_id, ()))
        assert all(n <= 2 * Counter(words[r.doc_id])[w] for w, n in count.items())
    names = sorted(total)
    want = mixing.targets(np.array([total[s] for s in names]), np.array([(5.0, 2, 1)[i % 3] for i in range(len(names))]), 1.5, 2)
    assert all(abs(by[s] - w) <= 256 * 1.5 for s, w in zip(names, want))

    t, ids = Tokenizer.from_file(packing.vocabulary()), {}
    for r in mix:
        ids[r.doc_id] = t.encode(r.text, add_special_tokens=False).ids + [1]
    at = Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id]
        at[p.doc_id] += p.length
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start:p.start + p.length], "<u4").tobytes())
    assert at == {i: len(x) for i, x in ids.items()}

    whole = cp.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces))
