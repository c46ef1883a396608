import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from creditlens.llm import quality_rules as op

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé日　\x85 \t\n\r\x0b\x1c#|!B", max_size=60))
def test_measures_match_brute_force(text):
    assert op.measures(text.encode())[:5] == brute(text)


def test_upper_bound_is_clopper_pearson():
    assert op.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-6)
    assert op.upper_bound(3, 50, 0.025) == pytest.approx(0.16548, abs=1e-4)  # published table value
    assert op.upper_bound(5, 5, 0.05) == 1.0


def test_choose_takes_a_lenient_certified_cutoff():
    cut = [3.0, 2.0, 1.0, 0.5]
    assert op.choose(cut, [0, 0, 0, 400], [0, 90, 90, 100], 10_000, 0.01, 0.01) == 2.0
    assert op.choose(cut, [0, 0, 0, 0], [0, 0, 0, 0], 10_000, 0.01, 0.01) is None  # rejects nothing bad
    assert op.choose(cut, [0, 0, 0, 0], [0, 5, 5, 5], 20, 0.01, 0.01) is None  # too few labels
    assert op.choose(cut, [0, 0, 0, 0], [0, 5, 5, 5], 0, 0.01, 0.01) is None


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in op.op5_quality_rules(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, want = got[d.doc_id], brute(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and (r.base_failed or r.failed_rules))


def words(n, seed):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 99991}" for i in range(n))


def test_rules_reject_junk_and_keep_good(docs_of, spark):
    good = [(i, words(60, i), "en", "s") for i in range(2000)]
    junk = [(5000 + i, words(60, i).replace(" ", "** "), "en", "s") for i in range(100)]
    rare = [(7000 + i, words(60, i), "xx", "s") for i in range(5)] + [(7100, words(60, 1).replace(" ", "** "), None, "s")]
    docs = docs_of(good + junk + rare + [(9000, None), (9001, "")])
    labels = spark.createDataFrame([(d[0], 1) for d in good] + [(d[0], 0) for d in junk] + [(7000, 1), (None, 1), (7001, None)],
                                   "doc_id long, quality int")
    got = {r.doc_id: r for r in op.quality_rules(docs, labels, alpha=0.05).collect()}
    assert all(got[d[0]].kept for d in good) and not any(got[d[0]].kept for d in junk)
    assert all(got[d[0]].kept for d in rare)  # no evidence in these strata
    assert got[9000].base_failed and not got[9001].kept
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2006 - 0


def test_no_labels_empty_table_and_clashing_columns(docs_of, spark):
    docs = docs_of([(1, words(60, 1)), (1, words(60, 1)), (None, "a")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = op.quality_rules(docs.selectExpr("*", "1 AS stratum", "2 AS n_words"), none).collect()
    assert sorted((str(r.doc_id), r.kept) for r in rows) == [("1", True), ("1", True), ("None", False)]
    assert op.quality_rules(docs.where("doc_id = 5"), none).count() == 0


def test_very_long_text():
    text = ("ab cd ef gh\n" * 200_000).encode()
    assert op.measures(text)[:5] == (800_000, 1_600_000, 0, 199_999, 800_000)
