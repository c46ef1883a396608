import pickle
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlens.llm import quality_classifier as op


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op.op3_quality_classifier(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_parts_and_repeats():
    assert op.parts(b"Thre***") == ("w:thre", "h:title", "s:***")
    assert op.parts(b"(ABC") == ("w:abc", "h:upper", "p:(")
    assert op.parts("|".encode()) == ("s:|", "h:none")
    assert op.parts(b"123") == ("w:0", "h:digits")
    assert op.repeats(b"a a b a".split()) == [1, 1, 1]


def test_document_vectors_are_means_over_whole_texts():
    v = op.Vectors([b"aa bb cc aa bb cc " * 5, b"dd! ee! dd! ee!"], 100)
    text = b"aa bb dd! zz aa"
    want = sum(v.table[v.features(w)].sum(axis=0) for w in text.split()) + v.table[v.number["r:1"]] * 0
    assert v.document(text) == pytest.approx(want / 5, abs=1e-5)
    assert v.document(b"aa bb " * 100_000) == pytest.approx(v.document(b"aa bb " * 1000), abs=1e-3)
    assert (pickle.loads(pickle.dumps(v)).document(text) == v.document(text)).all()
    assert not v.document(None).any()


def test_one_label_no_labels_and_odd_rows(spark, docs_of):
    docs = docs_of([(i, "good words here " * (1 + i % 5) if i % 2 else "$$ ## %%" * (1 + i % 4)) for i in range(200)] + [(500, None), (501, "")])
    docs = docs.selectExpr("*", "1 AS score", "0 AS quality")
    marks = "doc_id long, quality int"
    both = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, None), (None, 1), (900, 0)], marks)
    rows = {r.doc_id: r.score for r in op.score_quality(docs, both).collect()}
    assert len(rows) == 202 and all((rows[i] > 0.5) == bool(i % 2) for i in range(200)) and 0 <= rows[500] == rows[501] <= 1
    one = spark.createDataFrame([(1, 1), (3, 1)], marks)
    assert {r.score for r in op.score_quality(docs, one).collect()} == {1.0}
    assert {r.score for r in op.score_quality(docs, spark.createDataFrame([], marks)).collect()} == {0.5}
    assert op.score_quality(docs.where("doc_id < 0"), both).count() == 0


def test_repeated_ids_and_long_texts_bound_what_is_learnt(spark, docs_of):
    plain = [(i, "good words here " * (1 + i % 5) if i % 2 else "$$ ## %%" * (1 + i % 4)) for i in range(60)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1)], "doc_id long, quality int")
    scores = []
    for rows in (plain + [(7, "zzz"), (100, "$ " * 200_000)], [(100, "$ " * 200_000), (7, "zzz")] + plain[::-1]):
        docs = docs_of(rows)
        model = op.fit(docs, marks, 1500, 1000, fit_bytes=50_000)  # the long text does not fit
        scores.append(model.scores([b"good words here", b"$$ ##"]).tolist())
    assert scores[0] == scores[1] and scores[0][0] > 0.5 > scores[0][1]
    nothing = op.fit(docs, marks, 1500, 1000, fit_bytes=0)
    assert set(nothing.scores([b"good", b"$$"])) == {31 / 61}


def test_temperature_calibrates():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(4000, 6))
    y = (draw.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = op.Network(x, y, np.ones(4000))
    p = net.probability(x)
    for lo in (0.0, 0.25, 0.5, 0.75):
        band = (p >= lo) & (p < lo + 0.25)
        assert abs(p[band].mean() - y[band].mean()) < 0.08
