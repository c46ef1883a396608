import random
import re

from creditlens.llm import line_dedup as op
from creditlens.llm.graph import distinct_buckets


def brute(rows, percent):
    """Dropped line numbers of every document, comparing all lines."""
    where, lines = {}, []
    for i, text in rows:
        for no, raw in enumerate((text or "").split("\n")):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", raw).strip(" ")
            if line:
                where.setdefault(line, []).append((i if i is not None else 2**63, no))
    lines = list(where)
    sets = []
    for x in lines:
        u = x.encode("utf-16-be")
        n = max(len(u) // 2 - 8, 0)
        sets.append({u[2 * k:2 * k + 16] for k in range(n + 1)})
    parent = list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, shared = {}, {}
    for a, x in enumerate(sets):
        for v in x:
            holders.setdefault(v, []).append(a)
    for ids in holders.values():  # lines that share no shingle are not similar
        for i, a in enumerate(ids):
            for b in ids[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            parent[root(a)] = root(b)
    groups = {}
    for k, x in enumerate(lines):
        groups.setdefault(root(k), []).extend(where[x])
    gone = {}
    for g in groups.values():
        for i, no in sorted(g)[1:]:
            gone.setdefault(i, []).append(no)
    return {(i if i is not None else 2**63): sorted(gone.get(i if i is not None else 2**63, [])) for i, _ in rows}


def words(rnd, n):
    return " ".join(f"w{rnd.randrange(10**5)}" for _ in range(n))


def test_families_against_all_pairs(docs_of, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 4)
    rnd, rows = random.Random(4), []
    bases = [words(rnd, 25) for _ in range(5)]
    for i in range(90):
        text = []
        for _ in range(rnd.randrange(4)):
            line = rnd.choice(bases)
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(line))
                line = line[:at] + rnd.choice("xyzé日😀") + line[at + 1:]
            text.append(line)
        text += [words(rnd, 6), "", rnd.choice(["short", " short ", "sh"])]
        rows.append((i, "\n".join(text)))
    rows += [(500, None), (501, ""), (502, "\n \n"), (None, "short"), (503, "long " * 30_000), (504, "a\n" * 3)]
    docs = docs_of(rows).selectExpr("*", "1 AS no", "2 AS line", "3 AS d1", "4 AS n", "5 AS g")
    got = {r.doc_id if r.doc_id is not None else 2**63: r.dropped for r in op.line_dedup(docs).collect()}
    assert got == brute(rows, 80)


def test_documents_against_all_pairs(spark, sf_dir, docs_of):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 50").collect()]
    got = {r.doc_id: r.dropped for r in op.line_dedup(docs_of(rows)).collect()}
    assert got == brute(rows, 80)


def test_query_covers_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op.op1_line_dedup(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    lines = {r.doc_id: (r.text or "").split("\n") for r in docs.collect()}
    exact = set()
    for r in sorted(rows, key=lambda r: r.doc_id):  # an equal line met before has gone, and no first line of its kind is lost
        assert r.n_lines == sum(bool(x.strip(" \t\r\x0b\x0c")) for x in lines[r.doc_id])
        for no, line in enumerate(lines[r.doc_id]):
            if line.strip(" \t\r\x0b\x0c"):
                assert no in r.dropped or line not in exact
                exact.add(line)


def test_texts_and_empty_tables(docs_of):
    docs = docs_of([(2, "a line here\nother"), (1, "a  line here\n\nb"), (3, None), (3, "b")])
    out = op.without_dropped(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == [(1, "a  line here\n\nb"), (2, "other"), (3, ""), (3, None)]
    assert op.line_dedup(docs.where("doc_id = 9")).count() == 0


def test_lines_travel_not_their_sets(spark):
    """A task's lines cross one shuffle by task, as text: sets of eight bytes a character are never sent."""
    text = "the quick brown fox jumps over the lazy dog"
    tasks = spark.createDataFrame([(1, 0, 10, 10), (1, 1, 20, 20), (1, 1, 30, 30), (2, 0, 20, 20), (2, 0, 10, 10)],
                                  "task long, blk int, c long, id long")
    lines = spark.createDataFrame([(10, text), (20, text + "s"), (30, "nothing of that kind at all")], "id long, line string")
    found = op.confirmed(tasks, lines, 80)
    assert [tuple(r) for r in found.collect()] == [(10, 20)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert sum(plan.count(x) for x in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")) == 1
    assert "xxhash64" not in plan.split("collect_list", 1)[1]  # no set is built below the grouping by task


def test_band_keys_are_dealt_once(spark, tmp_path):
    spark.createDataFrame([(1, [5, 6]), (2, [6, 7]), (3, [8, 9])], "id long, keys array<long>").write.parquet(f"{tmp_path}/s")
    buckets = distinct_buckets(op.keyed(spark.read.parquet(f"{tmp_path}/s")))
    assert sorted(tuple(r) for r in buckets.select("key", "id").collect()) == [(6, 1), (6, 2)]
    buckets.collect()
    final = buckets._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in final.splitlines() if "REPARTITION_BY_COL" in x]
    assert len(dealt) == 2 and "ReusedExchange" in dealt[1]


def nodes(plan):
    """All nodes of an executed plan, also of its stages."""
    yield plan
    inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else []
    inner += [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
    for p in inner or [plan.children().apply(k) for k in range(plan.children().size())]:
        yield from nodes(p)


def test_only_similar_pairs_leave_a_task(spark):
    """Lines of like length that are not similar are not listed as pairs, however many a task holds."""
    rnd = random.Random(8)
    base = words(rnd, 30)
    texts = [base, base + "s"] + [base[:100] + words(rnd, 18)[:len(base) - 100].ljust(len(base) - 100, "z") for _ in range(38)]
    lines = op.sketched(spark.createDataFrame(list(enumerate(texts)), "id long, line string")).cache()
    tasks = spark.createDataFrame([(1, 0, k, k) for k in range(len(texts))], "task long, blk int, c long, id long")
    found = op.confirmed(tasks, lines, 80)
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
    made = [p.metrics().apply("numOutputRows").value() for p in nodes(found._jdf.queryExecution().executedPlan())
            if p.nodeName() == "Generate"]
    assert made == [1]


def test_sketches_lose_no_pair_and_a_pair_meets_once(spark):
    rnd = random.Random(9)
    bases = [words(rnd, 25), "short", "of", "ab" * 3000, "long " * 400, words(rnd, 700)]
    texts = {*bases}
    for line in bases * 12:
        for _ in range(rnd.randrange(1, 5)):
            at = rnd.randrange(len(line))
            line = line[:at] + rnd.choice("xyzé日😀") + line[at + 1:]
        texts.add(line)
    texts = sorted(texts)
    plain = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    tasks = spark.createDataFrame([(t, 0, k, k, t) for k in range(len(texts)) for t in (1, 2)],
                                  "task long, blk int, c long, id long, key long")
    whole = {tuple(r) for r in op.confirmed(tasks, plain, 80).collect()}
    assert len(whole) > 50
    both = op.sketched(plain).selectExpr("*", "array(2L, 1L) AS keys")
    assert {tuple(r) for r in op.confirmed(tasks, both, 80).collect()} == whole
    assert op.confirmed(tasks.where("key = 2"), both, 80).isEmpty()  # they met in bucket 1


def test_the_first_words_of_sketches_rule_a_pair_out(spark):
    """The others are not looked at then: here they are not even there."""
    texts = ["the quick brown fox jumps over the lazy dog", "a line of quite another kind stands here now"]
    lines = op.sketched(spark.createDataFrame(list(enumerate(texts)), "id long, line string"))
    tasks = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 1)], "task long, blk int, c long, id long")
    assert op.confirmed(tasks, lines.selectExpr("id", "line", "n", "slice(bits, 1, 3) AS bits"), 80).isEmpty()


def test_hubs_and_white_space(spark):
    buckets = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6), (2, 7)], "key long, id long")
    assert sorted(tuple(r) for r in op.without_hubs(buckets).collect()) == [(1, 6), (2, 6), (2, 7)]
    raw = ["", " ", "\t\x0b", "a b", " a  b\r", "a\tb", "a\x0bb\x0c", " ", "a  b"]
    df = spark.createDataFrame([(x,) for x in [*raw, None]], "raw string")
    got = [r[0] for r in df.where(op.has_word(df.raw)).select(op.cleaned_line(df.raw)).collect()]
    assert got == ["a b", "a b", "a b", "a b", " ", "a  b"]
