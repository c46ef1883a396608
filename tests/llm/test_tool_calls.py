import json
import random

import pytest

from creditlens.llm import tool_calls as op

SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}},
           "g": {"type": "object", "additionalProperties": False, "properties": {
               "s": {"type": "string", "maxLength": 3}, "l": {"type": "array", "items": {"type": ["number", "null"]}},
               "e": {"enum": ["a", 1]}}}}
C = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, status string"
R = "conv_id long, call_id string, turn long, content string, no long"


def link(spark, calls, results):
    out = op.link_tool_calls(spark.createDataFrame([(*c, "clash") for c in calls], C),
                             spark.createDataFrame([(*r, 5) for r in results], R), SCHEMAS)
    return out.collect()


def test_statuses_and_odd_rows(spark):
    calls = [(1, "a", 0, "f", '{"x": 1}', None), (1, "a", 2, "f", '{"x": 2}', None), (1, "b", 1, "f", None, ["zzz", None]),
             (1, None, 3, "f", "{}", []), (None, "q", 0, "f", "{}", []), (2, "a", 0, "h", "{", []), (1, "b", 1, "f", None, [])]
    results = [(1, "a", 1, "x é"), (1, "a", 9, "later"), (1, "gone", 4, None), (None, "q", 1, "r"), (2, "a", 1, None)]
    rows = link(spark, calls, results)
    got = sorted((str(r.conv_id), str(r.call_id), r.status, r.position or 0, r.n_results) for r in rows)
    assert got == sorted([("1", "a", "linked", 1, 2), ("1", "a", "repeated", 0, 0), ("1", "b", "open", 2, 0), ("1", "b", "repeated", 0, 0),
                          ("1", "None", "no_id", 0, 0), ("None", "q", "no_id", 0, 0), ("2", "a", "linked", 1, 1),
                          ("1", "gone", "orphan", 0, 1), ("None", "q", "orphan", 0, 1)])
    by = {(r.conv_id, r.call_id, r.status): r for r in rows}
    assert by[1, "a", "linked"].record == '{"arguments":{"x":1},"id":"a","name":"f","result":"x é"}'
    assert by[1, "b", "open"].errors == ["$.x: missing"] and by[2, "a", "linked"].errors == ["$: not JSON"]
    assert json.loads(by[2, "a", "linked"].record)["arguments"] == "{"
    assert link(spark, [], []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_order_is_topological(spark, seed):
    rnd, calls, deps = random.Random(seed), [], {}
    for conv in range(6):
        names = [f"c{i}" for i in range(25)]
        hidden = rnd.sample(names, len(names))  # dependencies follow a hidden order, turns another
        for i, n in enumerate(hidden):
            d = rnd.sample(hidden[:i], min(i, rnd.randrange(3)))
            deps[conv, n] = set(d)
            calls.append((conv, n, rnd.randrange(8), "f", '{"x": 0}', d))
    calls += [(99, "p", 1, "f", "{}", ["q"]), (99, "q", 2, "f", "{}", ["p"]), (99, "r", 0, "f", "{}", ["q"]), (99, "s", 3, "f", "{}", [])]
    rows = link(spark, calls, [])
    at = {(r.conv_id, r.call_id): r.position for r in rows}
    for (conv, n), ds in deps.items():
        assert all(at[conv, d] < at[conv, n] for d in ds)
    for conv in range(6):
        assert sorted(p for (c, _), p in at.items() if c == conv) == list(range(1, 26))
    assert {r.call_id for r in rows if r.cyclic} == {"p", "q", "r"}  # r waits for a cycle
    assert sorted(at[99, x] for x in "pqrs") == [1, 2, 3, 4]


def test_a_long_chain_of_forward_looks_takes_few_rounds(spark, monkeypatch):
    n, rounds = 60, []
    write = op.Scratch.write
    monkeypatch.setattr(op.Scratch, "write", lambda self, df, name, *a, **k: (rounds.append(name), write(self, df, name, *a, **k))[1])
    calls = spark.createDataFrame([(1, f"c{i}", i) for i in range(n)], "conv_id long, call_id string, turn long")
    edges = spark.createDataFrame([(1, f"c{i}", f"c{i + 1}") for i in range(n - 1)], "conv_id long, call_id string, dep string")
    scratch = op.Scratch(spark, "test")
    try:
        now, _ = op.latest(calls, edges, scratch)
        assert {r["at"].call_id for r in now.collect()} == {f"c{n - 1}"}
    finally:
        scratch.remove()
    assert len([x for x in rounds if x.startswith("times")]) <= 9


def test_problems():
    s = SCHEMAS["g"]
    assert op.problems({"s": "abc", "l": [1, 2.5, None], "e": 1}, s) == []
    assert op.problems({"s": "abcd", "l": [True, "x"], "e": "b", "z": 0}, s) == [
        "$.e: not in enum", "$.l[0]: not number or null", "$.l[1]: not number or null", "$.s: too long", "$.z: unexpected"]
    assert op.problems([], s) == ["$: not object"]
    assert op.problems({"x": True}, SCHEMAS["f"]) == ["$.x: not integer"]
    assert op.problems({"x": -1}, SCHEMAS["f"]) == ["$.x: too small"]


def test_whole_table_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(op.ORACLE)
    rows = op.op7_tool_calls(spark, sf_dir).select(want.columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want.fetchall()))
    # the traffic holds calls that go behind later ones, and cycles
    moved = [r for r in rows if r.position and not r.cyclic and r.turn // 2 + 1 < r.position]
    assert moved and any(r.cyclic for r in rows) and not all(r.cyclic for r in rows if r.position)


HOSTILE = {"deep": ("[" * 100_000, "nested"), "deep object": ('{"a":' * 50_000 + "1" + "}" * 50_000, "nested"),
           "half": ('{"x":"\\ud800"}', "surrogate"), "nan": ('{"x": NaN}', "not JSON"), "inf": ('{"x": -Infinity}', "not JSON"),
           "overflow": ('{"x": 1e999}', "not JSON"), "digits": ('{"x": ' + "9" * 6000 + "}", "not JSON"), "torn": ('{"x"', "not JSON"),
           "empty": ("", "not JSON"), "key": ('{"\\udc00": 1}', "surrogate")}


def test_hostile_arguments_are_invalid_and_end_nothing(spark):
    schemas = {"t": {"type": "object", "properties": {"n": {"type": "integer"}, "s": {"type": "string"}}}, "odd": {"type": "decimal"},
               "tree": {"type": "array", "items": {"type": "array"}}}
    rows = [(1, name, i, "t", text, None) for i, (name, (text, _)) in enumerate(HOSTILE.items())]
    rows += [(1, "one", 90, "t", '{"n": 1.0}', None), (1, "half one", 91, "t", '{"n": 1.5}', None), (1, "true", 92, "t", '{"n": true}', None),
             (1, "odd", 93, "odd", "{}", None), (1, "long", 94, "t", json.dumps({"s": "é" * 500_000}), None),
             (1, "pair", 95, "t", '{"s":"\\ud83d\\ude00"}', None)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "long", 95, "z" * 500_000)], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r for r in op.link_tool_calls(calls, results, schemas).collect()}
    assert len(got) == len(rows)
    for name, (text, error) in HOSTILE.items():
        assert not got[name].valid and error in got[name].errors[0], name
        assert json.loads(got[name].record)["arguments"] == text
    assert {k: got[k].valid for k in ("one", "half one", "true", "odd", "long", "pair")} == {
        "one": True, "half one": False, "true": False, "odd": False, "long": True, "pair": True}
    assert "no type decimal" in got["odd"].errors[0] and json.loads(got["pair"].record)["arguments"]["s"] == "😀"
    assert len(json.loads(got["long"].record)["result"]) == 500_000
