"""Operator 7 - chat formatting by tool-call linking.

Calls and results are hash-joined by (conversation, call id).  Calls are then
put in topological order: a call that names others it depends on comes after
them.  The time of a call is the latest turn among itself and all it depends
on, so calls that only look back keep their turn; calls that look forward are moved
behind what they wait for, and a peeling of equal times orders them among
themselves.  A time names the call it comes from, so a round also takes over
the time of that call: chains of n forward looks take about log n rounds.  Positions come from one range sort of all
calls, so a conversation with a large share of the rows is never one task's
group.  Arguments are checked against the tools' schemas, and every call is
written as canonical JSON (sorted keys, no white space, plain Unicode).

Defined results: calls without an id or conversation are not linked (status
"no_id"); of calls that repeat an id the first by turn is linked, the others
are "repeated"; of several results the first by turn counts and ``n_results``
tells; a call without a result is "open"; results without a call are listed
as "orphan" rows without a position; unknown dependencies are ignored; calls
on a cycle are marked ``cyclic`` and come last at their time; arguments that
are null count as {}; arguments that are no JSON, are nested deeper than the
parser goes, or hold half a surrogate pair, NaN or an infinity are invalid and
stand in the record as the string they came as; a schema with an unknown type
makes its calls invalid; very long arguments and results are read and written
whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import Scratch, cleaned, table
from creditlens.operators.global_order import global_rank

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed(arguments: str | None) -> tuple[object, str | None]:
    """(value, error) of JSON arguments; what cannot be written back as JSON in UTF-8 is an error, never an exception."""
    if arguments is None:
        return {}, None
    try:
        value = json.loads(arguments, parse_constant=_no_constant)
        canonical(value).encode()
        return value, None
    except RecursionError:
        return arguments, "$: nested too deeply"
    except UnicodeEncodeError:
        return arguments, "$: half a surrogate pair"
    except ValueError:
        return arguments, "$: not JSON"


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number") and isinstance(value, bool):
        return False
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()  # 1.0 is an integer of JSON Schema
    return isinstance(value, TYPES[kind])


def problems(value, schema: dict, path: str = "$") -> list[str]:
    """What a JSON value breaks of a schema: type, required, properties, additionalProperties, items, enum, bounds."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        unknown = [k for k in kinds if k not in TYPES]
        if unknown:
            return [f"{path}: the schema names no type {' or '.join(map(str, unknown))}"]
        if not any(_is(value, k) for k in kinds):
            return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unexpected")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{path}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: too long")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{path}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{path}: too large")
    return out


def record(call_id, name, arguments, result, schemas: dict) -> tuple[str | None, list[str]]:
    """Canonical JSON of one call and the errors of its arguments."""
    value, error = parsed(arguments)
    if error:
        errors = [error]
    elif name not in schemas:
        errors = ["unknown tool"]
    else:
        try:
            errors = problems(value, schemas[name])
        except RecursionError:  # a schema may ask for more calls a level than the parser
            value, errors = arguments, ["$: nested too deeply"]
    return canonical({"id": call_id, "name": name, "arguments": value, "result": result}), errors


def latest(calls: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """(conv_id, call_id, pos, at): the latest (turn, call_id) among a call and all it depends on; and whether any moved."""
    pos = calls.select("conv_id", "call_id", F.struct("turn", "call_id").alias("pos"))
    now = scratch.write(pos.withColumn("at", F.col("pos")), "times-0")
    k = 0
    while True:
        known = now.select("conv_id", F.col("call_id").alias("dep"), F.col("at").alias("dep_at"))
        moved = now.where("at.call_id <> call_id").select("conv_id", "call_id", F.col("at.call_id").alias("dep"))
        wait = (edges.select("conv_id", "call_id", "dep").unionByName(moved).join(known, ["conv_id", "dep"])
                .join(now.select("conv_id", "call_id", "at"), ["conv_id", "call_id"]).where("dep_at > at")
                .groupBy("conv_id", "call_id").agg(F.max("dep_at").alias("later")))
        k += 1
        wait = scratch.write(wait, f"wait-{k}")
        if wait.isEmpty():
            return now, k > 1
        now = scratch.write(now.join(wait, ["conv_id", "call_id"], "left").select(
            "conv_id", "call_id", "pos", F.coalesce("later", "at").alias("at")), f"times-{k}")


def times(calls: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, at, hop, cyclic): a topological order of the calls by (at, hop, turn, call_id).

    ``edges`` (conv_id, call_id, dep): dep comes first.  Work beyond one pass
    is done only for calls that look forward.
    """
    now, moved = latest(calls, edges, scratch)
    if not moved:
        return now.select("conv_id", "call_id", "at", F.lit(0).alias("hop"), F.lit(False).alias("cyclic"))
    # calls with equal times: peel those whose tight dependencies are all placed
    tight = scratch.write(
        edges.join(now.select("conv_id", F.col("call_id").alias("dep"), F.col("at").alias("dep_at")), ["conv_id", "dep"])
        .join(now.select("conv_id", "call_id", "at"), ["conv_id", "call_id"]).where("dep_at = at")
        .select("conv_id", "call_id", "dep"), "tight")
    left, placed, hop = tight, None, 0
    while not left.isEmpty():
        hop += 1
        open_ = left.select("conv_id", "call_id").distinct()
        free = left.join(open_.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi").select("conv_id", "call_id").distinct()
        ready = scratch.write(open_.join(free, ["conv_id", "call_id"], "left_anti").withColumn("hop", F.lit(hop)), f"ready-{hop}")
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.unionByName(ready)
        left = scratch.write(left.join(ready, ["conv_id", "call_id"], "left_anti"), f"left-{hop}")
    cyclic = left.select("conv_id", "call_id").distinct().withColumns({"hop": F.lit(hop + 1), "cyclic": F.lit(True)})
    placed = cyclic if placed is None else placed.withColumn("cyclic", F.lit(False)).unionByName(cyclic)
    return now.join(placed, ["conv_id", "call_id"], "left").select(
        "conv_id", "call_id", "at", F.coalesce("hop", F.lit(0)).alias("hop"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


CALLS = ["conv_id", "call_id", "turn", "name", "arguments", "depends_on"]


@cleaned
def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """calls (conv_id, call_id, turn, name, arguments, depends_on) and results (conv_id, call_id, turn, content).

    Returns conv_id, call_id, turn, name, status, position (from 1 in the
    conversation's topological order), cyclic, n_results, valid, errors, record.
    """
    spark = calls.sparkSession
    scratch = Scratch(spark, "tool-calls")
    calls = scratch.write(calls.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"),
        F.col("turn").cast("long").alias("turn"), F.col("name").cast("string").alias("name"),
        F.col("arguments").cast("string").alias("arguments"), F.col("depends_on").cast("array<string>").alias("depends_on"))
        .withColumn("no", F.monotonically_increasing_id()), "calls")
    named = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    first = named.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "no")).alias("first"))
    linked = named.join(first.select("conv_id", "call_id", F.col("first.no").alias("first_no")), ["conv_id", "call_id"])
    known = linked.where("no = first_no").drop("first_no")
    edges = scratch.write(known.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).distinct()
                          .join(known.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"]), "edges")
    order = times(known, edges, scratch)

    answers = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"),
                             F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content"))
    answers = answers.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"),
                                                        F.count(F.lit(1)).alias("n_results"))
    both = known.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"])
    ranked = global_rank(both.select("conv_id", "call_id", "at", "hop", "turn", "name", "arguments", "cyclic", "n_results",
                                     F.col("answer.content").alias("result")),
                         [F.col("conv_id"), F.col("at"), F.col("hop"), F.col("turn"), F.col("call_id")], "rank")
    starts = ranked.groupBy("conv_id").agg(F.min("rank").alias("first_rank"))
    ranked = ranked.join(starts, "conv_id").select(
        "conv_id", "call_id", "turn", "name", "arguments", "result",
        F.when(F.col("n_results").isNull(), "open").otherwise("linked").alias("status"),
        (F.col("rank") - F.col("first_rank") + 1).alias("position"), "cyclic", F.coalesce("n_results", F.lit(0)).alias("n_results"))
    rest = (calls.where("conv_id IS NULL OR call_id IS NULL").withColumn("status", F.lit("no_id"))
            .unionByName(linked.where("no <> first_no").drop("first_no").withColumn("status", F.lit("repeated"))))
    rest = rest.select("conv_id", "call_id", "turn", "name", "arguments", F.lit(None).cast("string").alias("result"), "status",
                       F.lit(None).cast("long").alias("position"), F.lit(False).alias("cyclic"), F.lit(0).cast("long").alias("n_results"))

    names = ["conv_id", "call_id", "turn", "name", "status", "position", "cyclic", "n_results"]

    def serialise(batches):
        for b in batches:
            made = [record(*x, schemas) for x in zip(*(b.column(c).to_pylist() for c in ("call_id", "name", "arguments", "result")))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array([not e for _, e in made], pa.bool_()),
                 pa.array([e for _, e in made], pa.list_(pa.string())), pa.array([r for r, _ in made], pa.string())],
                [*names, "valid", "errors", "record"])

    schema = ("conv_id long, call_id string, turn long, name string, status string, position long, cyclic boolean, "
              "n_results long, valid boolean, errors array<string>, record string")
    out = ranked.unionByName(rest).mapInArrow(serialise, schema)
    lost = answers.join(known.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "call_id", F.col("answer.turn").alias("turn"), F.lit(None).cast("string").alias("name"),
        F.lit("orphan").alias("status"), F.lit(None).cast("long").alias("position"), F.lit(False).alias("cyclic"), "n_results",
        F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("array<string>").alias("errors"),
        F.lit(None).cast("string").alias("record"))
    return scratch.finish(out.unionByName(lost))


#: The tools of the query: a user's turn asks, by its length, a search or an analysis.
SCHEMAS = {
    "search": {"type": "object", "additionalProperties": False, "required": ["limit", "query"], "properties": {
        "limit": {"type": "integer", "minimum": 1, "maximum": 6}, "query": {"type": "string", "minLength": 20}}},
    "analyse": {"type": "object", "additionalProperties": False, "required": ["query"], "properties": {
        "limit": {"type": "integer", "minimum": 1, "maximum": 5}, "query": {"type": "string", "maxLength": 1000}}},
}


def traffic(talk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conversations``: each user turn calls a tool, and the next turn, if the assistant's, is its
    result.  By the length of its text a call needs the call two turns before, the one two turns later, or none; so there
    are looks back, chains of forward looks, and cycles where a forward look meets a look back."""
    def call(turn):
        return F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), turn)

    arguments = F.to_json(F.struct(F.col("text").alias("query"), (F.col("turn") + 1).alias("limit")))
    calls = talk.where("role = 'user'").select(
        "conv_id", call(F.col("turn")).alias("call_id"), "turn",
        F.when(F.length("text") < 300, "search").otherwise("analyse").alias("name"), arguments.alias("arguments"),
        F.when(F.length("text") % 3 == 0, F.array(call(F.col("turn") - 2)))
         .when(F.length("text") % 3 == 1, F.array(call(F.col("turn") + 2))).alias("depends_on"))
    results = talk.where("role = 'assistant'").select("conv_id", call(F.col("turn") - 1).alias("call_id"), "turn",
                                                      F.col("text").alias("content"))
    return calls, results


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_tool_calls(*traffic(table(spark, sf_dir, "conversations")), SCHEMAS)
    return out.select("conv_id", "call_id", "turn", "name", "status", "position", "cyclic", "n_results", "valid",
                      F.sha2("record", 256).alias("record_sha256"))


#: A chain of forward looks ends at ``last``; all of it waits for that call.  It runs backwards from there, unless the
#: last call looks back into the chain: then all of it is cyclic and keeps the order of turns.
ORACLE = """
WITH c AS (
  SELECT conv_id, turn, text, 'call_' || conv_id || '_' || turn AS call_id,
         CASE WHEN length(text) < 300 THEN 'search' ELSE 'analyse' END AS name, coalesce(length(text) % 3, 2) AS looks
  FROM conversations WHERE role = 'user'
), near AS (
  SELECT c.*, c.looks <> 1 OR after.turn IS NULL AS ends, c.looks = 0 AND coalesce(before.looks = 1, false) AS bites
  FROM c LEFT JOIN c after ON after.conv_id = c.conv_id AND after.turn = c.turn + 2
         LEFT JOIN c before ON before.conv_id = c.conv_id AND before.turn = c.turn - 2
), chained AS (
  SELECT *, min(CASE WHEN ends THEN turn END) OVER (
    PARTITION BY conv_id, turn % 2 ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last
  FROM near
), timed AS (
  SELECT a.*, z.bites AS cyclic, row_number() OVER (
    PARTITION BY a.conv_id ORDER BY a.last, CASE WHEN NOT z.bites THEN a.last - a.turn END NULLS LAST, a.turn) AS position
  FROM chained a JOIN chained z ON z.conv_id = a.conv_id AND z.turn = a.last
), r AS (
  SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, min_by(text, turn) AS content, min(turn) AS turn,
         count(*) AS n_results
  FROM conversations WHERE role = 'assistant' GROUP BY ALL
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, c.name,
       CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'open' ELSE 'linked' END AS status,
       position, coalesce(cyclic, false) AS cyclic, coalesce(n_results, 0) AS n_results,
       CASE c.name WHEN 'search' THEN c.turn + 1 <= 6 AND length(c.text) >= 20
                   WHEN 'analyse' THEN c.turn + 1 <= 5 AND length(c.text) <= 1000 END AS valid,
       CASE WHEN c.call_id IS NOT NULL THEN sha256(
         '{"arguments":{"limit":' || (c.turn + 1) || ',"query":' || CAST(to_json(c.text) AS VARCHAR) || '},"id":"' ||
         c.call_id || '","name":"' || c.name || '","result":' ||
         coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}') END AS record_sha256
FROM timed c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""
