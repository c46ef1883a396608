"""Operator 11 - Merkle dataset manifest by slot pivot.

Every row is a leaf; the leaves of a group (here: a language) in ascending id
order form a tree of ``fanout`` children a node, the groups' roots another
tree above.  A level is one aggregation: conditional aggregates spread the
children of a parent into ``fanout`` slot columns, and the digest of the
concatenated columns is the parent.  The same wide row proves its children:
the columns left and right of a child's own slot are its siblings.  Levels are
stored, and read again from the root down: each parent hands its own path to
its children, so a leaf's proof is the list of (left, right) strings up to the
root.  Folding a leaf through that list recomputes the root.

Positions come from ``positions`` (a group that holds most rows is cut into
slices), a parent never has more than ``fanout`` children, and a level holds
1 / fanout of the rows of the level below, so nothing meets in one task but
the last few nodes.

Defined results: a null column counts as ``-`` in the leaf; a null id comes
first, and rows that repeat an id follow each other by their leaves; a null
group is a group and comes first; a group of one row has that leaf as its
root; a very long text is hashed whole, in the scan, and only digests are
shuffled; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import LOWER, UPPER, Scratch, table
from creditlens.operators.segments import positions

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def part(value: Column) -> Column:
    """UTF-8 byte count, ':' and the value; '-' for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(part, fields)), 256)


def pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """(grp, pos, n, s0.., digest) of the parents of (grp, pos, n, digest): one slot column a child."""
    slot = F.col("pos") % fanout
    wide = nodes.groupBy("grp", F.expr(f"pos div {fanout}").alias("pos")).agg(
        F.ceil(F.max("n") / fanout).alias("n"),
        *(F.max(F.when(slot == i, F.col("digest"))).alias(f"s{i}") for i in range(fanout)))
    return wide.withColumn("digest", F.sha2(F.concat(*(F.coalesce(f"s{i}", F.lit("")) for i in range(fanout))), 256))


def beside(slots: list[str], own: Column) -> Column:
    """struct(left, right): the digests in the slot columns before and after the own one."""
    def side(taken) -> Column:
        return F.concat(*(F.when(taken(i), F.coalesce(c, F.lit(""))).otherwise("") for i, c in enumerate(slots)))

    return F.struct(side(lambda i: F.lit(i) < own).alias("left"), side(lambda i: F.lit(i) > own).alias("right"))


def levels(nodes: DataFrame, fanout: int, scratch: Scratch, label: str) -> list[DataFrame]:
    """Stored levels from the leaves up; level k + 1 has the parents of the nodes of groups not yet down to one."""
    out = [nodes]
    while not out[-1].where("n > 1").isEmpty():
        out.append(scratch.write(pivot(out[-1].where("n > 1"), fanout), f"{label}-{len(out)}"))
    return out


PATH = "array<struct<left:string,right:string>>"


def descend(levels: list[DataFrame], roots: DataFrame, fanout: int, scratch: Scratch, label: str) -> DataFrame:
    """Level 0 with ``path`` and the other columns of ``roots`` (grp, path, ...), each group's root among them.

    A parent meets its children as one wide row; their siblings are read off its slots after the join."""
    extra = [c for c in roots.columns if c not in ("grp", "path")]
    slots = [f"s{i}" for i in range(fanout)]
    ends, down = roots.withColumnRenamed("grp", "_g"), None
    for k in reversed(range(len(levels))):
        nodes = levels[k]
        # the nodes that are their group's root at this level
        out = nodes.where("n = 1").join(ends, F.expr("grp <=> _g")).select(*nodes.columns, *extra, "path")
        if down is not None:
            up = down.select(F.col("grp").alias("_g"), F.col("pos").alias("_p"), "path", *extra,
                             *(F.col(c).alias(f"_{c}") for c in slots))
            met = nodes.where("n > 1").join(up, F.expr(f"grp <=> _g AND pos div {fanout} = _p"))
            step = beside([f"_{c}" for c in slots], F.col("pos") % fanout)
            out = out.unionByName(met.select(*nodes.columns, *extra, F.concat(F.array(step), "path").alias("path")))
        down = scratch.write(out, f"{label}-{k}") if k else out
    return down


def fold(start: Column) -> Column:
    """The root reached from a leaf through its ``path``."""
    return F.aggregate("path", start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def merkle(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS,
           tampered: dict[str, Column] | None = None, tamper: Column | None = None,
           fanout: int = FANOUT, with_path: bool = False) -> DataFrame:
    """Manifest of ``docs``: one row per row with its leaf, its group's root, the root and its proof.

    Where ``tamper`` holds, the columns of ``tampered`` replace the row's own
    before the proof is folded, so ``verified`` tells whether the proof
    catches the change.  ``with_path`` adds the proof itself: the siblings'
    digests left and right of the node, from the leaf's level to the root's.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    try:
        own = [F.col(c) for c in fields]
        changed = [(tampered or {}).get(c, F.col(c)) for c in fields]
        rows = docs.select(
            F.col(order).alias("id"), F.col(group).alias("grp"), leaf(own).alias("digest"),
            F.when(F.coalesce(tamper, F.lit(False)), leaf(changed)).alias("changed") if tamper is not None
            else F.lit(None).cast("string").alias("changed"))
        placed = positions(rows, ["grp"], ["id", "digest"], rank_col="_at", total_col="n")
        base = scratch.write(placed.withColumn("pos", F.col("_at") - 1).drop("_at"), "leaves")

        trees = levels(base.select("grp", "pos", "n", "digest"), fanout, scratch, "node")
        tops = trees[0].where("n = 1").select("grp", "digest")
        for level in trees[1:]:
            tops = tops.unionByName(level.where("n = 1").select("grp", "digest"))
        heads = positions(tops.withColumnRenamed("grp", "name").withColumn("grp", F.lit(0)), ["grp"], ["name"],
                          rank_col="_at", total_col="n")
        heads = scratch.write(heads.withColumn("pos", F.col("_at") - 1).drop("_at"), "heads")
        above = levels(heads.select("grp", "pos", "n", "digest"), fanout, scratch, "head")
        peak = above[-1].where("n = 1").select(
            "grp", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
        of_heads = descend([heads] + above[1:], peak, fanout, scratch, "path-of-heads")
        roots = scratch.write(of_heads.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path"),
                              "roots")
        proven = descend([base] + trees[1:], roots, fanout, scratch, "path")
        out = proven.select(
            F.col("id").alias(order), F.col("digest").alias("leaf"), "subroot", "root",
            F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"]))), 256).alias("proof_sha256"),
            fold(F.coalesce("changed", "digest")).alias("folded_root"), *(["path"] if with_path else []))
        out = out.withColumn("verified", F.col("folded_root") == F.col("root"))
        return scratch.finish(out)
    except BaseException:
        scratch.remove()
        raise


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle(docs, tamper=third, tampered={"text": F.translate("text", UPPER, LOWER)})


#: CRC-32 of the decimal doc_id bit by bit (DuckDB has none), the levels as a recursive table, proofs by position arithmetic.
ORACLE = f"""
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT *, {'||'.join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS[:4])} AS head
  FROM documents),
crc AS (
  SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0,1,2,3,4,5,6,7]),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS inv
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
leaves AS MATERIALIZED (
  SELECT rows.doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(inv, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-'))
    END AS changed
  FROM rows LEFT JOIN crc ON rows.doc_id = crc.doc_id),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
node(lang, lvl, pos, digest) AS (
  SELECT lang, 0, pos, leaf FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang, lvl) AS width FROM node) WHERE width > 1 GROUP BY lang, lvl, pos // {FANOUT}),
subroot AS (
  SELECT lang, lvl, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos
  FROM (SELECT *, max(lvl) OVER (PARTITION BY lang) AS top FROM node) WHERE lvl = top),
high(lvl, pos, digest) AS (
  SELECT 0, pos, digest FROM subroot
  UNION ALL
  SELECT lvl + 1, pos // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY lvl) AS width FROM high) WHERE width > 1 GROUP BY lvl, pos // {FANOUT}),
peak AS (SELECT max(lvl) AS top FROM high),
-- every step of every proof: the place of the node at that level, and the run it lies in
steps AS (
  SELECT p.lang, p.pos AS leaf_pos, k AS lvl, p.pos // CAST({FANOUT} ** k AS BIGINT) AS place
  FROM placed p JOIN subroot s ON p.lang IS NOT DISTINCT FROM s.lang, unnest(range(s.lvl)) AS _(k)),
below AS (
  SELECT s.lang, s.leaf_pos, s.lvl, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < s.place), '') AS l,
    coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > s.place), '') AS r
  FROM steps s JOIN node n ON n.lang IS NOT DISTINCT FROM s.lang AND n.lvl = s.lvl AND n.pos // {FANOUT} = s.place // {FANOUT}
  GROUP BY s.lang, s.leaf_pos, s.lvl),
above AS (
  SELECT s.lang, s.lvl + k AS lvl, coalesce(string_agg(h.digest, '' ORDER BY h.pos) FILTER (h.pos < s.pos // CAST({FANOUT} ** k AS BIGINT)), '') AS l,
    coalesce(string_agg(h.digest, '' ORDER BY h.pos) FILTER (h.pos > s.pos // CAST({FANOUT} ** k AS BIGINT)), '') AS r
  FROM (SELECT s.*, unnest(range(top)) AS k FROM subroot s, peak) s
  JOIN high h ON h.lvl = k AND h.pos // {FANOUT} = (s.pos // CAST({FANOUT} ** k AS BIGINT)) // {FANOUT}
  GROUP BY s.lang, s.lvl, k),
whole AS (
  SELECT lang, leaf_pos, lvl, l, r FROM below
  UNION ALL SELECT p.lang, p.pos, a.lvl, a.l, a.r FROM placed p JOIN above a ON a.lang IS NOT DISTINCT FROM p.lang),
proof AS (
  SELECT lang, leaf_pos, list({{'l': l, 'r': r}} ORDER BY lvl) AS path, string_agg(l || r, '' ORDER BY lvl) AS text
  FROM whole GROUP BY lang, leaf_pos),
fold(lang, pos, k, cur) AS (
  SELECT lang, pos, 0, coalesce(changed, leaf) FROM placed
  UNION ALL
  SELECT f.lang, f.pos, k + 1, sha256(path[k + 1].l || cur || path[k + 1].r)
  FROM fold f JOIN proof p ON p.lang IS NOT DISTINCT FROM f.lang AND p.leaf_pos = f.pos WHERE k < len(path))
SELECT p.doc_id, p.leaf, s.digest AS subroot, root.digest AS root, sha256(coalesce(q.text, '')) AS proof_sha256,
  f.cur AS folded_root, f.cur = root.digest AS verified
FROM placed p JOIN subroot s ON s.lang IS NOT DISTINCT FROM p.lang
LEFT JOIN proof q ON q.lang IS NOT DISTINCT FROM p.lang AND q.leaf_pos = p.pos
JOIN fold f ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND f.k = coalesce(len(q.path), 0),
(SELECT digest FROM high JOIN peak ON lvl = top) AS root"""
