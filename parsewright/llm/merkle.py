"""Merkle dataset manifest (operator 11): a bottom-up build of persisted levels, and a top-down push of proofs.

Every row is a leaf. Within a group (source) the leaves, in order, are the lowest level; each run of ``ARITY`` consecutive
nodes has a parent in the next, until one node is left, the group's subroot. The subroots, ordered by group, are the leaves
of a tree of the same kind, whose top is the root. Every level is written to the shared folder. A parent keeps its run's
digests, so in the second pass, from the root down, each child joins its parent once, and puts its siblings before the
proof that the parent has inherited. Only one level is read at a time, joins are on (group, run), which at most ``ARITY``
rows share, and places in the order come from ranges of rows and one offset a range, so no group is ever in one task.

Texts are hashed where they are read and never moved. Digests are kept as 32 bytes; they count as lowercase hex text
wherever they are hashed. A proof is an array of steps (the siblings before, those after), lowest level first.

Defined results: a null field is ``-``; equal leaves of a group are interchangeable, so ties and repeated rows each have
a place and a proof; rows without a doc_id come first in their group, and count as not tampered with; a null group comes
first; very long texts are hashed whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(d: Column) -> Column:
    return F.lower(F.hex(d))


def hexes(ds: Column) -> Column:
    """Digests as one hex text."""
    return F.array_join(F.transform(ds, hexed), "")


def placed(rows: DataFrame, order: list[str], keep: list[str], shared: common.Shared, name: str) -> DataFrame:
    """The columns ``keep`` and ``idx``, the row's place (from 0) within its group ``g`` by ``order`` (nulls first).

    Rows are dealt into ranges by (g, order). A range's rows of its first group go on where the ranges before stopped;
    all its other groups start within it. So the offsets are one row a range.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(n, "g", *order).sortWithinPartitions("g", *order).select(*[c for c in rows.columns if c in keep], at.alias("_at"), F.spark_partition_id().alias("_range"))
    dealt = shared.keep(dealt, name)
    held = dealt.groupBy("_range").agg(F.min(F.struct("g")).alias("first"), F.max(F.struct("g")).alias("last"), F.count(F.lit(1)).alias("n"))
    lasts = dealt.groupBy("_range", "g").agg(F.count(F.lit(1)).alias("m"))
    ends = lasts.join(held, "_range").filter(F.col("g").eqNullSafe(F.col("last.g"))).select("_range", "first", "last", "n", "m")  # a row a range
    ranges = W.orderBy("_range")
    # A range of one group alone hands on what came before it and its own rows; any other hands on its last group's rows.
    whole = F.col("first").eqNullSafe(F.col("last"))
    breaks = F.sum(F.when(whole & F.lag("last").over(ranges).eqNullSafe(F.col("first")), 0).otherwise(1)).over(ranges)
    ends = ends.withColumn("_run", breaks)
    through = F.sum("m").over(W.partitionBy("_run").orderBy("_range"))
    ends = ends.withColumn("_through", through)
    before = F.when(F.lag("last").over(ranges).eqNullSafe(F.col("first")), F.lag("_through").over(ranges)).otherwise(0)
    offsets = ends.select("_range", F.col("first.g").alias("_g"), before.alias("_before"))
    local = F.row_number().over(W.partitionBy("_range", "g").orderBy("_at")) - 1
    more = F.when(F.col("g").eqNullSafe(F.col("_g")), F.col("_before")).otherwise(0)
    return dealt.withColumn("idx", local).join(F.broadcast(offsets), "_range").withColumn("idx", (F.col("idx") + more).cast("long")).drop("_at", "_range", "_g", "_before")


def grown(level: DataFrame, shared: common.Shared, name: str) -> list[DataFrame]:
    """All levels above the nodes (g, idx, h): each persisted as (g, idx, h, kids, lone).

    ``kids`` are the digests of the node's run. A node is ``lone`` if it stands for a group's last node, whose digest it has.
    """
    levels: list[DataFrame] = []
    while True:
        run = level.groupBy("g", F.floor(F.col("idx") / ARITY).cast("long").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("k"))  # at most ARITY
        run = run.select("g", "idx", F.col("k.h").alias("kids"))
        lone = (F.col("idx") == 0) & (F.size("kids") == 1)
        up = shared.keep(run.select("g", "idx", F.when(lone, F.col("kids")[0]).otherwise(digest(hexes(F.col("kids")))).alias("h"), "kids", lone.alias("lone")), f"{name}{len(levels)}")
        levels.append(up)
        level = up.filter("not lone")
        if level.isEmpty():
            return levels


STEP = "array<struct<before:array<binary>,after:array<binary>>>"


def pushed(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` (g, idx, ...) with their proofs and subroots, from ``parents`` (g, idx, kids, lone, proof, subroot)."""
    above = parents.select(F.col("g").alias("_g"), F.col("idx").alias("_run"), F.col("kids").alias("_kids"), F.col("lone").alias("_lone"), F.col("proof").alias("_proof"), F.col("subroot").alias("_sub"))
    on = F.col("g").eqNullSafe(F.col("_g")) & (F.floor(F.col("idx") / ARITY).cast("long") == F.col("_run"))
    at = (F.col("idx") % ARITY).cast("int")
    step = F.struct(F.slice("_kids", F.lit(1), at).alias("before"), F.slice("_kids", at + 2, F.lit(ARITY)).alias("after"))
    proof = F.when(F.col("_lone"), F.col("_proof")).otherwise(F.concat(F.array(step), F.col("_proof")))
    return children.join(above, on).select(*children.columns, proof.alias("proof"), F.col("_sub").alias("subroot"))


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame | None, shared: common.Shared, name: str) -> DataFrame:
    """``leaves`` with the proofs of the groups' last nodes (``tops``: g, proof, subroot; None: empty) pushed down through ``levels``."""
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        last = levels[k].filter("lone")
        if tops is None:
            last = last.withColumn("proof", F.array().cast(STEP)).withColumn("subroot", F.lit(None).cast("binary"))
        else:
            given = tops.select(F.col("g").alias("_t"), "proof", "subroot")
            last = last.join(given, F.col("g").eqNullSafe(F.col("_t"))).drop("_t")
        if above is not None:
            last = last.unionByName(pushed(levels[k].filter("not lone"), above))
        above = shared.keep(last, f"{name}{k}")
        shared.drop(f"{name}{k + 1}")
    return pushed(leaves, above)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: digest(hexes(s["before"]), hexed(h), hexes(s["after"])))


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (g, key, leaf, and what rides along) with subroot, root (digests) and proof; leaves ascend by key within g."""
    shared = common.Shared(rows.sparkSession)
    kept = shared.keep(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    leaves = shared.keep(placed(kept, ["key", "leaf", "_row"], rows.columns, shared, "dealt"), "placed")
    shared.drop("leaves")
    shared.drop("dealt")
    levels = grown(leaves.select("g", "idx", F.col("leaf").alias("h")), shared, "level")
    subroots = levels[0].filter("lone")
    for up in levels[1:]:
        subroots = subroots.unionByName(up.filter("lone"))
    subroots = subroots.select(F.lit(0).alias("g"), F.col("g").alias("group"), F.col("h"))
    subroots = shared.keep(placed(subroots, ["group"], ["g", "group", "h"], shared, "groups"), "subroots")
    upper = grown(subroots.select("g", "idx", "h"), shared, "upper")
    tops = descend(subroots, upper, None, shared, "top")
    tops = shared.keep(tops.select(F.col("group").alias("g"), "proof", F.col("h").alias("subroot")), "tops")
    root = upper[-1].filter("lone").select(F.col("h").alias("root"))  # one row
    return descend(leaves, levels, tops, shared, "proof").drop("idx").crossJoin(F.broadcast(root))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(g, key, leaf, changed): each document's leaf, and the leaf that tampering makes of it (null: not tampered with)."""
    docs = docs.select(*[F.col(f"`{f}`").alias(f) for f in FIELDS])
    rest = [field(F.col(f)) for f in FIELDS[:-1]]
    tampers = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    changed = F.when(tampers, digest(*rest, field(F.translate(F.col("text"), "\n", ""))))
    return docs.select(F.col("source").alias("g"), F.col("doc_id").alias("key"), digest(*[field(F.col(f)) for f in FIELDS]).alias("leaf"), changed.alias("changed"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Per document: leaf, subroot and root in hex, its proof, the root that its (perhaps tampered) leaf folds to, and whether that is the root."""
    out = manifest(leaves_of(docs))
    again = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    out = out.select(F.col("key").alias("doc_id"), *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], "proof", hexed(again).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, and what tampering with line breaks does to them."""
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(hexes(s["before"]), hexes(s["after"]))), "")
    out = document_manifest(common.load(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


#: CRC-32 in SQL: the table of its bytes, and the number of a whole number's decimal digits (4294967295 and 3988292384 are fixed values).
CRC_TABLE = """tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE
{CRC_TABLE},
f AS (SELECT doc_id, source, text,
        {crc_sql('doc_id')} % 2 = 0 AS even,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
        replace(text, chr(10), '') AS cut FROM documents, tab),
d AS (SELECT doc_id, source, head, text, cut, coalesce(even, false) AS even, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (
  SELECT source, 0 AS lvl, idx, leaf AS h, n FROM l
  UNION ALL
  SELECT source, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, h, n FROM s
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
below AS (
  SELECT a.source, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.source, a.lvl, a.idx),
above AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY a.lvl, a.idx),
step AS (
  SELECT x.source, x.idx0, b.lvl, b.before, b.after FROM (SELECT source, idx AS idx0 FROM l) x
  JOIN below b ON x.source IS NOT DISTINCT FROM b.source AND b.idx = x.idx0 // CAST(power(3, b.lvl) AS BIGINT)
  UNION ALL
  SELECT l.source, l.idx, 100 + a.lvl, a.before, a.after FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
  JOIN above a ON a.idx = s.idx // CAST(power(3, a.lvl) AS BIGINT)),
p AS (SELECT source, idx0, list({{'b': before, 'a': after}} ORDER BY lvl) AS steps, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof FROM step GROUP BY source, idx0),
fold AS (
  SELECT l.source, l.idx, 0 AS k, coalesce(p.steps, []) AS steps,
         CASE WHEN l.text IS NOT NULL AND l.even THEN sha256(l.head || strlen(l.cut) || ':' || l.cut) ELSE l.leaf END AS h
  FROM l LEFT JOIN p ON l.source IS NOT DISTINCT FROM p.source AND l.idx = p.idx0
  UNION ALL
  SELECT source, idx, k + 1, steps, sha256(steps[k + 1].b || h || steps[k + 1].a) FROM fold WHERE k < len(steps))
SELECT l.doc_id, l.leaf, u.h AS subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM l JOIN up u ON u.n = 1 AND u.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT h FROM top WHERE n = 1) r
JOIN fold f ON f.source IS NOT DISTINCT FROM l.source AND f.idx = l.idx AND f.k = len(f.steps)
LEFT JOIN p ON p.source IS NOT DISTINCT FROM l.source AND p.idx0 = l.idx
"""
