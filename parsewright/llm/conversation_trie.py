"""Conversation prefix trie (operator 13): a node for each distinct sequence of first turns, with counts of its subtree.

A turn is an item of 20 bytes: 16 of a digest of role and text, 4 with the text's code points. A conversation is its items in
a row, so texts move once, into their order. Equal conversations become one path with its number, its least id and the
digest of its ids, whatever their number; what follows works on distinct paths.

Paths are dealt out by the digest of their first turn, and tries are built inside applyInPandas: children are pointers in
dictionaries, and an iterative postorder sums up subtrees. Subtries that share a task have ``limit`` turns on average. A
first turn with more gets a spine instead: its paths share turns up to the longest common prefix of the least and the
greatest of them, and are dealt out anew by the next turn, again and again until no subtrie with more than one path is
larger. Counts of spine nodes are known on the way down; leaves and savings of their subtrees come up from the tops of what
hangs on them, pre-aggregated. There are at most total / limit spines a round.

Defined results: null roles and texts count as empty; turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows have one order and each row is a turn; rows without a conv_id belong to no conversation and give nothing;
very long texts are hashed whole; an empty table gives an empty result; extra columns are ignored, whatever their names.

Limits: a conversation's items (not its texts) stand in one row, so a conversation has at most 100 million turns. SHA-256 of a
node's ids is sequential by definition: they are sorted by Spark and pass one task as a stream, 24 bytes each, none held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .merkle import CRC_TABLE, crc_sql

ITEM = 20
#: Turns of distinct paths that a subtrie of several paths may have before it is dealt out by its next turn.
LIMIT = 100_000
NOTHING = hashlib.sha256(b"").hexdigest()


def item() -> Column:
    size = F.char_length("role").cast("string")
    chars = F.lpad(F.hex(F.char_length("text")), 8, "0")
    return F.unhex(F.concat(F.md5(F.concat(size, F.lit(":"), "role", "text").cast("binary")), chars))


def paths(conversations: DataFrame, shared: common.Shared) -> DataFrame:
    """(conv_id, path): the items of every conversation, in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text")).filter("conv_id is not null")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("at"), item().alias("item"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("turns"))
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["item"])), ""))
    return shared.keep(held.select("conv_id", joined.alias("path")), "paths")


def rebuilt(convs: DataFrame, heads: int, every: int) -> DataFrame:
    """Each conversation with its first turns taken from the first one of its ``every`` ids; crc32 says how many, under ``heads``."""
    first = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.substring("path", 1, ITEM * (heads - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int") * ITEM
    own = F.substring("path", h + 1, F.octet_length("path"))
    lent = F.coalesce(F.substring("head", F.lit(1), h), F.lit(b""))
    return convs.join(first, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left").select("conv_id", F.concat(lent, own).alias("path"))


ENDS = "pid binary, n long, least long, ends string"


def distinct_paths(convs: DataFrame, shared: common.Shared) -> DataFrame:
    """(path, n, least, ends): each path once, with the number of its conversations, the least of their ids and the digest of all."""
    convs = shared.keep(convs.withColumn("pid", F.unhex(F.md5("path"))), "rebuilt")
    arrow = common.to_arrow(ENDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, least, seen = None, 0, 0, None
        for batch in batches:
            out = []
            for pid, c in zip(batch.column("pid").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if pid != last:
                    if last is not None:
                        out.append((last, n, least, seen.hexdigest()))
                    last, n, least, seen = pid, 1, c, hashlib.sha256(b"%d" % c)
                else:
                    n += 1
                    seen.update(b",%d" % c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((last, n, least, seen.hexdigest()), arrow, strict=True)], schema=arrow)

    ends = common.map_arrow(convs.select("pid", "conv_id").repartition("pid").sortWithinPartitions("pid", "conv_id"), run, ENDS)
    one = convs.groupBy("pid").agg(F.first("path").alias("path"))
    return shared.keep(one.join(ends, "pid").drop("pid"), "distinct")


def _common(least: pd.Series, greatest: pd.Series) -> pd.Series:
    """Items that two paths have in common at their start."""

    def of(a: bytes, b: bytes) -> int:
        low, high = 0, min(len(a), len(b)) // ITEM
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[: mid * ITEM] == b[: mid * ITEM] else (low, mid - 1)
        return low

    return pd.Series([of(a, b) for a, b in zip(least, greatest, strict=True)], dtype="int32")


def prefix_key(cut: Column) -> Column:
    return F.unhex(F.md5(F.substring("path", F.lit(1), cut * ITEM)))


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, spine binary"


def grow(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries of a bucket: those of depth ``cut`` are tops, which name the spine that they hang on."""
    kids: list[dict[bytes, int]] = []
    parent, depth, n, least, chars, ends, spine, above = [], [], [], [], [], [], [], []
    tops: dict[bytes, int] = {}

    def new(up: int, at: int, item: bytes) -> int:
        kids.append({})
        parent.append(up)
        depth.append(at)
        n.append(0)
        least.append(None)
        chars.append(int.from_bytes(item[16:], "big"))
        ends.append(NOTHING)
        spine.append(None)
        above.append(None)
        return len(kids) - 1

    for key, cut, path, count, first, digest, on, over in zip(*(frame[c] for c in ("key", "cut", "path", "n", "least", "ends", "spine", "above")), strict=True):
        node = tops.get(key)
        if node is None:
            node = tops[key] = new(-1, cut, path[(cut - 1) * ITEM : cut * ITEM])
            spine[node], above[node] = on, over
        at = cut
        while True:
            n[node] += count
            least[node] = first if least[node] is None or first < least[node] else least[node]
            if at * ITEM >= len(path):
                break
            item = path[at * ITEM : (at + 1) * ITEM]
            at += 1
            child = kids[node].get(item)
            if child is None:
                child = kids[node][item] = new(node, at, item)
            node = child
        ends[node] = digest
    leaves, saved = [0] * len(kids), [(m - 1) * c for m, c in zip(n, chars, strict=True)]
    for node in range(len(kids) - 1, -1, -1):  # children were made after their parents: a postorder without recursion
        leaves[node] += not kids[node]
        up = parent[node]
        if up >= 0:
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            above[node] = least[up]
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "spine": spine})


def trie(distinct: DataFrame, shared: common.Shared, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of ``distinct`` (path, n, least, ends), which is a table that was written."""
    size = F.octet_length("path") / ITEM
    total = distinct.agg(F.sum(size + 1)).first()[0] or 0
    if not total:
        return distinct.sparkSession.createDataFrame([], NODES).drop("spine")
    shared_turns = F.pandas_udf(_common, "int")
    spines: list[DataFrame] = []
    stops: list[DataFrame] = []
    closed: DataFrame | None = None
    rows = distinct.select("*", F.lit(0).alias("cut"), F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("spine"), F.lit(None).cast("long").alias("above"))
    while True:
        held = rows.groupBy("key").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.sum("n").alias("n_convs"), F.min("least").alias("first"), F.first("cut").alias("from"), F.first("spine").alias("up"), F.first("above").alias("over"))
        held = held.withColumn("to", shared_turns("low", "high"))
        start = F.greatest(F.col("from"), F.lit(1))
        items = F.substring("low", (start - 1) * ITEM + 1, (F.col("to") - start + 1) * ITEM)
        spine = shared.keep(held.select("key", "from", "to", "n_convs", "first", "up", "over", F.when(F.col("to") >= start, items).otherwise(F.lit(b"")).alias("items")), f"spine{len(spines)}")  # at most total / limit rows
        spines.append(spine)
        met = rows.select("path", "n", "least", "ends", "key").join(F.broadcast(spine.select("key", "to", "first")), "key")
        stops.append(met.filter(size == F.col("to")).select("key", "ends"))
        cut = F.col("to") + 1
        rest = met.filter(size > F.col("to")).select("path", "n", "least", "ends", cut.alias("cut"), prefix_key(cut).alias("k"), F.col("key").alias("spine"), F.col("first").alias("above")).withColumnRenamed("k", "key")
        large = shared.keep(rest.groupBy("key").agg(F.sum(size).alias("turns"), F.count(F.lit(1)).alias("m")).filter((F.col("turns") > limit) & (F.col("m") > 1)).select(F.col("key").alias("large")), f"large{len(spines)}")
        marked = rest.join(F.broadcast(large), F.col("key") == F.col("large"), "left")  # at most total / limit keys
        small = marked.filter("large is null").drop("large")
        closed = small if closed is None else closed.unionByName(small)
        if large.isEmpty():
            break
        rows = shared.keep(marked.filter("large is not null").drop("large"), f"open{len(spines)}")
    buckets = max(1, -(-int(total) // limit), int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = closed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    nodes = shared.keep(dealt.groupBy("bucket").applyInPandas(grow, NODES), "nodes")

    def hung(tops: DataFrame) -> DataFrame:
        return tops.filter("spine is not null").groupBy("spine").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))

    below = hung(nodes)
    found = nodes.drop("spine")
    for k in range(len(spines) - 1, -1, -1):
        done = shared.keep(spine_nodes(spines[k], below, stops[k]), f"done{k}")
        found = found.unionByName(done.drop("spine"))
        if k:
            below = hung(nodes.select("spine", "n_leaves", "saved_tokens").unionByName(done.select("spine", "n_leaves", "saved_tokens")))
    return found


def spine_nodes(spine: DataFrame, below: DataFrame, stops: DataFrame) -> DataFrame:
    """The nodes of a round's spines, from what hangs on their lower ends and the paths that stop there."""
    below = below.withColumnRenamed("spine", "key")
    at = spine.join(below, "key", "left").join(stops, "key", "left")
    depth = F.explode(F.sequence("from", "to"))
    each = at.select("*", depth.alias("depth"))
    low = F.col("depth") == F.col("to")
    place = (F.col("depth") - F.greatest(F.col("from"), F.lit(1))) * ITEM
    chars = F.when(F.col("depth") > 0, F.conv(F.hex(F.substring("items", place + 17, F.lit(4))), 16, 10).cast("long")).otherwise(0)
    own = (F.col("n_convs") - 1) * chars + F.when(low, F.coalesce("saved", F.lit(0))).otherwise(0)
    up = W.partitionBy("key").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    top = F.col("depth") == F.col("from")
    return each.select(
        F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(top, F.col("over")).otherwise(F.col("first")).alias("parent_conv_id"), "n_convs",
        F.when(low, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.sum(own).over(up).cast("long").alias("saved_tokens"), F.when(low, F.coalesce("ends", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"), F.when(top, F.col("up")).alias("spine"))


def prefix_trie(conversations: DataFrame, heads: int = 6, every: int = 100, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    shared = common.Shared(conversations.sparkSession)
    return trie(distinct_paths(rebuilt(paths(conversations, shared), heads, every), shared), shared, limit)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie(common.load(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id AS c, conv_id - conv_id % 100 AS b, {crc_sql('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
r AS (SELECT c, k, role, text FROM ids JOIN t ON t.conv_id = b AND k <= h UNION ALL SELECT c, 6 + k, role, text FROM ids JOIN t ON t.conv_id = c AND k > h),
q AS (SELECT c, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS key, length(text) AS chars FROM r WINDOW w AS (PARTITION BY c ORDER BY k)),
m AS (SELECT c, 0 AS d, '' AS key, 0 AS chars FROM ids UNION ALL SELECT c, d, sha256(key), chars FROM q),
z AS (SELECT c, max(d) AS d FROM m GROUP BY c),
e AS (SELECT d, key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM m JOIN z USING (c, d) GROUP BY d, key),
n AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved FROM m GROUP BY d, key),
p AS (SELECT n.*, u.key AS up FROM n LEFT JOIN m u ON u.c = n.conv_id AND u.d = n.d - 1),
k AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM p WHERE d > 0 GROUP BY d, up),
s AS (SELECT a.d, a.key, sum(p.saved) AS saved_tokens, count(*) FILTER (k.key IS NULL) AS n_leaves
      FROM p LEFT JOIN k USING (d, key) JOIN m a ON a.c = p.conv_id AND a.d <= p.d GROUP BY a.d, a.key)
SELECT p.conv_id, CAST(p.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, p.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM p JOIN s USING (d, key) LEFT JOIN k USING (d, key) LEFT JOIN e USING (d, key) LEFT JOIN n u ON u.d = p.d - 1 AND u.key = p.up
"""
