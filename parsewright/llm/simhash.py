"""SimHash near-duplicates (operator 9) by covering locality-sensitive hashing.

Every bit position of a fingerprint gets a non-zero vector of ``radius + 1`` bits. For each of the 2^(radius+1) - 1
non-zero vectors v, a table's mask keeps the positions whose vector has an odd product with v. Up to ``radius``
differing positions give as many linear equations, which some v solves: the mask of that v keeps none of those
positions, so both fingerprints have the same key in its table. No pair within the radius is missed.

Only distinct fingerprints enter the tables. A key's fingerprints are compared in blocks of bounded size: a large
group is dealt into chunks, and every two chunks meet in one task's block, which emits a spanning forest of its
links and never the pairs. Components are found by the star contraction in ``graphs``. Copies, which share a
fingerprint, only meet in counts and in the join back; fingerprints of more than a thousandth of the documents
are joined by a broadcast of at most a thousand rows.

Defined results: a null text counts as empty and has fingerprint zero, which links like any other; a very long text is
hashed in blocks; a bit that exactly half of the shingles set is 0; rows that repeat a doc_id are one document to the
components; a null doc_id takes part in links but is never a component's id (null where a component has no other); extra
columns are ignored (``keep_one`` keeps them), whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graphs

BITS = 64
NO_ID = 1 << 62
SHINGLES = 1 << 15  # hashed at a time, so that a very long text needs no more


def fingerprint(text: str, shingle: int = 3) -> int:
    """A-Z lower-cased, words cut at ASCII white space; each shingle's XXH64 votes on every bit, over half sets it."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest, data = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return digest(data, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    n = len(starts)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, n, SHINGLES):
        hashes = [digest(data[a:b], 42) for a, b in zip(starts[k : k + SHINGLES].tolist(), ends[k : k + SHINGLES].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(len(hashes), 8), axis=1)
        lanes = bits.view(np.uint64)  # eight one-byte counters side by side; 255 rows can't overflow one
        for j in range(0, len(hashes), 255):
            votes += lanes[j : j + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """All columns but the text, and the fingerprint as a signed long."""
    others = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                made = np.array([fingerprint(t, shingle) for t in common.texts_of(part)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(made)], names=[*names, "fp"])

    return common.map_arrow(docs, run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "fp long"]))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector; positions take the non-zero vectors in turn, so masks are about equally wide."""
    vectors = range(1, 1 << (radius + 1))
    at = [1 + i % len(vectors) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (at[i] & v).bit_count() % 2) for v in vectors]


def forest(fps: np.ndarray, first: int, radius: int) -> np.ndarray:
    """For each fingerprint the index of the least one that it reaches within the block.

    ``first`` > 0: only links between the first ``first`` and the others are sought.
    """
    n = len(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    if first:
        near[:first, :first] = False
        near[first:, first:] = False
        np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(keyed: DataFrame, radius: int, kind: str) -> DataFrame:
    """Rows (v, key, i, j, c, fp, node), sorted by block: forest edges (a, b) of every block."""

    def edges(rows: dict[str, np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        fps, node = rows["fp"][a:b].view(np.uint64), rows["node"][a:b]
        if b - a == 2:
            if (int(fps[0]) ^ int(fps[1])).bit_count() > radius:
                return node[:0], node[:0]
            return node[:1], node[1:]
        i, j, c = rows["i"][a], rows["j"][a], rows["c"][a:b]
        label = forest(fps, int((c == i).sum()) if i != j else 0, radius)
        at = np.flatnonzero(label != np.arange(b - a))
        return node[at], node[label[at]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("v", "key", "i", "j", "c", "fp", "node")
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: batch.column(n).to_numpy() for n in names}
            if held is not None:
                rows = {n: np.concatenate((held[n], rows[n])) for n in names}
            new = np.ones(len(rows["fp"]), bool)
            new[1:] = np.any([rows[n][1:] != rows[n][:-1] for n in names[:4]], axis=0)
            cuts = np.flatnonzero(new)
            found = [edges(rows, a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1]
            held = {n: x[cuts[-1] :] for n, x in rows.items()}  # the last block may go on; a block is of bounded size
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])
        if held is not None and len(held["fp"]) > 1:
            a, b = edges(held, 0, len(held["fp"]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return common.map_arrow(keyed, run, "a long, b long")


def near_pairs(nodes: DataFrame, radius: int, total: int, chunk: int = 1024) -> DataFrame:
    """Edges (a, b) between nodes of distinct fingerprints that span all links within the radius."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("v", "key"))
    sizes = keyed.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = graphs.spread_join(keyed, sizes, ["v", "key"], "n", ["n"], total * len(masks)).filter("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    keyed = keyed.withColumn("c", F.pmod(F.xxhash64("fp"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    keyed = keyed.select("v", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "fp", "node")
    keyed = keyed.repartition("v", "key", "i", "j").sortWithinPartitions("v", "key", "i", "j", "c", "fp")
    return block_links(keyed, radius, "long")


def components(prints: DataFrame, radius: int = 3, by_text: bool = False) -> DataFrame:
    """Adds ``component`` to a written table of (doc_id long, fp, ...): the least doc_id reachable, or NO_ID and more without any.

    ``by_text``: the least fingerprint reachable instead, so that texts alone link rows, not a doc_id that they share.
    """
    shared = common.Shared(prints.sparkSession)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    node = F.col("fp") if by_text else F.coalesce("least", F.lit(NO_ID) + F.pmod("fp", F.lit(NO_ID)))
    nodes = shared.keep(nodes.select("fp", node.alias("node"), "n"), "nodes")
    total, distinct = (r := nodes.agg(F.sum("n"), F.count(F.lit(1))).first())[0] or 0, r[1]
    if not distinct:
        return prints.withColumn("component", F.col("doc_id"))
    label = graphs.connected(near_pairs(nodes, radius, distinct))
    of = nodes.join(label, "node", "left").select("fp", F.coalesce("label", "node").alias("component"), "n")
    return graphs.spread_join(prints, of, ["fp"], "n", ["component"], total)


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id (long) for every row of docs (doc_id, text)."""
    out = components(common.Shared(docs.sparkSession).keep(fingerprints(plain(docs), shingle), "prints"), radius)
    return out.select("doc_id", "fp", F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """Of every component one row of docs, with all its columns: the one of least doc_id (nulls last), then of least hash.

    Rows of equal doc_id and text are one row. Decided on a narrow table; repeated rows meet before they are shuffled.
    """
    key = ["_h1", "_h2"]
    hashed = docs.withColumns({"_h1": F.xxhash64("doc_id", "text"), "_h2": F.xxhash64(F.lit(1), "doc_id", "text")})
    narrow = hashed.select(F.col("doc_id").cast("long").alias("doc_id"), *key, F.col("text").cast("string").alias("text"))
    prints = components(common.Shared(docs.sparkSession).keep(fingerprints(narrow, shingle), "prints"), radius, True)
    best = prints.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *key)).alias("m")).select("m._h1", "m._h2")
    return hashed.dropDuplicates(key).join(best, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = groups(common.load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
