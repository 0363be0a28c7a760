"""Quality rules (operator 4): compression bands beside a few counts of words, symbols and repeats.

Method. A text's zstandard ratio (compressed by raw bytes) over the whole document, and over its fixed chunks, must lie
between the limits for its length: below the lower limit it repeats itself, above the upper one it does not compress as
language does. A document is rejected if the whole lies outside, or if the chunks outside their limits hold more than
``chunk_share`` of its bytes.

The limits are the corpus' own. Lengths fall into ``CLASSES`` classes an octave; of each class the median and the median
deviation of the log ratio are taken over all documents that pass the base rule (equal pairs of length and ratio, as
copies have, count once), for whole documents and for chunks apart (of each document the middle full chunk and the rest,
so that a long text counts no more than others), and the limits lie ``z`` such deviations off. A class
with fewer than ``LEAST`` texts takes in its neighbours, as far as there are any, with their ratios moved by what the
difference in length explains (``expected``); and median and deviation are drawn towards that curve and ``SPREAD`` by the
weight of a few texts, so small corpora are judged like large ones. Every document is measured once; the statistics are
counts by class and bin, a bounded table.

Defined results: a null text counts as empty: no words, so the base rule fails; a very long text is compressed whole and
chunk by chunk; a ratio that equals a limit is inside; repeated rows each give a row; extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
SPACES = b" \t\n\r\x0b\x0c"


CLASSES = 4  # of lengths, an octave
LEAST = 50  # texts that a class's limits rest on, where there are so many
BINS = 200  # of the log ratio, for each factor of e
FLOOR = 0.015  # of the deviation, in log ratio
SPREAD, OF_MEDIAN, OF_SPREAD = 0.08, 10, 10  # a usual deviation, and by how many texts the prior counts for each


@dataclass(frozen=True)
class Bands:
    """How texts are judged. ``fitted``: for whole documents and for chunks, the limits by class of length; without, none."""

    chunk: int = 2048
    chunk_share: float = 0.5
    level: int = 3
    z: float = 4.0
    fitted: tuple[dict[int, tuple[float, float]], dict[int, tuple[float, float]]] = ({}, {})

    def outside(self, ratio: float, n: int, of_chunk: bool = False) -> bool:
        """Whether a text of n bytes with that ratio lies outside its limits."""
        low, high = (self.fitted[of_chunk].get(class_of(n)) if n else None) or (0.0, math.inf)
        return not low <= ratio <= high


def class_of(n: int) -> int:
    return int(CLASSES * math.log2(n))


def expected(k: int) -> int:
    """The bin of the log ratio that texts of a class's length usually have: short ones compress less."""
    n = 2 ** ((k + 0.5) / CLASSES)
    return round(BINS * math.log(0.40 + 5.5 * n**-0.53))


def limits_of(counts: dict[int, dict[int, int]], z: float) -> dict[int, tuple[float, float]]:
    """By class the limits of the ratio, from {class: {bin: texts}}."""
    out = {}
    for k in counts:
        wide, bins = 0, Counter(counts[k])
        while sum(bins.values()) < LEAST and wide < max(counts) - min(counts):
            wide += 1
            for near in (k - wide, k + wide):
                for b, n in counts.get(near, {}).items():
                    bins[b - expected(near) + expected(k)] += n
        texts, middle = sum(bins.values()), median(bins)
        spread = Counter()
        for b, n in bins.items():
            spread[abs(b - middle)] += n
        deviation = max(1.4826 * median(spread) / BINS, FLOOR)
        deviation = math.exp((texts * math.log(deviation) + OF_SPREAD * math.log(SPREAD)) / (texts + OF_SPREAD))
        middle = (texts * middle + OF_MEDIAN * expected(k)) / (texts + OF_MEDIAN)
        out[k] = (math.exp(middle / BINS - z * deviation), math.exp(middle / BINS + z * deviation))
    return out


def median(bins: Counter) -> int:
    half, seen = (sum(bins.values()) + 1) // 2, 0
    for b in sorted(bins):
        seen += bins[b]
        if seen >= half:
            return b
    return 0


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    bits = max(1, int(len(number) - 1).bit_length())
    if bits * width <= 63:
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = (key << bits) | ids[k : k + n]
    else:  # number the windows one word at a time, so that equal numbers stay equal windows
        key = ids[:n].copy()
        for k in range(1, width):
            key = np.unique(key * len(number) + ids[k : k + n], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def dup_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in data:
        return 0
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(text: str, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    """What the text shows by itself: the counts, the base rule, its bytes, its ratio and its chunks' ratios."""
    data = text.encode()
    words = data.split()
    joined = b"".join(words)
    n = len(words)
    word_chars = len(joined) if len(joined) == len(joined.decode()) else len(joined.decode())
    n_repeat = repeat_words(words)
    base_failed = n < 10 or 100 * n_repeat > 20 * n
    ratio = len(compressor.compress(data)) / len(data) if data else 0.0
    chunks = [data[k : k + bands.chunk] for k in range(0, len(data), bands.chunk)] if len(data) > bands.chunk else []
    return n, word_chars, len(data.translate(None, NOT_SYMBOLS)), dup_lines(data), n_repeat, base_failed, len(data), ratio, [len(compressor.compress(c)) / len(c) for c in chunks]


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
MEASURED = f"{COUNTS}, n_bytes long, zstd_ratio double, chunk_ratios array<double>"


def measured(docs: DataFrame, bands: Bands) -> DataFrame:
    docs = common.columns(docs, "doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURED}"
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for part in common.slices(batch):
                made = list(zip(*(measure(t, bands, compressor) for t in common.texts_of(part)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, f.type) for v, f in zip(made, list(arrow)[1:], strict=True))], schema=arrow)

    return common.map_arrow(docs, run, schema)


def fit(table: DataFrame, bands: Bands) -> Bands:
    """The bands with the limits of a written table of measures; the driver sees counts by class and bin alone."""
    clean = table.filter("not base_failed")
    rows = clean.select("n_bytes", "zstd_ratio", "chunk_ratios").dropDuplicates(["n_bytes", "zstd_ratio"])
    full = F.floor(F.col("n_bytes") / bands.chunk).cast("int")
    part = lambda kind, n, r: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), r.alias("r"))
    chunk = part(1, F.lit(bands.chunk), F.get("chunk_ratios", F.floor(full / 2).cast("int")))
    rest = part(1, F.col("n_bytes") - full * bands.chunk, F.get("chunk_ratios", full))
    texts = rows.select(F.inline(F.array(part(0, F.col("n_bytes"), F.col("zstd_ratio")), chunk, rest))).filter("n > 0 AND r IS NOT NULL")
    cls, b = F.floor(CLASSES * F.log2("n")).cast("int"), F.round(F.log("r") * BINS).cast("int")
    counts: tuple[dict, dict] = ({}, {})
    for r in texts.groupBy("kind", cls.alias("cls"), b.alias("bin")).agg(F.count(F.lit(1)).alias("texts")).collect():
        counts[r["kind"]].setdefault(r["cls"], {})[r["bin"]] = r["texts"]
    return replace(bands, fitted=(limits_of(counts[0], bands.z), limits_of(counts[1], bands.z)))


def judge(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """doc_id with the counts, the base rule, and whether the document is kept. Limits are fitted unless ``bands`` are given."""
    table = measured(docs, bands or Bands())
    if bands is None:
        table = common.Shared(docs.sparkSession).keep(table, "measured")
        bands = fit(table, Bands())
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COUNTS}, kept boolean, zstd_ratio double, bytes_outside long"
    names = ["doc_id", *(c.split()[0] for c in COUNTS.split(", "))]
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, outside = [], []
            for failed, n, ratio, chunks in zip(*(batch.column(c).to_pylist() for c in ("base_failed", "n_bytes", "zstd_ratio", "chunk_ratios")), strict=True):
                lost = 0
                for k, r in enumerate(chunks):
                    size = min(bands.chunk, n - k * bands.chunk)
                    lost += size if bands.outside(r, size, True) else 0
                outside.append(lost)
                kept.append(not failed and not bands.outside(ratio, n) and lost <= bands.chunk_share * n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.bool_()), batch.column("zstd_ratio"), pa.array(outside, pa.int64())], schema=arrow)

    return common.map_arrow(table, run, schema)


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.load(spark, sf_dir, "documents"))
