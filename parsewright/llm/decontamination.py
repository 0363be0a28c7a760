"""Benchmark decontamination (operator 5): rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters, digits and underscores; Han characters and kana are words of their own. A seed is
an n-gram of a test item. A match is a document in which the item scores at least ``least`` of its full score, or one of
its passages of ``PASSAGE`` words at least ``PASSAGE_LEAST`` of that passage's, by local alignment: +2 for equal words, -1
for a changed word, -2 for one left out or put in.

A first pass over all documents counts in how many each seed occurs. A match keeps at least ``need`` of an item's seeds
(each edit breaks at most n of them, and costs at least what the scores say), so an item's ``need - 1`` most frequent
seeds can be left out of the search without losing any match: every match still has a rarer seed, and passages that half
the corpus shares start no work. An item so short that its edits could break all its seeds of ``n`` words has shorter
seeds, of two words or one, so that every match keeps one at least. The second pass joins each document's words to the
rare seeds, takes the stretch around the seeds of an item where at least ``need`` seeds lie, and aligns it.

The test set is stated and read in blocks of bounded bytes; each block's seeds travel to the tasks, every block sees
all documents. Documents are never shuffled.

Defined results: null and empty texts and items match nothing; a very long text or item is read whole; an item of fewer
words than a seed has one seed, the whole of it; of stretches that align equally well the first counts; items or documents
that repeat each give their own pairs; a null doc_id stays null; extra columns are ignored (``clean`` keeps them), whatever
their names; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|[^\W\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
MATCH, CHANGE, GAP = 2, -1, -2
PASSAGE, PASSAGE_LEAST = 13, 0.8


def kept_seeds(m: int, width: int, least: float) -> int:
    """How many of its seeds of ``width`` words an item of ``m`` words keeps in any match, at least; may be negative."""
    cost = int((1 - least) * m * MATCH + 1e-9)  # what a match may lose of the full score
    # Seeds broken for what is lost: by a changed word, by one put in, by one cut off an end.
    most = max(width / (MATCH - CHANGE), (width - 1) / -GAP, 1 / MATCH)
    return m - (width - 1) - int(most * cost + 1e-9)


def seed_width(m: int, n: int, least: float) -> int:
    """The widest seed, of ``n`` words at most, of which every match keeps one."""
    return next((w for w in range(min(n, m), 1, -1) if kept_seeds(m, w, least) >= 1), 1)


@dataclass
class Block:
    """A block of test items, ready for the tasks."""

    n: int
    least: float
    items: list[tuple[int, np.ndarray]] = field(default_factory=list)  # (item_id, word numbers)
    words: dict[str, int] = field(default_factory=dict)  # numbers from 1; 0: not in the block
    seeds: dict[tuple, int] = field(default_factory=dict)  # word numbers -> seed number
    places: list[list[tuple[int, int]]] = field(default_factory=list)  # of each seed: (item, position)
    need: list[int] = field(default_factory=list)  # of each item
    rare: list[set[int]] = field(default_factory=list)  # of each seed: the items for which it is a rare one

    @classmethod
    def of(cls, rows: list[tuple[int, str]], n: int, least: float) -> Block:
        b = cls(n, least)
        for item_id, text in rows:
            words = WORDS.findall((text or "").lower())
            if not words:
                continue
            ids = np.array([b.words.setdefault(w, len(b.words) + 1) for w in words], np.int64)
            k = len(b.items)
            b.items.append((item_id, ids))
            width = seed_width(len(ids), n, least)
            for at in range(len(ids) - width + 1):
                s = b.seeds.setdefault(tuple(ids[at : at + width].tolist()), len(b.seeds))
                if s == len(b.places):
                    b.places.append([])
                b.places[s].append((k, at))
            need = kept_seeds(len(ids), width, least)
            if len(ids) > PASSAGE:
                need = min(need, kept_seeds(PASSAGE, width, PASSAGE_LEAST))
            b.need.append(max(1, need))
        return b

    def set_rare(self, counts: dict[int, int]) -> None:
        of_item: dict[int, set[int]] = defaultdict(set)
        for s, places in enumerate(self.places):
            for k, _ in places:
                of_item[k].add(s)
        self.rare = [set() for _ in self.places]
        for k, seeds in of_item.items():
            ranked = sorted(seeds, key=lambda s: (counts.get(s, 0), s))
            # a repeated seed stands for several positions, all of which leave together
            drop, left = 0, self.need[k] - 1
            for s in reversed(ranked[1:]):
                times = sum(1 for i, _ in self.places[s] if i == k)
                if times > left:
                    break
                left -= times
                drop += 1
            for s in ranked[: len(ranked) - drop]:
                self.rare[s].add(k)

    def finder(self):
        """A function from texts to (word numbers of all texts, first word of each, hits (word position, seed))."""
        get = self.words.get
        factor = np.uint64(0x9E3779B97F4A7C15)
        tables = []  # by width: sorted keys of the seeds, their words and their numbers
        by_width: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
        for words, s in self.seeds.items():
            by_width[len(words)].append((words, s))

        def keys_of(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
            key = ids[at]
            for k in range(1, width):  # wraps around; equal keys are compared word by word
                key = (key ^ (key >> np.uint64(29))) * factor + ids[at + k]
            return key

        for width, pairs in by_width.items():
            words = np.array([w for w, _ in pairs], np.uint64).reshape(len(pairs), width)
            keys = keys_of(words.ravel(), np.arange(len(pairs)) * width, width)
            order = np.argsort(keys, kind="stable")
            most = int(np.unique(keys, return_counts=True)[1].max())  # seeds that share a key: one, but for chance
            tables.append((width, keys[order], words[order], np.array([s for _, s in pairs], np.int64)[order], most))

        def find(texts: list[str]):
            numbers: list[int] = []
            starts = [0]
            pad = [0] * self.n
            for t in texts:
                numbers.extend([get(w, 0) for w in WORDS.findall(t.lower())])
                numbers.extend(pad)  # no seed crosses texts
                starts.append(len(numbers))
            ids = np.array(numbers, np.uint64)
            at_all, seed_all = [], []
            for width, keys, words, seeds, most in tables:
                if len(ids) < width:
                    continue
                m = len(ids) - width + 1
                full = ids[:m] > 0
                for k in range(1, width):
                    full &= ids[k : k + m] > 0
                at = np.flatnonzero(full)
                key = keys_of(ids, at, width)
                first = np.searchsorted(keys, key)
                for j in range(most):
                    where = np.minimum(first + j, len(keys) - 1)
                    ok = np.flatnonzero((keys[where] == key) & (first + j < len(keys)))
                    same = (ids[at[ok][:, None] + np.arange(width)] == words[where[ok]]).all(1)
                    at_all.append(at[ok][same])
                    seed_all.append(seeds[where[ok]][same])
            ids = ids.astype(np.int64)
            if not at_all:
                return ids, starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
            at, seed = np.concatenate(at_all), np.concatenate(seed_all)
            order = np.argsort(at, kind="stable")
            return ids, starts, at[order], seed[order]

        return find


def best_passage(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local score of any PASSAGE consecutive words of item ``a`` in stretch ``b``, and that passage's first word."""
    windows = np.lib.stride_tricks.sliding_window_view(a, PASSAGE)
    col = np.arange(len(b) + 1) * GAP
    h = np.zeros((len(windows), len(b) + 1), np.int64)
    best = np.zeros(len(windows), np.int64)
    for k in range(PASSAGE):
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(h[:, :-1] + np.where(windows[:, k : k + 1] == b[None, :], MATCH, CHANGE), np.maximum(h[:, 1:] + GAP, 0))
        h = np.maximum(new, np.maximum.accumulate(new - col, axis=1) + col)  # gaps in the item: the best cell to the left, less GAP a step
        best = np.maximum(best, h.max(1))
    at = int(best.argmax())
    return int(best[at]), at


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score of item ``a`` in stretch ``b``, and the stretch's first word and end in that alignment."""
    n = len(b)
    col = np.arange(n + 1)
    h, start = np.zeros(n + 1, np.int64), col.copy()
    best = (0, 0, 0)
    for x in a:
        diag = h[:-1] + np.where(b == x, MATCH, CHANGE)
        up = h[1:] + GAP
        new = np.zeros(n + 1, np.int64)
        from_start = col.copy()
        take = np.maximum(diag, up)
        pos = take > 0
        new[1:][pos] = take[pos]
        src = np.where(diag >= up, start[:-1], start[1:])
        from_start[1:][pos] = src[pos]
        # Gaps in the item: the best cell to the left, less GAP a step, as a running maximum.
        slope = new - GAP * col
        run = np.maximum.accumulate(slope)
        left = run + GAP * col
        better = left > new
        if better.any():
            origin = np.maximum.accumulate(np.where(slope == run, col, 0))
            from_start = np.where(better, from_start[origin], from_start)
            new = np.maximum(new, left)
        h, start = new, from_start
        k = int(h.argmax())
        if h[k] > best[0]:
            best = (int(h[k]), int(start[k]), k)
    return best


def matches_in(block: Block, ids: np.ndarray, at: np.ndarray, seed: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(item index, share of the full score, first word, end) of every item that one text holds, whole or in a passage."""
    by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rare: set[int] = set()
    for p, s in zip(at.tolist(), seed.tolist(), strict=True):
        rare |= block.rare[s]
        for k, q in block.places[s]:
            by_item[k].append((p - q, p))
    out = []
    for k in sorted(rare):
        hits = by_item[k]
        item_id, words = block.items[k]
        m = len(words)
        if len(hits) < block.need[k]:
            continue
        best, passage = (0.0, 0, 0), False
        for low, high in stretches(sorted(hits), m, block.need[k]):
            a, b = max(0, low), min(len(ids), high)
            score, first, end = smith_waterman(words, ids[a:b])
            if score / (MATCH * m) > best[0]:
                best = (score / (MATCH * m), a + first, a + end)
            if score < block.least * MATCH * m and m > PASSAGE and score >= PASSAGE_LEAST * MATCH * PASSAGE and not passage:
                passage = best_passage(words, ids[a:b])[0] >= PASSAGE_LEAST * MATCH * PASSAGE
        if best[0] >= block.least or passage:
            out.append((k, *best))
    return out


def stretches(hits: list[tuple[int, int]], m: int, need: int) -> list[tuple[int, int]]:
    """Word ranges in which enough seeds lie for a match, from (implied start of the item, position)."""
    slack = m  # what gaps can shift an item by
    out: list[tuple[int, int]] = []
    group = [hits[0][0]]
    for start, _ in [*hits[1:], (1 << 60, 0)]:
        if start - group[-1] > slack:
            if len(group) >= need:
                out.append((group[0] - slack, group[-1] + m + slack))
            group = []
        group.append(start)
    return out


def blocks(bench: DataFrame, n: int, least: float, most_bytes: int) -> Iterator[Block]:
    """The stated test set, in blocks of at most ``most_bytes`` of text (one item at least)."""
    rows, size = [], 0
    for r in bench.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        length = len((r["text"] or "").encode())
        if rows and size + length > most_bytes:
            yield Block.of(rows, n, least)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += length
    if rows:
        yield Block.of(rows, n, least)


def contaminated(docs: DataFrame, bench: DataFrame, n: int = 3, least: float = 0.6, most_bytes: int = 2 << 20) -> DataFrame:
    """Pairs (doc_id, item_id, score, first_word, end_word) of documents that hold a test item."""
    spark = docs.sparkSession
    docs = common.columns(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {bench.schema['item_id'].dataType.simpleString()}, score double, first_word long, end_word long"
    out = None
    for block in blocks(bench, n, least, most_bytes):
        if not block.items:
            continue
        made = _block(spark, docs, block, schema)
        out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], schema) if out is None else out


def with_rare_seeds(docs: DataFrame, block: Block) -> Block:
    """Counts in how many documents each seed of the block occurs, and sets which are rare."""
    spark = docs.sparkSession
    plain = spark.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = plain.value
        find, seen = b.finder(), Counter()
        for batch in batches:
            for part in common.slices(batch):
                _, starts, at, seed = find(common.texts_of(part))
                if len(at):
                    row = np.searchsorted(starts, at, side="right")
                    once = np.unique(row * len(b.places) + seed)  # a document counts a seed once
                    for s, k in zip(*np.unique(once % len(b.places), return_counts=True), strict=True):
                        seen[int(s)] += int(k)
        if seen:
            yield pa.RecordBatch.from_pydict({"seed": pa.array(seen.keys(), pa.int64()), "n": pa.array(seen.values(), pa.int64())})

    counted = common.map_arrow(docs.select("text"), count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    block.set_rare({r["seed"]: r["n"] for r in counted.collect()})  # a row for each seed of the block
    return block


def matcher(block: Block):
    """A function from texts to matches (row, item index, score, first word, end word)."""
    find = block.finder()
    any_rare = np.array([bool(x) for x in block.rare])

    def match(texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        ids, starts, at, seed = find(texts)
        found: list[tuple[int, int, float, int, int]] = []
        if not len(at):
            return found
        row = np.searchsorted(starts, at, side="right") - 1
        for r in np.unique(row[any_rare[seed]]):
            a, z = np.searchsorted(row, r), np.searchsorted(row, r, side="right")
            first, end = starts[r], starts[r + 1] - block.n
            found += [(int(r), *m) for m in matches_in(block, ids[first:end], at[a:z] - first, seed[a:z])]
        return found

    return match


def _block(spark: SparkSession, docs: DataFrame, block: Block, schema: str) -> DataFrame:
    table = spark.sparkContext.broadcast(with_rare_seeds(docs, block))
    arrow = common.to_arrow(schema)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = table.value
        match = matcher(b)
        for batch in batches:
            for part in common.slices(batch):
                found = match(common.texts_of(part))
                if found:
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([b.items[f[1]][0] for f in found], arrow.field("item_id").type),
                        pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())], schema=arrow)

    return common.map_arrow(docs, align, schema)


def clean(docs: DataFrame, bench: DataFrame, n: int = 3, least: float = 0.6, most_bytes: int = 2 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for block in blocks(bench, n, least, most_bytes):
        if not block.items:
            continue
        table = spark.sparkContext.broadcast(with_rare_seeds(texts, block))

        def keep(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            match = matcher(table.value)
            for batch in batches:
                for part in common.slices(batch):
                    held = {f[0] for f in match(common.texts_of(part))}
                    yield part.filter(pa.array([k not in held for k in range(part.num_rows)], pa.bool_())) if held else part

        docs = common.map_arrow(docs, keep, docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a test item that it holds, exact or edited."""
    return contaminated(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))
