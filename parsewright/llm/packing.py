"""Best-fit packing (operator 2): bin completion branch-and-bound over the histogram of piece lengths.

A piece's length is an integer from 1 to the capacity, so the whole packing problem is a table of at most
``capacity`` counts, whatever the size of the corpus. On that table the solver fills sequences around the largest
piece left. It enumerates the undominated fillings of the room beside that piece (a filling is dominated if one of
its pieces, or two together, could be exchanged for a larger one that is there and still fits), best fit first, uses
a filling as often as the counts allow, and prunes every branch whose waste so far already exceeds what the best
solution found (the incumbent) could waste. The first incumbent is best-fit decreasing, run on the counts, so no result
needs more sequences than that. It stops at once when an incumbent meets the
lower bound. While none does, ``exhaust`` goes on through the whole tree, every undominated filling any number of times;
it ends with the least number of sequences proved, unless its ``steps`` run out first (packing is NP-hard, so a large
instance can outlast any time; ``steps=None`` sets no end). README has the gaps left at several sizes. The result is a short list of patterns with multiplicities; every piece then finds its place from its
rank among the pieces of its length, by arithmetic alone.

Ranks are counted within (length, bucket) with the buckets' sums as offsets, so that a length that a third of all
pieces have is dealt over all tasks.

Defined results: a null text counts as empty and packs as its end mark alone; repeated rows each get their own
places; a null doc_id stays null; a very long text is tokenized in blocks and cut into many pieces; pieces of equal length
are told apart by all they carry, and equal ones take either's place; extra columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common, pretokens

CACHE = 400_000  # pre-tokens whose ids a task keeps at hand
STEPS = 100_000  # of the search through the whole tree: some seconds on the driver, only if the bound isn't met before
MOST_BUCKETS = 1024  # so that the driver sees a million counts at most, whatever the cluster


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def fillings(counts: np.ndarray, room: int, most: int = 64, steps: int = 4000) -> list[tuple[int, dict[int, int]]]:
    """Undominated fillings of ``room`` from the lengths with counts, least waste first: (waste, {length: times}).

    Lengths are tried from the largest down, so the first found are the best-fit ones. ``most`` and ``steps`` bound
    the enumeration at one node of the search, not the pieces that it packs.
    """
    sizes = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s] > 0]
    if not sizes:
        return [(room, {})]
    found: list[tuple[int, dict[int, int]]] = []
    left = steps
    ascending = sizes[::-1]

    def free(low: int, high: int, used: dict[int, int]) -> bool:
        k = bisect.bisect_right(ascending, high) - 1
        while k >= 0 and ascending[k] >= low:
            if counts[ascending[k]] - used.get(ascending[k], 0) > 0:
                return True
            k -= 1
        return False

    def dominated(waste: int, used: dict[int, int]) -> bool:
        if any(free(s + 1, s + waste, used) for s in used):  # a larger piece that is still there fits in the place of one
            return True
        twos = ((a, b) for a in used for b in used if a < b or (a == b and used[a] > 1))
        return any(free(a + b, a + b + waste, used) for a, b in twos)  # or of two

    def go(k: int, rest: int, used: dict[int, int]) -> bool:
        nonlocal left
        left -= 1
        k = bisect.bisect_left(sizes, -rest, lo=k, key=lambda s: -s)
        if rest == 0 or k == len(sizes):
            fits = any(s <= rest and counts[s] - used.get(s, 0) > 0 for s in (ascending[:1]))
            if not fits and not dominated(rest, used):
                found.append((rest, dict(used)))
            return rest == 0 or left <= 0 or len(found) >= most
        while k < len(sizes):
            s = sizes[k]
            times = int(min(rest // s, counts[s]))
            for t in range(times, 0, -1):
                used[s] = t
                if go(k + 1, rest - t * s, used):
                    return True
                del used[s]
                if left <= 0:
                    return True
            k += 1
        return False

    go(0, room, {})
    return sorted(found, key=lambda f: f[0]) or [(room, {})]


def undominated(counts: np.ndarray, room: int, spend: Callable[[], bool]) -> Iterator[tuple[int, dict[int, int]]]:
    """All undominated fillings of ``room``, one by one: (waste, {length: times}). Ends early when ``spend`` says no."""
    there = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s] > 0]

    def free(low: int, high: int, used: dict[int, int]) -> bool:
        """Whether a piece of a length from ``low`` to ``high`` is there beside those used."""
        for s in there[bisect.bisect_left(there, -high, key=lambda s: -s) :]:
            if s < low:
                return False
            if counts[s] > used.get(s, 0):
                return True
        return False

    def dominated(waste: int, used: dict[int, int]) -> bool:
        if free(1, waste, used) or any(free(s + 1, s + waste, used) for s in used):
            return True
        twos = ((a, b) for a in used for b in used if a < b or (a == b and used[a] > 1))
        return any(free(a + b, a + b + waste, used) for a, b in twos)  # one piece for two

    def go(k: int, rest: int, used: dict[int, int]) -> Iterator[tuple[int, dict[int, int]]]:
        k = bisect.bisect_left(there, -rest, lo=k, key=lambda s: -s)
        if k == len(there):
            if not dominated(rest, used):
                yield rest, dict(used)
            return
        for j in range(k, len(there)):
            s = there[j]
            for t in range(int(min(rest // s, counts[s])), 0, -1):
                if not spend():
                    return
                used[s] = t
                yield from go(j + 1, rest - t * s, used)
                del used[s]

    yield from go(0, room, {})


def exhaust(counts: np.ndarray, capacity: int, best: list[tuple[int, dict[int, int]]], steps: int | None) -> list[tuple[int, dict[int, int]]]:
    """The best patterns, from ``best`` on, of the whole tree: depth first, until the bound is met or nothing is left.

    A node is the largest piece left; its branches are all its undominated fillings, each used as often as it can be,
    then once less, down to once.
    """
    counts = counts.copy()
    bound, best_bins = lower_bound(counts, capacity), sum(t for t, _ in best)
    left = math.inf if steps is None else steps
    seen: dict[bytes, int] = {}  # the fewest sequences with which a rest has been reached

    def spend() -> bool:
        nonlocal left
        left -= 1
        return left >= 0

    def branches(bins: int) -> Iterator[tuple[int, dict[int, int]]]:
        nonlocal best, best_bins
        some = np.flatnonzero(counts)
        if not len(some):
            if bins < best_bins:
                best, best_bins = [path for _, path in stack if path], bins
            return
        key = np.stack([some, counts[some]]).tobytes()
        if seen.get(key, 1 << 62) <= bins or bins + lower_bound(counts, capacity) >= best_bins:
            return
        seen[key] = bins
        top = int(some[-1])
        rest = counts.copy()
        rest[top] -= 1
        for _, fill in undominated(rest, capacity - top, spend):
            pattern = dict(fill)
            pattern[top] = pattern.get(top, 0) + 1
            for times in range(min(int(counts[s]) // t for s, t in pattern.items()), 0, -1):
                if best_bins <= bound or not spend():
                    return
                yield times, pattern

    # A list instead of recursion, as the tree can be as deep as there are sequences: (branches left, the one taken).
    stack: list[tuple[Iterator, tuple | None]] = []
    stack.append((branches(0), None))
    used = [0]
    while stack:
        options, taken = stack[-1]
        if taken:
            for s, t in taken[1].items():
                counts[s] += taken[0] * t
        stack[-1] = (options, None)
        step = next(options, None)
        if step is None:
            stack.pop()
            used.pop()
            continue
        for s, t in step[1].items():
            counts[s] -= step[0] * t
        stack[-1] = (options, step)
        used.append(used[-1] + step[0])
        stack.append((branches(used[-1]), None))
    return best


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's bound over every threshold."""
    sizes = np.arange(capacity + 1)
    volume = int(-(-int((sizes * counts).sum()) // capacity))
    upto, mass = np.cumsum(counts), np.cumsum(sizes * counts)
    best = volume
    half = capacity // 2
    for k in range(half + 1):
        big = int(upto[capacity] - upto[capacity - k])  # longer than capacity - k
        mid = int(upto[capacity - k] - upto[half])
        room = mid * capacity - int(mass[capacity - k] - mass[half])
        small = int(mass[half] - (mass[k - 1] if k else 0))
        best = max(best, big + mid + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: pieces}) as best-fit decreasing packs the pieces one by one, with equal sequences taken together."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, times: int, pattern: dict[int, int]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((times, pattern))

    for s in range(capacity, 0, -1):
        left = int(counts[s])
        while left:
            k = bisect.bisect_left(rooms, s)
            if k == len(rooms):  # new sequences
                each = min(capacity // s, left)
                times = left // each
                put(capacity - each * s, times, {s: each})
            else:
                room = rooms[k]
                there, pattern = open_[room].pop()
                each = min(room // s, left)  # a sequence that took one is the tightest for the next
                times = min(there, left // each)
                if there > times:
                    open_[room].append((there - times, pattern))
                elif not open_[room]:
                    del open_[room], rooms[k]
                put(room - each * s, times, {**pattern, s: pattern.get(s, 0) + each})
            left -= times * each
    return [x for room in rooms for x in open_[room]]


def solve(counts: np.ndarray, capacity: int, nodes: int = 12, steps: int | None = STEPS) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: pieces}) that pack all counts, in the fewest sequences unless ``steps`` run out.

    Starts from best-fit decreasing. The first ``nodes`` alternatives to the best filling are tried with a few fillings
    each; then the whole tree is searched.
    """
    counts = counts.astype(np.int64).copy()
    bound, total = lower_bound(counts, capacity), int((np.arange(capacity + 1) * counts).sum())
    best = best_fit_decreasing(counts, capacity)
    best_bins = sum(t for t, _ in best)
    if best_bins <= bound:
        return best
    budget = nodes

    def descend(counts: np.ndarray, done: list, bins: int, waste: int, limit: int) -> None:
        """Depth first; ``limit`` is how often this branch may still leave the best fit (limited discrepancy)."""
        nonlocal best, best_bins, budget
        counts, done, top = counts.copy(), list(done), capacity
        while True:
            while top > 0 and counts[top] == 0:
                top -= 1
            if top == 0:
                if bins < best_bins:
                    best, best_bins = done, bins
                return
            if -(-(total + waste) // capacity) >= best_bins:  # this much waste can't do better than the incumbent
                return
            counts[top] -= 1
            options = fillings(counts, capacity - top)
            counts[top] += 1
            if limit > 0:
                for w, other in options[1:3]:
                    if budget <= 0 or best_bins <= bound:
                        break
                    budget -= 1
                    c, d, k = apply(counts, top, other)
                    descend(c, [*done, d], bins + k, waste + w * k, limit - 1)
            w, fill = options[0]
            counts, pattern, k = apply(counts, top, fill)
            done.append(pattern)
            bins, waste = bins + k, waste + w * k

    def apply(counts: np.ndarray, top: int, fill: dict[int, int]) -> tuple[np.ndarray, tuple, int]:
        pattern = dict(fill)
        pattern[top] = pattern.get(top, 0) + 1
        k = min(int(counts[s]) // t for s, t in pattern.items())
        counts = counts.copy()
        for s, t in pattern.items():
            counts[s] -= t * k
        return counts, (k, pattern), k

    for limit in (0, 1, 2):  # the best filling around the largest piece each time; then other ones too
        if best_bins > bound and budget > 0:
            descend(counts, [], 0, 0, limit)
    return exhaust(counts, capacity, best, steps) if best_bins > bound else best


def runs(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length the runs (first rank, first sequence, pieces a sequence, offset there) in order of ranks."""
    first = 0
    ranks: dict[int, int] = {}
    out: dict[int, list] = {}
    for times, pattern in patterns:
        at = 0
        for s in sorted(pattern, reverse=True):
            out.setdefault(s, []).append((ranks.get(s, 0), first, pattern[s], at))
            ranks[s] = ranks.get(s, 0) + times * pattern[s]
            at += s * pattern[s]
        first += times
    return {s: np.array(x, np.int64) for s, x in out.items()}


def place(lengths: np.ndarray, ranks: np.ndarray, table: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for s in np.unique(lengths):
        at = np.flatnonzero(lengths == s)
        run = table[int(s)]
        k = np.searchsorted(run[:, 0], ranks[at], side="right") - 1
        within = ranks[at] - run[k, 0]
        sequence[at] = run[k, 1] + within // run[k, 2]
        offset[at] = run[k, 3] + within % run[k, 2] * s
    return sequence, offset


def little(ids: list[int], kind: str = "I") -> bytes:
    """Ids as little-endian unsigned numbers of 32 bits, or of 16 (kind H)."""
    a = array(kind, ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Ids(dict):
    """Ids of a pre-token as bytes, by the library's BPE model itself: its merges need no second look at the text."""

    def __init__(self, path: str, kind: str = "I"):
        super().__init__()
        tokenizer = pretokens.load_tokenizer(path)
        self.model, self.of_byte, self.kind = tokenizer.model, byte_letters(), kind
        self.specials = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}

    def __missing__(self, word: str) -> bytes:
        if word in self.specials:
            found = [self.specials[word]]
        else:
            found = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.of_byte))]
        ids = little(found, self.kind)
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Ids are made per distinct pre-token of a task and joined as bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = common.to_arrow(f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, cache = pretokens.cutter(path), Ids(path)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for part in common.slices(batch):
                ids, piece, start, length, crc = [], [], [], [], []
                for row, text in enumerate(common.texts_of(part)):
                    data = b"".join(b"".join(map(cache.__getitem__, cut(t))) for t in pretokens.text_blocks(text)) + end
                    n = len(data)
                    at, k = 0, 0
                    stop = n % step or min(step, n)
                    while at < n:
                        ids.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append((stop - at) // 4)
                        crc.append(zlib.crc32(data[at:stop]))
                        at, stop, k = stop, stop + step, k + 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], schema=arrow)

    return common.map_arrow(docs, run, T._parse_datatype_string(f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"))


def pack(pieces: DataFrame, capacity: int, nodes: int = 12) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with a ``length`` from 1 to ``capacity``."""
    spark = pieces.sparkSession
    buckets = min(MOST_BUCKETS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Within a bucket rows are told apart by all they carry, so a lost task counts the same ranks again.
    order = [F.col(c) for c in pieces.columns]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(c) for c in pieces.columns]), F.lit(buckets)).cast("int"))
    counted = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    found = counted.collect()  # a row for each length: capacity rows at most, each of MOST_BUCKETS pairs at most
    counts = np.zeros(capacity + 1, np.int64)
    starts = {}
    for r in found:
        n = np.zeros(buckets, np.int64)
        for b, k in r["b"]:
            n[b] = k
        counts[r["length"]] = n.sum()
        starts[r["length"]] = np.cumsum(n) - n
    table = spark.sparkContext.broadcast((starts, runs(solve(counts, capacity, nodes))))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy(*order)) - 1)
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, places = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, bucket = batch.column("length").to_numpy(), batch.column("bucket").to_numpy()
            rank = batch.column("rank").to_numpy().astype(np.int64)
            for s in np.unique(length):
                at = length == s
                rank[at] += starts[int(s)][bucket[at]]
            sequence, offset = place(length, rank, places)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return common.map_arrow(ranked.select(*names, "bucket", "rank"), run, out)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, nodes: int = 12) -> DataFrame:
    """Tokenizes, cuts what is longer than a sequence, and packs all pieces."""
    shared = common.Shared(docs.sparkSession)
    docs = common.columns(docs, "doc_id", "text")
    return pack(shared.keep(token_pieces(docs, path, capacity, end_id), "pieces"), capacity, nodes)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return pack_documents(common.load(spark, sf_dir, "documents"), pretokens.default_path("byte_bpe_50k.json"))
