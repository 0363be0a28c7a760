"""Token counts and packing against the tokenizer itself and against exhaustive packing."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from parsewright.llm import packing, pretokens, token_counts  # noqa: E402

TEXTS = ["", None, "Hello  world, it's 12½ o'clock", "<|endoftext|> x <|startoftext|>y", "ΣΑΣ İstanbul ﬁ ȩ́", "a" * 5000, "\n\t \x1c\x85 x", "中文 字 한글", "the the the " * 50, "՘ new ꟎ letters"]
DOCS = [(k, t, "extra") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id", "x"), (50, "same", "x"), (50, "other text", "x")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, n_bytes string")


@pytest.fixture(params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def path(request):
    return public.path(request.param)


def encode(path, text):
    return tokenizers.Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("frequent", [0, 5, 400_000])
def test_counts(docs, path, frequent):
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, path, frequent).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(encode(path, t))) for i, t, _ in DOCS), key=str)
    assert got == want


def test_counts_of_no_rows(docs, path):
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24FF, exclude_categories=["Cs"]) | st.sampled_from("  '<|>\nsStT"), max_size=40))
def test_pretokens_are_the_librarys(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        p = public.path(name)
        t = pretokens.load_tokenizer(p)
        assert [i for w in pretokens.cutter(p)(text) for i in t.encode(w, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sS 1.\n\t<|>́ é"), max_size=60), st.integers(1, 9))
def test_blocks_have_the_texts_pretokens(text, size):
    assert "".join(pretokens.text_blocks(text, size)) == text
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        cut = pretokens.cutter(public.path(name))
        assert [w for t in pretokens.text_blocks(text, size) for w in cut(t)] == cut(text)


def test_packing(docs):
    p = public.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, p, capacity=64).collect()
    ids = {(i, t): np.array([*encode(p, t), 2], "<u4") for i, t, _ in DOCS}
    total = 0
    for i, t, _ in DOCS:
        data = ids[i, t]
        total += len(data)
        first = len(data) % 64 or 64
        cuts = [0, *range(first, len(data) + 1, 64)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            assert any((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) == (i, k, a, b - a, zlib.crc32(data[a:b].tobytes())) for r in rows)
    assert sum(r["length"] for r in rows) == total
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 64
    assert packing.pack_documents(docs.limit(0), p).count() == 0


def fewest(sizes, capacity):
    """Exhaustive: the least number of sequences."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for j in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[j] >= sizes[k]:
                rooms[j] -= sizes[k]
                go(k + 1, rooms)
                rooms[j] += sizes[k]
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_solver_is_near_the_fewest(sizes):
    counts = np.bincount(sizes, minlength=21)
    patterns = packing.solve(counts, 20)
    used = np.zeros(21, int)
    for times, pattern in patterns:
        assert sum(s * n for s, n in pattern.items()) <= 20
        for s, n in pattern.items():
            used[s] += times * n
    assert (used == counts).all()
    bins, least = sum(t for t, _ in patterns), fewest(sizes, 20)
    assert packing.lower_bound(counts, 20) <= least <= bins <= least + 1


def test_places_are_exact():
    counts = np.zeros(11, int)
    counts[[2, 3, 5, 7]] = [40, 33, 21, 17]
    table = packing.runs(packing.solve(counts, 10))
    lengths = np.repeat(np.arange(11), counts)
    ranks = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = packing.place(lengths, ranks, table)
    taken = {(s, o + k) for s, o, n in zip(sequence, offset, lengths, strict=True) for k in range(n)}
    assert len(taken) == lengths.sum()
    assert max(o for _, o in taken) < 10


TRIPLETS = [[25, 25, 26, 27, 27, 28, 31, 33, 42, 44, 45, 47], [25, 26, 26, 26, 27, 27, 28, 29, 29, 30, 33, 34, 39, 41, 42, 45, 46, 47], [25, 25, 26, 27, 27, 27, 27, 27, 28, 28, 28, 29, 29, 29, 31, 33, 39, 43, 43, 44, 44, 46, 47, 48]]


@pytest.mark.parametrize("sizes", TRIPLETS)
def test_solver_searches_on(sizes):
    counts = np.bincount(sizes, minlength=101)
    patterns = packing.solve(counts, 100)
    assert sum(t for t, _ in patterns) == len(sizes) // 3 == packing.lower_bound(counts, 100)
    used = sum(np.bincount(list(p), list(p.values()), 101) * t for t, p in patterns)
    assert (used == counts).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_whole_tree_has_the_fewest(sizes):
    counts = np.bincount(sizes, minlength=21)
    one_each = [(1, {s: 1}) for s in sizes]
    found = packing.exhaust(counts, 20, one_each, None)
    assert sum(t for t, _ in found) == fewest(sizes, 20)
    assert sum(t * s * n for t, p in found for s, n in p.items()) == sum(sizes)


def test_two_pieces_are_exchanged_for_one():
    counts = np.zeros(21, int)
    counts[[3, 4, 7, 9]] = 1
    found = [f for _, f in packing.undominated(counts, 10, lambda: True)]
    assert {4: 1, 3: 1} not in found  # 7 could stand for both
    assert {7: 1, 3: 1} in found


def one_by_one(pieces, capacity):
    """Best-fit decreasing, a piece at a time."""
    rooms = []
    for s in sorted(pieces, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return rooms


@pytest.mark.parametrize(("capacity", "pieces", "low", "high"), [(10, 30, 1, 10), (100, 60, 10, 70), (100, 400, 1, 60), (1024, 300, 1, 1024), (1024, 200, 100, 700), (50, 500, 20, 30)])
def test_never_above_best_fit_decreasing(capacity, pieces, low, high):
    rng = random.Random(capacity + pieces)
    for _ in range(5):
        made = [rng.randint(low, high) for _ in range(pieces)]
        counts = np.bincount(made, minlength=capacity + 1)
        bfd = packing.best_fit_decreasing(counts, capacity)
        rooms = one_by_one(made, capacity)
        assert sorted(capacity - sum(s * n for s, n in p.items()) for t, p in bfd for _ in range(t)) == sorted(rooms)
        for patterns in (bfd, packing.solve(counts, capacity, steps=2000)):
            assert sum(t for t, _ in patterns) <= len(rooms)
            assert sum(t for t, _ in patterns) >= packing.lower_bound(counts, capacity)
            back = np.zeros(capacity + 1, int)
            for t, p in patterns:
                assert sum(s * n for s, n in p.items()) <= capacity
                for s, n in p.items():
                    back[s] += t * n
            assert (back == counts).all()
