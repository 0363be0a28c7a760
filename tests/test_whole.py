"""Queries over whole texts against plain Python."""

import collections
import re

import pytest
import regex

from parsewright.functions import lengths
from parsewright.operators import corpus
from parsewright.plans import inputs, registry

TEXTS = [
    (1, 0, "The cat sat on the mat, and the dog lay by the door of the old house near a river."),
    (1, 1, "Le chat est assis sur le tapis; le chien dort devant la porte de la vieille maison."),
    (1, 2, "yes. No! Ça va? Ελλάδα 12 ÉTÉ"),
    (1, 3, "word " * 45 + "end"),
    (2, 0, "a b c d e f g h i j k l m n o p q r s t u"),
    (2, 1, "one two three four five six seven eight nine ten"),
    (2, 2, "12 34"),
    (3, 0, "Alone. Here"),
    (4, 0, None),
    (None, 0, "Lost words."),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(*t[:2], "user", t[2]) for t in TEXTS], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def cut(text):
    return regex.findall(r"\p{L}+", text or "")


def sentences():
    """A turn's sentences with its successor's words, dealt evenly; the last turn goes with the first."""
    talks = collections.defaultdict(list)
    for conv, turn, text in TEXTS:
        if conv and cut(text):
            talks[conv].append((turn, text))
    for conv, turns in talks.items():
        for (turn, text), (_, after) in zip(turns, turns[1:] + turns[:1], strict=True):
            e = [s for s in map(cut, re.split(r"[.!?\n]+", text.lower())) if s]
            f = cut(after)
            for k, s in enumerate(e):
                yield (conv * 10000 + turn) * 100000 + k, s, f[k * len(f) // len(e) : (k + 1) * len(f) // len(e)]


def ids(side):
    freq = collections.Counter(w for p in sentences() for w in p[side])
    return {w: k + 2 for k, w in enumerate(sorted(freq, key=lambda w: (-freq[w], w)))}


def spans(n):
    """Of the non-unary nodes: leaves, chunks of two, and the runs of chunks under symbol 2."""
    if n == 1:
        return [(0, 1)]
    out = [(k, 1) for k in range(n)] + [(k, 2) for k in range(0, n - 1, 2)]
    chunks, at = (n + 1) // 2, 0
    while True:
        if n - 2 * at > 2 or chunks == 2:
            out.append((2 * at, n - 2 * at))
        if chunks - at <= 4:
            return out
        at += 3


def test_every_word_counts(spark, sf):
    rows = inputs.words(spark, sf).collect()
    whole = collections.Counter(w for c, _, t in TEXTS if c for w in cut(t))
    assert collections.Counter(w for r in rows for w in r["f_words"]) == whole
    assert collections.Counter(w for r in rows for w in r["e_words"]) == collections.Counter(w.lower() for w in whole.elements())
    got = {r["word"]: r["freq"] for r in registry.QUERIES["vocab_freq"](spark, sf).collect()}
    assert got == collections.Counter(w for p in sentences() for w in p[1])
    got = {(r["w1"], r["w2"], r["w3"]): r["cnt"] for r in registry.QUERIES["trigram_counts"](spark, sf).collect()}
    want = collections.Counter()
    for _, e, _ in sentences():
        s = ["<s>", *e, "</s>"]
        want.update(zip(s, s[1:], s[2:], strict=False))
    assert got == want


def test_trees_hold_sentences_in_few_children(spark, sf):
    nodes = collections.defaultdict(list)
    for r in registry.QUERIES["tree_nodes"](spark, sf).collect():
        nodes[r["pair_id"]].append(r)
    number = ids(1)
    assert set(nodes) == {p[0] for p in sentences()}
    for pair, e, _ in sentences():
        leaves = sorted((r["epos"], int(r["head"])) for r in nodes[pair] if r["is_leaf"])
        assert leaves == list(enumerate(number[w] for w in e))
        assert max(r["numc"] for r in nodes[pair]) <= 4


def test_pair_ids_have_room(spark):
    make = lambda conv, turn: corpus.word_pairs(spark.createDataFrame([(conv, turn, "a b")], "conv_id long, turn long, text string"))
    assert make(7, 9999).first()["pair_id"] == 79999_00000
    for conv, turn in ((7, 10000), (2**40, 0), (1, -1)):
        with pytest.raises(Exception, match="room"):
            make(conv, turn).collect()


def test_limits_see_long_pairs(spark, sf):
    got = {r["pair_id"]: r["ok"] for r in registry.QUERIES["sentence_ok"](spark, sf).collect()}
    assert got == {p: len(e) <= 19 and 0 < len(f) <= 29 and len(f) <= lengths.DEFAULT_BAND.of(len(e))[1] for p, e, f in sentences()}
    assert set(got.values()) == {False, True}


def test_cooccurrence(spark, sf):
    got = {(r["e"], r["f"]): r["cnt"] for r in registry.QUERIES["cooccurrence"](spark, sf).collect()}
    e_id, f_id = ids(1), ids(2)
    want = collections.Counter()
    for _, e, f in sentences():
        if len(e) > 20 or len(f) > 29:
            continue
        for at, n in spans(len(e)):
            low, high = lengths.DEFAULT_BAND.of(n)
            for m in range(low, min(high, len(f)) + 1):
                for k in range(len(f) - m + 1):
                    want[" ".join(str(e_id[w]) for w in e[at : at + n]), " ".join(str(f_id[w]) for w in f[k : k + m])] += 1
    assert got == want
    assert max(len(e.split()) for e, _ in got) > 6
