"""Operators 11 and 13 against brute force, with ties, nulls, hot groups and very long members."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from parsewright.llm import common, conversation_trie, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, kids string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def brute_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof digest, folded root)."""

    def tree(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
            for p, k in zip(proofs, at, strict=True):
                run = runs[k // 3]
                p.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            at = [k // 3 for k in at]
            nodes = [h(*run) for run in runs]
        return nodes[0], proofs

    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))):
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([leaf(r, r[1]) for r in groups[g]]) for g in names}
    root, upper = tree([inner[g][0] for g in names])
    out = []
    for g, more in zip(names, upper, strict=True):
        for r, proof in zip(groups[g], inner[g][1], strict=True):
            whole = proof + more
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            acc = leaf(r, text)
            for before, after in whole:
                acc = h(before, acc, after)
            out.append((-1 if r[0] is None else r[0], leaf(r, r[1]), inner[g][0], root, h(*[a + b for a, b in whole]), acc))
    return sorted(out)


def manifest(spark, rows):
    out = merkle.document_manifest(spark.createDataFrame(rows, DOCS)).collect()
    proof = lambda p: h(*["".join(x.hex() for x in [*s.before, *s.after]) for s in p])
    for r in out:
        assert r.verified == (r.folded_root == r.root)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.leaf, r.subroot, r.root, proof(r.proof), r.folded_root) for r in out)


def doc(k, source, text):
    return (k, text, ["en", None][k % 2], source, len(text or ""), "x", "y")


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "b": 1}, {None: 5, "": 4, "é": 1, "z": 10}, {"hot": 90, "b": 2, "c": 27, None: 28}])
def test_manifest_against_brute_force(spark, sizes):
    rnd, k, rows = random.Random(1), 0, []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append(doc(k, source, rnd.choice([None, "", "a\nb", "one\n\n", "é\n" * 30, "plain"])))
            k += 1
    rnd.shuffle(rows)
    assert manifest(spark, rows) == brute_manifest(rows)


def test_manifest_of_ties_nulls_and_long_texts(spark):
    rows = [doc(1, "a", "x\ny")] * 4 + [doc(1, "a", "other"), (None, "t\n", "en", "a", None, "", ""), (None, None, None, None, None, None, None), doc(2, "b", "long\n" * 200_000)]
    assert manifest(spark, rows) == brute_manifest(rows)
    assert merkle.document_manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_places_go_on_over_ranges(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), F.col("id").alias("key"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {}
        for r in merkle.placed(rows, ["key"], ["g", "key"], common.Shared(spark), "t").collect():
            got.setdefault(r.g, []).append((r.idx, r.key))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for held in got.values():
        held.sort()
        assert [i for i, _ in held] == list(range(len(held))) and [k for _, k in held] == sorted(k for _, k in held)


TURNS = "conv_id long, turn long, role string, text string, path string, depth long"


def brute_trie(rows):
    own = {}
    for c, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        n = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:n] + turns[n:])
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, ())) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, ())) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, limit=conversation_trie.LIMIT):
    out = conversation_trie.prefix_trie(spark.createDataFrame(rows, TURNS), limit=limit)
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in out.collect()), key=repr)


def conversations(n, seed, words):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        c = c * 7 % 450
        for k in range(rnd.randint(1, 7)):
            rows.append((c, rnd.choice([k, k, None]), rnd.choice(["user", "assistant", None]), rnd.choice(words), "p", 1))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 20, 100_000])
@pytest.mark.parametrize("words", [["a", "b"], ["", None, "é𠀀", "x\n", "y" * 40], ["same"]])
def test_trie_against_brute_force(spark, limit, words):
    rows = conversations(150, len(words), words)
    assert trie(spark, rows, limit) == brute_trie(rows)


def test_trie_of_equal_long_and_absent_conversations(spark):
    long = [(100, k, "user", f"t{k % 5}", "", 0) for k in range(3000)] + [(c, k, "user", f"t{k % 5}", "", 0) for c in (205, 309) for k in range(2900)]
    copies = [(c, k, "user", "same", "", 0) for c in range(1000, 1300) for k in range(2)]
    lost = [(None, 1, "user", "x", "", 0)] * 3
    for rows in (long + copies + lost, long, copies, [(5, 0, None, None, None, None)]):
        assert trie(spark, rows, 500) == brute_trie(rows)
    assert trie(spark, lost) == [] and trie(spark, []) == []
    very = [(7, 0, "user", "long " * 300_000, "", 0), (8, 0, "user", "long " * 300_000, "", 0)]
    assert trie(spark, very) == brute_trie(very)
