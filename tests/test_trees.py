"""Node rows and tree edits."""

import random

import pytest
from pyspark.sql import functions as F

from parsewright.operators import trees
from parsewright.operators import transforms as X

PUNCT = (("PUNC.", "PUNC"), ("PUNC,", "PUNC"), ("PUNC:", "PUNC"))
PARSED = "(TOP~slept~1~1 (S~slept~2~2 (NPB~dog~2~2 the/DT dog/NN ) (VP~slept~2~1 slept/VBD (PP~on~2~1 on/IN (NPB~mat~2~2 a/DT mat/NN ./PUNC. ) ) ) ) ) "


@pytest.fixture
def edited(spark):
    def run(text, *steps, **options):
        df = spark.createDataFrame([(1, text)], "k int, t string")
        out = X.edited(df, "k", "t", X.Edits(steps, **options)).first().t
        if len(steps) < 3:
            assert df.select(X.edit(F.col("t"), X.Edits(steps, **options))).first()[0] == out
        return out

    return run


@pytest.fixture
def value(spark):
    return lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_nodes(spark):
    df = spark.createDataFrame([(1, "(2 (3 10/4 11/5) 12/6)"), (2, "7/4"), (3, None), (4, "")], "pair_id int, e_tree string")
    rows = {(r["pair_id"], r["node_id"]): r for r in trees.nodes(df).collect()}
    assert len(rows) == 6
    assert [(rows[1, k]["parent_id"], rows[1, k]["child_idx"], rows[1, k]["symbol"], rows[1, k]["head"], rows[1, k]["numc"], rows[1, k]["epos"], rows[1, k]["elen"]) for k in range(5)] == [
        (-1, 0, 2, None, 2, 0, 3), (0, 0, 3, None, 2, 0, 2), (1, 0, 4, 10, 0, 0, 1), (1, 1, 5, 11, 0, 1, 1), (0, 1, 6, 12, 0, 2, 1)]
    assert rows[2, 0]["is_leaf"] and rows[2, 0]["head"] == 7


def test_max_children_of_a_leaf(spark):
    row = spark.createDataFrame([("7/4",)], "t string").select(*[trees.max_children(trees.node_array(F.col("t")), k).alias(f"m{k}") for k in (0, 1)]).first()
    assert (row["m0"], row["m1"]) == (0, 1)


def test_sample_tree(edited, value):
    want = "(slept/TOP (slept/S (dog/NPB the/DT dog/NN) (slept/VP slept/VBD (on/PP on/IN (mat/NPB a/DT mat/NN)))))"
    assert edited(PARSED, "conv", "upqpunc", "rmpunc", table=PUNCT) == want
    assert value(PARSED, lambda t: X.max_children(t, X.Edits(("conv", "upqpunc", "rmpunc"), PUNCT))) == 2


def test_flatten_and_up(edited):
    t = "(S~a~1~1 (VP~a~1~1 a/VB b/NN) c/NN)"
    assert edited(t, "flat") == "(a/S a/VB b/NN c/NN)"
    assert edited(t, "flat", up=True) == "(a/VB a/VB b/NN c/NN)"
    assert edited(t, "noflat", up=True) == "(a/VB (a/VB a/VB b/NN) c/NN)"
    assert edited("(S~a~1~1 (NPB~a~1~1 a/NN))", "flat") == "a/NN"


def test_passive_and_auxiliary(edited):
    assert edited("(VP~was~1~1 was/VBD (VP-A~seen~1~1 seen/VBN x/NN))", "pas") == "(seen/VP-A was/VBD seen/VBN x/NN)"
    assert edited("(VP~will~1~1 will/MD (VP-A~go~1~1 go/VB))", "aux") == "(go/VP-A will/MD go/VB)"
    assert edited("(NP~was~1~1 was/VBD (VP-A~seen~1~1 seen/VBN))", "pas") == "(was/NP was/VBD (seen/VP-A seen/VBN))"


def test_marks(edited):
    assert edited("(TOP~a~1~1 (S~a~1~1 a/VB ?/PUNC.))", "conv", "upqpunc", table=PUNCT) == "(a/TOP (a/S a/VB) ?/PUNCX)"
    assert edited("(TOP~a~1~1 (S~?~1~1 ?/PUNC.))", "conv", "upqpunc", table=PUNCT) == "(a/TOP ?/S ?/PUNCX)"
    assert edited("(TOP~a~1~1 a/VB ./PUNC. ./PUNC.)", "conv", "rmpunc", table=PUNCT) == "(a/TOP a/VB ./PUNC)"


def test_ids_and_leaves(spark, edited):
    t = "(S~Ab~1~1 Ab/VB x/NN)"
    df = spark.createDataFrame([(1, t), (2, None), (3, "x/NN")], "k int, t string")
    ids = lambda rows: spark.createDataFrame(rows, "word string, id int")
    run = lambda edits, words, symbols=None: {r.k: r.t for r in X.edited(df, "k", "t", edits, words, symbols).collect()}
    assert run(X.Edits(("lower", "vocab", "convsym")), ids([("ab", 5), ("UNK", 1)]), ids([("S", 2), ("VB", 3)])) == {1: "(5/2 5/3 1/0)", 2: None, 3: "1/0"}
    assert run(X.Edits(("vocab",), max_id=4), ids([("Ab", 5)]))[1] == "(0/S 0/VB 0/NN)"
    assert edited(t, "rmhead", "lf") == "(S (VB Ab) (NN x))"
    assert [r[0] for r in df.select(X.both(F.col("t"), X.Edits(("rmhead", "lf")))).collect()] == [["(S~Ab~1~1 (VB Ab) (NN x))", "(S (VB Ab) (NN x))"], None, ["(NN x)"] * 2]


def test_conversion_runs_twice(edited):
    assert edited("a/A", "conv", table=(("A", "B"), ("B", "C"))) == "a/C"


def test_escapes_round_trip(value):
    t = r"(S~a~1~1 \(/\( b\\/NN)"
    assert [c.head for c in value(t, X.read)] == ["a", "(", "b\\"]
    assert value(t, lambda c: X.write(X.read(c))) == t
    assert value("[S~a~1~1 a/VB (/X ]", lambda c: X.write(X.read(c))) == r"(S~a~1~1 a/VB \(/X)"


def test_listing(value):
    t = "(S~a~1~1 a/VB (NP~b~1~1 b/NN))"
    lines = lambda **o: value(t, lambda c: X.rule_lines(c, X.Edits(()), **o))
    assert lines() == ["S <= VB NP ", "NP <= NN "]
    assert lines(right=True) == ["VB NP => S", "NN => NP"]
    assert lines(heads=True)[0] == "S <= VB NP ".ljust(30) + "a/S <= a/VB b/NP "


def test_picks_by_children(spark):
    df = spark.createDataFrame([(1, "(S~a~1~1 a/VB b/NN)"), (2, "a/VB"), (3, "(S~a~1~1 a/VB b/NN c/NN)"), (4, None)], "k int, t string")
    picked = lambda **o: [r.k for r in X.pick(df, "t", X.Edits(()), **o).collect()]
    assert picked(exactly=2) == [1] and picked(at_most=2) == [1, 2] and picked(exactly=0) == [2]


class Plain:
    """Trees as nested lists [head, symbol, children], for a plain version of the splices by their definitions."""

    @staticmethod
    def show(t):
        h, s, c = t
        return f"{h}/{s}" if not c else f"({h}/{s} {' '.join(map(Plain.show, c))})"

    @staticmethod
    def source(t):
        h, s, c = t
        return f"{h}/{s}" if not c else f"({s}~{h}~1~1 {' '.join(map(Plain.source, c))})"

    @staticmethod
    def flat(t, up, splice):
        h, s, c = t
        new = [Plain.flat(x, up, splice) for x in c]
        same = [x for x in new if x[0] == h]
        if splice and len(new) == 1 and same and not same[0][2]:
            return [h, same[0][1], []]
        out = [y for x in new for y in (x[2] if splice and x[0] == h and x[2] else [x])]
        return [h, same[-1][1] if up and same else s, out]

    @staticmethod
    def verbs(t, words, symbols):
        h, s, c = t
        new = [Plain.verbs(x, words, symbols) for x in c]
        if not c or h not in words or s not in symbols:
            return [h, s, new]
        took = [x for x in new if x[1] in X.VERB_PHRASES]
        head, symbol = took[-1][:2] if took else (h, s)
        return [head, symbol, [y for x in new for y in (x[2] if x in took and x[2] else [x])]]

    @staticmethod
    def strip(t):
        h, s, c = t
        c = c[:-1] if len(c) > 1 and c[-1][1] == "PUNC" else c
        return [h, s, [Plain.strip(x) for x in c]]


def test_edits_of_random_trees(spark):
    rnd = random.Random(2)

    def tree(depth):
        head, symbol = rnd.choice(["was", "is", "will", "have", "go", "x"]), rnd.choice(["VP", "VP-A", "VB", "MD", "NP", "PUNC"])
        return [head, symbol, [tree(depth - 1) for _ in range(rnd.choice([1, 1, 2, 3]))] if depth and rnd.random() < 0.8 else []]

    made = [tree(rnd.randint(0, 7)) for _ in range(150)]
    df = spark.createDataFrame([(k, Plain.source(t)) for k, t in enumerate(made)], "k int, t string")
    plain = {
        "flat": (X.Edits(("flat",)), lambda t: Plain.flat(t, False, True)), "flat up": (X.Edits(("flat",), up=True), lambda t: Plain.flat(t, True, True)),
        "noflat": (X.Edits(("noflat",), up=True), lambda t: Plain.flat(t, True, False)), "pas": (X.Edits(("pas",)), lambda t: Plain.verbs(t, X.BE, X.BE_SYMBOLS)),
        "aux": (X.Edits(("aux",)), lambda t: Plain.verbs(t, X.AUXILIARIES, X.AUX_SYMBOLS)), "rmpunc": (X.Edits(("rmpunc",)), Plain.strip),
        "flat pas aux": (X.Edits(("flat", "pas", "aux")), lambda t: Plain.verbs(Plain.verbs(Plain.flat(t, False, True), X.BE, X.BE_SYMBOLS), X.AUXILIARIES, X.AUX_SYMBOLS)),
    }
    for name, (edits, f) in plain.items():
        for r in X.edited(df, "k", "t", edits).collect():
            assert r.t == Plain.show(f(made[r.k])), (name, Plain.source(made[r.k]))


def test_bad_trees_are_null(spark):
    df = spark.createDataFrame([("(a b",), (None,), ("",), ("a/B",)], "t string")
    assert [r[0] for r in df.select(X.edit(F.col("t"), X.Edits(()))).collect()] == [None, None, None, "a/B"]


def test_reading_grows_with_the_tokens(spark):
    """A fold over arrays of structs took milliseconds a tree: 20,000 trees of 20 words, read and edited, would take minutes."""
    import time

    words = " ".join(f"{k}/5" for k in range(2, 22))
    df = spark.range(20_000).select(F.col("id").alias("pair_id"), F.lit(f"(2 (3 {words}) 9/4)").alias("e_tree"))
    tree = F.lit(f"(TOP~a~1~1 (VP~a~1~1 {words} ?/PUNC.))")
    began = time.perf_counter()
    assert trees.nodes(df).count() == 20_000 * 23 and trees.rules(trees.with_nodes(df).select("pair_id", "nodes")).count() == 40_000
    assert X.edited(df.withColumn("t", F.concat(tree, F.lit(""))), "pair_id", "t", X.Edits(("conv", "all"), PUNCT)).filter("t LIKE '(TOP 2/5%'").count() == 20_000
    assert time.perf_counter() - began < 60


def test_a_tree_is_read_once(spark):
    df = spark.createDataFrame([(1, "(2 10/4 11/5)")], "pair_id int, e_tree string")
    plan = trees.nodes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "filter" not in plan.lower()
