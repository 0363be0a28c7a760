"""Shapes of physical plans that must hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from parsewright.functions import text
from parsewright.operators import corpus, trees, vocab


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def pairs(spark, tmp_path):
    rows = [(k, "(2 (3 10/4 11/5) 12/6)", [20, 21, 22]) for k in range(50)]
    spark.createDataFrame(rows, "pair_id long, e_tree string, f array<int>").write.parquet(str(tmp_path / "pairs"))
    return spark.read.parquet(str(tmp_path / "pairs"))


def test_trees_need_no_shuffle(pairs):
    assert "Exchange" not in plan(trees.nodes(pairs))
    assert "Exchange" not in plan(trees.rules(trees.with_nodes(pairs)))
    assert "Exchange" not in plan(corpus.spans(pairs))


def test_phrase_table_is_one_shuffle(pairs):
    p = plan(corpus.phrase_cutoff(corpus.cooccurrence(pairs)))
    assert len(re.findall(r"\bExchange hashpartitioning", p)) == 1
    assert "partial_count" in p
    assert "Python" not in p


def test_only_needed_columns_are_read(pairs):
    assert re.search(r"ReadSchema: struct<e_tree:string>", plan(trees.with_nodes(pairs).select(trees.max_children(F.col("nodes")))))


def test_text_stays_in_the_jvm(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("line"))
    p = plan(df.select(text.ptb_tokenize(F.col("line")), text.pos_format(F.col("line")), text.length_gate(F.col("line"))))
    assert "Python" not in p
    assert "Arrow" not in p


def test_ranks_have_no_global_sort(spark):
    df = spark.range(100).select(F.array(F.col("id").cast("string")).alias("w"))
    p = plan(vocab.vocabulary(df, "w"))
    single = p.count("SinglePartition")
    assert single == 1  # of the groups' counts alone, never of the words
    assert "rangepartitioning" not in p


def test_filters_reach_the_scan(pairs):
    assert "PushedFilters: [IsNotNull(pair_id), GreaterThan(pair_id,10)]" in plan(trees.nodes(pairs.filter("pair_id > 10")))


def test_stretches_of_phrases_are_not_shuffled(pairs):
    """Phrases of several words reach their task with whole sentences and are cut and counted there."""
    text = plan(corpus.phrase_counts(pairs))
    before = text[: text.index("REPARTITION_BY_COL")].splitlines()[:-1]
    branch = before[max(k for k, line in enumerate(before) if "Scan" in line) + 1 :]
    assert any("Generate" in line for line in branch) and not any("Exchange" in line for line in branch)
    assert corpus.phrase_counts(pairs).exceptAll(corpus.cooccurrence(pairs)).isEmpty() and corpus.cooccurrence(pairs).exceptAll(corpus.phrase_counts(pairs)).isEmpty()


def test_factors_of_phrases_are_not_rows(spark):
    from parsewright.operators import params

    keys = spark.createDataFrame([("1 2", "5 6 5"), ("1 2", "5 7"), ("1 2", "0"), ("1 3", "5"), ("4", "5 6"), ("4", "0")], "e string, f string")
    t = spark.createDataFrame([("1 2", "5", 0.5), ("1 2", "6", 0.25), ("4", "5", 0.5), ("4", "6", 0.5)], "e string, f string, prob double")
    fert = spark.createDataFrame([("1 2", 3, 0.5), ("1 2", 2, 0.5), ("1 2", 0, 0.125), ("1 3", 1, 1.0), ("4", 2, 0.5), ("4", 0, 0.25)], "e string, n int, prob double")
    out = params.fertility_prob(keys, t, fert, ["e", "f"])
    assert {(r.e, r.f): r.prob for r in out.collect()} == {("1 2", "5 6 5"): 0.03125, ("1 2", "5 7"): 0.0, ("1 2", "0"): 0.125, ("1 3", "5"): 0.0, ("4", "5 6"): 0.125, ("4", "0"): 0.25}
    exploded = [line for line in plan(params.fertility_prob(keys.filter("e = '1 2'"), t, fert, ["e", "f"])).splitlines() if "aggregate(split(f" in line]
    assert exploded  # multiplied in the row


def test_parameters_meet_their_pairs_in_one_group(spark, pairs):
    """No table of phrases or words is sent to the driver and broadcast, and a pair's tables take one join."""
    from parsewright.operators import em

    config = em.Config()
    made = lambda kind, *row: spark.createDataFrame([row], kind)
    t, fert, words = made("e string, f string, prob double", "10", "20", 1.0), made("e string, n int, prob double", "10", 1, 1.0), made("word string, prob double", "20", 1.0)
    l1, r, n = made("e string, prob double", "10 11", 0.5), made("rule string, perm int, prob double", "9999 4 5", 0, 1.0), made("ctx string, ins int, prob double", "3 4|0", 0, 1.0)
    rows, keys = em.prepare(pairs, config)
    out = em.gathered(rows, keys, em.Model(config, t=t, fert=fert, lambda1=l1, r=r, n=n, insword=words, equal=False))
    joins = [line for line in plan(out).splitlines() if "Join" in line]
    assert not [x for x in joins if "Broadcast" in x and re.search(r"Join \[(e|f|word)#", x)]
    assert len([x for x in joins if re.search(r"Join \[pair_id#", x)]) == 1
    got = out.first()
    assert [x.f for x in got.tw] == ["20"] and got.fert[0].prob == 1.0 and got.l1[0].l1 == 0.5 and got.r == {"9999 4 5": [1.0]} and got.n == {"3 4|0": [1.0, 0.0, 0.0]} and got.words == {"20": 1.0} and got.t is None


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("talk"))
    spark.createDataFrame([(c, t, "user", "one two three. four five six seven") for c in range(3) for t in range(2)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["n_shared_prob", "n_full_normalize", "r_lookup", "t_normalize", "fertility_normalize"])
def test_trees_are_read_once(spark, talk, name):
    """What is read more than once has been written: its sums and joins don't read the trees again."""
    from parsewright.plans import registry

    assert "ArrowEvalPython" not in plan(registry.QUERIES[name](spark, talk))


def test_counts_do_not_meet_themselves(spark, talk):
    """The phrase table is a part of the counts: their rows carry along whether they are in it, and come from a table of spans."""
    from parsewright.plans import registry

    text = plan(registry.QUERIES["t_lookup_equal_prob"](spark, talk))
    assert "Join" not in text and "ArrowEvalPython" not in text


def test_ids_of_both_sides(spark):
    """As side by side by ``integerize``, without a join on the key."""
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["x"]), (2, ["b", "?"], []), (3, [], ["y", "x"]), (4, [], None)], "k int, e array<string>, f array<string>")
    table = lambda rows: spark.createDataFrame(rows, "id int, word string, freq long")
    e, f = table([(2, "a", 2), (3, "b", 2)]), table([(2, "x", 2), (3, "y", 1)])
    out = vocab.integerize_sides(df, "k", {"e": ("e", e), "f": ("f", f)})
    assert sorted(map(tuple, out.collect())) == [(1, [2, 3, 2], [2]), (2, [3, 1], []), (3, [], [3, 2]), (4, [], [])]
    by_two = vocab.integerize(vocab.integerize(df, "k", "e", e, "e2"), "k", "f", f, "f2").select("k", "e2", "f2")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, by_two.collect()))
    assert not re.search(r"Join \[k#", plan(out))


def test_rules_are_kept_as_counts(spark, talk, monkeypatch):
    from parsewright.operators import em
    from parsewright.plans import registry

    kept = []
    monkeypatch.setattr(em, "checkpointed", lambda df, write=em.checkpointed: kept.append(write(df)) or kept[-1])
    registry.QUERIES["source_rntable"](spark, talk)
    assert kept[0].count() < registry.QUERIES["tree_rules"](spark, talk).count() == kept[0].agg(F.sum("cnt")).first()[0]
