"""Corpus operators, parameter tables, training and formats on small corpora."""

import math

import pytest
from pyspark.sql import functions as F

from parsewright.operators import corpus, em, params, reports, vocab
from parsewright.sources import formats

PAIRS = [(1, "(2 10/4 11/5)", [20, 21]), (2, "10/4", [20]), (3, "(2 11/5 10/4)", [21, 20]), (4, "11/5", [21]), (5, "(2 (3 10/4 11/5) 12/6)", [20, 21, 22]), (6, "12/6", [22])]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(PAIRS, "pair_id long, e_tree string, f array<int>")


def plain(**options):
    return em.Config(chinese=False, cutoff=False, fertility=False, lambda1=0.0, old_rules=False).with_options(**options)


@pytest.mark.parametrize("config", [plain(), plain(shared_words=False), plain(old_rules=True), plain(fertility=True)])
def test_training_improves_and_normalizes(spark, pairs, config):
    fit = em.train(pairs, config=config.with_options(iterations=4))
    curve = [r["log2"] for r in fit.history.orderBy("iteration").collect()]
    assert all(b >= a - 1e-9 for a, b in zip(curve[1:], curve[2:], strict=False))
    for table, by in ((fit.model.t, "e"), (fit.model.r, "rule"), (fit.model.n, "ctx")):
        for r in table.groupBy(by).agg(F.sum("prob").alias("p")).collect():
            assert r["p"] == pytest.approx(1.0) or r["p"] == 0
    best = {r["e"]: r["f"] for r in fit.model.t.groupBy("e").agg(F.max_by("f", "prob").alias("f")).collect()}
    assert (best["10"], best["11"], best["12"]) == ("20", "21", "22")


def test_default_configuration(spark, pairs):
    allowed = corpus.phrase_cutoff(corpus.cooccurrence(pairs), 0, 0)
    fit = em.train(pairs, allowed, pairs.filter("pair_id < 3"), em.Config(iterations=3), final_test=True)
    rows = fit.history.orderBy("iteration", "part").collect()
    assert [(r["iteration"], r["part"]) for r in rows] == [(1, "test"), (1, "train"), (2, "test"), (2, "train"), (3, "test"), (3, "train"), (4, "test")]
    assert all(math.isfinite(r["perplexity"]) for r in rows)
    aligned = reports.alignment(pairs, fit.model).collect()
    for r in aligned:
        assert r["prob"] <= r["total"] * (1 + 1e-9)
    # lambda1 counts add up over iterations
    assert {r["e"]: round(r["cnt"] + r["ncnt"], 6) for r in fit.model.lambda1.collect()}["10 11"] > 2.5
    assert reports.phrases(pairs, fit.model).columns == ["pair_id", "elen", "flen", "prob", "label", "e", "f"]
    assert reports.best_trees(pairs, fit.model).count() == 2 * len({r["pair_id"] for r in aligned if r["total"] > 0})


def test_rejected_pairs(spark):
    rows = [(1, "10/4", []), (2, "10/4", [0, 20]), (3, "10/4", [20] * 4), (4, "10/4", [20] * 30), (5, "10/4", [20]), (6, "(2 " + " ".join(["10/4"] * 20) + ")", [20])]
    df = spark.createDataFrame(rows, "pair_id long, e_tree string, f array<int>")
    made, _ = em.prepare(df, plain())
    assert [r["pair_id"] for r in made.filter("ok").collect()] == [5]


def test_zero_fertility_report(spark):
    df = spark.createDataFrame([(1, "(2 10/4 11/5)", [20])], "pair_id long, e_tree string, f array<int>")
    config = plain()
    t = spark.createDataFrame([("10", "20", 0.9), ("10", "0", 0.1), ("11", "0", 1.0)], "e string, f string, prob double")
    r = spark.createDataFrame([("2 4 5", 0, 1.0), ("2 4 5", 1, 0.0)], "rule string, perm int, prob double")
    n = spark.createDataFrame([("0 2|0", 0, 1.0), ("2 4 5|0", 0, 1.0), ("2 4 5|1", 0, 1.0)], "ctx string, ins int, prob double")
    words = spark.createDataFrame([("20", 1.0)], "word string, prob double")
    model = em.Model(config, t=t, r=r, n=n, insword=words, equal=False)
    assert sorted((x["kind"], x["line"]) for x in reports.zero_fertility(df, model).collect()) == [("F0Rule", "2 1 -> 4 5"), ("F0Word", "5 -> 11")]
    assert [tuple(x)[:6] for x in reports.alignment(df, model).orderBy("seq").collect()] == [(1, 0, 0, 1, 0, 1), (1, 1, 1, 1, 1, 0)]
    used = reports.used_probs(df, model).groupBy("kind").count().collect()
    assert {x["kind"]: x["count"] for x in used} == {"R": 1, "N": 3, "T": 2}
    lines = reports.zero_fertility(df, model)
    assert [tuple(x) for x in reports.top_lines(lines, five_fields=True).collect()] == [("2 1 -> 4 5", 1)] or reports.top_lines(lines).count() == 2


def test_phrase_table(spark):
    counts = spark.createDataFrame([("1", "2", 1), ("1", "2 3", 1), ("1", "2 4", 2), ("1 5", "2", 4), ("1 5", "3", 5), ("1 5", "4", 99)], "e string, f string, cnt long")
    assert {tuple(r) for r in corpus.phrase_cutoff(counts).collect()} == {("1", "2"), ("1", "2 4"), ("1 5", "3"), ("1 5", "4")}
    assert corpus.phrase_cutoff(counts, 1, 10).filter(F.col("e").contains(" ")).count() == 0  # counts saturate


def test_lambda1(spark):
    table = spark.createDataFrame([("1 2", 0.3)], "e string, prob double")
    keys = spark.createDataFrame([("1",), ("1 2",), ("3 4",)], "e string")
    get = lambda **k: {r["e"]: r["l1"] for r in params.lambda1_lookup(keys, table, **k).collect()}
    assert get() == {"1": 0, "1 2": 0.3, "3 4": 0}
    assert get(equal=True, cutoff=True) == {"1": 0, "1 2": 0.5, "3 4": 0}
    assert get(equal=True) == {"1": 0, "1 2": 0.5, "3 4": 0.5}


def test_empty_corpus(spark, pairs):
    none = pairs.limit(0)
    assert corpus.cooccurrence(none).count() == 0
    assert vocab.vocabulary(none.withColumn("w", F.array(F.lit("a"))), "w").count() == 0
    assert em.perplexity(spark.createDataFrame([], "pair_id long, n_e int, prob double")).first()["pairs"] == 0


def test_split_and_rank(spark):
    df = spark.range(250).select(F.col("id").alias("pair_id"))
    out = corpus.split(df)
    assert [r["pair_id"] for r in out.filter("split = 'test'").orderBy("pair_id").collect()] == [0, 100, 200]


def test_formats_round_trip(spark, pairs, tmp_path):
    formats.write_bxi(pairs, str(tmp_path / "bxi"))
    back = formats.read_bxi(spark, str(tmp_path / "bxi"))
    assert sorted((r["e_tree"], tuple(r["f"])) for r in back.collect()) == sorted((t, tuple(f)) for _, t, f in PAIRS)
    lines = formats.numbered_lines(spark, str(tmp_path / "bxi"))
    assert formats.bxi_from_lines(lines.filter(F.col("line") != "").union(lines.filter("line = ''").limit(0)), file="file").columns == ["file", "record", "e_tree", "f"]
    allowed = corpus.phrase_cutoff(corpus.cooccurrence(pairs), 0, 0)
    formats.write_cutoffs(allowed, str(tmp_path / "cut"))
    assert {tuple(r) for r in formats.read_cutoffs(spark, str(tmp_path / "cut")).collect()} == {tuple(r) for r in allowed.collect()}
    t = spark.createDataFrame([("1", "2", 0.25), ("1", "3", 0.75), ("1", "4", 0.0)], "e string, f string, prob double")
    fert = spark.createDataFrame([("1", 0, 0.5), ("1", 2, 0.5), ("1", 3, 0.0)], "e string, n int, prob double")
    lam = spark.createDataFrame([("1", 0.125)], "e string, prob double")
    formats.write_ttable(t, fert, lam, str(tmp_path / "t"))
    rows = {(r["kind"], r["f"], r["n"]): r["prob"] for r in formats.read_ttable(spark, str(tmp_path / "t")).collect()}
    assert rows == {("t", "2", None): 0.25, ("t", "3", None): 0.75, ("fert", None, 0): 0.5, ("fert", None, 1): 0.0, ("fert", None, 2): 0.5, ("lambda1", None, None): 0.125}
    r = spark.createDataFrame([("2 3 4", 0, 0.5), ("2 3 4", 1, 0.5)], "rule string, perm int, prob double")
    n = spark.createDataFrame([("2 3 4|0", 0, 0.75), ("2 3 4|1", 2, 0.25)], "ctx string, ins int, prob double")
    words = spark.createDataFrame([("7", 1.0)], "word string, prob double")
    formats.write_rntable(r, n, words, str(tmp_path / "rn"))
    got = {(x["kind"], x["rule"], x["i"], x["ins"], x["word"], x["prob"]) for x in formats.read_rntable(spark, str(tmp_path / "rn")).collect()}
    assert got == {("r", "2 3 4", 0, None, None, 0.5), ("r", "2 3 4", 1, None, None, 0.5), ("n", "2 3 4", 0, 0, "0", 0.75), ("n", "2 3 4", 1, 2, "0", 0.25), ("insword", None, None, None, "7", 1.0)}


def test_bad_record(spark, tmp_path):
    (tmp_path / "x").write_text("1/2\n3\nnot blank\n")
    with pytest.raises(Exception, match="blank"):
        formats.read_bxi(spark, str(tmp_path / "x")).collect()


def test_byte_ranges(spark, tmp_path):
    """Many small ranges, one range and one partition give the same records and numbers."""
    trees = [(k, f"(2 {k}/4 11/5)", [] if k % 3 == 0 else [k, 20]) for k in range(200)]
    formats.write_bxi(spark.createDataFrame(trees, "pair_id long, e_tree string, f array<int>").coalesce(1), str(tmp_path / "bxi"))
    t = spark.range(500).selectExpr("cast(id % 7 as string) e", "cast(id as string) f", "id / 1000 prob")
    formats.write_ttable(t, None, None, str(tmp_path / "t"))
    got = []
    for size in ("64m", "97", "50", "33"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            read = formats.read_bxi(spark, str(tmp_path / "bxi"))
            pieces = formats.records(spark, str(tmp_path / "bxi")).select("_block").distinct().count()
            names = sorted({r["file"] for r in read.collect()})
            rows = [(names.index(r["file"]), r["n"], r["e_tree"], tuple(r["f"])) for r in read.collect()]
            lines = [(names.index(r["file"]), r["n"], r["line"]) for r in formats.numbered_lines(spark, str(tmp_path / "bxi")).collect()]
            got.append((sorted(rows), sorted(lines), sorted(map(tuple, formats.read_ttable(spark, str(tmp_path / "t")).select("e", "f", "prob").collect()))))
            assert (pieces > 20) == (size != "64m")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == got[1] == got[2] == got[3]
    assert [(e, f) for _, _, e, f in got[0][0]] == [(e, tuple(f)) for _, e, f in trees]
    assert [n for k, n, _ in got[0][1] if k == 0] == list(range(sum(k == 0 for k, _, _ in got[0][1])))
    assert len(got[0][2]) == 499  # a probability of 0 is not written


def test_spaces_on_third_lines(spark, tmp_path):
    (tmp_path / "x").write_text("1/2\n3\n  \n4/2\n\n\n5/2\n6\n")
    assert sorted((r["n"], r["e_tree"], r["f"]) for r in formats.read_bxi(spark, str(tmp_path / "x")).collect()) == [(0, "1/2", [3]), (1, "4/2", []), (2, "5/2", [6])]


def test_listed_tables(spark, tmp_path):
    table = spark.createDataFrame([(2, "the", 9), (3, "a", 4)], "id int, word string, freq long")
    formats.write_listed(table, str(tmp_path / "v"), "id", "word", "freq")
    assert sorted(map(tuple, formats.read_vocabulary(spark, str(tmp_path / "v")).collect())) == [(2, "the", 9), (3, "a", 4)]
    assert formats.read_symbols(spark, str(tmp_path / "v")).columns == ["id", "sym", "freq"]
    (tmp_path / "c").write_text("# note\nNP-A NP\nX\n\nNP-A NN\n")
    rows = formats.read_conversions(spark, str(tmp_path / "c"))
    assert sorted((r["n"], r["source"], r["target"]) for r in rows.collect()) == [(1, "NP-A", "NP"), (2, "X", ""), (4, "NP-A", "NN")]
    symbols = spark.createDataFrame([("NP-A",), ("X",)], "s string")
    assert sorted(r["s"] for r in vocab.convert(symbols, "s", rows, order="n").collect()) == ["NP", "X"]


def test_writers_gather_no_lines(spark, tmp_path):
    """A record's lines are sorted rows: with a word of very many phrases no row holds them all."""
    table = spark.range(3000).selectExpr("'1' e", "cast(id as string) f")
    formats.write_cutoffs(table, str(tmp_path / "c"))
    lines = spark.read.text(str(tmp_path / "c"))
    assert lines.count() == 3001 and lines.agg(F.max(F.length("value"))).first()[0] < 10
    assert formats.read_cutoffs(spark, str(tmp_path / "c")).exceptAll(table).count() == 0


def test_concatenated_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(f"{name}1\n{name}2\n")
    rows = corpus.concat_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted((r["n"], r["line"]) for r in rows.collect()) == [(0, "a1"), (0, "b1"), (1, "a2"), (1, "b2")]


def test_frozen_tables_stay(spark, pairs):
    first = em.train(pairs, config=plain(iterations=1)).model
    again = em.train(pairs, config=plain(iterations=1, frozen=("t", "n")), start=em.Model(plain(iterations=1, frozen=("t", "n")), t=first.t, r=first.r, n=first.n, insword=first.insword, equal=False)).model
    key = lambda m: sorted(map(tuple, m.t.collect()))
    assert key(again) == key(first)


def test_model_from_dumps(spark, pairs, tmp_path):
    model = em.train(pairs, config=plain(iterations=2)).model
    formats.write_ttable(model.t, None, None, str(tmp_path / "t"))
    formats.write_rntable(model.r, model.n, model.insword, str(tmp_path / "rn"))
    back = em.from_dumps(plain(), formats.read_ttable(spark, str(tmp_path / "t")), formats.read_rntable(spark, str(tmp_path / "rn")))
    key = lambda m: sorted(map(tuple, reports.alignment(pairs, m).collect()))
    assert key(back) == key(model)


def test_config_files():
    assert em.read_config('A="1" # note\nB=2\n# C=3', "B='4'") == {"A": "1", "B": "4"}


def test_sentence_filter(spark):
    from parsewright.operators import transforms

    rows = [(1, "(S~a~1~1 a/A b/B c/C)", "x"), (2, "(S~a~1~1 a/A b/B)", "y"), (3, "(TOP~SentenceTooLong~1~1 SentenceTooLong/NN)", "z"), (4, "a/A", "w"), (5, None, "v")]
    out = corpus.btx(spark.createDataFrame(rows, "n int, tree string, f string"), transforms.Edits(()), 2)
    assert sorted(map(tuple, out.collect())) == [(2, "(a/S a/A b/B)", "y"), (4, "(a/A)", "w")]
