"""Text functions against shipped samples and small cases."""

from pyspark.sql import functions as F

from parsewright.functions import lengths, text
from parsewright.operators import reports


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "line string").select(f(F.col("line")).alias("x")).first()["x"]


def test_tokenizer_sample(spark):
    assert column(spark, "the old dog (asleep) sighs.", text.ptb_tokenize) == "the old dog -LRB- asleep -RRB- sighs . "


def test_tokenizer_cases(spark):
    for raw, want in [
        ('"I can\'t," he said.', "`` I ca n't , '' he said . "),
        ("They're gonna go...", "They 're gon na go ... "),
        ("Mr. Smith's dog--a big one!", "Mr. Smith 's dog -- a big one ! "),
        ("'Tis a cannot", "'T is a can not "),
        ("", ""),
    ]:
        assert column(spark, raw, text.ptb_tokenize) == want


def test_null_line(spark):
    assert column(spark, None, text.ptb_tokenize) is None


def test_pos_format(spark):
    assert column(spark, "a_b_NN (_( c_VB", text.pos_format) == "3 a_b NN -LRB- -LRB- c VB"


def test_length_gate(spark):
    ok = "2 a NN b NN"
    assert column(spark, ok, lambda c: text.length_gate(c, 2, 100)) == ok
    assert column(spark, ok, lambda c: text.length_gate(c, 1, 100)) == text.TOO_LONG
    assert column(spark, ok, lambda c: text.length_gate(c, 2, 5)) == text.TOO_LONG


def test_parse_filter_runs_over_lines(spark):
    lines = ["PROB 1 -2 0", "(TOP a)", "TIME 0", "PROB 0 0 0", "(TOP bad)", "(TOP bad2)", "PROB 2 -1 0", "(TOP SentenceTooLong)", "(TOP c)"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    kept = [r["line"] for r in text.parse_filter(text.parser_lines(df)).orderBy("n").collect()]
    assert kept == ["(TOP a)", "(TOP c)"]


def test_lm_text(spark):
    assert column(spark, "a b .", text.lm_text) == "<s> A B </s>"


def test_bands():
    want = {1: ((1, 3), (1, 8)), 2: ((1, 4), (1, 10)), 3: ((1, 6), (1, 12)), 5: ((2, 9), (1, 15)), 10: ((6, 16), (7, 24)), 20: ((14, 30), (18, 41))}
    for n, (a, b) in want.items():
        assert lengths.DEFAULT_BAND.of(n) == a
        assert lengths.CHINESE_BAND.of(n) == b


def test_decoder_line(spark):
    assert column(spark, "NP-A 1 -> X TOP V_P", reports.decoder_line) == "NP.A 1 -> .X. .TOP. V^P"
