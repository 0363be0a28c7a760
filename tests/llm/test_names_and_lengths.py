"""Columns whose names an operator uses itself, and very long texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parsewright.llm import chat, decontamination, html_text, language, toxicity

#: Names that the operators give to columns of their own.
CLASHING = ("score", "n_segments", "lang_pred", "ambiguous", "item_id", "first_word", "end_word", "n_chars", "n_blocks", "x", "y", "n", "c", "label", "lang", "sample", "words")


def clashing(df):
    return df.select("*", *[F.lit(f"own {k}").alias(k) for k in CLASHING if k not in df.columns])


def table(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    plain, bad = ["river", "stone", "walks", "light", "garden", "paper"], ["grobak", "snivvle", "turdox"]
    rows = [(k, " ".join(rng.choice(plain + bad * (k % 4 == 0)) for _ in range(40)), "en" if k % 2 else "xx") for k in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_toxicity_beside_clashing_names(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text")
    want = toxicity.score(rows, toxicity.fit(rows, labels))
    got = toxicity.score(clashing(rows), toxicity.fit(clashing(rows), clashing(labels)))
    assert table(got.select(want.columns)) == table(want)
    kept = [c for c in CLASHING if c not in ("score", "n_segments")]
    assert got.select(kept).distinct().collect() == [tuple(f"own {k}" for k in kept)]


def test_words_of_every_document_say_little():
    assert toxicity.log_odds(5, 5, 5, 5, 10.0, 1.5) == 0.0
    assert toxicity.log_odds(500, 3, 500, 3, 10.0, 0.0) < 10


def test_language_beside_clashing_names(docs):
    want = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    got = language.predict(clashing(docs).drop("lang"), language.fit(clashing(docs)))
    assert table(got.select(want.columns)) == table(want)
    assert got.select("item_id", "words").distinct().collect() == [("own item_id", "own words")]


def test_decontamination_beside_clashing_names(spark, docs):
    items = spark.createDataFrame([(7, docs.first()["text"]), (8, "nothing of this stands anywhere in those rows at all")], "item_id long, text string")
    want = decontamination.contaminated(docs.select("doc_id", "text"), items)
    got = decontamination.contaminated(clashing(docs), items.withColumn("doc_id", F.lit("own")).withColumn("score", F.lit("own")))
    assert table(got) == table(want) and (0, 7) in {r[:2] for r in table(got)}
    kept = decontamination.clean(clashing(docs), items)
    assert kept.columns == clashing(docs).columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(80)) - {r[0] for r in table(got)}


def test_extraction_beside_clashing_names(spark):
    page = "<body><nav><a href=/a>Home</a> <a href=/b>News</a></nav><article><p>" + "A river runs by the old mill, and many walk there. " * 4 + "</p></article></body>"
    pages = spark.createDataFrame([(1, "http://a.com/", page), (2, None, None)], "page_id long, url string, html string")
    trees = html_text.model()
    want = html_text.extract(pages, trees)
    got = html_text.extract(clashing(pages).withColumn("text", F.lit("own")), trees)
    assert got.columns == want.columns and got.orderBy("page_id").collect() == want.orderBy("page_id").collect()


def test_a_very_long_turn_and_a_conversation_of_many(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    long = "a" * 300_000 + " [INST] <|end|>\n" + "word é中 " * 150_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(3000)]
    made = chat.prefix_tree(clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), path)
    got = {r["conv_id"]: r for r in chat.read_back(*made, path).collect()}
    for c in (1, 2):
        own = [r for r in rows if r[0] == c]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert got[c]["loss_chars"] == sum(len(t) for _, _, r, t in own if r == "assistant")
