"""Vocabularies, integerizing, symbol tables, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parsewright.functions.ranking import global_rank

#: Reserved ids.
NULL_WORD, UNK, TOP, DUMMY_PARENT = 0, 1, 0, 9999
MAX_ID = 65500


def word_counts(df: DataFrame, words: str) -> DataFrame:
    """(word, freq) of an array column."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def vocabulary(df: DataFrame, words: str, first: int = UNK + 1) -> DataFrame:
    """(id, word, freq): ids from ``first`` by descending frequency, ties by word."""
    ranked = global_rank(word_counts(df, words), F.desc("freq"), F.asc("word"))
    return ranked.select((F.col("rank") + (first - 1)).cast("int").alias("id"), "word", "freq")


def top_vocabulary(vocab: DataFrame, top: int = 65530) -> DataFrame:
    """The most frequent words, by descending frequency and word."""
    return vocab.orderBy(F.desc("freq"), "word").limit(top).select("word", "freq")


def singleton_cutoff(vocab: DataFrame, most: int = MAX_ID) -> DataFrame:
    """One row: the id of the first word that occurs once, at most ``most``."""
    return vocab.agg(F.least(F.min(F.when(F.col("freq") == 1, F.col("id"))), F.lit(most)).alias("max_id"))


def integerize(df: DataFrame, key: str, words: str, vocab: DataFrame, out: str, max_id: int | None = None) -> DataFrame:
    """Adds the array of ids of an array of words; words that are unknown or beyond ``max_id`` become UNK.

    Tokens join the vocabulary on the word. A word of a large share of all tokens is handled by adaptive skew joins;
    small vocabularies broadcast by their measured size.
    """
    known = vocab.select("word", "id") if max_id is None else vocab.filter(F.col("id") <= max_id).select("word", "id")
    tokens = df.select(key, F.posexplode(words).alias("_pos", "word")).join(known, "word", "left")
    ids = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("id", F.lit(UNK)).alias("id")))).alias("_ids"))
    return df.join(ids, key, "left").withColumn(out, F.coalesce(F.transform("_ids", lambda x: x["id"]), F.array().cast("array<int>"))).drop("_ids")


def integerize_sides(df: DataFrame, key: str, sides: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(key, an array of ids for each name of ``sides``), from a column of words and its vocabulary for each; unknown words become UNK.

    The tokens of all sides meet their row in one group, and nothing is joined back. ``key`` is of one row each.
    """
    tokens = None
    for k, (words, vocab) in enumerate(sides.values()):
        each = F.posexplode(words) if k else F.posexplode_outer(words)  # a row without words stays
        rows = df.select(key, F.lit(k).alias("_side"), each.alias("_pos", "word")).join(vocab.select("word", "id"), "word", "left").select(key, "_side", "_pos", F.coalesce("id", F.lit(UNK)).alias("id"))
        tokens = rows if tokens is None else tokens.unionByName(rows)
    ids = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_side", "_pos", "id"))).alias("_ids"))
    of = lambda k: F.transform(F.filter("_ids", lambda x: (x["_side"] == k) & x["_pos"].isNotNull()), lambda x: x["id"])
    return ids.select(key, *[of(k).alias(name) for k, name in enumerate(sides)])


def symbol_table(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """(id, sym, freq): ranks from 1 by descending frequency, ties by symbol."""
    counts = symbols.groupBy(F.col(column).alias("sym")).agg(F.count(F.lit(1)).alias("freq"))
    ranked = global_rank(counts, F.desc("freq"), F.asc("sym"))
    return ranked.select(F.col("rank").cast("int").alias("id"), "sym", "freq")


def convert(df: DataFrame, column: str, table: DataFrame, source: str = "source", target: str = "target", order: str | None = None, times: int = 2) -> DataFrame:
    """Map a column through (source, target); first match wins by ``order``; no or empty match keeps. Applied ``times`` over."""
    first = table.groupBy(F.col(source).alias("_s")).agg((F.min_by(target, order) if order else F.min(target)).alias("_t"))
    for _ in range(times):
        df = df.join(first, F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce(F.nullif(F.col("_t"), F.lit("")), F.col(column))).drop("_s", "_t")
    return df


def ngrams(df: DataFrame, words: str, n: int, marks: tuple[str, str] | None = ("<s>", "</s>")) -> DataFrame:
    """(w1..wn, cnt) over arrays of words, between sentence marks; one pass, no join."""
    seq = F.col(words) if marks is None else F.concat(F.array(F.lit(marks[0])), F.col(words), F.array(F.lit(marks[1])))
    starts = F.when(F.size(seq) >= n, F.sequence(F.lit(0), F.size(seq) - n)).otherwise(F.array().cast("array<int>"))
    rows = df.select(seq.alias("_w"), F.explode(starts).alias("_i"))
    grams = rows.select(*[F.get("_w", F.col("_i") + k).alias(f"w{k + 1}") for k in range(n)])
    return grams.groupBy(*[f"w{k + 1}" for k in range(n)]).agg(F.count(F.lit(1)).alias("cnt"))


def mle(counts: DataFrame, n: int) -> DataFrame:
    """Adds p = cnt / the sum over the same history."""
    history = [f"w{k + 1}" for k in range(n - 1)]
    totals = counts.groupBy(*history).agg(F.sum("cnt").alias("_total"))
    return counts.join(totals, history).withColumn("p", F.col("cnt") / F.col("_total")).drop("_total")


def unk_above(ids: Column, max_id: int) -> Column:
    return F.transform(ids, lambda x: F.when(x > max_id, F.lit(UNK)).otherwise(x))
