"""Parameter tables of the model as DataFrames: load, look up, accumulate, normalize.

t (e, f, prob), fert (e, n, prob), lambda1 (e, prob, cnt, ncnt), r (rule, perm, prob), n (ctx, ins, word, prob) with the
context (rule, child position) as text, insword (word, prob).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUAL = 0.1  # fixed value: every probability of the equal-probability start
MAX_PERMS = 24  # fixed value: orders of four children; uniform reorder tables spread over all of them
NULL = "0"
SHARED_WORD = "0"


def normalize(counts: DataFrame, by: list[str], value: str = "cnt", out: str = "prob") -> DataFrame:
    """count / sum over the same context; 0 where the sum is 0.

    The totals are a separate pre-aggregated table, so a context with very many rows is never gathered in one task.
    """
    totals = counts.groupBy(*by).agg(F.sum(value).alias("_total"))
    return counts.join(totals, by).withColumn(out, F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(F.lit(0.0))).drop("_total", value)


def t_uniform(allowed: DataFrame) -> DataFrame:
    """From a phrase table (e, f): each with the empty word, equal shares for every E."""
    rows = allowed.select("e", "f").unionByName(allowed.select("e", F.lit(NULL).alias("f")).distinct())
    return normalize(rows.withColumn("cnt", F.lit(1.0)), ["e"])


def words_in(phrase: Column) -> Column:
    return F.when(phrase == NULL, F.lit(0)).otherwise(F.size(F.split(phrase, " ")))


def t_lookup_equal(keys: DataFrame, allowed: DataFrame, cutoff: bool = True, fertility: bool = False) -> DataFrame:
    """Adds prob under the equal-probability start, of keys that meet the phrase table here."""
    rows = keys.join(allowed.select("e", "f", F.lit(True).alias("_in")).distinct(), ["e", "f"], "left")
    return rows.withColumn("prob", t_equal(F.col("_in").isNotNull(), cutoff, fertility)).drop("_in")


def t_equal(allowed: Column, cutoff: bool = True, fertility: bool = False) -> Column:
    """EQUAL, gated by ``allowed`` (whether the phrase table has the row) for all but word to word, times EQUAL a foreign word under fertility."""
    n_e, n_f = words_in(F.col("e")), words_in(F.col("f"))
    prob = F.lit(EQUAL) * (F.pow(F.lit(EQUAL), n_f) if fertility else F.lit(1.0))
    return F.when(((n_e > 1) | (n_f > 1)) & ~allowed, F.lit(0.0)).otherwise(prob) if cutoff else prob


def fertility_prob(keys: DataFrame, t: DataFrame, fert: DataFrame, key: list[str]) -> DataFrame:
    """Adds prob = fert(n | e) times the product of t(word | e); 0 if one is missing. The empty word has n = 0.

    A phrase of several words takes its words' and lengths' entries along as two maps, so its rows are shuffled once and
    multiplied in place. A single E word may have any number of rows and words, but few words a row: these are joined one by one.
    """
    one = ~F.col("e").contains(" ")
    rows = keys.withColumn("_n", words_in(F.col("f")))
    words = rows.filter(one & (F.col("_n") > 0)).select(*key, "e", F.explode(F.split("f", " ")).alias("w"))
    probs = words.join(t.filter(one).select("e", F.col("f").alias("w"), "prob"), ["e", "w"], "left").groupBy(*key).agg(F.product(F.coalesce("prob", F.lit(0.0))).alias("_p"))
    short = rows.filter(one).join(probs, key, "left").join(fert.filter(one).select("e", F.col("n").alias("_n"), F.col("prob").alias("_fert")), ["e", "_n"], "left")
    entries = lambda table, k, out: table.filter(~one).groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct(k, "prob"))).alias(out))
    asked = rows.filter(~one).join(entries(t, "f", "_words"), "e", "left").join(entries(fert, "n", "_lengths"), "e", "left")
    product = F.when(F.col("_n") > 0, F.aggregate(F.split("f", " "), F.lit(1.0), lambda p, w: p * F.coalesce(F.try_element_at("_words", w), F.lit(0.0))))
    long = asked.withColumn("_p", product).withColumn("_fert", F.try_element_at("_lengths", F.col("_n"))).drop("_words", "_lengths")
    return short.unionByName(long).withColumn("prob", F.coalesce("_fert", F.lit(0.0)) * F.coalesce("_p", F.lit(1.0))).drop("_n", "_p", "_fert")


def lambda1_lookup(keys: DataFrame, lambda1: DataFrame, equal: bool = False, cutoff: bool = False) -> DataFrame:
    """Adds l1: 0 for one word; one half in the equal phase (if e is in the table, under cutoff); else what is stored."""
    rows = keys.join(lambda1.select("e", F.col("prob").alias("_l")), "e", "left")
    half = F.when(F.col("_l").isNull(), 0.0).otherwise(0.5) if cutoff else F.lit(0.5)
    return rows.withColumn("l1", F.when(words_in(F.col("e")) <= 1, F.lit(0.0)).otherwise(half if equal else F.coalesce("_l", F.lit(0.0)))).drop("_l")


def lambda1_update(old: DataFrame | None, counts: DataFrame, reset: bool = False) -> DataFrame:
    """Counts add to those of all iterations before, unless ``reset``; prob = cnt / (cnt + ncnt), 0 without counts."""
    rows = counts.select("e", "cnt", "ncnt")
    if old is not None and not reset:
        rows = rows.unionByName(old.select("e", "cnt", "ncnt"))
    rows = rows.groupBy("e").agg(F.sum("cnt").alias("cnt"), F.sum("ncnt").alias("ncnt"))
    total = F.col("cnt") + F.col("ncnt")
    return rows.withColumn("prob", F.when(total > 0, F.col("cnt") / total).otherwise(F.lit(0.0)))


def r_uniform(rules: DataFrame) -> DataFrame:
    """From (rule, numc): each rule and, for its parent, ``TOP parent``, with equal shares over MAX_PERMS orders."""
    top = rules.select(F.concat(F.lit("0 "), F.get(F.split("rule", " "), F.lit(0))).alias("rule"), F.lit(1).alias("numc"))
    rows = rules.select("rule", F.col("numc").cast("int").alias("numc")).unionByName(top).distinct()
    factorial = F.element_at(F.array(*[F.lit(math.factorial(k)) for k in range(1, 5)]), F.col("numc"))
    return rows.select("rule", F.explode(F.sequence(F.lit(0), factorial - 1)).alias("perm"), F.lit(1.0 / MAX_PERMS).alias("prob"))


def n_uniform(rules: DataFrame) -> DataFrame:
    """(ctx, ins, prob): a third for no, right and left insertion at every child of every rule and under TOP."""
    top = rules.select(F.concat(F.lit("0 "), F.get(F.split("rule", " "), F.lit(0))).alias("rule"), F.lit(1).alias("numc"))
    rows = rules.select("rule", F.col("numc").cast("int").alias("numc")).unionByName(top).distinct()
    at = rows.select("rule", F.explode(F.sequence(F.lit(0), F.col("numc") - 1)).alias("pos"))
    at = at.select(F.concat_ws("|", "rule", F.col("pos").cast("string")).alias("ctx"))
    return at.select("ctx", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("ins"), F.lit(1.0 / 3).alias("prob"))


def rule_key_old(rule: Column) -> Column:
    """The parent replaced by the dummy parent."""
    return F.regexp_replace(rule, r"^\d+", "9999")


def n_context_old(rule: Column, pos: Column) -> Column:
    """Insertion context of the old mode: (parent, child)."""
    parts = F.split(rule, " ")
    return F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, pos + 1))


def n_lookup_shared(keys: DataFrame, sides: DataFrame, insword: DataFrame) -> DataFrame:
    """Adds prob to keys (ctx, ins, word): P(side | ctx), times P(word) for an insertion on either side."""
    rows = keys.join(sides.select("ctx", "ins", F.col("prob").alias("_s")), ["ctx", "ins"], "left").join(insword.select("word", F.col("prob").alias("_w")), "word", "left")
    word = F.when(F.col("ins") == 0, F.lit(1.0)).otherwise(F.coalesce("_w", F.lit(0.0)))
    return rows.withColumn("prob", F.coalesce("_s", F.lit(0.0)) * word).drop("_s", "_w")


def t_dump(t: DataFrame) -> DataFrame:
    """Only entries with a positive probability."""
    return t.filter("prob > 0").select("e", "f", "prob")


def fert_dump(fert: DataFrame) -> DataFrame:
    """For each e the probabilities from 0 up to the last one that is positive."""
    top = fert.filter("prob > 0").groupBy("e").agg(F.max("n").alias("_top"))
    return fert.join(top, "e").filter("n <= _top").drop("_top")


def t_lookup(keys: DataFrame, table: DataFrame | None, single_words: bool = False) -> DataFrame:
    """Adds the stored prob, 0 where there is none. ``single_words``: only one E word with at most one F word has one, and is joined.

    Without a table every prob is 0.
    """
    if table is None:
        return keys.withColumn("prob", F.lit(0.0))
    rest = None
    if single_words:
        one = F.coalesce((words_in(F.col("e")) == 1) & (words_in(F.col("f")) <= 1), F.lit(False))
        keys, table, rest = keys.filter(one), table.filter(one), keys.filter(~one).withColumn("prob", F.lit(0.0))
    rows = keys.join(table.select("e", "f", F.col("prob").alias("_p")), ["e", "f"], "left")
    rows = rows.withColumn("prob", F.coalesce("_p", F.lit(0.0))).drop("_p")
    return rows if rest is None else rows.unionByName(rest)


def r_lookup(keys: DataFrame, r: DataFrame | None) -> DataFrame:
    """Adds prob to (rule, perm, is_leaf): 1 at a leaf; EQUAL without a table (the equal-probability start); else what is stored."""
    if r is None:
        return keys.withColumn("prob", F.when(F.col("is_leaf"), F.lit(1.0)).otherwise(F.lit(EQUAL)))
    rows = keys.join(r.select("rule", "perm", F.col("prob").alias("_p")), ["rule", "perm"], "left")
    return rows.withColumn("prob", F.when(F.col("is_leaf"), F.lit(1.0)).otherwise(F.coalesce("_p", F.lit(0.0)))).drop("_p")


def insword_uniform(vocab_f: DataFrame) -> DataFrame:
    """(word, prob): equal shares over the ids of a vocabulary."""
    total = F.broadcast(vocab_f.agg(F.count(F.lit(1)).alias("_n")))  # one row
    return vocab_f.crossJoin(total).select(F.col("id").cast("string").alias("word"), (F.lit(1.0) / F.col("_n")).alias("prob"))
