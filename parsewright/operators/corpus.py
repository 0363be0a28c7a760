"""Parallel corpora: derived pairs, filters, splits, phrase co-occurrence and cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parsewright.functions.lengths import DEFAULT_BAND, Band
from parsewright.functions.ranking import global_rank

from . import trees, vocab


#: What ends a sentence, and what a word is, in texts that have no lines of their own.
SENTENCE_END, WORD = r"[.!?\n]+", r"\p{L}+"
#: Room of a turn's number and of a sentence's number in a pair_id.
TURNS, SENTENCES = 10_000, 100_000


def word_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, e_words, f_words): each turn's sentences, lower-cased (E), with the words of the next turn (F), case kept.

    The last turn of a conversation goes with its first, so that every word of every text is once in E and once in F. F's
    words are dealt to the sentences in order, as evenly as they go; a sentence may get none. Turns without words, without
    a conversation or a number are no sentences. pair_id is ``conv_id``, turn and sentence side by side; numbers that
    don't fit are an error.
    """
    cut = lambda c: F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    sentences = F.filter(F.transform(F.split(F.lower("text"), SENTENCE_END), cut), lambda w: F.size(w) > 0)
    turns = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "text", sentences.alias("e"), cut(F.col("text")).alias("f")).filter("size(e) > 0")
    turns = turns.repartition("conv_id")  # what the window needs, also where one file is one partition
    at = W.partitionBy("conv_id").orderBy("turn", "text")
    after = F.coalesce(F.lead("f").over(at), F.first("f").over(at.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = turns.withColumn("f", after).select("conv_id", "turn", "f", F.size("e").alias("n"), F.posexplode("e").alias("k", "e_words"))
    place = lambda k: F.floor(k * F.size("f") / F.col("n")).cast("int")
    begin, end = place(F.col("k").cast("long")), place(F.col("k").cast("long") + 1)
    fits = F.col("turn").between(0, TURNS - 1) & (F.col("k") < SENTENCES) & (F.abs("conv_id") < 2**63 // (TURNS * SENTENCES))
    pair_id = F.when(fits, (F.col("conv_id") * TURNS + F.col("turn")) * SENTENCES + F.col("k")).otherwise(F.raise_error(F.lit("conv_id, turn or sentence beyond a pair_id's room")))
    return rows.select(pair_id.alias("pair_id"), "e_words", F.slice("f", begin + 1, end - begin).alias("f_words"))


def tree_text(ids: Column) -> Column:
    """A tree over word ids: chunks of two under symbol 3, root symbol 2, leaves ``id/(4 + id mod 3)``; one word: a leaf.

    A node has four children at most: from more chunks, three stay and the rest goes under a further symbol 2.
    """
    leaf = lambda x: F.concat_ws("/", x.cast("string"), (F.lit(4) + F.pmod(x, F.lit(3))).cast("string"))
    leaves = F.transform(ids, leaf)
    chunk = lambda k: F.when(2 * k + 1 < F.size(ids), F.concat(F.lit("(3 "), F.get(leaves, 2 * k), F.lit(" "), F.get(leaves, 2 * k + 1), F.lit(")"))).otherwise(F.get(leaves, 2 * k))
    n = F.ceil(F.size(ids) / 2).cast("int")
    opened = lambda k: F.when((k > 0) & (k % 3 == 0) & (n - k > 1), F.concat(F.lit("(2 "), chunk(k))).otherwise(chunk(k))
    chunks = F.transform(F.sequence(F.lit(0), n - 1), opened)
    closed = F.repeat(F.lit(")"), F.greatest(F.floor((n - 2) / 3).cast("int"), F.lit(0)) + 1)
    return F.when(F.size(ids) == 1, F.get(leaves, F.lit(0))).otherwise(F.concat(F.lit("(2 "), F.array_join(chunks, " "), closed))


def gated(pairs: DataFrame, max_e: int = 20, max_f: int = 30) -> DataFrame:
    """Pairs that the preparation lets through: parsed sentences of ``max_e`` words at most, fewer than ``max_f`` foreign words."""
    return pairs.filter((F.size("e") <= max_e) & (F.size("f") < max_f))


def bxi(words: DataFrame) -> DataFrame:
    """(pair_id, e_tree, e, f) with ids of the vocabularies of both sides."""
    both = vocab.integerize_sides(words, "pair_id", {"e": ("e_words", vocab.vocabulary(words, "e_words")), "f": ("f_words", vocab.vocabulary(words, "f_words"))})
    return both.select("pair_id", tree_text(F.col("e")).alias("e_tree"), "e", "f")


def corpus_filter(pairs: DataFrame, max_children: int = 4, max_id: int = vocab.MAX_ID, max_f: int = 30) -> DataFrame:
    """Pairs with few children a node and fewer than ``max_f`` foreign words; ids above ``max_id`` become UNK on both sides."""
    rows = trees.with_nodes(pairs).filter(trees.max_children(F.col("nodes")) <= max_children).filter(F.size("f") < max_f)
    fixed = trees.replace_heads(F.col("nodes"), F.col("e_tree"), max_id)
    return rows.select("pair_id", fixed.alias("e_tree"), vocab.unk_above(F.col("f"), max_id).alias("f"))


def split(pairs: DataFrame, ratio: float = 0.01, key: str = "pair_id") -> DataFrame:
    """Adds split: every (1/ratio)-th pair by key, counted from 0, is ``test``, the others ``train``."""
    every = round(1 / ratio)
    ranked = global_rank(pairs, F.asc(key), out="_rank")
    return ranked.withColumn("split", F.when((F.col("_rank") - 1) % every == 0, "test").otherwise("train")).drop("_rank")


def align_sample(train: DataFrame, n: int = 100, key: str = "pair_id") -> DataFrame:
    """The first n pairs by key."""
    return train.orderBy(key).limit(n)


def cooccurrence(pairs: DataFrame, band: Band = DEFAULT_BAND) -> DataFrame:
    """(e, f, cnt): the words under each node that is not unary, with every stretch of F in the length band.

    Node, stretch and counting happen in one pass up to the partial sums: a single shuffle, on (e, f), without Python. It
    costs far more than ``phrase_counts``.
    """
    if "nodes" not in pairs.columns:
        pairs = pairs.select("f", F.lit(0).alias("pair_id"), trees.node_expression(F.col("e_tree")).alias("nodes"))
    return spans(pairs, band).groupBy("e", "f").agg(F.count(F.lit(1)).alias("cnt"))


def phrase_counts(pairs: DataFrame, band: Band = DEFAULT_BAND) -> DataFrame:
    """The same rows as ``cooccurrence`` by three small shuffles in place of a large one.

    A phrase meets hundreds of stretches, nearly all of them once: phrases are shuffled with their whole sentences, equal ones
    as one row with their number, and cut into stretches where all rows of an E are, so these are never shuffled. A single
    word may be in any share of all sentences, but its stretches are short: they are counted before the shuffle, on (e, f).
    """
    rows = _phrases(pairs)
    short = _stretches(rows.filter("elen = 1"), band).groupBy("e", "f").agg(F.count(F.lit(1)).alias("cnt"))
    whole = rows.filter("elen > 1").groupBy("e", "elen", "f").agg(F.count(F.lit(1)).alias("times")).repartition("e")
    long = _stretches(whole.withColumn("epos", F.lit(0)), band, "times").groupBy("e", "f").agg(F.sum("times").alias("cnt"))
    return short.unionByName(long)


def with_spans(pairs: DataFrame, *keys: str) -> DataFrame:
    """(f, e, spans): a row a pair, with epos and elen of its non-unary nodes. All that phrases are made of, for a table to count them from."""
    rows = pairs if "nodes" in pairs.columns else trees.with_nodes(pairs)
    inner = F.filter("nodes", lambda n: n["numc"] != 1)
    return rows.select(*keys, "f", trees.words_of(F.col("nodes")).alias("e"), F.transform(inner, lambda n: F.struct(n["epos"].alias("epos"), n["elen"].alias("elen"))).alias("spans"))


def _phrases(pairs: DataFrame, *keys: str) -> DataFrame:
    """(f, epos, elen, e) of each non-unary node, words as strings."""
    rows = pairs if "spans" in pairs.columns else with_spans(pairs, *keys)
    rows = rows.select(*keys, F.col("f").cast("array<string>").alias("f"), F.col("e").cast("array<string>").alias("_e"), "spans")
    rows = rows.select(*keys, "f", "_e", F.explode("spans").alias("n"))  # words are made once a pair, before its nodes are rows
    return rows.select(*keys, "f", F.col("n.epos").alias("epos"), F.col("n.elen").alias("elen"), F.array_join(F.slice("_e", F.col("n.epos") + 1, F.col("n.elen")), " ").alias("e"))


def _stretches(rows: DataFrame, band: Band, *keys: str) -> DataFrame:
    """Each phrase with every stretch of its F in the band."""
    low, high = band.columns(F.col("elen"))
    lens = F.when(F.least(high, F.size("f")) >= low, F.sequence(low, F.least(high, F.size("f")))).otherwise(F.array().cast("array<int>"))
    made = rows.select(*keys, "epos", "elen", "e", "f", F.explode(lens).alias("flen"))
    made = made.select(*keys, "epos", "elen", "e", "f", F.explode(F.sequence(F.lit(0), F.size("f") - F.col("flen"))).alias("fpos"), "flen")
    return made.select(*keys, "epos", "elen", "fpos", "flen", "e", F.array_join(F.slice("f", F.col("fpos") + 1, F.col("flen")), " ").alias("f"))


def spans(pairs: DataFrame, band: Band = DEFAULT_BAND, with_null: bool = False) -> DataFrame:
    """A row for each (non-unary node, stretch of F in the band): pair_id, epos, elen, fpos, flen, e, f.

    ``with_null``: one-word nodes also meet the empty word ``0`` (fpos 0, flen 0).
    """
    rows = _phrases(pairs, "pair_id")
    made = _stretches(rows, band, "pair_id")
    if with_null:
        null = rows.filter("elen = 1").select("pair_id", "epos", "elen", F.lit(0).alias("fpos"), F.lit(0).alias("flen"), "e", F.lit("0").alias("f"))
        made = made.unionByName(null)
    return made


def phrase_cutoff(counts: DataFrame, cutoff: int = 1, cutoff2: int = 4, saturate: int = 10) -> DataFrame:
    """(e, f): counts (which saturate) above ``cutoff``, or one word on both sides; then, if cutoff2 > 0, longer E only above it."""
    return counts.filter(in_cutoff(cutoff, cutoff2, saturate)).select("e", "f")


def in_cutoff(cutoff: int = 1, cutoff2: int = 4, saturate: int = 10) -> Column:
    """Whether a row (e, f, cnt) is in the phrase table."""
    cnt = F.least("cnt", F.lit(saturate))
    many_e, many_f = F.col("e").contains(" "), F.col("f").contains(" ")
    keep = (cnt > cutoff) | (~many_e & ~many_f)
    return keep & ~(many_e & (cnt <= cutoff2)) if cutoff2 > 0 else keep


def shard(column: str = "e", shards: int = 20) -> Column:
    """The shard of a phrase: its first word modulo the number of shards."""
    return F.pmod(F.get(F.split(F.col(column), " "), F.lit(0)).cast("int"), F.lit(shards))


def children_histogram(pairs: DataFrame) -> DataFrame:
    """Sentences by their most children (a lone leaf counts 1)."""
    return trees.with_nodes(pairs).select(trees.max_children(F.col("nodes")).alias("max_children")).groupBy("max_children").agg(F.count(F.lit(1)).alias("sentences"))


def rule_frequencies(pairs: DataFrame) -> DataFrame:
    return trees.rules(trees.with_nodes(pairs).select("pair_id", "nodes")).groupBy("rule", "numc").agg(F.count(F.lit(1)).alias("freq"))


def join_parses(parses: DataFrame, foreign: DataFrame, key: str = "sent_id") -> DataFrame:
    """Trees that parsed with their foreign lines, by sentence key."""
    return parses.filter("parse_ok").select(key, "e_tree").join(foreign.select(key, "f"), key)


TOO_LONG_HEAD = "SentenceTooLong"


def btx(pairs: DataFrame, edits, most: int, tree: str = "tree") -> DataFrame:
    """Pairs of a string-labelled tree and a sentence whose edited tree has at most ``most`` children a node.

    Trees of over-long sentences leave; a lone leaf prints in parentheses; the other columns stay.
    """
    from . import transforms

    root = F.regexp_extract(tree, r"^\s*[(\[]?([^\s()\[\]]+)", 1)
    edited = pairs.withColumn("_edited", transforms.edit(F.col(tree), edits)).withColumn("_most", transforms.max_children(F.col(tree), edits))
    kept = edited.filter(F.col("_edited").isNotNull() & (F.col("_most") <= most) & ~root.rlike(rf"(^|~){TOO_LONG_HEAD}(~|/|$)"))
    shown = F.when(F.col("_edited").startswith("("), F.col("_edited")).otherwise(F.concat(F.lit("("), F.col("_edited"), F.lit(")")))
    return kept.withColumn(tree, shown).drop("_edited", "_most")


def concat_files(spark, paths: list[str]) -> DataFrame:
    """(file, n, line) of several text files as one corpus."""
    from parsewright.sources.formats import numbered_lines

    return numbered_lines(spark, paths)
