"""Named queries over the tables of a data folder, and the SQL that says the same.

Every query runs over all rows and whole texts: pairs hold every word of every text (``corpus.word_pairs``). Only limits
of the operators themselves leave pairs out: the preparation's before co-occurrence and training, the chart's in the chart.
Doubles are rounded on both sides, as sums are taken in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewright.functions import lengths, ranking, tables, text
from parsewright.operators import corpus, em, params, reports, transforms, trees, vocab
from parsewright.sources import formats

from .inputs import BASE, conversations, pairs, prepared, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOW, HIGH = lengths.DEFAULT_BAND.sql("x")


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name, with its SQL (after the common derivations unless ``base`` is off)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = BASE.replace("{low}", LOW).replace("{high}", HIGH) + sql if base else sql
        return f

    return add


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return trees.nodes(pairs(spark, sf))


def _cooc(spark: SparkSession, sf: str) -> DataFrame:
    """What is read several times, the words and the spans of the pairs' trees, is written once."""
    rows = corpus.gated(corpus.bxi(em.checkpointed(words(spark, sf))))
    return corpus.phrase_counts(em.checkpointed(corpus.with_spans(rows)))


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return trees.rules(trees.with_nodes(pairs(spark, sf)).select("pair_id", "nodes"))


# Text

@query("SELECT conv_id, turn, CAST(n - 1 AS INT) AS n, " + text.duckdb_ptb("line") + " AS tokens FROM (SELECT conv_id, turn, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations))", base=False)
def tokenize_ptb(spark, sf):
    lines = conversations(spark, sf).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("conv_id", "turn", "n", text.ptb_tokenize(F.col("line")).alias("tokens"))


@query("SELECT pair_id, len(e_words) || ' ' || array_to_string(list_transform(e_words, lambda w: w || ' NN' || length(w)), ' ') AS line FROM wp")
def pos_format(spark, sf):
    tagged = F.array_join(F.transform("e_words", lambda w: F.concat(w, F.lit("_NN"), F.length(w).cast("string"))), " ")
    return words(spark, sf).select("pair_id", text.pos_format(tagged).alias("line"))


@query("SELECT pair_id, CASE WHEN length(line) <= 1000 AND len(e_words) <= 20 THEN line ELSE '1 SentenceTooLong NN' END AS line FROM (SELECT *, len(e_words) || ' ' || array_to_string(e_words, ' NN ') || ' NN' AS line FROM wp)")
def length_gate(spark, sf):
    line = F.concat_ws(" ", F.size("e_words").cast("string"), F.array_join("e_words", " NN "), F.lit("NN"))
    return words(spark, sf).select("pair_id", text.length_gate(line).alias("line"))


PARSER = """SELECT pair_id, '(TOP ' || e_tree || ')' AS line FROM (
  SELECT pair_id, e_tree, len(e) AS n, last_value(CASE WHEN len(f) = 0 THEN false WHEN len(e) % 3 > 0 THEN true END IGNORE NULLS) OVER (ORDER BY pair_id) AS ok FROM pairs)
WHERE n <= 20 AND coalesce(ok, true)"""


@query(PARSER)
def parse_filter(spark, sf):
    """Output of a parser that gives up on sentences over 20 words and scores those without a foreign word as failed.

    Where the number of words is a multiple of three it has no score line, so the score before stays in force, from
    pair to pair and file to file.
    """
    tree = F.when(F.size("e") > 20, F.lit("(TOP SentenceNotParsed)")).otherwise(F.concat(F.lit("(TOP "), F.col("e_tree"), F.lit(")")))
    score = F.when(F.size("f") == 0, F.lit("PROB 0 0 0")).when(F.size("e") % 3 > 0, F.lit("PROB 12 -3.5 0")).otherwise(F.lit("TIME 1"))
    lines = pairs(spark, sf).select("pair_id", F.posexplode(F.array(score, tree, F.lit("TIME 0"))).alias("n", "line"))
    return text.parse_filter(text.parser_lines(lines), "pair_id", "n").select("pair_id", "line")


@query("SELECT pair_id, '<s> ' || upper(replace(array_to_string(e_words, ' '), 'ß', 'ss')) || ' </s>' AS line FROM wp")
def lm_text(spark, sf):
    return words(spark, sf).select("pair_id", text.lm_text(F.concat(F.array_join("e_words", " "), F.lit(" ."))).alias("line"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT regexp_matches(w, '^[!-/:-@\\[-`{-~]+$')), ' ') AS line FROM conversations", base=False)
def drop_punctuation(spark, sf):
    parts = F.filter(F.split(F.regexp_replace("text", "[ \n]+", " "), " "), lambda w: w != "")
    return conversations(spark, sf).select("conv_id", "turn", F.array_join(text.drop_punctuation(parts), " ").alias("line"))


# Vocabularies and n-grams

@query("SELECT * FROM ve")
def vocab_freq(spark, sf):
    return vocab.vocabulary(words(spark, sf), "e_words")


@query("SELECT word, freq FROM ve ORDER BY freq DESC, word LIMIT 100")
def vocab_top_k(spark, sf):
    return vocab.top_vocabulary(vocab.vocabulary(words(spark, sf), "e_words"), 100)


@query("SELECT pair_id, array_to_string(list_transform(f, lambda x: CASE WHEN x <= 50 THEN x ELSE 1 END), ' ') AS ids FROM pairs")
def integerize_unk(spark, sf):
    w = words(spark, sf)
    out = vocab.integerize(w, "pair_id", "f_words", vocab.vocabulary(w, "f_words"), "f", max_id=50)
    return out.select("pair_id", F.array_join(F.col("f").cast("array<string>"), " ").alias("ids"))


@query("SELECT least(min(id) FILTER (freq = 1), 65500) AS max_id FROM ve")
def singleton_cutoff(spark, sf):
    return vocab.singleton_cutoff(vocab.vocabulary(words(spark, sf), "e_words"))


@query("SELECT CAST(row_number() OVER (ORDER BY freq DESC, sym) AS INT) AS id, sym, freq FROM (SELECT CAST(symbol AS VARCHAR) AS sym, count(*) AS freq FROM nodes GROUP BY 1)")
def symbol_table(spark, sf):
    return vocab.symbol_table(_nodes(spark, sf).select(F.col("symbol").cast("string").alias("symbol")))


@query("SELECT pair_id, node_id, CASE symbol WHEN 4 THEN 'C' WHEN 5 THEN 'B' ELSE CAST(symbol AS VARCHAR) END AS symbol FROM nodes")
def symbol_convert(spark, sf):
    table = spark.createDataFrame([(1, "4", "A"), (2, "5", "B"), (3, "A", "C"), (4, "4", "Z")], "n int, source string, target string")
    rows = _nodes(spark, sf).select("pair_id", "node_id", F.col("symbol").cast("string").alias("symbol"))
    return vocab.convert(rows, "symbol", table, order="n")


@query("SELECT word AS w1, count(*) AS cnt FROM (SELECT word FROM we UNION ALL SELECT unnest(['<s>', '</s>']) FROM wp) GROUP BY 1")
def unigram_freq(spark, sf):
    return vocab.ngrams(words(spark, sf), "e_words", 1)


NGRAMS = "SELECT {cols}, count(*) AS cnt FROM (SELECT s, unnest(range(1, len(s) - {n} + 2)) AS i FROM (SELECT list_concat(['<s>'], e_words, ['</s>']) AS s FROM wp)) GROUP BY ALL"
BIGRAMS = NGRAMS.format(cols="s[i] AS w1, s[i + 1] AS w2", n=2)
TRIGRAMS = NGRAMS.format(cols="s[i] AS w1, s[i + 1] AS w2, s[i + 2] AS w3", n=3)


@query(BIGRAMS)
def bigram_counts(spark, sf):
    return vocab.ngrams(words(spark, sf), "e_words", 2)


@query(TRIGRAMS)
def trigram_counts(spark, sf):
    return vocab.ngrams(words(spark, sf), "e_words", 3)


@query(f"SELECT w1, w2, w3, cnt, round(cnt / sum(cnt) OVER (PARTITION BY w1, w2), 9) AS p FROM ({TRIGRAMS})")
def trigram_mle(spark, sf):
    return vocab.mle(vocab.ngrams(words(spark, sf), "e_words", 3), 3).withColumn("p", F.round("p", 9))


# Trees and corpora

@query("SELECT * FROM nodes")
def tree_nodes(spark, sf):
    return _nodes(spark, sf)


@query("SELECT pair_id, node_id, epos, elen, array_to_string(e[epos + 1:epos + elen], ' ') AS e FROM nodes JOIN pairs USING (pair_id)")
def tree_spans(spark, sf):
    rows = trees.with_nodes(pairs(spark, sf)).select("pair_id", trees.words_of(F.col("nodes")).cast("array<string>").alias("w"), "nodes").select("pair_id", "w", F.inline("nodes"))
    return rows.select("pair_id", "node_id", "epos", "elen", F.array_join(F.slice("w", F.col("epos") + 1, F.col("elen")), " ").alias("e"))


@query("SELECT pair_id, node_id, numc, rule FROM rules")
def tree_rules(spark, sf):
    return _rules(spark, sf)


@query("SELECT rule, numc, count(*) AS freq FROM rules GROUP BY ALL")
def rule_freq(spark, sf):
    return corpus.rule_frequencies(pairs(spark, sf))


@query("SELECT numc, count(DISTINCT rule) AS rules FROM rules GROUP BY numc")
def distinct_rules_by_arity(spark, sf):
    return _rules(spark, sf).groupBy("numc").agg(F.count_distinct("rule").alias("rules"))


@query("SELECT max_children, count(*) AS sentences FROM (SELECT greatest(max(numc), 1) AS max_children FROM nodes GROUP BY pair_id) GROUP BY 1")
def max_children_hist(spark, sf):
    return corpus.children_histogram(pairs(spark, sf))


@query("SELECT numc, count(*) AS n FROM nodes WHERE NOT is_leaf GROUP BY numc")
def children_per_node(spark, sf):
    return _nodes(spark, sf).filter("NOT is_leaf").groupBy("numc").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pair_id, e_tree FROM (SELECT pair_id, max(numc) AS m FROM nodes GROUP BY pair_id) JOIN pairs USING (pair_id) WHERE m <= 2")
def limit_children(spark, sf):
    rows = trees.with_nodes(pairs(spark, sf)).filter(trees.max_children(F.col("nodes"), leaf=0) <= 2)
    return rows.select("pair_id", "e_tree")


@query("""SELECT pair_id, n_unk, array_to_string(list_transform(f, lambda x: CASE WHEN x > 200 THEN 1 ELSE x END), ' ') AS f
          FROM pairs JOIN (SELECT pair_id, CAST(count(*) FILTER (id > 200 OR id = 1) AS INT) AS n_unk FROM tok GROUP BY pair_id) USING (pair_id) WHERE len(f) < 30
          AND pair_id IN (SELECT pair_id FROM nodes GROUP BY pair_id HAVING max(numc) <= 3)""")
def corpus_filter(spark, sf):
    out = corpus.corpus_filter(pairs(spark, sf), max_children=3, max_id=200)
    heads = trees.words_of(trees.node_array(F.col("e_tree")))
    return out.select("pair_id", F.size(F.filter(heads, lambda h: h == 1)).alias("n_unk"), F.array_join(F.col("f").cast("array<string>"), " ").alias("f"))


@query("SELECT pair_id, CASE WHEN (row_number() OVER (ORDER BY pair_id) - 1) % 100 = 0 THEN 'test' ELSE 'train' END AS split FROM pairs")
def train_test_split(spark, sf):
    return corpus.split(pairs(spark, sf).select("pair_id"))


@query("SELECT pair_id, e_tree FROM pairs ORDER BY pair_id LIMIT 100")
def align_sample(spark, sf):
    return corpus.align_sample(pairs(spark, sf)).select("pair_id", "e_tree")


@query(f"SELECT x AS elen, {LOW} AS min_f, {HIGH} AS max_f, {lengths.CHINESE_BAND.sql('x')[0]} AS min_zh, {lengths.CHINESE_BAND.sql('x')[1]} AS max_zh FROM range(1, 41) t(x)", base=False)
def length_band(spark, sf):
    rows = spark.range(1, 41).select(F.col("id").alias("elen"))
    (a, b), (c, d) = lengths.DEFAULT_BAND.columns(F.col("elen")), lengths.CHINESE_BAND.columns(F.col("elen"))
    return rows.select("elen", a.alias("min_f"), b.alias("max_f"), c.alias("min_zh"), d.alias("max_zh"))


@query("SELECT * FROM cooc")
def cooccurrence(spark, sf):
    return _cooc(spark, sf)


@query("SELECT * FROM cut")
def phrase_cutoff(spark, sf):
    return corpus.phrase_cutoff(_cooc(spark, sf))


@query("SELECT CAST(string_split(e, ' ')[1] AS INT) % 20 AS shard, count(*) AS entries, CAST(sum(cnt) AS BIGINT) AS cnt FROM cooc GROUP BY 1")
def shard_balance(spark, sf):
    return _cooc(spark, sf).groupBy(corpus.shard().alias("shard")).agg(F.count(F.lit(1)).alias("entries"), F.sum("cnt").alias("cnt"))


@query("SELECT pair_id, e_tree, array_to_string(f, ' ') AS f FROM pairs")
def bxi_lines(spark, sf):
    """Records written as three lines and read back from numbered lines."""
    f = F.array_join(F.col("f").cast("array<string>"), " ")
    lines = pairs(spark, sf).select("pair_id", F.posexplode(F.array(F.col("e_tree"), f, F.lit(""))).alias("n", "line"))
    return formats.bxi_from_lines(lines, file="pair_id").select("pair_id", "e_tree", F.array_join(F.col("f").cast("array<string>"), " ").alias("f"))


@query("SELECT pair_id, e_tree, f_words[1] AS first FROM pairs JOIN wp USING (pair_id) WHERE len(e) <= 20")
def join_parses(spark, sf):
    w = words(spark, sf)
    parses = corpus.bxi(w).select(F.col("pair_id").alias("sent_id"), "e_tree", (F.size("e") <= 20).alias("parse_ok"))
    foreign = w.select(F.col("pair_id").alias("sent_id"), F.col("f_words").alias("f"))
    return corpus.join_parses(parses, foreign).select(F.col("sent_id").alias("pair_id"), "e_tree", F.get("f", F.lit(0)).alias("first"))


@query("SELECT pair_id, e_tree FROM pairs")
def tree_serialize(spark, sf):
    """Trees read to nodes and written back."""
    return trees.with_nodes(pairs(spark, sf)).select("pair_id", trees.to_text(F.col("nodes")).alias("e_tree"))


# Parameters

@query("SELECT CAST(id AS VARCHAR) AS word, round(1.0::DOUBLE / count(*) OVER (), 9) AS prob FROM vf")
def insword_uniform(spark, sf):
    return params.insword_uniform(vocab.vocabulary(words(spark, sf), "f_words")).withColumn("prob", F.round("prob", 9))


@query("""SELECT rule || '|' || pos AS ctx, ins, round(1 / 3.0::DOUBLE, 9) AS prob FROM (SELECT DISTINCT rule, numc FROM rules UNION SELECT DISTINCT '0 ' || string_split(rule, ' ')[1], 1 FROM rules),
          LATERAL (SELECT unnest(range(0, numc)) AS pos), LATERAL (SELECT unnest([0, 1, 2]) AS ins)""")
def n_uniform(spark, sf):
    return params.n_uniform(_rules(spark, sf).select("rule", "numc").distinct()).withColumn("prob", F.round("prob", 9))


@query("SELECT cooc.e, cooc.f, CASE WHEN NOT contains(cooc.e, ' ') AND NOT contains(cooc.f, ' ') AND cut.e IS NOT NULL THEN round(1.0::DOUBLE / n, 9) ELSE 0 END AS prob FROM cooc LEFT JOIN (SELECT e, f, 1 + count(*) OVER (PARTITION BY e) AS n FROM cut) cut ON cut.e = cooc.e AND cut.f = cooc.f")
def t_lookup_single_words(spark, sf):
    counts = em.checkpointed(_cooc(spark, sf))  # read twice
    return params.t_lookup(counts.select("e", "f"), params.t_uniform(corpus.phrase_cutoff(counts)), single_words=True).withColumn("prob", F.round("prob", 9))


@query("SELECT pair_id, node_id, perm, CASE WHEN perm = 0 OR numc = 4 THEN round(1 / 24.0::DOUBLE, 9) ELSE 0 END AS prob FROM (SELECT pair_id, node_id, numc, unnest([0, 9]) AS perm FROM rules) UNION ALL SELECT pair_id, node_id, 0, 1 FROM nodes WHERE is_leaf")
def r_lookup(spark, sf):
    """Trees are read once; each node is written with its rule (a leaf: none), and the table of rules by itself."""
    read = trees.with_nodes(pairs(spark, sf)).select("pair_id", "nodes").withColumn("rules", trees.rule_array(F.col("nodes")))
    inner = F.transform("rules", lambda x: F.struct(x["node_id"].alias("node_id"), x["rule"].alias("rule"), x["numc"].alias("numc"), F.lit(False).alias("is_leaf")))
    leaf = F.transform(F.filter("nodes", lambda x: x["is_leaf"]), lambda x: F.struct(x["node_id"].alias("node_id"), F.lit("").alias("rule"), F.lit(0).alias("numc"), F.lit(True).alias("is_leaf")))
    nodes = em.checkpointed(read.select("pair_id", F.inline(F.concat(inner, leaf))))
    table = em.checkpointed(params.r_uniform(nodes.filter("NOT is_leaf").select("rule", "numc").distinct()))
    perms = F.when(F.col("is_leaf"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(9)))
    keys = nodes.select("pair_id", "node_id", "rule", F.explode(perms).alias("perm"), "is_leaf")
    return params.r_lookup(keys, table).select("pair_id", "node_id", "perm", F.round("prob", 9).alias("prob"))


@query("SELECT e, f, round(1.0::DOUBLE / count(*) OVER (PARTITION BY e), 9) AS prob FROM (SELECT e, f FROM cut UNION ALL SELECT DISTINCT e, '0' FROM cut)")
def t_init_uniform(spark, sf):
    return params.t_uniform(corpus.phrase_cutoff(_cooc(spark, sf))).withColumn("prob", F.round("prob", 9))


@query("""SELECT cooc.e, cooc.f, CASE WHEN (contains(cooc.e, ' ') OR contains(cooc.f, ' ')) AND cut.e IS NULL THEN 0.0::DOUBLE
          ELSE round(power(0.1::DOUBLE, 1 + len(string_split(cooc.f, ' '))), 9) END AS prob FROM cooc LEFT JOIN cut ON cut.e = cooc.e AND cut.f = cooc.f""")
def t_lookup_equal_prob(spark, sf):
    """The phrase table is the part of the counts that passes the cutoff, so each row knows whether it is in it: no join."""
    prob = params.t_equal(corpus.in_cutoff(), cutoff=True, fertility=True)
    return _cooc(spark, sf).select("e", "f", F.round(prob, 9).alias("prob"))


@query("SELECT e, f, round(cnt / sum(cnt) OVER (PARTITION BY e), 9) AS prob FROM cooc")
def t_normalize(spark, sf):
    return params.normalize(em.checkpointed(_cooc(spark, sf)), ["e"]).withColumn("prob", F.round("prob", 9))  # read twice


def _fert(cooc: DataFrame) -> DataFrame:
    counts = cooc.groupBy("e", params.words_in(F.col("f")).alias("n")).agg(F.sum("cnt").cast("double").alias("cnt"))
    return params.normalize(em.checkpointed(counts), ["e"])  # read twice


def _t_words(cooc: DataFrame) -> DataFrame:
    counts = cooc.select("e", F.explode(F.split("f", " ")).alias("f"), "cnt").groupBy("e", "f").agg(F.sum("cnt").cast("double").alias("cnt"))
    return params.normalize(counts, ["e"])


FERT = "fert AS (SELECT e, n, cnt / sum(cnt) OVER (PARTITION BY e) AS prob FROM (SELECT e, CAST(len(string_split(f, ' ')) AS INT) AS n, sum(cnt)::DOUBLE AS cnt FROM cooc GROUP BY 1, 2))"
T_WORDS = "tw AS (SELECT e, w, cnt / sum(cnt) OVER (PARTITION BY e) AS prob FROM (SELECT e, w, sum(cnt)::DOUBLE AS cnt FROM (SELECT e, unnest(string_split(f, ' ')) AS w, cnt FROM cooc) GROUP BY 1, 2))"


@query(f", {FERT} SELECT e, n, round(prob, 9) AS prob FROM fert")
def fertility_normalize(spark, sf):
    return _fert(_cooc(spark, sf)).withColumn("prob", F.round("prob", 9))


@query(f""", {FERT}, {T_WORDS},
x AS (SELECT e, f, unnest(string_split(f, ' ')) AS w, len(string_split(f, ' ')) AS n FROM cooc),
p AS (SELECT e, f, any_value(n) AS n, product(tw.prob) AS p FROM x JOIN tw USING (e, w) GROUP BY e, f)
SELECT p.e, p.f, round(p.p * fert.prob + 1e-12, 9) AS prob FROM p JOIN fert ON fert.e = p.e AND fert.n = p.n""")
def fertility_prob(spark, sf):
    cooc = em.checkpointed(_cooc(spark, sf))  # read three times
    return params.fertility_prob(cooc.select("e", "f"), _t_words(cooc), _fert(cooc), ["e", "f"]).withColumn("prob", F.round(F.col("prob") + 1e-12, 9))  # exact halves round up, whatever the order of factors


@query("SELECT e, round(sum(cnt) FILTER (cnt > 1) / sum(cnt), 9) AS prob FROM cooc WHERE contains(e, ' ') GROUP BY e HAVING sum(cnt) FILTER (cnt > 1) IS NOT NULL UNION ALL SELECT e, 0.0::DOUBLE FROM cooc WHERE contains(e, ' ') GROUP BY e HAVING sum(cnt) FILTER (cnt > 1) IS NULL")
def lambda1_normalize(spark, sf):
    counts = _cooc(spark, sf).filter(F.col("e").contains(" "))
    both = counts.groupBy("e").agg(F.sum(F.when(F.col("cnt") > 1, F.col("cnt")).otherwise(0)).cast("double").alias("cnt"), F.sum(F.when(F.col("cnt") <= 1, F.col("cnt")).otherwise(0)).cast("double").alias("ncnt"))
    return params.lambda1_update(None, both).select("e", F.round("prob", 9).alias("prob"))


@query("""SELECT rule, perm, round(1 / 24.0::DOUBLE, 9) AS prob FROM (SELECT DISTINCT rule, numc FROM rules UNION SELECT DISTINCT '0 ' || string_split(rule, ' ')[1], 1 FROM rules),
          LATERAL (SELECT CAST(unnest(range(0, [1, 2, 6, 24][numc])) AS INT) AS perm)""")
def r_uniform(spark, sf):
    return params.r_uniform(_rules(spark, sf).select("rule", "numc").distinct()).withColumn("prob", F.round("prob", 9))


@query("SELECT rule, perm, round(cnt / sum(cnt) OVER (PARTITION BY rule), 9) AS prob FROM (SELECT rule, node_id % [1, 2, 6, 24][numc] AS perm, count(*)::DOUBLE AS cnt FROM rules GROUP BY ALL)")
def r_normalize(spark, sf):
    size = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(6), F.lit(24)), F.col("numc"))
    counts = _rules(spark, sf).groupBy("rule", (F.col("node_id") % size).alias("perm")).agg(F.count(F.lit(1)).cast("double").alias("cnt"))
    return params.normalize(counts, ["rule"]).withColumn("prob", F.round("prob", 9))


def _insertions(spark, sf) -> DataFrame:
    """Pseudo counts (ctx, ins, word, cnt): the words of a pair at each of its rules. Written once.

    Rules and words meet inside the pair's row, where equal rules are one with their number.
    """
    word = lambda w, j: F.struct((j % 3).alias("ins"), F.when(j % 3 == 0, F.lit("0")).otherwise(w.cast("string")).alias("word"))
    rows = trees.with_nodes(pairs(spark, sf)).select("f", trees.rule_array(F.col("nodes")).alias("rules")).select("f", F.transform("rules", lambda x: x["rule"]).alias("rules"))
    own = F.transform(F.array_distinct("rules"), lambda r: F.struct(F.concat(r, F.lit("|0")).alias("ctx"), F.size(F.filter("rules", lambda x: x == r)).alias("times")))
    made = rows.select("f", F.inline(own)).select("ctx", "times", F.inline(F.transform("f", word)))
    return em.checkpointed(made.groupBy("ctx", "ins", "word").agg(F.sum("times").cast("double").alias("cnt")))


INS = "ins AS (SELECT rule || '|0' AS ctx, j % 3 AS ins, CASE WHEN j % 3 = 0 THEN '0' ELSE CAST(id AS VARCHAR) END AS word, count(*)::DOUBLE AS cnt FROM rules JOIN tokf USING (pair_id) GROUP BY ALL)"


@query(f", {INS} SELECT ctx, ins, word, round(cnt / sum(cnt) OVER (PARTITION BY ctx), 9) AS prob FROM ins")
def n_full_normalize(spark, sf):
    return params.normalize(_insertions(spark, sf), ["ctx"]).withColumn("prob", F.round("prob", 9))


@query(f""", {INS}, side AS (SELECT ctx, ins, cnt / sum(cnt) OVER (PARTITION BY ctx) AS s FROM (SELECT ctx, ins, sum(cnt) AS cnt FROM ins GROUP BY ALL)),
w AS (SELECT word, cnt / sum(cnt) OVER () AS p FROM (SELECT word, sum(cnt) AS cnt FROM ins WHERE ins > 0 GROUP BY ALL))
SELECT ctx, ins, word, round(s * CASE WHEN ins = 0 THEN 1 ELSE coalesce(p, 0) END, 9) AS prob FROM ins JOIN side USING (ctx, ins) LEFT JOIN w USING (word)""")
def n_shared_prob(spark, sf):
    ins = _insertions(spark, sf)
    sides = params.normalize(ins.groupBy("ctx", "ins").agg(F.sum("cnt").alias("cnt")), ["ctx"])
    counts = ins.filter("ins > 0").groupBy("word").agg(F.sum("cnt").alias("cnt"))
    total = F.broadcast(counts.agg(F.sum("cnt").alias("total")))  # one row
    insword = counts.crossJoin(total).select("word", (F.col("cnt") / F.col("total")).alias("prob"))
    return params.n_lookup_shared(ins.select("ctx", "ins", "word"), sides, insword).withColumn("prob", F.round("prob", 9))


@query("SELECT pair_id, node_id, '9999' || substr(rule, strpos(rule, ' ')) AS old_rule, string_split(rule, ' ')[1] || ' ' || string_split(rule, ' ')[2] AS old_ctx FROM rules")
def rule_key_oldmode(spark, sf):
    r = F.col("rule")
    return _rules(spark, sf).select("pair_id", "node_id", params.rule_key_old(r).alias("old_rule"), params.n_context_old(r, F.lit(0)).alias("old_ctx"))


@query(f"SELECT pair_id, n <= 40 AND len(f) <= 29 AND len(f) > 0 AND len(e) <= 19 AND len(f) <= (SELECT high FROM band WHERE elen = len(e)) AS ok FROM pairs JOIN (SELECT pair_id, count(*) AS n FROM nodes GROUP BY pair_id) USING (pair_id)")
def sentence_ok(spark, sf):
    rows = trees.with_nodes(pairs(spark, sf))
    n_e = F.size(trees.words_of(F.col("nodes")))
    return rows.select("pair_id", lengths.sentence_ok(F.size("nodes"), n_e, F.size("f"), lengths.DEFAULT_BAND.columns(n_e)[1]).alias("ok"))


EQUAL = em.Config(iterations=2, chinese=False, cutoff=False, fertility=False, lambda1=0.0, shared_words=True, old_rules=False)


def _inside(rows: DataFrame, config: em.Config) -> DataFrame:
    """(pair_id, n_e, prob) of the pairs that fit the chart, at equal probabilities."""
    data, keys = em.prepare(rows, config)
    model = em.Model(config)
    found = em.events(em.gathered(data, keys, model), model, 0.0, False)
    return found.select("pair_id", F.col("i").alias("n_e"), F.col("cnt").alias("prob"))


# At 0.1 everywhere a pair's probability depends on its two lengths alone. b, c: a leaf's and a chunk's sums by foreign length;
# cn: of several chunks; g1, g2, g3: of a run of chunks that holds no, one or two further runs; a sentence is the outermost.
INSIDE = """, most AS (SELECT x AS w, CAST(trunc(1.4::DOUBLE * x + 2.001::DOUBLE) AS INT) AS most FROM range(1, 21) t(x)),
l0 AS (SELECT x AS l FROM range(0, 61) t(x)),
b(l, p) AS (VALUES (0, 0.01::DOUBLE), (1, 0.01), (2, 0.03), (3, 0.03)),
bb AS (SELECT b1.l + b2.l AS l, sum(b1.p * b2.p) AS p FROM b b1, b b2 GROUP BY 1),
c AS (SELECT m.l, 0.1 * 0.2 * coalesce(x.p, 0) + 0.2 * 0.2 * coalesce(y.p, 0) AS p FROM l0 m LEFT JOIN bb x ON x.l = m.l LEFT JOIN bb y ON y.l = m.l - 1 WHERE m.l <= 4),
c2 AS (SELECT x.l + y.l AS l, sum(x.p * y.p) AS p FROM c x, c y GROUP BY 1),
c3 AS (SELECT x.l + y.l AS l, sum(x.p * y.p) AS p FROM c2 x, c y GROUP BY 1),
c4 AS (SELECT x.l + y.l AS l, sum(x.p * y.p) AS p FROM c3 x, c y GROUP BY 1),
cn AS (SELECT 0 AS n, 0 AS l, 1.0::DOUBLE AS p UNION ALL SELECT 1, * FROM c UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3 UNION ALL SELECT 4, * FROM c4),
bn AS (SELECT 0 AS n, 0 AS l, 1.0::DOUBLE AS p UNION ALL SELECT 1, * FROM b),
k1 AS (SELECT w, cn.l + bn.l AS l, sum(cn.p * bn.p) * 0.1 * [1, 2, 6, 24][CAST((w + 1) // 2 AS INT)] AS p FROM most JOIN cn ON cn.n = w // 2 JOIN bn ON bn.n = w % 2 WHERE w BETWEEN 2 AND 8 GROUP BY w, 2),
g1 AS (SELECT w, m.l, 0.1 * coalesce(x.p, 0) + 0.2 * coalesce(y.p, 0) AS p FROM most CROSS JOIN l0 m LEFT JOIN k1 x USING (w, l) LEFT JOIN k1 y ON y.w = most.w AND y.l = m.l - 1 WHERE w BETWEEN 2 AND 8 AND m.l <= most),
k2 AS (SELECT g1.w + 6 AS w, c3.l + g1.l AS l, sum(c3.p * g1.p) * 0.1 * 24 AS p FROM g1, c3 WHERE g1.w >= 3 GROUP BY 1, 2),
g2 AS (SELECT w, m.l, 0.1 * coalesce(x.p, 0) + 0.2 * coalesce(y.p, 0) AS p FROM most CROSS JOIN l0 m LEFT JOIN k2 x USING (w, l) LEFT JOIN k2 y ON y.w = most.w AND y.l = m.l - 1 WHERE w BETWEEN 9 AND 14 AND m.l <= most),
k3 AS (SELECT g2.w + 6 AS w, c3.l + g2.l AS l, sum(c3.p * g2.p) * 0.1 * 24 AS p FROM g2, c3 GROUP BY 1, 2),
g3 AS (SELECT w, m.l, 0.1 * coalesce(x.p, 0) + 0.2 * coalesce(y.p, 0) AS p FROM most CROSS JOIN l0 m LEFT JOIN k3 x USING (w, l) LEFT JOIN k3 y ON y.w = most.w AND y.l = m.l - 1 WHERE w BETWEEN 15 AND 19 AND m.l <= most),
inside AS (SELECT 1 AS w, * FROM b UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3),
probs AS (SELECT pair_id, CAST(len(e) AS INT) AS n_e, p FROM pairs JOIN most ON most.w = len(e) AND len(f) BETWEEN 1 AND least(most.most, 29) JOIN inside ON inside.w = len(e) AND inside.l = len(f) WHERE len(e) <= 19)
"""


@query(INSIDE + "SELECT pair_id, n_e, round(log2(p), 9) AS log2 FROM probs")
def inside_probabilities(spark, sf):
    """Of every pair that fits the chart's limits: log2 of its probability at equal probabilities."""
    return _inside(pairs(spark, sf), EQUAL).select("pair_id", "n_e", F.round(F.log2("prob"), 9).alias("log2"))


@query(INSIDE + "SELECT count(*) AS pairs, 0 AS zero, CAST(sum(n_e) AS BIGINT) AS e_words, round(sum(log2(p)), 4) AS log2, round(power(2, -sum(log2(p)) / sum(n_e)), 4) AS perplexity FROM probs")
def perplexity(spark, sf):
    """Of the model at equal probabilities, over all pairs that fit."""
    out = em.perplexity(_inside(pairs(spark, sf), EQUAL))
    return out.select("pairs", F.col("zero").cast("int").alias("zero"), "e_words", F.round("log2", 4).alias("log2"), F.round("perplexity", 4).alias("perplexity"))


# Formats: each written as text to the shared folder and read back.

@query("SELECT row_number() OVER (ORDER BY pair_id) AS record, e_tree, array_to_string(f, ' ') AS f FROM pairs")
def source_bxi(spark, sf):
    """Numbers follow the order of the written corpus, over files and byte ranges."""
    path = tables.place(spark, "bxi")
    formats.write_bxi(pairs(spark, sf), path)
    rows = ranking.global_rank(formats.read_bxi(spark, path), "file", "n", out="record")
    return rows.select("record", "e_tree", F.array_join(F.col("f").cast("array<string>"), " ").alias("f"))


@query("SELECT * FROM cut")
def source_cutoffs(spark, sf):
    path = tables.place(spark, "cutoffs")
    formats.write_cutoffs(corpus.phrase_cutoff(_cooc(spark, sf)), path)
    return formats.read_cutoffs(spark, path)


@query("SELECT * FROM ve")
def source_vocabulary(spark, sf):
    path = tables.place(spark, "vocabulary")
    formats.write_listed(vocab.vocabulary(words(spark, sf), "e_words"), path, "id", "word", "freq")
    return formats.read_vocabulary(spark, path)


@query(f""", {FERT}, lam AS (SELECT e, sum(cnt) FILTER (cnt > 1) / sum(cnt) AS prob FROM cooc WHERE contains(e, ' ') GROUP BY e)
SELECT 't' AS kind, e, f, NULL::INT AS n, round(cnt / sum(cnt) OVER (PARTITION BY e), 9) AS prob FROM cooc
UNION ALL SELECT 'fert', e, NULL, n, round(coalesce(prob, 0), 9) FROM (SELECT e, CAST(unnest(range(0, max(n) + 1)) AS INT) AS n FROM fert GROUP BY e) LEFT JOIN fert USING (e, n)
UNION ALL SELECT 'lambda1', e, NULL, NULL, round(prob, 9) FROM lam WHERE prob > 0""")
def source_ttable(spark, sf):
    cooc = em.checkpointed(_cooc(spark, sf))  # read three times
    counts = cooc.filter(F.col("e").contains(" ")).groupBy("e").agg(F.sum(F.when(F.col("cnt") > 1, F.col("cnt")).otherwise(0)).cast("double").alias("cnt"), F.sum(F.when(F.col("cnt") <= 1, F.col("cnt")).otherwise(0)).cast("double").alias("ncnt"))
    path = tables.place(spark, "ttable")
    formats.write_ttable(params.normalize(cooc, ["e"]), _fert(cooc), params.lambda1_update(None, counts), path)
    return formats.read_ttable(spark, path).withColumn("prob", F.round("prob", 9))


@query("""SELECT 'r' AS kind, rule, CAST(perm AS INT) AS i, NULL::INT AS ins, NULL::VARCHAR AS word, round(1 / [1, 2, 6, 24][numc]::DOUBLE, 9) AS prob FROM (SELECT DISTINCT rule, numc FROM rules), LATERAL (SELECT unnest(range(0, [1, 2, 6, 24][numc])) AS perm)
UNION ALL SELECT 'n', rule, 0, ins, '0', round(cnt / sum(cnt) OVER (PARTITION BY rule), 9) FROM (SELECT rule, CAST(node_id % 3 AS INT) AS ins, count(*)::DOUBLE AS cnt FROM rules GROUP BY ALL)
UNION ALL SELECT 'insword', NULL, NULL, NULL, CAST(id AS VARCHAR), round(freq / sum(freq) OVER (), 9) FROM vf""")
def source_rntable(spark, sf):
    side = (F.col("node_id") % 3).alias("ins")
    rule = em.checkpointed(_rules(spark, sf).groupBy("rule", "numc", side).agg(F.count(F.lit(1)).cast("double").alias("cnt")))  # read twice
    size = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(6), F.lit(24)), F.col("numc"))
    perms = rule.select("rule", "numc").distinct().select("rule", F.explode(F.sequence(F.lit(0), size - 1)).alias("perm"), F.lit(1.0).alias("cnt"))
    sides = rule.select(F.concat("rule", F.lit("|0")).alias("ctx"), "ins", "cnt")
    freq = vocab.vocabulary(words(spark, sf), "f_words").select(F.col("id").cast("string").alias("word"), F.col("freq").alias("cnt"), F.lit(0).alias("all"))
    path = tables.place(spark, "rntable")
    formats.write_rntable(params.normalize(perms, ["rule"]), params.normalize(sides, ["ctx"]), params.normalize(freq, ["all"]), path)
    return formats.read_rntable(spark, path).withColumn("prob", F.round("prob", 9))


# Expected counts at equal probabilities. All orders of a node weigh the same there, and every derivation orders each inner
# node once, inserts beside each node at most once, translates each leaf once and makes every foreign word once.

def _first_pairs(spark, sf) -> tuple[DataFrame, em.Model, float]:
    """All pairs that fit, for the first E-step."""
    rows, keys = em.prepare(corpus.bxi(em.checkpointed(words(spark, sf))), EQUAL)  # words are read by both vocabularies and their ids
    model = em.Model(EQUAL)
    return em.gathered(rows, keys, model), model, 0.0


@query(INSIDE + """SELECT rule, CAST(perm AS INT) AS perm, round(cnt / [1, 2, 6, 24][numc]::DOUBLE, 6) AS cnt FROM (SELECT rule, numc, count(*) AS cnt FROM rules JOIN probs USING (pair_id) GROUP BY ALL),
          LATERAL (SELECT unnest(range(0, [1, 2, 6, 24][numc])) AS perm)""")
def expected_order_counts(spark, sf):
    return em.order_counts(*_first_pairs(spark, sf)).withColumn("cnt", F.round("cnt", 6))


@query(INSIDE + """SELECT pair_id, round(count(*) FILTER (NOT is_leaf), 6)::DOUBLE AS orders, round(count(*), 6)::DOUBLE AS insertions, round(any_value(n_e), 6)::DOUBLE AS translations, round(any_value(n_f), 6)::DOUBLE AS foreign_words
FROM nodes JOIN probs USING (pair_id) JOIN (SELECT pair_id, len(f) AS n_f FROM pairs) USING (pair_id) GROUP BY pair_id""")
def expected_count_totals(spark, sf):
    """Expected counts of each pair: orders, insertions (none, right or left), translations, foreign words made by either."""
    made = em.count_totals(*_first_pairs(spark, sf))
    return made.select("pair_id", *[F.round(x, 6).alias(x) for x in ("orders", "insertions", "translations", "foreign_words")])


# Reports

@query("SELECT e, f, cnt AS n FROM cooc WHERE cnt > 1")
def report_uniq_count(spark, sf):
    return reports.uniq_count(corpus.spans(prepared(spark, sf)), ["e", "f"]).filter("n > 1")


@query("SELECT line, n FROM (SELECT rule AS line, count(*) AS n FROM rules WHERE numc = 2 GROUP BY rule) ORDER BY n DESC, line LIMIT 10")
def report_top_rules(spark, sf):
    return reports.top_lines(_rules(spark, sf).filter("numc = 2").select(F.col("rule").alias("line")))


@query("SELECT pair_id, node_id, CASE symbol WHEN 2 THEN '.TOP.' WHEN 3 THEN '.X.' WHEN 4 THEN 'NP.A' WHEN 5 THEN 'V^P' ELSE CAST(symbol AS VARCHAR) END AS symbol FROM nodes")
def decoder_symbols(spark, sf):
    name = F.when(F.col("symbol") == 2, "TOP").when(F.col("symbol") == 3, "X").when(F.col("symbol") == 4, "NP-A").when(F.col("symbol") == 5, "V_P").otherwise(F.col("symbol").cast("string"))
    return _nodes(spark, sf).select("pair_id", "node_id", reports.decoder_symbol(name).alias("symbol"))


@query("SELECT pair_id, 'E' AS side, array_to_string(e_words, ' ') AS line FROM wp UNION ALL SELECT pair_id, 'F', array_to_string(f_words, ' ') FROM wp")
def report_sentences(spark, sf):
    w = words(spark, sf)
    return reports.sentences(corpus.bxi(w), vocab.vocabulary(w, "e_words"), vocab.vocabulary(w, "f_words"))


# Tree edits on string labels. The trees have one shape for each length, so SQL can say what an edit leaves.

def _labelled(spark, sf) -> DataFrame:
    """(TOP~w1~1~1 (VP~w1~1~1 w1/VB w2/VB-A ... ./PUNC)): head first, a closing mark last."""
    w = F.col("e_words")
    first = F.get(w, F.lit(0))
    leaves = F.array_join(F.transform(w, lambda x: F.concat(x, F.lit("/NN"))), " ")
    return words(spark, sf).select("pair_id", F.concat(F.lit("(TOP~"), first, F.lit("~1~1 (VP~"), first, F.lit("~2~1 "), leaves, F.lit(" ./PUNC.)) ")).alias("tree"))


PUNCT = (("PUNC.", "PUNC"), ("PUNC,", "PUNC"), ("PUNC:", "PUNC"))


@query("SELECT pair_id, '(' || e_words[1] || '/TOP (' || e_words[1] || '/VP ' || array_to_string(e_words, '/NN ') || '/NN))' AS tree FROM wp")
def tree_rmpunc(spark, sf):
    return _labelled(spark, sf).select("pair_id", transforms.edit(F.col("tree"), transforms.Edits(("conv", "rmpunc"), PUNCT)).alias("tree"))


@query("SELECT pair_id, '(' || e_words[1] || '/TOP ' || array_to_string(e_words, '/NN ') || '/NN ./PUNC)' AS tree FROM wp")
def tree_flatten(spark, sf):
    return _labelled(spark, sf).select("pair_id", transforms.edit(F.col("tree"), transforms.Edits(("conv", "flat"), PUNCT)).alias("tree"))


@query("SELECT pair_id, '(TOP (VP ' || array_to_string(list_transform(e_words, lambda w: '(NN ' || translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ')'), ' ') || ' (PUNC .)))' AS tree FROM wp")
def tree_rmhead_lf(spark, sf):
    upper = _labelled(spark, sf).select("pair_id", text.ascii_upper(F.col("tree")).alias("tree"))
    return upper.select("pair_id", transforms.edit(F.col("tree"), transforms.Edits(("conv", "rmhead", "lf"), PUNCT)).alias("tree"))


@query("SELECT pair_id, '(' || e_words[1] || '/TOP (' || e_words[1] || '/VP ' || array_to_string(e_words, '/NN ') || '/NN ./PUNC.))' AS tree FROM wp")
def tree_lower(spark, sf):
    upper = _labelled(spark, sf).select("pair_id", text.ascii_upper(F.col("tree")).alias("tree"))
    return upper.select("pair_id", transforms.edit(F.col("tree"), transforms.Edits(("lower",))).alias("tree"))


@query("SELECT pair_id, unnest(['TOP <= VP ', 'VP <= ' || repeat('NN ', len(e_words)) || 'PUNC ']) AS line FROM wp")
def tree_rule_list(spark, sf):
    return _labelled(spark, sf).select("pair_id", F.explode(transforms.rule_lines(F.col("tree"), transforms.Edits(("conv",), PUNCT))).alias("line"))


@query("SELECT pair_id, '(' || e_words[1] || '/TOP (' || e_words[1] || '/VP ' || array_to_string(e_words, '/NN ') || '/NN ./PUNC))' AS tree, f_words[1] AS first FROM wp WHERE len(e_words) <= 3")
def tree_sentence_filter(spark, sf):
    """Trees with at most four children a node, with their sentences."""
    rows = _labelled(spark, sf).join(words(spark, sf).select("pair_id", F.get("f_words", F.lit(0)).alias("first")), "pair_id")
    return corpus.btx(rows, transforms.Edits(("conv",), PUNCT), 4)


@query("SELECT pair_id, '(seen/VB (he/NPB he/NN) ' || CASE WHEN len(e_words) > 1 THEN array_to_string(e_words[2:], '/NN ') || '/NN ' ELSE '' END || 'seen/VBN)' AS tree FROM wp")
def tree_passive_aux(spark, sf):
    """(VP was (NPB he) (VP-A/VB seen ... )): the passive's inner verb takes over."""
    rest = F.concat_ws(" ", F.transform(F.slice("e_words", F.lit(2), F.size("e_words")), lambda x: F.concat(x, F.lit("/NN"))))
    inner = F.concat(F.lit("(VB~seen~1~1 "), F.when(F.size("e_words") > 1, F.concat(rest, F.lit(" "))).otherwise(""), F.lit("seen/VBN)"))
    tree = F.concat(F.lit("(VP~was~1~1 (NPB~he~1~1 he/NN) "), inner, F.lit(")"))
    return transforms.edited(words(spark, sf).select("pair_id", tree.alias("tree")), "pair_id", "tree", transforms.Edits(("pas", "aux")))


# Parsed sentences: a subject, a verb, its phrase and a mark. The verb (in capitals, as no word is) is a form of be or an auxiliary.

VERB, MARK = "CASE len(e_words) % 2 WHEN 1 THEN 'WAS' ELSE 'WILL' END", "['?', '!', '.'][1 + len(e_words[1]) % 3]"
PARSED = f"""n1 AS (SELECT pair_id, e_words, len(e_words) AS n, e_words[1] AS w, e_words[-1] AS z, {VERB} AS v, {MARK} AS m,
  array_to_string(list_concat(list_transform(e_words[2:len(e_words) - 1], lambda x: x || '/NN'), [e_words[-1] || '/VBN']), ' ') AS rest FROM wp)"""


def _parsed(spark, sf) -> DataFrame:
    """(TOP~V~1~1 (S~V~1~1 (NPB~w~1~1 w/NN) (VP~V~1~1 V/VBD (VP-A~z~1~1 ... z/VBN)) ?/PUNC.)), without VP-A for one word."""
    w, n = F.col("e_words"), F.size("e_words")
    verb = F.when(n % 2 == 1, "WAS").otherwise("WILL")
    mark = F.get(F.array(F.lit("?"), F.lit("!"), F.lit(".")), F.length(F.get(w, F.lit(0))) % 3)
    inner = lambda symbol, head: F.concat(F.lit(f"({symbol}~"), head, F.lit("~1~1 "))
    rest = F.array_join(F.concat(F.transform(F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda x: F.concat(x, F.lit("/NN"))), F.array(F.concat(F.element_at(w, -1), F.lit("/VBN")))), " ")
    phrase = F.when(n > 1, F.concat(F.lit(" "), inner("VP-A", F.element_at(w, -1)), rest, F.lit(")"))).otherwise("")
    first = F.get(w, F.lit(0))
    tree = F.concat(inner("TOP", verb), inner("S", verb), inner("NPB", first), first, F.lit("/NN) "), inner("VP", verb), verb, F.lit("/VBD"), phrase, F.lit(") "), mark, F.lit("/PUNC.))"))
    return words(spark, sf).select("pair_id", tree.alias("tree"))


def _edited(spark, sf, *steps: str, **options) -> DataFrame:
    return transforms.edited(_parsed(spark, sf), "pair_id", "tree", transforms.Edits(steps, PUNCT, **options))


PHRASE = "CASE n WHEN 1 THEN '' {two}ELSE ' (' || z || '/{symbol} ' || rest || ')' END"
FLAT = "SELECT pair_id, '(' || v || '/{top} ' || w || '/NN ' || v || '/VBD' || {phrase} || ' ' || m || '/PUNC)' AS tree FROM n1"
TWO = "WHEN 2 THEN ' ' || z || '/VBN' "


@query(f", {PARSED} " + FLAT.format(top="TOP", phrase=PHRASE.format(two=TWO, symbol="VP-A")))
def tree_flatten_chains(spark, sf):
    return _edited(spark, sf, "conv", "flat")


@query(f", {PARSED} " + FLAT.format(top="VBD", phrase=PHRASE.format(two=TWO, symbol="VBN")))
def tree_flatten_up(spark, sf):
    return _edited(spark, sf, "conv", "flat", up=True)


@query(f", {PARSED} SELECT pair_id, '(' || v || '/VBD (' || v || '/VBD (' || w || '/NN ' || w || '/NN) (' || v || '/VBD ' || v || '/VBD' || {PHRASE.format(two='', symbol='VBN')} || ') ' || m || '/PUNC))' AS tree FROM n1")
def tree_propagate_up(spark, sf):
    return _edited(spark, sf, "conv", "noflat", up=True)


WHOLE = "SELECT pair_id, '(' || v || '/TOP (' || v || '/S (' || w || '/NPB ' || w || '/NN) ' || {vp} || {inside} || ')' || {outside} || ')' AS tree FROM n1"
KEPT_VP = f"'(' || v || '/VP ' || v || '/VBD' || {PHRASE.format(two='', symbol='VP-A')} || ')'"
MERGED_VP = "CASE WHEN n > 1 AND v = '{verb}' THEN '(' || z || '/VP-A ' || v || '/VBD ' || rest || ')' ELSE " + KEPT_VP + " END"
MARK_INSIDE = "' ' || m || '/PUNC'"


@query(f", {PARSED} " + WHOLE.format(vp=MERGED_VP.format(verb="WAS"), inside=MARK_INSIDE, outside="''"))
def tree_passive(spark, sf):
    return _edited(spark, sf, "conv", "pas")


@query(f", {PARSED} " + WHOLE.format(vp=MERGED_VP.format(verb="WILL"), inside=MARK_INSIDE, outside="''"))
def tree_auxiliary(spark, sf):
    return _edited(spark, sf, "conv", "aux")


@query(f", {PARSED} " + WHOLE.format(vp=KEPT_VP, inside="CASE m WHEN '.' THEN ' ./PUNC' ELSE '' END", outside="CASE m WHEN '.' THEN '' ELSE ' ' || m || '/PUNCX' END"))
def tree_raise_marks(spark, sf):
    return _edited(spark, sf, "conv", "upqpunc")


@query(f", {PARSED} SELECT pair_id, '(TOP ' || w || '/NN ' || v || '/VBD' || CASE n WHEN 1 THEN '' {TWO}ELSE ' (VP-A ' || rest || ')' END || ')' AS tree FROM n1")
def tree_preset(spark, sf):
    return _edited(spark, sf, "conv", "all")


@query(f""", {PARSED}, i AS (SELECT pair_id, j, CAST(CASE WHEN id > 500 THEN 1 ELSE id END AS VARCHAR) AS id, n FROM tok),
r AS (SELECT pair_id, string_agg(id || CASE WHEN j + 1 = n THEN '/6' ELSE '/5' END, ' ' ORDER BY j) FILTER (j > 0) AS rest, max(id) FILTER (j = 0) AS w, max(id) FILTER (j + 1 = n) AS z FROM i GROUP BY pair_id)
SELECT pair_id, '(1/2 (1/3 (' || r.w || '/1 ' || r.w || '/5) (1/4 1/1' || CASE n WHEN 1 THEN '' ELSE ' (' || r.z || '/1 ' || r.rest || ')' END || ') 1/1))' AS tree FROM n1 JOIN r USING (pair_id)""")
def tree_ids(spark, sf):
    """Heads as word ids up to 500 and symbols as ids, by joins with both tables."""
    ids = vocab.vocabulary(words(spark, sf), "e_words").select("word", "id").unionByName(spark.createDataFrame([("UNK", vocab.UNK)], "word string, id int"))
    symbols = spark.createDataFrame([("UNK", 1), ("TOP", 2), ("S", 3), ("VP", 4), ("NN", 5), ("VBN", 6)], "word string, id int")
    return transforms.edited(_parsed(spark, sf), "pair_id", "tree", transforms.Edits(("conv", "vocab", "convsym"), PUNCT, max_id=500), ids, symbols)


@query(f""", {PARSED}, o AS (SELECT pair_id, '(TOP~' || v || '~1~1 (S~' || v || '~1~1 (NPB~' || w || '~1~1 ' || w || '/NN) (VP~' || v || '~1~1 ' || v || '/VBD' || CASE n WHEN 1 THEN '' ELSE ' (VP-A~' || z || '~1~1 ' || rest || ')' END || ') ' || m || '/PUNC.))' AS line FROM n1)
SELECT pair_id, 0 AS n, line FROM o UNION ALL SELECT pair_id, 1, tree FROM ({WHOLE.format(vp=KEPT_VP, inside="''", outside="''")})""")
def tree_original_edited(spark, sf):
    lines = transforms.both(F.col("tree"), transforms.Edits(("conv", "rmpunc"), PUNCT))
    return _parsed(spark, sf).select("pair_id", F.posexplode(lines).alias("n", "line"))


@query(f", {PARSED} " + WHOLE.format(vp=KEPT_VP, inside=MARK_INSIDE, outside="''") + " WHERE n <= 4")
def tree_children_equal(spark, sf):
    """Edited trees with three children at some node and never more."""
    edits = transforms.Edits(("conv",), PUNCT)
    return transforms.pick(_parsed(spark, sf), "tree", edits, exactly=3).select("pair_id", transforms.edit(F.col("tree"), edits).alias("tree"))


@query(f""", {PARSED}, l AS (SELECT pair_id, unnest(list_concat(
  [{{'k': 'S', 'own': 'TOP', 'kids': v || '/S', 'full': v || '/TOP'}}, {{'k': 'NPB VP PUNC', 'own': 'S', 'kids': w || '/NPB ' || v || '/VP ' || m || '/PUNC', 'full': v || '/S'}}, {{'k': 'NN', 'own': 'NPB', 'kids': w || '/NN', 'full': w || '/NPB'}}],
  CASE n WHEN 1 THEN [{{'k': 'VBD', 'own': 'VP', 'kids': v || '/VBD', 'full': v || '/VP'}}]
  ELSE [{{'k': 'VBD VP-A', 'own': 'VP', 'kids': v || '/VBD ' || z || '/VP-A', 'full': v || '/VP'}}, {{'k': repeat('NN ', n - 2) || 'VBN', 'own': 'VP-A', 'kids': rest, 'full': z || '/VP-A'}}] END)) AS x FROM n1)
SELECT pair_id, (CASE WHEN length(s) < 30 THEN rpad(s, 30, ' ') ELSE s END) || x.kids || ' => ' || x.full AS line FROM (SELECT *, x.k || ' => ' || x.own AS s FROM l)""")
def tree_rule_list_heads(spark, sf):
    lines = transforms.rule_lines(F.col("tree"), transforms.Edits(("conv",), PUNCT), right=True, heads=True)
    return _parsed(spark, sf).select("pair_id", F.explode(lines).alias("line"))


# Training: iterative, so without SQL.

_fits: dict[tuple[str, str], tuple[em.Fit, DataFrame]] = {}


def _fit(spark, sf, iterations: int = 3) -> tuple[em.Fit, DataFrame]:
    """The model and the train part, fitted once a session and folder; its tables are in the checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fits:
        # what is read again and again: words by both vocabularies and their ids, the corpus by its split, its parts by all that follows
        rows = em.checkpointed(corpus.gated(corpus.bxi(em.checkpointed(words(spark, sf)))).select("pair_id", "e_tree", "f"))
        parts = em.checkpointed(corpus.split(rows))
        config = em.Config(iterations=iterations)
        train = parts.filter("split = 'train'").drop("split")
        allowed = corpus.phrase_cutoff(corpus.phrase_counts(train, config.band), 1, 4)
        _fits[key] = em.train(train, allowed, parts.filter("split = 'test'").drop("split"), config), train
    return _fits[key]


@query()
def em_perplexity_curve(spark, sf):
    return _fit(spark, sf)[0].history


@query()
def em_t_table(spark, sf):
    return params.t_dump(_fit(spark, sf)[0].model.t)


def _sample(spark, sf) -> tuple[DataFrame, em.Model]:
    """The first pairs of the train part, and the model."""
    fit, train = _fit(spark, sf)
    return corpus.align_sample(train), fit.model


@query()
def viterbi_alignment(spark, sf):
    return reports.alignment(*_sample(spark, sf))


@query()
def viterbi_trees(spark, sf):
    return reports.best_trees(*_sample(spark, sf))


@query()
def viterbi_used_probs(spark, sf):
    return reports.used_probs(*_sample(spark, sf))


@query()
def phrase_report(spark, sf):
    return reports.phrases(*_sample(spark, sf))


@query()
def fert_zero_report(spark, sf):
    return reports.zero_fertility(*_sample(spark, sf))
