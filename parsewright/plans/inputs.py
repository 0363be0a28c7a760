"""Corpora derived from the tables of a data folder, for the named queries; and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parsewright.operators import corpus


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_pairs(conversations(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.bxi(words(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for co-occurrence and training: those within the preparation's limits."""
    return corpus.gated(pairs(spark, sf_dir))


#: Word pairs, vocabularies, ids; ``pairs`` with the tree's text, ``gated`` what the preparation lets through; ``nodes`` in
#: closed form (``grp``: the runs of chunks under symbol 2; ``tok``: one row an E word with its chunk and group).
BASE = r"""
WITH turns AS (
  SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?\n]+'), lambda s: regexp_extract_all(s, '\p{L}+')), lambda s: len(s) > 0) AS e,
         regexp_extract_all(text, '\p{L}+') AS f
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND regexp_matches(text, '\p{L}')),
after AS (
  SELECT conv_id, turn, e, coalesce(lead(f) OVER (PARTITION BY conv_id ORDER BY turn), first_value(f) OVER (PARTITION BY conv_id ORDER BY turn)) AS f, CAST(len(e) AS BIGINT) AS n FROM turns),
wp AS (
  SELECT (conv_id * 10000 + turn) * 100000 + k AS pair_id, e[k + 1] AS e_words, f[1 + (k * len(f)) // n:((k + 1) * len(f)) // n] AS f_words
  FROM (SELECT *, unnest(range(0, n)) AS k FROM after)),
we AS (SELECT pair_id, unnest(e_words) AS word, CAST(unnest(range(len(e_words))) AS INT) AS j, CAST(len(e_words) AS INT) AS n FROM wp),
wf AS (SELECT pair_id, unnest(f_words) AS word, CAST(unnest(range(len(f_words))) AS INT) AS j, CAST(len(f_words) AS INT) AS n FROM wp),
ve AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, word) + 1 AS INT) AS id, word, freq FROM (SELECT word, count(*) AS freq FROM we GROUP BY word)),
vf AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, word) + 1 AS INT) AS id, word, freq FROM (SELECT word, count(*) AS freq FROM wf GROUP BY word)),
size_of AS (
  SELECT pair_id, n, CAST((n + 1) // 2 AS INT) AS chunks, CAST(1 + greatest(0, ((n + 1) // 2 - 2) // 3) AS INT) AS groups
  FROM (SELECT pair_id, CAST(len(e_words) AS INT) AS n FROM wp)),
tok AS (
  SELECT pair_id, j, n, id, 4 + id % 3 AS sym, chunks, groups, CAST(j // 2 AS INT) AS k, CAST(least(j // 2 // 3, groups - 1) AS INT) AS g
  FROM we JOIN ve USING (word) JOIN size_of USING (pair_id, n)),
tokf AS (SELECT pair_id, j, n, id FROM wf JOIN vf USING (word)),
f AS (SELECT pair_id, list(id ORDER BY j) AS f FROM tokf GROUP BY pair_id),
e AS (SELECT pair_id, list(id ORDER BY j) AS e FROM tok GROUP BY pair_id),
chunk_text AS (
  SELECT pair_id, k, any_value(chunks) AS chunks, any_value(groups) AS groups, any_value(n) AS n,
         CASE WHEN k > 0 AND k % 3 = 0 AND any_value(chunks) - k > 1 THEN '(2 ' ELSE '' END
         || CASE WHEN count(*) = 2 THEN '(3 ' ELSE '' END || string_agg(id || '/' || sym, ' ' ORDER BY j) || CASE WHEN count(*) = 2 THEN ')' ELSE '' END AS t
  FROM tok GROUP BY pair_id, k),
trees AS (SELECT pair_id, CASE WHEN any_value(n) = 1 THEN any_value(t) ELSE '(2 ' || string_agg(t, ' ' ORDER BY k) || repeat(')', any_value(groups)) END AS e_tree FROM chunk_text GROUP BY pair_id),
pairs AS (SELECT pair_id, e_tree, e, coalesce(f, CAST([] AS INT[])) AS f FROM trees JOIN e USING (pair_id) LEFT JOIN f USING (pair_id)),
gated AS (SELECT * FROM pairs WHERE len(e) <= 20 AND len(f) < 30),
grp AS (SELECT pair_id, n, chunks, groups, CAST(unnest(range(groups)) AS INT) AS g FROM size_of WHERE n > 1),
nodes AS (
  SELECT pair_id, 10 * g AS node_id, CASE WHEN g = 0 THEN -1 ELSE 10 * (g - 1) END AS parent_id, CASE WHEN g = 0 THEN 0 ELSE 3 END AS child_idx, 2 AS symbol, NULL AS head,
         CASE WHEN g < groups - 1 THEN 4 ELSE chunks - 3 * g END AS numc, 6 * g AS epos, n - 6 * g AS elen, false AS is_leaf, 1 + g AS level FROM grp
  UNION ALL
  SELECT pair_id, 10 * g + 1 + 3 * (k - 3 * g), 10 * g, k - 3 * g, 3, NULL, 2, j, 2, false, 2 + g FROM tok WHERE n > 1 AND j % 2 = 0 AND j + 1 < n
  UNION ALL
  SELECT pair_id, CASE WHEN n = 1 THEN 0 WHEN j % 2 = 0 AND j + 1 = n THEN 10 * g + 1 + 3 * (k - 3 * g) ELSE 10 * g + 2 + 3 * (k - 3 * g) + j % 2 END,
         CASE WHEN n = 1 THEN -1 WHEN j % 2 = 0 AND j + 1 = n THEN 10 * g ELSE 10 * g + 1 + 3 * (k - 3 * g) END,
         CASE WHEN n = 1 THEN 0 WHEN j % 2 = 0 AND j + 1 = n THEN k - 3 * g ELSE j % 2 END,
         sym, id, 0, j, 1, true, CASE WHEN n = 1 THEN 1 WHEN j % 2 = 0 AND j + 1 = n THEN 2 + g ELSE 3 + g END
  FROM tok),
rules AS (
  SELECT p.pair_id, p.node_id, p.numc, p.symbol || ' ' || string_agg(c.symbol, ' ' ORDER BY c.child_idx) AS rule
  FROM nodes p JOIN nodes c ON c.pair_id = p.pair_id AND c.parent_id = p.node_id GROUP BY p.pair_id, p.node_id, p.numc, p.symbol),
band AS (SELECT x AS elen, {low} AS low, {high} AS high FROM range(1, 21) t(x)),
spans AS (
  SELECT n.pair_id, n.epos, n.elen, p.fpos, l.flen, array_to_string(e[n.epos + 1:n.epos + n.elen], ' ') AS e, array_to_string(f[p.fpos + 1:p.fpos + l.flen], ' ') AS f
  FROM nodes n JOIN gated USING (pair_id) JOIN band b ON b.elen = n.elen, LATERAL (SELECT unnest(range(b.low, least(b.high, len(f)) + 1)) AS flen) l,
       LATERAL (SELECT unnest(range(0, len(f) - l.flen + 1)) AS fpos) p
  WHERE n.numc <> 1),
cooc AS (SELECT e, f, count(*) AS cnt FROM spans GROUP BY e, f),
cut AS (
  SELECT e, f FROM (SELECT e, f, least(cnt, 10) AS cnt FROM cooc)
  WHERE (cnt > 1 OR (NOT contains(e, ' ') AND NOT contains(f, ' '))) AND NOT (contains(e, ' ') AND cnt <= 4))
"""
