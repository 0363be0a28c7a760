"""Ranks and carried states over ranges of rows."""

import random

from pyspark.sql import functions as F

from parsewright.functions import ranking, text
from parsewright.operators import corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_many_groups_and_of_one(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0, 0, 0, rnd.randint(1, 500)]), k) for k in range(4000)]
    out = ranking.global_rank(spark.createDataFrame(rows, "a int, b int"), F.desc("a"), F.asc("b")).collect()
    want = {r: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1)}
    assert {(r.a, r.b): r["rank"] for r in out} == want
    assert ranking.global_rank(spark.createDataFrame([], "a int"), "a").count() == 0


def test_split_has_no_task_for_all_rows(spark):
    """A million groups of one row: no shuffle of rows follows the written ranges, and no range has more than its share."""
    pairs = spark.range(1_000_000).select((F.col("id") * 100_000).alias("pair_id"))
    out = corpus.split(pairs)
    assert plan(out).count("Exchange SinglePartition") <= 1  # of a row a range
    sizes = ranking.in_order(pairs, "pair_id").groupBy(ranking.range_of()).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[1] == 4 and sizes[0] < 2 * 250_000
    assert out.filter("split = 'test'").count() == 10_000


def test_state_is_carried_over_ranges(spark):
    """A failed score far back switches all lines off, over whole ranges, until the next score."""
    rnd = random.Random(2)
    lines, ok, want = [], True, []
    for k in range(5000):
        kind = rnd.random()
        line = "PROB 0 0 0" if kind < 0.0008 else "PROB 1 -2 0" if kind < 0.0016 else "(TOP SentenceNotParsed)" if kind < 0.1 else f"(TOP {k})"
        if line.startswith("PROB"):
            ok = line != "PROB 0 0 0"
        elif ok and "Not" not in line:
            want.append(line)
        lines.append((k, line))
    assert 0 < len(want) < 4000
    rnd.shuffle(lines)
    df = spark.createDataFrame(lines, "n int, line string")
    assert [r.line for r in text.parse_filter(df).orderBy("n").collect()] == want
    assert "windowspecdefinition(0" not in plan(text.parse_filter(df))
    assert text.parse_filter(df.limit(0)).count() == 0
