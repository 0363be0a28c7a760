"""Toxicity (operator 3): maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Fit. Tokens are lower-cased words and the prefixes of words (``PREFIXES`` letters long), so that insults which a
language inflects share a token. On the labelled training rows each token's log-odds between toxic and other
documents is taken with an informative Dirichlet prior (the token's share in both, times ``prior``), over documents, as
a word that one toxic document repeats tells nothing. It is drawn towards zero by ``shrink`` standard deviations, so
what few documents say counts little and nothing is cut off. A word scores as the token that says most about it, for
or against, less ``drift``; with that the expected score of ordinary text is negative, as segment statistics ask for.

Score. One linear pass finds all maximal-scoring segments (Ruzzo and Tompa). The score of a random text's best
segment follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)); lambda solves E[exp(lambda s)] = 1
over the words of the other training documents, K is the likeliest given their best segments. A segment is significant
if its expected number in a text of that length is at most ``e_most``. A document's evidence is the law's log-odds
against its r best segments together (Karlin and Altschul's sum statistic), at the r that says most; a logistic curve
turns its logarithm into a score from 0 to 1. Lambda, K and the curve are fitted on the training rows, each scored
without its own contribution to the counts.

The fit reads at most about ``max_labelled`` labelled rows (taken by a hash of their ids; all, if there are no more),
one row for each doc_id. They are joined out of the corpus once and written. That bound does not depend on the size of
the corpus; every document is scored over its whole text.

Defined results: null and empty texts have no segment and get the score of no evidence; a very long text is scanned
like any other, in one pass; labels that are null count as no label, a doc_id with several labels is toxic if one of
them says so, and of several texts of a labelled doc_id the one of the least hash is learned from; equal segments
stand in text order, and of tokens that say equally much the longer one counts; without labelled rows of both kinds
every score is 0; repeated rows each give a row; an empty table gives an empty result; extra columns stay, but those
named like an added one (score, n_segments, passages) are replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = re.compile(r"[^\W_]+")
PREFIXES = (5, 6, 7)


def word_tokens(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


@dataclass
class ToxicModel:
    """Scores of tokens, and the constants of the extreme-value law and of the logistic curve."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    lam: float = 1.0
    k: float = 0.1
    e_most: float = 0.25
    weights: tuple[float, ...] = ()
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def word_score(self, word: str) -> float:
        """What the word's most telling token says, less the drift."""
        s = self.cache.get(word)
        if s is None:
            s = max((self.scores.get(t, 0.0) for t in word_tokens(word)), key=abs) - self.drift
            if len(self.cache) > 150_000:
                self.cache.clear()
            self.cache[word] = s
        return s

    def found(self, words: list[str]) -> list[tuple[int, float]]:
        """The words that differ from the drift alone: (place, score)."""
        get, least, out = self.cache.get, -self.drift, []
        for k, w in enumerate(words):
            s = get(w)
            if s is None:
                s = self.word_score(w)
            if s != least:
                out.append((k, s))
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal segments: (first word, end, score), in text order."""
        return maximal_segments(self.found(words), self.drift)

    def significant(self, n: int) -> float:
        """The least score of a segment that is expected at most e_most times in n words."""
        return math.log(max(self.k * n, 1e-9) / self.e_most) / self.lam

    def evidence(self, scores: list[float], n: int) -> float:
        """Log of one plus -log P of the best segments (all scores, in descending order) of n words, at the number that says most."""
        if not scores or not n:
            return 0.0
        level, total, best = math.log(max(self.k * n, 1e-9)), 0.0, 0.0
        for r, s in enumerate(scores, 1):
            total += self.lam * s - level
            if r == 1:
                p = -math.expm1(-math.exp(-total)) if total < 30 else math.exp(-min(total, 600.0))
                best = -math.log(max(p, 1e-300))
            elif total > r - 1:  # where the law of the sum's tail holds; each more that is looked at costs a factor of two
                best = max(best, total + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2 * total))
        return math.log1p(best)

    def probability(self, evidence: float) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + self.weights[1] * evidence
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def maximal_segments(scored: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a text (Ruzzo and Tompa), given the words that differ from -drift, in one pass.

    The stack holds candidate segments with the running totals before and after them.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, end, total before, total after
    total, last = 0.0, 0
    for k, s in scored:
        total -= drift * (k - last)
        last = k + 1
        before, total = total, total + s
        if s <= 0:
            continue
        first, left, right = k, before, total
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]  # join with that candidate and all after it
            del stack[j:]
        stack.append((first, k + 1, left, right))
    return [(a, b, r - x) for a, b, x, r in stack]


def labelled(labels: DataFrame, label: str, max_labelled: int, train) -> DataFrame:
    """(doc_id, y) of the training labels, at most about max_labelled, chosen by a hash of the id."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = rows.filter(train)
    n = rows.count()
    if n > max_labelled:
        rows = rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1 << 20)) < int(max_labelled / n * (1 << 20)))
    return rows


def without_copies(sample: DataFrame) -> dict:
    """{doc_id: y} of the sample (bounded), one row for those that share a min-hash of their 5-word shingles and the label.

    Copies of one text would else make its words look like a trait of the label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                sketch = []
                for text in common.texts_of(part):
                    words = text.lower().split()
                    shingles = [" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
                    sketch.append([min(xxhash.xxh3_64_intdigest(x, seed) for x in shingles) - (1 << 63) for seed in (1, 2)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "y", "h"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    seen: set = set()
    out = {}
    for r in sorted(common.map_arrow(sample, run, f"doc_id {kind}, y int, h array<long>").collect(), key=lambda r: r["doc_id"]):
        keys = {(k, h, r["y"]) for k, h in enumerate(r["h"])}
        if not keys & seen:
            out[r["doc_id"]] = r["y"]
        seen |= keys
    return out


def tokens_in(words: list[str]) -> set[str]:
    return {t for w in set(words) for t in word_tokens(w)}


def count_labelled(sample: DataFrame, chosen) -> DataFrame:
    """Per token: in how many toxic (a) and other (b) training documents it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Counter(), Counter()
        label = chosen.value

        def out() -> pa.RecordBatch:
            keys = list(a.keys() | b.keys())
            made = pa.RecordBatch.from_pydict({"token": pa.array(keys, pa.string()), **{n: pa.array([c[k] for k in keys], pa.int64()) for n, c in (("a", a), ("b", b))}})
            a.clear()
            b.clear()
            return made

        for batch in batches:
            for part in common.slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), common.texts_of(part), strict=True):
                    if doc_id in label:
                        (a if label[doc_id] else b).update(tokens_in(WORDS.findall(text.lower())))
                        if len(a) + len(b) > 100_000:
                            yield out()
        if a or b:
            yield out()

    return common.map_arrow(sample, run, "token string, a long, b long").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


LEAST_PRIOR = 0.3  # documents by which the prior counts a token, or its absence, at least


def log_odds(a: float, b: float, n_a: int, n_b: int, prior: float, shrink: float) -> float:
    """Of a token in a of n_a toxic and b of n_b other documents, drawn towards zero by ``shrink`` standard deviations."""
    if a + b <= 0:
        return 0.0
    alpha = max(prior * (a + b) / (n_a + n_b), LEAST_PRIOR)
    without = lambda c, n: max(n + prior - c - alpha, LEAST_PRIOR)
    delta = math.log((a + alpha) / without(a, n_a)) - math.log((b + alpha) / without(b, n_b))
    return math.copysign(max(0.0, abs(delta) - shrink * math.sqrt(1 / (a + alpha) + 1 / (b + alpha))), delta)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train=None, max_labelled: int = 20_000, prior: float = 10.0, shrink: float = 1.5, drift: float = 1.0, e_most: float = 0.25) -> ToxicModel:
    """``train`` is a condition on doc_id for the rows to learn from."""
    spark = docs.sparkSession
    docs = common.columns(docs, "doc_id", "text")
    chosen_rows = labelled(labels, label, max_labelled, F.lit(True) if train is None else train)
    shared = common.Shared(spark)
    # about max_labelled rows are broadcast; of a doc_id's rows the one of the least hash stays
    sample = docs.join(F.broadcast(chosen_rows), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = shared.keep(sample.repartition(spark.sparkContext.defaultParallelism), "sample")
    chosen = without_copies(sample)
    n_a = sum(chosen.values())
    n_b = len(chosen) - n_a
    model = ToxicModel(drift=drift, e_most=e_most)
    if not n_a or not n_b:
        shared.drop("sample")
        return model
    sent = spark.sparkContext.broadcast(chosen)
    alpha = F.greatest(F.lit(prior) * (F.col("a") + F.col("b")) / F.lit(n_a + n_b), F.lit(LEAST_PRIOR))
    odds = lambda c, n: F.log((F.col(c) + alpha) / F.greatest(F.lit(n + prior) - F.col(c) - alpha, F.lit(LEAST_PRIOR)))
    telling = count_labelled(sample, sent).filter(F.abs(odds("a", n_a) - odds("b", n_b)) > F.lit(shrink) * F.sqrt(1 / (F.col("a") + alpha) + 1 / (F.col("b") + alpha)))
    counts = {r["token"]: (r["a"], r["b"]) for r in telling.collect()}  # tokens that several labelled documents share
    model.scores = {t: log_odds(a, b, n_a, n_b, prior, shrink) for t, (a, b) in counts.items()}
    table = spark.sparkContext.broadcast(counts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
        """(y, words, the words that differ from the drift) of each document, its own share of the counts left out."""
        label, counts = sent.value, table.value
        caches: tuple[dict[str, float], dict[str, float]] = ({}, {})

        def word_score(word: str, y: int) -> float:
            s = caches[y].get(word)
            if s is None:
                own = lambda t: log_odds(counts[t][0] - y, counts[t][1] - (1 - y), n_a - y, n_b - (1 - y), prior, shrink) if t in counts else 0.0
                s = caches[y][word] = max(map(own, word_tokens(word)), key=abs) - drift
            return s

        for batch in batches:
            for part in common.slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), common.texts_of(part), strict=True):
                    if doc_id in label:
                        y, words = label[doc_id], WORDS.findall(text.lower())
                        yield y, len(words), [(k, s) for k, w in enumerate(words) if (s := word_score(w, y)) != -drift]
                for c in caches:
                    if len(c) > 150_000:
                        c.clear()

    def law(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of other documents words and best segment; and how often each score occurs in them (n = -1), for lambda."""
        values: Counter = Counter()
        rows: list[tuple[int, float, int]] = []
        for y, n, found in scored(batches):
            if not y:
                values.update(round(s, 3) for _, s in found)
                rows.append((n, max((s for _, _, s in maximal_segments(found, drift)), default=0.0), 1))
        rows += [(-1, s, c) for s, c in values.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["n", "s", "c"])

    seen = common.map_arrow(sample, law, "n long, s double, c long").groupBy("n", "s").agg(F.sum("c").alias("c")).collect()
    fit_law(model, sorted((r["n"], r["s"], r["c"]) for r in seen if r["n"] >= 0), {r["s"]: r["c"] for r in seen if r["n"] < 0})

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document what all its segments say."""
        rows = [(y, model.evidence(sorted((s for _, _, s in maximal_segments(found, drift)), reverse=True), n)) for y, n, found in scored(batches)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64()), strict=True)], names=["y", "x"])

    model.weights = logistic(sorted((r["y"], r["x"]) for r in common.map_arrow(sample, evidence, "y int, x double").collect()))  # a row for each labelled one
    sent.unpersist()
    table.unpersist()
    shared.drop("sample")
    return model


def fit_law(model: ToxicModel, clean: list[tuple[int, float, int]], values: dict[float, int]) -> None:
    """Set lambda and K of the extreme-value law from other documents: (words, best segment, how many), and {score: words}."""
    words = max(1, sum(n * c for n, _, c in clean))
    plain = words - sum(values.values())

    def excess(lam: float) -> float:
        return (plain * math.exp(-lam * model.drift) + sum(values[s] * math.exp(lam * s) for s in sorted(values))) / words - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 50:
        high *= 2
    if excess(low) < 0:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid) < 0 else (low, mid)
        model.lam = low
    # the likeliest K, given the best segments
    counted = sum(c for n, _, c in clean if n)
    if counted:
        model.k = counted / max(1e-9, sum(n * c * math.exp(-model.lam * s) for n, s, c in clean))


def logistic(rows: list[tuple[int, float]]) -> tuple[float, ...]:
    """Weights of 1 and x by which y is likeliest; none if all y are the same."""
    y = np.array([r[0] for r in rows], float)
    x = np.array([(1.0, r[1]) for r in rows], float).reshape(len(rows), 2)
    if not 0 < y.sum() < len(y):
        return ()
    w = np.zeros(2)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (y - p) - ridge @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: ToxicModel, passages: bool = False) -> DataFrame:
    """Adds score (0 to 1), n_segments, and with ``passages`` the significant segments' texts, to all columns of docs.

    Columns of docs that have one of these three names are replaced.
    """
    table = docs.sparkSession.sparkContext.broadcast(model)
    fields = "score double, n_segments int" + ", passages array<string>" * passages
    names = [c for c in docs.columns if c not in ("score", "n_segments", "passages")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, {fields}"
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = table.value
        for batch in batches:
            for part in common.slices(batch):
                scores, counts, found = [], [], []
                for text in part.column("text").to_pylist():
                    low = (text or "").lower()
                    words = WORDS.findall(low)
                    every = m.segments(words)
                    limit = m.significant(len(words))
                    segs = [x for x in every if x[2] >= limit]
                    scores.append(m.probability(m.evidence(sorted((x[2] for x in every), reverse=True), len(words))))
                    counts.append(len(segs))
                    if passages:
                        spans = [x.span() for x in WORDS.finditer(low)] if segs else []
                        found.append([low[spans[a][0] : spans[b - 1][1]] for a, b, _ in segs])
                more = [pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), *([pa.array(found, pa.list_(pa.string()))] if passages else [])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)] + more, schema=arrow)

    return common.map_arrow(docs, run, schema)


def in_fit() -> Column:
    return common.crc_mod("doc_id", 5) != 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document; the model never sees the labels of held-out rows."""
    docs = common.columns(common.load(spark, sf_dir, "documents"), "doc_id", "text")
    model = fit(docs, common.load(spark, sf_dir, "labels"), train=in_fit())
    out = score(docs, model)
    return out.select("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments")
