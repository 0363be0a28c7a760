"""Language ID (operator 8): error-correcting output codes over hashed character n-grams.

Every language has a codeword; for each bit a binary logistic classifier over character 1- to 3-grams (letters
lower-cased, anything else one separator) predicts whether the text's language has that bit set. Decoding is
loss-weighted: a language's distance is the sum over bits of the bit's weight (its accuracy on the training rows
beyond chance) times the logistic loss of the classifier's output against the language's bit; the least distance wins.
The score is the softmax of the negative distances, and a text is flagged as ambiguous if the two nearest codewords
are closer than ``ambiguous``. Up to seven languages the code is exhaustive (all 2^(L-1) - 1 ways to part the
languages), beyond that a random code with the best least distance of several draws.

The classifiers are fitted on about ``max_fit`` labelled rows at most, taken by a hash of their ids and texts in equal shares of the
languages; their n-grams are counted over whole texts. That bound is a parameter and does not follow the corpus.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous; without labelled rows
every text is ``und``; rows with a null lang are not learned from; a very long text is counted in blocks; of codewords
equally near the first language in text order wins; repeated rows each give a row; extra columns stay, but those named
like an added one (lang_pred, score, ambiguous) are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIM = 1 << 12
UND = "und"


@functools.lru_cache(1)
def folded() -> np.ndarray:
    """For each code point of the first plane its lower case if a letter, else 0; further planes by the letter test alone."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0])
    return table


BLOCK = 1 << 18  # characters of a text that are looked at together


def gram_counts(text: str) -> np.ndarray | None:
    """Hashed counts of 1- to 3-grams, square-rooted and scaled to length one; None without a letter. In blocks, the last
    two characters of one being the context of the next."""
    counts, table, letters = np.zeros(DIM, np.int64), folded(), False
    shift = np.uint32(20)

    def add(c: np.ndarray, old: int) -> None:
        """Count the grams that end after the first ``old`` characters of c."""
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for n, grams in enumerate((one, two, three)):
            counts[:] += np.bincount(grams[max(old - n, 0) :] >> shift, minlength=DIM)

    held = np.zeros(1, np.uint32)
    add(held, 0)
    for at in range(0, len(text), BLOCK):
        c = table[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters = letters or bool(c.any())
        before = np.concatenate((held[-1:] if at else np.ones(1, np.uint32), c[:-1]))
        c = c[(c != 0) | (before != 0)]  # runs of separators count as one
        add(np.concatenate((held, c)), len(held))
        held = np.concatenate((held, c))[-2:]
    if not letters:
        return None
    add(np.concatenate((held, np.zeros(1, np.uint32))), len(held))
    x = np.sqrt(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of n languages as rows of +1 and -1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[1 if (b >> k) & 1 else -1 for b in range(1, 1 << (n - 1))] for k in range(n - 1)]
        return np.array([*bits, [-1] * ((1 << (n - 1)) - 1)], float)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(15 * np.log2(n)))

    def draw() -> np.ndarray:
        return rng.choice([-1.0, 1.0], size=(n, width))

    def least(m: np.ndarray) -> float:
        d = (width - m @ m.T) / 2
        return d[~np.eye(n, dtype=bool)].min() - 100 * (np.abs(m.sum(0)) == n).any()

    return max((draw() for _ in range(200)), key=least)


@dataclass
class LanguageModel:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding
    ambiguous: float = 0.15

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        x = gram_counts(text) if text and self.langs else None
        if x is None:
            return UND, 0.0, False
        d = self.distances((x @ self.weights + self.bias)[None, :])[0]
        p = np.exp(-(d - d.min()))
        p /= p.sum()
        best = int(d.argmin())
        second = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
        return self.langs[best], float(p[best]), bool(p[best] - second < self.ambiguous)

    def distances(self, f: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of classifier outputs to every codeword."""
        return np.logaddexp(0, -f[:, None, :] * self.codes[None, :, :]) @ self.trust


def fit(docs: DataFrame, train: Column | None = None, label: str = "lang", max_fit: int = 4000) -> LanguageModel:
    """Learns from rows with a text and a label under ``train``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if train is not None:
        rows = rows.filter(train)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.ones((0, 1)), np.zeros((DIM, 1), np.float32), np.zeros(1), np.ones(1))
    each = max(20, max_fit // len(langs))
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1 << 20, int(each / n * (1 << 20)) + 1))).otherwise(share)
    # by id and text, and each text once: rows that share an id, or copies, can't be picked all together
    picked = rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(11)), F.lit(1 << 20)) < share).select("text", "lang").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                found = [(lang, x.astype(np.float16).tobytes()) for lang, t in zip(part.column("lang").to_pylist(), common.texts_of(part), strict=True) if (x := gram_counts(t)) is not None]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.binary())], names=["lang", "x"])

    got = common.map_arrow(picked, run, "lang string, x binary").collect()  # max_fit rows of DIM half floats at most, but for chance
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    got = [r for k, r in enumerate(got) if not k or bytes(r["x"]) != bytes(got[k - 1]["x"])]  # copies count once
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, DIM), np.float32)
    y = np.array([langs.index(r["lang"]) for r in got], int)
    codes = code_matrix(len(langs))
    weights, bias = logistic(x, codes[y] if len(y) else np.ones((0, codes.shape[1])))
    right = ((x @ weights + bias) * codes[y] > 0).mean(0) if len(y) else np.ones(codes.shape[1])
    return LanguageModel(langs, codes, weights, bias, np.clip(2 * right - 1, 0.05, 1.0))


def logistic(x: np.ndarray, targets: np.ndarray, rounds: int = 60, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """All bits' logistic regressions at once, by accelerated gradient steps on balanced classes."""
    n, bits = len(x), targets.shape[1]
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    if not n:
        return w, b
    up = (targets > 0).mean(0)
    cost = np.where(targets > 0, 0.5 / np.maximum(up, 1e-6), 0.5 / np.maximum(1 - up, 1e-6)).astype(np.float32)
    t = targets.astype(np.float32)
    vw, vb, rate, keep = np.zeros_like(w), np.zeros_like(b), 8.0, 0.9
    for _ in range(rounds):
        aw, ab = w + keep * vw, b + keep * vb
        g = -t * cost / (1 + np.exp(t * (x @ aw + ab)))
        vw = keep * vw - rate * (x.T @ g / n + ridge * aw)
        vb = keep * vb - rate * g.mean(0)
        w, b = w + vw, b + vb
    return w, b


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of docs with lang_pred, score and ambiguous added (or replaced)."""
    table = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double, ambiguous boolean"])
    arrow = common.to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = table.value
        for batch in batches:
            for part in common.slices(batch):
                made = [m.predict(t) for t in part.column("text").to_pylist()]
                more = [pa.array([r[k] for r in made], f.type) for k, f in enumerate(list(arrow)[-3:])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)] + more, schema=arrow)

    return common.map_arrow(docs, run, schema)


def in_fit() -> Column:
    return common.crc_mod("doc_id", 4) != 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; held-out rows are never learned from."""
    docs = common.load(spark, sf_dir, "documents")
    model = fit(docs, train=in_fit())
    out = predict(common.columns(docs, "doc_id", "text"), model)
    return out.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
