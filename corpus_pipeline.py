"""A corpus pipeline: from raw documents to packed training sequences.

Five stages, each of which works on all that the one before kept. All but the last return the columns of the documents.

Defined results: a stage keeps null texts unless its rule rejects them (language ID does: they are ``und``); in the
near-duplicate stage texts alone decide, so rows that repeat a doc_id or have none go with their texts, and of rows equal
in doc_id and text one stays; very long texts are read whole; empty tables pass through; extra columns are kept, whatever
their names. A stage's input and what it wrote for itself are removed once its result is written.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsewright.llm import common, decontamination, language, packing, pretokens, simhash, toxicity


def _guarded(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``step`` with neutral names for the columns that it doesn't use, so that none can clash with what it adds."""
    used = {"doc_id", "text", "lang"}
    names = [c if c in used else f"_column_{k}" for k, c in enumerate(docs.columns)]
    return step(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: fitted on the labelled documents among the input; those with a score of 0.5 or more go."""
    model = toxicity.fit(docs, common.load(spark, sf_dir, "labels"), train=toxicity.in_fit())
    return _guarded(docs, lambda d: toxicity.score(d, model).filter("score < 0.5"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a language, and those whose nearest codewords are too close to call, go."""
    model = language.fit(docs, train=language.in_fit())
    return _guarded(docs, lambda d: language.predict(d, model).filter(F.col("lang_pred").eqNullSafe("und") == F.lit(False)).filter("not ambiguous"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the least doc_id stays."""
    return _guarded(docs, simhash.keep_one)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item, exact or edited, go."""
    return decontamination.clean(docs, common.load(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 1024 tokens."""
    return packing.pack_documents(docs, pretokens.default_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]

#: Tokenizers, fitted models, XXH64 and alignment are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read as the next one's input."""
    docs, before = common.load(spark, sf_dir, "documents"), None
    root = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(common.remove, spark, root)  # of which the result is read until then
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        with common.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return docs
