"""Token counts (operator 1): pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies and summed.

No ids of a document are ever made. The distinct pre-tokens of the corpus are found with pre-aggregation in every
task and shuffled once; a tokenizer counts the pieces of each of them once. The join to the documents' frequencies
has two halves. The pre-tokens that most documents hold, at most ``frequent`` of them however large the corpus is,
travel to the tasks as a table of bounded size, and a document sums these at once. What a document holds besides goes
through a shuffled join on the pre-token: none of those keys is in many documents, so no task gets a hot key.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens); repeated rows each give a row; a null
doc_id stays null; a very long text is cut in blocks; pre-tokens that equally many documents hold go the same way; an empty table gives an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pretokens

VOCABULARY = "pretoken string, df long, n long"


def vocabulary(docs: DataFrame, path: str, held: int = 300_000) -> DataFrame:
    """Distinct pre-tokens of the corpus, the documents that have each (df), and the pieces of each (n)."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = pretokens.cutter(path), Counter()

        def distinct_of(text: str) -> set[str]:
            return set().union(*(cut(t) for t in pretokens.text_blocks(text)))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"pretoken": pa.array(seen.keys(), pa.string()), "df": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return made

        for batch in batches:
            for part in common.slices(batch):
                for text in common.texts_of(part):
                    seen.update(distinct_of(text))
                    if len(seen) > held:
                        yield out()
        if seen:
            yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = pretokens.load_tokenizer(path)
        for batch in batches:
            for part in common.slices(batch):
                words = part.column("pretoken").to_pylist()
                n = [len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column("pretoken"), part.column("df"), pa.array(n, pa.int64())], names=["pretoken", "df", "n"])

    found = common.map_arrow(docs.select("text"), distinct, "pretoken string, df long").groupBy("pretoken").agg(F.sum("df").alias("df"))
    return common.map_arrow(found, pieces, VOCABULARY)


def frequent_bound(vocab: DataFrame, frequent: int) -> int:
    """The least power of two such that at most ``frequent`` pre-tokens are in so many documents."""
    rows = vocab.groupBy(F.floor(F.log2("df")).alias("p")).count().collect()  # at most 63 rows
    total, least = 0, 63
    for p, n in sorted(((r["p"], r["count"]) for r in rows), reverse=True):
        total += n
        if total > frequent:
            break
        least = p
    return 1 << min(least, 62)


def count_tokens(docs: DataFrame, path: str, frequent: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_tokens (special strings as the library counts them by default)."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType
    shared = common.Shared(spark)
    vocab = shared.keep(vocabulary(docs, path), "vocabulary")
    least = frequent_bound(vocab, frequent)
    known = {r["pretoken"]: r["n"] for r in vocab.filter(F.col("df") >= least).select("pretoken", "n").collect()}  # at most `frequent` rows
    table = spark.sparkContext.broadcast(known)
    schema = f"doc_id {kind.simpleString()}, text_hash long, n_bytes long, n_known long, rest array<struct<pretoken:string,freq:long>>"
    arrow = common.to_arrow(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, pieces = pretokens.cutter(path), table.value
        for batch in batches:
            for part in common.slices(batch):
                hashes, n_bytes, n_known, rests = [], [], [], []
                for text in common.texts_of(part):
                    raw = text.encode()
                    sums, rest = 0, []
                    counts: Counter = Counter()
                    for block in pretokens.text_blocks(text):
                        counts.update(cut(block))
                    for word, f in counts.items():
                        n = pieces.get(word)
                        if n is None:
                            rest.append({"pretoken": word, "freq": f})
                        else:
                            sums += f * n
                    hashes.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                    n_bytes.append(len(raw))
                    n_known.append(sums)
                    rests.append(rest)
                made = [hashes, n_bytes, n_known, rests]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, f.type) for v, f in zip(made, list(arrow)[1:], strict=True))], schema=arrow)

    # One pass gives each row's rest as (document, pretoken, freq), and its head: a line whose key, which starts with a
    # space as no pre-token does, finds nothing and is spread over all tasks.
    none = F.lit(None).cast("long")
    head = F.struct(F.concat(F.lit(" "), F.hex("text_hash")).alias("pretoken"), F.lit(0).cast("long").alias("freq"), F.col("n_bytes").alias("n_bytes"), F.col("n_known").alias("n_known"))
    tail = F.transform("rest", lambda x: F.struct(x["pretoken"].alias("pretoken"), x["freq"].alias("freq"), none.alias("n_bytes"), none.alias("n_known")))
    lines = common.map_arrow(docs, split, schema).select("doc_id", "text_hash", F.explode(F.concat(F.array(head), tail)).alias("x")).select("doc_id", "text_hash", "x.*")
    rest = vocab.filter(F.col("df") < least).select("pretoken", "n")
    sums = lines.join(rest, "pretoken", "left").groupBy("doc_id", "text_hash").agg(
        F.sum(F.col("freq") * F.coalesce(F.col("n"), F.lit(0))).alias("n_rest"), F.max("n_bytes").alias("n_bytes"), F.max("n_known").alias("n_known"), F.count("n_known").alias("times"))
    # Equal rows share a key, so their rest was summed `times` over.
    return sums.select(
        F.col("doc_id").alias(id_col), "n_bytes", (F.col("n_known") + (F.col("n_rest") / F.col("times")).cast("long")).alias("n_tokens"),
        F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_"),
    ).drop("_")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the vocabulary with word ends; over_limit marks more than 2048."""
    out = count_tokens(common.load(spark, sf_dir, "documents"), pretokens.default_path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
