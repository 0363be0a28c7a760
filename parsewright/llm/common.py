"""What the operators of this subpackage share: shared tables, row keys, and Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the same set in which ``bytes.split()`` cuts.
WORD_BYTES = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or the context's checkpoint folder; else (tests) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get().rstrip("/")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="parsewright-"))
    return _own_dir[0]


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all tables that ``Shared`` wrote within: for work whose result has been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # at exit the JVM may be gone already
        return


class Shared:
    """Tables written to the shared folder, which cut lineage; ``drop`` removes them when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def keep(self, df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
        """Write ``df`` once and read it back, with its schema given so that an empty table reads as well."""
        path = f"{self.root}/{name}-{len(self.made)}"
        df.write.option("compression", "zstd").parquet(path)
        self.made.append(path)
        if _scopes:
            _scopes[-1].append(path)
        atexit.register(remove, self.spark, path)
        return self.spark.read.schema(schema or df.schema).parquet(path)

    def drop(self, name: str) -> None:
        for path in [p for p in self.made if p.rsplit("/", 1)[1].rsplit("-", 1)[0] == name]:
            remove(self.spark, path)
            self.made.remove(path)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_mod_py(value: object, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def columns(df: DataFrame, *names: str, text: str | None = "text") -> DataFrame:
    """Only the named columns; the text column becomes a string, null as null."""
    return df.select(*[F.col(f"`{n}`").cast("string").alias(n) if n == text else F.col(f"`{n}`") for n in names])


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with Arrow batches of bounded bytes.

    Spark fills a batch up to 64 MB by default, which every running task then holds in the JVM and in Python. A session
    that has not set the size of batches itself gets BATCH_BYTES; as results are lazy, that stays set.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


BATCH_BYTES = 8 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about BATCH_BYTES, one row at least, so that decoded Python strings stay bounded."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, int(n * BATCH_BYTES / max(BATCH_BYTES, batch.nbytes)))
    for k in range(0, n, step):
        yield batch.slice(k, step)


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
