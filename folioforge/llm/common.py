"""Helpers that the training-data operators share: scratch tables, bindings, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    It is read from ``spark.checkpoint.dir``. Only where neither that nor a checkpoint
    folder of the context is set (tests, a laptop) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioforge-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path not used before, below the shared folder."""
    return f"{shared_folder(spark)}/folioforge/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go as soon as the query has ended, not when the
    driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, a lost
    executor costs a file read, not a recomputation, and what was shuffled on the way goes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_bytes(written: DataFrame) -> int:
    """Bytes of the files of a written table."""
    spark = written.sparkSession
    conf, path = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs.Path
    folders = {f.rpartition("/")[0] for f in written.inputFiles()}
    return sum(path(x).getFileSystem(conf).getContentSummary(path(x)).getLength() for x in folders)


def broadcast_if_small(written: DataFrame, most: int = 8_000_000) -> DataFrame:
    """A broadcast hint if the files of a written table have at most ``most`` bytes."""
    return F.broadcast(written) if written_bytes(written) <= most else written


def discard(*written: DataFrame) -> None:
    """Remove the folders of tables that ``materialise`` wrote and nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/folioforge/" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as long as ``columns`` have one of that name."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often body names it.

    Catalyst may inline an alias into a lambda, where it would be computed for each
    element; a lambda's own variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"{SPACE_CLASS}+"))


def row_key(*columns: str) -> Column:
    """64 bits that, together with the id, name a row. Rows that agree in id and text are
    equal rows and share it."""
    return F.xxhash64(*[F.col(c) for c in columns])


def slices_by_bytes(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a few megabytes in a column of text or bytes; a longer value is a run
    of its own."""
    values = batch.column(column)
    start, size = 0, 0
    lengths = pa.compute.binary_length(values).to_pylist()
    for row, n in enumerate(lengths):
        n = n or 0
        if size and size + n > most:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside exchange Arrow batches of at most ``rows`` rows with Python, for
    stages whose rows carry whole texts and more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
