"""Continuous folder ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.storage import work_folder


def _watched(spark: SparkSession, path: str) -> tuple[str, str]:
    """(folder, pattern) under which a file or all files of a folder are watched."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if system.getFileStatus(place).isDirectory():
        return path, "*"
    folder, _, name = path.rpartition("/")
    return folder, name


def watch(
    spark: SparkSession,
    path: str,
    schema,
    process: Callable[[DataFrame, int], None],
    checkpoint: str,
    pattern: str = "*",
    fmt: str = "parquet",
    every: str | None = None,
    retries: int = 0,
):
    """A query that hands each batch of new files to ``process``; without ``every`` it stops when the
    folder is read, with it (``10 seconds``) it goes on until it is stopped. Files are seen once,
    across restarts; a batch that fails is tried ``retries`` times more and then fails the query.
    Archiving belongs at the end of ``process``: it then follows success, which cleanSource does
    not."""
    if checkpoint.rstrip("/").startswith(path.rstrip("/") + "/"):
        raise ValueError("the work folder must not lie in the folder that is watched")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).format(fmt).load(path)

    def attempts(batch: DataFrame, number: int) -> None:
        for left in range(retries, -1, -1):
            try:
                return process(batch, number)
            except Exception:
                if not left:
                    raise

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(attempts).option("checkpointLocation", f"{checkpoint}/checkpoint").trigger(**trigger).start()


def isolated(batch: DataFrame, outcome: Column, done: str, failed: str, number: int) -> None:
    """Write the rows of a batch whose ``outcome`` (a problem, or null) is null below ``done`` and the
    others, with it, below ``failed``: one bad file does not hold up the rest. Writing a batch
    again replaces it."""
    judged = batch.withColumn("problem", outcome)
    judged.where("problem IS NULL").drop("problem").write.mode("overwrite").parquet(f"{done}/batch={number}")
    judged.where("problem IS NOT NULL").write.mode("overwrite").parquet(f"{failed}/batch={number}")


def archive_file(spark: SparkSession, path: str, folder: str | None) -> None:
    """After success: move a file into an archive folder, or delete it where none is named. A file
    already there is not replaced."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source = hadoop(path)
    system = source.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if folder is None:
        system.delete(source, False)
        return
    target = hadoop(f"{folder.rstrip('/')}/{path.rpartition('/')[2]}")
    if system.exists(target):
        raise FileExistsError(str(target))
    system.mkdirs(hadoop(folder))
    if not system.rename(source, target):
        raise OSError(f"{path} cannot be moved to {folder}")


def watched_events(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, n, failed): events through the watcher, unreadable ones set aside."""
    work = work_folder(spark, "watched")
    schema = spark.read.parquet(path).schema
    parent, name = _watched(spark, path)
    problem = F.when(F.col("event_type") == "error", "unreadable")
    watch(spark, parent, schema, lambda b, n: isolated(b, problem, f"{work}/done", f"{work}/failed", n), work, name, retries=1).awaitTermination()
    done, failed = (spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{work}/{x}") for x in ("done", "failed"))
    both = done.select("user_id", F.lit(0).alias("f")).unionByName(failed.select("user_id", F.lit(1).alias("f")))
    return both.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("f").cast("long").alias("failed"))


def ingest_events(spark: SparkSession, path: str) -> DataFrame:
    """Events as the folder watcher files them, under the year and month they carry."""
    work = work_folder(spark, "folder")
    schema = spark.read.parquet(path).schema
    parent, name = _watched(spark, path)

    def process(batch: DataFrame, number: int) -> None:
        batch.withColumn("folder", F.date_format("ts", "yyyy/MM")).write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    running = watch(spark, parent, schema, process, work, name)
    running.awaitTermination()
    return spark.read.parquet(f"{work}/out").drop("batch")


def suppress_repeats(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, window: int = 5) -> Iterator[pd.DataFrame]:
    """Messages of a logger without those among its last ``window`` shown; carries the window
    and the number held back from batch to batch."""
    recent, held = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    shown = []
    for at, message in zip(rows["event_id"], rows["message"], strict=True):
        if message in recent:
            held += 1
            continue
        if held:
            shown.append((key[0], at, f"(suppressed {held} repeated lines)"))
            recent, held = [], 0
        shown.append((key[0], at, message))
        recent = [*recent, message][-window:]
    state.update((recent, held))
    yield pd.DataFrame(shown, columns=["user_id", "event_id", "message"])


def dedupe_stream(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, event_id, message): the log of each user as it is shown."""
    work = work_folder(spark, "folder")
    schema = spark.read.parquet(path).schema
    parent, name = _watched(spark, path)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", True).parquet(parent)
    shown = (
        stream.select("user_id", "event_id", "ts", F.col("event_type").alias("message"))
        .groupBy("user_id")
        .applyInPandasWithState(
            suppress_repeats, "user_id long, event_id long, message string", "recent array<string>, held int", "append",
            GroupStateTimeout.NoTimeout,
        )
    )
    query = (
        shown.writeStream.format("parquet").outputMode("append").option("path", f"{work}/out")
        .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema("user_id long, event_id long, message string").parquet(f"{work}/out")
