"""Token counts through a digest cache: only contents that were never counted are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenize
from .common import discard, materialise, shared_folder

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def read_cache(spark, path: str) -> DataFrame:
    """The cache table; empty where nothing has been stored yet. Entries that two writers
    stored at once count once."""
    try:
        table = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    return table.groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Contents are normalised as the vocabulary itself would: a null text is the empty text and
    nothing else changes, so the digest is SHA-256 of the UTF-8 bytes; the version is SHA-256
    of the vocabulary file. Digests that the cache at ``cache_path`` does not hold are encoded
    once each, however many rows share them, and appended.
    By default the cache is ``folioforge/token-counts`` in the shared folder; it lasts, so a later
    run over the same contents encodes nothing. Digests meet by partial aggregation, so a text
    that a third of all rows share does not meet itself. A cached result of another vocabulary is
    never used. Very long texts are encoded whole; other columns are not read. Repeated rows
    give repeated results; an empty table gives none and stores none.
    """
    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_folder(spark)}/folioforge/token-counts"
    version = tokenize.file_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("_text"),
    )
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
    # of the rows of a digest one is named by numbers alone, before any text moves
    chosen = keyed.select("digest", F.xxhash64(id_col).alias("of")).groupBy("digest").agg(F.min("of").alias("of"))
    chosen = materialise(chosen.join(stored, "digest", "left_anti"), "uncounted")
    one = keyed.select("digest", F.xxhash64(id_col).alias("of"), "_text")
    misses = one.join(chosen, ["digest", "of"], "left_semi").select("digest", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, done = tokenize.counter(tokenizer_path), set()
        for batch in batches:
            new = [i for i, d in enumerate(batch.column(0).to_pylist()) if not (d in done or done.add(d))]
            n = pa.array([count(batch.column(1)[i].as_py()) for i in new], pa.int64())
            tag = pa.array([version] * len(new), pa.string())
            digests = batch.column(0).take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([digests, tag, n], names=["digest", "tokenizer", "n_tokens"])

    if not chosen.isEmpty():
        counted = misses.mapInArrow(encode, CACHE_SCHEMA)
        # rows equal in id and text may have gone to several tasks
        counted.dropDuplicates(["digest"]).write.mode("append").parquet(cache_path)
    discard(chosen)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    return keyed.join(counts, "digest", "left").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
