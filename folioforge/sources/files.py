"""Bounded sources: files by content, folders by pattern, words as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction


def read_folder(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.load(path)


def signature_version(content: Column) -> Column:
    """Version after the signature in the first 1024 bytes; empty if there is none."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.regexp_extract(head, r"%PDF-(\d\.\d)", 1)


def route(content: Column) -> Column:
    return F.when(signature_version(content) != "", "pdf").otherwise("image")


def save_options(kind: str) -> dict[str, bool | str]:
    """Writer settings by output kind: the oldest archive standard forbids object streams."""
    old = kind.endswith("pdfa-1")
    return {"compress_streams": True, "object_streams": "disable" if old else "generate", "preserve_metadata": True}


class _Words:
    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(text.split(" "))


def page_words() -> UserDefinedTableFunction:
    """Table function (place, word) of a text."""
    return F.udtf(_Words, returnType="place int, word string", useArrow=True)


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_words", page_words())


def manifest_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of a column of JSON objects; lines that are none are left out."""
    read = lines.select(F.from_json(column, schema).alias("_m"), F.json_object_keys(column).alias("_k"))
    return read.where(F.col("_k").isNotNull()).select("_m.*")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest file, one JSON object a line."""
    return manifest_lines(spark.read.text(path), "value", schema)


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, kind, version) of all files below a folder, told apart by content. A
    path without any file is an error at once, not an empty result."""
    found = read_folder(spark, path, pattern)
    if found.select("path").isEmpty():
        raise FileNotFoundError(path)
    return found.select("path", "length", "content", route(F.col("content")).alias("kind"), signature_version(F.col("content")).alias("version"))


def write_results(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """Results as Parquet; what is there already is not overwritten unless told so."""
    results.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
