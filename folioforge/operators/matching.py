"""Joins and set operations that document processing hides in loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quality_words


def truncated_copies(
    damaged: DataFrame, originals: DataFrame, signature: list[str], content: str, id_col: str, most: int = 15
) -> DataFrame:
    """(id, original): for each damaged value the first original of the same signature of which
    it is all but the last 1 to ``most`` characters.

    A damaged value of length n is a prefix of an original of length n + 1 .. n + most, so the
    join is on the signature and the hash of that many characters: one key for each possible
    loss, never all pairs of a signature. Equal nulls in the signature match.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_s{i}") for i, c in enumerate(signature)]
    names = [f"_s{i}" for i in range(len(signature))]
    cut = F.explode(F.sequence(F.lit(1), F.lit(most)))
    prefix = F.xxhash64(F.expr("substring(_full, 1, length(_full) - _cut)")).alias("_h")
    longer = originals.select(F.col(id_col).alias("_o"), F.col(content).alias("_full"), *keys, cut.alias("_cut"))
    longer = longer.where(F.length("_full") >= F.col("_cut")).select("_o", *names, prefix)  # keys move, texts stay
    short = damaged.select(F.col(id_col), F.col(content).alias("_short"), *keys, F.xxhash64(content).alias("_h"))
    met = short.drop("_short").join(longer, [*names, "_h"]).select(id_col, "_o")
    texts = damaged.select(F.col(id_col), F.col(content).alias("_short"))
    met = met.join(texts, id_col).join(originals.select(F.col(id_col).alias("_o"), F.col(content).alias("_full")), "_o")
    return met.where(F.startswith("_full", F.col("_short"))).groupBy(id_col).agg(F.min("_o").alias("original"))


def dangling(links: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """Links without a target."""
    return links.join(targets, on, "left_anti")


def with_checkpoint(pages: DataFrame, done: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Every page with what a checkpoint has of it, or the defaults; found tells which."""
    joined = pages.join(done.withColumn("found", F.lit(True)), on, "left")
    columns = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()]
    return joined.select(*pages.columns, *columns, F.coalesce("found", F.lit(False)).alias("found"))


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """Value of a short fixed table, or the default."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def first_covering(words: DataFrame, word: str, fonts: list[tuple[str, str]], fallback: str) -> DataFrame:
    """``words`` with font: the first of the fonts, in order, that has all characters of a
    word."""
    chosen = F.lit(fallback)
    for name, characters in reversed(fonts):
        have = F.array(*[F.lit(c) for c in characters])
        covered = F.size(F.array_except(F.array_distinct(F.split(F.col(word), "")), have)) == 0
        chosen = F.when(covered, name).otherwise(chosen)
    return words.withColumn("font", chosen)


def dictionary_share(docs: DataFrame, id_col: str, text_col: str, dictionary: DataFrame) -> DataFrame:
    """(id, words, matched, share): how many of a text's distinct words a dictionary (word) has, as
    they are or in lower case; a text without words has a share of 0. Two equi joins, not one on
    either form; whether the dictionary is broadcast is left to its size at run time."""
    words = docs.select(id_col, F.explode_outer(quality_words(F.col(text_col))).alias("word"))
    as_is = dictionary.select("word", F.lit(True).alias("_as_is"))
    lower = dictionary.select(F.col("word").alias("_low"), F.lit(True).alias("_lower"))
    met = words.withColumn("_low", F.lower("word")).join(as_is, "word", "left").join(lower, "_low", "left")
    hit = F.coalesce("_as_is", "_lower", F.lit(False))
    out = met.groupBy(id_col).agg(F.count("word").alias("words"), F.count_if(hit).alias("matched"))
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("words")), F.lit(0.0)))


def union_scans(scans: list[DataFrame]) -> DataFrame:
    """All rows of several scans of one shape."""
    return reduce(DataFrame.unionByName, scans)


def override(base: Column, own: Column) -> Column:
    """A map in which filled entries of ``own`` replace those of ``base``."""
    filled = F.map_filter(own, lambda _, v: v.isNotNull() & (v != ""))
    rest = F.map_filter(base, lambda k, _: ~F.map_contains_key(filled, k))
    return F.map_concat(rest, filled)


def without_entries(held: Column, new: Column, keep: list[str]) -> Column:
    """Entries of a map that go: neither in ``new`` nor named in ``keep``, sorted by name."""
    return F.array_sort(F.array_except(F.array_except(F.map_keys(held), F.map_keys(new)), F.array(*[F.lit(k) for k in keep])))


def merged_properties(original: Column, output: Column, given: Column) -> Column:
    """Struct (properties, lost) of a document: what the output has, what the original had besides
    and the given ones; given ones that are empty are taken out, and are not lost."""
    filled = F.map_filter(given, lambda _, v: v != "")
    removed = F.map_filter(given, lambda _, v: v == "")
    base = override(original, output)
    kept = F.map_filter(override(base, filled), lambda k, _: ~F.map_contains_key(removed, k))
    lost = F.array_sort(F.array_except(F.array_except(F.map_keys(original), F.map_keys(output)), F.map_keys(removed)))
    return F.struct(kept.alias("properties"), lost.alias("lost"))


def graft(pages: DataFrame, layers: DataFrame, on: list[str]) -> DataFrame:
    """Every page with its text layer, where it has one; ``grafted`` tells. A layer without a page
    is an error of the caller and is left out."""
    return pages.join(layers.withColumn("grafted", F.lit(True)), on, "left").withColumn("grafted", F.coalesce("grafted", F.lit(False)))


def looked_up(rows: DataFrame, key: str, table: DataFrame, code: str, name: str, default: str) -> DataFrame:
    """``rows`` with ``name``: what a table of codes, given as data, has for each key, or the default.
    Repeated codes of the table count once; whether it is broadcast is left to its size at run
    time."""
    known = table.groupBy(F.col(code).alias("_code")).agg(F.min(name).alias("_name"))
    joined = rows.join(known, F.col(key) == F.col("_code"), "left")
    return joined.select(*rows.columns, F.coalesce("_name", F.lit(default)).alias(name))


def in_order_of_trial(first: Column, more: Column) -> Column:
    """Two lists one after another, each name where it comes first."""
    return F.array_distinct(F.concat(first, more))
