"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item of q distinct shingles lies in a document if the document holds at least a share t of
them, so it misses at most (1 - t) q. Items are partitioned by size, a power of two to a class.
Each class has its own index: its items' k smallest shingle hashes, where k exceeds what an item
of the class may miss by HITS, and its own threshold, the hits of one item that a document needs
to be a candidate. Any document that contains the item holds that many hashes of its signature:
the search loses nothing, however long the document, and documents need no signature of their
own. Candidates are checked on the shingles themselves. DataFrame expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, let, materialise, row_key, words_of

#: Hits of one item's signature that make a document a candidate, where the item is large enough.
HITS = 3


def plain_words(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return words_of(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _runs(words: Column, k: int, make) -> Column:
    """make(the k words from i on) for every i; none where there are fewer words."""
    return F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: make([F.get(words, i + j) for j in range(k)])),
    ).otherwise(F.array())


def shingle_hashes(words: Column, k: int) -> Column:
    return F.array_distinct(_runs(words, k, lambda w: F.xxhash64(*w)).cast("array<long>"))


def shingle_texts(words: Column, k: int) -> Column:
    return F.array_distinct(_runs(words, k, lambda w: F.concat_ws(" ", *w)).cast("array<string>"))


def item_shingles(items: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """(item, width, hashes, texts, q): items of fewer than k words are one shingle of all."""
    words = F.col("_w")
    width = F.least(F.lit(k), F.size(words))

    def by_width(make) -> Column:
        out = make(words, k)
        for short in range(1, k):
            out = F.when(F.size(words) == short, make(words, short)).otherwise(out)
        return out

    return (
        items.select(F.col(item_col).alias("item_id"), plain_words(F.col(text_col)).alias("_w"))
        .where(F.size("_w") > 0)
        .select(
            "item_id", width.alias("width"), by_width(shingle_hashes).alias("hashes"), by_width(shingle_texts).alias("texts")
        )
        .withColumn("q", F.size("texts"))
    )


def signatures(shingled: DataFrame, threshold: float) -> DataFrame:
    """(size_class, need, item_id, width, h): the index of every size class, which ends at a
    power of two. An item's signature has ``need`` hashes more than an item of its class may
    miss, less one; a small item's is all of its hashes, and it needs what it cannot miss."""
    size_class = F.ceil(F.log2(F.col("q").cast("double")))
    missed = F.floor(F.pow(F.lit(2.0), size_class) * (1 - threshold) + 1e-9).cast("int")
    k = F.least(F.col("q"), missed + HITS)
    own = F.floor(F.col("q") * (1 - threshold) + 1e-9).cast("int")
    return shingled.select(
        size_class.alias("size_class"), F.greatest(F.lit(1), k - F.least(own, missed)).alias("need"), "item_id", "width",
        F.explode(F.slice(F.array_sort("hashes"), F.lit(1), k)).alias("h"),
    )


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, _key, item_id, n_shingles, n_shared, containment) for every document row and item
    of which it holds a share of ``threshold`` or more of the distinct word shingles.

    Words are runs of letters and digits in lower case. Items without a word (null, empty)
    are contained nowhere; items of fewer words than a shingle are one shingle. Null and
    empty documents contain nothing. Repeated rows give repeated results; texts of any length are
    searched whole; other columns of either table are not read. _key is the row key of (id, text)
    by which rows of ``docs`` can be told apart.
    """
    shingled = materialise(item_shingles(items.dropDuplicates([item_col, item_text_col]), item_col, item_text_col, shingle), "items")
    wanted = materialise(signatures(shingled, threshold), "signatures")
    # at most ``shingle`` rows: the widths that items have
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())
    keyed = docs.select(F.col(id_col), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("_key"))
    if not widths:
        return keyed.where("false").select(
            id_col, "_key", F.lit(None).cast(items.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("n_shingles"),
            F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment"),
        )
    signs = broadcast_if_small(wanted)
    probes = None
    for k in widths:
        hashes = let(plain_words(F.col("_text")), lambda w: shingle_hashes(w, k))  # noqa: B023
        part = keyed.select(id_col, "_key", F.lit(k).alias("width"), F.explode(hashes).alias("h"))
        probes = part if probes is None else probes.unionByName(part)
    hits = probes.join(signs, ["width", "h"]).groupBy(F.col(id_col).alias("_id"), "_key", "item_id", "size_class", "need")
    candidates = hits.agg(F.count("*").alias("hits")).where("hits >= need").select("_id", "_key", "item_id")
    candidates = materialise(candidates, "candidates")
    same = keyed["_key"].eqNullSafe(candidates["_key"]) & keyed[id_col].eqNullSafe(candidates["_id"])
    met = keyed.join(broadcast_if_small(candidates), same).select(keyed[id_col], keyed["_key"], "item_id", "_text")
    full = met.join(broadcast_if_small(shingled.select("item_id", "width", "texts", "q")), "item_id")

    def shared(words: Column) -> Column:
        texts = shingle_texts(words, shingle)
        for k in range(1, shingle):
            texts = F.when(F.col("width") == k, shingle_texts(words, k)).otherwise(texts)
        return F.size(F.array_intersect(F.col("texts"), texts))

    return (
        full.withColumn("n_shared", let(plain_words(F.col("_text")), shared))
        .withColumn("containment", F.col("n_shared") / F.col("q"))
        .where(F.col("n_shared") >= F.lit(threshold) * F.col("q") - 1e-9)
        .select(id_col, "_key", "item_id", F.col("q").alias("n_shingles"), "n_shared", "containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns as they were, whatever their names."""
    found = contaminated(docs, items, id_col=id_col, text_col=text_col, **options)
    found = materialise(found.select(F.col(id_col).alias("_id"), "_key").distinct(), "contaminated")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    bare = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"), row)
    same = F.xxhash64("i", "t").eqNullSafe(found["_key"]) & F.col("i").eqNullSafe(found["_id"])
    return bare.join(broadcast_if_small(found), same, "left_anti").select("row.*")
