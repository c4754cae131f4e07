"""Literal cases of the rules of pages, ranges and logs."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folioforge.functions import numbers, text
from folioforge.operators import assembly, pages
from folioforge.plans import catalogue


@pytest.mark.parametrize(
    ("spec", "total", "want"),
    [
        ("1", 9, [0]), ("1-3", 9, [0, 1, 2]), ("2,5,6", 9, [1, 4, 5]), (",,3", 9, [2]), ("3, 3, 3,", 9, [2]), ("end", 10, [9]),
        ("1-END", 3, [0, 1, 2]), ("2-4,end", 10, [1, 2, 3, 9]), ("-1", 9, None), ("1-0", 9, None), ("0-0", 9, None), (",", 9, None),
        ("start-end", 9, None), ("end-1", 5, None),
    ],
)
def test_page_ranges(spark, spec, total, want):
    row = spark.range(1).select(text.page_ranges(F.lit(spec), F.lit(total)).alias("p")).first()["p"]
    assert row["pages"] == want and (row["status"] is None) == (want is not None)


def test_compress_ranges(spark):
    rows = [(1, i, x) for i, x in enumerate(["x", "", "", "y", "", "", "", "z"])]
    out = assembly.compress_ranges(spark.createDataFrame(rows, "d int, i int, t string"), ["d"], "i", "t")
    assert sorted((r["first"], r["last"], r["item"]) for r in out.collect()) == [(1, 1, "x"), (2, 3, None), (4, 4, "y"), (5, 7, None), (8, 8, "z")]


def test_images_shrink_within_limits(spark):
    size = lambda *a: tuple(spark.range(1).select(numbers.fit_image(F.lit(100), F.lit(100), F.lit(4), *a).alias("s")).first()["s"])
    big = 10**9
    assert size(50, 50, big, big) == size(big, big, 2500, big) == size(big, big, big, 10000) == (50, 50)
    assert size(big, big, big, 100000) == (100, 100)


def test_log_window(spark):
    log = F.array(*[F.lit(m) for m in ("a", "a", "b", "a", "c")])
    shown = spark.range(1).select(assembly.dedupe_messages(log).alias("m")).first()["m"]
    assert shown == ["a", "(suppressed 1 repeated lines)", "b", "a", "c"]


def test_all_jpeg(spark):
    kinds = lambda *k: F.array(*[F.lit(x) for x in k]).cast("array<string>")
    ask = lambda *k: spark.range(1).select(pages.all_of_kind(kinds(*k), pages.JPEG_KINDS)).first()[0]
    assert [ask(), ask("jpeg"), ask("jpeg", "flate_jpeg"), ask("jpeg", "flate")] == [False, True, True, False]


def test_all_words_of_a_text_are_parsed(spark, tmp_path):
    texts = {1: " ".join(f"wort{chr(97 + i % 26)}" for i in range(300)), 2: "eins, zwei 3 drei", 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["node"], r["word"], r["x0"]) for r in catalogue.queries()["hocr_parse_whole"](spark, str(tmp_path)).collect()}
    words = {k: re.findall(r"[^\W\d_]+", t or "") for k, t in texts.items()}
    assert got == {(k, f"word_{i}", w, 10.0 * (i + 1)) for k, ws in words.items() for i, w in enumerate(ws)}


def test_whole_texts_are_reversed(spark, tmp_path):
    texts = {1: "x" * 30 + "abc", 2: "שלום עולם " * 9 + "e\u0301", 3: "", 4: "x" * 30 + "abd"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["turned"] for r in catalogue.queries()["script_direction_whole"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(t[::-1].encode()).hexdigest() for k, t in texts.items()}
