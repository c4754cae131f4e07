"""Literal cases of the rules: boxes, titles, stacks, inks, text quality, files, hooks, folders."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioforge.functions import boxes, numbers, text
from folioforge.operators import assembly, engines, folds, matching, options, pages
from folioforge.plans import catalogue
from folioforge.sources import content, files, recognised
from folioforge.streaming import folder


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("spec", "total", "want"),
    [
        ("11-15, 18, ", 99, [10, 11, 12, 13, 14, 17]), ("3, 2, 1, 42", 99, [2, 1, 0, 41]), ("3-end", 5, [2, 3, 4]), ("end-end", 7, [6]),
        ("1,end", 4, [0, 3]), ("end,end,end", 5, [4]), ("1,3,-11", 99, None), ("1-,", 99, None), ("99-98", 99, None), ("1-0,3-4", 99, None), ("", 99, None),
        ("end", None, None), ("2000000000-2000000001", 5, []),
    ],
)
def test_more_page_ranges(spark, spec, total, want):
    got = one(spark, text.page_ranges(F.lit(spec), F.lit(total).cast("int")))
    assert got["pages"] == want


def test_wide_page_ranges_are_cut(spark):
    got = one(spark, text.page_ranges(F.lit("1-2000000000"), F.lit(10), most=50))
    assert got["pages"] == list(range(50))


@pytest.mark.parametrize(
    ("media", "sub", "box", "media_kinds", "kinds"),
    [
        ("0 792 612 0", "0 0 612 792", [0, 0, 612, 792], ["reordered"], []),
        ("0 0 612 792", "1000 1000 1500 1500", None, [], ["discarded"]),
        ("0 0 612 792", "200 200 800 900", [200, 200, 612, 792], [], ["clamped"]),
        ("0 0 612 792", "800 900 200 200", [200, 200, 612, 792], [], ["reordered", "clamped"]),
        ("0 0 612 792", "3.05175781e-005 0 612 792", [3.05175781e-005, 0, 612, 792], [], ["recoded"]),
        ("0 0 0 792", "700 0 10 10", [10, 0, 700, 10], ["degenerate_mediabox"], ["reordered"]),
        ("0 0 612 792", "0 0 612 792", [0, 0, 612, 792], [], []),
        ("0 0 612 792", "0 0 x 792", None, [], []),
    ],
)
def test_box_repairs(spark, media, sub, box, media_kinds, kinds):
    got = one(spark, boxes.repairs(*[F.array(*map(F.lit, x.split())) for x in (media, sub)]))
    assert (list(got["box"]) if got["box"] else None, got["media_kinds"], got["kinds"]) == (box, media_kinds, kinds)


def test_title_fields(spark):
    title = lambda f, t: one(spark, f(F.lit(t)))
    font = title(text.title_font, "x_font Times New; x_fsize .5")
    assert (font["name"], font["size"]) == ("Times", 0.5) and title(text.title_font, "bbox 1 2 3 4") is None
    assert title(text.title_resolution, "scan_res 300 400") == 300.0 and title(text.title_resolution, "scan_res 300") is None
    assert title(text.title_angle, "bbox 1 2 3 4; textangle 5.5") == 5.5 and title(text.title_confidence, "x_wconf 95.5") == 0.95


@pytest.mark.parametrize(
    ("words", "rtl", "cjk"),
    [("", False, True), ("abc", False, False), ("12 שלום", True, False), ("(مرحبا) a", True, False), ("ܐܒ", True, False), ("ދިވެހި", True, False),
     ("ߒߞߏ", True, False), ("a שלום", False, False), ("‏a", True, False), ("漢字", False, True), ("\U00020000", False, True), ("ㄅ", False, False), ("漢 a", False, False)],
)
def test_directions_of_writing(spark, words, rtl, cjk):
    assert one(spark, text.reads_right_to_left(F.lit(words))) is rtl and one(spark, text.only_cjk(F.lit(words))) is cjk


def test_share_of_dictionary_words(spark):
    dictionary = spark.createDataFrame([(w,) for w in ("words", "quick", "brown", "fox", "lazy", "dog")], "word string")
    rows = [(1, "The quick brown fox jumps quickly over the lazy dog"), (2, "12345 10% _f  7fox -brown   | words"), (3, "quick quick quick"), (4, ""), (5, "12 a"), (6, None)]
    got = {r["id"]: r["share"] for r in matching.dictionary_share(spark.createDataFrame(rows, "id int, t string"), "id", "t", dictionary).collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 0.0}


@pytest.mark.parametrize(
    ("stream", "status", "deepest"),
    [("q " * 35, "deep stack", 35), ("q Q Q Q Q", "stack underflow", 1), ("q " * 135, "stack overflow, deep stack", 135), ("q Q", "", 1), ("", "", 0), (None, "", 0)],
)
def test_stacks_of_streams(stream, status, deepest):
    _, _, said, depth = content.markers(stream)
    assert (said, depth) == (status, deepest)


@pytest.mark.parametrize(
    ("ops", "ink"),
    [("0 0 9 9 re f", "mono"), ("0.3 0.3 0.3 rg 0 0 9 9 re f", "gray"), ("0.5 g f", "gray"), ("0 g f", "mono"), ("0.8 0.2 0.2 rg f", "color"),
     ("0 0 0 0.5 k f", "gray"), ("0.5 0.1 0 0 k f", "color"), ("q 0.8 0.2 0.2 rg Q f", "mono"), ("/P scn f", "color"), ("0.8 0.2 0.2 rg", "mono")],
)
def test_inks_of_streams(ops, ink):
    assert content.markers(ops)[1] == ink


def test_streams_as_tables(spark):
    stream = "q 2 0 0 3 5 7 cm /Im1 Do Q % note (\nBT /F1 12 Tf 3 Tr (a (b) \\) c) Tj [(x) -20 (y)] TJ ET <</A [1 2]>> gs BI /W 2 ID \x00 Q EI f"
    pages_ = spark.createDataFrame([(1, stream), (2, None)], "page int, s string")
    ops = [r["operator"] for r in content.content_operators(pages_, "page", "s").orderBy("place").collect()]
    assert ops == ["q", "cm", "Do", "Q", "BT", "Tf", "Tr", "Tj", "TJ", "ET", "gs", "INLINE IMAGE", "f"]
    marks = content.content_markers(pages_, "page", "s").orderBy("place").collect()
    assert [(m["kind"], m["name"], m["depth"]) for m in marks] == [("object", "Im1", 1), ("hidden text", None, 0), ("hidden text", None, 0), ("inline", None, 0), ("vector", None, 0)]
    assert (marks[0]["a"], marks[0]["d"], marks[0]["e"], marks[0]["f"]) == (2, 3, 5, 7)


def test_nested_states_fold_as_one_by_one(spark):
    rows = [(1, i, "push" if i % 2 == 0 else "move") for i in range(400)] + [(1, 400 + i, "pop") for i in range(100)] + [(1, 900, "draw"), (2, 0, "pop"), (2, 1, "draw")]
    t = spark.createDataFrame(rows, "k int, i int, op string").select("*", *[F.lit(v).alias(c) for c, v in zip("abcdef", (1.0, 0.0, 0.0, 1.0, 1.0, 0.0), strict=True)])
    got = {r["k"]: (r["draws"], r["deepest"], r["status"], r["e"]) for r in folds.graphics_states(t, ["k"], ["i"]).collect()}
    assert got == {1: (1, 200, "stack overflow, deep stack", 100.0), 2: (1, 0, "stack underflow", 0.0)}


def brute_log(messages, window=5):
    shown, recent, held = [], [], 0
    for m in messages:
        if m in recent:
            held += 1
            continue
        if held:
            shown.append(f"(suppressed {held} repeated lines)")
            recent, held = [], 0
        shown.append(m)
        recent = (recent + [m])[-window:]
    return shown


def test_logs_are_shown_as_one_by_one(spark):
    r = random.Random(2)
    rows = [(k, i, r.choice("abcdefgh")) for k in range(5) for i in range(300)]
    out = folds.shown_messages(spark.createDataFrame(rows, "k int, i int, m string").repartition(4), "k", ["i"], "m").collect()
    arrays = spark.createDataFrame([(k, [m for j, _, m in rows if j == k]) for k in range(5)], "k int, m array<string>")
    folded = {x["k"]: x["s"] for x in arrays.select("k", assembly.dedupe_messages(F.col("m")).alias("s")).collect()}
    for k in range(5):
        want = brute_log([m for j, _, m in rows if j == k])
        assert [x["message"] for x in sorted((x for x in out if x["k"] == k), key=lambda x: x["place"])] == want == folded[k]


def test_streamed_log_is_the_folded_one(spark, tmp_path):
    rows = [(k, 100 * k + i, "abcdefg"[(i * i + k) % 7], "{}", 1.0) for k in range(3) for i in range(80)]
    t = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, props string, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    t.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = folder.dedupe_stream(spark, f"{tmp_path}/events.parquet").collect()
    for k in range(3):
        shown = [x["message"] for x in sorted((x for x in got if x["user_id"] == k), key=lambda x: (x["event_id"], not x["message"].startswith("(")))]
        assert shown == brute_log([m for j, _, m, *_ in rows if j == k])


def test_markup_that_cannot_be_read(spark):
    page = "<div class='ocr_page' title='bbox 0 0 9 9'>{}</div>"
    rows = [(1, "<a"), (2, "<div/>"), (3, "<div class='ocr_page' title='x'/>"), (4, page.format("<b>" * 3000 + "</b>" * 3000)), (5, None),
            (6, page.format("<span class='ocr_line' title='bbox 0 0 1 1'><span class='ocrx_word'>ﬁ x<i>y</i></span> z</span>"))]
    nodes = recognised.parse_nodes(spark.createDataFrame(rows, "id int, m string"), "id", "m")
    got = {(r["id"], r["status"]) for r in nodes.collect()}
    assert got == {(1, "not well formed"), (2, "no page"), (3, "page without box"), (4, None), (5, "not well formed"), (6, None)}
    assert [r["text"] for r in nodes.where("kind = 'ocrx_word'").collect()] == ["fi xy z"]
    assert recognised.lines(nodes).count() == 1 and recognised.first_of(nodes, ["id"], "ocrx_word", "ocr_line").first()["kind"] == "ocr_line"


def test_reachable_in_a_branching_graph(spark):
    edges = [(i, 100 * (i // 100 + 1) + j) for i in [*range(0, 1), *range(100, 106), *range(200, 206)] for j in range(6)] + [(205, 0), (300, 300)]
    out = assembly.reachable(spark, spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (300,)], "root long"))
    got = {(r["root"], r["id"]) for r in out.collect()}
    assert out.count() == len(got) and {i for r, i in got if r == 0} == {0, *range(100, 106), *range(200, 206), *range(300, 306)} and (300, 300) in got


def test_runs_meet_across_blocks(spark):
    numbers_ = [0, 1, 2, 9, 10, 11, 12, 19, 20, 33]
    t = spark.createDataFrame([(1, n) for n in numbers_ for _ in range(2)], "k int, n long")
    assert assembly.format_pages(t, ["k"], "n", block=10).first()["pages"] == "1-3, 10-13, 20-21, 34"


def test_turns_go_round_in_every_group(spark):
    t = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(100)], "i int, g string").repartition(5)
    out = pages.round_robin(t, [F.col("i")], 4, ["g"]).collect()
    for g in "ab":
        assert [r["worker"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["i"])] == [k % 4 for k in range(sum(r["g"] == g for r in out))]


def test_shell_words(spark):
    words = lambda x: one(spark, options.shell_words(F.lit(x)))
    assert words("--layout double -x") == ["--layout", "double", "-x"] and words("") == []
    assert words("a 'b c' d\\ e \"f \\\" g\"h") == ["a", "b c", "d e", 'f " gh']
    assert one(spark, options.names_a_file(F.array(F.lit(".."), F.lit("x")))) and not one(spark, options.names_a_file(F.array(F.lit("x"))))


def test_files_by_content(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.3\nx"), ("b.pdf", b"\xff" * 1020 + b"%PDF-1.7"), ("sub/c.pdf", b"\xff\x00%PDF-2.0 rest")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: (r["kind"], r["version"]) for r in files.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.pdf": ("pdf", "1.3"), "b.pdf": ("image", ""), "c.pdf": ("pdf", "2.0")}
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        files.read_documents(spark, str(tmp_path / "empty"))
    (tmp_path / "m.jsonl").write_text('{"a": 1, "b": "x"}\nbroken\n{"a": null}\n')
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.jsonl"), "a int, b string").collect()] == [(1, "x"), (None, None)]
    files.write_results(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_results(spark.range(3), str(tmp_path / "out"))


def test_one_bad_file_does_not_hold_up_the_rest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.txt").write_text("bad" if i == 2 else f"page {i}")
    problem, tried = F.when(F.col("value") == "bad", "unreadable"), []

    def process(batch, number):
        tried.append(number)
        if len(tried) == 1:
            raise OSError("not ready yet")
        folder.isolated(batch, problem, f"{tmp_path}/done", f"{tmp_path}/failed", number)

    folder.watch(spark, str(tmp_path / "in"), "value string", process, str(tmp_path / "work"), "*.txt", "text", retries=2).awaitTermination()
    assert len(tried) >= 2 and spark.read.parquet(f"{tmp_path}/done").count() == 3
    assert [r["problem"] for r in spark.read.parquet(f"{tmp_path}/failed").collect()] == ["unreadable"]
    with pytest.raises(ValueError):
        folder.watch(spark, str(tmp_path / "in"), "value string", process, str(tmp_path / "in/work"))
    folder.archive_file(spark, str(tmp_path / "in/0.txt"), str(tmp_path / "old"))
    folder.archive_file(spark, str(tmp_path / "in/1.txt"), None)
    assert (tmp_path / "old/0.txt").exists() and not (tmp_path / "in/0.txt").exists() and not (tmp_path / "in/1.txt").exists()
    (tmp_path / "in" / "0.txt").write_text("again")
    with pytest.raises(FileExistsError):
        folder.archive_file(spark, str(tmp_path / "in/0.txt"), str(tmp_path / "old"))


def test_hooks_in_batches(spark):
    hooks = engines.Hooks()
    t = spark.createDataFrame([(1, 1, b"b"), (1, 0, b"a"), (2, 0, b"c" * 99)], "doc_id long, pageno int, data binary")
    with pytest.raises(LookupError):
        engines.rasterised(t, hooks)
    with pytest.raises(ValueError):
        hooks.register("no such hook", print)
    assert engines.filtered(t, hooks, "filter_page") is t

    def raster(batches):
        for p in batches:
            yield p.assign(image=[bytes(x) * 2 for x in p["data"]])

    def join(p):
        return p.groupby("doc_id", as_index=False).agg({"data": lambda x: b"".join(map(bytes, x))})

    hooks.register("rasterise_page", raster)
    hooks.register("archive", join)
    assert sorted(bytes(r["image"])[:2] for r in engines.rasterised(t, hooks).collect()) == [b"aa", b"bb", b"cc"]
    whole = {r["doc_id"]: bytes(r["data"]) for r in engines.per_document(t, hooks, "archive", "doc_id long, data binary").collect()}
    assert whole == {1: b"ab", 2: b"c" * 99}
    hooks.register("check_options", lambda o: ["a"] if o.get("x") else [])
    hooks.register("check_options", lambda o: ["b"])
    assert engines.checked(hooks, {"x": 1}) == ["b", "a"]
    hooks.register("register_options", lambda: {"one": {"a": 1}})
    hooks.register("register_options", lambda: {"one": {"b": 2}, "two": {}})
    assert engines.registered_options(hooks) == {"one": {"a": 1, "b": 2}, "two": {}}
    small = [bytes(r["d"]) for r in t.select(engines.deflated("data").alias("d")).collect()]
    assert sorted(map(len, small))[:2] == [1, 1] and any(len(x) < 99 and zlib.decompress(x) == b"c" * 99 for x in small if len(x) > 1)


def test_small_rules(spark):
    assert one(spark, numbers.smallest({"kept": F.lit(5), "jpeg": F.lit(5), "png": F.lit(None).cast("int")})) == "kept"
    m = one(spark, boxes.layer_matrix(F.lit(100.0), F.lit(200.0), F.lit(100.0), F.lit(200.0), F.lit(0.0), F.lit(0.0), F.lit(0)))
    assert m is None
    turned = one(spark, boxes.layer_matrix(F.lit(200.0), F.lit(100.0), F.lit(100.0), F.lit(200.0), F.lit(5.0), F.lit(7.0), F.lit(90)))
    corner = lambda x, y: (x * turned["a"] + y * turned["c"] + turned["e"], x * turned["b"] + y * turned["d"] + turned["f"])
    assert corner(0, 0) == (5.0, 207.0) and corner(200, 100) == (105.0, 7.0)
    assert one(spark, pages.messages_fine(F.array(F.lit("x " + pages.BENIGN)))) and not one(spark, pages.messages_fine(F.array(F.lit("odd"))))
    assert one(spark, text.ascii85(F.lit(b"abcd"))) == "<~@:E_W~>"


def test_queries_and_their_sql_go_together():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 95
