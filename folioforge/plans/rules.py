"""Registered queries of single rules: option checks, page and image arithmetic, reports, text.

The driver's tables play the rules' inputs; each query stands beside its DuckDB equivalent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, numbers, text
from ..operators import assembly, engines, folds, matching, options, pages
from ..sources import content, files, recognised
from .catalogue import LINE_ORDER, _r, _t, query

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _lines(spark, sf):
    return _t(spark, sf, "lineitem")


@query("""
SELECT c_custkey, strip, problem, sidecar, sidecar_problem, lossless, wide, warnings, combination FROM (
SELECT c_custkey,
  CASE WHEN m = 'strip' THEN concat_ws(',', CASE WHEN a THEN 'clean' END, CASE WHEN b THEN 'deskew' END, CASE WHEN c THEN 'rotate' END) ELSE '' END AS strip,
  CASE WHEN c_nationkey = 3 AND NOT a THEN 'cleaner arguments without cleaning' WHEN c_custkey % 5 <> 0 AND NOT c THEN 'rotation threshold without rotation' END AS problem,
  CASE WHEN c_custkey % 4 = 0 AND o IN ('-', '/dev/null') THEN NULL WHEN c_custkey % 4 = 0 THEN o || '.txt' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name END AS sidecar,
  CASE WHEN c_custkey % 4 = 0 AND o IN ('-', '/dev/null') THEN 'sidecar needs a name' WHEN c_custkey % 4 = 1 THEN 'sidecar is the output' END AS sidecar_problem,
  NOT (b OR a OR m = 'force') AS lossless,
  concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'jobs' END, CASE WHEN c_acctbal > 5000 THEN 'oversample' END, CASE WHEN c_nationkey > 2 THEN 'verbose' END) AS wide,
  CAST((CASE WHEN c_nationkey IN (0, 2) THEN 1 ELSE 0 END) + (CASE WHEN NOT c THEN 1 ELSE 0 END) + (CASE WHEN c_nationkey % 2 = 0 AND c_acctbal > 0 THEN 1 ELSE 0 END) AS INTEGER) AS warnings,
  CASE WHEN m = 'redo' AND (b OR a) THEN 'redo with image changes' WHEN c_custkey % 7 = 0 AND o NOT IN ('-', '/dev/null') THEN 'output file without output' END AS combination
FROM (SELECT *, c_mktsegment = 'BUILDING' AS a, c_nationkey % 2 = 0 AS b, c_nationkey % 3 = 0 AS c,
        CASE c_custkey % 5 WHEN 0 THEN 'strip' WHEN 1 THEN 'redo' WHEN 2 THEN 'force' ELSE 'default' END AS m,
        CASE c_custkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '/dev/null' ELSE c_name END AS o FROM customer))
""".replace("WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name END AS sidecar", "WHEN c_custkey % 4 = 1 THEN NULL ELSE 'notes' END AS sidecar"))
def option_problems(spark, sf):
    """P18, P19, P21, P30."""
    k, n, bal = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    clean, deskew, rotate = F.col("c_mktsegment") == "BUILDING", n % 2 == 0, n % 3 == 0
    mode = F.when(k % 5 == 0, "strip").when(k % 5 == 1, "redo").when(k % 5 == 2, "force").otherwise("default")
    output = F.when(k % 3 == 0, "-").when(k % 3 == 1, "/dev/null").otherwise(F.col("c_name"))
    arguments = F.when(n == 3, options.shell_words(F.lit("--layout 'one column'")))
    no = F.lit(False)
    side = options.sidecar_path(F.when(k % 4 == 0, "").when(k % 4 == 1, output).otherwise("notes"), output)
    warnings = options.engine_warnings(n, F.lit(100), rotate, F.when(n % 2 == 0, 0).otherwise(1), [bal])
    return _t(spark, sf, "customer").select(
        "c_custkey",
        F.array_join(options.strip_conflicts(mode, {"deskew": deskew, "clean": clean, "rotate": rotate}), ",").alias("strip"),
        options.preprocessing_problem(clean, no, arguments, rotate, F.when(k % 5 == 0, 14.0).otherwise(2.0)).alias("problem"),
        side["path"].alias("sidecar"), side["problem"].alias("sidecar_problem"),
        options.lossless(deskew, clean, mode, no).alias("lossless"),
        F.array_join(options.out_of_range({"oversample": F.greatest(bal, F.lit(0)), "jobs": F.when(bal < 0, -1).otherwise(1), "verbose": n}), ",").alias("wide"),
        F.size(warnings).alias("warnings"),
        options.combination_problem(mode, deskew, clean, no, F.when(k % 7 == 0, "none").otherwise("pdf"), output).alias("combination"),
    )


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'equ,osd' WHEN doc_id % 4 = 1 THEN 'osd' ELSE '' END AS reserved,
  concat_ws(',', CASE WHEN lang = 'es' THEN 'es' END, CASE WHEN doc_id % 4 = 2 THEN 'tlh' END) AS missing
FROM documents
""")
def language_check(spark, sf):
    """U2, C13, S11."""
    n = F.col("doc_id") % 4
    spec = F.concat(F.col("lang"), F.when(n == 0, "+osd+equ").when(n == 1, "+osd").when(n == 2, "+tlh").otherwise("+en"))
    have = text.language_list(F.lit("List of available languages (6):\n de\nen\nfr \nequ\nosd\nchi_sim\n"))
    found = options.language_problem(text.languages(spec), have)
    t = _t(spark, sf, "documents").withColumn("p", found)
    return t.select("doc_id", F.array_join("p.reserved", ",").alias("reserved"), F.array_join("p.missing", ",").alias("missing"))


@query("""
SELECT p_partkey, claims, CASE WHEN s = '' THEN 'No PDF/A metadata in XMP' ELSE 'PDF/A-' || lower(s) END AS conformance, claims OR p_size % 4 = 0 AS safe,
  CAST(CASE WHEN p_size % 9 = 0 THEN 0 WHEN p_size % 2 = 0 AND NOT claims THEN 10 WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 4 ELSE 0 END AS INTEGER) AS status
FROM (SELECT *, s IN ('1B', '2U', '3A') AS claims FROM (SELECT *, CASE p_size % 6 WHEN 0 THEN '1B' WHEN 1 THEN '2U' WHEN 2 THEN '3A' WHEN 3 THEN '4F' WHEN 4 THEN '' ELSE '1U' END AS s FROM part))
""")
def archive_status(spark, sf):
    """P15, P22, K8."""
    n = F.col("p_size")
    status = F.when(n % 6 == 0, "1B").when(n % 6 == 1, "2U").when(n % 6 == 2, "3A").when(n % 6 == 3, "4F").when(n % 6 == 4, "").otherwise("1U")
    messages = F.array_compact(F.array(F.when(n % 5 == 0, "page 3: ERROR in stream"), F.when(n % 7 == 0, "odd spacing"), F.concat(F.lit("page 1 "), F.lit(pages.BENIGN))))
    claim = pages.archive_claim(status)
    code = pages.final_status(F.when(n % 9 == 0, "-").otherwise("out.pdf"), F.when(n % 2 == 0, "pdfa-2").otherwise("pdf"), claim["claims"], pages.messages_fine(messages))
    return _t(spark, sf, "part").select("p_partkey", claim["claims"].alias("claims"), claim["conformance"].alias("conformance"), pages.safe_archive(status, F.when(n % 4 == 0, "force").otherwise("skip")).alias("safe"), code.alias("status"))


@query(f"""
SELECT {LINE}, l_linenumber % 4 >= 2 OR (l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'A') AS jpeg, l_extendedprice > l_linenumber * 10000 AS linear,
  CASE WHEN l_linenumber % 3 = 0 THEN false WHEN l_linenumber % 3 = 1 THEN l_linestatus = 'O' ELSE true END AS blanked
FROM lineitem
""")
def file_decisions(spark, sf):
    """P11, P16, P20."""
    n = F.col("l_linenumber")
    version = text.version_key(F.concat(F.lit("10."), F.when(F.col("l_quantity") < 10, "5").when(F.col("l_quantity") < 20, "6").otherwise("7"), F.lit(".0")))
    mode = F.when(n % 3 == 0, "force").when(n % 3 == 1, "redo").otherwise("default")
    return _lines(spark, sf).select(
        "l_orderkey", *LINE_ORDER, pages.jpeg_worth(n % 4, version, F.col("l_returnflag") == "A").alias("jpeg"),
        numbers.worth_linearising(F.col("l_extendedprice") * 100, n).alias("linear"), pages.blanked(mode, F.col("l_linestatus") == "O").alias("blanked"))


@query(f"""
SELECT {LINE}, round(l_quantity * 2, 6) AS x0, round((100 - l_discount * 100 - l_tax * 10) * 2, 6) AS y0, round((l_quantity + l_linenumber) * 2, 6) AS x1, round((100 - l_discount * 100) * 2, 6) AS y1
FROM lineitem WHERE l_linenumber % 3 = 2 OR (l_linenumber % 3 = 1 AND l_linestatus = 'O')
""")
def mask_boxes(spark, sf):
    """P20, M9: what is painted over before recognition, in pixels."""
    n = F.col("l_linenumber")
    mode = F.when(n % 3 == 0, "force").when(n % 3 == 1, "redo").otherwise("default")
    kept = _lines(spark, sf).where(pages.blanked(mode, F.col("l_linestatus") == "O"))
    b = boxes.box(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") + n, F.col("l_discount") * 100 + F.col("l_tax") * 10)
    p = boxes.to_pixels(b, F.lit(100.0), F.lit(144.0))
    return kept.withColumn("p", p).select("l_orderkey", *LINE_ORDER, *[_r(f"p.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""
SELECT event_id, event_type = 'error' AS error, event_type = 'signup' AS color, event_type = 'click' OR (event_type = 'error' AND user_id % 2 = 1) AS empty FROM events
""")
def engine_messages(spark, sf):
    """P23, P25."""
    e, one = F.col("event_type"), (F.col("user_id") % 2).cast("int")
    log = F.when(e == "error", "page 1\nAn ERROR occurred").when(e == "signup", "The DeviceN space has an\nDeviceN with Inappropriate Alternate").otherwise("DeviceN\ninappropriate alternate")
    output = F.when(e == "click", "Warning\nEmpty page!!").when(e == "error", "Error in boxClipToRectangle: box outside rectangle").otherwise("Page 1")
    return _t(spark, sf, "events").select("event_id", text.reports_error(log).alias("error"), text.reports_color_problem(log).alias("color"), text.empty_page(output, one).alias("empty"))


@query(f"""
SELECT {LINE}, (l_linenumber * 2 >= l_quantity) OR ((l_linenumber * 2 / l_quantity) / ((l_extendedprice / 100 * cos(radians(l_tax * 100)) + 10 * sin(radians(l_tax * 100))) / (l_extendedprice / 100 * sin(radians(l_tax * 100)) + 10 * cos(radians(l_tax * 100)))) >= 0.1) AS plausible
FROM lineitem
""")
def aspect_filter(spark, sf):
    """P27."""
    fine = numbers.plausible_aspect(F.col("l_linenumber") * 2, F.col("l_quantity"), F.col("l_extendedprice") / 100, F.lit(10.0), F.col("l_tax") * -100)
    return _lines(spark, sf).select("l_orderkey", *LINE_ORDER, fine.alias("plausible"))


@query("""
WITH c AS (SELECT user_id, event_id, ts, k % 7 = 0 AS unknown, CASE WHEN k < 50 THEN 0 ELSE 3 END AS mode, event_type AS font
           FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)),
s AS (SELECT *, CASE WHEN lag(mode) OVER w = mode AND ((NOT unknown AND NOT lag(unknown) OVER w) OR lag(font) OVER w = font) THEN 0 ELSE 1 END AS b FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN unknown THEN chr(65533) ELSE 'x' END AS shown, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS line FROM s
""")
def char_lines(spark, sf):
    """P28, W5, C22."""
    k = F.get_json_object("props", "$.k").cast("int")
    t = _t(spark, sf, "events").select("user_id", "event_id", "ts", F.when(k % 7 == 0, "(cid:12)").otherwise("x").alias("text"), F.when(k < 50, 0).otherwise(3).alias("mode"), F.col("event_type").alias("font"))
    out = pages.text_lines(t, ["user_id"], ["ts", "event_id"], "text", "mode", "font")
    return out.select("event_id", text.mapped_character(F.col("text")).alias("shown"), F.col("line").cast("long").alias("line"))


@query("SELECT event_id, event_type <> 'error' AS visible, CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 AS corrupt FROM events")
def first_box(spark, sf):
    """P5."""
    k = F.get_json_object("props", "$.k").cast("int")
    char = lambda t, m: F.struct(F.lit(t).alias("text") if isinstance(t, str) else t.alias("text"), m.alias("mode"))
    first = char(F.when(k % 2 == 0, "(cid:7)").otherwise("a"), F.when(F.col("event_type") == "error", 3).otherwise(0))
    lines = F.array(F.array(first, char("�", F.lit(3))), F.array(char("b", F.lit(3))))
    return _t(spark, sf, "events").select("event_id", F.inline(F.array(pages.first_box_flags(lines))))


@query("""
SELECT o_orderkey, round(greatest(max(l_quantity), 10), 6) AS most_x, round(greatest(max(l_discount * 500), 20), 6) AS most_y,
       round(least(min(l_quantity), 10), 6) AS least_x, round(least(min(l_discount * 500), 20), 6) AS least_y
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def resolution_bounds(spark, sf):
    """A3: each way's largest and smallest over a page's images and the page's own."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 500
    t = _lines(spark, sf).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(x).alias("mx"), F.max(y).alias("my"), F.min(x).alias("nx"), F.min(y).alias("ny"))
    pair = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    own = pair(F.lit(10.0), F.lit(20.0))
    most, least = numbers.component_max(own, pair(F.col("mx"), F.col("my"))), numbers.component_min(own, pair(F.col("nx"), F.col("ny")))
    return t.select("o_orderkey", _r(most["x"]).alias("most_x"), _r(most["y"]).alias("most_y"), _r(least["x"]).alias("least_x"), _r(least["y"]).alias("least_y"))


@query("""
SELECT user_id, max('1.' || CAST(k % 8 AS VARCHAR)) AS version, bool_or(k > 97) AS has_userunit, bool_or(event_type = 'error' AND k < 20) AS has_corrupt_text
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY user_id
""")
def document_flags(spark, sf):
    """A4, A5."""
    k = F.get_json_object("props", "$.k").cast("int")
    t = _t(spark, sf, "events").select("user_id", F.concat(F.lit("1."), (k % 8).cast("string")).alias("v"), F.when(k > 97, 2.0).otherwise(1.0).alias("u"), ((F.col("event_type") == "error") & (k < 20)).alias("c"))
    return pages.document_flags(t, ["user_id"], "v", "u", "c")


@query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS removed, count(*) FILTER (l_returnflag = 'A') AS repaired, count(*) FILTER (l_tax >= 0.07) AS errors,
       count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS routed FROM lineitem GROUP BY l_orderkey
""")
def outcome_counts(spark, sf):
    """A11."""
    f = F.col("l_returnflag")
    return _lines(spark, sf).groupBy("l_orderkey").agg(
        F.count_if(f == "R").alias("removed"), F.count_if(f == "A").alias("repaired"), F.count_if(F.col("l_tax") >= 0.07).alias("errors"),
        F.count_if((F.col("l_linestatus") == "O") & (f == "N")).alias("routed"))


@query("""
SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 0.5 WHEN event_type = 'view' THEN 0.5 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events
""")
def page_progress(spark, sf):
    """A17."""
    share = F.when(F.col("event_type").isin("click", "view"), 0.5).otherwise(0.0)
    return pages.progress(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], share).select("event_id", "done")


@query("""
WITH l AS (SELECT *, CAST(user_id % 10 AS INTEGER) + 2 AS n FROM events),
t AS (SELECT *, first_value(CASE WHEN event_type = 'signup' THEN n END IGNORE NULLS) OVER w AS total FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, total, CAST(sum(CASE WHEN event_type = 'click' AND total IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS done FROM t
""")
def conversion_log(spark, sf):
    """C20, X8."""
    e = F.col("event_type")
    line = F.when(e == "signup", F.concat(F.lit(" Processing pages 1 through "), ((F.col("user_id") % 10) + 2).cast("int").cast("string"), F.lit("."))).when(e == "click", "Page 4").otherwise("Loading Page 4")
    t = _t(spark, sf, "events").withColumn("line", line)
    return pages.conversion_progress(t, ["user_id"], ["ts", "event_id"], "line").select("event_id", "total", F.col("done").cast("long").alias("done"))


@query("SELECT p_partkey, p_name AS title, CASE p_size % 4 WHEN 0 THEN 'Folio hOCR + Tesseract OCR 5.3' WHEN 1 THEN 'Folio fpdf2 + Tesseract OCR 5.3' WHEN 2 THEN 'Tesseract OCR + PDF 5.3' ELSE 'Tesseract OCR 5.3' END AS creator FROM part")
def document_properties(spark, sf):
    """C14, C15."""
    n = F.col("p_size") % 4
    kind = F.when(n == 0, "hocr").when(n == 1, "auto").when(n == 2, "sandwich").otherwise("other")
    spoilt = F.concat(F.lit("\0"), F.substring("p_name", 1, 3), F.lit("\0\0"), F.expr("substring(p_name, 4)"))
    return _t(spark, sf, "part").select("p_partkey", text.without_nul(spoilt).alias("title"), text.creator_tag(kind, "Folio", F.lit("5.3")).alias("creator"))


@query("""
SELECT event_id, CASE WHEN k % 4 <> 0 THEN 'with existing rotation ' || d[k % 4 + 1] || ', ' ELSE '' END || 'page is facing ' || CASE WHEN user_id % 5 = 4 THEN '?' ELSE d[CAST(user_id % 5 AS INTEGER) + 1] END
  || ', confidence ' || printf('%.2f', k / 8.0) || ' - ' || CASE WHEN k / 8.0 >= 5 THEN CASE WHEN user_id % 5 % 4 <> 0 THEN 'will rotate ' || t[CAST(user_id % 5 AS INTEGER) + 1] ELSE 'rotation appears correct' END
     WHEN user_id % 5 % 4 <> 0 THEN 'confidence too low to rotate' ELSE 'no change' END AS message
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, ['⇧', '⇨', '⇩', '⇦'] AS d, [' ', '⬏', '↻', '⬑'] AS t FROM events)
""")
def rotation_report(spark, sf):
    """C16."""
    k, a = F.get_json_object("props", "$.k").cast("int"), ((F.col("user_id") % 5) * 90).cast("int")
    return _t(spark, sf, "events").select("event_id", text.rotation_message((k % 4) * 90, a, k / 8.0, numbers.wrap(a), 5.0).alias("message"))


_STEMS = "CASE p_size % 9 WHEN 0 THEN b || '-Regular' WHEN 1 THEN b || '[wdth,wght]' WHEN 2 THEN b || '-VF' WHEN 3 THEN b WHEN 4 THEN b || '-Bold' WHEN 5 THEN b || 'UI-Regular' WHEN 6 THEN b || '-Italic[wght]' WHEN 7 THEN 'Other-Regular' ELSE b || 'UI' END"


@query(f"""
WITH s AS (SELECT p_partkey, {_STEMS} AS stem FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'NotoSans' WHEN 1 THEN 'NotoSerif' ELSE 'NotoMusic' END || replace(p_brand, 'Brand#', '') AS b FROM part)),
f AS (SELECT *, CASE WHEN NOT starts_with(stem, 'Noto') THEN NULL WHEN ends_with(h, '-Regular') THEN replace(h, '-Regular', '') WHEN ends_with(h, '-VF') THEN replace(h, '-VF', '') WHEN contains(h, '-') THEN NULL ELSE h END AS family FROM (SELECT *, string_split(stem, '[')[1] AS h FROM s)),
v AS (SELECT *, CASE WHEN stem = family || '-Regular' THEN 0 WHEN starts_with(stem, family || '[') THEN 1 WHEN stem = family || '-VF' THEN 2 WHEN stem = family THEN 3 END AS rank FROM f WHERE family IS NOT NULL),
b AS (SELECT * FROM v WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY family ORDER BY rank, p_partkey) = 1)
SELECT family, stem, CAST(row_number() OVER (ORDER BY CASE WHEN starts_with(family, 'NotoSans') THEN 0 WHEN starts_with(family, 'NotoSerif') THEN 1 ELSE 2 END, CASE WHEN ends_with(family, 'UI') THEN 1 ELSE 0 END, family) AS INTEGER) AS place FROM b
""")
def font_candidates(spark, sf):
    """The best file of every family, in the order of trial."""
    from pyspark.sql import Window

    k, n = F.col("p_partkey") % 3, F.col("p_size") % 9
    base = F.concat(F.when(k == 0, "NotoSans").when(k == 1, "NotoSerif").otherwise("NotoMusic"), F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")))
    ends = ["-Regular", "[wdth,wght]", "-VF", "", "-Bold", "UI-Regular", "-Italic[wght]", "", "UI"]
    stem = F.when(n == 7, "Other-Regular").otherwise(F.concat(base, F.get(F.array(*map(F.lit, ends)), n)))
    t = _t(spark, sf, "part").select("p_partkey", stem.alias("stem")).withColumn("family", text.font_family(F.col("stem")))
    rank = numbers.rank_of(text.font_variant(F.col("stem"), F.col("family")), ["regular", "variable", "vf", "plain"])
    best = pages.best_by(t.withColumn("rank", rank).where("rank IS NOT NULL"), ["family"], [F.col("rank"), F.col("p_partkey")])
    # one row a family: a short list, numbered in order of trial
    return best.select("family", "stem", F.row_number().over(Window.orderBy(*text.font_order(F.col("family")))).alias("place"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '--layout|one column|-x' WHEN 1 THEN 'a b|c"d' WHEN 2 THEN '..|x' ELSE 'in/out' END AS words, o_orderkey % 4 >= 2 AS names_file FROM orders
""")
def cleaner_arguments(spark, sf):
    """C23."""
    n = F.col("o_orderkey") % 4
    line = F.when(n == 0, "--layout 'one column'  -x").when(n == 1, "a\\ b \"c\\\"d\"").when(n == 2, ".. x").otherwise("in/out")
    t = _t(spark, sf, "orders").withColumn("w", options.shell_words(line))
    return t.select("o_orderkey", F.array_join("w", "|").alias("words"), options.names_a_file(F.col("w")).alias("names_file"))


@query(f"""
SELECT {LINE}, round(CASE WHEN l_returnflag <> 'R' AND l_quantity * 10 > 0 AND l_linenumber > 0 THEN (l_extendedprice / (l_quantity * 10)) * (100.0 / l_linenumber) ELSE 0 END, 6) AS area,
  CAST(round_even(l_discount * 250, 0) AS INTEGER) AS pixels, round(degrees(l_tax), 6) AS skew, round(greatest(l_quantity, 10), 6) AS real_x,
  CAST(CASE WHEN l_quantity < 10 OR l_linenumber < 10 THEN greatest(1, round_even(100 * (l_quantity / greatest(l_quantity, 10)), 0)) ELSE 100 END AS INTEGER) AS back_w,
  CAST(CASE WHEN l_linenumber % 2 = 1 THEN round_even(200 * l_linenumber * 10 / 72.0, 0) ELSE round_even(100 * l_quantity / 72.0, 0) END AS INTEGER) AS expected_w,
  greatest(1, least(CAST(floor(8 / greatest(l_linenumber, 1)) AS INTEGER), 3)) AS threads, greatest(10, CAST(l_quantity AS INTEGER) - 10) AS band_low, least(100, CAST(l_quantity AS INTEGER) + 60) AS band_high,
  round(CASE WHEN l_discount = 0 OR l_quantity = 0 THEN 0 ELSE 2 * l_quantity * l_discount / (l_quantity + l_discount) END, 6) AS scalar
FROM lineitem
""")
def image_arithmetic(spark, sf):
    """M2, M3, M5, M6, M19, M20, M21, M23, M24, M25, P6."""
    q, n, price = F.col("l_quantity").cast("double"), F.col("l_linenumber"), F.col("l_extendedprice").cast("double")
    x, y = q * 10, n.cast("double")
    fine = numbers.renderable(x, y, price, F.lit(100.0), F.col("l_returnflag") == "R")
    low = numbers.low_resolution_size(F.lit(100), F.lit(200), q, y)
    size = numbers.expected_size(F.lit(100.0), F.lit(200.0), q, n * 10.0, n * 90)
    whole = q.cast("int")
    return _lines(spark, sf).select(
        "l_orderkey", *LINE_ORDER, _r(numbers.printed_area(price, F.lit(100.0), x, y, fine)).alias("area"),
        numbers.pixels(F.col("l_discount"), F.lit(250)).alias("pixels"), _r(numbers.skew_degrees(F.col("l_tax"))).alias("skew"), _r(low["x"]).alias("real_x"),
        low["width"].alias("back_w"), size["width"].alias("expected_w"), numbers.engine_threads(8, n).alias("threads"),
        numbers.quality_band(whole)[0].alias("band_low"), numbers.quality_band(whole + 50)[1].alias("band_high"), _r(numbers.harmonic_mean(q, F.col("l_discount").cast("double"))).alias("scalar"))


@query(f"""
WITH b AS (SELECT {LINE}, l_quantity * 10 AS x0, l_quantity * 10 + (l_linenumber - 2) * 100 AS x1, l_discount * 4000 AS y0, l_discount * 4000 + l_tax * 9000 AS y1, l_linenumber = 7 AS dead, l_suppkey % 5 = 0 AS e FROM lineitem),
o AS (SELECT *, least(x0, x1) AS a, greatest(x0, x1) AS c, y0 AS b, y1 AS d FROM b)
SELECT {LINE}, concat_ws(',', CASE WHEN x1 < x0 THEN 'reordered' END, CASE WHEN e THEN 'recoded' END,
    CASE WHEN dead THEN NULL WHEN least(c, 400) - greatest(a, 0) <= 0 OR least(d, 700) - greatest(b, 0) <= 0 THEN 'discarded' WHEN a < 0 OR c > 400 OR b < 0 OR d > 700 THEN 'clamped' END) AS kinds,
  concat_ws(',', 'reordered', CASE WHEN dead THEN 'degenerate_mediabox' END) AS media_kinds,
  CASE WHEN dead THEN round(c, 4) WHEN NOT (least(c, 400) - greatest(a, 0) <= 0 OR least(d, 700) - greatest(b, 0) <= 0) THEN round(least(c, 400), 4) END AS right
FROM o
""".replace("concat_ws(',', 'reordered', CASE WHEN dead", "concat_ws(',', 'reordered', CASE WHEN dead"))
def box_repairs(spark, sf):
    """Every repair of a page's boxes, read from text."""
    shown = lambda c: F.format_string("%.4f", c.cast("double"))
    x, y = F.col("l_quantity") * 10, F.col("l_discount") * 4000
    x1, y1 = x + (F.col("l_linenumber") - 2) * 100, y + F.col("l_tax") * 9000
    left = F.when(F.col("l_suppkey") % 5 == 0, F.concat(shown(x), F.lit("e0"))).otherwise(shown(x))
    sub = F.array(left, shown(y), shown(x1), shown(y1))
    media = F.array(F.when(F.col("l_linenumber") == 7, "0").otherwise("400"), F.lit("0"), F.lit("0"), F.lit("700"))
    media = F.when(F.col("l_linenumber") == 7, F.array(F.lit("0"), F.lit("700"), F.lit("0"), F.lit("0"))).otherwise(media)
    t = _lines(spark, sf).withColumn("r", boxes.repairs(media, sub))
    return t.select("l_orderkey", *LINE_ORDER, F.array_join("r.kinds", ",").alias("kinds"), F.array_join("r.media_kinds", ",").alias("media_kinds"), _r("r.box.x1", 4).alias("right"))


@query(f"""
SELECT {LINE}, round(CASE WHEN l_linenumber % 2 = 1 THEN l_discount * 100 - 20 ELSE l_quantity - 10 END, 6) AS moved_x0,
  round(least(l_quantity * 2, l_quantity * 2 + 4) - 3, 6) AS around_x0, round(greatest(l_quantity * 2, l_quantity * 2 + 4) - 3, 6) AS around_x1,
  CASE WHEN l_linenumber % 4 = 0 AND l_quantity = 10 THEN NULL ELSE round(CASE l_linenumber % 4 WHEN 0 THEN 100.0 / (l_quantity * 10) WHEN 2 THEN -100.0 / (l_quantity * 10) ELSE 0 END, 6) END AS layer_a,
  CASE WHEN l_linenumber % 4 = 0 AND l_quantity = 10 THEN NULL ELSE round(CASE l_linenumber % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 100.0 ELSE 100.0 END, 6) END AS layer_e
FROM lineitem
""")
def page_geometry(spark, sf):
    """M13, M15, M16."""
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    b = boxes.box(q, F.col("l_discount") * 100, q + 2, F.col("l_discount") * 100 + 2)
    media = boxes.box(F.lit(10.0), F.lit(20.0), F.lit(600.0), F.lit(800.0))
    around = boxes.transform_box(b, boxes.affine(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(-3.0), F.lit(1.0)))
    layer = boxes.layer_matrix(q * 10, F.lit(200.0), F.lit(100.0), F.lit(200.0), F.lit(0.0), F.lit(0.0), (n % 4) * 90)
    t = _lines(spark, sf).withColumn("m", layer)
    return t.select("l_orderkey", *LINE_ORDER, _r(boxes.to_origin(b, media, n % 2 == 1)["x0"]).alias("moved_x0"), _r(around["x0"]).alias("around_x0"), _r(around["x1"]).alias("around_x1"), _r(F.col("m.a") + 0.0).alias("layer_a"), _r(F.col("m.e") + 0.0).alias("layer_e"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS jobs, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS mode, 'extra' AS extra, 2 AS n_known FROM events
""")
def job_settings(spark, sf):
    """D6, D7, D8."""
    encoded = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("jobs"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("mode"), F.lit("x").alias("later")))
    t = _t(spark, sf, "events").select("event_id", options.settings(encoded, "jobs int, mode string, later string").alias("s"))
    held = F.create_map(F.lit("jobs"), F.col("s.jobs").cast("string"), F.lit("mode"), F.col("s.mode"), F.lit("extra"), F.col("s.later"))
    t = t.withColumn("m", options.split_known(held, ["jobs", "mode", "language"]))
    return t.select("event_id", "s.jobs", "s.mode", F.array_join(F.map_keys("m.extra"), ",").alias("extra"), F.size("m.known").alias("n_known"))


@query("""
SELECT doc_id, source AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'me' END AS author, CASE WHEN doc_id % 2 = 0 THEN 'keywords' ELSE 'author,keywords' END AS lost, 'old' AS goes
FROM documents
""".replace("CASE WHEN doc_id % 2 = 0 THEN 'keywords' ELSE 'author,keywords' END AS lost", "CASE WHEN doc_id % 3 = 0 THEN 'keywords' ELSE 'author,keywords' END AS lost"))
def property_merge(spark, sf):
    """N13, U3, U4."""
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    original, output = pair("title", "draft", "author", "me", "keywords", "a, b"), pair("title", F.col("source"), "producer", "folio")
    given = F.when(F.col("doc_id") % 3 == 0, pair("author", "")).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    t = _t(spark, sf, "documents").withColumn("p", matching.merged_properties(original, output, given))
    goes = matching.without_entries(pair("title", "x", "old", "y", "kept", "z"), output, ["kept"])
    return t.select("doc_id", F.col("p.properties")["title"].alias("title"), F.try_element_at("p.properties", F.lit("author")).alias("author"), F.array_join("p.lost", ",").alias("lost"), F.array_join(goes, ",").alias("goes"))


@query("""
SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM conversations WHERE role <> 'system' GROUP BY conv_id
""")
def first_of_kind(spark, sf):
    """The first node of a kind in reading order."""
    t = _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("node"), F.col("role").alias("kind"), F.array("turn").alias("path"))
    kinds = [r["kind"] for r in t.select("kind").distinct().collect() if r["kind"] != "system"]  # a few classes
    return recognised.first_of(t, ["conv_id"], *kinds).select("conv_id", F.col("kind").alias("role"), F.col("node").alias("turn"))


@query("""
SELECT event_id, 'D:' || strftime(ts, '%Y%m%d%H%M%S') || '+00''00''' AS stamp, event_type = 'error' AS bad, CAST(CASE WHEN event_type = 'click' THEN -1 WHEN event_type = 'error' THEN 3 ELSE 0 END AS INTEGER) AS failed,
  'U+' || CASE WHEN event_type = 'view' THEN '00E9' ELSE '0041' END AS point
FROM events
""")
def report_fields(spark, sf):
    """D1, P29, S14, C17."""
    e = F.col("event_type")
    title = F.when(e == "error", F.lit("a\U0001d11e")).otherwise("plain")
    report = F.when(e == "click", "no report").when(e == "error", '{"report":{"jobs":[{"validationResult":[{"details":{"failedRules":3}}]}]}}').otherwise('{"report":{"jobs":[{"validationResult":[{"details":{}}]}]}}')
    return _t(spark, sf, "events").select("event_id", text.pdf_date(F.col("ts")).alias("stamp"), text.has_private_or_astral(title).alias("bad"), pages.failed_rules(report).alias("failed"), text.code_point(F.when(e == "view", "é").otherwise("A")).alias("point"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'in a data folder' WHEN p_size % 5 = 1 THEN 'not a regular file' WHEN p_size % 5 = 2 THEN 'writable by others' END AS settings,
  CASE WHEN p_size % 3 = 0 THEN 'in a data folder' END AS plugin, CASE WHEN p_size % 4 = 0 THEN 'output in watched folder' WHEN p_size % 4 = 1 THEN 'archive in watched folder' END AS watch,
  CASE WHEN p_size % 6 = 0 THEN 'not a regular file' WHEN p_size % 6 = 1 THEN 'outside the folder' END AS file, CASE WHEN p_size % 7 = 0 THEN 'outside the folder' WHEN p_size % 7 = 1 THEN 'occupied' END AS target
FROM part
""")
def path_checks(spark, sf):
    """P26, X5."""
    n = F.col("p_size")
    data = F.array(F.lit("/data/in"), F.lit("/data/out"))
    settings = pages.settings_problem(F.when(n % 5 == 0, "/data/in/a.json").otherwise("/data/input/a.json"), F.when(n % 5 == 1, "fifo").otherwise("file"), F.when(n % 5 == 2, 0o664).otherwise(0o644), data)
    plugin = pages.plugin_problem(F.when(n % 3 == 1, "module.name").otherwise("p.py"), F.when(n % 3 == 2, "/opt/p.py").otherwise("/data/out/p.py"), data)
    watch = pages.watch_problem(F.lit("/data/in"), F.when(n % 4 == 0, "/data/in/done").otherwise("/data/inbox"), F.when(n % 4 == 1, "/data/in").otherwise("/data/old"))
    file = pages.file_problem(F.when(n % 6 == 1, "/data/x").otherwise("/data/in/x"), F.when(n % 6 == 0, "link").otherwise("file"), F.lit("/data/in"))
    target = pages.target_problem(F.when(n % 7 == 0, "/elsewhere").otherwise("/data/out/2024"), F.when(n % 7 == 1, "fifo").when(n % 7 == 2, "file"), F.lit("/data/out"))
    return _t(spark, sf, "part").select("p_partkey", settings.alias("settings"), plugin.alias("plugin"), watch.alias("watch"), file.alias("file"), target.alias("target"))


@query("""
SELECT o_orderkey, layer IS NOT NULL AS grafted, coalesce(layer, '') AS layer FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS layer FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey
""")
def grafted_layers(spark, sf):
    """A text layer for each page that has one."""
    layers = _lines(spark, sf).where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("layer"))
    out = matching.graft(_t(spark, sf, "orders").select("o_orderkey"), layers, ["o_orderkey"])
    return out.select("o_orderkey", "grafted", F.coalesce("layer", F.lit("")).alias("layer"))


@query(f"""
SELECT {LINE}, CASE WHEN l_extendedprice <= l_quantity * 1000 AND l_extendedprice <= l_partkey * 10 THEN 'kept' WHEN l_quantity * 1000 <= l_partkey * 10 THEN 'jpeg' ELSE 'deflate' END AS best, l_partkey * 20000 < 268435456 AS cleanable
FROM lineitem
""")
def encoding_choice(spark, sf):
    """The smallest of several encodings; whether a page image is cleaned."""
    sizes = {"kept": F.col("l_extendedprice").cast("double"), "jpeg": (F.col("l_quantity") * 1000).cast("double"), "deflate": (F.col("l_partkey") * 10).cast("double")}
    return _lines(spark, sf).select("l_orderkey", *LINE_ORDER, numbers.smallest(sizes).alias("best"), numbers.cleanable(F.col("l_partkey"), F.lit(20000)).alias("cleanable"))


@query("""
SELECT p_partkey, '[{Thing} /type' AS head, 4 AS n FROM part
""".replace("'[{Thing} /type' AS head, 4 AS n", "'[/_objdef {Thing} /type /dict /OBJ pdfmark' AS head, '[{Thing} <<' AS opening, '  /N ' || CAST(p_size AS VARCHAR) AS entry, '>> /PUT pdfmark' AS closing"))
def converter_script(spark, sf):
    """C21."""
    entries = F.array(F.struct(F.lit("/N").alias("name"), F.col("p_size").cast("string").alias("value")))
    t = _t(spark, sf, "part").withColumn("s", F.split(text.object_definition(F.lit("{Thing}"), entries), "\n"))
    return t.select("p_partkey", *[F.get("s", F.lit(i)).alias(n) for i, n in enumerate(("head", "opening", "entry", "closing"))])


@query("""
SELECT p_partkey, p_size % 5 = 0 AS has_text, p_size % 3 = 0 AS has_vector, CAST(p_size % 2 = 0 AS INTEGER) AS n_objects, CASE WHEN p_size % 3 = 0 THEN 'color' ELSE 'mono' END AS ink, CAST(p_size * 3 AS INTEGER) AS deepest,
  concat_ws(', ', CASE WHEN p_size * 3 > 128 THEN 'stack overflow' END, CASE WHEN p_size * 3 > 32 THEN 'deep stack' END, CASE WHEN p_size % 4 = 0 THEN 'stack underflow' END) AS status
FROM part
""")
def page_scans(spark, sf):
    """What the content stream of every page holds."""
    n = F.col("p_size")
    some = lambda when, what: F.when(when, what).otherwise("")
    stream = F.concat(
        F.lit("q 2 0 0 2 "), n.cast("string"), F.lit(" 0 cm"), some(n % 2 == 0, " /Im1 Do"), some(n % 3 == 0, " % painted\n0 0 1 rg 0 0 9 9 re f"), some(n % 5 == 0, " BT 3 Tr (a (b) \\) Q Q) Tj ET"),
        F.lit(" Q"), some(n % 4 == 0, " Q"), F.repeat(F.lit(" q"), n.cast("int") * 3))
    out = content.page_scan(_t(spark, sf, "part").select("p_partkey", stream.alias("stream")), "p_partkey", "stream")
    return out.select("p_partkey", "has_text", "has_vector", "n_objects", "ink", "deepest", "status")


@query("""
SELECT p_partkey, i.place, i.operator, i.n FROM part, (VALUES (0, 'q', 0), (1, 'cm', 6), (2, 'Do', 1), (3, 'TJ', 1), (4, 'INLINE IMAGE', 4), (5, 'Q', 0)) AS i(place, operator, n)
""")
def content_operators(spark, sf):
    """The operators of content streams and their operands."""
    stream = F.concat(F.lit("q 1 0 0 1 "), F.col("p_size").cast("string"), F.lit(" -.5 cm /X#20y Do [(a) -20 (b)] TJ BI /W 2 /H 2 ID \x01Q EIx EI Q"))
    out = content.content_operators(_t(spark, sf, "part").select("p_partkey", stream.alias("s")), "p_partkey", "s")
    return out.select("p_partkey", "place", "operator", F.size("operands").alias("n"))


@query("SELECT doc_id, 0 AS pageno, upper(lang) AS text, CAST(doc_id % 4 * 90 AS INTEGER) AS orientation, doc_id % 3 = 0 AS kept FROM documents")
def hooked_engine(spark, sf):
    """Pages through registered hooks, the last registered first."""
    hooks = engines.Hooks()
    hooks.register("recognise", lambda: engines.null_engine)
    hooks.register("recognise", lambda: _upper_engine)
    hooks.register("filter_page", _third_only)
    t = _t(spark, sf, "documents").select("doc_id", F.lit(0).alias("pageno"), F.encode("lang", "utf-8").alias("image"))
    read = engines.recognise(t, hooks).select("doc_id", "pageno", "text", "orientation")
    kept = engines.filtered(t, hooks, "filter_page").select("doc_id", F.col("image").isNotNull().alias("kept"))
    return read.join(kept, "doc_id").select("doc_id", "pageno", "text", "orientation", "kept")


def _upper_engine(batches):
    for p in batches:
        yield p[["doc_id", "pageno"]].assign(text=[bytes(x).decode().upper() for x in p["image"]], orientation=(p["doc_id"] % 4 * 90).astype("int32"), confidence=1.0)


def _third_only(batches):
    for p in batches:
        yield p.assign(image=[x if i % 3 == 0 else None for i, x in zip(p["doc_id"], p["image"], strict=True)])


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[skipped page]' ELSE lang END AS text, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 90 END AS INTEGER) AS orientation FROM documents
""")
def timed_out_pages(spark, sf):
    """N3, N6."""
    t = _t(spark, sf, "documents").select("doc_id", F.col("lang").alias("text"), F.lit(90).alias("orientation"), F.lit(1.0).alias("confidence"))
    return engines.after_timeouts(t, F.when(F.col("doc_id") % 6 != 1, F.col("doc_id") % 3 == 0)).select("doc_id", "text", "orientation")


@query("SELECT c_custkey, coalesce(n_name, '') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey")
def code_lookup(spark, sf):
    """Names of codes from a table that is given as data."""
    table = _t(spark, sf, "nation").where("n_regionkey <> 1")
    out = matching.looked_up(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table, "n_nationkey", "n_name", "")
    return out.select("c_custkey", "n_name")


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'plain,western,cjk' ELSE 'plain,western,' || lang END AS fonts FROM documents")
def fallback_fonts(spark, sf):
    """U6, T8."""
    known = F.array(F.lit("plain"), F.lit("western"))
    more = F.when(F.col("lang") == "fr", F.array(F.lit("western"), F.lit("cjk"), F.lit("cjk"))).otherwise(F.array(F.col("lang")))
    return _t(spark, sf, "documents").select("doc_id", F.array_join(matching.in_order_of_trial(known, more), ",").alias("fonts"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_extendedprice >= 25000 AND l_extendedprice * 2 / (l_extendedprice + 4000 + 3000 * l_linenumber) >= 1.35
  THEN concat_ws(',', CASE WHEN l_returnflag = 'R' THEN 'forced' END, CASE WHEN l_linestatus = 'O' THEN 'no optimiser' END) ELSE '' END AS reasons FROM lineitem
""")
def size_reasons(spark, sf):
    """Why a result has grown."""
    reasons = F.array(F.when(F.col("l_returnflag") == "R", "forced"), F.when(F.col("l_linestatus") == "O", "no optimiser"))
    report = pages.size_report(F.col("l_extendedprice"), F.col("l_extendedprice") * 2, F.col("l_linenumber"), reasons)
    return _lines(spark, sf).select("l_orderkey", *LINE_ORDER, F.array_join(report["reasons"], ",").alias("reasons"))


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id
""")
def watched_files(spark, sf):
    """Files through the watcher; those that cannot be read are set aside."""
    from ..streaming import folder

    return folder.watched_events(spark, f"{sf}/events.parquet")


@query("""
SELECT event_id, event_type AS kind, CAST(user_id AS BIGINT) AS page FROM events
""")
def cache_manifest(spark, sf):
    """A cache's manifest, one JSON object a line."""
    line = F.to_json(F.struct(F.col("event_id").alias("event_id"), F.col("event_type").alias("kind"), F.col("user_id").alias("page"), F.lit(None).cast("string").alias("none")))
    return files.manifest_lines(_t(spark, sf, "events").select(line.alias("line")), "line", "event_id long, kind string, page long")
