"""Registered queries: each operator on the driver's tables, beside its DuckDB equivalent.

Orders play pages, line items image draws, parts resources, events operator and log streams,
documents recognised documents, conversations documents with numbered pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, numbers, text
from ..operators import assembly, engines, folds, matching, pages
from ..sources import files, recognised
from ..streaming import folder

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits)


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""
SELECT l_orderkey, round(weighted, 6) AS weighted_dpi, max_dpi, round(weighted / max_dpi, 6) AS ratio,
       round(first_area / total, 6) AS area_ratio
FROM (SELECT l_orderkey, sum(l_extendedprice) AS total, sum(l_extendedprice) / sum(l_extendedprice / l_quantity) AS weighted,
             max(l_quantity) AS max_dpi,
             arg_min(l_extendedprice, (-l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS first_area
      FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
""")
def page_resolution_profile(spark, sf):
    draws = _t(spark, sf, "lineitem").where("l_returnflag <> 'R'")
    out = pages.resolution_profile(draws, ["l_orderkey"], "l_quantity", "l_extendedprice", LINE_ORDER)
    return out.select("l_orderkey", _r("weighted_dpi").alias("weighted_dpi"), "max_dpi", _r("ratio").alias("ratio"), _r("area_ratio").alias("area_ratio"))


@query("""
SELECT l_orderkey, round(greatest(CASE WHEN weighted / mx < 0.8 THEN weighted ELSE mx END, CASE WHEN rich THEN 400.0 ELSE 0 END, 30.0), 6) AS dpi
FROM (SELECT l_orderkey, sum(l_extendedprice) / sum(l_extendedprice / l_quantity) AS weighted, max(l_quantity) AS mx,
             bool_or(l_linestatus = 'F' AND l_returnflag = 'A') AS rich
      FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey)
""")
def raster_dpi(spark, sf):
    draws = _t(spark, sf, "lineitem").where("l_returnflag <> 'R'")
    rich = F.bool_or((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"))
    profile = pages.resolution_profile(draws, ["l_orderkey"], "l_quantity", "l_extendedprice", LINE_ORDER, {"rich": rich})
    dpi = F.when(F.col("ratio") < 0.8, F.col("weighted_dpi")).otherwise(F.col("max_dpi"))
    return profile.select("l_orderkey", _r(numbers.square_dpi(dpi, F.col("rich"), 30.0)).alias("dpi"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       sqrt(l_discount * l_discount + l_tax * l_tax) <> 0 AS finite,
       CASE WHEN sqrt(l_discount * l_discount + l_tax * l_tax) <> 0
            THEN round(l_quantity / sqrt(l_discount * l_discount + l_tax * l_tax) * 72, 6) END AS dpi
FROM lineitem
""")
def image_dpi(spark, sf):
    dpi = numbers.drawn_dpi(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    t = _t(spark, sf, "lineitem").withColumn("_d", dpi)
    return t.select("l_orderkey", *LINE_ORDER, numbers.is_finite(F.col("_d")).alias("finite"), F.when(numbers.is_finite(F.col("_d")), _r("_d")).alias("dpi"))


@query("""
WITH p AS (SELECT o_orderkey, o_orderstatus = 'F' AS has_text, coalesce(n, 0) > 0 AS has_images, coalesce(px, 0) AS px
           FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) * 1000 AS px FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
m AS (SELECT unnest(['default', 'skip', 'redo', 'force', 'strip']) AS mode)
SELECT o_orderkey, mode,
       CASE WHEN mode = 'strip' OR o_orderkey % 10 = 0 OR (has_text AND mode = 'default') THEN false
            WHEN has_text AND mode NOT IN ('force', 'redo') THEN false
            WHEN NOT has_text AND NOT has_images AND mode <> 'force' THEN false
            ELSE NOT (has_images AND px > 0.2 * 1000000) END AS required,
       CASE WHEN mode = 'default' AND o_orderkey % 10 <> 0 AND has_text THEN 'prior text found' END AS error
FROM p, m
""")
def page_filter(spark, sf):
    draws = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.sum("l_quantity") * 1000).alias("px"))
    t = _t(spark, sf, "orders").join(draws, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    modes = F.array(*[F.lit(m) for m in ("default", "skip", "redo", "force", "strip")])
    t = t.select("o_orderkey", "o_orderstatus", "n", F.coalesce("px", F.lit(0.0)).alias("px"), F.explode(modes).alias("mode"))
    out = pages.needs_recognition(
        F.col("mode"), F.col("o_orderstatus") == "F", F.coalesce(F.col("n") > 0, F.lit(False)), F.col("px"),
        F.col("o_orderkey") % 10 != 0, F.lit(False), F.lit(0.2),
    )
    return t.select("o_orderkey", "mode", F.inline(F.array(out)))


@query("""
SELECT regexp_extract(substr(html, 1, 1024), '<!DOCTYPE (\\w+)', 1) AS signature,
       regexp_extract(substr(html, 1, 1024), 'lang="(\\w+)"', 1) AS lang, page_id,
       CASE WHEN regexp_extract(substr(html, 1, 1024), '<!DOCTYPE (\\w+)', 1) = '' THEN 2 ELSE 0 END AS status
FROM pages
""".replace("\\\\", "\\"))
def sniff_signature(spark, sf):
    head = F.substring("html", 1, 1024)
    kind = F.regexp_extract(head, r"<!DOCTYPE (\w+)", 1)
    status = F.when(kind == "", pages.STATUS["input_file"]).otherwise(pages.STATUS["ok"])
    return _t(spark, sf, "pages").select("page_id", kind.alias("signature"), F.regexp_extract(head, r'lang="(\w+)"', 1).alias("lang"), status.alias("status"))


@query("""
SELECT doc_id, CASE WHEN n_chars > 20000 THEN 'dynamic form' WHEN toxic = 1 THEN 'digital signature' WHEN quality = 0 AND doc_id % 2 = 0 THEN 'form with redo'
               WHEN source = 'src3' AND doc_id % 2 = 1 THEN 'tagged' END AS reason,
       CASE WHEN n_chars IS NULL THEN 'no resolution' WHEN n_chars % 200 < 96 OR (n_chars % 200 = 96 AND doc_id % 200 <= 96) THEN 'low resolution'
            WHEN lang = 'fr' THEN 'alpha channel' WHEN lang = 'de' AND source <> 'src1' THEN 'cmyk without profile' END AS gate
FROM documents LEFT JOIN labels USING (doc_id)
""")
def triage_route(spark, sf):
    t = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    odd = F.col("doc_id") % 2 == 1
    mode = F.when(odd, "default").otherwise("redo")
    no = F.lit(False)
    reason = pages.reject_reason(F.col("n_chars") > 20000, F.coalesce(F.col("toxic") == 1, no), F.coalesce(F.col("quality") == 0, no), F.col("source") == "src3", mode, no)
    gate = pages.image_gate((F.col("n_chars") % 200).cast("double"), (F.col("doc_id") % 200).cast("double"), F.col("lang") == "fr", F.col("lang") == "de", F.col("source") == "src1", no)
    return t.select("doc_id", reason.alias("reason"), gate.alias("gate"))


@query("""
SELECT o_orderkey, CASE coalesce(max(CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_returnflag = 'A' THEN 2 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END), 0)
       WHEN 0 THEN 'mono' WHEN 1 THEN 'gray' WHEN 2 THEN 'indexed' ELSE 'color' END AS device
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def device_escalation(spark, sf):
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).when(F.col("l_linestatus") == "F", 1).otherwise(0)
    most = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(rank).alias("r"))
    t = _t(spark, sf, "orders").join(most, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    names = F.array(*[F.lit(d) for d in pages.DEVICES])
    return t.select("o_orderkey", F.get(names, F.coalesce("r", F.lit(0))).alias("device"))


@query("""
SELECT o_orderkey, count(l_orderkey) > 0 AND coalesce(bool_and(l_returnflag IN ('A', 'N')), false) AS use_jpeg
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def all_jpeg(spark, sf):
    kinds = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("k"))
    t = _t(spark, sf, "orders").join(kinds, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    held = F.coalesce("k", F.array().cast("array<string>"))
    return t.select("o_orderkey", pages.all_of_kind(held, ["A", "N"]).alias("use_jpeg"))


@query("""
WITH x AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_size, l_quantity, l_returnflag, l_linestatus, l_tax, l_discount, p_retailprice,
    CASE WHEN l_returnflag = 'X' THEN 'not an image' WHEN l_extendedprice < 1000 THEN 'small stream' WHEN p_size < 8 OR l_quantity < 8 THEN 'small dimensions'
         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'several filters' WHEN l_tax >= 0.08 THEN 'wide gamut' WHEN l_discount = 0.1 THEN 'decode table' END AS reason
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, reason,
  CASE WHEN reason IS NOT NULL THEN 'none' WHEN p_size % 5 = 0 THEN 'jbig2' WHEN l_returnflag = 'N' THEN 'jpeg' WHEN l_linestatus = 'O' THEN 'png' ELSE 'none' END AS route
FROM x
""")
def optimizer_route(spark, sf):
    t = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    codec = F.when(F.col("l_returnflag") == "N", "dct").otherwise("flate")
    filters = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.array(F.lit("flate"), F.lit("lzw"))).otherwise(F.array(codec))
    kind = F.when(F.col("l_returnflag") == "X", "form").otherwise("image")
    bits = F.when(F.col("l_tax") >= 0.08, 16).when(F.col("p_size") % 5 == 0, 1).otherwise(8)
    reason = pages.skip_reason(kind, F.col("l_extendedprice") / 10, F.col("p_size"), F.col("l_quantity"), filters, bits, F.col("l_discount") == 0.1, F.lit(False))
    route = pages.optimiser_route(F.col("reason"), bits, codec, F.col("l_linestatus") == "F", F.lit(True), F.lit(2))
    return t.withColumn("reason", reason).select("l_orderkey", *LINE_ORDER, "reason", route.alias("route"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R'
""")
def textarea_filter(spark, sf):
    keep = pages.select_boxes(F.col("l_linestatus") == "O", F.col("l_returnflag") == "R", True, False)
    return _t(spark, sf, "lineitem").where(keep).select("l_orderkey", *LINE_ORDER, "l_quantity")


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity < 43.75 AND l_quantity + 2 > 6.25 AND l_discount * 500 < 43.75 AND l_discount * 500 + l_tax * 100 > 6.25)
""")
def interior_semi(spark, sf):
    t = _t(spark, sf, "lineitem")
    b = boxes.box(F.col("l_quantity"), F.col("l_discount") * 500, F.col("l_quantity") + 2, F.col("l_discount") * 500 + F.col("l_tax") * 100)
    page = boxes.box(*[F.lit(v) for v in (6.25, 6.25, 43.75, 43.75)])
    inside = t.where(boxes.overlaps(b, page)).select("l_orderkey")
    return _t(spark, sf, "orders").join(inside, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""
SELECT l_orderkey, p_brand, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS draws, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT (l_linenumber = 1 AND abs(l_quantity - 1) <= 0.001) GROUP BY l_orderkey, p_brand
""")
def name_index(spark, sf):
    t = _t(spark, sf, "lineitem").join(_t(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    unit = (F.col("l_linenumber") == 1) & (F.abs(F.col("l_quantity") - 1) <= 0.001)
    parts = F.array_sort(F.collect_list(F.struct(*LINE_ORDER)))
    out = t.where(~unit).groupBy("l_orderkey", "p_brand").agg(parts.alias("d"))
    return out.select("l_orderkey", "p_brand", F.array_join(F.transform("d", lambda x: x["l_linenumber"].cast("string")), ",").alias("draws"), F.size("d").cast("long").alias("n"))


@query("""
SELECT c_custkey, round((1 + r_regionkey) * (1 + n_nationkey / 10.0) * 0.5, 6) AS scale, round(((1 + n_nationkey / 10.0) * 2 + 3) * 0.5 + c_custkey, 6) AS shift
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def nested_forms(spark, sf):
    zero, one = F.lit(0.0), F.lit(1.0)
    t = _t(spark, sf, "customer").join(F.broadcast(_t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    t = t.join(F.broadcast(_t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = boxes.affine(one + F.col("r_regionkey"), zero, zero, one, F.lit(2.0), zero)
    middle = boxes.affine(one + F.col("n_nationkey") / 10.0, zero, zero, one, F.lit(3.0), zero)
    outer = boxes.affine(F.lit(0.5), zero, zero, one, F.col("c_custkey"), zero)
    m = boxes.compose(boxes.compose(inner, middle), outer)
    return t.withColumn("m", m).select("c_custkey", _r("m.a").alias("scale"), _r("m.e").alias("shift"))


@query("""
WITH o AS (SELECT doc_id, lang, source, substr(text, 1, CAST(n_chars - doc_id % 20 AS INTEGER)) AS t FROM documents)
SELECT o.doc_id, min(d.doc_id) AS original FROM o JOIN documents d ON o.lang = d.lang AND o.source = d.source
WHERE length(d.text) - length(o.t) BETWEEN 1 AND 15 AND starts_with(d.text, o.t) GROUP BY o.doc_id
""")
def truncated_copy_match(spark, sf):
    t = _t(spark, sf, "documents")
    cut = t.select("doc_id", "lang", "source", F.expr("substring(text, 1, int(n_chars - doc_id % 20))").alias("text"))
    return matching.truncated_copies(cut, t, ["lang", "source"], "text", "doc_id").select("doc_id", "original")


@query(r"""
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT page_id, target FROM l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE contains(l.target, 'the') AND p.page_id = l.page_id) AND length(target) > 3
""")
def broken_links(spark, sf):
    t = _t(spark, sf, "pages")
    links = t.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).distinct()
    known = links.where(F.col("target").contains("the")).select("page_id", "target")
    return matching.dangling(links, known, ["page_id", "target"]).where(F.length("target") > 3)


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, labels.doc_id IS NOT NULL AS done FROM documents LEFT JOIN labels USING (doc_id)".replace("labels.doc_id IS NOT NULL", "quality IS NOT NULL"))
def checkpoint_left(spark, sf):
    t = matching.with_checkpoint(_t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels"), ["doc_id"], {"quality": -1, "toxic": 0})
    return t.select("doc_id", "quality", "toxic", F.col("found").alias("done"))


@query("""
SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE '' END AS alpha3 FROM documents
""")
def iso_lookup(spark, sf):
    table = {"en": "eng", "fr": "fra", "de": "deu"}
    return _t(spark, sf, "documents").select("doc_id", matching.lookup(F.col("lang"), table, "").alias("alpha3"))


@query(r"""
WITH w AS (SELECT DISTINCT lang, unnest(string_split(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'), ' ')) AS word FROM documents),
c AS (SELECT DISTINCT lang, word, unnest(string_split(word, '')) AS ch FROM w WHERE word <> ''),
f AS (SELECT 1 AS prio, 'plain' AS font, unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS ch UNION ALL
      SELECT 2, 'western', unnest(string_split('abcdefghijklmnopqrstuvwxyzàâäçèéêëîïñóôöùûüßíáú', '')))
SELECT lang, word, coalesce(arg_min(font, prio), 'fallback') AS font FROM (SELECT lang, word, count(*) AS n FROM c GROUP BY 1, 2)
LEFT JOIN (SELECT lang, word, font, prio, count(*) AS hit FROM c JOIN f USING (ch) GROUP BY 1, 2, 3, 4) USING (lang, word)
WHERE hit IS NULL OR hit = n OR NOT EXISTS (SELECT 1) GROUP BY lang, word
UNION ALL
SELECT lang, word, 'fallback' FROM (SELECT lang, word, count(*) AS n FROM c GROUP BY 1, 2) x
WHERE EXISTS (SELECT 1 FROM c JOIN f USING (ch) WHERE c.lang = x.lang AND c.word = x.word)
  AND NOT EXISTS (SELECT 1 FROM (SELECT c.lang, c.word, font, count(*) AS hit FROM c JOIN f USING (ch) GROUP BY 1, 2, 3) y WHERE y.lang = x.lang AND y.word = x.word AND y.hit = x.n)
""")
def font_coverage(spark, sf):
    words = _t(spark, sf, "documents").select("lang", F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " ")).alias("word"))
    fonts = [("plain", "abcdefghijklmnopqrstuvwxyz"), ("western", "abcdefghijklmnopqrstuvwxyzàâäçèéêëîïñóôöùûüßíáú")]
    return matching.first_covering(words.where("word <> ''").distinct(), "word", fonts, "fallback")


@query(r"""
WITH d AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(regexp_replace(regexp_replace(text, '[0-9_]+', ' ', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ')) AS w FROM benchmark) WHERE length(w) >= 3),
x AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '[0-9_]+', ' ', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ')) AS w FROM documents) WHERE length(w) >= 3)
SELECT doc_id, count(w) AS words, count(*) FILTER (w IN (SELECT w FROM d) OR lower(w) IN (SELECT w FROM d)) AS matched,
       coalesce(round(count(*) FILTER (w IN (SELECT w FROM d) OR lower(w) IN (SELECT w FROM d)) / nullif(count(w), 0), 6), 0.0) AS share
FROM documents LEFT JOIN x USING (doc_id) GROUP BY doc_id
""")
def dictionary_quality(spark, sf):
    words = _t(spark, sf, "benchmark").select(F.explode(text.quality_words(F.col("text"))).alias("word")).distinct()
    out = matching.dictionary_share(_t(spark, sf, "documents"), "doc_id", "text", words)
    return out.select("doc_id", "words", "matched", _r("share").alias("share"))


@query("""
SELECT c.conv_id, c.turn, coalesce(nullif(CASE WHEN c.turn % 3 = 0 THEN '' ELSE c.role END, ''), p.role) AS role
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
""")
def parent_inherit(spark, sf):
    t = _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("own"))
    above = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("above"))
    return t.join(above, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(F.nullif("own", F.lit("")), "above").alias("role"))


@query("""
SELECT doc_id, round(n_chars / strlen(text), 6) AS ratio, round(1 - strlen(text) / n_chars, 6) AS savings,
       strlen(text) * 2 / (n_chars + 4000 + 3000 * 2) >= 1.35 AND n_chars >= 25000 AS warn
FROM documents
""".replace("n_chars / strlen(text)", "n_chars / (strlen(text) * 2)").replace("1 - strlen(text) / n_chars", "1 - strlen(text) * 2 / n_chars"))
def size_report(spark, sf):
    report = pages.size_report(F.col("n_chars"), F.octet_length("text") * 2, F.lit(2), F.array(F.lit("transcoding"), F.lit(None).cast("string")))
    t = _t(spark, sf, "documents").withColumn("s", report)
    return t.select("doc_id", _r("s.ratio").alias("ratio"), _r("s.savings").alias("savings"), F.col("s.warn").alias("warn"))


_ISLANDS = """
WITH n AS (SELECT DISTINCT {keys}, doc_id FROM documents), i AS (SELECT *, doc_id - row_number() OVER (PARTITION BY {keys} ORDER BY doc_id) AS g FROM n),
r AS (SELECT {keys}, min(doc_id) AS a, max(doc_id) AS b FROM i GROUP BY {keys}, g)
SELECT {keys}, string_agg(CASE WHEN a = b THEN CAST(a + 1 AS VARCHAR) ELSE CAST(a + 1 AS VARCHAR) || '-' || CAST(b + 1 AS VARCHAR) END, ', ' ORDER BY a) AS pages
FROM r GROUP BY {keys}
"""


@query(_ISLANDS.format(keys="lang, source"))
def repair_summary(spark, sf):
    return assembly.format_pages(_t(spark, sf, "documents"), ["lang", "source"], "doc_id")


@query(_ISLANDS.format(keys="lang"))
def format_pages(spark, sf):
    return assembly.format_pages(_t(spark, sf, "documents"), ["lang"], "doc_id")


@query("""
SELECT l_partkey, min(l_orderkey) AS first_page FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 7 = 0) GROUP BY l_partkey
""")
def first_use(spark, sf):
    masks = _t(spark, sf, "part").where("p_size % 7 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return _t(spark, sf, "lineitem").join(masks, "l_partkey", "left_anti").groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_page"))


_RUNS = """
WITH p AS (SELECT conv_id, row_number() OVER w AS n, CASE WHEN length(text) > 200 THEN text ELSE '' END AS item FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, CAST(sum(CASE WHEN item <> '' OR coalesce(prev <> '', true) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS BIGINT) AS run
      FROM (SELECT *, lag(item) OVER (PARTITION BY conv_id ORDER BY n) AS prev FROM p)),
r AS (SELECT conv_id, run, CAST(min(n) AS INTEGER) AS first, CAST(max(n) AS INTEGER) AS last, max(nullif(item, '')) AS item FROM s GROUP BY conv_id, run)
"""


def _paged(spark, sf):
    return _t(spark, sf, "conversations").withColumn("item", F.when(F.length("text") > 200, F.col("text")).otherwise(""))


@query(_RUNS + "SELECT conv_id, first, last, md5(item) AS item FROM r")
def compress_ranges(spark, sf):
    return assembly.compress_ranges(_paged(spark, sf), ["conv_id"], "turn", "item").withColumn("item", F.md5("item"))


@query(_RUNS + """SELECT conv_id, md5(string_agg(coalesce(item, '[OCR skipped on page(s) ' || CASE WHEN first = last THEN CAST(first AS VARCHAR)
  ELSE CAST(first AS VARCHAR) || '-' || CAST(last AS VARCHAR) END || ']'), chr(12) ORDER BY first)) AS sidecar FROM r GROUP BY conv_id""")
def merge_sidecars(spark, sf):
    return assembly.merge_sidecars(_paged(spark, sf), ["conv_id"], "turn", "item").withColumn("sidecar", F.md5("sidecar"))


@query("""
SELECT user_id, bool_and(coalesce(value > prev, true)) AS rising FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id
""")
def monotonic_check(spark, sf):
    return assembly.strictly_rising(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")


@query("""
WITH s AS (SELECT event_id, user_id, ts, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS s FROM events)
SELECT event_id, CAST(s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS depth FROM s
""")
def graphics_stack_depth(spark, sf):
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return assembly.stack_depth(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], step).select("event_id", "depth")


@query()
def graphics_stack_fold(spark, sf):
    e = _t(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "push").when(F.col("event_type") == "error", "pop").when(F.col("event_type") == "click", "move").otherwise("draw")
    one, zero = F.lit(1.0), F.lit(0.0)
    k = F.get_json_object("props", "$.k").cast("double")
    t = e.withColumn("op", kind).select("*", F.inline(F.array(boxes.affine(one + k / 1000, zero, zero, one, k, zero))))
    out = folds.graphics_states(t, ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "draws", "deepest", "status", _r("a").alias("last_scale"))


@query("""
WITH b AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS blk FROM events),
i AS (SELECT *, blk > 0 AND coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, blk ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS inside FROM b),
l AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS INTEGER) % 4 END IGNORE NULLS)
        OVER (PARTITION BY user_id, blk, inside ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m FROM i)
SELECT event_id FROM l WHERE NOT (inside AND coalesce(m = 3, false))
""")
def strip_blocks(spark, sf):
    mode = F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k").cast("int") % 4)
    out = assembly.strip_blocks(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error", mode)
    return out.select("event_id")


@query()
def log_dedupe(spark, sf):
    return folds.shown_messages(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
SELECT conv_id, turn, length(text) - coalesce(lag(length(text)) OVER w, 0) AS delta, coalesce(lead(length(text)) OVER w > length(text), false) AS spaced
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def word_spacing(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    return _t(spark, sf, "conversations").select(
        "conv_id", "turn", (n - F.coalesce(F.lag(n).over(w), F.lit(0))).cast("long").alias("delta"), F.coalesce(F.lead(n).over(w) > n, F.lit(False)).alias("spaced"))


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 AS INTEGER) AS worker FROM documents")
def round_robin(spark, sf):
    return pages.round_robin(_t(spark, sf, "documents"), [F.col("doc_id")], 4, ["source"]).select("doc_id", "worker")


@query("""
SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_name, p_partkey) AS r FROM part) WHERE r = 1
""")
def ranked_candidates(spark, sf):
    return pages.best_by(_t(spark, sf, "part"), ["p_brand"], [F.col(c) for c in ("p_size", "p_name", "p_partkey")]).select("p_brand", "p_partkey", "p_name")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'fast' WHEN c_mktsegment = 'BUILDING' THEN 'slow' WHEN c_nationkey % 2 = 0 THEN 'last' END AS result,
       CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_mktsegment = 'BUILDING' THEN 2 WHEN c_nationkey % 2 = 0 THEN 3 END AS attempt FROM customer
""")
def first_success(spark, sf):
    tries = [F.when(F.col("c_acctbal") > 5000, "fast"), F.when(F.col("c_mktsegment") == "BUILDING", "slow"), F.when(F.col("c_nationkey") % 2 == 0, "last")]
    return _t(spark, sf, "customer").select("c_custkey", F.inline(F.array(engines.first_success(tries))))


@query("""
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey)))[1:3], ',') AS top, greatest(len(list_distinct(list(l_partkey))) - 3, 0) AS more FROM lineitem GROUP BY l_orderkey
""")
def top3_and_more(spark, sf):
    t = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    return t.select("l_orderkey", F.array_join(F.slice("p", 1, 3).cast("array<string>"), ",").alias("top"), F.greatest(F.size("p") - 3, F.lit(0)).cast("long").alias("more"))


@query("""
SELECT 'missing' AS kind, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'both', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)
""")
def set_differences(spark, sf):
    d, l = _t(spark, sf, "documents").select("doc_id"), _t(spark, sf, "labels")
    missing = d.subtract(l.select("doc_id")).select(F.lit("missing").alias("kind"), "doc_id")
    return missing.unionByName(d.intersect(l.where("toxic = 1").select("doc_id")).select(F.lit("both").alias("kind"), "doc_id"))


@query("""
SELECT 'vector' AS marker, CAST(r_regionkey AS BIGINT) AS id FROM region UNION ALL SELECT 'text', CAST(n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT 'inline', s_suppkey FROM supplier UNION ALL SELECT 'image', p_partkey FROM part UNION ALL SELECT 'form', c_custkey FROM customer
""")
def union_markers(spark, sf):
    scans = [("vector", "region", "r_regionkey"), ("text", "nation", "n_nationkey"), ("inline", "supplier", "s_suppkey"), ("image", "part", "p_partkey"), ("form", "customer", "c_custkey")]
    return matching.union_scans([_t(spark, sf, t).select(F.lit(m).alias("marker"), F.col(c).cast("long").alias("id")) for m, t, c in scans])


@query("""
SELECT doc_id, source AS title, CASE WHEN lang = 'de' THEN 'unknown' ELSE lang END AS language, '' AS author FROM documents
""")
def map_override(spark, sf):
    base = F.create_map(*[F.lit(v) for v in ("title", "none", "language", "unknown", "author", "")])
    own = F.create_map(F.lit("title"), F.col("source"), F.lit("language"), F.when(F.col("lang") == "de", "").otherwise(F.col("lang")))
    t = _t(spark, sf, "documents").withColumn("m", matching.override(base, own))
    return t.select("doc_id", *[F.col("m")[k].alias(k) for k in ("title", "language", "author")])


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation),
walk(root, id, depth) AS (SELECT src, src, 0 FROM e UNION ALL SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.depth < 10)
SELECT DISTINCT root, id FROM walk WHERE depth > 0
""")
def xref_recursion(spark, sf):
    e = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return assembly.reachable(spark, e, e.select(F.col("src").alias("root")))


@query("""
WITH n AS (SELECT r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey, s_name FROM supplier)
SELECT r.id AS root, string_agg(s.name, ' ' ORDER BY n.id, s.id) AS text, count(*) AS leaves
FROM n r JOIN n ON n.parent = r.id JOIN n s ON s.parent = n.id WHERE r.parent IS NULL GROUP BY r.id
""")
def tree_walk(spark, sf):
    region = _t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"))
    nation = _t(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), F.col("n_name").alias("name"))
    supplier = _t(spark, sf, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), (F.col("s_nationkey") + 100).cast("long").alias("parent"), F.col("s_name").alias("name"))
    walked = assembly.tree_paths(region.unionByName(nation).unionByName(supplier), 2).where(F.size("path") == 3)
    parts = F.array_sort(F.collect_list(F.struct("path", "name")))
    return walked.groupBy(F.get("path", F.lit(0)).alias("root")).agg(F.array_join(F.transform(parts, lambda p: p["name"]), " ").alias("text"), F.count("*").alias("leaves")).select(F.col("root"), "text", "leaves")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN CAST(l_quantity AS INTEGER) + l_linenumber - 3 >= CAST(l_quantity AS INTEGER) THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END AS x0,
  CASE WHEN CAST(l_quantity AS INTEGER) + l_linenumber - 3 >= CAST(l_quantity AS INTEGER) THEN CAST(CAST(l_quantity AS INTEGER) + l_linenumber - 3 AS DOUBLE) END AS x1,
  CASE WHEN l_linenumber > 2 THEN CAST(-l_linenumber AS DOUBLE) END AS intercept, CAST(l_quantity AS INTEGER) / 100.0 AS confidence, l_linenumber * 300 AS dpi
FROM lineitem
""")
def hocr_fields(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber")
    title = F.concat(
        F.lit("bbox "), q, F.lit(" 10 "), F.greatest(F.col("l_quantity").cast("int") + n - 3, F.lit(0)).cast("string"), F.lit(" 20; baseline "),
        F.when(n > 2, F.lit("0.5 ")).otherwise(F.lit(". ")), (-n).cast("string"), F.lit("; x_wconf "), q, F.lit("; scan_res "), (n * 300).cast("string"), F.lit(" 300"))
    t = _t(spark, sf, "lineitem").withColumn("title", title).withColumn("b", text.title_box(F.col("title")))
    return t.select(
        "l_orderkey", *LINE_ORDER, F.col("b.left").alias("x0"), F.col("b.right").alias("x1"), text.title_baseline(F.col("title"))["intercept"].alias("intercept"),
        text.title_confidence(F.col("title")).alias("confidence"), text.title_number(F.col("title"), "scan_res").alias("dpi"))


@query("SELECT doc_id, md5('fi ' || trim(text) || ' 1a') AS plain FROM documents")
def nfkc_text(spark, sf):
    written = F.concat(F.lit(" \ufb01 "), F.trim("text"), F.lit(" \u2460\uff41 "))
    return _t(spark, sf, "documents").select("doc_id", F.md5(text.normalised(written)).alias("plain"))


@query("""
SELECT doc_id, doc_id % 6 IN (1, 2, 3) AS rtl, doc_id % 6 = 4 AS cjk, md5(reverse(t)) AS turned
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN '12 שלום ' || text WHEN 2 THEN '(مرحبا) ' || text WHEN 3 THEN 'ܐܒ ' || text WHEN 4 THEN '漢字かな𠀀。' WHEN 5 THEN 'ㄅ' ELSE text END AS t FROM documents)
""")
def script_direction(spark, sf):
    n = F.col("doc_id") % 6
    led = lambda sign: F.concat(F.lit(sign), F.col("text"))
    written = F.when(n == 1, led("12 שלום ")).when(n == 2, led("(مرحبا) ")).when(n == 3, led("ܐܒ ")).when(n == 4, "漢字かな𠀀。").when(n == 5, "ㄅ").otherwise(F.col("text"))
    t = _t(spark, sf, "documents").select("doc_id", written.alias("t"))
    return t.select("doc_id", text.reads_right_to_left(F.col("t")).alias("rtl"), text.only_cjk(F.col("t")).alias("cjk"), F.md5(F.reverse("t")).alias("turned"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_linenumber + 3 < CAST(l_quantity AS INTEGER) THEN 'reversed' END AS status,
  CASE WHEN l_linenumber + 3 >= CAST(l_quantity AS INTEGER) THEN CAST(list_sum(list_distinct(list_concat(range(CAST(l_quantity AS INTEGER) - 1, l_linenumber + 3), [99], [0]))) AS BIGINT) END AS total
FROM lineitem
""")
def page_ranges(spark, sf):
    spec = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("-"), (F.col("l_linenumber") + 3).cast("string"), F.lit(", end,,1"))
    t = _t(spark, sf, "lineitem").withColumn("p", text.page_ranges(spec, F.lit(100)))
    total = F.aggregate("p.pages", F.lit(0).cast("long"), lambda s, x: s + x)
    return t.select("l_orderkey", *LINE_ORDER, F.col("p.status").alias("status"), total.alias("total"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  abs(l_extendedprice - l_quantity * p_retailprice) <= 0.002 * greatest(abs(l_extendedprice), abs(l_quantity * p_retailprice)) AS same
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def tolerant_equality(spark, sf):
    t = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return t.select("l_orderkey", *LINE_ORDER, numbers.rel_close(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")).alias("same"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_size * 100 AS w, CAST(l_quantity AS BIGINT) * 1000 AS h FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT * EXCLUDE (w, h), CASE WHEN f < 1 THEN CAST(floor(w * f) AS BIGINT) ELSE w END AS w, CASE WHEN f < 1 THEN CAST(floor(h * f) AS BIGINT) ELSE h END AS h FROM (SELECT *, least(4000 / w, 30000 / h) AS f FROM a)),
c AS (SELECT * EXCLUDE (w, h), CASE WHEN w * h > 20000000 THEN CAST(floor(w * sqrt(20000000.0::DOUBLE / (w * h))) AS BIGINT) ELSE w END AS w, CASE WHEN w * h > 20000000 THEN CAST(floor(h * sqrt(20000000.0::DOUBLE / (w * h))) AS BIGINT) ELSE h END AS h FROM b),
d AS (SELECT * EXCLUDE (w, h), CASE WHEN w * 4 * h > 30000000 THEN CAST(floor(floor(w * 4 * sqrt(30000000.0::DOUBLE / (w * 4 * h))) / 4) AS BIGINT) ELSE w END AS w, CASE WHEN w * 4 * h > 30000000 THEN CAST(floor(h * sqrt(30000000.0::DOUBLE / (w * 4 * h))) AS BIGINT) ELSE h END AS h FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, w, h FROM d
""")
def downsample(spark, sf):
    t = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    size = numbers.fit_image(F.col("p_size") * 100, F.col("l_quantity").cast("long") * 1000, F.lit(4), 4000, 30000, 20_000_000, 30_000_000)
    return t.select("l_orderkey", *LINE_ORDER, F.inline(F.array(size)))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity * 10 AS x0, l_quantity * 10 + (l_linenumber - 2) * 100 AS x1, l_discount * 4000 AS y0, l_discount * 4000 + l_tax * 9000 AS y1 FROM lineitem),
o AS (SELECT *, least(x0, x1) AS a, greatest(x0, x1) AS c, least(y0, y1) AS b, greatest(y0, y1) AS d, x1 < x0 OR y1 < y0 AS turned FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN least(c, 400) - greatest(a, 0) <= 0 OR least(d, 700) - greatest(b, 0) <= 0 THEN 'discarded'
       WHEN greatest(a, 0) <> a OR greatest(b, 0) <> b OR least(c, 400) <> c OR least(d, 700) <> d THEN 'clamped' WHEN turned THEN 'reordered' END AS kind,
  CASE WHEN NOT (least(c, 400) - greatest(a, 0) <= 0 OR least(d, 700) - greatest(b, 0) <= 0) THEN round(least(c, 400), 6) END AS right
FROM o
""")
def box_repair(spark, sf):
    x, y = F.col("l_quantity") * 10, F.col("l_discount") * 4000
    sub = boxes.box(x, y, x + (F.col("l_linenumber") - 2) * 100, y + F.col("l_tax") * 9000)
    media = boxes.box(*[F.lit(v) for v in (0, 0, 400, 700)])
    t = _t(spark, sf, "lineitem").withColumn("r", boxes.repair(media, sub))
    return t.select("l_orderkey", *LINE_ORDER, F.col("r.kind").alias("kind"), _r("r.box.x1").alias("right"))


@query("""
SELECT event_id, CAST(((90 - k * 90) % 360 + 360) % 360 AS INTEGER) AS misaligned, CAST(((k * 90 - 90) % 360 + 360) % 360 AS INTEGER) AS rotation,
  CAST(CASE WHEN value >= 14 AND (k * 90) % 360 <> 0 THEN (k * 90) % 360 ELSE 0 END AS INTEGER) AS correction
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
""")
def rotation_math(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") * 90
    right, no = F.lit(90), F.lit(False)
    return _t(spark, sf, "events").select("event_id", numbers.text_misalignment(k, right, no).alias("misaligned"), numbers.page_rotation(k, right, no).alias("rotation"), numbers.orientation_correction(k, F.col("value")).alias("correction"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN abs(l_discount - l_tax) <= 1e-3 AND l_linenumber % 2 = 0 THEN CASE WHEN abs(l_discount) <= 1e-3 THEN 'mono' ELSE 'gray' END
       WHEN l_linenumber % 2 = 0 THEN 'color' WHEN abs(l_discount) <= 1e-3 OR abs(l_discount - 1) <= 1e-3 THEN 'mono' ELSE 'gray' END AS ink
FROM lineitem
""")
def ink_class(spark, sf):
    d, x = F.col("l_discount"), F.col("l_tax")
    parts = F.when(F.col("l_linenumber") % 2 == 0, F.array(d, x, d)).otherwise(F.array(d))
    return _t(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER, numbers.ink_of(parts).alias("ink"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_quantity * 72 / 300.0, 6) AS x_pt,
  round(CASE WHEN abs(l_discount) < 0.005 THEN 0 ELSE degrees(atan(l_discount)) END, 6) AS angle,
  round(CASE WHEN l_quantity - l_linenumber * 5 < 1 THEN 0.8 * l_quantity ELSE l_quantity - l_linenumber * 5 END, 6) AS font_size
FROM lineitem
""")
def line_layout(spark, sf):
    slope = F.when(F.abs("l_discount") < 0.005, F.lit(0.0)).otherwise(F.col("l_discount"))
    size = F.col("l_quantity") - F.col("l_linenumber") * 5
    return _t(spark, sf, "lineitem").select(
        "l_orderkey", *LINE_ORDER, _r(F.col("l_quantity") * 72 / 300.0).alias("x_pt"), _r(F.degrees(F.atan(slope))).alias("angle"),
        _r(F.when(size < 1, 0.8 * F.col("l_quantity")).otherwise(size)).alias("font_size"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, -1 AS missing, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS encoded FROM events
""")
def json_roundtrip(spark, sf):
    parsed = F.from_json("props", "k int, other int")
    t = _t(spark, sf, "events").withColumn("p", parsed)
    return t.select("event_id", F.col("p.k").alias("k"), F.coalesce("p.other", F.lit(-1)).alias("missing"), F.to_json("p").alias("encoded"))


@query("SELECT event_id, event_type AS kind, CAST(user_id + 1 AS VARCHAR) AS id, 2 AS n FROM events")
def kv_parse(spark, sf):
    lines = F.concat(F.lit("kind: "), F.col("event_type"), F.lit("\na: b: c\nid: 0\nid: "), (F.col("user_id") + 1).cast("string"))
    t = _t(spark, sf, "events").withColumn("m", text.key_values(lines))
    return t.select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["id"].alias("id"), F.size("m").alias("n"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def udtf_words(spark, sf):
    files.register(spark)
    _t(spark, sf, "documents").select("doc_id", "text").createOrReplaceTempView("_udtf_documents")
    return spark.sql("SELECT doc_id, place, word FROM _udtf_documents, LATERAL page_words(text)")


@query(r"""
SELECT doc_id, 'word_' || CAST(i - 1 AS VARCHAR) AS node, w[i] AS word, CAST(i * 10 AS DOUBLE) AS x0, CAST(0.9 AS DOUBLE) AS confidence
FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w FROM documents))
""")
def hocr_parse(spark, sf):
    return _word_nodes(spark, sf, _letter_words())


@query()
def hocr_parse_whole(spark, sf):
    """The same under its former name."""
    return _word_nodes(spark, sf, _letter_words())


@query()
def script_direction_whole(spark, sf):
    """script_direction of the texts as they are."""
    t = _t(spark, sf, "documents")
    return t.select("doc_id", text.reads_right_to_left(F.col("text")).alias("rtl"), text.only_cjk(F.col("text")).alias("cjk"), F.md5(F.reverse("text")).alias("turned"))


def _letter_words():
    return F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))


def _word_nodes(spark, sf, words):
    span = F.transform(words, lambda w, i: F.format_string("<span class='ocrx_word' id='word_%d' title='bbox %d 0 %d 9; x_wconf 90'>%s</span>", i, (i + 1) * 10, (i + 1) * 10 + 9, w))
    page = F.concat(F.lit("<!DOCTYPE html><html xmlns='http://www.w3.org/1999/xhtml'><body><div class='ocr_page' title='bbox 0 0 100 100; ppageno 0'><span class='ocr_line' title='bbox 0 0 90 9'>"), F.array_join(span, " "), F.lit("</span></div></body></html>"))
    nodes = recognised.parse_nodes(_t(spark, sf, "documents").select("doc_id", page.alias("markup")), "doc_id", "markup")
    return nodes.where("kind = 'ocrx_word'").select("doc_id", F.col("name").alias("node"), F.col("text").alias("word"), F.col("box.left").alias("x0"), "confidence")


@query("""
SELECT event_id, format('{:06d}_{}', CAST(user_id AS INTEGER) + 1, event_type) AS file, CAST(user_id AS INTEGER) AS page, strftime(ts, '%Y/%m') AS folder FROM events
""")
def artefact_names(spark, sf):
    name = text.page_file(F.col("user_id").cast("int"), F.col("event_type"))
    return _t(spark, sf, "events").select("event_id", name.alias("file"), text.page_of_file(name).alias("page"), F.date_format("ts", "yyyy/MM").alias("folder"))


@query("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'click' THEN NULL ELSE 'info' END AS level FROM events
""")
def log_classifier(spark, sf):
    e = F.col("event_type")
    line = F.when(e == "error", "An Exception occurred").when(e == "signup", "OSD: Weak margin (1.0)").when(e == "click", "Tesseract Open Source OCR Engine").otherwise("Page 1")
    return _t(spark, sf, "events").select("event_id", text.log_level(line).alias("level"))


@query("""
SELECT p_partkey, list_transform(string_split(CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 13 AS VARCHAR), '.'), lambda x: CAST(x AS INTEGER)) >= [10, 6] AS recent FROM part
""")
def version_order(spark, sf):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 13).cast("string"))
    return _t(spark, sf, "part").select("p_partkey", (text.version_key(v) >= F.array(F.lit(10), F.lit(6))).alias("recent"))


@query("""
SELECT n.n_nationkey, c.r_regionkey, NOT (n_name = r_name OR starts_with(n_name, r_name || '/') OR starts_with(r_name, n_name || '/')) AS apart FROM nation n, region c
""")
def path_isolation(spark, sf):
    n, r = _t(spark, sf, "nation"), _t(spark, sf, "region")
    # the configured folders are a table of a few rows, joined to every data folder
    t = n.select("n_nationkey", "n_name").join(F.broadcast(r.select("r_regionkey", "r_name")), F.lit(True))
    return t.select("n_nationkey", "r_regionkey", pages.safe_paths(F.col("n_name"), F.col("r_name")).alias("apart"))


@query("SELECT doc_id, 0 AS pageno, '' AS text, 0 AS orientation FROM documents")
def null_recognition(spark, sf):
    t = _t(spark, sf, "documents").select("doc_id", F.lit(0).alias("pageno"))
    return engines.recognise(t, engines.Hooks()).select("doc_id", "pageno", "text", "orientation")


@query("""
SELECT event_type, count(*) AS n, strftime(ts, '%Y/%m') AS folder FROM events GROUP BY event_type, strftime(ts, '%Y/%m')
""")
def stream_ingest(spark, sf):
    return folder.ingest_events(spark, f"{sf}/events.parquet").groupBy("event_type", "folder").agg(F.count("*").alias("n"))


@query()
def stream_dedupe(spark, sf):
    return folder.dedupe_stream(spark, f"{sf}/events.parquet")


def queries() -> dict[str, Query]:
    from . import rules  # noqa: F401  registers its queries here

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import rules  # noqa: F401

    return dict(_sql)
