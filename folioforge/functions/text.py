"""Text rules: fields of recognised-text titles, page ranges, scripts, versions, messages."""

from __future__ import annotations

import base64
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


# fields of a recognised-text title, `name value; name value; ...`


def title_box(title: Column) -> Column:
    """Struct (left, top, right, bottom) of doubles; null if missing or turned around."""
    pattern = r"bbox\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)"
    left, top, right, bottom = (found(title, pattern, i).cast("double") for i in range(1, 5))
    box = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    return F.when((right >= left) & (bottom >= top), box)


def title_baseline(title: Column) -> Column:
    """Struct (slope, intercept): an empty slope is level, a lone point is no baseline."""
    pattern = r"baseline\s+([-+]?\d*\.?\d*)\s+([-+]?\d+)"
    slope = F.regexp_extract(title, pattern, 1)
    intercept = found(title, pattern, 2).cast("int").cast("double")
    number = F.when(slope == "", F.lit(0.0)).otherwise(F.expr("try_cast(null as double)"))
    number = F.when(slope.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), slope.try_cast("double")).otherwise(number)
    return F.when(intercept.isNotNull() & number.isNotNull(), F.struct(number.alias("slope"), intercept.alias("intercept")))


def title_angle(title: Column) -> Column:
    return found(title, r"textangle\s+([-+]?\d*\.?\d*)").try_cast("double")


def title_confidence(title: Column) -> Column:
    """Share from 0 to 1; decimals are not read."""
    return found(title, r"x_wconf\s+(\d+)").cast("double") / 100.0


def title_number(title: Column, name: str) -> Column:
    return found(title, rf"{name}\s+(\d+)").cast("int")


def title_resolution(title: Column) -> Column:
    """The first of the two numbers of a scan's resolution; null unless both are there."""
    return found(title, r"scan_res\s+(\d+)\s+\d+").cast("double")


def title_font(title: Column) -> Column:
    """Struct (name, size): a name without white space, a size whose whole part may be left out;
    null if neither is given."""
    name, size = found(title, r"x_font\s+([^\s;]+)"), found(title, r"x_fsize\s+(\d*\.?\d+)").try_cast("double")
    return F.when(name.isNotNull() | size.isNotNull(), F.struct(name.alias("name"), size.alias("size")))


@F.pandas_udf(StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC) without white space at the ends; no built-in has it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).strip())


@F.pandas_udf(StringType())
def described(texts: pd.Series) -> pd.Series:
    """Code point and name of the first character."""
    return texts.map(lambda t: None if not t else f"U+{ord(t[0]):04X} {unicodedata.name(t[0], '(unnamed)')}")


def quality_words(text: Column) -> Column:
    """Distinct words of three or more letters, after digits and other signs are blanked."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[0-9_]+", " "), r"[^\p{L}\p{N}_]+", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= 3))


#: Blocks whose letters run from right to left, and the marks of either direction.
RIGHT_TO_LEFT = r"\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}"


def reads_right_to_left(text: Column) -> Column:
    """Whether the first character with a direction of its own (a letter or a direction mark) runs
    from right to left."""
    return text.rlike(rf"^[^\p{{L}}\x{{200E}}\x{{200F}}]*(?:\x{{200F}}|[{RIGHT_TO_LEFT}&&\p{{L}}])")


#: Blocks of Chinese, Japanese and Korean writing, which has no spaces.
CJK = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}"
    r"\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{AC00}-\x{D7AF}"
    r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
)


def only_cjk(text: Column) -> Column:
    """Whether all characters are of such writing; true of the empty text."""
    return text.rlike(rf"(?s)^[{CJK}]*\z")


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, comparable part by part."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def languages(spec: Column) -> Column:
    """Codes of a specification such as ``eng+deu``, each once."""
    return F.array_distinct(F.split(spec, r"\+"))


def page_file(pageno: Column, name: Column) -> Column:
    """File name of a page's artefact; its number counts from 1."""
    return F.format_string("%06d_%s", pageno + 1, name)


def page_of_file(file: Column) -> Column:
    return F.substring(file, 1, 6).cast("int") - 1


def key_values(text: Column) -> Column:
    """Map of the lines ``key: value``; lines with another number of colons do not count, the
    last of a key wins."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.split(x, ":"))
    pairs = F.transform(
        F.filter(lines, lambda p: F.size(p) == 2),
        lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("key"), F.trim(F.get(p, F.lit(1))).alias("value")),
    )
    keep = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]),
    )
    return F.map_from_entries(keep)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def page_ranges(spec: Column, total: Column, most: int = 1_000_000) -> Column:
    """Struct (pages array<int> from 0, status): ``1,3-5,end`` as distinct pages in order of
    mention. status is null or why the specification is refused. Ranges are cut at ``most`` or
    the total, whichever is larger, before they are spelled out."""
    filled = F.replace(F.replace(F.lower(spec), F.lit("end"), total.cast("string")), F.lit(" "), F.lit(""))
    one = r"^(\d+)(?:-(\d+))?$"

    def bounds(part: Column) -> Column:
        first, last = F.nullif(F.regexp_extract(part, one, 1), F.lit("")), F.nullif(F.regexp_extract(part, one, 2), F.lit(""))
        return F.struct(first.try_cast("long").alias("a"), F.coalesce(last, first).try_cast("long").alias("b"))

    def judged(parts: Column) -> Column:
        status = (
            F.when(F.size(parts) == 0, "empty")
            .when(F.exists(parts, lambda x: x["a"].isNull() | x["b"].isNull()), "not a number")
            .when(F.exists(parts, lambda x: x["a"] < 1), "below one")
            .when(F.exists(parts, lambda x: x["b"] < x["a"]), "reversed")
        )
        upto = F.greatest(F.lit(most), F.coalesce(total, F.lit(0))).cast("long")
        within = F.filter(parts, lambda x: x["a"] <= upto)
        spelled = F.transform(within, lambda x: F.sequence((x["a"] - 1).cast("int"), (F.least(x["b"], upto) - 1).cast("int")))
        return let(status, lambda why: F.struct(F.when(why.isNull(), F.array_distinct(F.flatten(spelled))).alias("pages"), why.alias("status")))

    parts = F.filter(F.split(filled, ","), lambda p: p != "")
    return let(F.transform(parts, bounds), judged)


def log_level(line: Column) -> Column:
    """Level of a recognition engine's message: the first rule that fits decides; null drops it."""
    low = F.lower(line)
    return (
        F.when(line.startswith("Tesseract Open Source") | line.startswith("Warning in pixReadMem"), F.lit(None).cast("string"))
        .when(line.contains("diacritics"), "warning")
        .when(line.startswith("OSD: Weak margin"), "warning")
        .when(line.contains("Error in pixScanForForeground") | line.contains("Error in boxClipToRectangle"), F.lit(None).cast("string"))
        .when(low.contains("parameter not found: "), "fatal")
        .when(low.contains("error") | low.contains("exception"), "error")
        .when(low.contains("warning"), "warning")
        .when(low.contains("read_params_file"), "fatal")
        .otherwise("info")
    )


def has_private_or_astral(text: Column) -> Column:
    """Whether a metadata text holds characters that older readers cannot show."""
    return text.rlike(r"[\p{Co}\x{10000}-\x{10FFFF}]")


def pdf_date(ts: Column) -> Column:
    return F.date_format(ts, "'D:'yyyyMMddHHmmss'+00''00'''")


def language_list(output: Column) -> Column:
    """Languages that an engine names, one a line after a headline."""
    lines = F.split(F.regexp_replace(output, r"\s+\z", ""), "\n")
    return F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x))


def without_nul(value: Column) -> Column:
    """A document property without NUL characters."""
    return F.replace(value, F.lit("\0"), F.lit(""))


def creator_tag(renderer: Column, product: str, version: Column) -> Column:
    """What a file names as its creator, by the renderer of its text."""
    engine = F.concat(F.lit("Tesseract OCR "), version)
    return (
        F.when(renderer == "hocr", F.concat(F.lit(f"{product} hOCR + "), engine))
        .when(renderer.isin("fpdf2", "auto"), F.concat(F.lit(f"{product} fpdf2 + "), engine))
        .when(renderer == "sandwich", F.concat(F.lit("Tesseract OCR + PDF "), version))
        .otherwise(engine)
    )


#: How the message on a page's rotation shows directions and turns.
DIRECTIONS, TURNS = {0: "⇧", 90: "⇨", 180: "⇩", 270: "⇦"}, {0: " ", 90: "⬏", 180: "↻", 270: "⬑"}


def rotation_message(existing: Column, angle: Column, confidence: Column, correction: Column, threshold: float = 14.0) -> Column:
    """What is said of a page's rotation: where it faces, how sure that is, what is done. The
    confidence is rounded half to even, as decimal fractions of a double are printed."""

    def shown(x: Column, table: dict[int, str]) -> Column:
        out = F.lit("?")
        for degrees, sign in table.items():
            out = F.when(x == degrees, sign).otherwise(out)
        return out

    action = F.when(confidence >= threshold, F.when(correction != 0, F.concat(F.lit("will rotate "), shown(correction, TURNS))).otherwise("rotation appears correct")).otherwise(
        F.when(correction != 0, "confidence too low to rotate").otherwise("no change")
    )
    before = F.when(existing != 0, F.concat(F.lit("with existing rotation "), shown(existing, DIRECTIONS), F.lit(", "))).otherwise("")
    number = F.format_string("%.2f", F.bround(confidence, 2))
    return F.concat(before, F.lit("page is facing "), shown(angle, DIRECTIONS), F.lit(", confidence "), number, F.lit(" - "), action)


def font_variant(stem: Column, base: Column) -> Column:
    """Which face of a font family a file is: regular, variable, vf, plain, or null for any other
    (a bold face, a longer family name)."""
    return (
        F.when(stem == F.concat(base, F.lit("-Regular")), "regular")
        .when(stem.startswith(F.concat(base, F.lit("["))), "variable")
        .when(stem == F.concat(base, F.lit("-VF")), "vf")
        .when(stem == base, "plain")
    )


def font_family(stem: Column, prefix: str = "Noto") -> Column:
    """The family that a font file is the regular face of; null for other faces and families."""

    def family(head: Column) -> Column:
        bare = F.regexp_replace(head, r"-(Regular|VF)\z", "")
        return F.when(bare.startswith(prefix) & ~bare.contains("-"), bare)

    return let(F.substring_index(stem, "[", 1), family)


def font_order(family: Column) -> list[Column]:
    """Sort columns of font families: sans, serif, others; narrow cousins later; then by name."""
    rank = F.when(family.startswith("NotoSans"), 0).when(family.startswith("NotoSerif"), 1).otherwise(2)
    return [rank, (family.endswith("UI") | family.startswith("NotoSansMono")).cast("int"), family]


def progress_total(line: Column) -> Column:
    """The number of pages that a converter announces at the start of a line."""
    return found(F.trim(line), r"^Processing pages \d+ through (\d+).").cast("int")


def progress_step(line: Column) -> Column:
    """Whether a converter's line says that a page is done."""
    return F.trim(line).rlike(r"^Page \d+")


def mapped_character(text: Column) -> Column:
    """A character as shown: one without a known meaning is the replacement character."""
    return F.when(text.startswith("(cid:") & text.endswith(")"), "\ufffd").otherwise(text)


def reports_error(log: Column) -> Column:
    return log.rlike(r"(?i)error")


def reports_color_problem(log: Column) -> Column:
    """Whether a converter says that a multi-ink color has an unfit alternate."""
    return log.rlike(r"(?i)DeviceN.*inappropriate alternate")


def empty_page(output: Column, code: Column) -> Column:
    """Whether an engine's failure only means that there is nothing on the page."""
    return output.contains("Empty page!!") | (code == 1) & ((output == "") | output.startswith("Error in boxClipToRectangle: box outside rectangle"))


def code_point(text: Column) -> Column:
    """U+XXXX of the first character."""
    return F.format_string("U+%04X", F.ascii(text))


def object_definition(alias: Column, entries: Column, stream: Column | None = None) -> Column:
    """Lines that define a dictionary for a converter; ``entries`` is an array of struct (name,
    value), ``stream`` the ASCII data of a named stream, already encoded."""
    lines = F.transform(entries, lambda e: F.concat(F.lit("  "), e["name"], F.lit(" "), e["value"]))
    kind = F.lit("/dict" if stream is None else "/stream")
    define = F.when(alias != "{Catalog}", F.array(F.concat(F.lit("[/_objdef "), alias, F.lit(" /type "), kind, F.lit(" /OBJ pdfmark"))))
    data = [] if stream is None else [F.array(F.concat(F.lit("/ICCProfile "), stream), F.lit("def"))]
    after = [] if stream is None else [F.array(F.concat(F.lit("["), alias, F.lit(" ICCProfile /PUT pdfmark")))]
    parts = [
        *data, F.coalesce(define, F.array().cast("array<string>")), F.array(F.concat(F.lit("["), alias, F.lit(" <<"))), lines,
        F.array(F.lit(">> /PUT pdfmark")), *after,
    ]
    return F.array_join(F.concat(*parts), "\n")


@F.pandas_udf(StringType())
def ascii85(data: pd.Series) -> pd.Series:
    """Bytes in base 85 between its marks; no built-in has it."""
    return data.map(lambda x: None if x is None else base64.a85encode(bytes(x), adobe=True).decode("ascii"))
