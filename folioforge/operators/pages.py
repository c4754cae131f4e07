"""Decisions on documents, pages and images as ladders of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mapped_character, progress_step, progress_total
from .storage import settled

#: Exit codes of a document's processing.
STATUS = {
    "ok": 0, "bad_args": 1, "input_file": 2, "missing_dependency": 3, "invalid_output": 4, "file_access": 5,
    "already_done": 6, "child_process": 7, "encrypted": 8, "invalid_config": 9, "pdfa_failed": 10, "other": 15, "ctrl_c": 130,
}
#: Raster devices in rising order of what they can show.
DEVICES = ["mono", "gray", "indexed", "color"]
JPEG_KINDS = ["jpeg", "flate_jpeg"]


def needs_recognition(
    mode: Column, has_text: Column, has_images: Column, pixels: Column, requested: Column, lossless: Column, skip_big: Column
) -> Column:
    """Struct (required, error): whether a page goes through recognition.

    The first of these decides: stripping; not requested; text under each mode; a blank page
    without images in a pass that is not lossless. A page that would go is held back if it is
    larger than ``skip_big`` megapixels. Text in the default mode is an error of the page, as
    data, not an exception of the job.
    """
    wanted = (
        F.when(mode == "strip", False)
        .when(~requested, False)
        .when(has_text & (mode == "default"), False)
        .when(has_text & mode.isin("force", "redo"), True)
        .when(has_text, False)
        .when(~has_images & ~lossless & (mode != "force"), False)
        .otherwise(True)
    )
    too_big = F.coalesce((skip_big > 0) & has_images & (pixels > skip_big * 1_000_000), F.lit(False))
    error = F.when((mode == "default") & requested & has_text, "prior text found")
    return F.struct((wanted & ~too_big).alias("required"), error.alias("error"))


def reject_reason(needs_rendering: Column, signed: Column, form: Column, tagged: Column, mode: Column, invalidate: Column) -> Column:
    """Why a document cannot be processed; null if it can."""
    return (
        F.when(needs_rendering, "dynamic form")
        .when(signed & ~invalidate, "digital signature")
        .when(form & (mode == "redo"), "form with redo")
        .when(tagged & (mode == "default"), "tagged")
    )


def low_resolution(x: Column, y: Column, least: float = 96.0) -> Column:
    """Whether a resolution comes before (least, least) or equals it, compared as a pair."""
    return (x < least) | (x == least) & (y <= least)


def image_gate(x_dpi: Column, y_dpi: Column, alpha: Column, cmyk: Column, profile: Column, given: Column) -> Column:
    """Why an image cannot become a page; null if it can."""
    return (
        F.when(x_dpi.isNull() & ~given, "no resolution")
        .when(x_dpi.isNotNull() & low_resolution(x_dpi, y_dpi) & ~given, "low resolution")
        .when(alpha, "alpha channel")
        .when(cmyk & ~profile, "cmyk without profile")
    )


def skip_reason(
    kind: Column, length: Column, width: Column, height: Column, filters: Column, bits: Column, decode: Column, matte: Column
) -> Column:
    """The first rule that keeps an image from being optimised; null if none does.
    ``filters`` is an array of names, outermost first."""
    first, second = F.get(filters, F.lit(0)), F.get(filters, F.lit(1))
    wrapped_jpeg = (F.size(filters) == 2) & (first == "flate") & (second == "dct")
    own = F.when(wrapped_jpeg, second).otherwise(first)
    return (
        F.when(kind != "image", "not an image")
        .when(length < 100, "small stream")
        .when((width < 8) | (height < 8), "small dimensions")
        .when((F.size(filters) > 1) & ~wrapped_jpeg, "several filters")
        .when(bits > 8, "wide gamut")
        .when(own == "jpx", "jpeg 2000")
        .when(own == "ccitt3", "ccitt group 3")
        .when(decode, "decode table")
        .when(matte, "matte")
    )


def optimiser_route(reason: Column, bits: Column, codec: Column, indexed: Column, simple: Column, level: Column) -> Column:
    """Where an image that may be optimised goes: jbig2, jpeg, png or nowhere."""
    return (
        F.when(reason.isNotNull(), "none")
        .when(bits == 1, "jbig2")
        .when((codec == "dct") & (level >= 2), "jpeg")
        .when(indexed & simple & (level >= 3), "png")
        .when(~indexed & simple, "png")
        .otherwise("none")
    )


def all_of_kind(kinds: Column, wanted: list[str]) -> Column:
    """Whether an array is not empty and holds nothing but the wanted kinds."""
    return (F.size(kinds) > 0) & F.forall(kinds, lambda k: k.isin(*wanted))


def select_boxes(visible: Column, corrupt: Column, want_visible: bool | None, want_corrupt: bool | None) -> Column:
    """Condition of two optional filters; None does not care."""
    keep = F.lit(True)
    if want_visible is not None:
        keep &= visible == want_visible
    if want_corrupt is not None:
        keep &= corrupt == want_corrupt
    return keep


def resolution_profile(
    draws: DataFrame, page: list[str], dpi: str, area: str, order: list[str], more: dict[str, Column] | None = None
) -> DataFrame:
    """(page, weighted_dpi, max_dpi, ratio, area_ratio) of the images drawn on each page, and
    ``more`` aggregates of the same rows by name.

    weighted_dpi is the harmonic mean of the resolutions by drawn area, ratio how it relates
    to the largest, area_ratio the area share of the first image with the largest resolution;
    ``order`` breaks ties. Pages without area give nulls. One shuffle by page serves both the
    aggregate and the choice of the first: the choice is a maximum, not a window.
    """
    negated = F.struct((-F.col(dpi)).alias("d"), *order, F.col(area).alias("area"))
    grouped = draws.groupBy(*page).agg(
        F.sum(area).alias("_total"),
        F.sum(F.try_divide(F.col(area), F.col(dpi))).alias("_inverse"),
        F.max(dpi).alias("_max"),
        F.min(negated).alias("_first"),
        *[x.alias(name) for name, x in (more or {}).items()],
    )
    weighted = F.when(F.col("_total") > 0, F.col("_total") / F.nullif(F.col("_inverse"), F.lit(0.0)))
    known = F.col("_total") > 0
    return grouped.select(
        *page,
        weighted.alias("weighted_dpi"),
        F.when(known, F.col("_max")).alias("max_dpi"),
        F.try_divide(weighted, F.when(known, F.col("_max"))).alias("ratio"),
        F.when(known, F.col("_first.area") / F.col("_total")).alias("area_ratio"),
        *(more or {}),
    )


def size_report(size_in: Column, size_out: Column, pages: Column, reasons: Column) -> Column:
    """Struct (ratio, savings, warn, reasons): a result much larger than its input is reported
    unless the input is small."""
    expected = size_in + 4000 + 3000 * pages
    warn = (size_out / expected >= 1.35) & (size_in >= 25_000)
    return F.struct(
        F.try_divide(size_in.cast("double"), size_out.cast("double")).alias("ratio"),
        (1.0 - F.try_divide(size_out.cast("double"), size_in.cast("double"))).alias("savings"),
        warn.alias("warn"),
        F.when(warn, F.array_compact(reasons)).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )


def best_by(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    ranked = table.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def round_robin(table: DataFrame, order: list[Column], workers: int, within: list[str]) -> DataFrame:
    """Rows dealt to workers in turn, by place inside each group. Places are counted in ranges of
    the order, each a task's work, and then across the ranges of a group."""
    ranged = settled(table.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order))
    counts = ranged.groupBy(*within, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_of{i}" for i in range(len(within) + 1)]
    keys = [F.col(k).alias(n) for k, n in zip([*within, "_part"], names, strict=True)]
    bases = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*within, "_part"], names, strict=True)]
    placed = ranged.withColumn("_own", own).join(F.broadcast(bases), same).select(*table.columns, "_own", "_base")
    return placed.withColumn("worker", F.pmod(F.col("_base") + F.col("_own") - 1, F.lit(workers)).cast("int")).drop("_own", "_base")


def safe_paths(data: Column, critical: Column) -> Column:
    """Whether two folders lie apart: neither is, or lies in, the other."""
    inside = lambda a, b: (a == b) | a.startswith(F.concat(b, F.lit("/")))
    return ~(inside(data, critical) | inside(critical, data))


#: Fixed value: a checker's message that means nothing.
BENIGN = "/DecodeParms: operation for dictionary attempted on object of type null"


def messages_fine(messages: Column, benign: str = BENIGN) -> Column:
    """Whether a checker's messages hold nothing but the benign one; an error is never benign."""
    return ~F.exists(messages, lambda m: F.lower(m).contains("error") | ~m.contains(benign))


#: Parts and levels of the archive standard that a file can claim.
ARCHIVE_LEVELS = ["1a", "1b", "2a", "2b", "2u", "3a", "3b", "3u"]


def archive_claim(status: Column) -> Column:
    """Struct (claims, conformance) of the archive level that a file's metadata names."""
    level = F.lower(status)
    named = F.when(F.coalesce(status, F.lit("")) == "", "No PDF/A metadata in XMP").otherwise(F.concat(F.lit("PDF/A-"), level))
    return F.struct(F.coalesce(level.isin(*ARCHIVE_LEVELS), F.lit(False)).alias("claims"), named.alias("conformance"))


def safe_archive(status: Column, mode: Column) -> Column:
    """Whether a file counts as archive file without validation: it claims to be one, or its pages
    were all made anew."""
    return archive_claim(status)["claims"] | (mode == "force")


def final_status(output: Column, output_type: Column, claims: Column, sound: Column) -> Column:
    """Exit code after writing: a failed archive conversion, an invalid file, or fine. What goes to a
    stream or nowhere is not looked at."""
    unseen = output.isin("-", "/dev/null")
    return (
        F.when(unseen, STATUS["ok"])
        .when(output_type.startswith("pdfa") & ~claims, STATUS["pdfa_failed"])
        .when(~sound, STATUS["invalid_output"])
        .otherwise(STATUS["ok"])
    )


def jpeg_worth(level: Column, version: Column, producer: Column, first: tuple[int, ...] = (10, 6, 0), fixed: tuple[int, ...] = (10, 7, 0)) -> Column:
    """Whether a JPEG is encoded anew: on a high level, or if the converter that made the file cut
    such images short. ``version`` is an array of numbers."""
    cut_short = (version >= F.array(*map(F.lit, first))) & (version < F.array(*map(F.lit, fixed)))
    return (level >= 2) | cut_short & producer


def first_box_flags(lines: Column) -> Column:
    """Struct (visible, corrupt) of a text box from its first line's first character, a struct (text,
    mode): mode 3 is invisible, the replacement character unreadable."""
    first = F.get(F.get(lines, F.lit(0)), F.lit(0))
    return F.struct((first["mode"] != 3).alias("visible"), (mapped_character(first["text"]) == "\ufffd").alias("corrupt"))


def blanked(mode: Column, visible: Column) -> Column:
    """Whether a text box is painted over before recognition: none when all is forced, only visible
    ones when text is redone, else all."""
    return F.when(mode == "force", False).when(mode == "redo", visible).otherwise(True)


def text_lines(chars: DataFrame, keys: list[str], order: list[str], text: str, mode: str, font: str) -> DataFrame:
    """``chars`` with line: neighbours run on if they are drawn in the same mode, and in the same
    font where the meaning of either is unknown. Lines count from 0 in each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    unknown = mapped_character(F.col(text)) == "\ufffd"
    marked = chars.withColumn("_unknown", unknown)
    runs_on = (F.lag(mode).over(w) == F.col(mode)) & (~F.col("_unknown") & ~F.lag("_unknown").over(w) | (F.lag(font).over(w) == F.col(font)))
    starts = F.when(F.coalesce(runs_on, F.lit(False)), 0).otherwise(1)
    return marked.withColumn("_starts", starts).withColumn("line", F.sum("_starts").over(w) - 1).drop("_starts", "_unknown")


def document_flags(pages: DataFrame, document: list[str], version: str, unit: str, corrupt: str) -> DataFrame:
    """(document, version, has_userunit, has_corrupt_text) from its pages: the highest version that
    any needs, and whether any has a unit of its own or unreadable text."""
    return pages.groupBy(*document).agg(
        F.max(version).alias("version"),
        F.coalesce(F.bool_or(F.col(unit) != 1.0), F.lit(False)).alias("has_userunit"),
        F.coalesce(F.bool_or(corrupt), F.lit(False)).alias("has_corrupt_text"),
    )


def progress(steps: DataFrame, keys: list[str], order: list[str], share: Column) -> DataFrame:
    """``steps`` with done: what is finished after each step, in pages."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("done", F.sum(share).over(w))


def conversion_progress(lines: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """``lines`` with total and done: pages that a converter announced, and those finished since the
    first announcement; null and 0 before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = lines.withColumn("total", F.first(progress_total(F.col(line)), ignorenulls=True).over(w))
    counted = progress_step(F.col(line)) & F.col("total").isNotNull() & progress_total(F.col(line)).isNull()
    return out.withColumn("done", F.sum(F.when(counted, 1).otherwise(0)).over(w))


def path_inside(path: Column, folder: Column) -> Column:
    """Whether a normal path is a folder or lies in it."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def watch_problem(watched: Column, output: Column, archive: Column) -> Column:
    """Why a watcher would read its own results; null if it would not."""
    return F.when(path_inside(output, watched), "output in watched folder").when(path_inside(archive, watched), "archive in watched folder")


def file_problem(path: Column, kind: Column, folder: Column) -> Column:
    """Why a file is not to be read: it is no regular file, or lies elsewhere; null if it is."""
    return F.when(kind != "file", "not a regular file").when(~path_inside(path, folder), "outside the folder")


def target_problem(parent: Column, kind: Column, folder: Column) -> Column:
    """Why a result is not to be written: its folder lies elsewhere, or something that is no regular
    file (``kind`` is null for nothing) is in its place."""
    return F.when(~path_inside(parent, folder), "outside the folder").when(kind != "file", "occupied")


def settings_problem(path: Column, kind: Column, mode: Column, folders: Column) -> Column:
    """Why a settings file is not to be trusted: it lies in a data folder, is no regular file, or
    others may write it (``mode`` are its permission bits)."""
    return (
        F.when(F.exists(folders, lambda f: path_inside(path, f)), "in a data folder")
        .when(kind != "file", "not a regular file")
        .when(mode.bitwiseAND(F.lit(0o022)) != 0, "writable by others")
    )


def plugin_problem(name: Column, path: Column, folders: Column) -> Column:
    """Why a plug-in is not to be loaded: it is a file in a data folder. Module names are fine."""
    return F.when(name.endswith(".py") & F.exists(folders, lambda f: path_inside(path, f)), "in a data folder")



def failed_rules(report: Column) -> Column:
    """Number of rules that a validator's report says have failed: 0 where it names none, -1 where it
    is no such report."""
    details = F.get_json_object(report, "$.report.jobs[0].validationResult[0].details")
    count = F.get_json_object(report, "$.report.jobs[0].validationResult[0].details.failedRules")
    return F.when(details.isNull(), -1).when(count.isNull(), 0).otherwise(F.coalesce(count.try_cast("int"), F.lit(-1)))
