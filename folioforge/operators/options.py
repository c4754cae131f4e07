"""Checks of processing options as expressions over a table of configurations.

A configuration is a row. What is wrong with it is a value of that row (the first problem, or an
array of warnings), so a table of millions of jobs is checked in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages that an engine keeps for itself, and the least and most of numeric options.
RESERVED_LANGUAGES = ["equ", "osd"]
LIMITS = {"jobs": (0, 256), "verbose": (0, 2), "oversample": (0, 5000), "rotate_pages_threshold": (0, 1000), "max_image_mpixels": (0, None)}
DEFAULT_ROTATE_THRESHOLD, DEFAULT_DOWNSAMPLE_ABOVE = 14.0, 32767


def _named(flags: dict[str, Column]) -> Column:
    """The names whose flag is set, in order of name."""
    return F.array_compact(F.array(*[F.when(F.coalesce(flags[n], F.lit(False)), n) for n in sorted(flags)]))


def strip_conflicts(mode: Column, used: dict[str, Column]) -> Column:
    """Options that have no meaning where only a text layer is removed, in order of name; none in
    other modes. ``used`` says which of them are set."""
    return F.when(mode == "strip", _named(used)).otherwise(F.array().cast("array<string>"))


def cleaning(clean: Column, clean_final: Column) -> Column:
    """Cleaning the final image implies cleaning."""
    return F.coalesce(clean, F.lit(False)) | F.coalesce(clean_final, F.lit(False))


def preprocessing_problem(clean: Column, clean_final: Column, cleaner_arguments: Column, rotate: Column, threshold: Column) -> Column:
    """Why preprocessing options do not go together; null if they do."""
    given = F.coalesce(F.size(cleaner_arguments) > 0, F.lit(False))
    return F.when(given & ~cleaning(clean, clean_final), "cleaner arguments without cleaning").when(
        (threshold != DEFAULT_ROTATE_THRESHOLD) & ~rotate, "rotation threshold without rotation"
    )


def sidecar_path(sidecar: Column, output: Column) -> Column:
    """Struct (path, problem): a sidecar that is asked for without a name (an empty one) lies beside
    the output file, which then needs a name."""
    unnamed = sidecar == ""
    path = F.when(unnamed, F.concat(output, F.lit(".txt"))).otherwise(sidecar)
    problem = F.when(unnamed & output.isin("-", "/dev/null"), "sidecar needs a name").when(path == output, "sidecar is the output")
    return F.struct(F.when(problem.isNull(), path).alias("path"), problem.alias("problem"))


def language_problem(requested: Column, available: Column) -> Column:
    """Struct (reserved, missing): requested languages that an engine keeps for itself, and those
    it does not have, each sorted. An engine that names no languages has all."""
    reserved = F.array_sort(F.array_intersect(requested, F.array(*[F.lit(x) for x in RESERVED_LANGUAGES])))
    missing = F.array_sort(F.array_except(requested, available))
    none = F.array().cast("array<string>")
    return F.struct(reserved.alias("reserved"), F.when(F.size(available) > 0, missing).otherwise(none).alias("missing"))


def out_of_range(values: dict[str, Column]) -> Column:
    """Names of numeric options beyond their limits, in order of name; null values are in range."""
    flags = {}
    for name, x in values.items():
        low, high = LIMITS[name]
        flags[name] = (x < low) | (x > high if high is not None else F.lit(False))
    return _named(flags)


def engine_warnings(segmentation: Column, downsample_above: Column, downsample: Column, optimise: Column, qualities: list[Column]) -> Column:
    """Settings that take effect otherwise than they look, as an array of short names."""
    asked = F.lit(False)
    for q in qualities:
        asked |= F.coalesce(q > 0, F.lit(False))
    return F.array_compact(
        F.array(
            F.when(segmentation.isin(0, 2), "segmentation disables recognition"),
            F.when((downsample_above != DEFAULT_DOWNSAMPLE_ABOVE) & ~downsample, "downsampling limit without downsampling"),
            F.when((optimise == 0) & asked, "quality without optimisation"),
        )
    )


def combination_problem(mode: Column, deskew: Column, clean_final: Column, no_background: Column, output_type: Column, output: Column) -> Column:
    """Why options of different parts exclude each other; null if they do not."""
    return F.when((mode == "redo") & (deskew | clean_final | no_background), "redo with image changes").when(
        (output_type == "none") & ~output.isin("-", "/dev/null"), "output file without output"
    )


def archive_warning(compression: Column, output_type: Column) -> Column:
    """Whether an image compression for archive files is given for another output."""
    return F.coalesce((compression != "") & (compression != "auto") & ~output_type.startswith("pdfa"), F.lit(False))


def renderer(name: Column) -> Column:
    """The text renderer in use: the removed ones and the automatic choice mean the present one."""
    return F.when(name.isin("hocr", "hocrdebug", "auto"), "fpdf2").otherwise(name)


def lossless(deskew: Column, clean_final: Column, mode: Column, no_background: Column) -> Column:
    """Whether page images stay as they are."""
    return ~(deskew | clean_final | (mode == "force") | no_background)


def shell_words(line: Column) -> Column:
    """Words of a command line: quotes hold words together, a backslash takes the next character
    as it is (in single quotes it is an ordinary one)."""
    part = r"""[^\s"'\\]+|\\.|"(?:[^"\\]|\\.)*"|'[^']*'"""
    words = F.regexp_extract_all(line, F.lit(rf"((?:{part})+)"), F.lit(1))

    def plain(word: Column) -> Column:
        pieces = F.regexp_extract_all(word, F.lit(rf"({part})"), F.lit(1))
        return F.array_join(
            F.transform(
                pieces,
                lambda p: F.when(p.startswith("'"), F.substr(p, F.lit(2), F.length(p) - 2))
                .when(p.startswith('"'), F.regexp_replace(F.substr(p, F.lit(2), F.length(p) - 2), r'\\(["\\])', "$1"))
                .otherwise(F.regexp_replace(p, r"\\(.)", "$1")),
            ),
            "",
        )

    return F.transform(words, plain)


def names_a_file(words: Column) -> Column:
    """Whether some argument could be a path."""
    return F.exists(words, lambda w: w.contains("/") | w.isin(".", ".."))


def split_known(options: Column, known: list[str]) -> Column:
    """Struct (known, extra): a map of options, parted by whether the core knows their names."""
    names = F.array(*[F.lit(k) for k in known])
    return F.struct(
        F.map_filter(options, lambda k, _: F.array_contains(names, k)).alias("known"),
        F.map_filter(options, lambda k, _: ~F.array_contains(names, k)).alias("extra"),
    )


def settings(text: Column, schema: str) -> Column:
    """Settings from JSON text; null where the text is no object."""
    return F.when(F.json_object_keys(text).isNotNull(), F.from_json(text, schema))
