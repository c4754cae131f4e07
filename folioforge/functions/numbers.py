"""Numeric rules of page geometry and resolution as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative tolerance at which two resolutions count as equal.
SAME_RESOLUTION = 0.002
#: Resolution for pages of text or vector content, or without any known one.
DEFAULT_DPI = 400.0


def bankers_round(x: Column, digits: int = 0) -> Column:
    """Rounds half to even."""
    return F.bround(x, digits)


def wrap(x: Column, n: int = 360) -> Column:
    """Remainder that is never negative."""
    return F.pmod(x, F.lit(n))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def rel_close(a: Column, b: Column, tolerance: float = SAME_RESOLUTION) -> Column:
    """Equality up to a share of the larger value. Not transitive: never a join key."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def or_default(x: Column, default: float) -> Column:
    """``x``, or the default where it is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(default))


def harmonic_mean(x: Column, y: Column) -> Column:
    """Scalar of a two-way resolution; zero if either side is."""
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(2.0 * x * y / (x + y))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def drawn_dpi(pixels: Column, a: Column, b: Column) -> Column:
    """Pixels an inch of an image side drawn along the vector (a, b) in points; infinite if
    nothing is drawn."""
    drawn = F.sqrt(a * a + b * b)
    return F.when(drawn == 0, F.lit(float("inf"))).otherwise(pixels / F.nullif(drawn, F.lit(0.0)) * 72.0)


def square_dpi(weighted: Column, rich: Column, oversample: float = 0.0) -> Column:
    """Resolution to render a page at: its own or the default, at least the default for pages
    with text or vectors, at least the oversampling."""
    return F.greatest(
        or_default(weighted, DEFAULT_DPI), F.when(rich, F.lit(DEFAULT_DPI)).otherwise(F.lit(0.0)), F.lit(float(oversample))
    )


def fit_image(
    width: Column, height: Column, bytes_per_pixel: Column, max_width: int, max_height: int, max_pixels: int, max_bytes: int
) -> Column:
    """Struct (width, height) of an image scaled down until it keeps three limits in turn."""

    def floor(x: Column) -> Column:
        return F.floor(x).cast("long")

    def within_sides(s: Column) -> Column:
        factor = F.least(max_width / s["w"], max_height / s["h"])
        w, h = floor(s["w"] * factor), floor(s["h"] * factor)
        one_wide = F.struct(F.lit(1).cast("long").alias("w"), F.least(h, F.lit(max_height).cast("long")).alias("h"))
        one_high = F.struct(F.least(w, F.lit(max_width).cast("long")).alias("w"), F.lit(1).cast("long").alias("h"))
        small = F.when(w == 0, one_wide).when(h == 0, one_high).otherwise(F.struct(w.alias("w"), h.alias("h")))
        return F.when(factor < 1.0, small).otherwise(s)

    def within_pixels(s: Column) -> Column:
        factor = F.sqrt(F.lit(float(max_pixels)) / (s["w"] * s["h"]))
        small = F.struct(floor(s["w"] * factor).alias("w"), floor(s["h"] * factor).alias("h"))
        return F.when(s["w"] * s["h"] > max_pixels, small).otherwise(s)

    def within_bytes(s: Column) -> Column:
        stride = s["w"] * bytes_per_pixel
        factor = F.sqrt(F.lit(float(max_bytes)) / (stride * s["h"]))
        line, lines = floor(stride * factor), floor(s["h"] * factor)
        cap = F.lit(max_bytes).cast("long")
        lines_1 = F.when(line == 0, F.least(floor(cap / bytes_per_pixel), lines)).otherwise(lines)
        line_1 = F.when(line == 0, bytes_per_pixel).otherwise(line)
        line_2 = F.when(lines_1 == 0, F.least(cap, line_1)).otherwise(line_1)
        lines_2 = F.when(lines_1 == 0, F.lit(1).cast("long")).otherwise(lines_1)
        small = F.struct(floor(line_2 / bytes_per_pixel).alias("w"), lines_2.alias("h"))
        return F.when(stride * s["h"] > max_bytes, small).otherwise(s)

    size = F.struct(width.cast("long").alias("w"), height.cast("long").alias("h"))
    for step in (within_sides, within_pixels, within_bytes):
        size = F.element_at(F.transform(F.array(size), step), 1)
    return size


def text_misalignment(content: Column, corrected: Column, emplaced: Column) -> Column:
    """Degrees to turn a text layer so that it lies on the page content."""
    return wrap(corrected - F.when(emplaced, corrected).otherwise(content))


def page_rotation(content: Column, corrected: Column, emplaced: Column) -> Column:
    return wrap(F.when(emplaced, corrected).otherwise(content) - corrected)


def orientation_correction(angle: Column, confidence: Column, threshold: float = 14.0) -> Column:
    """The found angle if it is sure enough, else none."""
    return F.when((confidence >= threshold) & (wrap(angle) != 0), wrap(angle)).otherwise(0)


def quality_band(quality: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(10), quality - 10), F.least(F.lit(100), quality + 10)


def engine_threads(jobs: int, pages: Column) -> Column:
    """Threads an engine may use for each page when jobs run side by side."""
    return clamp(F.floor(F.lit(jobs) / F.greatest(pages, F.lit(1))).cast("int"), F.lit(1), F.lit(3))


def ink_of(components: Column, epsilon: float = 1e-3) -> Column:
    """mono, gray or color of gray, rgb or cmyk components; anything else is color."""
    c = lambda i: F.get(components, F.lit(i))
    gray_of = lambda v: F.when((F.abs(v) <= epsilon) | (F.abs(v - 1.0) <= epsilon), "mono").otherwise("gray")
    same = (F.abs(c(0) - c(1)) <= epsilon) & (F.abs(c(1) - c(2)) <= epsilon)
    no_ink = (F.abs(c(0)) <= epsilon) & (F.abs(c(1)) <= epsilon) & (F.abs(c(2)) <= epsilon)
    return (
        F.when(F.size(components) == 1, gray_of(c(0)))
        .when((F.size(components) == 3) & same, gray_of(c(0)))
        .when((F.size(components) == 4) & no_ink, gray_of(1.0 - c(3)))
        .otherwise("color")
    )


def rank_of(x: Column, names: list[str]) -> Column:
    """Place of a name in an ordered list, from 0; null for others."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(names):
        out = F.when(x == name, i).otherwise(out)
    return out


def component_max(*pairs: Column) -> Column:
    """Struct (x, y) of the largest x and the largest y of resolutions."""
    return F.struct(F.greatest(*[p["x"] for p in pairs]).alias("x"), F.greatest(*[p["y"] for p in pairs]).alias("y"))


def component_min(*pairs: Column) -> Column:
    return F.struct(F.least(*[p["x"] for p in pairs]).alias("x"), F.least(*[p["y"] for p in pairs]).alias("y"))


def printed_area(width: Column, height: Column, x_dpi: Column, y_dpi: Column, renderable: Column) -> Column:
    """Square inches that an image covers; none if it cannot be rendered."""
    area = (width / F.nullif(x_dpi, F.lit(0.0))) * (height / F.nullif(y_dpi, F.lit(0.0)))
    return F.when(renderable, area).otherwise(F.lit(0.0))


def renderable(x_dpi: Column, y_dpi: Column, width: Column, height: Column, stencil: Column) -> Column:
    """Whether an image counts for a page's resolution."""
    return is_finite(x_dpi) & is_finite(y_dpi) & (width >= 0) & (height >= 0) & ~stencil


def pixels(inches: Column, dpi: Column) -> Column:
    """Whole pixels of a length, halves to even."""
    return F.bround(inches * dpi).cast("int")


def skew_degrees(radians: Column) -> Column:
    return F.degrees(radians)


def low_resolution_size(width: Column, height: Column, x_dpi: Column, y_dpi: Column, least: float = 10.0) -> Column:
    """Struct (x, y, width, height): the resolution that a page is really rendered at, which has a
    floor, and the pixels it is then scaled back to; at least one each way."""
    x, y = F.greatest(x_dpi, F.lit(least)), F.greatest(y_dpi, F.lit(least))
    back = lambda n, asked, real: F.greatest(F.lit(1), F.bround(n * (asked / real)).cast("int"))
    low = (x_dpi < least) | (y_dpi < least)
    return F.struct(
        x.alias("x"), y.alias("y"), F.when(low, back(width, x_dpi, x)).otherwise(width).alias("width"),
        F.when(low, back(height, y_dpi, y)).otherwise(height).alias("height"),
    )


def expected_size(width: Column, height: Column, x_dpi: Column, y_dpi: Column, rotation: Column) -> Column:
    """Struct (width, height) of pixels of a page in points, turned with the page."""
    w, h = F.bround(width * F.bround(x_dpi, 6) / 72.0).cast("int"), F.bround(height * F.bround(y_dpi, 6) / 72.0).cast("int")
    turned = wrap(rotation, 180) == 90
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def plausible_aspect(width: Column, height: Column, natural: Column, font_size: Column, angle: Column, least: float = 0.1) -> Column:
    """Whether a line's box can hold its text: taller boxes than wide are compared with the box
    that the text would take at its slope (degrees)."""
    turn = F.radians(F.abs(angle))
    wide = natural * F.cos(turn) + font_size * F.sin(turn)
    tall = natural * F.sin(turn) + font_size * F.cos(turn)
    unknown = (width <= 0) | (height <= 0) | (font_size <= 0) | (width >= height) | (natural <= 0) | (tall <= 0)
    ratio = (width / F.nullif(height, F.lit(0.0))) / F.nullif(wide / F.nullif(tall, F.lit(0.0)), F.lit(0.0))
    return unknown | F.coalesce(ratio >= least, F.lit(True))


def worth_linearising(size: Column, megabytes: Column) -> Column:
    """Whether a file is large enough for the web layout."""
    return size > megabytes * 1_000_000


def smallest(sizes: dict[str, Column]) -> Column:
    """The name of the smallest of several encodings; the first named wins ties, nulls are out."""
    best = F.least(*sizes.values()) if len(sizes) > 1 else next(iter(sizes.values()))
    out = F.lit(None).cast("string")
    for name, size in reversed(list(sizes.items())):
        out = F.when(size == best, name).otherwise(out)
    return out


#: Fixed value: pixels from which a page image is not cleaned.
TOO_LARGE_TO_CLEAN = 256 * 1024 * 1024


def cleanable(width: Column, height: Column) -> Column:
    return width.cast("long") * height < TOO_LARGE_TO_CLEAN
