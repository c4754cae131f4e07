"""Rectangles and 2x3 affine maps as structs of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1")
    )


def ordered(b: Column) -> Column:
    """The same rectangle with its lower corner first."""
    return box(F.least(b["x0"], b["x1"]), F.least(b["y0"], b["y1"]), F.greatest(b["x0"], b["x1"]), F.greatest(b["y0"], b["y1"]))


def read_box(values: Column) -> Column:
    """Box of four values given as text; null unless there are four finite numbers."""
    numbers = [F.get(values, F.lit(i)).try_cast("double") for i in range(4)]
    fine = F.size(values) == 4
    for n in numbers:
        fine &= n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf")))
    return F.when(fine, ordered(box(*numbers)))


def is_empty(b: Column) -> Column:
    return (b["x1"] - b["x0"] <= 0) | (b["y1"] - b["y0"] <= 0)


def meet(a: Column, b: Column) -> Column:
    return box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share an interior."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def read_problem(values: Column) -> Column:
    """Struct (box, reordered, recoded) of four values given as text: whether corners were turned
    round, and whether a number was written in another way than plain decimals. Null unless
    there are four finite numbers."""
    given = F.transform(values, lambda v: v.try_cast("double"))
    fine = (F.size(values) == 4) & F.forall(given, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))))
    plain = F.forall(values, lambda v: v.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"))
    at = lambda n, i: F.get(n, F.lit(i))

    def read(n: Column) -> Column:
        turned = (at(n, 2) < at(n, 0)) | (at(n, 3) < at(n, 1))
        return F.struct(ordered(box(*[at(n, i) for i in range(4)])).alias("box"), turned.alias("reordered"), (~plain).alias("recoded"))

    return let(F.when(fine, given), lambda n: F.when(n.isNotNull(), read(n)))


def repairs(media: Column, sub: Column) -> Column:
    """Struct (box, media_kinds, kinds) of a page's inner box and its media box, both as arrays of
    four texts: every repair that each needs. An inner box may be turned round, written anew and
    then clamped or discarded; an empty media box limits nothing. A box that cannot be read
    stays as it is."""
    kinds = lambda b, *more: F.array_compact(F.array(F.when(b["reordered"], "reordered"), F.when(b["recoded"], "recoded"), *more))
    none = F.array().cast("array<string>")

    def within(x: Column) -> Column:
        m, s, inside = x["m"], x["s"], x["inside"]
        limit = m.isNotNull() & ~is_empty(m["box"])
        lost = F.coalesce(limit & is_empty(inside), F.lit(False))
        own = kinds(s, F.when(lost, "discarded").when(limit & (inside != s["box"]), "clamped"))
        return F.struct(
            F.when(s.isNotNull() & ~lost, F.when(limit, inside).otherwise(s["box"])).alias("box"),
            F.coalesce(F.when(m.isNotNull(), kinds(m, F.when(is_empty(m["box"]), "degenerate_mediabox"))), none).alias("media_kinds"),
            F.coalesce(F.when(s.isNotNull(), own), none).alias("kinds"),
        )

    both = F.struct(read_problem(media).alias("m"), read_problem(sub).alias("s"))
    met = let(both, lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"), meet(x["s"]["box"], x["m"]["box"]).alias("inside")))
    return let(met, within)


def repair(media: Column, sub: Column) -> Column:
    """Struct (box, kind) of a page's inner box against its media box: clamped to it, discarded
    if nothing is left, null kind if it stays. An empty media box limits nothing."""
    inside = meet(ordered(sub), ordered(media))
    kind = (
        F.when(is_empty(ordered(media)), F.when(ordered(sub) != sub, "reordered"))
        .when(is_empty(inside), "discarded")
        .when(inside != ordered(sub), "clamped")
        .when(ordered(sub) != sub, "reordered")
    )
    out = F.when(is_empty(ordered(media)), ordered(sub)).when(~is_empty(inside), inside)
    return F.struct(out.alias("box"), kind.alias("kind"))


def to_origin(b: Column, media: Column, swap: Column) -> Column:
    """A box moved so that the media box begins at zero; axes swapped for turned pages."""
    moved = box(b["x0"] - media["x0"], b["y0"] - media["y0"], b["x1"] - media["x0"], b["y1"] - media["y0"])
    return F.when(swap, box(moved["y0"], moved["x0"], moved["y1"], moved["x1"])).otherwise(moved)


def to_pixels(b: Column, page_height: Column, dpi: Column) -> Column:
    """Points with the origin below to pixels with the origin above."""
    scale = dpi / 72.0
    return box(b["x0"] * scale, (page_height - b["y1"]) * scale, b["x1"] * scale, (page_height - b["y0"]) * scale)


def affine(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    names = "abcdef"
    return F.struct(*[x.cast("double").alias(n) for n, x in zip(names, (a, b, c, d, e, f), strict=True)])


def compose(first: Column, then: Column) -> Column:
    """Row-vector convention: a point goes through ``first``, then through ``then``."""
    return affine(
        first["a"] * then["a"] + first["b"] * then["c"], first["a"] * then["b"] + first["b"] * then["d"],
        first["c"] * then["a"] + first["d"] * then["c"], first["c"] * then["b"] + first["d"] * then["d"],
        first["e"] * then["a"] + first["f"] * then["c"] + then["e"], first["e"] * then["b"] + first["f"] * then["d"] + then["f"],
    )


def transform_box(b: Column, m: Column) -> Column:
    """The upright box around a transformed one."""
    xs = [b[x] * m["a"] + b[y] * m["c"] + m["e"] for x in ("x0", "x1") for y in ("y0", "y1")]
    ys = [b[x] * m["b"] + b[y] * m["d"] + m["f"] for x in ("x0", "x1") for y in ("y0", "y1")]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def layer_matrix(text_width: Column, text_height: Column, width: Column, height: Column, x: Column, y: Column, rotation: Column) -> Column:
    """The affine map that lays a text layer on a page: centred, turned clockwise by a multiple of
    a right angle, scaled to the page, moved to its corner. Null if that changes nothing."""
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = F.pmod(-rotation, F.lit(360))
    cos = F.when(turn == 0, 1.0).when(turn == 180, -1.0).otherwise(0.0)
    sin = F.when(turn == 90, 1.0).when(turn == 270, -1.0).otherwise(0.0)
    swapped = rotation.isin(90, 270)
    w, h = F.when(swapped, text_height).otherwise(text_width), F.when(swapped, text_width).otherwise(text_height)
    scale = lambda page, own: F.coalesce(page / F.nullif(own, F.lit(0.0)), one)
    steps = [
        affine(one, zero, zero, one, -text_width / 2, -text_height / 2), affine(cos, sin, -sin, cos, zero, zero),
        affine(scale(width, w), zero, zero, scale(height, h), zero, zero), affine(one, zero, zero, one, width / 2 + x, height / 2 + y),
    ]
    m = steps[0]
    for step in steps[1:]:
        m = let(F.struct(m.alias("m"), step.alias("n")), lambda p: compose(p["m"], p["n"]))
    changes = lambda m: (m["a"] != 1) | (m["b"] != 0) | (m["c"] != 0) | (m["d"] != 1) | (m["e"] != 0) | (m["f"] != 0)
    return let(m, lambda m: F.when(changes(m), m))
