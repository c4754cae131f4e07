"""Ordered assembly: runs of pages, page-range text, sidecars, stack machines, trees, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from .storage import settled


def compress_ranges(table: DataFrame, keys: list[str], order: str, item: str) -> DataFrame:
    """(keys, first, last, item): places from 1 in order; each non-empty item is a range of its
    own, runs of empty ones are one range without item."""
    w = Window.partitionBy(*keys).orderBy(order)
    filled = F.coalesce(F.col(item) != "", F.lit(False))
    placed = table.select(*keys, order, item, F.row_number().over(w).alias("_n"), filled.alias("_filled"))
    starts = F.col("_filled") | F.coalesce(F.lag("_filled").over(w), F.lit(True))
    grouped = placed.withColumn("_run", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    return grouped.groupBy(*keys, "_run").agg(
        F.min("_n").alias("first"), F.max("_n").alias("last"), F.max(F.when(F.col("_filled"), F.col(item))).alias("item")
    ).drop("_run")


def merge_sidecars(table: DataFrame, keys: list[str], order: str, item: str) -> DataFrame:
    """(keys, sidecar): page texts in order between form feeds; runs of empty pages leave a
    note. A text's own last form feed does not count."""
    pages = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(
        F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string"))
    )
    note = F.concat(F.lit("[OCR skipped on page(s) "), pages, F.lit("]"))
    text = F.coalesce(F.regexp_replace("item", r"\f\z", ""), note)
    ranges = compress_ranges(table, keys, order, item).select(*keys, "first", text.alias("_text"))
    parts = F.array_sort(F.collect_list(F.struct("first", "_text")))
    return ranges.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), "\f").alias("sidecar"))


def format_pages(table: DataFrame, keys: list[str], number: str, block: int = 65536) -> DataFrame:
    """(keys, pages): distinct numbers from 0, printed from 1 with runs as ``a-b``. Runs are found
    within blocks of numbers, which are many tasks' work, and joined where blocks meet."""
    distinct = table.select(*keys, F.col(number).cast("long").alias("_n")).distinct()
    distinct = distinct.withColumn("_block", F.floor(F.col("_n") / block))
    island = F.col("_n") - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_n"))
    runs = distinct.withColumn("_island", island).groupBy(*keys, "_block", "_island").agg(F.min("_n").alias("a"), F.max("_n").alias("b"))
    w = Window.partitionBy(*keys).orderBy("a")
    starts = F.coalesce(F.lag("b").over(w) + 1 < F.col("a"), F.lit(True)).cast("int")
    runs = runs.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(w))
    runs = runs.groupBy(*keys, "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), (F.col("a") + 1).cast("string")).otherwise(
        F.concat_ws("-", (F.col("a") + 1).cast("string"), (F.col("b") + 1).cast("string"))
    )
    parts = F.array_sort(F.collect_list(F.struct("a", shown.alias("s"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["s"]), ", ").alias("pages"))


def strictly_rising(table: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, rising): whether each value exceeds the one before; true for one row."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    steps = table.withColumn("_ok", F.coalesce(F.col(value) > before, F.lit(True)))
    return steps.groupBy(*keys).agg(F.bool_and("_ok").alias("rising"))


def stack_depth(table: DataFrame, keys: list[str], order: list[str], step: Column) -> DataFrame:
    """``table`` with depth: a stack after each push (1) and pop (-1); popping an empty stack
    does nothing, which is the walk reflected at its running minimum."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = table.withColumn("_sum", F.sum(step).over(w))
    lowest = F.least(F.lit(0), F.min("_sum").over(w))
    return total.withColumn("depth", (F.col("_sum") - lowest).cast("long")).drop("_sum")


def dedupe_messages(messages: Column, window: int = 5) -> Column:
    """Array of the messages that a log shows: one that is among the last ``window`` shown is
    held back; the next new one is preceded by a note of how many were, and starts anew."""
    text = F.array().cast("array<string>")
    start = F.struct(text.alias("shown"), text.alias("recent"), F.lit(0).alias("held"))

    def step(state: Column, m: Column) -> Column:
        known = F.array_contains(state["recent"], m)
        note = F.concat(F.lit("(suppressed "), state["held"].cast("string"), F.lit(" repeated lines)"))
        recent = F.when(state["held"] > 0, text).otherwise(state["recent"])
        longer = F.concat(recent, F.array(m))
        kept = F.when(F.size(longer) > window, F.slice(longer, -window, window)).otherwise(longer)
        fresh = F.when(state["held"] > 0, F.array(note, m)).otherwise(F.array(m))
        return F.struct(
            F.when(known, state["shown"]).otherwise(F.concat(state["shown"], fresh)).alias("shown"),
            F.when(known, state["recent"]).otherwise(kept).alias("recent"),
            F.when(known, state["held"] + 1).otherwise(0).alias("held"),
        )

    return F.aggregate(messages, start, step, lambda s: s["shown"])


def strip_blocks(table: DataFrame, keys: list[str], order: list[str], begin: Column, end: Column, mode: Column, hidden: int = 3) -> DataFrame:
    """``table`` without the blocks, from a beginning to its end, whose last mode is hidden.
    Rows outside blocks stay; mode is null where a row does not set it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = table.withColumn("_begin", begin).withColumn("_mode", mode).withColumn("_end", end)
    marked = marked.withColumn("_block", F.sum(F.col("_begin").cast("int")).over(w))
    ended = F.coalesce(F.max(F.col("_end").cast("int")).over(
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = marked.withColumn("_inside", (F.col("_block") > 0) & (ended == 0))
    whole = Window.partitionBy(*keys, "_block", "_inside").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("_mode", ignorenulls=True).over(whole)
    kept = marked.withColumn("_last", last).where(~(F.col("_inside") & F.coalesce(F.col("_last") == hidden, F.lit(False))))
    return kept.drop("_begin", "_mode", "_end", "_block", "_inside", "_last")


def tree_paths(nodes: DataFrame, depth: int) -> DataFrame:
    """``nodes`` (id, parent) with path array<long>, whose order is the order of a depth-first
    walk. Joins level by level; children of unknown parents are not reached."""
    level = nodes.where("parent IS NULL").withColumn("path", F.array(F.col("id").cast("long")))
    out = level
    for _ in range(depth):
        above = level.select(F.col("id").alias("_above"), F.col("path").alias("_path"))
        level = nodes.join(above, F.col("parent") == F.col("_above")).select(
            *nodes.columns, F.concat("_path", F.array(F.col("id").cast("long"))).alias("path")
        )
        out = out.unionByName(level)
    return out


def reachable(spark, edges: DataFrame, roots: DataFrame, depth: int = 10) -> DataFrame:
    """(root, id): nodes within ``depth`` steps of each root; each once, cycles end.

    Breadth first: a step goes on only from what the last one reached for the first time, so a
    graph costs its edges once for each root, however many ways lead to a node.
    """
    steps = settled(edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct(), "steps")
    front, seen = settled(roots.select("root", F.col("root").alias("id")).distinct(), "front"), None
    for _ in range(depth):
        reached = front.join(steps, front["id"] == steps["_at"]).select("root", F.col("_to").alias("id")).distinct()
        front = settled(reached if seen is None else reached.join(seen, ["root", "id"], "left_anti"), "front")
        if seen is not None and front.isEmpty():
            break
        seen = front if seen is None else seen.unionByName(front)
    return seen
