"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Only lengths matter to best fit, and lengths run from 1 to the capacity. So the corpus-wide
plan is made from a histogram of at most ``capacity`` rows, with equal items and equal bins
handled as runs; a segment tree over remaining capacities finds the tightest open bins. The
plan's size depends on the capacity alone. Pieces find their place by length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenize
from .common import materialise


class Capacities:
    """A segment tree over remaining capacities: which have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        at = self.leaves + capacity
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        at = self.leaves + least
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, first bin, offset): the items of a length, by rank from there
    to the next run of that length, go one by one into consecutive bins at that offset."""
    tree, open_bins = Capacities(capacity), {}
    runs, bins = [], 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            held = open_bins.setdefault(room, [])
            if held and held[-1][0] + held[-1][1] == first:
                held[-1] = (held[-1][0], held[-1][1] + count)
            else:
                held.append((first, count))
            tree.set(room, True)

    def fill(length: int, rank: int, total: int, first: int, count: int, room: int) -> tuple[int, int]:
        """Put items into a run of equal bins, each filled as far as it goes: once a bin has
        one, it is the tightest. Returns the next rank and how many bins were touched."""
        each = room // length
        whole = min(count, (total - rank) // each)
        rest = (total - rank) - whole * each if whole < count else 0
        for slot in range(each if whole else 0):
            runs.append((length, rank, first, capacity - room + slot * length))
            rank += whole
        leave(room - each * length, first, whole)
        for slot in range(rest):
            runs.append((length, rank, first + whole, capacity - room + slot * length))
            rank += 1
        leave(room - rest * length, first + whole, 1 if rest else 0)
        return rank, whole + (1 if rest else 0)

    for length in sorted(histogram, reverse=True):
        rank, total = 0, histogram[length]
        while rank < total:
            room = tree.tightest(length)
            if room is None:
                rank, opened = fill(length, rank, total, bins, total, capacity)
                bins += opened
                continue
            first, count = open_bins[room].pop()
            if not open_bins[room]:
                tree.set(room, False)
            rank, touched = fill(length, rank, total, first, count, room)
            leave(room, first + touched, count - touched)
    return runs


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool
) -> DataFrame:
    """The pieces of every row: its ids and then ``end_id``, cut at multiples of ``capacity``;
    part and nth say which piece of its length it is in the task that made it."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenize.per_worker(tokenize.WordIds, tokenizer_path)
        part, seen, step = TaskContext.get().partitionId(), {}, 4 * capacity
        for batch in batches:
            rows, piece, length, crc, nth, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                data = encode(text.as_py()) + end
                for at in range(0, len(data), step):
                    own = data[at : at + step]
                    n = len(own) // 4
                    rows.append(row)
                    piece.append(at // step)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    nth.append(seen.get(n, 0))
                    seen[n] = nth[-1] + 1
                    if with_ids:
                        ids.append(own)
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()),
                pa.array(nth, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "piece", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    schema = f"`{id_col}` {kind}, piece int, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece.

    Every row of ``docs`` is packed, repeated rows each time. A null or empty text is the end
    id alone. Documents of more than ``capacity`` tokens are cut at multiples of it, others
    never. Sequences are filled by best fit decreasing over the whole table, without gaps.
    Pieces of one length are interchangeable; which of them goes where is any. Columns besides id
    and text are not read, so none can clash; an empty table gives no piece. The tokenizer must drop white space (see tokenize.WordIds).
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = materialise(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    # at most one row for each length from 1 to the capacity
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit_plan(histogram, capacity)), np.int64).reshape(-1, 4)
    span = int(max(histogram.values(), default=0)) + 1
    starts = runs[:, 0] * span + runs[:, 1]

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["length", "part"]).select(
        *[F.col(f"`{c}`") for c in pieces.columns if c not in ("part", "nth")], (F.col("base") + F.col("nth")).alias("rank")
    )
    width = len(ranked.columns) - 1
    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(width).to_numpy()
            at = np.searchsorted(starts, length * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])],
                names=[f.name for f in fields] + ["sequence_id", "offset"],
            )

    placed = ranked.mapInArrow(place, schema)
    return placed.select(
        id_col, "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length", "ids_crc32",
        "sequence_id", "offset", *["ids"] * with_ids,
    )


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the token ids of every sequence, from pieces with ids.
    A group is one sequence, so no larger than the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"),
    )
