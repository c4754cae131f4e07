"""Removal of long repeated strings, by prefix-free parsing of the corpus.

A rolling hash over short windows cuts each text into phrases: a place is a trigger where the
hash is least among all windows around it, so every string of ``head`` bytes has a trigger that
its own bytes determine, no phrase is longer than that, and equal strings are cut alike wherever
they stand. The text before a trigger is the end of a dictionary phrase, the text from it on is
a suffix of the parse.

Corpus order ranks a suffix first by the rest of its phrase, an entry of the dictionary's suffix
array, and then by the suffix of the parse that follows, an entry of the parse's suffix array.
Both arrays are built for each class of equal text from a trigger on (``mark`` bytes), as no
string of the wanted length can be repeated across classes and no machine holds all of them.
Triggers whose class occurs once cannot lie in a repeated string and fall away. Triggers whose
whole surroundings occur again are settled: every string around them repeats, and one of them
stands for all. What is left goes to the task of its class, where phrase ends and parse
suffixes are sorted with their common lengths, and each pair of ranks names the strings that
are equal. Classes with very many different surroundings are counted string by string.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices_by_bytes, small_batches


@dataclass(frozen=True)
class Repeat:
    """What counts as repeated: ``length`` bytes, at places that are multiples of ``step``.

    ``gram`` are the bytes of a rolling window, ``head`` those at the start of a string among
    which it must have a trigger. With ``words`` a text is the sequence of its words' 4-byte
    digests instead of its bytes.
    """

    length: int
    gram: int
    head: int
    step: int = 1
    words: bool = False

    @property
    def before(self) -> int:
        """Bytes before a trigger at which a string that has it in its head can start."""
        return self.head - self.gram

    @property
    def mark(self) -> int:
        """Bytes from a trigger on that every such string holds."""
        return self.length - self.before


#: Strings of 400 bytes, and passages of over 50 words.
STRINGS = Repeat(400, 16, 256)
PASSAGES = Repeat(51 * 4, 16, 128, 4, True)
#: Bytes of text that a task parses at once; arrays of eight bytes for each of them are held.
SLICE = 400_000
#: Different surroundings of one class that a single task orders, and those it orders at once.
IN_TASK, AT_ONCE = 4000, 4000
#: Rows of two numbers up to which a counted table is broadcast (some 30 MB at most).
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240229)
_TABLES = _rng.integers(0, 2**63, (2, 256), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 .. n - 1 of an odd base, or of its inverse, modulo 2**64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 2**64) if inverse else _BASES[which]
        steps = np.full(max(n, 1 << 19), base, np.uint64)
        steps[0] = 1
        have = _powers[which, inverse] = np.multiply.accumulate(steps)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _prefix(data: np.ndarray, which: int) -> np.ndarray:
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLES[which][data] * _power(which, len(data)), out=sums[1:])
    return sums


def _hash(sums: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * _power(which, len(sums), True)[start])


def triggers(data: np.ndarray, kind: Repeat = STRINGS) -> np.ndarray:
    """Places of the rightmost least rolling hash of every run of ``head`` bytes."""
    n, width = (len(data) - kind.gram) // kind.step + 1, kind.before // kind.step + 1
    if n < width:
        return np.empty(0, np.int64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    first, second = eight[:: kind.step][:n], eight[8 :: kind.step][:n]
    h = _mix(first * np.uint64(_BASES[0]) + second * np.uint64(_BASES[1]))
    key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    blocks = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    blocks[:n] = key
    blocks = blocks.reshape(-1, width)
    down = np.minimum.accumulate(blocks, 1).ravel()
    up = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(up[: n - width + 1], down[width - 1 : n])
    place = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return place[np.concatenate(([True], place[1:] != place[:-1]))] * kind.step


def word_digests(text: bytes) -> bytes:
    """Four bytes for each word ``[^\\x20\\x09-\\x0D]+``."""
    return np.fromiter(map(zlib.crc32, text.split()), "<u4").tobytes()


def _view(column: pa.Array, kind: Repeat) -> pa.Array:
    """The texts of a binary column as what is searched for repeats."""
    return pa.array(map(word_digests, column.to_pylist()), pa.binary()) if kind.words else column


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of binary values, one after another, and where each begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def parse(column: pa.Array, kind: Repeat = STRINGS) -> tuple[np.ndarray, ...]:
    """(row, place, class, surroundings) of the triggers of a batch of texts. A trigger counts
    if a string of the length in its own text can have it in its head."""
    data, offsets = _joined(column)
    place = triggers(data, kind)
    row = np.searchsorted(offsets, place, "right") - 1
    start, end = offsets[row], offsets[row + 1]
    before, after = np.minimum(kind.before, place - start), np.minimum(kind.length, end - place)
    fit = (before + after >= kind.length) & (after >= kind.mark)
    row, place, start, before, after = (x[fit] for x in (row, place, start, before, after))
    if not len(place):
        return row, place, np.empty(0, np.int64), np.empty(0, np.int64)
    mark = _hash(_prefix(data, 0), 0, place, place + kind.mark)
    around = _hash(_prefix(data, 1), 1, place - before, place + after)
    around = _mix(around + (before * (kind.length + 1) + after).astype(np.uint64))
    return row, place - start, mark.view(np.int64), around.view(np.int64)


def _trigger_table(keyed: DataFrame, kind: Repeat) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, 2, SLICE):
                row, place, mark, around = parse(_view(batch.column(2), kind), kind)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(mark), pa.array(around)],
                    names=["k1", "k2", "place", "g", "c"],
                )

    return keyed.mapInArrow(run, "k1 long, k2 long, place int, g long, c long")


def suffix_order(group: np.ndarray, strings: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings by (group, bytes), and the length that each has in common with the
    one before it; -1 at the first of a group. Bytes beyond ``wide`` do not count."""
    order = np.array(sorted(range(len(strings)), key=lambda i: (group[i], strings[i])), np.int64)
    table = np.zeros((len(strings), wide + 1), np.uint8)
    for i, x in enumerate(strings):
        table[i, : min(len(x), wide)] = np.frombuffer(x[:wide], np.uint8)
    size = np.minimum(np.array([len(x) for x in strings], np.int64), wide)[order]
    common = np.full(len(strings), -1, np.int64)
    if len(strings) > 1:
        ranked = table[order]
        apart = ranked[1:, :wide] != ranked[:-1, :wide]
        first = np.where(apart.any(1), apart.argmax(1), wide)
        first = np.minimum(first, np.minimum(size[1:], size[:-1]))
        common[1:] = np.where(group[order][1:] == group[order][:-1], first, -1)
    return order, common


def _most_in_common(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each string, what it has in common with its closest neighbour in the order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], -1))
    return out


def repeated_starts(
    group: np.ndarray, around: list[bytes], before: np.ndarray, kind: Repeat = STRINGS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which surroundings, least, most): between which starts before the trigger strings are
    that occur in another surroundings of the same group. Groups are whole.

    The phrase ends (read backwards from the trigger) and the parse suffixes (from the trigger
    on) are each put in order. Strings that start ``a`` bytes before the trigger are equal where
    the ends have ``a`` and the suffixes the rest of the length in common: where both cuts of
    the two orders put them together.
    """
    of = np.arange(len(around))
    for last in (False, True):
        ends = [around[i][: before[i]][::-1] for i in of]
        rests = [around[i][before[i] :] for i in of]
        by_end, in_end = suffix_order(group[of], ends, kind.before)
        by_rest, in_rest = suffix_order(group[of], rests, kind.length)
        if not last:  # strings without a neighbour that has enough in common match none
            of = of[_most_in_common(by_end, in_end) + _most_in_common(by_rest, in_rest) >= kind.length]
            if not len(of):
                return of, of, of
    n = len(of)
    least, most = np.full(n, kind.length, np.int64), np.full(n, -1, np.int64)
    phrase, rest = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(0, kind.before + 1, kind.step):
        phrase[by_end] = np.cumsum(in_end < a)
        rest[by_rest] = np.cumsum(in_rest < kind.length - a)
        rank = phrase * (n + 1) + rest
        order = np.argsort(rank)
        same = rank[order][1:] == rank[order][:-1]
        hit = np.zeros(n, bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        least[hit & (most < 0)] = a
        most[hit] = a
    some = most >= 0
    return of[some], least[some], most[some]


def window_hashes(around: list[bytes], before: np.ndarray, kind: Repeat = STRINGS) -> tuple[np.ndarray, np.ndarray]:
    """For each surroundings (bytes, how many lie before the trigger) the hashes of the strings
    that start 0 .. ``before`` bytes before the trigger, and which of them exist."""
    k, wide, most = len(around), kind.before + kind.length, kind.before
    table = np.zeros((k, wide), np.uint8)
    for i, (x, b) in enumerate(zip(around, before.tolist(), strict=True)):
        table[i, most - b : most - b + len(x)] = np.frombuffer(x, np.uint8)
    after = np.array([len(x) for x in around]) - before
    sums = np.zeros((k, wide + 1), np.uint64)
    np.cumsum(_TABLES[0][table] * _power(0, wide), 1, out=sums[:, 1:])
    a = np.arange(most + 1)
    hashes = _mix((sums[:, wide - a] - sums[:, most - a]) * _power(0, most + 1, True)[most - a])
    return hashes, (a <= before[:, None]) & (kind.length - a <= after[:, None]) & (a % kind.step == 0)


def _rims(around: DataFrame, kind: Repeat) -> DataFrame:
    """(k1, k2, lo, hi) from surroundings dealt by class: what the repeated strings cover."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        g, k1, k2, place, before, text = zip(*rows, strict=True)
        before, place = np.array(before, np.int64), np.array(place, np.int64)
        some, least, most = repeated_starts(np.array(g, np.int64), list(text), before, kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(k1, np.int64)[some]), pa.array(np.array(k2, np.int64)[some]),
             pa.array((place[some] - most).astype(np.int32)), pa.array((place[some] - least + kind.length).astype(np.int32))],
            names=["k1", "k2", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) > AT_ONCE:
                last = held[-1][0]
                cut = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != last), -1) + 1
                if not cut:
                    break
                upto = cut
                if cut > 2 * AT_ONCE:  # whole groups of about so many rows
                    upto = next(i for i in range(AT_ONCE, cut + 1) if i == cut or held[i][0] != held[i - 1][0])
                yield settle(held[:upto])
                held = held[upto:]
        if held:
            yield settle(held)

    dealt = around.repartition("g").sortWithinPartitions("g").select("g", "k1", "k2", "place", "before", "around")
    return dealt.mapInArrow(run, "k1 long, k2 long, lo int, hi int")


def _rims_by_string(around: DataFrame, kind: Repeat) -> DataFrame:
    """The same for classes with very many surroundings: one row a string, counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                before = batch.column(4).to_numpy().astype(np.int64)
                hashes, real = window_hashes(batch.column(5).to_pylist(), before, kind)
                row, start = np.nonzero(real)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(4)), pa.array(start.astype(np.int32)), pa.array(hashes[row, start].view(np.int64))],
                    names=["g", "k1", "k2", "place", "start", "h"],
                )

    strings = around.select("g", "k1", "k2", "place", "before", "around").mapInArrow(
        run, "g long, k1 long, k2 long, place int, start int, h long"
    )
    again = strings.groupBy("g", "start", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return (
        strings.join(materialise(again, "strings"), ["g", "start", "h"])
        .groupBy("k1", "k2", "place")
        .agg(F.min("start").alias("least"), F.max("start").alias("most"))
        .select("k1", "k2", (F.col("place") - F.col("most")).alias("lo"), (F.col("place") - F.col("least") + kind.length).alias("hi"))
    )


def _if_few(table: DataFrame) -> DataFrame:
    """A broadcast hint if a written table of a few numbers a row is counted and small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def repeat_ranges(keyed: DataFrame, kind: Repeat = STRINGS) -> DataFrame:
    """(k1, k2, ranges array<struct<lo, hi>>) of the texts ``keyed`` (k1, k2, _bytes) that hold
    a repeated string: the bytes that such strings cover; ranges may overlap.

    Classes and surroundings are counted with partial sums, so a passage that a third of all
    texts hold is one row a task; joins are between written tables, which adaptive execution
    splits where a key is hot.
    """
    found = materialise(_trigger_table(keyed, kind), "triggers")
    classes = materialise(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "classes")
    hot = materialise(found.join(classes, "g", "left_semi"), "hot")
    discard(found)
    me = F.xxhash64("k1", "k2", "place")  # any one of the triggers with equal surroundings
    kinds = materialise(hot.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(me).alias("first")), "kinds")
    wide = materialise(kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"), "wide")
    kinds = kinds.join(wide, "g", "left").where("n > 1 or kinds > 1")
    again = materialise(kinds.select("g", "c", "n", "first", F.coalesce("kinds", F.lit(1)).alias("kinds")), "again")
    marks = hot.join(again, ["g", "c"]).select(
        "k1", "k2", "place", (F.col("n") > 1).alias("settled"),
        F.when((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("first") == me)), F.col("g")).alias("g"),
        (F.col("kinds") > IN_TASK).alias("wide"),
    )
    marks = materialise(marks, "marks")
    discard(hot, again)
    mine = F.struct("place", "g", "wide")
    lists = marks.where("g is not null").groupBy("k1", "k2").agg(F.collect_set(mine).alias("marks"))
    lists = materialise(lists, "lists")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, done = ["g", "k1", "k2", "place", "before", "around", "wide"], set()
        for whole in batches:
            for batch in slices_by_bytes(whole, 2, SLICE):
                rows: list[tuple] = []
                views = _view(batch.column(2), kind).to_pylist()
                for k1, k2, data, marks in zip(*(batch.column(i).to_pylist() for i in (0, 1)), views, batch.column(3).to_pylist(), strict=True):
                    if (k1, k2) in done:  # a repeated row, whose strings are settled
                        continue
                    done.add((k1, k2))
                    for m in marks:
                        p = m["place"]
                        before = min(kind.before, p)
                        rows.append((m["g"], k1, k2, p, before, data[p - before : p + kind.length], m["wide"]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    few = _if_few(lists.select("k1", "k2"))
    texts = keyed.join(few, ["k1", "k2"], "left_semi").join(lists, ["k1", "k2"])
    around = texts.select("k1", "k2", "_bytes", "marks").mapInArrow(
        surroundings, "g long, k1 long, k2 long, place int, before int, around binary, wide boolean"
    )
    around = materialise(around, "surroundings")
    rims = _rims(around.where("not wide"), kind).unionByName(_rims_by_string(around.where("wide"), kind))
    settled = marks.where("settled").select(
        "k1", "k2", F.greatest(F.lit(0), F.col("place") - kind.before).alias("lo"), (F.col("place") + kind.length).alias("hi")
    )
    both = settled.unionByName(rims)
    ranges = materialise(both.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    discard(marks, lists, around)
    return ranges


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("k2"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("_bytes"), F.col(id_col).alias("_id"),
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_passages: bool = False
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept][, n_passage_words]) for every row.

    Every byte that lies in a string of 400 bytes which also starts anywhere else in the corpus
    is removed; overlaps count, strings are judged on the input, none crosses texts. Null texts
    count as empty; shorter texts stay whole. Repeated rows are texts like any other, so long
    ones are removed from each. ``kept`` holds the remaining bytes (they may not be valid text
    where a character was cut). ``n_passage_words`` counts the words that lie in passages of
    over 50 words which also start anywhere else; nothing is removed for them. Other columns of
    ``docs`` are not read; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        return _remove_repeats(docs, id_col, text_col, with_text, with_passages)


def _remove_repeats(docs: DataFrame, id_col: str, text_col: str, with_text: bool, with_passages: bool) -> DataFrame:
    keyed = _keyed(docs, id_col, text_col)
    found = repeat_ranges(keyed.select("k1", "k2", "_bytes"), STRINGS)
    found = found.withColumnRenamed("ranges", "strings")
    if with_passages:
        words = repeat_ranges(keyed.select("k1", "k2", "_bytes"), PASSAGES).withColumnRenamed("ranges", "passages")
        alone, found = (found, words), materialise(found.join(words, ["k1", "k2"], "full"), "both")
        discard(*alone)
    else:
        found = found.withColumn("passages", F.lit(None).cast(found.schema["strings"].dataType))
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ["kept"] * with_text + ["n_passage_words"] * with_passages
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *extra]
    types = {"kept": "binary", "n_passage_words": "long"}
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", {x} {types[x]}" for x in extra)

    def cover(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, lo, 1)
        np.add.at(edge, np.minimum(hi, n), -1)
        return np.cumsum(edge[:n]) > 0

    def bounds(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lo, hi = (column.flatten().field(i).to_numpy() for i in (0, 1))
        ends = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy())))
        return ((lo[a:b], hi[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices_by_bytes(big, 1, SLICE):
                out: list[tuple] = []
                for data, strings, passages in zip(batch.column(1).to_pylist(), bounds(batch.column(2)), bounds(batch.column(3)), strict=True):
                    n, kept, runs = len(data), data, 0
                    if len(strings[0]):
                        gone = cover(n, *strings)
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    words = int(cover(4 * len(data.split()), *passages).sum()) // 4 if len(passages[0]) else 0
                    out.append((n, n - len(kept), runs, hashlib.sha256(kept).hexdigest(), *[kept] * with_text, *[words] * with_passages))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_text, *[pa.int64()] * with_passages]
                columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names
                )

    few = _if_few(found.select("k1", "k2"))
    size = F.octet_length("_bytes").cast("long")
    none = F.lit(0).cast("long")
    extras = [F.col("_bytes").alias("kept")] * with_text + [none.alias("n_passage_words")] * with_passages
    whole = keyed.join(few, ["k1", "k2"], "left_anti").select(
        F.col("_id").alias(id_col), size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2("_bytes", 256).alias("kept_sha256"), *extras,
    )
    texts = keyed.join(few, ["k1", "k2"], "left_semi").join(found, ["k1", "k2"])
    trimmed = texts.select("_id", "_bytes", "strings", "passages").mapInArrow(cut, schema)
    result = materialise(whole.unionByName(trimmed), "trimmed")
    discard(found)
    return result
