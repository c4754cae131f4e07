"""Near duplicates by SimHash, linked through a Gray-order hierarchical index.

Fingerprints at ``radius`` or fewer differing bits are linked, exactly. The 64 bits are cut
into blocks; any linked pair agrees in some ``m - radius`` blocks (pigeonhole), so one table
for each choice of blocks, dealt by the chosen bits, brings every linked pair together in
some task. In a task the fingerprints of a table are sorted by Gray rank. Runs that share a
prefix are the nodes of a hierarchy, each standing for one masked bit pattern; node pairs
descend level by level, add up differing bits, and fall away as groups once they exceed the
radius. A task returns a spanning forest of its links, never pairs: at most one edge a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, words_of
from .components import connected_components
from .line_dedup import LOCAL, line_links, word_shingles, word_sketch

#: Seed of the shingle hash.
SEED = 42
#: Bits that a level of the hierarchy adds; a node has at most 2**LEVEL_BITS children.
LEVEL_BITS = 10
#: Node pairs that are expanded at once in a task.
CHUNK = 2_000_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included. No word: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    hashes = [h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    values, counts = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        counts += np.unpackbits(values[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long. Null texts count as empty."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, fp long")


def block_tables(n: int, radius: int) -> list[tuple[tuple[int, int], ...]]:
    """The tables for n distinct fingerprints: each is the blocks (shift, width) in order,
    those of the key (all but ``radius``) first. More fingerprints get longer keys in more
    tables; each choice is exact."""
    for key_blocks in range(1, 5):
        blocks = radius + key_blocks
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        cut = [(64 - edges[i + 1], edges[i + 1] - edges[i]) for i in range(blocks)]
        if key_blocks == 4 or n <= 2 ** (64 * key_blocks // blocks + 8):
            return [
                tuple(cut[i] for i in (*chosen, *(i for i in range(blocks) if i not in chosen)))
                for chosen in combinations(range(blocks), key_blocks)
            ]
    raise AssertionError


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of all pairs (i, j); roots are the smallest places."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = _roots(parent)


def link_forest(prints: np.ndarray, blocks: tuple[tuple[int, int], ...], radius: int) -> np.ndarray:
    """For distinct fingerprints (uint64), each one's root among those that links within equal
    keys join. Works on one table's rows in one task."""
    key_bits = sum(width for _, width in blocks[: len(blocks) - radius])
    codes = np.zeros_like(prints)
    for shift, width in blocks:
        codes = (codes << np.uint64(width)) | ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    order = np.argsort(gray_rank(codes), kind="stable")
    codes, n = codes[order], len(prints)
    depths = [key_bits, *range(key_bits + LEVEL_BITS, 64, LEVEL_BITS), 64]
    starts, patterns = [], []
    for above, depth in zip([0, *depths], depths, strict=False):
        prefix = codes >> np.uint64(64 - depth)
        first = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
        starts.append(first)
        patterns.append(prefix[first] & np.uint64((1 << (depth - above)) - 1))
    ends = [np.append(s[1:], n) for s in starts]
    child_from = [np.searchsorted(starts[k + 1], starts[k]) for k in range(len(depths) - 1)]
    child_to = [np.searchsorted(starts[k + 1], ends[k]) for k in range(len(depths) - 1)]

    parent, found, waiting, merged = np.arange(n), [], 0, False
    own = np.flatnonzero(ends[0] - starts[0] > 1)
    stack = [(0, own, own, np.zeros(len(own), np.int64))]
    while stack:
        level, a, b, acc = stack.pop()
        if merged:  # groups that are one component already have nothing to add
            low, high = np.minimum.reduceat(parent, starts[level]), np.maximum.reduceat(parent, starts[level])
            useful = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b, acc = a[useful], b[useful], acc[useful]
        if not len(a):
            continue
        width = child_to[level][b] - child_from[level][b]
        size = (child_to[level][a] - child_from[level][a]) * width
        upto = int(np.searchsorted(np.cumsum(size), CHUNK)) + 1
        if upto < len(a):
            stack.append((level, a[upto:], b[upto:], acc[upto:]))
            a, b, acc, width, size = a[:upto], b[:upto], acc[:upto], width[:upto], size[:upto]
        pair = np.repeat(np.arange(len(a)), size)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        i = child_from[level][a][pair] + place // width[pair]
        j = child_from[level][b][pair] + place % width[pair]
        total = acc[pair] + np.bitwise_count(patterns[level + 1][i] ^ patterns[level + 1][j])
        keep = (total <= radius) & ((a != b)[pair] | (i <= j))
        i, j, total = i[keep], j[keep], total[keep]
        if level + 1 < len(depths) - 1:
            stack.append((level + 1, i, j, total))
            continue
        found.append((i[i != j], j[i != j]))
        waiting += len(i)
        if waiting > CHUNK // 8:
            parent = _merge(parent, *(np.concatenate(x) for x in zip(*found, strict=True)))
            found, waiting, merged = [], 0, True
    if found:
        parent = _merge(parent, *(np.concatenate(x) for x in zip(*found, strict=True)))
    roots = np.empty(n, np.int64)
    roots[order] = order[parent]
    return roots


def link_edges(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(src, dst): for a table of distinct fingerprints (fp), edges that span every component
    of the graph of pairs at ``radius`` or fewer differing bits."""
    tables = block_tables(prints.count(), radius)
    fp = F.col("fp")
    keys = []
    for t, blocks in enumerate(tables):
        key = F.lit(0).cast("long")
        for shift, width in blocks[: len(blocks) - radius]:
            part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("k")))
    dealt = prints.select("fp", F.inline(F.array(*keys))).repartition("t", "k").select("t", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not rows:
            return
        of, values = (np.concatenate(x) for x in zip(*rows, strict=True))
        for t in np.unique(of):
            mine = values[of == t].astype(np.int64).view(np.uint64)
            roots = link_forest(mine, tables[t], radius)
            moved = np.flatnonzero(roots != np.arange(len(mine)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine[moved].view(np.int64)), pa.array(mine[roots[moved]].view(np.int64))], names=["src", "dst"]
                )

    return dealt.mapInArrow(run, "src long, dst long")


def simhash_prints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(id, fp, root) for every row: rows with the same root are in one component."""
    prints = materialise(with_fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = materialise(prints.select("fp").distinct(), "distinct")
    roots = connected_components(link_edges(distinct, radius))
    return prints.join(roots.toDF("fp", "root"), "fp", "left").select(id_col, "fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included. Texts that
    are null, empty or blank have fingerprint zero and link like any other. Repeated rows and
    ids give repeated result rows. Null ids never become a component_id unless all ids of the
    component are null. Columns of ``docs`` besides id and text are not read. An empty table
    gives an empty result.
    """
    found = materialise(simhash_prints(docs, id_col, text_col, shingle, radius), "rooted")
    # written first: where it is too large to broadcast, adaptive execution splits a hot root
    least = materialise(found.groupBy("root").agg(F.min(id_col).alias("component_id")), "least")
    return found.join(broadcast_if_small(least), "root").select(id_col, "fp", "component_id")


def near_duplicate_roots(
    docs: DataFrame, key_col: str, text_col: str = "text", threshold: float = 0.8, radius: int = 4
) -> DataFrame:
    """(key, root) for every row of ``docs``: rows with the same root are in one component of
    documents whose five-word shingles have an exact Jaccard similarity of ``threshold``.

    Fingerprints of five-word shingles, linked through the index, nominate groups; at 0.8 two
    documents differ in ten of 64 bits on average, which no index of exact tables reaches, so
    bands of MinHashes nominate what the fingerprints cannot. Every link is verified on the
    shingles. Words are in lower case; documents of equal words are one node. Null, empty and
    blank texts are one node without words. Keys may be repeated; an empty table gives none.
    """
    words = docs.select(F.col(key_col), F.array_join(words_of(F.lower(F.col(text_col))), " ").alias("line"))
    words = words.withColumn("h", F.xxhash64("line"))
    groups = simhash_prints(words.select("h", "line"), "h", "line", 5, radius).select(F.xxhash64("root").alias("bucket"), "h").distinct()
    groups = materialise(groups, "groups")
    shared = groups.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    links = line_links(words.select("h", "line"), threshold, word_shingles, word_sketch, groups.join(shared, "bucket"))
    roots = connected_components(links, local=LOCAL).toDF("h", "root")
    return words.drop("line").join(roots, "h", "left").select(key_col, F.coalesce("root", "h").alias("root"))
