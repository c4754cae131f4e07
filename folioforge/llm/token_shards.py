"""Training-order materialisation: token sequences in fixed-stride binary shards.

Documents are tokenised once and joined into sequences of a fixed number of ids. Sequences
are numbered from 0 without gaps; a keyed Feistel network, walking its cycle until it falls
inside the numbers in use, permutes them: the image is the sequence's global slot. A shard is
a range of slots, written as one file of records of equal size in slot order. Record k of the
training order is at a known place of a known file, so readers stream shards and resume at any
slot, and another key is another epoch's order.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenize
from .common import materialise, scratch_path

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of ``numbers`` under a keyed permutation of 0 .. n - 1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = np.asarray(numbers, np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key + 0x9E3779B9 * (turn + 1) & (2**64 - 1)) & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def filesystem(uri: str):
    """The file system of a shared folder, as executors reach it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def token_sequences(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(part, nth, n_tokens, packed, places): the ids of a task's documents, each followed by
    ``end_id``, cut every ``length`` ids; the last sequence of a task is filled up with it."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenize.per_worker(tokenize.WordIds, tokenizer_path)
        pack = zstandard.ZstdCompressor(level=1).compress
        part, nth = TaskContext.get().partitionId(), 0
        held, filled, places = [], 0, []
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, filled, places, nth
            ids = np.concatenate(held)
            ids = np.concatenate((ids, np.full(length - filled, end_id, ids.dtype)))
            out.append((nth, filled, pack(ids.tobytes()), places))
            held, filled, places, nth = [], 0, [], nth + 1

        def flush() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            n, size, packed, where = zip(*rows, strict=True)
            flat = [p for w in where for p in w]
            ids, start, offset, count = zip(*flat, strict=True)
            struct = pa.StructArray.from_arrays(
                [pa.array(ids, id_type), pa.array(start, pa.int64()), pa.array(offset, pa.int32()), pa.array(count, pa.int32())],
                names=["id", "start", "offset", "length"],
            )
            bounds = np.concatenate(([0], np.cumsum([len(w) for w in where]))).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array(n, pa.int64()), pa.array(size, pa.int32()),
                 pa.array(packed, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), struct)],
                names=["part", "nth", "n_tokens", "packed", "places"],
            )

        gc.disable()  # nothing here makes cycles, and the memory of words is large to walk
        try:
            id_type = pa.int64()
            for batch in batches:
                id_type = batch.schema.field(0).type
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.append(np.frombuffer(encode(text.as_py()), "<u4").astype("<u2"), np.uint16(end_id))
                    at = 0
                    while at < len(ids):
                        take = min(length - filled, len(ids) - at)
                        held.append(ids[at : at + take])
                        places.append((row, at, filled, take))
                        at, filled = at + take, filled + take
                        if filled == length:
                            close()
                if len(out) >= 256:
                    yield flush()
            if filled:
                close()
            if out:
                yield flush()
        finally:
            gc.enable()

    places = f"array<struct<id:{kind},start:bigint,offset:int,length:int>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"part int, nth long, n_tokens int, packed binary, places {places}")


def write_training_order(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    key: int = 2024,
    length: int = 2048,
    per_shard: int = 4096,
    end_id: int = 49407,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Write the shards; returns (manifest, placements).

    manifest: (shard, path, first_slot, records, crc32) for each file; placements: (id, start,
    length, slot, offset, shard, record) for each run of a document's ids in a sequence. Shard
    files hold ``length`` unsigned 16-bit ids a record, little-endian. Files are written under
    a temporary name and renamed, so a lost executor leaves no half shard. Null and empty texts
    are the end id alone; very long ones run through as many sequences as they need. Every row is
    written, repeated rows each time; columns besides id and text are not read; an empty table
    writes nothing. The vocabulary must drop white space (tokenize.WordIds) and have ids below
    65536.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "shards")
    made = materialise(token_sequences(docs, tokenizer_path, length, end_id, id_col, text_col), "sequences")
    # one number for each task of the tokenising stage
    sizes = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count("*").alias("n")).collect())
    parts = np.array([p for p, _ in sizes], np.int64)
    bases = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).astype(np.int64)
    total = int(bases[-1])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, nth = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            slot = permute(bases[np.searchsorted(parts, part)] + nth, total, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // per_shard), batch.column(2)], names=["slot", "shard", batch.schema.names[2]]
            )

    dealt = made.select("part", "nth", "packed").mapInArrow(slots, "slot long, shard long, packed binary")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        unpack = zstandard.ZstdDecompressor().decompress
        done: list[tuple] = []
        shard, stream, temporary, records, crc = None, None, "", 0, 0

        def close() -> None:
            stream.close()
            system.move(temporary, f"{root}/shard-{shard:08d}.bin")
            done.append((shard, f"{folder}/shard-{shard:08d}.bin", shard * per_shard, records, crc))

        for batch in batches:
            for own, packed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != shard:
                    if shard is not None:
                        close()
                    shard, records, crc = own, 0, 0
                    temporary = f"{root}/.shard-{shard:08d}-{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temporary)
                data = unpack(packed.as_buffer(), max_output_size=2 * length)
                stream.write(data)
                records, crc = records + 1, zlib.crc32(data, crc)
        if shard is not None:
            close()
            columns = list(zip(*done, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["shard", "path", "first_slot", "records", "crc32"],
            )

    manifest = materialise(dealt.mapInArrow(write, "shard long, path string, first_slot long, records long, crc32 long"), "manifest")
    kind = made.schema["places"].dataType.simpleString()
    where = made.select("part", "nth", "places").mapInArrow(slots, f"slot long, shard long, places {kind}")
    placements = where.select("slot", "shard", F.inline("places")).select(
        F.col("id").alias(id_col), "start", F.col("length").cast("long").alias("length"), "slot",
        F.col("offset").cast("long").alias("offset"), "shard", (F.col("slot") % per_shard).alias("record"),
    )
    return manifest, placements


def read_records(path: str, first: int = 0, count: int | None = None, length: int = 2048) -> np.ndarray:
    """Records ``first`` .. of a shard as rows of ids; a reader resumes by asking from where it
    stopped."""
    system, name = filesystem(path)
    with system.open_input_file(name) as f:
        have = f.size() // (2 * length) - first
        f.seek(2 * length * first)
        data = f.read(2 * length * (have if count is None else min(count, have)))
    return np.frombuffer(data, "<u2").reshape(-1, length)
