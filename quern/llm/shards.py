"""Shards of whole texts, and the exchange of sorted keys between shards and buckets of keys.

A shard is a row that holds neighbouring documents of bounded size, so a task can look at one with array operations, and what it
sends is a few blobs instead of a row a key.  Shards are written once: whatever is found in a shard again, after a lost executor
or in a later stage, is found in the same order.  Keys travel sorted and distinct within their shard, which is all the pre-aggregation a hot key
needs: it comes from a shard once.  The answer for a shard is a bit a key, in the order in which the keys were sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import small_batches, written

SHARD_BYTES = 8 << 20
#: a place among the documents of a shard takes 14 bits
PLACE_BITS = 14
LEAST_BUCKETS = 256
BUCKET_BYTES = 16 << 20
_BATCH_BYTES = 8 << 20
#: of a bucket, what is decided at once
_PART_BYTES = 8 << 20
#: for tables of few and large rows, as writers would else hold a hundred of them before they look at sizes; readers hold a row group
FEW_BLOBS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def byte_batches(df: DataFrame) -> DataFrame:
    """``df``, to be handed to Python in batches of about 8 MB, or of one row; a setting of the session, lowered, never raised."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(df.sparkSession.conf.get(name))
    if now > _BATCH_BYTES:
        df.sparkSession.conf.set(name, str(_BATCH_BYTES))
    return df


def settled(df: DataFrame, label: str, **options) -> DataFrame:
    """``written``, after which Spark deletes the shuffle files that led to the table."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN_UP)
    conf.set(_CLEAN_UP, "true")
    try:
        return written(df, label, **options)
    finally:
        conf.set(_CLEAN_UP, before)


def sharded(docs: DataFrame, text_col: str, label: str, limit: int = SHARD_BYTES) -> DataFrame:
    """(shard, n_bytes, docs: array of whole rows), written; a shard ends with the row that takes it to ``limit`` bytes."""
    rows = docs.select(F.struct("*").alias("d"), F.octet_length(text_col).alias("n"))
    item = rows.schema["d"].dataType

    def run(batches):
        from pyspark import TaskContext

        shard, held, size, count = TaskContext.get().partitionId() << 32, [], 0, 0

        def row():
            whole = pa.concat_arrays(held)
            listed = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([size], pa.int64()), listed], names=["shard", "n_bytes", "docs"])

        for b in batches:
            sizes = pc.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = 0
            for i, n in enumerate(sizes):
                size += int(n)
                count += 1
                if size >= limit or count == 1 << PLACE_BITS:
                    held.append(b.column(0).slice(first, i + 1 - first))
                    yield row()
                    shard, held, size, count, first = shard + 1, [], 0, 0, i + 1
            if first < len(sizes):
                held.append(b.column(0).slice(first))
        if count:
            yield row()

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("docs", T.ArrayType(item))])
    return settled(small_batches(rows).mapInArrow(run, schema), label, **FEW_BLOBS)


def shard_rows(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, int]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b, i


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes and 8 zeros, starts, ends) of a string array; a null is empty."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return np.concatenate((whole, np.zeros(8, np.uint8))), at[:-1] - at[0], at[1:] - at[0]


def token_ids(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(ids of the parts between single blanks, the distinct parts, in the order of their first place)."""
    found = pc.split_pattern(pa.array([data], pa.large_binary()), b" ").values.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def bucket_count(total_bytes: int) -> int:
    """A power of two, ``LEAST_BUCKETS`` at least, so that a bucket has about ``BUCKET_BYTES``."""
    return max(LEAST_BUCKETS, 1 << max(0, (total_bytes // BUCKET_BYTES).bit_length()))


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of equal leading bits begins in sorted 64-bit keys; one more for the end."""
    width = np.uint64(64 - (buckets.bit_length() - 1))
    return np.append(np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) << width), len(keys)) if buckets > 1 else np.array([0, len(keys)])


def planes(values: np.ndarray) -> bytes:
    """The bytes of ``values``, those of equal weight together: the leading ones of sorted keys compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplaned(blob, dtype) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    planes = blob if isinstance(blob, np.ndarray) else np.frombuffer(blob, np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def one_blob(data) -> pa.Array:
    """A binary array of one value, which is ``data`` itself and not a copy."""
    whole = pa.py_buffer(data)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, whole.size], np.int32)), whole])


def sent(shard: int, edges: np.ndarray, columns: list[np.ndarray], first: int = 0) -> pa.RecordBatch:
    """A row for each bucket that has keys: (bucket, shard, a blob a column)."""
    used = np.flatnonzero(np.diff(edges))
    blobs = [pa.array([planes(c[edges[i] : edges[i + 1]]) for i in used], pa.binary()) for c in columns]
    names = ["bucket", "shard", *[f"c{i}" for i in range(len(columns))]]
    return pa.RecordBatch.from_arrays([pa.array(used + first, pa.int64()), pa.array(np.full(len(used), shard), pa.int64()), *blobs], names=names)


def sent_schema(columns: int) -> str:
    return "bucket long, shard long, " + ", ".join(f"c{i} binary" for i in range(columns))


def answered(rows: DataFrame, kinds: list, decide: Callable[[list[np.ndarray], np.ndarray], np.ndarray], label: str) -> DataFrame:
    """(shard, bits: array of (bucket, blob)), written: ``decide`` gets all columns of some keys of a bucket and each key's shard, and says yes or no a key.

    Blobs are sorted by the first column.  A bucket is decided a range of it at a time, all rows of a key at once, so that beside the bucket itself little is in memory.
    """
    kinds = [np.dtype(k) for k in kinds]

    def run(group: pa.Table) -> pa.Table:
        columns = [[np.frombuffer(b.as_buffer(), np.uint8).reshape(kind.itemsize, -1) for b in group.column(f"c{i}")] for i, kind in enumerate(kinds)]
        keys = [unplaned(b, kinds[0]) for b in columns[0]]
        parts = 1 + sum(len(k) for k in keys) * sum(kind.itemsize for kind in kinds) // _PART_BYTES
        low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
        edges = np.array([low + (high - low) * i // parts for i in range(1, parts)], kinds[0])
        cuts = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in keys]
        del keys
        yes = [[] for _ in cuts]
        for i in range(parts):
            sizes = [c[i + 1] - c[i] for c in cuts]
            if any(sizes):
                own = [np.concatenate([unplaned(b[:, c[i] : c[i + 1]], kind) for b, c in zip(column, cuts)]) for column, kind in zip(columns, kinds)]
                said = decide(own, np.repeat(np.arange(len(sizes)), sizes))
                for held, end, n in zip(yes, np.cumsum(sizes).tolist(), sizes):
                    held.append(said[end - n : end])
        bits = [np.packbits(np.concatenate(held)).tobytes() for held in yes]
        return pa.table({"shard": group.column("shard"), "bucket": group.column("bucket"), "bits": pa.chunked_array([pa.array(bits, pa.binary())])})

    found = rows.groupBy("bucket").applyInArrow(run, "shard long, bucket long, bits binary")
    return settled(found.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")), label, **FEW_BLOBS)


def answers(bits: pa.Scalar, edges: np.ndarray, first: int = 0) -> np.ndarray:
    """What ``answered`` says of a shard's keys, in their order."""
    out = np.zeros(edges[-1], bool)
    for item in bits.as_py() or []:
        i = item["bucket"] - first
        if 0 <= i < len(edges) - 1:
            n = edges[i + 1] - edges[i]
            out[edges[i] : edges[i + 1]] = np.unpackbits(np.frombuffer(item["bits"], np.uint8), count=int(n)).astype(bool)
    return out
