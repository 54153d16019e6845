"""Token-id files: Parquet list columns in document order, with controlled encodings, row groups and pages.

``write_token_files`` encodes each whole text, appends the end id and writes rows in ascending id
order.  ``read_token_files`` reads any columns and any id range back; filters on the id reach row
groups and, through the page index, single pages.

Cases: a null or empty text is the end id alone.  Rows with equal ids keep their input order, rows
with a null id come first.  Texts of any length are encoded whole.  Other columns of the input are ignored, whatever their names.  An empty
input writes an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.llm.common import scratch_path, small_batches, table

BATCH_CHARS = 1 << 21
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens int, tokens array<int>"


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of bounded size from (id, text) batches; null texts become empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            ids.append(key)
            texts.append(text)
            size += len(text) + 64
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def id_lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int32)))


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 64 << 10,
    page_rows: int = 256,
) -> None:
    """Writes ``docs`` as token files.

    ``encoding`` is that of the ids: ``dictionary`` (falling back to delta where a chunk has too many
    distinct ids) or ``delta``.  ids and lengths of documents are always delta-encoded.
    """
    source = tokenizer or bpe.default_path()

    def encode(batches):
        from pyspark import TaskContext

        encode_texts, part, start = bpe.encoder(source), TaskContext.get().partitionId(), 0
        for ids, texts in text_batches(batches):
            rows = [np.append(r, np.uint32(end_id)) for r in encode_texts(texts)]
            n = np.array([len(r) for r in rows], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(start + np.cumsum(n) - n),
                    pa.array(n.astype(np.int32)),
                    id_lists(rows),
                ],
                names=["doc_id", "part", "part_start", "n_tokens", "tokens"],
            )
            start += int(n.sum())

    ordered = (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(text_col).alias("text"),
            F.monotonically_increasing_id().alias("row"),
        )
        .repartitionByRange("doc_id", "row")
        .sortWithinPartitions("doc_id", "row")
    )
    (
        small_batches(ordered.select("doc_id", "text"))
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#part", "true")
        .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
        .parquet(path)
    )


def read_token_files(
    spark: SparkSession, path: str, *, ids: tuple[int, int] | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Rows of token files; ``ids`` is an inclusive id range, ``columns`` what to read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    if ids:
        rows = rows.where(F.col("doc_id").between(*ids))
    return rows.select(*columns) if columns else rows


def document_starts(rows: DataFrame) -> DataFrame:
    """Replaces ``part`` and ``part_start`` by ``start``, the ids of all documents before this one.

    Only one row per part, not per document, passes through the ordered running sum.
    """
    from pyspark.sql import Window

    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").withColumn("start", F.col("part_start") + F.col("offset")).drop("part", "part_start", "offset")


def list_crc32(lists: pa.ListArray) -> np.ndarray:
    """Unsigned CRC-32 of each list's values as little-endian unsigned 32-bit integers."""
    offsets = lists.offsets.to_numpy()
    flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
    return np.array([zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], dtype=np.int64)


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Reads token files back: doc_id, start, n_tokens (of the list as read) and ids_crc32."""

    def digest(batches):
        for b in batches:
            lists = b.column(3)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int64)), pa.array(list_crc32(lists))],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    rows = read_token_files(spark, path, columns=["doc_id", "part", "part_start", "tokens"])
    read = small_batches(rows).mapInArrow(digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    from quern.llm.common import written

    return document_starts(written(read, "token-digests")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_file_digests(spark, path)
