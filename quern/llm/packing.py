"""Packing by multiway Karmarkar-Karp differencing.

Each task packs its documents in blocks.  A document longer than a window gives whole windows
first; what remains is an item.  Differencing merges partial partitions of the items, the fullest
part of one with the emptiest of the other, until one partition into ``k`` near-equal windows is
left.  While a window passes its capacity ``k`` rises, as far as ``padding`` allows: the share of padding
that may be spent to keep documents whole, 0 unless given.  Items are then cut where a window still passes
its capacity; the cut tails fill the windows below it.  The last tokens of a block, beyond the capacity of
``k`` windows, have windows of the sizes of powers of two, which need no padding.

Cases: a null or empty text is its end id alone; rows with equal or null ids are documents of their
own; a text of any length is packed whole, in as many windows as it fills; other columns are ignored; an empty input gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.llm.common import small_batches, table
from quern.llm.token_files import text_batches

WINDOW = 2048
BLOCK_WINDOWS = 512
PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens array<int>"
)

Piece = tuple[int, int, int]  # document (its place in the block), start, length


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """A partition of the items into ``k`` parts of near-equal sums, by multiway differencing.

    A partial partition is a list of (sum, items) in falling order of sums; parts that are still
    empty aren't stored.  The two partial partitions with the widest spread are merged with opposing
    orders, so that their imbalances cancel.
    """
    if k <= 1 or not sizes:
        return [list(range(len(sizes)))] if sizes else []
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the last ``over`` parts of each meet in opposing order; the rest stay with empty parts
            merged = a[:-over] + b[:-over]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[-over:], reversed(b[-over:]))]
        merged.sort(key=lambda p: -p[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    return [items for _, items in heap[0][2]]


def pack_block(lengths: list[int], window: int = WINDOW, padding: float = 0.0) -> list[list[Piece]]:
    """Sequences of pieces that hold every token of documents of these lengths exactly once.

    Every sequence has ``window`` tokens or a power of two below it, but for windows that lack at most a
    share of ``padding`` of all tokens.  With a ``padding`` of 1 no document up to a window's size is cut,
    unless a block's tokens are less than a window.
    """
    sequences: list[list[Piece]] = []
    items: list[Piece] = []
    for d, n in enumerate(lengths):
        full = n // window * window
        sequences += [[(d, s, window)] for s in range(0, full, window)]
        if n > full:
            items.append((d, full, n - full))
    total = sum(x[2] for x in items)
    k = total // window
    if not k:
        parts, spare = [], items
    else:
        sizes, most = [x[2] for x in items], max(k, int(total + padding * sum(lengths)) // window)
        while True:
            parts, spare = [[items[i] for i in part] for part in difference(sizes, k)], []
            over = sum(max(0, sum(x[2] for x in part) - window) for part in parts)
            if not over or k == most:
                break
            k = min(most, k + max(1, over // window))  # capacity is exceeded: more windows
        for part in parts:  # cut at the capacity
            room = window
            for j, (d, s, n) in enumerate(part):
                if n > room:
                    spare += ([(d, s + room, n - room)]) + part[j + 1 :]
                    del part[j:]
                    if room:
                        part.append((d, s, room))
                    break
                room -= n
    spare.sort(key=lambda x: x[2])  # the longest tails fill first
    while len(parts) < k:
        parts.append([])

    def fill(part: list[Piece], room: int) -> None:
        while room and spare:
            d, s, n = spare.pop()
            take = min(n, room)
            part.append((d, s, take))
            if n > take:
                spare.append((d, s + take, n - take))
            room -= take

    for part in sorted(parts, key=lambda p: sum(x[2] for x in p)):
        fill(part, window - sum(x[2] for x in part))
    sequences += parts
    rest = sum(x[2] for x in spare)
    for bit in reversed(range(rest.bit_length())):  # what ``k`` windows can't hold
        if rest >> bit & 1:
            sequences.append([])
            fill(sequences[-1], 1 << bit)
    return sequences


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    window: int = WINDOW,
    padding: float = 0.0,
    block_windows: int = BLOCK_WINDOWS,
    with_tokens: bool = True,
) -> DataFrame:
    """One row per piece: its document, place, length, checksum, sequence, offset and (optionally) ids.

    No shuffle: each task packs what it reads, in blocks of about ``block_windows`` windows, and
    numbers its sequences from its partition's number times 2^33.
    """
    source = tokenizer or bpe.default_path()
    limit = window * block_windows

    def pieces(ids: list, rows: list[np.ndarray], first: int):
        sequences = pack_block([len(r) for r in rows], window, padding)
        columns = [[] for _ in range(8)]
        for q, sequence in enumerate(sequences):
            offset = 0
            for d, s, n in sequence:
                own = rows[d][s : s + n]
                values = (ids[d], s, n, zlib.crc32(own.astype("<u4", copy=False)), len(rows[d]), first + q, offset)
                for column, value in zip(columns, values):
                    column.append(value)
                columns[7].append(own.view(np.int32) if with_tokens else None)
                offset += n
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split(" ")[0] for f in PIECE_SCHEMA.split(", ")]), len(sequences)

    def run(batches):
        from pyspark import TaskContext

        encode_texts, serial = bpe.encoder(source), TaskContext.get().partitionId() << 33
        ids, rows, size = [], [], 0
        for some, texts in text_batches(batches):
            for key, row in zip(some, encode_texts(texts)):
                ids.append(key)
                rows.append(np.append(row, np.uint32(end_id)))
                size += len(rows[-1])
                if size >= limit:
                    batch, n = pieces(ids, rows, serial)
                    yield batch
                    ids, rows, size, serial = [], [], 0, serial + n
        if ids:
            yield pieces(ids, rows, serial)[0]

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(chosen).mapInArrow(run, PIECE_SCHEMA)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_tokens=False).drop("tokens")
