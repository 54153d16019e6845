"""Exact substring dedup: bytes covered by a string of ``least`` bytes that also starts in a document with a smaller id are removed.

A suffix array of the corpus would have every suffix; here only those are sorted that a difference cover leaves open, one block of
suffix buckets at a time.

1. Cover samples: the places of a text whose offset modulo the period lies in a difference cover.  Of any two equal strings of
   ``least`` bytes, at whatever offsets, some pair of samples stands at the same distance from their starts, with ``least`` - period + 1
   equal bytes.  Samples are ranked by buckets over all shards; a string none of whose samples has an equal in another row is unique.
2. Suffixes that remain are sorted by hashes of their first ``least`` bytes, a third of the buckets at a time, so memory and disk are
   bounded by a block.  Ties end at ``least`` bytes.  Of equal ones the smallest id is found over all shards, and a suffix whose document's id is
   larger is removed.  Two hashes, of 64 and 32 bits, stand for the bytes.

A string that a third of all documents hold is sent once by each shard.

Cases: a null or empty text has no bytes; a text shorter than ``least`` stays whole.  A null id counts as smaller than all others; rows with equal ids
are one document to this operator and remove nothing from each other; of copies under different ids the smallest stays.  Texts of any length are taken
whole, a very long one as a shard of its own.  Cuts may part a character, so what is kept is binary.  Other columns stay, whatever their
names.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import shards
from quern.llm.common import table
from quern.llm.shards import PLACE_BITS

LEAST_BYTES = 50
BLOCKS = 3
#: a worker holds some 30 bytes a byte of a shard whose places are all open
SHARD_BYTES = 4 << 20
#: Perfect difference covers, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Odd multipliers of the hashes.
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_NO_ID = np.iinfo(np.int64).min


def cover_of(least: int) -> tuple[int, np.ndarray]:
    """The longest period that leaves a sample half of ``least`` bytes, less a sixth, and its cover."""
    period = max(p for p in COVERS if p == 1 or 5 * p <= 3 * least + 5)
    return period, np.array(COVERS[period], np.int64)


def _parts(length: int) -> list[int]:
    """Where 8-byte words begin that cover ``length`` bytes."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])] if length >= 8 else [0]


def string_hash(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the ``length`` bytes at each place; ``data`` has 8 bytes more than the text."""
    words = np.ndarray((max(0, len(data) - 7),), "<u8", buffer=data, strides=(1,))
    out = np.full(len(at), length, np.uint64)
    for o in _parts(length):
        word = words[at + o]
        if length < 8:
            word &= np.uint64((1 << 8 * length) - 1)
        out ^= word
        out *= _FACTORS[0]
        out ^= out >> np.uint64(29)
    out *= _FACTORS[1]
    return out ^ (out >> np.uint64(32))


def _windows(data: np.ndarray, length: int, step: int):
    """(first place, 64-bit hashes, 32-bit ones) of the ``length`` bytes at every place, ``step`` places at a time."""
    words = np.ndarray((max(0, len(data) - 7),), "<u8", buffer=data, strides=(1,))
    n = max(0, len(data) - 8 - length + 1)
    mask = np.uint64((1 << 8 * min(8, length)) - 1)
    for i in range(0, n, step):
        m = min(step, n - i)
        x, y, moved = np.full(m, length, np.uint64), np.full(m, length + 1, np.uint64), np.empty(m, np.uint64)
        for o in _parts(length):
            word = words[i + o : i + o + m] & mask
            for h, factor in ((x, _FACTORS[0]), (y, _FACTORS[1])):
                np.bitwise_xor(h, word, out=h)
                np.multiply(h, factor, out=h)
            np.right_shift(x, np.uint64(29), out=moved)
            np.bitwise_xor(x, moved, out=x)
        x *= _FACTORS[1]
        y ^= y >> np.uint64(32)
        y *= _FACTORS[0]
        yield i, x ^ (x >> np.uint64(32)), (y >> np.uint64(32)).astype(np.uint32)


def string_hashes(data: np.ndarray, length: int, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash (that of ``string_hash``) and another one of 32 bits of the ``length`` bytes at every place, a few thousand places at a time."""
    n = max(0, len(data) - 8 - length + 1)
    keys, checks = np.empty(n, np.uint64), np.empty(n, np.uint32)
    for i, x, y in _windows(data, length, step):
        keys[i : i + len(x)], checks[i : i + len(x)] = x, y
    return keys, checks


def in_span(key: np.ndarray, span: tuple[int, int, int]) -> np.ndarray:
    """Which keys fall into the buckets from ``low`` to below ``high`` of all."""
    low, high, buckets = span
    if high - low == buckets:
        return np.ones(len(key), bool)
    bucket = key >> np.uint64(64 - (buckets.bit_length() - 1))
    return (bucket >= low) & (bucket < high)


def open_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, least: int, span: tuple[int, int, int], step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, check) of the places in runs whose keys fall into the span; others are never held, but for ``step`` places."""
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first] += 1
    inside[last + 1] -= 1
    np.cumsum(inside, out=inside)
    low, high, buckets = span
    room = int(np.count_nonzero(inside))
    room = room if high - low == buckets else min(room, room * (high - low) // buckets + (room >> 4) + step)
    at, keys, checks, n = np.empty(room, kind), np.empty(room, np.uint64), np.empty(room, np.uint32), 0
    for i, x, y in _windows(data, least, step):
        own = np.flatnonzero(inside[i : i + len(x)].view(bool) & in_span(x, span))
        if n + len(own) > room:  # the span has more than its share
            room = n + len(own) + room // 2
            at, keys, checks = (np.concatenate((a[:n], np.empty(room - n, a.dtype))) for a in (at, keys, checks))
        at[n : n + len(own)], keys[n : n + len(own)], checks[n : n + len(own)] = own + i, x[own], y[own]
        n += len(own)
    return at[:n], keys[:n], checks[:n]


def samples(starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of the cover samples that some string of ``least`` bytes holds, in order."""
    period, cover = cover_of(least)
    long = np.flatnonzero(ends - starts >= least)
    last = ends[long] - starts[long] - (least - period + 1)
    n = (last + 1) // period * len(cover) + np.searchsorted(cover, (last + 1) % period)
    text = np.repeat(long, n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts[text] + nth // len(cover) * period + cover[nth % len(cover)], text


def sample_keys(data: np.ndarray, at: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """A hash of the sample's bytes, and below it the place of its text in the shard."""
    key = string_hash(data, at, least - cover_of(least)[0] + 1)
    return key >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | text.astype(np.uint64)


def distinct_keys(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, where each begins, whether two texts have it) of sorted ``sample_keys``."""
    keys = ranked >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(keys)) - 1 if len(starts) else starts
    return keys[starts], starts, ranked[starts] != ranked[ends]


def open_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: pa.Scalar, buckets: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last): runs of places where strings of ``least`` bytes with a shared sample begin."""
    period, _ = cover_of(least)
    at, text = samples(starts, ends, least)
    packed = sample_keys(data, at, text, least)
    order = np.argsort(packed)
    keys, begins, shared = distinct_keys(packed[order])
    shared |= shards.answers(bits, shards.bucket_edges(keys, buckets))
    hit = np.zeros(len(at), bool)
    hit[order] = np.repeat(shared, np.diff(np.append(begins, len(at))))
    at, text = at[hit], text[hit]
    if not len(at):
        return text, at, at
    cut = np.flatnonzero(np.append(True, (at[1:] - period + 1 > at[:-1] + 1) | (text[1:] != text[:-1])))
    text, first, last = text[cut], at[cut] - period + 1, at[np.append(cut[1:], len(at)) - 1]
    first, last = np.maximum(first, starts[text]), np.minimum(last, ends[text] - least)
    real = last >= first
    return text[real], first[real], last[real]


class Suffixes:
    """The open suffixes of a shard (see ``open_hashes``) that one block of buckets has, in the order of their keys."""

    def __init__(self, hashed: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, ids: np.ndarray, span: tuple[int, int, int]):
        self.low, high, buckets = span
        self.at, key, check = hashed
        own = in_span(key, span)
        if not own.all():
            self.at, key, check = self.at[own], key[own], check[own]
        edges = np.append(np.searchsorted(self.at, first), len(self.at))
        run = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(edges))
        order = ordered(key, check)
        self.at, run, key, check = self.at[order], run[order], key[order], check[order]
        del order
        self.run, self.ids = run, ids[run]
        self.starts = groups(key, check)
        self.least_id = np.minimum.reduceat(self.ids, self.starts) if len(self.starts) else self.ids
        self.key, self.check = key[self.starts], check[self.starts]
        edges = shards.bucket_edges(self.key, buckets)
        self.edges = edges[self.low : high + 1]

    def removed(self, bits: pa.Scalar) -> np.ndarray:
        """Whether a document with a smaller id, here or in another shard, has the string too."""
        sizes = np.diff(np.append(self.starts, len(self.at)))
        return np.repeat(shards.answers(bits, self.edges, self.low), sizes) | (self.ids > np.repeat(self.least_id, sizes))


def ordered(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """An order by key and then check; the second sort is only for equal keys of different checks."""
    order = np.argsort(key)
    k, c = key[order], check[order]
    return np.lexsort((check, key)) if np.any((k[1:] == k[:-1]) & (c[1:] != c[:-1])) else order


def groups(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))) if len(key) else np.empty(0, np.int64)


def in_other_shards(columns: list[np.ndarray], shard: np.ndarray) -> np.ndarray:
    """Keys that a second shard sent."""
    ranked = np.sort(columns[0])
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    place = np.searchsorted(twice, columns[0])
    return twice[np.minimum(place, len(twice) - 1)] == columns[0] if len(twice) else np.zeros(len(ranked), bool)


def has_smaller(columns: list[np.ndarray], shard: np.ndarray) -> np.ndarray:
    """Strings that some shard sent with a smaller id."""
    key, check, ids = columns
    order = ordered(key, check)
    starts = groups(key[order], check[order])
    out = np.empty(len(key), bool)
    sizes = np.diff(np.append(starts, len(key)))
    out[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], starts), sizes)
    return out


def _documents(docs: pa.Array, id_at: int, text_at: int):
    """(struct array, bytes, starts, ends, ids) of a shard."""
    ids = docs.field(id_at)
    return docs, *shards.text_bytes(docs.field(text_at)), ids.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES, blocks: int = BLOCKS) -> DataFrame:
    """(d: the whole row, spans: the maximal removed runs of bytes as (start, stop), kept: the other bytes) of every row of ``docs``."""
    spark = docs.sparkSession
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    whole = shards.sharded(docs, text_col, "shards", shard_bytes)
    total = whole.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = shards.bucket_count(4 * total)

    def read(b: pa.RecordBatch, i: int, column: int):
        return _documents(b.column(column)[i].values, id_at, text_at)

    def send_samples(batches):
        for b, i in shards.shard_rows(batches):
            _, data, starts, ends, _ = read(b, i, 1)
            keys, _, _ = distinct_keys(np.sort(sample_keys(data, *samples(starts, ends, least), least)))
            yield shards.sent(b.column(0)[i].as_py(), shards.bucket_edges(keys, buckets), [keys])

    rows = shards.byte_batches(whole.select("shard", "docs"))
    shared = shards.answered(rows.mapInArrow(send_samples, shards.sent_schema(1)), ["<u8"], in_other_shards, "samples")

    def open_suffixes(batches):
        for b, i in shards.shard_rows(batches):
            _, data, starts, ends, ids = read(b, i, 1)
            text, first, last = open_runs(data, starts, ends, b.column(2)[i], buckets, least)
            whole = np.concatenate([data[:0], *[data[i:j] for i, j in zip(first.tolist(), (last + least).tolist())]])
            columns = [shards.one_blob(np.ascontiguousarray(c)) for c in (whole, last - first + 1, text, first - starts[text], ids[text])]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *columns], names=["shard", "data", "n", "text", "first", "ids"])

    found = rows.join(shared.hint("shuffle_hash"), "shard", "left").mapInArrow(open_suffixes, "shard long, data binary, n binary, text binary, first binary, ids binary")
    runs = shards.settled(found, "runs", **shards.FEW_BLOBS)

    def hashed(b: pa.RecordBatch, i: int, at: int, span: tuple[int, int, int]):
        """The hashes of a shard's open suffixes, and of its runs the texts, offsets in them, starts and ids."""
        data, n, text, first, ids = (np.frombuffer(b.column(at + j)[i].as_buffer(), kind) for j, kind in enumerate((np.uint8, np.int64, np.int64, np.int64, np.int64)))
        ends = np.cumsum(n + least - 1)
        starts = ends - (n + least - 1)
        return open_hashes(np.concatenate((data, np.zeros(8, np.uint8))), starts, starts + n - 1, least, span), text, first, starts, ids

    spans = [(buckets * i // blocks, buckets * (i + 1) // blocks, buckets) for i in range(blocks)]
    answers = None
    for span in spans:

        def send_suffixes(batches, span=span):
            for b, i in shards.shard_rows(batches):
                found, _, _, starts, ids = hashed(b, i, 1, span)
                own = Suffixes(found, starts, ids, span)
                yield shards.sent(b.column(0)[i].as_py(), own.edges - own.edges[0], [own.key, own.check, own.least_id], span[0])

        part = shards.answered(shards.byte_batches(runs).mapInArrow(send_suffixes, shards.sent_schema(3)), ["<u8", "<u4", "<i8"], has_smaller, "suffixes")
        answers = part if answers is None else answers.unionByName(part)
    answers = answers.groupBy("shard").agg(F.flatten(F.collect_list("bits")).alias("bits"))
    schema = T.StructType([T.StructField("d", whole.schema["docs"].dataType.elementType), T.StructField("spans", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "stop")]))), T.StructField("kept", T.BinaryType())])

    def cut(batches):
        for b, i in shards.shard_rows(batches):
            rows, data, starts, ends, _ = read(b, i, 1)
            gone = np.zeros(len(data) + 1, np.int8)
            if b.column(2)[i].is_valid:
                found, text, first, begins, of = hashed(b, i, 2, (0, buckets, buckets))
                for span in spans:
                    own = Suffixes(found, begins, of, span)
                    out = own.removed(b.column(7)[i])
                    at = own.at[out] - begins[own.run[out]] + (starts[text] + first)[own.run[out]]
                    gone[at] += 1  # each place is there once
                    gone[at + least] -= 1
                    del own, out, at
                del found
            gone = np.cumsum(gone[:-1], dtype=np.int32) > 0
            yield from _results(rows, data, starts, ends, gone)

    joined = rows.join(runs.hint("shuffle_hash"), "shard", "left").join(answers.hint("shuffle_hash"), "shard", "left")
    return joined.mapInArrow(cut, schema)


def _results(rows: pa.Array, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray):
    """Rows with the runs of bytes that are gone, and the bytes that aren't."""
    text = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts)
    inside = gone[: len(text)]
    fresh = np.append(True, (text[1:] != text[:-1])) if len(text) else np.empty(0, bool)
    begin = np.flatnonzero(inside & (fresh | ~np.append(False, inside[:-1])))
    over = np.flatnonzero(inside & (np.append(fresh[1:], True) | ~np.append(inside[1:], False))) + 1 if len(text) else begin
    of = text[begin] if len(begin) else begin
    spans = pa.StructArray.from_arrays([pa.array(begin - starts[of], pa.int64()), pa.array(over - starts[of], pa.int64())], names=["start", "stop"])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(starts))))).astype(np.int32)
    kept = data[: len(text)][~inside]
    left = np.concatenate(([0], np.cumsum(np.bincount(text[~inside], minlength=len(starts))))).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(left), pa.py_buffer(kept)])
    yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(offsets), spans), binary], names=["d", "spans", "kept"])


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("d.doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    n = LEAST_BYTES
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * n}) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {n - 1})) AS i FROM d)),
gone AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY s) USING (s) WHERE doc_id > least),
parts AS (SELECT doc_id, i, sum(CASE WHEN gap <= {n} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM gone),
spans AS (SELECT doc_id, part, min(i) AS a, max(i) + {n} AS b, lag(max(i) + {n}, 1, 0) OVER (PARTITION BY doc_id ORDER BY part) AS before FROM parts GROUP BY doc_id, part),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY part) AS front
  FROM spans JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
