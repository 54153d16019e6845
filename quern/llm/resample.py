"""Importance resampling towards a target distribution, over hashed bags of n-grams.

Words get ids within a block of texts, and a suffix array of word ids, compared to the longest feature's length, puts
equal n-grams side by side.  Its longest common prefixes split it into runs, one a distinct n-gram of each length: a run is hashed
once, and its bucket goes back to all its occurrences, for counting and for scoring.

Counts of source and target per bucket are sums over all texts; only a number per bucket, ``BUCKETS`` of them, comes to the
driver, whatever the corpus.  Drawing the best is one range sort (see ``drawn``), without a window over all rows.

Cases: a null or empty text, or one without words, has no features and weight 0.  Words are split at ASCII characters other than digits and
letters; nothing else is folded.  Texts of any length are taken whole, one with more than ``BLOCK_BYTES`` bytes as a block of its own.
Repeated rows count each, and each can be drawn; ties go to the smaller id, then to the smaller weight.  A null id is hashed as an empty one and
comes before all others.  Empty tables are allowed on either side.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import shards
from quern.llm.common import small_batches, table, written

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
BLOCK_BYTES = 1 << 21
#: ASCII letters in lower case; other ASCII characters than letters and digits part words
_PARTED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def suffix_runs(words: np.ndarray, left: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length k up to ``most``: (k, the suffixes with k words or more, in order, and where a run of equal k-grams begins).

    ``words`` are ids; ``left`` is the number of words from a place to the end of its text, so that no run passes it.
    """
    n = len(words)
    shifted = [np.where(left > k, np.concatenate((words[k:], np.full(min(k, n), -1, words.dtype)))[:n], -1) for k in range(most)]
    order = np.lexsort(shifted[::-1]) if most > 1 else np.argsort(words)
    prefix = np.zeros(n, np.int64)  # words that a suffix shares with the one before it in order, up to ``most``
    same = np.ones(max(0, n - 1), bool)
    for column in shifted:
        ranked = column[order]
        same &= (ranked[1:] == ranked[:-1]) & (ranked[1:] >= 0)
        prefix[1:] += same
    for k in range(1, most + 1):
        long = left[order] >= k
        # between two suffixes of k words all have k words in common if they do, so dropping shorter ones joins no two runs
        yield k, order[long], np.flatnonzero(prefix[long] < k)


def blocks(texts: Iterator[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    block, size = [], 0
    for text in texts:
        block.append(text or b"")
        size += len(block[-1])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def bucket_ids(texts: list[bytes], most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of every text, grouped by length, not in order of place."""
    ids, names = shards.token_ids(b" \n ".join(t.translate(_PARTED) for t in texts))
    ends = names.index(b"\n") if len(texts) > 1 else -1
    ids = ids[ids != names.index(b"")] if b"" in names else ids
    over = np.flatnonzero(ids == ends)
    sizes = np.diff(np.concatenate(([-1], over, [len(ids)]))) - 1
    words = ids[ids != ends]
    text = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    owners, hashed = [], []
    for k, suffixes, starts in suffix_runs(words, left, most):
        grams = (b" ".join(names[w] for w in words[at : at + k]) for at in suffixes[starts])
        once = np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int64, len(starts))
        hashed.append(np.repeat(once, np.diff(np.append(starts, len(suffixes)))))
        owners.append(text[suffixes])
    return np.concatenate(owners), np.concatenate(hashed)


def bucket_counts(docs: DataFrame, *, text_col: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts; each task sends one row a bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for block in blocks(x.as_py() for x in b.column(0)):
                total += np.bincount(bucket_ids(block, most, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return small_batches(docs.select(F.col(text_col).cast("binary").alias("text"))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, spark: SparkSession, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of ln(target share / source share) of every bucket, each smoothed by one, floored."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    every = both.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t")))
    sums = every.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    # a row a bucket
    totals = F.broadcast(sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).withColumn("one", F.lit(1)))
    double = lambda c: F.col(c).cast("double")
    ratio = ((double("t") + 1) * (double("all_s") + buckets)) / ((double("s") + 1) * (double("all_t") + buckets))
    gains = sums.withColumn("one", F.lit(1)).join(totals, "one").select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))
    out = np.zeros(buckets, np.int64)
    for r in gains.collect():
        out[r.bucket] = r.gain
    return out


def weighed(docs: DataFrame, gains: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", most: int = 1) -> DataFrame:
    """(doc_id, n_features, weight): the floored mean gain of a text's features."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(gains)  # a number a bucket

    def run(batches):
        gain = held.value
        for b in batches:
            features, sums = [], []
            for block in blocks(x.as_py() for x in b.column(1)):
                text, hashed = bucket_ids(block, most, len(gain))
                features.append(np.bincount(text, minlength=len(block)))
                sums.append(np.bincount(text, weights=gain[hashed], minlength=len(block)).astype(np.int64))  # exact below 2^53
            n = np.concatenate(features) if features else np.empty(0, np.int64)
            weight = np.where(n > 0, (np.concatenate(sums) if sums else n) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_features", "weight"])

    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_features long, weight long"
    return small_batches(kept).mapInArrow(run, schema)


def drawn(weights: DataFrame, *, seed: int = SEED, least: int = LEAST_WORDS, percent: int = PERCENT, most: int = 1) -> DataFrame:
    """Adds ``score`` (the weight and Gumbel noise from a hash of the id) and ``rank`` among those drawn, else null.

    Drawn are the ``percent`` of texts with ``least`` words or more that score highest, which draws them without replacement in
    proportion to the exponentials of their weights.  Rows are sorted over all tasks and written; a rank is the place
    in a partition and the rows of the partitions before.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    # a text of w words has w + (w - 1) + ... features of up to ``most`` words
    enough = F.col("n_features") >= sum(max(0, least - k) for k in range(most))
    scored = weights.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), enough.alias("fit"))
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("weight")]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    fixed = written(placed, "drawn")
    part = F.shiftright("at", 33)
    counts = fixed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fits"))
    # a row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("before"), F.expr(f"sum(fits) over () * {percent} div 100").alias("drawn"))
    rank = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1
    rows = fixed.withColumn("part", part).join(F.broadcast(starts), "part")
    return rows.select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", most: int = 1, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``, drawn to resemble ``target``; features are runs of 1 to ``most`` words."""
    gains = bucket_gains(bucket_counts(docs, text_col=text_col, most=most, buckets=buckets), bucket_counts(target, text_col=target_text_col, most=most, buckets=buckets), docs.sparkSession, buckets)
    # a range sort reads its input twice
    return drawn(written(weighed(docs, gains, id_col=id_col, text_col=text_col, most=most), "weights"), seed=seed, least=least, percent=percent, most=most)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc32_steps() -> list[int]:
    """The CRC-32 of every byte alone, from the polynomial (fixed value)."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def oracle() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    digits = "list_transform(range(0, octet_length(encode(w))), lambda i: (strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * i + 2, 1)) - 1)"
    return f"""
WITH steps AS MATERIALIZED (SELECT {_crc32_steps()}::BIGINT[] AS t),
d AS MATERIALIZED (SELECT doc_id, {words} AS ws FROM documents),
sw AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w FROM d),
tw AS MATERIALIZED (SELECT unnest({words}) AS w FROM benchmark),
hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT w FROM (SELECT w FROM sw UNION ALL SELECT w FROM tw)), steps),
s AS (SELECT bucket, count(*) AS s FROM sw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM sw) + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM tw) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (
  SELECT doc_id, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM sw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS fit FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= fit * {PERCENT} // 100 THEN place END AS rank
FROM placed"""
