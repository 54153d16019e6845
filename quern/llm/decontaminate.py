"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern of token positions that count and positions that are ignored.  The words
under each mask at each place are hashed, in benchmark items and in documents, and the hashes are
joined.  A hit fixes how item and document lie against each other; around it, aligned words are
compared, and an overlap is a stretch of ``WINDOW`` words of the item (or the whole of a shorter
one) of which at least ``SHARE`` are equal.  So neither seeds nor overlaps need every word equal.

The masks of a width are chosen so that every pattern of as many other words as the share allows leaves all
words under some mask at some place (``masks_for``): each overlap is found, not only likely ones.
Items of fewer than ``WHOLE_BELOW`` words are found by one hash of all their words: within texts if they
have ``LEAST_WORDS`` or more, and only as a whole text if they have fewer, which many clean texts have.

Only DataFrame functions are used.  The seeds of the benchmark are broadcast only if they are at most
``BROADCAST_SEEDS``; otherwise both sides are shuffled by hash and a turn, so that documents that share a
seed are in ``TURNS`` tasks; the benchmark's side, the smaller one, is repeated for each turn.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from itertools import combinations, groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table, written

WINDOW = 13
SHARE = 0.8
WEIGHT = 6
WIDEST = 14
BROADCAST_SEEDS = 1_000_000
TURNS = 16
WHOLE_BELOW = 10
LEAST_WORDS = 4

_BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def least_equal(width: int, share: float) -> int:
    """The least number of equal words of an overlap of ``width`` words."""
    return math.ceil(width * share - 1e-9)


@lru_cache
def masks_for(width: int, wrong: int, weight: int = WEIGHT) -> tuple[str, ...]:
    """Masks such that any ``wrong`` other words among ``width`` leave one of them whole at some place, by span.

    Chosen greedily among all masks of ``weight`` positions.  Of a width above ``WIDEST``, one half has at most
    half of the other words, so masks of half the width do.
    """
    while width > WIDEST:
        width, wrong = width // 2, wrong // 2
    weight = min(weight, width - wrong)
    if weight == 1:
        return ("1",)
    patterns = [sum(1 << i for i in gone) for gone in combinations(range(width), wrong)]
    meets = {}
    for span in range(weight, width + 1):
        for inner in combinations(range(1, span - 1), weight - 2):
            cares = {0, *inner, span - 1}
            bits = sum(1 << i for i in cares)
            met = {n for n, gone in enumerate(patterns) if any(not (bits << at) & gone for at in range(width - span + 1))}
            meets["".join("01"[i in cares] for i in range(span))] = met
    left, chosen = set(range(len(patterns))), []
    while left:
        chosen.append(max(meets, key=lambda m: len(meets[m] & left)))
        left -= meets[chosen[-1]]
    return tuple(sorted(chosen, key=lambda m: (len(m), m)))


def _parts(mask: str) -> list[tuple[str, int]]:
    """The positions that count, as hashed neighbours (``p``) where two are next to each other, else as words (``h``)."""
    parts, i = [], 0
    while i < len(mask):
        pair = mask[i : i + 2] == "11"
        if mask[i] == "1":
            parts.append(("p" if pair else "h", i))
        i += 2 if pair else 1
    return parts


def _under(mask: str, places: Column) -> Column:
    """The hashes under a mask at the first ``places`` words."""
    return F.transform(F.sequence(F.lit(1), places), lambda i: F.xxhash64(*[F.element_at(c, i + k) for c, k in _parts(mask)]))


def _seeds(rows: DataFrame, keys: list[str], masks: set[str]) -> list[DataFrame]:
    """(keys, seed, at): the hash under each mask at each word position ``at`` of ``h``, a frame for each span.

    Masks share the hashes of neighbouring words, which are made once; seeds of different masks that
    happen to be equal are candidates like any others.
    """
    out = []
    pairs = F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1)))
    for span, group in groupby(sorted(masks, key=lambda m: (len(m), m)), key=len):
        places = F.size("h") - F.lit(span - 1)
        under = [_under(mask, places) for mask in group]
        enough = rows.where(places > 0).withColumn("places", places).withColumn("p", pairs)
        exploded = enough.select(*keys, "places", F.posexplode(F.concat(*under)).alias("at", "seed"))
        out.append(exploded.select(*keys, "seed", (F.col("at") % F.col("places")).cast("int").alias("at")))
    return out


def _whole_seeds(rows: DataFrame, keys: list[str], words: int) -> DataFrame:
    """(keys, seed, at): the hash of all of ``words`` words at each position of ``h``; below ``LEAST_WORDS`` only if there are no more words."""
    last = F.size("h") - F.lit(words - 1)
    seeds = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.lit(words), *[F.element_at("h", i + k) for k in range(words)]))
    wanted = last > 0 if words >= LEAST_WORDS else last == 1
    return rows.where(wanted).select(*keys, F.posexplode(seeds).alias("at", "seed")).select(*keys, "seed", "at")


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    share: float = SHARE,
) -> DataFrame:
    """(doc_id, text_hash, item_id, start, equal_words, item_words) of every document and item that overlap.

    ``start`` is the word of the document at which the item would begin (below 0 if its beginning is
    missing), ``equal_words`` the number of equal aligned words; of several places of an item that
    with most equal words, then the first, is given.  Two rows of equal id and text are one document.

    Items of ``LEAST_WORDS`` to ``WHOLE_BELOW`` - 1 words overlap where all their words stand; shorter ones overlap
    documents that have their words and no others.

    Cases: null and empty texts and items, and those without a letter or digit, never overlap; null ids are kept as
    null; very long texts are compared whole; repeated items count once; other columns are ignored; empty tables give no rows.
    """
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    items = (
        benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
        .select("item_id", hashes.alias("item"))
        .where(F.size("item") > 0)
        .distinct()
    )
    items = written(items, "benchmark-words")
    # items of a window or more have the window's masks, shorter ones those of their length, the shortest none
    whole = F.size("item") < WHOLE_BELOW
    width = F.when(whole, F.size("item")).otherwise(F.least(F.size("item"), F.lit(window)))
    widths = sorted(tuple(r) for r in items.select(whole, width).distinct().collect())  # at most a window's, and those of short items
    masks = {n: set(masks_for(n, n - least_equal(n, share))) for short, n in widths if not short}
    wholes = [n for short, n in widths if short]
    own = items.select("item_id", F.col("item").alias("h"), whole.alias("whole"), width.alias("width"))
    item_seeds = [x for n in masks for x in _seeds(own.where(~F.col("whole") & (F.col("width") == n)), ["item_id"], masks[n])]
    item_seeds += [_whole_seeds(own.where(F.col("whole") & (F.col("width") == n)), ["item_id"], n) for n in wholes]
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    hashed = hashed.select("doc_id", "text_hash", hashes.alias("h"))
    doc_keys = ["doc_id", "text_hash"]
    doc_seeds = _seeds(hashed, doc_keys, set().union(*masks.values()))
    doc_seeds += [_whole_seeds(hashed, doc_keys, n) for n in wholes]
    if not widths:  # an empty benchmark
        item_seeds, doc_seeds = [_whole_seeds(own, ["item_id"], 1)], [_whole_seeds(hashed, doc_keys, 1)]
    most = max((len(m) for m in masks.values()), default=1)
    seeds = items.agg(F.coalesce(F.sum(F.size("item") * most), F.lit(0))).first()[0]
    small = seeds <= BROADCAST_SEEDS
    bounded = F.broadcast if small else (lambda x: x)

    item_seeds = reduce(DataFrame.unionByName, item_seeds).withColumnRenamed("at", "item_at").distinct()
    doc_seeds = reduce(DataFrame.unionByName, doc_seeds)
    if small:
        met = doc_seeds.join(F.broadcast(item_seeds), "seed")
    else:
        dealt = doc_seeds.withColumn("turn", F.pmod(F.xxhash64(*doc_keys, "at"), F.lit(TURNS)).cast("int"))
        met = dealt.join(item_seeds.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1)))), ["seed", "turn"])
    hits = met.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct()
    hits = written(hits, "seed-hits")

    aligned = (
        hashed.join(hits, hashed["doc_id"].eqNullSafe(hits["doc_id"]) & (hashed["text_hash"] == hits["text_hash"]))
        .select(hits["doc_id"], hits["text_hash"], hits["item_id"].alias("hit_item"), "start", "h")
        .join(bounded(items), F.col("hit_item").eqNullSafe(F.col("item_id")))
    )
    equal = F.transform(
        "item", lambda w, i: F.when(F.get("h", F.col("start") + i) == w, 1).otherwise(0)
    )
    enough = F.when(whole, F.size("item")).otherwise(F.ceil(width * F.lit(share) - F.lit(1e-9)))
    counted = aligned.select(
        "doc_id", "text_hash", "item_id", "start", F.size("item").alias("item_words"), equal.alias("equal"), width.alias("width"), enough.alias("enough")
    )
    verified = counted.where(
        F.exists(
            F.sequence(F.lit(1), F.col("item_words") - F.col("width") + 1),
            lambda s: F.aggregate(F.slice("equal", s, F.col("width")), F.lit(0), lambda a, x: a + x) >= F.col("enough"),
        )
    )
    best = F.struct(
        F.aggregate("equal", F.lit(0), lambda a, x: a + x).alias("equal_words"), (-F.col("start")).alias("minus"), "item_words"
    )
    return (
        verified.groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max(best).alias("b"))
        .select("doc_id", "text_hash", "item_id", (-F.col("b.minus")).alias("start"), "b.equal_words", "b.item_words")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap no item of ``benchmark``."""
    leaks = written(overlaps(docs, benchmark, id_col=id_col, text_col=text_col).select("doc_id", "text_hash").distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("d"), F.col(id_col).alias("own_id"), F.xxhash64(F.col(text_col)).alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    return rows.join(leaks, same, "left_anti").select("d.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "equal_words", "item_words")


def oracle() -> str:
    """DuckDB SQL for ``op7_decontaminate``, without masks.

    With at most two other words, a stretch of 12 or 13 words has 4 equal ones in a row, one of 10 or 11 words has 3, so
    runs of words give candidates for every overlap.
    """
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '" + _BETWEEN + "'), lambda w: w <> '')"

    def runs(source: str, keys: str, kind: str, n: int, wanted: str) -> str:
        cares = ", ".join(f"w[i + {c}]" for c in range(n))
        return f"SELECT {keys}, i AS at, concat_ws(' ', '{kind} {n}', {cares}) AS seed FROM (SELECT {keys}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {source} WHERE {wanted})"

    def seeds(source: str, keys: str) -> str:
        item = source == "b"
        parts = [runs(source, keys, 'part', n, (f"len(w) BETWEEN {low} AND {high}" if item else f"len(w) >= {n} AND EXISTS (SELECT 1 FROM b WHERE len(b.w) BETWEEN {low} AND {high})")) for n, low, high in ((4, 12, 1_000_000_000), (3, WHOLE_BELOW, 11))]
        for n in range(1, WHOLE_BELOW):
            wanted = f"len(w) = {n}" if item or n < LEAST_WORDS else f"len(w) >= {n} AND EXISTS (SELECT 1 FROM b WHERE len(b.w) = {n})"
            parts.append(runs(source, keys, 'whole', n, wanted))
        return " UNION ALL ".join(parts)

    return f"""
WITH d AS (SELECT DISTINCT doc_id, text, {words} AS w FROM documents),
b AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
ds AS ({seeds('d', 'doc_id, text')}),
bs AS ({seeds('b', 'item_id')}),
hits AS (SELECT DISTINCT doc_id, text, item_id, ds.at - bs.at AS start FROM ds JOIN bs USING (seed)),
eq AS (
  SELECT h.doc_id, h.text, h.item_id, h.start, len(b.w) AS n, least(len(b.w), {WINDOW}) AS width,
    list_transform(range(1, len(b.w) + 1), lambda i: CASE WHEN h.start + i >= 1 AND d.w[h.start + i] = b.w[i] THEN 1 ELSE 0 END) AS e
  FROM hits h JOIN d ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.text = h.text JOIN b ON b.item_id IS NOT DISTINCT FROM h.item_id),
ok AS (
  SELECT *, list_sum(e) AS total FROM eq
  WHERE len(list_filter(range(1, n - width + 2), lambda s: list_sum(e[s : s + width - 1]) >= CASE WHEN n < {WHOLE_BELOW} THEN n ELSE ceil(width * {SHARE} - 1e-9) END)) > 0)
SELECT doc_id, item_id,
  CAST(start AS INTEGER) AS start, CAST(total AS INTEGER) AS equal_words, CAST(n AS INTEGER) AS item_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY total DESC, start) AS rn FROM ok) WHERE rn = 1"""
