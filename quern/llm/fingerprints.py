"""Document fingerprints by consistent weighted sampling.

A text's terms are its word 5-grams, weighted by how often they occur.  For each term, r and c follow
Gamma(2, 1) and b is uniform, all drawn from the term's hash.  A term of weight S has

    t = floor(ln S / r + b),    ln a = ln c - r (t - b + 1)

and the term of least ``a`` is the sample: it is the same in two texts with a probability that equals
their generalised Jaccard similarity (sum of lesser over sum of greater weights).  As ``a`` fixes the
term and its t, equal samples are equal numbers.  There are ``SLOTS`` strata, each with a sample of its
own.  Each occurrence of a term is dealt to a stratum by a hash of the term and of how often it came before, and a
term's weight in a stratum is the number of its occurrences there.  So of two texts, the one with more occurrences of
a term has all of the other's, a stratum holds a random part of the occurrences that either text has, and its
collision rate is, on average, that of the whole: the share of equal samples among strata that either text
fills estimates the similarity without bias.  Occurrences of a term after its first ``DEALT`` come to the strata in
turn, where chance hardly matters by then.

Only DataFrame functions are used.  Texts are shuffled once, to be next to their successor, and all
that follows happens where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import table, written

SLOTS = 128
GRAM = 5
DEALT = 1024
ROWS_PER_BUCKET = 500
ROWS_PER_PARTITION = 2000
CUTS = 4096
ROWS_PER_RANGE = 20_000
MOST_HEADS = 1_000_000


def terms(text: Column) -> Column:
    """Hashes of the word 5-grams; of the whole word sequence if it is shorter, and none without words."""
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    words = F.array_remove(F.split(F.lower(text), " "), "")

    def grams(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, GRAM)]))  # nulls hash to nothing
        return F.slice(hashes, 1, F.greatest(F.size(w) - (GRAM - 1), F.lit(1)))

    # the words are bound once, as the only element of an array that is mapped over
    return F.flatten(F.transform(F.array(words), grams))


def _uniform(bits: Column, shift: int) -> Column:
    """In (0, 1), from 30 bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 30) - 1)).cast("double") + F.lit(0.5)) * F.lit(2.0**-30)


def sample(term: Column, weights: dict[str, Column]) -> dict[str, Column]:
    """ln a of a term for each weight; null for a weight of 0.  ``term`` must be a plain column."""
    x, y, z = (F.xxhash64(term, F.lit(k)) for k in (1, 2, 3))
    r = -F.ln(_uniform(x, 0) * _uniform(x, 30))
    ln_c = F.ln(-F.ln(_uniform(y, 0) * _uniform(y, 30)))
    b = _uniform(z, 0)
    drawn = F.struct(r.alias("r"), ln_c.alias("ln_c"), b.alias("b"))
    return {
        "draw": drawn,
        **{name: F.when(w > 0, F.col("draw.ln_c") - F.col("draw.r") * (F.floor(F.ln(w) / F.col("draw.r") + F.col("draw.b")) - F.col("draw.b") + 1)) for name, w in weights.items()},
    }


def slots(grouped: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows of (keys, slot, names: least ln a) to one row per keys, with a sorted list of slot * 2^16 + digest for each name."""
    digest = lambda v: F.shiftleft(F.col("slot"), 16) + F.pmod(F.xxhash64(v), F.lit(1 << 16)).cast("int")
    packed = grouped.select(*keys, *[F.when(F.col(n).isNotNull(), digest(n)).alias(n) for n in names])
    return packed.groupBy(*keys).agg(*[F.sort_array(F.collect_list(n)).alias(n) for n in names])


def as_text(samples: Column) -> Column:
    """Six hexadecimal digits per filled slot."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples among the slots that either list fills; 1 if both are empty."""
    filled = lambda x: F.transform(x, lambda v: F.shiftright(v, 16))
    either = F.size(F.array_union(filled(a), filled(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def _stratum(term: Column, k: Column) -> Column:
    """The stratum of a term's occurrence ``k``, from 0."""
    return F.pmod(F.xxhash64(term, F.lit(4), k), F.lit(SLOTS)).cast("int")


def fingerprint(docs: DataFrame, text_cols: dict[str, str], keys: list[str]) -> DataFrame:
    """One row per ``keys`` (which must tell rows apart) with the samples of each text column (see ``slots``).

    ``text_cols`` maps names to text columns.  If ``docs`` is already dealt by some of the keys,
    nothing is shuffled.
    """
    names = list(text_cols)
    if len(names) > 2:
        raise ValueError("at most two texts a row")

    def tag(column: str, i: int) -> Column:
        return F.transform(terms(F.coalesce(F.col(column), F.lit(""))), lambda t: F.shiftleft(t, 1).bitwiseOR(F.lit(i)))

    tagged = F.concat(*[tag(c, i) for i, c in enumerate(text_cols.values())])
    exploded = docs.select(*keys, F.explode_outer(tagged).alias("tagged"))
    counted = exploded.groupBy(*keys, F.shiftrightunsigned("tagged", 1).alias("term")).agg(
        *[F.count_if(F.col("tagged").bitwiseAND(F.lit(1)) == i).alias(f"w_{n}") for i, n in enumerate(names)]
    )
    # occurrence k falls to a stratum hashed from term and k; each term has a draw of its own in each stratum
    weights = [f"w_{n}" for n in names]
    most = F.greatest(F.lit(1), *[F.col(w) for w in weights])
    first = _stratum(F.col("term"), F.lit(0))
    dealt_to = F.transform(F.sequence(F.lit(0), F.least(most, F.lit(DEALT)).cast("int") - 1), lambda k: _stratum(F.col("term"), k))
    many = counted.select("*", F.when(most > 1, dealt_to).alias("dealt_to"), (most > DEALT).alias("all_slots"))
    present = F.when(F.col("all_slots"), F.sequence(F.lit(0), F.lit(SLOTS - 1))).otherwise(F.array_distinct("dealt_to"))
    dealt = many.select(*keys, "term", *weights, "dealt_to", F.explode(F.when(F.col("dealt_to").isNull(), F.array(first)).otherwise(present)).alias("slot"))
    in_turn = F.pmod(F.col("slot") - F.xxhash64("term", F.lit(6)), F.lit(SLOTS))

    def here(w: str) -> Column:
        early = F.size(F.filter(F.slice("dealt_to", 1, F.least(F.col(w), F.lit(DEALT)).cast("int")), lambda x: x == F.col("slot")))
        late = F.greatest(F.lit(0), F.floor((F.col(w) - DEALT - in_turn + (SLOTS - 1)) / SLOTS))
        return F.when(F.col("dealt_to").isNull(), F.col(w)).when(F.col(w) <= DEALT, early).otherwise(early + late)

    dealt = dealt.select(
        *keys, F.when(F.col("slot") == first, F.col("term")).otherwise(F.xxhash64("term", F.lit(5), "slot")).alias("term"), "slot", *[here(w).alias(w) for w in weights]
    )
    columns = sample(F.col("term"), {n: F.col(f"w_{n}") for n in names})
    drawn = dealt.select("*", columns["draw"].alias("draw"))
    least = drawn.select(*keys, "slot", *[columns[n].alias(n) for n in names]).groupBy(*keys, F.coalesce("slot", F.lit(-1)).alias("slot")).agg(*[F.min(n).alias(n) for n in names])
    return slots(least, keys, names)


def _bucketed(own: DataFrame) -> DataFrame:
    """``own`` with ``order``, a hash by which rows of equal ids are ordered, and ``bucket``, which rises with (doc_id, order).

    Buckets are ranges of ids between at most ``CUTS`` quantiles, each cut into even ranges if it would have more than
    ``ROWS_PER_RANGE`` rows.  An id that is several quantiles has as many buckets, ranges of the hash.
    Rows with a null id come first, in ranges of their hash.
    """
    own = own.withColumn("order", F.shiftrightunsigned(F.xxhash64("text"), 1))
    n, nulls, low, high = own.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    count = max(1, min(CUTS, n // ROWS_PER_BUCKET))
    cuts: list[int] = []
    if count > 1 and low is not None:
        cuts = sorted(own.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 20_000)).first()[0])
    ranges = max(1, -(-n // (ROWS_PER_RANGE * (len(cuts) + 1))))
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    at = F.size(F.filter(bounds, lambda x: x < F.col("doc_id")))
    bucket = at.cast("long")
    part = F.col("order") / F.lit(2.0**63)
    if ranges > 1:
        lo = F.coalesce(F.get(bounds, at - 1), F.lit(low - 1)).cast("double")
        hi = F.coalesce(F.get(bounds, at), F.lit(high)).cast("double")
        share = (F.col("doc_id").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0))
        bucket = bucket * ranges + F.least(F.floor(share * ranges), F.lit(ranges - 1))
    if len(set(cuts)) < len(cuts):  # an id has the last of its first quantile's ranges, and all of its other quantiles'
        times = F.size(F.filter(bounds, lambda x: x == F.col("doc_id")))
        more = (times - 1) * ranges + 1
        bucket = F.when(times > 1, at * ranges + (ranges - 1) + F.least(F.floor(part * more), more - 1)).otherwise(bucket)
    first = -max(1, -(-nulls // ROWS_PER_RANGE))
    no_id = F.floor(part * -first) + F.lit(first)
    return own.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.least(no_id, F.lit(-1))).otherwise(bucket).cast("long"))


def with_next(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Every row's id and text with the text of the row that follows in order of the id (after the last, the first).

    Adds ``bucket`` and ``place``, which tell rows apart and by which rows are dealt, and the same of the
    next row.  Only one row of each bucket is sent to its neighbour apart from the one shuffle.
    """
    spark = docs.sparkSession
    own = _bucketed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))

    # the first row of each bucket, for the last row of the bucket before it; ids and counts only, a row a bucket
    head = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "order"))
    heads = own.groupBy("bucket").agg(head.alias("h"), F.count(F.lit(1)).alias("n")).select("bucket", F.col("h.doc_id").alias("first_id"), F.col("h.order").alias("first_order"), "n")
    in_order = Window.orderBy("bucket")
    heads = heads.select("*", F.coalesce(F.lag("bucket").over(in_order), F.max("bucket").over(Window.partitionBy())).alias("before"))
    heads = written(heads.withColumnRenamed("bucket", "head_bucket"), "bucket-heads")
    many, n = heads.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bounded = F.broadcast if many <= MOST_HEADS else (lambda x: x.hint("merge"))
    is_head = (F.col("bucket") == F.col("head_bucket")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("order") == F.col("first_order"))
    firsts = (
        own.join(bounded(heads.drop("n")), is_head)
        .groupBy("before", "head_bucket")
        .agg(F.first("text").alias("head_text"))
        .select(F.col("before").alias("bucket"), "head_bucket", "head_text")
    )
    firsts = written(firsts, "bucket-firsts")

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // ROWS_PER_PARTITION)
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "order")
    lined = own.repartition(parts, "bucket").select(
        "*", F.row_number().over(inside).alias("place"), F.lead("text").over(inside).alias("lead_text")
    )
    last = F.col("lead_text").isNull()
    return lined.join(firsts.hint("merge"), "bucket").select(
        "bucket",
        "place",
        "doc_id",
        "text",
        F.when(last, F.col("head_text")).otherwise(F.col("lead_text")).alias("next_text"),
        F.when(last, F.col("head_bucket")).otherwise(F.col("bucket")).alias("next_bucket"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"),
    )


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next text's beginning, and their likeness.

    The edit replaces the last half of the text by as much of the beginning of the next one.

    Cases: a null text is empty; empty and blank texts have the empty fingerprint, and are alike;
    rows of equal ids are ordered by a hash of their text, rows with a null id come first; a single row
    is its own successor; texts of any length are taken whole; other columns are ignored; an empty input gives no rows.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs, id_col=id_col, text_col=text_col).select("bucket", "place", "doc_id", "next_bucket", "next_place", "text", edited.alias("edited"))
    keys = ["bucket", "place", "doc_id", "next_bucket", "next_place", "n_chars", "edited_sha256"]
    rows = rows.select("*", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    found = written(fingerprint(rows, {"fingerprint": "text", "edited_fingerprint": "edited"}, keys), "fingerprints")
    other = found.select(F.col("bucket").alias("next_bucket"), F.col("place").alias("next_place"), F.col("fingerprint").alias("next_fingerprint"))
    return found.join(other, ["next_bucket", "next_place"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
