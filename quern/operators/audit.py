"""Data audit: scorecards, arm summaries, balance, duplicates, the hash split, id density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import is_finite, safe_ratio
from quern.plans.experiment import FEATURES, FLAGS, any_of

SPLIT_SEED = "quern-v1"


def quality_checks(view: DataFrame, features: list[str] = FEATURES, flags: list[str] = FLAGS) -> DataFrame:
    """Rows and five counters that must be 0, in one scan."""
    return view.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_of([F.col(c).isNull() for c in [*features, *flags]])).alias("missing_rows"),
        F.count_if(any_of([~F.col(c).isin(0, 1) for c in flags])).alias("invalid_binary_rows"),
        F.count_if(any_of([~is_finite(F.col(c)) for c in features])).alias("nonfinite_feature_rows"),
        F.count_if((F.col("conversion") == 1) & (F.col("visit") == 0)).alias("conversion_without_visit"),
        F.count_if((F.col("treatment") == 0) & (F.col("exposure") == 1)).alias("exposed_controls"),
    )


def input_checks(view: DataFrame, flags: list[str] = FLAGS) -> DataFrame:
    """The counters of the experiment stage: nulls in, and domains of, each flag, and implications."""
    return view.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_of([F.col(c).isNull() for c in flags])).alias("missing_rows"),
        *[F.count_if(~F.col(c).isin(0, 1)).alias(f"invalid_{c}") for c in flags],
        F.count_if((F.col("conversion") == 1) & (F.col("visit") == 0)).alias("conversion_without_visit"),
        F.count_if((F.col("treatment") == 0) & (F.col("exposure") == 1)).alias("exposed_controls"),
    )


def arm_summary(view: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per arm (or other keys): rows, positives, exposed, and their rates."""
    total = F.count(F.lit(1))
    sums = {n: F.sum(F.col(c).cast("long")) for n, c in (("visit_positive", "visit"), ("conversion_positive", "conversion"), ("exposed", "exposure"))}
    return view.groupBy(*(keys or ["treatment"])).agg(
        total.alias("rows"),
        *[s.alias(n) for n, s in sums.items()],
        *[safe_ratio(s, total).alias(r) for r, s in zip(("visit_rate", "conversion_rate", "exposure_rate"), sums.values())],
    )


def feature_balance(view: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Standardised mean differences of the features between arms: one aggregate, then one row per feature."""
    arm = lambda f, t: F.when(F.col("treatment") == t, F.col(f))
    wide = view.agg(*[g(arm(f, t)).alias(f"{f}_{n}{t}") for f in features for t in (0, 1) for n, g in (("m", F.avg), ("v", F.var_samp))])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}_{x}").alias(x) for x in ("m0", "m1", "v0", "v1")]) for f in features]))
    smd = safe_ratio(F.col("m1") - F.col("m0"), F.sqrt((F.col("v0") + F.col("v1")) / 2))
    return wide.select(rows.alias("r")).select("r.*").select(
        "feature", F.col("m0").alias("control_mean"), F.col("m1").alias("treatment_mean"), smd.alias("smd"), F.abs(smd).alias("absolute_smd")
    )


def duplicate_summary(view: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of identical records: their number, their rows, and the rows beyond the first of each."""
    groups = view.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(F.count(F.lit(1)).alias("groups"), total(F.col("n")).alias("rows_in_groups"), total(F.col("n") - 1).alias("extra_identical_records"))


def split_bucket(features: list[str] = FEATURES, seed: str = SPLIT_SEED) -> Column:
    """0 to 99: the last 8 bytes of the features' MD5 as a little-endian number, modulo 100.

    Features are rendered as integers, so that every engine hashes the same text.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(f).cast("long").cast("string") for f in features]))
    reversed_bytes = F.concat(*[F.substring(digest, 31 - 2 * i, 2) for i in range(8)])
    return (F.conv(reversed_bytes, 16, 10).cast("decimal(20,0)") % 100).cast("int")


def partition_of(bucket: Column) -> Column:
    return F.when(bucket < 60, "train").when(bucket < 80, "validation").otherwise("test")


def with_partition(view: DataFrame, features: list[str] = FEATURES, seed: str = SPLIT_SEED) -> DataFrame:
    return view.withColumn("data_partition", partition_of(split_bucket(features, seed)))


def split_mismatches(view: DataFrame, features: list[str] = FEATURES, seed: str = SPLIT_SEED) -> DataFrame:
    """Rows whose stored partition isn't that of the rule."""
    rule = partition_of(split_bucket(features, seed))
    return view.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("data_partition").eqNullSafe(rule)).alias("mismatches"))


def partition_summary(view: DataFrame) -> DataFrame:
    return view.groupBy("data_partition", "treatment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("visit").cast("long")).alias("visit_positive"), F.sum(F.col("conversion").cast("long")).alias("conversion_positive")
    )


def id_density(view: DataFrame, id_col: str = "source_row_id") -> DataFrame:
    """Whether ids are 0 to n - 1, each once."""
    n = F.count(F.lit(1))
    found = view.agg(n.alias("rows"), F.count_distinct(id_col).alias("distinct_ids"), F.min(id_col).alias("least_id"), F.max(id_col).alias("greatest_id"))
    dense = (F.col("rows") == F.col("distinct_ids")) & (F.col("least_id") == 0) & (F.col("greatest_id") == F.col("rows") - 1)
    return found.withColumn("dense", dense)


def systematic_sample(view: DataFrame, fraction: float, id_col: str = "source_row_id") -> DataFrame:
    """The rows whose id modulo 10,000 is below the fraction's share; the same rows every time."""
    return view.where(F.col(id_col) % 10_000 < max(1, round(fraction * 10_000)))


def check_model_columns(columns: list[str], features: list[str] = FEATURES, treatment_allowed: bool = False) -> None:
    """Raises unless a model's inputs are exactly the features (and, for one learner, the arm)."""
    allowed = {*features, *(["treatment"] if treatment_allowed else [])}
    if set(columns) != allowed or len(columns) != len(set(columns)):
        raise ValueError(f"model inputs must be {sorted(allowed)}; extra: {sorted(set(columns) - allowed)}, missing: {sorted(allowed - set(columns))}")


def key_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, duplicates of keys, and whether the key sets are equal and unique."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("na"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("nb"))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("nb").isNull()).alias("left_only"),
        F.count_if(F.col("na").isNull()).alias("right_only"),
        F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("repeated"),
    ).withColumn("equal", (F.col("left_only") + F.col("right_only") + F.col("repeated")) == 0)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An equi-join that fails on a key that isn't on both sides exactly once."""
    n = lambda df, name: df.withColumn(name, F.count(F.lit(1)).over(_by(key)))
    joined = n(left, "_l").join(n(right, "_r"), key, "full")
    bad = F.col("_l").isNull() | F.col("_r").isNull() | (F.col("_l") > 1) | (F.col("_r") > 1)
    checked = F.when(bad, F.raise_error(F.lit("keys aren't one to one"))).otherwise(F.col(key))
    return joined.withColumn(key, checked).drop("_l", "_r")


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def cross_outcome_alignment(a: DataFrame, b: DataFrame, key: str = "source_row_id", arm: str = "treatment") -> DataFrame:
    """How the rows of two outcomes differ: ids that only one has, repeated ids, and ids whose arms differ."""
    one = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(f"n{n}"), F.min(arm).alias(f"lo{n}"), F.max(arm).alias(f"hi{n}"))
    both = one(a, 0).join(one(b, 1), key, "full")
    found = both.agg(
        F.count_if(F.col("n1").isNull()).alias("left_only"), F.count_if(F.col("n0").isNull()).alias("right_only"), F.count_if((F.col("n0") > 1) | (F.col("n1") > 1)).alias("repeated"),
        F.count_if((F.col("lo0") != F.col("lo1")) | (F.col("hi0") != F.col("hi1"))).alias("arms_differ"),
    )
    bad = F.col("left_only") + F.col("right_only") + F.col("repeated") + F.col("arms_differ")
    return found.withColumn("aligned", bad == 0)


def frame_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_only, right_only, equal): rows, counted with repetitions, that one of two frames has more of.

    Nulls and NaN equal themselves; columns are compared by name and may stand in any order, but must be the same.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the frames have different columns")
    names = [F.col(f"`{c}`") for c in sorted(a.columns)]
    rows = a.select(F.struct(*names).alias("r"), F.lit(1).alias("n")).unionAll(b.select(F.struct(*names).alias("r"), F.lit(-1).alias("n")))
    net = rows.groupBy("r").agg(F.sum("n").alias("n"))
    found = net.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("left_only"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("right_only"))
    return found.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))
