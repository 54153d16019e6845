"""Score groups, cumulative gain, AUUC and Qini, calibration, and the row-level recomputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import Z_95, safe_ratio
from quern.operators.effects import difference_in_rates
from quern.operators.ranking import bucket

REPORT_PERCENTS = [5, 10, 20, 30, 40, 50, 75, 100]
MAIN_PERCENTS = [10, 20, 30]


def cells(rows: DataFrame, groups: int, weight: str | None = None) -> DataFrame:
    """(model_name, bucket, n0, n1, y0, y1, group_rows, score_sum): the sufficient statistics of every score group."""
    w = F.col(weight) if weight else F.lit(1)
    some = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    t1, y1 = F.col("treatment") == 1, F.col("outcome") == 1
    return rows.groupBy("model_name", bucket(groups).alias("bucket")).agg(
        some(~t1).alias("n0"), some(t1).alias("n1"), some(~t1 & y1).alias("y0"), some(t1 & y1).alias("y1"), F.sum(w).alias("group_rows"), F.sum(F.col("score").cast("double") * w).alias("score_sum")
    )


def group_effects(rows: DataFrame, groups: int = 10, z: float = Z_95) -> DataFrame:
    """One row per model and score group; group 1 has the highest scores."""
    found = difference_in_rates(cells(rows, groups), z)
    return found.select(
        "model_name",
        (F.col("bucket") + 1).alias("score_group"),
        (F.col("bucket") * F.lit(100.0) / groups).alias("population_start_pct"),
        ((F.col("bucket") + 1) * F.lit(100.0) / groups).alias("population_end_pct"),
        "group_rows",
        F.col("n1").alias("treatment_rows"),
        F.col("n0").alias("control_rows"),
        F.col("p1").alias("treatment_rate"),
        F.col("p0").alias("control_rate"),
        F.col("uplift").alias("observed_uplift"),
        (F.col("score_sum") / F.col("group_rows")).alias("mean_predicted_score"),
        (F.col("group_rows") * F.col("uplift")).alias("incremental_outcomes"),
        "uplift_ci_lower",
        "uplift_ci_upper",
    )


def curve_from_cells(found: DataFrame, groups: int, z: float = Z_95, by: list[str] | None = None) -> DataFrame:
    """The cumulative curve; every window covers the ``groups`` rows of one model."""
    keys = by or ["model_name"]
    so_far = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(c).over(so_far).alias(c) for c in ("n0", "n1", "y0", "y1")]
    total = F.sum(F.col("n0") + F.col("n1")).over(Window.partitionBy(*keys)).alias("total")
    curve = difference_in_rates(found.select(*keys, "bucket", *sums, total), z)
    rows = F.col("n0") + F.col("n1")
    return curve.select(
        *keys,
        ((F.col("bucket") + 1) / F.lit(groups).cast("double")).alias("target_fraction"),
        (rows / F.col("total")).alias("selected_population_fraction"),
        rows.alias("selected_rows"),
        F.col("n1").alias("treatment_rows"),
        F.col("n0").alias("control_rows"),
        F.col("p1").alias("treatment_rate"),
        F.col("p0").alias("control_rate"),
        F.col("uplift").alias("cumulative_uplift"),
        (rows * F.col("uplift")).alias("cumulative_gain"),
        "uplift_ci_lower",
        "uplift_ci_upper",
    )


def cumulative_gain(rows: DataFrame, groups: int = 20, z: float = Z_95) -> DataFrame:
    """The curve of every model, with the line of a random ranking."""
    curve = curve_from_cells(cells(rows, groups), groups, z)
    endpoint = F.max_by("cumulative_gain", "target_fraction").over(Window.partitionBy("model_name"))
    with_end = curve.withColumn("endpoint_gain", endpoint).withColumn("random_gain", F.col("target_fraction") * F.col("endpoint_gain"))
    return with_end.withColumn("gain_above_random", F.col("cumulative_gain") - F.col("random_gain"))


def curve_metrics(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUUC (trapezoids from the origin), Qini and endpoint per model."""
    keys = by or ["model_name"]
    order = Window.partitionBy(*keys).orderBy("target_fraction")
    lag = lambda c: F.coalesce(F.lag(c).over(order), F.lit(0.0))
    areas = curve.select(
        *keys, "target_fraction", "cumulative_gain", ((F.col("cumulative_gain") + lag("cumulative_gain")) / 2 * (F.col("target_fraction") - lag("target_fraction"))).alias("area")
    )
    found = areas.groupBy(*keys).agg(F.sum("area").alias("auuc"), F.max_by("cumulative_gain", "target_fraction").alias("endpoint_gain"))
    return found.select(*keys, "auuc", (F.col("auuc") - F.lit(0.5) * F.col("endpoint_gain")).alias("qini"), "endpoint_gain")


def with_random(metrics: DataFrame) -> DataFrame:
    """Adds the random ranking: half the endpoint as AUUC, and a Qini of 0."""
    end = metrics.agg(F.max("endpoint_gain").alias("endpoint_gain"))
    random = end.select(F.lit("random_uniform").alias("model_name"), (F.lit(0.5) * F.col("endpoint_gain")).alias("auuc"), F.lit(0.0).alias("qini"), "endpoint_gain")
    return metrics.unionByName(random)


def endpoint_check(metrics: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """All rankings end at the same gain."""
    found = metrics.agg(F.count(F.lit(1)).alias("models"), F.max("endpoint_gain").alias("greatest"), F.min("endpoint_gain").alias("least"))
    return found.withColumn("common_endpoint", F.col("greatest") - F.col("least") <= tolerance)


def calibration(groups: DataFrame) -> DataFrame:
    """Weighted least squares of observed uplift on mean score, per model; weights are the groups' rows.

    Null with fewer than two groups or (nearly) equal scores.  A diagnosis: rankings never change.
    """
    valid = groups.where("mean_predicted_score is not null and observed_uplift is not null")
    w, x, y = F.col("group_rows").cast("double"), F.col("mean_predicted_score"), F.col("observed_uplift")
    means = Window.partitionBy("model_name")
    centred = valid.withColumn("mx", F.sum(w * x).over(means) / F.sum(w).over(means)).withColumn("my", F.sum(w * y).over(means) / F.sum(w).over(means))
    dx, dy = x - F.col("mx"), y - F.col("my")
    sums = centred.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("k"), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * dy).alias("sxy"), F.max("mx").alias("mx"), F.max("my").alias("my"),
        F.max(x).alias("hi"), F.min(x).alias("lo"),
    )
    flat = (F.col("k") < 2) | (F.col("hi") - F.col("lo") <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col("lo")))
    slope = F.when(~flat, F.try_divide("sxy", "sxx"))
    return sums.withColumn("slope", slope).select("model_name", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "slope", F.lit(False).alias("ranking_changed"))


def calibrated(groups: DataFrame) -> DataFrame:
    """The score groups with the uplift that their model's calibration line gives for the mean score."""
    line = calibration(groups).select("model_name", "intercept", "slope")
    predicted = F.col("intercept") + F.col("slope") * F.col("mean_predicted_score")
    return groups.join(F.broadcast(line), "model_name").withColumn("calibrated_predicted_uplift", predicted).drop("intercept", "slope")  # a row per model


def normalised_gain(curve: DataFrame) -> DataFrame:
    """Adds ``gain_share``, the gain over that at the end of the model's curve; null if that is 0."""
    end = F.max_by("cumulative_gain", "target_fraction").over(Window.partitionBy("model_name"))
    return curve.withColumn("gain_share", F.try_divide(F.col("cumulative_gain"), end))


def row_level_groups(rows: DataFrame, groups: int = 10) -> DataFrame:
    """(model_name, score_group, treatment_rows, control_rows, observed_uplift) from bounds on ranks, independent of the buckets.

    Group k has the ranks from ceil(n (k - 1) / groups) on, below ceil(n k / groups).
    """
    bounds = [F.ceil(F.col("n") * F.lit(k) / F.lit(groups)) for k in range(1, groups)]
    at = reduce(lambda a, b: a + b, [(F.col("rank") >= x).cast("int") for x in bounds], F.lit(1))
    t, y = F.col("treatment") == 1, F.col("outcome").cast("long")
    found = rows.groupBy("model_name", at.alias("score_group")).agg(
        F.count_if(t).alias("treatment_rows"), F.count_if(~t).alias("control_rows"), F.sum(F.when(t, y)).alias("y1"), F.sum(F.when(~t, y)).alias("y0")
    )
    uplift = safe_ratio(F.col("y1"), F.col("treatment_rows")) - safe_ratio(F.col("y0"), F.col("control_rows"))
    return found.select("model_name", "score_group", "treatment_rows", "control_rows", uplift.alias("observed_uplift"))


def reconciled(rows: DataFrame, curve: DataFrame, effects: DataFrame, groups: int = 20, tolerance: float = 1e-12) -> DataFrame:
    """A row per model: how far the saved curve, its metrics and the saved deciles are from what rows give.

    ``curve`` and ``effects`` are tables as ``cumulative_gain`` and ``group_effects`` make them.
    """
    again = row_level_curve(rows, groups).select("model_name", F.col("point").alias("_point"), F.col("selected_rows").alias("_rows"), F.col("cumulative_gain").alias("_gain"))
    point = F.bround(F.col("target_fraction") * groups, 0).cast("int")
    both = curve.withColumn("_point", point).join(again, ["model_name", "_point"], "full")
    off = F.abs(F.col("cumulative_gain") - F.col("_gain"))
    points = both.groupBy("model_name").agg(
        F.count("_gain").alias("curve_points"),
        F.count_if(~F.col("selected_rows").eqNullSafe(F.col("_rows")) | F.coalesce(off > tolerance * F.abs("_gain") + 1e-8, F.lit(True))).alias("wrong_points"),
        F.max(off).alias("max_gain_error"),
    )
    metrics = lambda c, name: curve_metrics(c.select("model_name", "target_fraction", "cumulative_gain")).select("model_name", F.col("qini").alias(name))
    own = again.select("model_name", (F.col("_point") / F.lit(groups)).alias("target_fraction"), F.col("_gain").alias("cumulative_gain"))
    qini = metrics(own, "qini").join(metrics(curve, "_qini"), "model_name").select("model_name", "qini", F.abs(F.col("qini") - F.col("_qini")).alias("qini_error"))
    deciles = row_level_groups(rows).toDF("model_name", "score_group", "_t", "_c", "_u").join(effects, ["model_name", "score_group"], "full")
    wrong = ~F.col("_t").eqNullSafe(F.col("treatment_rows")) | ~F.col("_c").eqNullSafe(F.col("control_rows")) | F.coalesce(F.abs(F.col("_u") - F.col("observed_uplift")) > 1e-14, F.lit(False))
    deciles = deciles.groupBy("model_name").agg(F.count("_t").alias("deciles"), F.count_if(wrong).alias("wrong_deciles"))
    return points.join(qini, "model_name").join(deciles, "model_name")


def row_level_curve(rows: DataFrame, groups: int = 20) -> DataFrame:
    """The curve from running sums over rows, independent of the group cells.

    The running sums are in two steps, within blocks of ranks and over blocks, so that no window holds a
    whole ranking; a point of the curve is the last row of its group.
    """
    size = 1 << 14
    block = (F.col("rank") / size).cast("long")
    flags = rows.select(
        "model_name", "rank", "n", block.alias("block"), F.col("treatment").cast("long").alias("t"), (F.col("treatment") * F.col("outcome")).cast("long").alias("yt"), ((1 - F.col("treatment")) * F.col("outcome")).cast("long").alias("yc")
    )
    inside = Window.partitionBy("model_name", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = flags.select("model_name", "rank", "n", "block", *[F.sum(c).over(inside).alias(c) for c in ("t", "yt", "yc")])
    ends = flags.groupBy("model_name", "block").agg(*[F.sum(c).alias(f"b_{c}") for c in ("t", "yt", "yc")])
    before = Window.partitionBy("model_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("model_name", "block", *[F.coalesce(F.sum(f"b_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in ("t", "yt", "yc")])
    # the last rank of group g is ceil((g + 1) n / groups) - 1
    g = F.expr(f"rank * {groups} div n")
    last = run.where((F.expr(f"(rank + 1) * {groups} div n") > g) | (F.col("rank") == F.col("n") - 1))
    points = last.join(ends, ["model_name", "block"])
    t, yt, yc = (F.col(c) + F.col(f"b_{c}") for c in ("t", "yt", "yc"))
    k = F.col("rank") + 1
    uplift = F.try_divide(yt.cast("double"), t.cast("double")) - F.try_divide(yc.cast("double"), (k - t).cast("double"))
    return points.select("model_name", (F.least(g, F.lit(groups - 1)) + 1).cast("int").alias("point"), k.alias("selected_rows"), (k * uplift).alias("cumulative_gain"))
