"""Policies: rates to report, comparisons with the response ranking, overlap, stability, final choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import Z_95
from quern.operators.curves import MAIN_PERCENTS, REPORT_PERCENTS
from quern.operators.effects import difference_in_rates
from quern.operators.ranking import average_ranks, in_top
from quern.plans.experiment import RESPONSE_MODEL, UPLIFT_MODELS


def percent(fraction: str = "target_fraction") -> Column:
    """A fraction as an integer percentage, the key of all lookups by rate."""
    return F.bround(F.col(fraction) * 100, 0).cast("int")


def policy_summary(curve: DataFrame, percents: list[int] = REPORT_PERCENTS) -> DataFrame:
    """The curve at the reported rates, with the gain above the response ranking's at the same rate."""
    rows = curve.withColumn("percent", percent()).where(F.col("percent").isin(percents))
    response = F.max(F.when(F.col("model_name") == RESPONSE_MODEL, F.col("cumulative_gain"))).over(Window.partitionBy("percent"))
    return rows.withColumn("gain_above_response", F.col("cumulative_gain") - response)


def with_intervals(policy: DataFrame, uncertainty: DataFrame, main: list[int] = MAIN_PERCENTS) -> DataFrame:
    """Adds bootstrap intervals at the main rates; the response ranking differs from itself by 0."""
    wanted = uncertainty.select("model_name", "metric", "ci_lower", "ci_upper")

    def joined(rows: DataFrame, metric: Column, name: str) -> DataFrame:
        side = wanted.select(F.col("model_name"), F.col("metric").alias("_m"), F.col("ci_lower").alias(f"{name}_ci_lower"), F.col("ci_upper").alias(f"{name}_ci_upper"))
        return rows.withColumn("_m", F.when(F.col("percent").isin(main), metric)).join(side, ["model_name", "_m"], "left").drop("_m")

    gain = F.format_string("gain_at_%dpct", "percent")
    out = joined(policy, gain, "incremental_gain")
    out = joined(out, F.concat(gain, F.lit("_minus_response")), "gain_above_response")
    own = (F.col("model_name") == RESPONSE_MODEL) & F.col("percent").isin(main)
    for side in ("lower", "upper"):
        c = f"gain_above_response_ci_{side}"
        out = out.withColumn(c, F.when(own, F.lit(0.0)).otherwise(F.col(c)))
    return out


def pairwise_differences(metrics: DataFrame, models: list[str] = UPLIFT_MODELS) -> DataFrame:
    """Differences in AUUC and Qini of each later model and each earlier one (a few rows)."""
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model_name"))
    ranked = metrics.where(F.col("model_name").isin(models)).withColumn("place", place)
    earlier = F.explode(F.sequence(F.lit(1), F.lit(len(models))))
    a, b = ranked.select("*", earlier.alias("before")).alias("a"), ranked.alias("b")
    return a.join(b, (F.col("a.before") == F.col("b.place")) & (F.col("a.place") > F.col("b.place"))).select(
        F.col("a.model_name").alias("later_model"),
        F.col("b.model_name").alias("earlier_model"),
        (F.col("a.auuc") - F.col("b.auuc")).alias("auuc_difference"),
        (F.col("a.qini") - F.col("b.qini")).alias("qini_difference"),
    )


def selected_effects(rows: DataFrame, fractions: list[float], z: float = Z_95) -> DataFrame:
    """Effect and gain on the top fraction of every ranking."""
    picks = F.explode(F.filter(F.array(*[F.when(in_top(f), F.lit(f)) for f in fractions]), lambda x: x.isNotNull()))
    some = lambda t, y=None: F.count_if((F.col("treatment") == t) & (F.lit(True) if y is None else F.col("outcome") == y))
    cells = rows.select("model_name", "treatment", "outcome", picks.alias("fraction")).groupBy("model_name", "fraction").agg(
        some(0).alias("n0"), some(1).alias("n1"), some(0, 1).alias("y0"), some(1, 1).alias("y1")
    )
    found = difference_in_rates(cells, z).withColumn("selected_rows", F.col("n0") + F.col("n1"))
    return found.select(
        "model_name",
        "fraction",
        "selected_rows",
        "uplift",
        (F.col("selected_rows") * F.col("uplift")).alias("gain"),
        (F.col("selected_rows") * F.col("uplift_ci_lower")).alias("gain_ci_lower"),
        (F.col("selected_rows") * F.col("uplift_ci_upper")).alias("gain_ci_upper"),
    )


def policy_overlap(rows: DataFrame, model_a: str, model_b: str, fractions: list[float]) -> DataFrame:
    """Rows that both rankings select at each fraction, in one aggregate over rows that either selects."""
    pair = rows.where(F.col("model_name").isin(model_a, model_b))
    tops = F.array(*[F.when(in_top(f), F.lit(f)) for f in fractions])
    hits = pair.select("model_name", "source_row_id", "n", F.explode(F.filter(tops, lambda x: x.isNotNull())).alias("fraction"))
    both = hits.groupBy("fraction", "source_row_id").agg(
        F.count_if(F.col("model_name") == model_a).alias("a"), F.count_if(F.col("model_name") == model_b).alias("b"), F.max("n").alias("n")
    )
    return both.groupBy("fraction").agg(
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared_rows"), F.count_if(F.col("a") > 0).alias("selected_rows"), F.max("n").alias("population")
    ).withColumn("shared_pct_of_selected", F.lit(100.0) * F.col("shared_rows") / F.col("selected_rows")).withColumn(
        "shared_pct_of_population", F.lit(100.0) * F.col("shared_rows") / F.col("population")
    ).drop("population")


def spearman(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns, ties averaged."""
    ranks = average_ranks(average_ranks(wide.select(a, b), a), b)
    return ranks.agg(F.corr(f"{a}_rank", f"{b}_rank").alias("spearman_rank_correlation"), F.count(F.lit(1)).alias("rows"))
