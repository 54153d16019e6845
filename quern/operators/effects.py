"""Average effects: rates, intervals, tests, multiple testing, exposure and the complier ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import Z_95, Z_ROUNDED, log_normal_tail, p_value_text, safe_ratio

OUTCOMES = ["visit", "conversion"]


def outcome_cells(view: DataFrame, outcomes: list[str] = OUTCOMES) -> DataFrame:
    """(outcome, n0, n1, y0, y1), from one aggregate over the rows."""
    arm = lambda t: F.count_if(F.col("treatment") == t)
    cells = view.agg(
        arm(0).alias("n0"), arm(1).alias("n1"), *[F.count_if((F.col("treatment") == t) & (F.col(o) == 1)).alias(f"{o}{t}") for o in outcomes for t in (0, 1)]
    )
    return cells.select(
        F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), "n0", "n1", F.col(f"{o}0").alias("y0"), F.col(f"{o}1").alias("y1")) for o in outcomes])).alias("c")
    ).select("c.*")


def rate_columns() -> tuple[Column, Column]:
    return safe_ratio(F.col("y0"), F.col("n0")), safe_ratio(F.col("y1"), F.col("n1"))


def unpooled_se(p0: Column, p1: Column, n0: Column, n1: Column) -> Column:
    return F.sqrt(F.greatest(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0, F.lit(0.0)))


def difference_in_rates(cells: DataFrame, z: float = Z_95) -> DataFrame:
    """Adds p0, p1, uplift and its interval to n0, n1, y0, y1; null where an arm is empty."""
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    p0, p1 = (F.when(both, p) for p in rate_columns())
    out = cells.withColumn("p0", p0).withColumn("p1", p1).withColumn("uplift", F.col("p1") - F.col("p0"))
    se = F.when(both, unpooled_se(F.col("p0"), F.col("p1"), F.nullif("n0", F.lit(0)), F.nullif("n1", F.lit(0))))
    return out.withColumn("se", se).withColumn("uplift_ci_lower", F.col("uplift") - z * F.col("se")).withColumn("uplift_ci_upper", F.col("uplift") + z * F.col("se")).drop("se")


def effect_summary(cells: DataFrame, z: float = Z_ROUNDED) -> DataFrame:
    """Absolute and relative lift with intervals, and incremental outcomes, per outcome."""
    p0, p1 = rate_columns()
    out = cells.withColumn("control_rate", p0).withColumn("treatment_rate", p1)
    p0, p1 = F.col("control_rate"), F.col("treatment_rate")
    lift, ratio = p1 - p0, F.try_divide(p1, p0)
    se = unpooled_se(p0, p1, F.col("n0"), F.col("n1"))
    log_se = F.sqrt(F.try_divide(F.lit(1.0), F.col("y1")) - F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("y0")) - F.try_divide(F.lit(1.0), F.col("n0")))
    return out.select(
        "outcome",
        F.col("n0").alias("control_n"),
        F.col("n1").alias("treatment_n"),
        F.col("y0").alias("control_positive"),
        F.col("y1").alias("treatment_positive"),
        "control_rate",
        "treatment_rate",
        lift.alias("absolute_lift"),
        se.alias("absolute_lift_se"),
        (lift - z * se).alias("absolute_ci_lower"),
        (lift + z * se).alias("absolute_ci_upper"),
        (F.try_divide(lift, p0)).alias("relative_lift"),
        (F.exp(F.ln(ratio) - z * log_se) - 1).alias("relative_ci_lower"),
        (F.exp(F.ln(ratio) + z * log_se) - 1).alias("relative_ci_upper"),
        (F.col("n1") * lift).alias("incremental_treated"),
        ((F.col("n0") + F.col("n1")) * lift).alias("incremental_all"),
    )


def arm_rate_intervals(cells: DataFrame, z: float = Z_ROUNDED) -> DataFrame:
    """Each arm's rate with its interval, cut off at 0 and 1."""
    arms = F.explode(F.array(*[F.struct(F.lit(t).alias("treatment"), F.col(f"n{t}").alias("n"), F.col(f"y{t}").alias("positive")) for t in (0, 1)]))
    rows = cells.select("outcome", arms.alias("a")).select("outcome", "a.*").withColumn("rate", safe_ratio(F.col("positive"), F.col("n")))
    half = z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return rows.select("*", F.greatest(F.lit(0.0), F.col("rate") - half).alias("ci_lower"), F.least(F.lit(1.0), F.col("rate") + half).alias("ci_upper"))


def z_tests(cells: DataFrame) -> DataFrame:
    """Pooled two-sample tests: z, the two-sided p value and its logarithm, which doesn't underflow."""
    pooled = (F.col("y0") + F.col("y1")) / (F.col("n0") + F.col("n1"))
    se = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n0")))
    p0, p1 = rate_columns()
    out = cells.select("outcome", F.try_divide(p1 - p0, se).alias("z_statistic"))
    log_p = F.ln(F.lit(2.0)) + log_normal_tail(F.col("z_statistic"))
    out = out.withColumn("log_p", log_p).withColumn("log10_p_value", F.col("log_p") / F.ln(F.lit(10.0)))
    out = out.withColumn("p_value", F.when(F.col("log_p") > -708.3964185322641, F.exp("log_p")).otherwise(F.lit(0.0)))
    return out.withColumn("p_value_display", p_value_text(F.col("p_value"), F.col("log10_p_value"))).drop("log_p")


def holm(tests: DataFrame, p: str = "p_value", by: list[str] | None = None, level: float = 0.05) -> DataFrame:
    """Adds Holm's adjusted p value and whether it is below ``level``; a family is a few rows."""
    family = Window.partitionBy(*(by or [F.lit(0)]))
    order = family.orderBy(p, "outcome")
    k, m = F.row_number().over(order), F.count(F.lit(1)).over(family)
    step = tests.withColumn("_step", F.least(F.lit(1.0), (m - k + 1) * F.col(p)))
    running = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return step.withColumn("holm_p_value", running).drop("_step").withColumn("reject", F.col("holm_p_value") < level)


def exposure_groups(view: DataFrame) -> DataFrame:
    """Control, assigned but unexposed, assigned and exposed: size and rates."""
    group = F.when(F.col("treatment") == 0, "Control").when(F.col("exposure") == 0, "Assigned, unexposed").otherwise("Assigned, exposed")
    n = F.count(F.lit(1))
    rate = lambda c: safe_ratio(F.sum(F.col(c).cast("long")), n)
    return view.groupBy(group.alias("delivery_group")).agg(
        n.alias("n"), rate("exposure").alias("exposure_rate"), rate("visit").alias("visit_rate"), rate("conversion").alias("conversion_rate")
    )


def complier_ratio(view: DataFrame, outcomes: list[str] = OUTCOMES) -> DataFrame:
    """The lift per outcome divided by the difference of the exposure rates."""
    exposure = outcome_cells(view, [*outcomes, "exposure"])
    p0, p1 = rate_columns()
    lifts = exposure.select("outcome", (p1 - p0).alias("lift"))
    base = F.max(F.when(F.col("outcome") == "exposure", F.col("lift"))).over(Window.partitionBy(F.lit(0)))
    return lifts.withColumn("exposure_difference", base).where("outcome <> 'exposure'").select(
        "outcome", F.col("lift").alias("itt_lift"), "exposure_difference", F.try_divide("lift", "exposure_difference").alias("wald_ratio")
    )


def delivery_stages(view: DataFrame) -> DataFrame:
    """Assigned, exposed, visited and converted rows of the treatment arm."""
    treated = view.where("treatment = 1").agg(
        F.count(F.lit(1)).alias("assigned"), F.count_if(F.col("exposure") == 1).alias("exposed"), F.count_if(F.col("visit") == 1).alias("visited"), F.count_if(F.col("conversion") == 1).alias("converted")
    )
    names = ["assigned", "exposed", "visited", "converted"]
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.lit(n).alias("stage_name"), F.col(n).alias("n")) for i, n in enumerate(names)]))
    return treated.select(rows.alias("r")).select("r.*")
