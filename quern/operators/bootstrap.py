"""Bootstrap from sufficient statistics: binomial for rates, paired Poisson for rankings.

Draws come from hashed counters (see ``functions.streams``), so they don't depend on tasks, can be drawn again one by one, and have SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.streams import binomial_quantile, binomial_table, poisson_quantile, with_uniform
from quern.operators.curves import MAIN_PERCENTS, curve_from_cells, curve_metrics
from quern.operators.policy import percent
from quern.operators.ranking import bucket
from quern.plans.experiment import RESPONSE_MODEL, UPLIFT_MODELS
from quern.sources.files import written

BINOMIAL_SEED = 20260809
PAIRED_SEED = 20260825
#: replicates of a cell or an arm, at most
MOST_REPLICATES = 1 << 16


def binomial_draws(cells: DataFrame, replicates: int, seed: int = BINOMIAL_SEED) -> DataFrame:
    """(outcome, replicate, absolute_lift, relative_lift): both arms' positives drawn anew, each from its own rate.

    The first draws stay the same when there are more of them.
    """
    check_replicates(replicates)
    order = F.array(F.lit("visit"), F.lit("conversion"))
    place = F.coalesce(F.array_position(order, F.col("outcome")).cast("long"), F.lit(0))
    arms = cells.select("outcome", place.alias("place"), F.explode(F.array(*[F.struct(F.lit(t).alias("arm"), F.col(f"n{t}").alias("n"), F.col(f"y{t}").alias("y")) for t in (0, 1)])).alias("a")).select("outcome", "place", "a.*")
    with_table = arms.withColumn("table", binomial_table(F.col("n"), F.col("y")))
    every = with_table.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = with_uniform(every.withColumn("counter", (F.col("place") * 2 + F.col("arm")) * MOST_REPLICATES + F.col("replicate")), "counter", seed, "u")
    rates = drawn.select("outcome", "replicate", "arm", (binomial_quantile(F.col("n"), F.col("y"), F.col("table"), F.col("u")) / F.col("n")).alias("p"))
    both = rates.groupBy("outcome", "replicate").agg(*[F.max(F.when(F.col("arm") == t, F.col("p"))).alias(f"p{t}") for t in (0, 1)])
    lift = F.col("p1") - F.col("p0")
    return both.select("outcome", "replicate", lift.alias("absolute_lift"), F.try_divide(lift, F.col("p0")).alias("relative_lift"))


def check_replicates(replicates: int) -> None:
    if not 0 < replicates <= MOST_REPLICATES:
        raise ValueError(f"replicates must be 1 to {MOST_REPLICATES}")


def interval(column: str, level: float = 0.95) -> Column:
    a = (1 - level) / 2
    return F.percentile(column, F.array(F.lit(a), F.lit(1 - a)))


def percentile_intervals(draws: DataFrame) -> DataFrame:
    """(outcome, measure, ci_lower, ci_upper); undefined draws are left out."""
    long = draws.select("outcome", "replicate", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("absolute_lift", "relative_lift")])).alias("m")).select("outcome", "replicate", "m.*")
    found = long.where("value is not null").groupBy("outcome", "measure").agg(interval("value").alias("ci"))
    return found.select("outcome", "measure", F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper"))


def split_half_stability(draws: DataFrame, limit: float = 0.02) -> DataFrame:
    """How far the endpoints of two halves of the draws are apart, as a share of the whole interval's width."""
    n = draws.agg((F.max("replicate") + 1).alias("n")).first().n
    keys = ["outcome", "measure"]
    first, second = (percentile_intervals(draws.where(c)) for c in (F.col("replicate") < n // 2, F.col("replicate") >= n // 2))
    full = percentile_intervals(draws).select(*keys, (F.col("ci_upper") - F.col("ci_lower")).alias("width"))
    a, b = (x.select(*keys, F.col("ci_lower").alias(f"lo{i}"), F.col("ci_upper").alias(f"hi{i}")) for i, x in enumerate((first, second)))
    worst = F.greatest(F.abs(F.col("lo0") - F.col("lo1")), F.abs(F.col("hi0") - F.col("hi1")))
    return full.join(a, keys).join(b, keys).select(*keys, F.try_divide(worst, F.col("width")).alias("endpoint_change"), (F.try_divide(worst, F.col("width")) <= limit).alias("stable"))


def escalated_draws(cells: DataFrame, first: int = 10_000, second: int = 50_000, seed: int = BINOMIAL_SEED, *, strict: bool = True) -> tuple[DataFrame, int, bool]:
    """Draws, their number, and whether halves of them agree; more are drawn if the first check fails.

    If the second check fails too, ``strict`` raises: such intervals aren't to be published.
    """
    for n in (first, second):
        draws = written(binomial_draws(cells, n, seed), "binomial-draws")
        stable = split_half_stability(draws).where("not stable").isEmpty()
        if stable:
            break
    if strict and not stable:
        raise ValueError(f"halves of {n} draws still give different intervals")
    return draws, n, stable


def interval_agreement(analytical: DataFrame, bootstrap: DataFrame, limit: float = 0.10) -> DataFrame:
    """Differences of two kinds of intervals, as shares of the analytical width."""
    keys = ["outcome", "measure"]
    a = analytical.select(*keys, F.col("ci_lower").alias("al"), F.col("ci_upper").alias("au"))
    width = F.col("au") - F.col("al")
    out = a.join(bootstrap, keys).select(
        *keys,
        (F.abs(F.col("ci_lower") - F.col("al")) / width).alias("lower_difference"),
        (F.abs(F.col("ci_upper") - F.col("au")) / width).alias("upper_difference"),
        (F.abs((F.col("ci_upper") - F.col("ci_lower")) - width) / width).alias("width_difference"),
    )
    return out.withColumn("agrees", F.greatest("lower_difference", "upper_difference", "width_difference") <= limit)


def joint_cells(ranked: DataFrame, models: list[str], groups: int = 20, by: list[str] | None = None) -> DataFrame:
    """Rows per combination of all rankings' groups, arm and outcome: all that the paired bootstrap needs."""
    by = by or []
    wide = ranked.groupBy(*by, "source_row_id").agg(
        *[F.max(F.when(F.col("model_name") == m, bucket(groups))).alias(f"g_{m}") for m in models], F.max("treatment").alias("treatment"), F.max("outcome").alias("outcome")
    )
    return wide.groupBy(*by, *[f"g_{m}" for m in models], "treatment", "outcome").agg(F.count(F.lit(1)).alias("cell_rows"))


def stream_key(models: list[str], groups: int, stream: Column) -> Column:
    """A cell's number: its stream, its group in each ranking (none: one more than the last), arm and outcome, as digits."""
    key = stream.cast("long")
    for m in models:
        key = key * (groups + 1) + F.coalesce(F.col(f"g_{m}"), F.lit(groups))
    return key * 4 + F.col("treatment") * 2 + F.col("outcome")


def with_stream_keys(cells: DataFrame, models: list[str], groups: int = 20, stream: Column | None = None) -> DataFrame:
    if 8 * (groups + 1) ** len(models) * MOST_REPLICATES >= 1 << 63:
        raise ValueError("too many rankings and groups to number the cells in 64 bits")
    return cells.withColumn("stream_key", stream_key(models, groups, F.lit(0) if stream is None else stream))


def weighted_cells(cells: DataFrame, models: list[str], replicates: int, *, groups: int = 20, seed: int = PAIRED_SEED, stream: Column | None = None) -> DataFrame:
    """Cells once per replicate with ``weight``: the sum of a Poisson weight of mean 1 for each of the cell's rows."""
    check_replicates(replicates)
    every = with_stream_keys(cells, models, groups, stream).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = with_uniform(every.withColumn("counter", F.col("stream_key") * MOST_REPLICATES + F.col("replicate")), "counter", seed, "u")
    return drawn.withColumn("weight", poisson_quantile(F.col("cell_rows"), F.col("u"))).drop("counter", "u")


def paired_draws(cells: DataFrame, models: list[str], replicates: int, *, groups: int = 20, seed: int = PAIRED_SEED, by: list[str] | None = None, stream: Column | None = None) -> DataFrame:
    """(by, replicate, model_name, bucket, n0, n1, y0, y1) of resamples of the joint cells, the same for all rankings.

    A row's weight in a replicate is a Poisson number of mean 1, the limit of its count among draws with replacement; a
    cell's weights add up to one Poisson number.  Nothing but partial sums leaves a task, however many cells there are.
    """
    by = by or []
    weighted = weighted_cells(cells, models, replicates, groups=groups, seed=seed, stream=stream)
    long = weighted.select(*by, "replicate", "treatment", "outcome", "weight", F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(f"g_{m}").alias("bucket")) for m in models])).alias("m")).select("*", "m.*").where("bucket is not null")
    t1, y1 = F.col("treatment") == 1, F.col("outcome") == 1
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))
    return long.groupBy(*by, "replicate", "model_name", "bucket").agg(some(~t1).alias("n0"), some(t1).alias("n1"), some(~t1 & y1).alias("y0"), some(t1 & y1).alias("y1"))


def draw_metrics(draws: DataFrame, groups: int = 20, main: list[int] = MAIN_PERCENTS, models: list[str] = UPLIFT_MODELS, by: list[str] | None = None) -> DataFrame:
    """(by, replicate, model_name, metric, value): AUUC, Qini and gains, and paired differences within a replicate."""
    by = by or []
    keys = [*by, "replicate", "model_name"]
    curve = curve_from_cells(draws, groups, by=keys)
    areas = curve_metrics(curve, keys)
    long = areas.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auuc", "qini")])).alias("m")).select(*keys, "m.*")
    at = curve.withColumn("percent", percent()).where(F.col("percent").isin(main))
    own = long.unionByName(at.select(*keys, F.format_string("gain_at_%dpct", "percent").alias("metric"), F.col("cumulative_gain").alias("value")))
    per = Window.partitionBy(*by, "replicate", "metric")
    of = lambda m: F.max(F.when(F.col("model_name") == m, F.col("value"))).over(per)
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model_name"))
    others = [
        F.struct(F.concat("metric", F.lit("_minus_response")).alias("metric"), F.when(F.col("model_name") != RESPONSE_MODEL, F.col("value") - F.col("_response")).alias("value"))
    ] + [
        F.struct(
            F.concat("metric", F.lit(f"_minus_{m}")).alias("metric"),
            F.when((place > i + 1) & F.col("metric").isin("auuc", "qini"), F.col("value") - F.col(f"_{m}")).alias("value"),
        )
        for i, m in enumerate(models[:-1])
    ]
    wide = own.select("*", of(RESPONSE_MODEL).alias("_response"), *[of(m).alias(f"_{m}") for m in models[:-1]])
    paired = wide.select(*keys, F.explode(F.array(*others)).alias("d")).select(*keys, "d.*").where("value is not null")
    return own.unionByName(paired)


def bootstrap_summary(values: DataFrame, points: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Percentile intervals per model and metric, with the point estimates where given."""
    keys = [*(by or []), "model_name", "metric"]
    found = values.where("value is not null").groupBy(*keys).agg(interval("value").alias("ci"), F.count_distinct("replicate").alias("bootstrap_replicates"))
    out = found.select(*keys, F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper"), "bootstrap_replicates")
    return out.join(points, keys, "left") if points is not None else out


def replayed(saved: DataFrame, claimed: DataFrame, models: list[str], replicates: int, *, groups: int = 20, seed: int = PAIRED_SEED, main: list[int] = MAIN_PERCENTS, tolerance: float = 1e-12) -> DataFrame:
    """One row: the draws' values that the saved cells and stream keys give, how many of them the ``claimed`` ones miss by over ``tolerance``, and whether none does.

    A saved key that isn't its cell's makes all draws wrong, since other numbers would have been drawn.
    """
    odd = saved.where(~F.col("stream_key").eqNullSafe(stream_key(models, groups, F.lit(0)))).limit(1).select(F.lit(True).alias("odd_key"))
    again = draw_metrics(paired_draws(saved.drop("stream_key"), models, replicates, groups=groups, seed=seed), groups, main)
    keys = ["replicate", "model_name", "metric"]
    both = claimed.select(*keys, F.col("value").alias("claimed"), F.lit(1).alias("one")).join(again.select(*keys, F.col("value").alias("again"), F.lit(1).alias("two")), keys, "full")
    scale = F.greatest(F.lit(1.0), F.abs("again"))
    same = F.col("one").isNotNull() & F.col("two").isNotNull() & (F.col("claimed").eqNullSafe(F.col("again")) | F.coalesce(F.abs(F.col("claimed") - F.col("again")) <= tolerance * scale, F.lit(False)))
    wrong = both.agg(F.count(F.lit(1)).alias("draws"), F.count_if(~same).alias("wrong"))
    # one row or none
    found = wrong.join(F.broadcast(odd), F.lit(True), "left")
    bad = F.when(F.coalesce("odd_key", F.lit(False)), F.col("draws")).otherwise(F.col("wrong"))
    return found.select("draws", bad.alias("wrong_draws"), (bad == 0).alias("replayed"))
