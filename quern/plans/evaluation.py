"""The evaluation from learners to recommendations, for several outcomes at once.

Rankings are named ``outcome:model``, so one sort ranks all models of all outcomes.  The learners here are
stratified: mean responses per stratum and arm instead of boosted trees, with the same algebra.  Any scores in
long form (outcome_name, model_name, source_row_id, score, treatment, outcome) can take their place, such as
those of ``learners.score_learners``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import safe_ratio
from quern.operators import bootstrap, curves, policy, ranking
from quern.operators.learners import pseudo_outcome
from quern.plans.experiment import RESPONSE_MODEL, UPLIFT_MODELS
from quern.sources import files

OUTCOMES = ["visit", "conversion"]
MODELS = [*UPLIFT_MODELS, RESPONSE_MODEL, "constant_ate"]
TENTH = 10


def by_outcome(view: DataFrame, columns: list[str]) -> DataFrame:
    """(outcome_name, outcome, columns): a row per row and outcome."""
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome_name"), F.col(o).alias("outcome")) for o in OUTCOMES])).alias("o")
    return view.select(rows, *columns).select("o.*", *columns)


def _rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """mu0, mu1 (null for an empty arm) and the rate of both arms per outcome and stratum."""
    y = F.col("outcome").cast("long")
    arm = lambda t: safe_ratio(F.sum(F.when(F.col("treatment") == t, y)), F.count_if(F.col("treatment") == t))
    return rows.groupBy("outcome_name", *keys).agg(arm(0).alias("mu0"), arm(1).alias("mu1"), safe_ratio(F.sum(y), F.count(F.lit(1))).alias("mu"))


def stratified_scores(train: DataFrame, rows: DataFrame, seed: int = 0) -> DataFrame:
    """Scores of ``rows`` in long form, fitted on the nine tenths of ``train`` that the seed picks.

    S: the effect in a stratum of f3 and f10; T: the treated response by f2 less the control response by f3; X: mean
    pseudo-outcomes by f10; response: the rate by f3 and f10.  Where a stratum is empty, the rates of all stand in.
    """
    fit = by_outcome(train.where((F.col("source_row_id") * 7919 + seed * 104_729) % 10 != 0), ["f2", "f3", "f10", "treatment"])
    whole = _rates(fit, []).toDF("outcome_name", "all0", "all1", "all")
    both = _rates(fit, ["f3", "f10"]).select("outcome_name", "f3", "f10", (F.col("mu1") - F.col("mu0")).alias("e"), F.col("mu").alias("r"))
    treated = _rates(fit, ["f2"]).select("outcome_name", "f2", "mu1")
    control = _rates(fit, ["f3"]).select("outcome_name", "f3", "mu0")

    def with_rates(df: DataFrame) -> DataFrame:
        joined = df.join(whole, "outcome_name").join(treated, ["outcome_name", "f2"], "left").join(control, ["outcome_name", "f3"], "left")
        return joined.withColumn("mu1", F.coalesce("mu1", "all1")).withColumn("mu0", F.coalesce("mu0", "all0"))

    pseudo = pseudo_outcome(F.col("treatment"), F.col("outcome").cast("double"), F.col("mu0"), F.col("mu1"))
    pooled = with_rates(fit).groupBy("outcome_name", "f10").agg(F.round(F.avg(pseudo), 9).alias("x"))
    wide = with_rates(by_outcome(rows, ["source_row_id", "f2", "f3", "f10", "treatment"])).join(both, ["outcome_name", "f3", "f10"], "left").join(pooled, ["outcome_name", "f10"], "left")
    overall = F.col("all1") - F.col("all0")
    scores = [F.coalesce("e", overall), F.col("mu1") - F.col("mu0"), F.coalesce("x", overall), F.coalesce("r", "all"), overall]
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), s.alias("score")) for m, s in zip(MODELS, scores)])).alias("m")
    return wide.select("outcome_name", "source_row_id", "treatment", "outcome", long).select("outcome_name", "m.*", "source_row_id", "treatment", "outcome")


def ranked(scores: DataFrame, seed: int) -> DataFrame:
    return ranking.ranked(scores.withColumn("model_name", F.concat_ws(":", "outcome_name", "model_name")).drop("outcome_name"), seed=seed)


def named(df: DataFrame) -> DataFrame:
    """``outcome:model`` split into its two columns, which come first."""
    parts = F.split("model_name", ":")
    others = [c for c in df.columns if c != "model_name"]
    return df.select(parts[0].alias("outcome_name"), parts[1].alias("model_name"), *others)


def of_outcome(df: DataFrame, outcome: str) -> DataFrame:
    """The rows of one outcome, named by model alone."""
    return named(df).where(F.col("outcome_name") == outcome).drop("outcome_name")


def _each(make) -> DataFrame:
    """``make(outcome)`` for every outcome, as one table."""
    out = None
    for outcome in OUTCOMES:
        part = make(outcome)
        part = part.select(F.lit(outcome).alias("outcome_name"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out


def stream_of(outcome: str = "outcome_name") -> Column:
    return F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col(outcome))


def uncertainty(rows: DataFrame, replicates: int, groups: int, models: list[str] = MODELS) -> DataFrame:
    """(outcome_name, model_name, metric, estimate, ci_lower, ci_upper, bootstrap_replicates) from the paired bootstrap of ranked ``rows``.

    All outcomes are drawn together, and the draws are written once.
    """
    by = ["outcome_name"]
    own = named(rows)
    cells = files.written(bootstrap.joint_cells(own, models, groups, by), "joint-cells")
    draws = files.written(bootstrap.paired_draws(cells, models, replicates, groups=groups, by=by, stream=stream_of()), "draws")
    points = bootstrap.draw_metrics(cell_counts(cells, models, by), groups, by=by).select(*by, "model_name", "metric", F.col("value").alias("estimate"))
    found = bootstrap.bootstrap_summary(bootstrap.draw_metrics(draws, groups, by=by), points, by)
    return found.select(*by, "model_name", "metric", "estimate", "ci_lower", "ci_upper", "bootstrap_replicates")


def cell_counts(cells: DataFrame, models: list[str], by: list[str]) -> DataFrame:
    """The joint cells' own counts per ranking and group, as replicate 0."""
    long = cells.select(*by, "treatment", "outcome", F.col("cell_rows").alias("w"), F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(f"g_{m}").alias("bucket")) for m in models])).alias("m")).select("*", "m.*")
    some = lambda t, y: F.sum(F.when((F.col("treatment") == t) & (F.col("outcome") >= y), F.col("w")).otherwise(0))
    counts = long.groupBy(*by, "model_name", "bucket").agg(some(0, 0).alias("n0"), some(1, 0).alias("n1"), some(0, 1).alias("y0"), some(1, 1).alias("y1"))
    return counts.withColumn("replicate", F.lit(0))


def policy_table(curve: DataFrame, intervals: DataFrame) -> DataFrame:
    """The policy table of every outcome, with intervals at the main rates."""

    def one(outcome: str) -> DataFrame:
        own = intervals.where(F.col("outcome_name") == outcome)
        found = policy.with_intervals(policy.policy_summary(of_outcome(curve, outcome)), own)
        sides = [f"{c}_ci_{s}" for c in ("incremental_gain", "gain_above_response") for s in ("lower", "upper")]
        return found.select("model_name", "percent", "selected_rows", "cumulative_uplift", "cumulative_gain", "gain_above_response", *sides)

    return _each(one)


def stability(reference: DataFrame, alternates: dict[int, DataFrame], seed: int) -> DataFrame:
    """Per outcome, uplift model and alternate seed: rank correlation with the reference scores, overlap of the top tenths, means."""
    key = ["outcome_name", "model_name", "comparison_seed"]
    uplift = F.col("model_name").isin(UPLIFT_MODELS)
    both = None
    for other, scores in alternates.items():
        pair = reference.where(uplift).select("outcome_name", "model_name", "source_row_id", F.col("score").alias("a")).join(
            scores.where(uplift).select("outcome_name", "model_name", "source_row_id", F.col("score").alias("b")), ["outcome_name", "model_name", "source_row_id"]
        )
        pair = pair.withColumn("comparison_seed", F.lit(other))
        both = pair if both is None else both.unionByName(pair)
    both = both.select(*key, "source_row_id", "a", "b")
    ranks = ranking.average_ranks(ranking.average_ranks(both, "a", key), "b", key)
    found = ranks.groupBy(*key).agg(F.corr("a_rank", "b_rank").alias("spearman_rank_correlation"), F.avg("a").alias("reference_mean_uplift"), F.avg("b").alias("comparison_mean_uplift"))
    long = both.select(
        F.concat_ws(":", *key[:2], F.col("comparison_seed").cast("string")).alias("name"), "source_row_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("score")) for s in ("a", "b")])).alias("s")
    ).select(F.concat_ws("/", "name", "s.side").alias("model_name"), "source_row_id", "s.score")
    top = ranking.ranked(long, seed=seed).where(ranking.bucket(TENTH) == 0).select(F.split("model_name", "/")[0].alias("name"), "source_row_id")
    shared = top.groupBy("name", "source_row_id").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(
        F.count_if(F.col("n") == 2).alias("both"), F.sum("n").alias("all")
    )
    parts = F.split("name", ":")
    overlap = shared.select(parts[0].alias("outcome_name"), parts[1].alias("model_name"), parts[2].cast("int").alias("comparison_seed"), (F.col("both") * 2 / F.col("all")).alias("top_set_overlap"))
    return found.join(overlap, key)


def stability_summary(table: DataFrame) -> DataFrame:
    """Mean and least agreement of every model over the alternate seeds."""
    measures = {"spearman_rank_correlation": "spearman_rank_correlation", "top_set_overlap": "top_set_overlap"}
    return table.groupBy("outcome_name", "model_name").agg(*[f(c).alias(f"{p}_{c}") for c in measures for p, f in (("mean", F.avg), ("minimum", F.min))])


def _complexity(model: str = "model_name") -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in UPLIFT_MODELS]), F.col(model)).cast("int")


STABILITY = [f"{p}_{c}" for c in ("spearman_rank_correlation", "top_set_overlap") for p in ("mean", "minimum")]


def model_comparison(metrics: DataFrame, intervals: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Uplift models by outcome: area measures, the paired difference from the response ranking, and stability (null without ``summary``)."""
    above = intervals.where("metric = 'qini_minus_response'").select("outcome_name", "model_name", F.col("estimate").alias("qini_minus_response"), F.col("ci_lower").alias("qini_minus_response_ci_lower"), F.col("ci_upper").alias("qini_minus_response_ci_upper"))
    own = metrics.where(F.col("model_name").isin(UPLIFT_MODELS)).select("outcome_name", "model_name", _complexity().alias("complexity_rank"), "auuc", "qini")
    found = own.join(above, ["outcome_name", "model_name"])
    return found.join(summary, ["outcome_name", "model_name"]) if summary is not None else found.withColumns({c: F.lit(None).cast("double") for c in STABILITY})


def recommendations(comparison: DataFrame, intervals: DataFrame, table: DataFrame) -> DataFrame:
    """One row per outcome: the recommended uplift model, the ranking to deploy and its rate.

    Start from the highest Qini (ties: the simpler model).  Take the simplest model whose paired difference from it has a
    lower bound of 0 or below.  Deploy it if its Qini less the response ranking's has a lower bound above 0, else
    the response ranking; of the main rates that with the highest lower bound of the gain, then the highest gain.
    """
    best = Window.partitionBy("outcome_name").orderBy(F.desc("qini"), "complexity_rank")
    leader = comparison.withColumn("place", F.row_number().over(best)).where("place = 1").select("outcome_name", F.col("model_name").alias("point_qini_leader"), F.col("complexity_rank").alias("leader_rank"))
    simpler = F.regexp_extract("metric", "^qini_minus_(.*)$", 1)
    close = intervals.where("ci_lower <= 0").select("outcome_name", F.col("model_name").alias("point_qini_leader"), simpler.alias("simpler")).withColumn("rank", _complexity("simpler")).where("rank > 0")
    close = close.groupBy("outcome_name", "point_qini_leader").agg(F.min("rank").alias("rank"))
    chosen = leader.join(close, ["outcome_name", "point_qini_leader"], "left").withColumn("complexity_rank", F.least("leader_rank", F.coalesce("rank", "leader_rank")))
    chosen = chosen.select("outcome_name", "point_qini_leader", (F.col("complexity_rank") < F.col("leader_rank")).alias("simplicity_rule_applied"), "complexity_rank").join(comparison, ["outcome_name", "complexity_rank"])
    beats = F.col("qini_minus_response_ci_lower") > 0
    decided = chosen.withColumn("beats_response", beats).withColumn("deployment_ranking", F.when(beats, F.col("model_name")).otherwise(F.lit(RESPONSE_MODEL)))
    rates = table.where(F.col("percent").isin(curves.MAIN_PERCENTS)).withColumnRenamed("model_name", "deployment_ranking")
    order = Window.partitionBy("outcome_name").orderBy(F.col("incremental_gain_ci_lower").desc_nulls_last(), F.desc("cumulative_gain"))
    picked = decided.join(rates, ["outcome_name", "deployment_ranking"]).withColumn("place", F.row_number().over(order)).where("place = 1")
    return picked.select(
        "outcome_name", "point_qini_leader", F.col("model_name").alias("recommended_uplift_model"), "simplicity_rule_applied", "deployment_ranking", "beats_response",
        F.col("percent").alias("recommended_percent"), F.col("selected_rows").alias("selected_users"), F.col("cumulative_uplift").alias("selected_group_uplift"),
        F.col("cumulative_gain").alias("incremental_outcomes"), F.col("incremental_gain_ci_lower").alias("incremental_ci_lower"), F.col("incremental_gain_ci_upper").alias("incremental_ci_upper"),
        F.col("qini").alias("uplift_model_qini"), "qini_minus_response_ci_lower", "qini_minus_response_ci_upper", F.col("mean_spearman_rank_correlation").alias("mean_stability_rank_correlation"),
        F.col("mean_top_set_overlap").alias("mean_stability_top_set_overlap"),
    )


def cross_policies(rows: DataFrame, rankings: dict[str, str], fractions: list[float]) -> DataFrame:
    """Two policies, each ranked by one outcome's model, compared at each fraction.

    ``rankings`` maps the outcome whose policy it is to a model.  Columns: the rank correlation of the scores, the
    users that both select, and the effect and gain, with interval, of either policy on either outcome.
    """
    ours = {f"{o}:{m}": o for o, m in rankings.items()}
    own = rows.where(F.col("model_name").isin(list(ours)))
    first, second = ours
    wide = own.groupBy("source_row_id").agg(*[F.max(F.when(F.col("model_name") == m, F.col("score"))).alias(a) for m, a in ((first, "a"), (second, "b"))])
    corr = policy.spearman(wide, "a", "b").select("spearman_rank_correlation")
    overlap = policy.policy_overlap(own, first, second, fractions)
    outcomes = rows.where(F.col("model_name").isin(list(ours))).select("source_row_id", F.split("model_name", ":")[0].alias("measured"), "outcome")
    both = own.drop("outcome", "score").join(outcomes, "source_row_id").withColumn("model_name", F.concat_ws("/", F.split("model_name", ":")[0], "measured"))
    effects = policy.selected_effects(both, fractions)
    cells = [
        F.max(F.when(F.col("model_name") == f"{p}/{m}", F.col(c))).alias(f"{m}_{c}_using_{p}_policy") for p in rankings for m in rankings for c in ("uplift", "gain", "gain_ci_lower", "gain_ci_upper")
    ]
    names = [F.lit(m).alias(f"{o}_model") for o, m in rankings.items()]
    # a few rows on either side
    found = overlap.join(effects.groupBy("fraction").agg(*cells), "fraction").withColumn("k", F.lit(1)).join(F.broadcast(corr.withColumn("k", F.lit(1))), "k").drop("k")
    return found.select(*names, "*")
