"""Uplift learners on boosted trees, an analytic stratified learner, and diagnostics of probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import safe_ratio
from quern.operators import boosting
from quern.operators.audit import check_model_columns
from quern.operators.boosting import Boosting, Fit, Model
from quern.operators.ranking import average_ranks, running_counts
from quern.plans.experiment import FEATURES
from quern.sources.files import written

CLIP = 1e-9


def pseudo_outcome(treatment: Column, outcome: Column, mu0: Column, mu1: Column) -> Column:
    """Treated: outcome less the control response; control: the treated response less the outcome."""
    return F.when(treatment == 1, outcome - mu0).otherwise(mu1 - outcome)


def _outcome_label(outcome: str) -> Column:
    return F.col(outcome).cast("double")


def fit_learners(train: DataFrame, outcomes: str | list[str] = "visit", features: list[str] = FEATURES, *, validation: DataFrame | None = None, how: Boosting = Boosting()) -> dict[str, Model]:
    """The S, T, pooled X and response models of each outcome, named outcome:s and so on, grown side by side.

    With ``validation`` rows each stops by its own held-out loss and keeps its best round.  X models are grown after the two T models, whose predictions make
    their labels.
    """
    outcomes = [outcomes] if isinstance(outcomes, str) else outcomes
    check_model_columns(features, features)
    both = [*features, "treatment"]
    check_model_columns(both, features, treatment_allowed=True)
    needed = ["source_row_id", *both, *outcomes]
    train = written(train.select(*needed), "train")
    held = written(validation.select(*needed), "validation") if validation is not None else None
    arm = lambda t: F.col("treatment") == t
    first, second = [], []
    for o in outcomes:
        label = _outcome_label(o)
        first += [Fit(f"{o}:s", both, label), Fit(f"{o}:t0", features, label, arm(0)), Fit(f"{o}:t1", features, label, arm(1)), Fit(f"{o}:response", features, label)]
    edges = boosting.bin_edges(train, both, how.bins)
    models = boosting.fit(train, first, how, held=held, edges=edges)
    for o in outcomes:
        mu0, mu1 = (boosting.predicted(models[f"{o}:t{t}"]) for t in (0, 1))
        second.append(Fit(f"{o}:x", features, pseudo_outcome(F.col("treatment"), _outcome_label(o), mu0, mu1), logistic=False))
    return models | boosting.fit(train, second, how, held=held, edges=edges)


def score_learners(models: dict[str, Model], rows: DataFrame, outcome: str = "visit") -> DataFrame:
    """source_row_id and a score of every learner as a float; outcomes aren't read."""
    f = lambda name, **at: boosting.predicted(models[f"{outcome}:{name}"], at).cast("float")
    return rows.select(
        "source_row_id",
        (f("s", treatment=F.lit(1)) - f("s", treatment=F.lit(0))).alias("s_learner"),
        (f("t1") - f("t0")).alias("t_learner"),
        f("x").alias("x_learner"),
        f("response").alias("response_propensity"),
    )


def response_probabilities(models: dict[str, Model], rows: DataFrame, outcome: str = "visit") -> DataFrame:
    """(model_name, treatment, label, p): what each response model says of the rows as they were treated."""
    p = lambda name: boosting.predicted(models[f"{outcome}:{name}"])
    each = {"s_learner": p("s"), "t_learner": F.when(F.col("treatment") == 1, p("t1")).otherwise(p("t0")), "response_propensity": p("response")}
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), c.alias("p")) for m, c in each.items()])).alias("m")
    return rows.select("treatment", F.col(outcome).alias("label"), long).select("m.model_name", "treatment", "label", "m.p")


def save_models(models: dict[str, Model], path: str, spark) -> None:
    boosting.nodes_table(spark, models).write.mode("overwrite").parquet(path)


def load_models(path: str, spark) -> dict[str, Model]:
    return boosting.models_of(spark.read.parquet(path))


def stratified_responses(train: DataFrame, stratum: list[str], outcome: str = "visit") -> DataFrame:
    """Mean response per stratum and arm: mu0 and mu1, null where an arm is empty."""
    y = F.col(outcome).cast("long")
    arm = lambda t: safe_ratio(F.sum(F.when(F.col("treatment") == t, y)), F.count_if(F.col("treatment") == t))
    return train.groupBy(*stratum).agg(arm(0).alias("mu0"), arm(1).alias("mu1"))


def with_response(rows: DataFrame, strata: DataFrame, stratum: list[str]) -> DataFrame:
    return rows.join(strata, stratum).withColumn("factual", F.when(F.col("treatment") == 1, F.col("mu1")).otherwise(F.col("mu0")))


def probability_diagnostics(rows: DataFrame, by: list[str], label: str, p: str) -> DataFrame:
    """Log loss (probabilities clipped) and Brier score."""
    q = F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    y = F.col(label).cast("double")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"))


def roc_auc(rows: DataFrame, by: list[str], label: str, p: str) -> DataFrame:
    """Mann-Whitney with average ranks; rows without a probability are left out."""
    ranks = average_ranks(rows.select(*by, label, p).where(F.col(p).isNotNull()), p, by)
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    total = F.sum(F.when(F.col(label) == 1, F.col(f"{p}_rank")))
    return ranks.groupBy(*by).agg(F.try_divide(total - pos * (pos + 1) / 2, (pos * neg).cast("double")).alias("roc_auc"))


def average_precision(rows: DataFrame, by: list[str], label: str, p: str) -> DataFrame:
    """Sum over distinct thresholds of the step in recall times precision; rows without a probability are left out."""
    steps = running_counts(rows.where(F.col(p).isNotNull()).select(*by, p, label), p, by, [F.sum(F.col(label).cast("long")).alias("y")])
    totals = steps.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum("y").alias("total"))
    cum = steps.join(totals, by) if by else steps.withColumn("k", F.lit(1)).join(F.broadcast(totals.withColumn("k", F.lit(1))), "k")  # one row
    # from the greatest value down: all rows less those of lesser values
    cn, cy = F.col("n") - F.col("_before"), F.col("total") - F.col("_before_y")
    return cum.groupBy(*by).agg(F.sum(F.col("y") / F.col("total") * cy / cn).alias("average_precision"))


def score_diagnostics(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean, population deviation, least and greatest score."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.min(score).alias("least_score"), F.max(score).alias("greatest_score"), F.count_if(F.isnan(score)).alias("nan_scores")
    )
