"""Registry: every query of the engine over the driver's tables, and its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import streams
from quern.functions.scalar import Z_95, log_normal_tail_sql, tie_key_sql, with_tie_key
from quern.operators import artifacts, audit, boosting, bootstrap, curves, effects, learners, policy, ranking, segments
from quern.plans.experiment import EXPERIMENT_SQL, FEATURES, FLAGS, RESPONSE_MODEL, SCORES, UPLIFT_MODELS, experiment, scores, scores_sql
from quern.registry import ORACLES, QUERIES, query, rounded  # noqa: F401
from quern.sources.files import written
from quern.streaming.counters import ARM, arm_counters

SEED = 20260825
G = 20


def _ranked(spark: SparkSession, sf_dir: str, outcome: str = "visit", models: list[str] | None = None, seed: int = SEED) -> DataFrame:
    return ranking.ranked(scores(experiment(spark, sf_dir, items=False), outcome, models), seed=seed)


EXP = f"exp AS ({EXPERIMENT_SQL})"
SPLIT = (
    "md5_number_lower(concat_ws('|', '" + audit.SPLIT_SEED + "', " + ", ".join(f"CAST(CAST({f} AS BIGINT) AS VARCHAR)" for f in FEATURES) + ")) % 100"
)
PART = f"part AS (SELECT *, CASE WHEN {SPLIT} < 60 THEN 'train' WHEN {SPLIT} < 80 THEN 'validation' ELSE 'test' END AS data_partition FROM exp)"


def _rk(outcome: str = "visit", models: list[str] | None = None) -> str:
    return f"""{EXP}, sc AS ({scores_sql(outcome, models)}),
rk AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY score DESC, {tie_key_sql('source_row_id', SEED)}) - 1 AS rank, count(*) OVER (PARTITION BY model_name) AS n FROM sc)"""


_COUNTS = """count(*) FILTER (WHERE treatment = 0) AS n0, count(*) FILTER (WHERE treatment = 1) AS n1,
  count(*) FILTER (WHERE treatment = 0 AND outcome = 1) AS y0, count(*) FILTER (WHERE treatment = 1 AND outcome = 1) AS y1"""
_DIFF = f"""CASE WHEN n0 > 0 AND n1 > 0 THEN y0 / n0 END AS p0, CASE WHEN n0 > 0 AND n1 > 0 THEN y1 / n1 END AS p1"""


def _diff(source: str) -> str:
    """Rows of ``source`` with p0, p1, uplift, lo and hi."""
    return f"""(SELECT *, uplift - {Z_95!r} * se AS lo, uplift + {Z_95!r} * se AS hi FROM (
  SELECT *, p1 - p0 AS uplift, sqrt(greatest(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0, 0.0)) AS se FROM (SELECT *, {_DIFF} FROM {source})))"""


def _cells(groups: int) -> str:
    return f"SELECT model_name, CAST(least(rank * {groups} // n, {groups - 1}) AS INTEGER) AS bucket, {_COUNTS}, count(*) AS group_rows, sum(score) AS score_sum FROM rk GROUP BY ALL"


def curve_tail(groups: int = G) -> str:
    """CTEs after ``rk`` up to ``cv``, the cumulative curve, and ``mt``, its metrics."""
    run = ", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS {c}" for c in ("n0", "n1", "y0", "y1"))
    return f"""cl AS ({_cells(groups)}),
cm AS (SELECT model_name, bucket, {run} FROM cl WINDOW w AS (PARTITION BY model_name ORDER BY bucket)),
cv AS (SELECT model_name, (bucket + 1) / CAST({groups} AS DOUBLE) AS target_fraction, n0 + n1 AS selected_rows, n1, n0, p1, p0, uplift, (n0 + n1) * uplift AS gain, lo, hi FROM {_diff('cm')}),
ar AS (SELECT *, (gain + coalesce(lag(gain) OVER w, 0.0)) / 2 * (target_fraction - coalesce(lag(target_fraction) OVER w, 0.0)) AS area FROM cv WINDOW w AS (PARTITION BY model_name ORDER BY target_fraction)),
mt AS (SELECT model_name, auuc, auuc - 0.5 * endpoint_gain AS qini, endpoint_gain FROM (
  SELECT model_name, sum(area ORDER BY target_fraction) AS auuc, arg_max(gain, target_fraction) AS endpoint_gain FROM ar GROUP BY model_name))"""


def _curve(outcome: str = "visit", models: list[str] | None = None) -> str:
    return f"{_rk(outcome, models)}, {curve_tail()}"


def _flags(c: str, cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {c}"


# ---- data audit


@query(
    f"""WITH {EXP} SELECT count(*) AS rows, {_flags('missing_rows', ' OR '.join(f'{c} IS NULL' for c in FEATURES + FLAGS))},
  {_flags('invalid_binary_rows', ' OR '.join(f'{c} NOT IN (0, 1)' for c in FLAGS))}, {_flags('nonfinite_feature_rows', ' OR '.join(f'NOT isfinite({c})' for c in FEATURES))},
  {_flags('conversion_without_visit', 'conversion = 1 AND visit = 0')}, {_flags('exposed_controls', 'treatment = 0 AND exposure = 1')} FROM exp"""
)
def quality_checks(spark, sf_dir):
    return audit.quality_checks(experiment(spark, sf_dir))


@query(
    f"""WITH {EXP} SELECT count(*) AS rows, {_flags('missing_rows', ' OR '.join(f'{c} IS NULL' for c in FLAGS))},
  {', '.join(_flags(f'invalid_{c}', f'{c} NOT IN (0, 1)') for c in FLAGS)},
  {_flags('conversion_without_visit', 'conversion = 1 AND visit = 0')}, {_flags('exposed_controls', 'treatment = 0 AND exposure = 1')} FROM exp"""
)
def input_checks(spark, sf_dir):
    return audit.input_checks(experiment(spark, sf_dir, items=False))


@query(
    f"""WITH {EXP} SELECT treatment, count(*) AS rows, CAST(sum(visit) AS BIGINT) AS visit_positive, CAST(sum(conversion) AS BIGINT) AS conversion_positive, CAST(sum(exposure) AS BIGINT) AS exposed,
  sum(visit) / count(*) AS visit_rate, sum(conversion) / count(*) AS conversion_rate, sum(exposure) / count(*) AS exposure_rate FROM exp GROUP BY treatment"""
)
def arm_summary(spark, sf_dir):
    return audit.arm_summary(experiment(spark, sf_dir, items=False))


@query(
    f"""WITH {EXP} """
    + " UNION ALL ".join(
        f"""SELECT feature, round(m0, 6) AS control_mean, round(m1, 6) AS treatment_mean, round(smd, 9) AS smd, round(abs(smd), 9) AS absolute_smd FROM (
  SELECT '{f}' AS feature, m0, m1, (m1 - m0) / sqrt((v0 + v1) / 2) AS smd FROM (SELECT avg({f}) FILTER (WHERE treatment = 0) AS m0, avg({f}) FILTER (WHERE treatment = 1) AS m1,
  var_samp({f}) FILTER (WHERE treatment = 0) AS v0, var_samp({f}) FILTER (WHERE treatment = 1) AS v1 FROM exp))"""
        for f in FEATURES
    )
)
def feature_balance(spark, sf_dir):
    found = audit.feature_balance(experiment(spark, sf_dir))
    return rounded(rounded(found, 6, ("smd", "absolute_smd")), 9, ("control_mean", "treatment_mean"))


@query(
    f"""WITH {EXP}, c AS (SELECT {', '.join(f'{f} % 2 AS {f}' if f in ('f0', 'f1', 'f5', 'f6', 'f7', 'f8') else f for f in FEATURES)}, {', '.join(FLAGS)} FROM exp)
SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_identical_records
FROM (SELECT count(*) AS n FROM c GROUP BY {', '.join(FEATURES + FLAGS)} HAVING count(*) > 1)"""
)
def duplicate_summary(spark, sf_dir):
    """All 16 columns; those of many values are taken modulo 2, so that there are duplicates to count."""
    view = experiment(spark, sf_dir)
    coarse = [(F.col(f) % 2).alias(f) if f in ("f0", "f1", "f5", "f6", "f7", "f8") else F.col(f) for f in FEATURES]
    return audit.duplicate_summary(view.select(*coarse, *FLAGS), [*FEATURES, *FLAGS])


@query(f"WITH {EXP}, {PART} SELECT source_row_id, data_partition FROM part")
def feature_hash_split(spark, sf_dir):
    return audit.with_partition(experiment(spark, sf_dir)).select("source_row_id", "data_partition")


@query(f"WITH {EXP}, {PART} SELECT count(*) AS rows, count(*) FILTER (WHERE source_row_id % 101 = 7 AND data_partition <> 'test' OR source_row_id % 211 = 9 AND source_row_id % 101 <> 7) AS mismatches FROM part")
def split_mismatches(spark, sf_dir):
    """Labels that differ from what the hash says: every 101st row's was set to test, every 211th's to null."""
    label = F.when(F.col("source_row_id") % 101 == 7, F.lit("test")).when(F.col("source_row_id") % 211 != 9, F.col("data_partition"))
    return audit.split_mismatches(audit.with_partition(experiment(spark, sf_dir)).withColumn("data_partition", label))


@query(
    f"""WITH {EXP}, {PART} SELECT data_partition, treatment, count(*) AS rows, CAST(sum(visit) AS BIGINT) AS visit_positive, CAST(sum(conversion) AS BIGINT) AS conversion_positive
FROM part GROUP BY ALL"""
)
def partition_summary(spark, sf_dir):
    return audit.partition_summary(audit.with_partition(experiment(spark, sf_dir)))


@query(
    f"""WITH {EXP} SELECT rows, distinct_ids, least_id, greatest_id, rows = distinct_ids AND least_id = 0 AND greatest_id = rows - 1 AS dense
FROM (SELECT count(*) AS rows, count(DISTINCT source_row_id) AS distinct_ids, min(source_row_id) AS least_id, max(source_row_id) AS greatest_id FROM exp)"""
)
def id_density(spark, sf_dir):
    return audit.id_density(experiment(spark, sf_dir, items=False))


@query(f"WITH {EXP} SELECT source_row_id, treatment, visit FROM exp WHERE source_row_id % 10000 < 500")
def systematic_sample(spark, sf_dir):
    return audit.systematic_sample(experiment(spark, sf_dir, items=False), 0.05).select("source_row_id", "treatment", "visit")


@query(
    f"""WITH {EXP} SELECT CASE WHEN treatment = 0 THEN 'Control' WHEN exposure = 0 THEN 'Assigned, unexposed' ELSE 'Assigned, exposed' END AS delivery_group,
  count(*) AS n, sum(exposure) / count(*) AS exposure_rate, sum(visit) / count(*) AS visit_rate, sum(conversion) / count(*) AS conversion_rate FROM exp GROUP BY 1"""
)
def exposure_appendix(spark, sf_dir):
    return effects.exposure_groups(experiment(spark, sf_dir, items=False))


@query(
    f"""WITH {EXP}, t AS (SELECT * FROM exp WHERE treatment = 1)
SELECT 1 AS stage, 'assigned' AS stage_name, count(*) AS n FROM t UNION ALL SELECT 2, 'exposed', count(*) FROM t WHERE exposure = 1
UNION ALL SELECT 3, 'visited', count(*) FROM t WHERE visit = 1 UNION ALL SELECT 4, 'converted', count(*) FROM t WHERE conversion = 1"""
)
def delivery_stages(spark, sf_dir):
    return effects.delivery_stages(experiment(spark, sf_dir, items=False))


# ---- average effects

_OC = " UNION ALL ".join(f"SELECT '{o}' AS outcome, {_COUNTS.replace('outcome = 1', f'{o} = 1')} FROM exp" for o in effects.OUTCOMES)
_LOG_SE = "sqrt(1.0 / y1 - 1.0 / n1 + 1.0 / y0 - 1.0 / n0)"


def _oc(spark, sf_dir):
    return effects.outcome_cells(experiment(spark, sf_dir, items=False))


@query(
    f"""WITH {EXP}, oc AS ({_OC}), r AS (SELECT *, y0 / n0 AS p0, y1 / n1 AS p1 FROM oc),
s AS (SELECT *, p1 - p0 AS lift, sqrt(greatest(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0, 0.0)) AS se, {_LOG_SE} AS log_se FROM r)
SELECT outcome, n0 AS control_n, n1 AS treatment_n, y0 AS control_positive, y1 AS treatment_positive, round(p0, 9) AS control_rate, round(p1, 9) AS treatment_rate,
  round(lift, 9) AS absolute_lift, round(se, 9) AS absolute_lift_se, round(lift - 1.96 * se, 9) AS absolute_ci_lower, round(lift + 1.96 * se, 9) AS absolute_ci_upper,
  round(lift / p0, 9) AS relative_lift, round(exp(ln(p1 / p0) - 1.96 * log_se) - 1, 9) AS relative_ci_lower, round(exp(ln(p1 / p0) + 1.96 * log_se) - 1, 9) AS relative_ci_upper,
  round(n1 * lift, 9) AS incremental_treated, round((n0 + n1) * lift, 9) AS incremental_all FROM s"""
)
def effect_summary(spark, sf_dir):
    return rounded(effects.effect_summary(_oc(spark, sf_dir)))


@query(
    f"""WITH {EXP}, oc AS ({_OC}), a AS (SELECT outcome, 0 AS treatment, n0 AS n, y0 AS positive FROM oc UNION ALL SELECT outcome, 1, n1, y1 FROM oc), r AS (SELECT *, positive / n AS rate FROM a)
SELECT outcome, treatment, n, positive, rate, round(greatest(0.0, rate - 1.96 * sqrt(rate * (1 - rate) / n)), 9) AS ci_lower, round(least(1.0, rate + 1.96 * sqrt(rate * (1 - rate) / n)), 9) AS ci_upper FROM r"""
)
def arm_rate_ci(spark, sf_dir):
    return rounded(effects.arm_rate_intervals(_oc(spark, sf_dir)), but=("rate",))


_Z = f"""oc AS ({_OC}), zt AS (SELECT outcome, (y1 / n1 - y0 / n0) / sqrt((y0 + y1) / (n0 + n1) * (1 - (y0 + y1) / (n0 + n1)) * (1.0 / n1 + 1.0 / n0)) AS z FROM oc),
zp AS (SELECT outcome, z, ln(2.0) + {log_normal_tail_sql('z')} AS log_p FROM zt)"""


@query(f"WITH {EXP}, {_Z} SELECT outcome, round(z, 9) AS z_statistic, round(log_p / ln(10.0), 6) AS log10_p_value FROM zp")
def z_test(spark, sf_dir):
    found = effects.z_tests(_oc(spark, sf_dir))
    return found.select("outcome", F.round("z_statistic", 9).alias("z_statistic"), F.round("log10_p_value", 6).alias("log10_p_value"))


@query(
    f"""WITH {EXP}, {_Z}, pv AS (SELECT outcome, z, log_p, CASE WHEN log_p > -708.3964185322641 THEN exp(log_p) ELSE 0.0 END AS p FROM zp),
hl AS (SELECT *, max(step) OVER (ORDER BY p, outcome ROWS UNBOUNDED PRECEDING) AS holm FROM (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, outcome) + 1) * p) AS step FROM pv))
SELECT outcome, round(z, 9) AS z_statistic, round(log_p / ln(10.0), 6) AS log10_p_value, round(p, 9) AS p_value, CASE WHEN p > 0 THEN printf('%.3e', p) ELSE '<1e' || CAST(CAST(floor(log_p / ln(10.0)) + 1 AS BIGINT) AS VARCHAR) END AS p_value_display, round(holm, 9) AS holm_p_value, holm < 0.05 AS reject FROM hl"""
)
def z_test_p_values(spark, sf_dir):
    """With p values, Holm's adjustment and the display form."""
    return rounded(rounded(effects.holm(effects.z_tests(_oc(spark, sf_dir))), 6, ("z_statistic", "p_value", "holm_p_value")), 9)


_FAMILY = "SELECT model_name || ':' || CAST(bucket AS VARCHAR) AS outcome, CAST((y1 * 37 + n0 * 11) % 1000 AS DOUBLE) / 20000 AS p_value FROM cl"


@query(
    f"""WITH {_rk(models=['s_learner'])}, cl AS ({_cells(10)}), fam AS ({_FAMILY}),
st AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, outcome) + 1) * p_value) AS step FROM fam)
SELECT outcome, p_value, max(step) OVER (ORDER BY p_value, outcome ROWS UNBOUNDED PRECEDING) AS holm_p_value, max(step) OVER (ORDER BY p_value, outcome ROWS UNBOUNDED PRECEDING) < 0.05 AS reject FROM st"""
)
def holm_adjust(spark, sf_dir):
    """Holm's adjustment of a family of ten p values made from counts."""
    cells = curves.cells(_ranked(spark, sf_dir, models=["s_learner"]), 10)
    p = ((F.col("y1") * 37 + F.col("n0") * 11) % 1000).cast("double") / 20000
    return effects.holm(cells.select(F.concat_ws(":", "model_name", F.col("bucket").cast("string")).alias("outcome"), p.alias("p_value")))


@query(
    f"""WITH {EXP}, oc AS ({_OC} UNION ALL SELECT 'exposure', {_COUNTS.replace('outcome = 1', 'exposure = 1')} FROM exp), l AS (SELECT outcome, y1 / n1 - y0 / n0 AS lift FROM oc)
SELECT outcome, lift AS itt_lift, (SELECT lift FROM l WHERE outcome = 'exposure') AS exposure_difference, lift / (SELECT lift FROM l WHERE outcome = 'exposure') AS wald_ratio FROM l WHERE outcome <> 'exposure'"""
)
def wald_ratio(spark, sf_dir):
    return effects.complier_ratio(experiment(spark, sf_dir, items=False))


# ---- rankings


@query(f"WITH {EXP} SELECT source_row_id, CAST({tie_key_sql('source_row_id', SEED)} AS VARCHAR) AS tie_key FROM exp")
def tie_keys(spark, sf_dir):
    """The unsigned key as text."""
    key = F.expr("shiftrightunsigned(k, 1)").cast("decimal(20,0)") * 2 + F.expr("k & 1")
    rows = with_tie_key(experiment(spark, sf_dir, items=False).select("source_row_id"), "source_row_id", SEED, "t").select("source_row_id", F.col("t").bitwiseXOR(F.lit(-(1 << 63))).alias("k"))
    return rows.select("source_row_id", key.cast("decimal(20,0)").cast("string").alias("tie_key"))


@query(f"WITH {_rk()} SELECT model_name, source_row_id, rank, CAST(least(rank * {G} // n, {G - 1}) AS INTEGER) AS bucket FROM rk")
def rank_groups(spark, sf_dir):
    return _ranked(spark, sf_dir).select("model_name", "source_row_id", "rank", ranking.bucket(G).alias("bucket"))


@query(
    f"""WITH {_rk()}, cl AS ({_cells(10)}) SELECT model_name, bucket + 1 AS score_group, bucket * 100.0::DOUBLE / 10 AS population_start_pct, (bucket + 1) * 100.0::DOUBLE / 10 AS population_end_pct, group_rows,
  n1 AS treatment_rows, n0 AS control_rows, p1 AS treatment_rate, p0 AS control_rate, uplift AS observed_uplift, round(score_sum / group_rows, 6) AS mean_predicted_score,
  group_rows * uplift AS incremental_outcomes, lo AS uplift_ci_lower, hi AS uplift_ci_upper FROM {_diff('cl')}"""
)
def group_effects(spark, sf_dir):
    return curves.group_effects(_ranked(spark, sf_dir), 10).withColumn("mean_predicted_score", F.round("mean_predicted_score", 6))


def _gain(spark, sf_dir, outcome="visit", models=None):
    return curves.cumulative_gain(_ranked(spark, sf_dir, outcome, models), G)


def _cumulative_sql(outcome: str) -> str:
    return f"""WITH {_curve(outcome)} SELECT model_name, target_fraction, selected_rows / max(selected_rows) OVER m AS selected_population_fraction, selected_rows, n1 AS treatment_rows, n0 AS control_rows,
  p1 AS treatment_rate, p0 AS control_rate, uplift AS cumulative_uplift, gain AS cumulative_gain, lo AS uplift_ci_lower, hi AS uplift_ci_upper,
  endpoint_gain, target_fraction * endpoint_gain AS random_gain, gain - target_fraction * endpoint_gain AS gain_above_random
FROM cv JOIN mt USING (model_name) WINDOW m AS (PARTITION BY model_name)"""


@query(_cumulative_sql("visit"))
def cumulative_gain(spark, sf_dir):
    return _gain(spark, sf_dir)


@query(_cumulative_sql("conversion"))
def cumulative_gain_conversion(spark, sf_dir):
    return _gain(spark, sf_dir, "conversion")


_METRICS = "SELECT model_name, round(auuc, 6) AS auuc, round(qini, 6) AS qini, endpoint_gain"


@query(f"WITH {_curve()} {_METRICS} FROM mt")
def auuc_qini(spark, sf_dir):
    return rounded(curves.curve_metrics(_gain(spark, sf_dir)), 6, ("endpoint_gain",))


@query(f"WITH {_curve()} {_METRICS} FROM mt UNION ALL SELECT 'random_uniform', round(0.5 * max(endpoint_gain), 6), 0.0::DOUBLE, max(endpoint_gain) FROM mt")
def random_baseline(spark, sf_dir):
    return rounded(curves.with_random(curves.curve_metrics(_gain(spark, sf_dir))), 6, ("endpoint_gain",))


@query(f"WITH {_curve()} SELECT count(*) AS models, max(endpoint_gain) AS greatest, min(endpoint_gain) AS least, max(endpoint_gain) - min(endpoint_gain) <= 1e-8 AS common_endpoint FROM mt")
def endpoint_check(spark, sf_dir):
    return curves.endpoint_check(curves.curve_metrics(_gain(spark, sf_dir)))


@query(
    f"""WITH {_curve()}, oc AS (SELECT {_COUNTS.replace('outcome = 1', 'visit = 1')} FROM exp)
SELECT model_name, round(endpoint_gain, 6) AS endpoint_gain, round((n0 + n1) * (y1 / n1 - y0 / n0), 6) AS expected_endpoint, abs(endpoint_gain - (n0 + n1) * (y1 / n1 - y0 / n0)) <= 1e-6 AS agrees FROM mt, oc"""
)
def ate_sanity(spark, sf_dir):
    """Every curve ends at the number of rows times the average effect."""
    effect = effects.effect_summary(effects.outcome_cells(experiment(spark, sf_dir, items=False), ["visit"])).select(F.col("incremental_all").alias("expected_endpoint"), F.lit(True).alias("k"))
    found = curves.curve_metrics(_gain(spark, sf_dir)).select("model_name", "endpoint_gain", F.lit(True).alias("k")).join(F.broadcast(effect), "k")  # one row
    return rounded(found.select("model_name", "endpoint_gain", "expected_endpoint", (F.abs(F.col("endpoint_gain") - F.col("expected_endpoint")) <= 1e-6).alias("agrees")), 6)


@query(
    f"""WITH {_curve(models=['s_learner'])}, e AS (SELECT max(selected_rows) AS n, arg_max(gain, target_fraction) AS g FROM cv)
SELECT 'target_none' AS reference, 0.0::DOUBLE AS target_fraction, 0::BIGINT AS selected_rows, 0.0::DOUBLE AS gain FROM e UNION ALL SELECT 'target_all', 1.0::DOUBLE, n, g FROM e
UNION ALL SELECT 'random', q / 100, CAST(n * q // 100 AS BIGINT), q / 100 * g FROM e, (VALUES (10), (20), (30)) t(q)"""
)
def targeting_references(spark, sf_dir):
    """What no, full and random targeting would gain."""
    end = _gain(spark, sf_dir, models=["s_learner"]).where("target_fraction = 1").select(F.col("selected_rows").alias("n"), F.col("cumulative_gain").alias("g"))
    row = lambda name, f, n, g: F.struct(F.lit(name).alias("reference"), f.alias("target_fraction"), n.cast("long").alias("selected_rows"), g.alias("gain"))
    n, g = F.col("n"), F.col("g")
    rows = [row("target_none", F.lit(0.0), F.lit(0), F.lit(0.0)), row("target_all", F.lit(1.0), n, g)]
    rows += [row("random", F.lit(q) / 100, F.expr(f"n * {q} div 100"), F.lit(q) / 100 * g) for q in curves.MAIN_PERCENTS]
    return end.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_PERCENT = "CAST(round_even(target_fraction * 100, 0) AS INTEGER)"
_REPORT = ", ".join(map(str, curves.REPORT_PERCENTS))


@query(f"WITH {_curve()} SELECT model_name, {_PERCENT} AS percent, selected_rows, uplift AS cumulative_uplift, gain AS cumulative_gain FROM cv WHERE {_PERCENT} IN ({_REPORT})")
def policy_summary(spark, sf_dir):
    return policy.policy_summary(_gain(spark, sf_dir)).select("model_name", "percent", "selected_rows", "cumulative_uplift", "cumulative_gain")


@query(
    f"""WITH {_curve()} SELECT c.model_name, {_PERCENT.replace('target', 'c.target')} AS percent, c.gain - r.gain AS gain_above_response FROM cv c JOIN cv r ON r.model_name = 'response_propensity' AND r.target_fraction = c.target_fraction
WHERE {_PERCENT.replace('target', 'c.target')} IN ({_REPORT})"""
)
def gain_above_response(spark, sf_dir):
    return policy.policy_summary(_gain(spark, sf_dir)).select("model_name", "percent", "gain_above_response")


@query(
    f"""WITH {_curve()}, pl AS (SELECT *, list_position({UPLIFT_MODELS}, model_name) AS place FROM mt)
SELECT a.model_name AS later_model, b.model_name AS earlier_model, round(a.auuc - b.auuc, 6) AS auuc_difference, round(a.qini - b.qini, 6) AS qini_difference FROM pl a JOIN pl b ON a.place > b.place WHERE b.place > 0"""
)
def pairwise_model_qini(spark, sf_dir):
    return rounded(policy.pairwise_differences(curves.curve_metrics(_gain(spark, sf_dir))), 6)


@query(
    f"""WITH {_rk()}, cl AS ({_cells(10)}), g AS (SELECT model_name, CAST(group_rows AS DOUBLE) AS w, score_sum / group_rows AS x, uplift AS y FROM {_diff('cl')} WHERE p1 IS NOT NULL),
c AS (SELECT *, sum(w * x) OVER m / sum(w) OVER m AS mx, sum(w * y) OVER m / sum(w) OVER m AS my FROM g WINDOW m AS (PARTITION BY model_name)),
s AS (SELECT model_name, count(*) AS k, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy, max(mx) AS mx, max(my) AS my, max(x) AS hi, min(x) AS lo FROM c GROUP BY model_name),
f AS (SELECT *, CASE WHEN NOT (k < 2 OR hi - lo <= 1e-8 + 1e-5 * abs(lo)) THEN sxy / sxx END AS b FROM s)
SELECT model_name, round(my - b * mx, 7) AS intercept, round(b * 1e6, 7) AS slope_per_million, false AS ranking_changed FROM f"""
)
def calibration(spark, sf_dir):
    found = curves.calibration(curves.group_effects(_ranked(spark, sf_dir), 10))
    return found.select("model_name", F.round("intercept", 7).alias("intercept"), F.round(F.col("slope") * 1e6, 7).alias("slope_per_million"), "ranking_changed")


def _top(f: float) -> str:
    return f"rank < greatest(1, CAST(round_even(n * {f!r}::DOUBLE, 0) AS BIGINT))"


_TOPS = " UNION ALL ".join(f"SELECT *, {f!r}::DOUBLE AS fraction FROM rk WHERE {_top(f)}" for f in (0.1, 0.2, 0.3))


@query(
    f"""WITH {_rk()}, tp AS ({_TOPS}), cl AS (SELECT model_name, fraction, {_COUNTS} FROM tp GROUP BY ALL)
SELECT model_name, fraction, n0 + n1 AS selected_rows, uplift, (n0 + n1) * uplift AS gain, (n0 + n1) * lo AS gain_ci_lower, (n0 + n1) * hi AS gain_ci_upper FROM {_diff('cl')}"""
)
def top_fraction_policy(spark, sf_dir):
    return policy.selected_effects(_ranked(spark, sf_dir), [0.1, 0.2, 0.3])


@query(
    f"""WITH {_rk(models=['s_learner', 't_learner'])}, tp AS ({_TOPS}), b AS (SELECT fraction, source_row_id, count(*) FILTER (WHERE model_name = 's_learner') AS a, count(*) FILTER (WHERE model_name = 't_learner') AS b, max(n) AS n FROM tp GROUP BY ALL)
SELECT fraction, count(*) FILTER (WHERE a > 0 AND b > 0) AS shared_rows, count(*) FILTER (WHERE a > 0) AS selected_rows, 100.0::DOUBLE * count(*) FILTER (WHERE a > 0 AND b > 0) / count(*) FILTER (WHERE a > 0) AS shared_pct_of_selected,
  100.0::DOUBLE * count(*) FILTER (WHERE a > 0 AND b > 0) / max(n) AS shared_pct_of_population FROM b GROUP BY fraction"""
)
def policy_overlap(spark, sf_dir):
    return policy.policy_overlap(_ranked(spark, sf_dir, models=["s_learner", "t_learner"]), "s_learner", "t_learner", [0.1, 0.2, 0.3])


@query(
    f"""WITH {_rk(models=['s_learner', 'x_learner'])}, tp AS ({_TOPS}), o AS (SELECT t.model_name AS policy_model, fraction, t.treatment, u.name AS measured, CASE u.name WHEN 'visit' THEN e.visit ELSE e.conversion END AS outcome
  FROM tp t JOIN exp e USING (source_row_id), (VALUES ('visit'), ('conversion')) u(name)), cl AS (SELECT policy_model, fraction, measured, {_COUNTS} FROM o GROUP BY ALL)
SELECT policy_model, measured, fraction, uplift, (n0 + n1) * uplift AS gain FROM {_diff('cl')}"""
)
def cross_policy_effects(spark, sf_dir):
    """Each of two policies, measured on either outcome: ranks are found once."""
    models = ["s_learner", "x_learner"]
    view = experiment(spark, sf_dir, items=False)
    both = ranking.ranked(scores(view, "visit", models), seed=SEED)
    outcomes = view.select("source_row_id", F.explode(F.array(*[F.struct(F.lit(o).alias("measured"), F.col(o).alias("y")) for o in effects.OUTCOMES])).alias("o")).select("source_row_id", "o.*")
    rows = both.drop("outcome").join(outcomes, "source_row_id").select(F.concat_ws("/", "model_name", "measured").alias("model_name"), "treatment", F.col("y").alias("outcome"), "rank", "n")
    found = policy.selected_effects(rows, [0.1, 0.2, 0.3])
    return found.select(F.split("model_name", "/")[0].alias("policy_model"), F.split("model_name", "/")[1].alias("measured"), "fraction", "uplift", "gain")


def _rank_avg(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query(f"WITH {EXP}, r AS (SELECT {_rank_avg('f0')} AS a, {_rank_avg('f3')} AS b FROM exp) SELECT round(corr(a, b), 9) AS spearman_rank_correlation, count(*) AS rows FROM r")
def spearman(spark, sf_dir):
    """Rank correlation of a nearly tie-free and a heavily tied score."""
    return rounded(policy.spearman(experiment(spark, sf_dir, items=False), "f0", "f3"))


@query(
    f"""WITH {_rk(models=['s_learner', 'x_learner'])}, w AS (SELECT source_row_id, max(score) FILTER (WHERE model_name = 's_learner') AS s, max(score) FILTER (WHERE model_name = 'x_learner') AS x,
  bool_or(model_name = 's_learner' AND {_top(0.1)}) AS ts, bool_or(model_name = 'x_learner' AND {_top(0.1)}) AS tx FROM rk GROUP BY 1), r AS (SELECT {_rank_avg('s')} AS a, {_rank_avg('x')} AS b, ts, tx FROM w)
SELECT round(corr(a, b), 9) AS spearman_rank_correlation, count(*) FILTER (WHERE ts AND tx) / count(*) FILTER (WHERE ts) AS top_set_overlap FROM r"""
)
def stability_overlap(spark, sf_dir):
    """A ranking against its alternate: rank correlation and the share of the top tenth in both."""
    both = _ranked(spark, sf_dir, models=["s_learner", "x_learner"])
    wide = both.groupBy("source_row_id").agg(*[F.max(F.when(F.col("model_name") == m, F.col("score"))).alias(m) for m in ("s_learner", "x_learner")])
    corr = policy.spearman(wide, "s_learner", "x_learner").select("spearman_rank_correlation", F.lit(0.1).alias("fraction"))
    overlap = policy.policy_overlap(both, "s_learner", "x_learner", [0.1]).select("fraction", (F.col("shared_rows") / F.col("selected_rows")).alias("top_set_overlap"))
    return rounded(corr.join(overlap, "fraction").select("spearman_rank_correlation", "top_set_overlap"), but=("top_set_overlap",))


# ---- segments

_EDGE_ROWS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {b} AS bins, list_sort(list_distinct(quantile_cont({f}, {[i / b for i in range(1, b)]}))) AS edges FROM part WHERE data_partition = 'train'" for f in FEATURES for b in segments.BINS
)
_EDGES = f"ed AS (SELECT feature, bins, CAST(edges AS FLOAT[]) AS edges FROM ({_EDGE_ROWS}))"
_LONG = "lg AS (SELECT e.feature, e.bins, len(list_filter(e.edges, lambda x: x <= CAST(v.value AS FLOAT))) AS segment, v.treatment, v.outcome, v.source_row_id, v.data_partition FROM ({}) v JOIN ed e ON v.feature = e.feature)".format(
    " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, treatment, visit AS outcome, source_row_id, data_partition FROM part" for f in FEATURES)
)
_SEGS = f"""{EXP}, {PART}, {_EDGES}, {_LONG},
sg AS (SELECT feature, bins, segment, {_COUNTS} FROM lg WHERE data_partition = 'train' GROUP BY ALL),
ef AS (SELECT feature, bins, segment, n0 + n1 AS rows, coalesce(CASE WHEN n0 > 0 AND n1 > 0 THEN y1 / n1 - y0 / n0 END, sum(y1) OVER c / sum(n1) OVER c - sum(y0) OVER c / sum(n0) OVER c) AS effect FROM sg WINDOW c AS (PARTITION BY feature, bins))"""


def _split(spark, sf_dir):
    """The view with its partition, written once for the jobs that read it several times."""
    return written(audit.with_partition(experiment(spark, sf_dir)), "experiment")


@query(f"WITH {EXP}, {PART}, {_EDGES} SELECT feature, bins, array_to_string(list_transform(edges, lambda x: CAST(CAST(round(x) AS BIGINT) AS VARCHAR)), ',') AS edges FROM ed")
def segment_edges(spark, sf_dir):
    """Edges, shown to the nearest integer."""
    edges = segments.quantile_edges(audit.with_partition(experiment(spark, sf_dir)).where("data_partition = 'train'"))
    return edges.select("feature", "bins", F.array_join(F.transform("edges", lambda x: F.round(x).cast("long").cast("string")), ",").alias("edges"))


@query(f"WITH {_SEGS} SELECT feature, bins, CAST(segment AS INTEGER) AS segment, rows, effect FROM ef")
def segment_effects(spark, sf_dir):
    train = _split(spark, sf_dir).where("data_partition = 'train'")
    return segments.segment_effects(segments.long_segments(train, segments.quantile_edges(train), "visit"))


_CAND = "concat_ws(':', feature, bins)"


@query(
    f"""WITH {_SEGS}, sc AS (SELECT concat_ws(':', l.feature, l.bins) AS model_name, l.source_row_id, coalesce(e.effect, m.mean) AS score, l.treatment, l.outcome FROM lg l
  LEFT JOIN ef e ON e.feature = l.feature AND e.bins = l.bins AND e.segment = l.segment JOIN (SELECT feature, bins, sum(effect * rows) / sum(rows) AS mean FROM ef GROUP BY ALL) m ON m.feature = l.feature AND m.bins = l.bins WHERE data_partition = 'validation'),
rk AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY score DESC, {tie_key_sql('source_row_id', SEED)}) - 1 AS rank, count(*) OVER (PARTITION BY model_name) AS n FROM sc), """
    + _curve().split("cl AS", 1)[1].join(["cl AS", ""])
    + " SELECT string_split(model_name, ':')[1] AS feature, CAST(string_split(model_name, ':')[2] AS INTEGER) AS bins, round(auuc, 6) AS validation_auuc, round(qini, 6) AS validation_qini, (SELECT count(*) FROM ef WHERE concat_ws(':', feature, bins) = model_name) AS actual_bins FROM mt"
)
def segment_selection(spark, sf_dir):
    view = _split(spark, sf_dir)
    found = segments.segment_selection(view.where("data_partition = 'train'"), view.where("data_partition = 'validation'"), "visit", groups=G, seed=SEED)
    return rounded(found, 6)


@query(f"WITH {EXP}, {PART}, c AS (SELECT {_COUNTS.replace('outcome = 1', 'visit = 1')} FROM part WHERE data_partition <> 'test') SELECT p.source_row_id, y1 / n1 - y0 / n0 AS score FROM part p, c WHERE data_partition = 'test'")
def constant_baseline(spark, sf_dir):
    """The overall effect of train and validation as every test row's score."""
    view = _split(spark, sf_dir)
    effect = segments.constant_effect(view.where("data_partition <> 'test'")).withColumn("k", F.lit("test"))
    return view.where("data_partition = 'test'").join(F.broadcast(effect), F.col("data_partition") == F.col("k")).select("source_row_id", F.col("effect").alias("score"))  # one row


# ---- learners and diagnostics

_STRATUM = ["f3", "f10"]
_STRATA = f"""{EXP}, {PART}, mu AS (SELECT f3, f10, sum(visit) FILTER (WHERE treatment = 0) / count(*) FILTER (WHERE treatment = 0) AS mu0, sum(visit) FILTER (WHERE treatment = 1) / count(*) FILTER (WHERE treatment = 1) AS mu1 FROM part WHERE data_partition = 'train' GROUP BY ALL),
wr AS (SELECT p.source_row_id, p.f0, p.f10, p.treatment, p.visit, mu0, mu1, CASE WHEN treatment = 1 THEN mu1 ELSE mu0 END AS factual FROM part p JOIN mu USING (f3, f10) WHERE data_partition = 'validation')"""


def _responses(spark, sf_dir):
    view = _split(spark, sf_dir)
    return learners.with_response(view.where("data_partition = 'validation'"), learners.stratified_responses(view.where("data_partition = 'train'"), _STRATUM), _STRATUM)


@query(f"WITH {_STRATA} SELECT source_row_id, CASE WHEN treatment = 1 THEN visit - mu0 ELSE mu1 - visit END AS pseudo_outcome FROM wr")
def x_pseudo_outcome(spark, sf_dir):
    rows = _responses(spark, sf_dir)
    return rows.select("source_row_id", learners.pseudo_outcome(F.col("treatment"), F.col("visit"), F.col("mu0"), F.col("mu1")).alias("pseudo_outcome"))


@query(
    f"""WITH {_STRATA}, x AS (SELECT f10, avg(CASE WHEN treatment = 1 THEN visit - mu0 ELSE mu1 - visit END) AS x FROM wr GROUP BY f10)
SELECT source_row_id, mu1 - mu0 AS t_score, round(x, 9) AS x_score, factual AS response_score FROM wr JOIN x USING (f10)"""
)
def stratified_learner_scores(spark, sf_dir):
    """The learners' algebra on mean responses per stratum: S and T coincide, X pools the pseudo-outcomes."""
    rows = written(_responses(spark, sf_dir), "responses")
    pooled = rows.groupBy("f10").agg(F.avg(learners.pseudo_outcome(F.col("treatment"), F.col("visit"), F.col("mu0"), F.col("mu1"))).alias("x"))
    return rows.join(pooled, "f10").select("source_row_id", (F.col("mu1") - F.col("mu0")).alias("t_score"), F.round("x", 9).alias("x_score"), F.col("factual").alias("response_score"))


_Q = "least(greatest(factual, 1e-9), 1 - 1e-9)"


@query(f"WITH {_STRATA} SELECT treatment, count(*) AS rows, round(avg(-(visit * ln({_Q}) + (1 - visit) * ln(1 - {_Q}))), 9) AS log_loss, round(avg((factual - visit) * (factual - visit)), 9) AS brier FROM wr GROUP BY treatment")
def log_loss_brier(spark, sf_dir):
    return rounded(learners.probability_diagnostics(_responses(spark, sf_dir), ["treatment"], "visit", "factual"))


@query(
    f"""WITH {_STRATA}, r AS (SELECT treatment, visit, rank() OVER (PARTITION BY treatment ORDER BY factual) + (count(*) OVER (PARTITION BY treatment, factual) - 1) / 2 AS r FROM wr WHERE factual IS NOT NULL)
SELECT treatment, round((sum(r) FILTER (WHERE visit = 1) - sum(visit) * (sum(visit) + 1) / 2) / (sum(visit) * (count(*) - sum(visit))), 9) AS roc_auc FROM r GROUP BY treatment"""
)
def roc_auc(spark, sf_dir):
    return rounded(learners.roc_auc(_responses(spark, sf_dir), ["treatment"], "visit", "factual"))


@query(
    f"""WITH {_STRATA}, s AS (SELECT treatment, factual, count(*) AS n, sum(visit) AS y FROM wr WHERE factual IS NOT NULL GROUP BY ALL),
c AS (SELECT treatment, y, sum(n) OVER w AS cn, sum(y) OVER w AS cy, sum(y) OVER (PARTITION BY treatment) AS t FROM s WINDOW w AS (PARTITION BY treatment ORDER BY factual DESC))
SELECT treatment, round(sum(y / t * cy / cn), 9) AS average_precision FROM c GROUP BY treatment"""
)
def average_precision(spark, sf_dir):
    return rounded(learners.average_precision(_responses(spark, sf_dir), ["treatment"], "visit", "factual"))


@query(
    f"""WITH {EXP}, sc AS ({scores_sql()}) SELECT model_name, count(*) AS rows, round(avg(score), 4) AS mean_score, round(stddev_pop(score), 4) AS std_score, min(score) AS least_score, max(score) AS greatest_score, count(*) FILTER (WHERE isnan(score)) AS nan_scores FROM sc GROUP BY model_name"""
)
def score_diagnostics(spark, sf_dir):
    return rounded(learners.score_diagnostics(scores(experiment(spark, sf_dir, items=False)), ["model_name"]), 4)


BOOST = boosting.Boosting(rounds=12, depth=3, rate=0.3, bins=16, l2=1.0, least_rows=20, rows=0.8, features=0.8, patience=3)


def boosted_sql(outcomes: list[str], how: boosting.Boosting = BOOST) -> str:
    """CTEs after ``part``: the same trees grown in SQL; ``gs`` has a row for each test row and outcome with every learner's score."""
    features = [*FEATURES, "treatment"]
    shares = ", ".join(f"{i / how.bins!r}" for i in range(1, how.bins))
    cuts = " UNION ALL ".join(f"SELECT '{f}' AS feature, list_sort(list_distinct(quantile_cont({f}::DOUBLE, [{shares}]))) AS edges FROM part WHERE data_partition = 'train'" for f in features)
    names, sources = {}, []
    kind = "CASE data_partition WHEN 'train' THEN 'train' WHEN 'validation' THEN 'held' END"
    cols = ", ".join(FEATURES)
    for o in outcomes:
        names |= {f"{o}:s": (features, True), f"{o}:t0": (FEATURES, True), f"{o}:t1": (FEATURES, True), f"{o}:response": (FEATURES, True)}
        for f, where in (("s", "true"), ("t0", "treatment = 0"), ("t1", "treatment = 1"), ("response", "true")):
            sources.append(f"SELECT '{o}:{f}' AS fit, source_row_id AS id, {kind} AS part, -1 AS variant, {o}::DOUBLE AS y, {cols}, treatment FROM part WHERE data_partition IN ('train', 'validation') AND {where}")
        for t in (0, 1):
            sources.append(f"SELECT '{o}:s', source_row_id, 'score', {t}, NULL, {cols}, {t} FROM part WHERE data_partition = 'test'")
            sources.append(f"SELECT '{o}:t{t}', source_row_id, 'score', 2, NULL, {cols}, treatment FROM part")
        sources.append(f"SELECT '{o}:response', source_row_id, 'score', 2, NULL, {cols}, treatment FROM part WHERE data_partition = 'test'")
    p = lambda m: f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-{m})))"
    of = lambda o, f, v, a: f"JOIN gb_best {a} ON {a}.fit = '{o}:{f}' AND {a}.part = 'score' AND {a}.variant = {v} AND {a}.id = r.source_row_id"
    pseudo, scores, xs = [], [], {}
    for o in outcomes:
        xs[f"{o}:x"] = (FEATURES, False)
        label = f"CASE WHEN r.treatment = 1 THEN r.{o} - {p('a.m')} ELSE {p('b.m')} - r.{o} END"
        pseudo.append(f"SELECT '{o}:x' AS fit, source_row_id AS id, {kind} AS part, -1 AS variant, {label} AS y, {cols} FROM part r {of(o, 't0', 2, 'a')} {of(o, 't1', 2, 'b')} WHERE data_partition <> 'test'")
        pseudo.append(f"SELECT '{o}:x', source_row_id, 'score', 2, NULL, {cols} FROM part WHERE data_partition = 'test'")
        f = lambda a: f"CAST({p(f'{a}.m')} AS FLOAT)"
        scores.append(
            f"""SELECT '{o}' AS outcome_name, r.source_row_id, r.treatment, r.{o} AS outcome, CAST({f('s1')} - {f('s0')} AS FLOAT) AS s_learner, CAST({f('b')} - {f('a')} AS FLOAT) AS t_learner, CAST(x.m AS FLOAT) AS x_learner, {f('v')} AS response_propensity,
  CASE r.treatment WHEN 1 THEN {p('s1.m')} ELSE {p('s0.m')} END AS p_s, CASE r.treatment WHEN 1 THEN {p('b.m')} ELSE {p('a.m')} END AS p_t, {p('v.m')} AS p_r
  FROM part r {of(o, 's', 0, 's0')} {of(o, 's', 1, 's1')} {of(o, 't0', 2, 'a')} {of(o, 't1', 2, 'b')} {of(o, 'response', 2, 'v')} JOIN gx_best x ON x.fit = '{o}:x' AND x.part = 'score' AND x.id = r.source_row_id WHERE data_partition = 'test'"""
        )
    return f"""ge AS MATERIALIZED ({cuts}), gsrc AS ({' UNION ALL '.join(sources)}),
{boosting.boosting_sql('gb', 'gsrc', 'ge', features, names, how)},
gxs AS ({' UNION ALL '.join(pseudo)}),
{boosting.boosting_sql('gx', 'gxs', 'ge', FEATURES, xs, how)},
gs AS MATERIALIZED ({' UNION ALL '.join(scores)})"""


@query(f"WITH {EXP}, {PART}, {boosted_sql(['visit'])} SELECT source_row_id, {', '.join(f'round({m}::DOUBLE, 6) + 0.0 AS {m}' for m in [*UPLIFT_MODELS, RESPONSE_MODEL])} FROM gs")
def gbt_learner_scores(spark, sf_dir):
    """Boosted S, T, X and response learners, grown on train, stopped by patience on validation, saved as a table of nodes, read again and scored on test."""
    view = _split(spark, sf_dir)
    parts = [view.where(F.col("data_partition") == p) for p in ("train", "validation")]
    nodes = written(boosting.nodes_table(spark, learners.fit_learners(parts[0], "visit", validation=parts[1], how=BOOST)), "nodes")
    found = learners.score_learners(boosting.models_of(nodes), view.where("data_partition = 'test'"))
    return rounded(found.select("source_row_id", *[F.col(m).cast("double").alias(m) for m in [*UPLIFT_MODELS, RESPONSE_MODEL]]), 6)


# ---- bootstrap, selection, audit

_JOINT = ["s_learner", "response_propensity"]


@query(
    f"""WITH {_rk(models=_JOINT)}, b AS (SELECT *, CAST(least(rank * {G} // n, {G - 1}) AS INTEGER) AS bucket FROM rk),
w AS (SELECT source_row_id, {', '.join(f"max(bucket) FILTER (WHERE model_name = '{m}') AS g_{m}" for m in _JOINT)}, max(treatment) AS treatment, max(outcome) AS outcome FROM b GROUP BY source_row_id)
SELECT {', '.join(f'g_{m}' for m in _JOINT)}, treatment, outcome, count(*) AS cell_rows FROM w GROUP BY ALL"""
)
def bootstrap_cells(spark, sf_dir):
    return bootstrap.joint_cells(_ranked(spark, sf_dir, models=_JOINT), _JOINT, G)


def paired_sql(models: list[str], replicates: int, outcomes: list[str] | None = None, source: str = "rk", name: str = "bl") -> str:
    """CTEs up to ``name``: replicate, model_name, bucket and counts of the paired bootstrap; models are named outcome:model if ``outcomes`` are given."""
    split = "split_part(model_name, ':', 1) AS o, split_part(model_name, ':', 2) AS m" if outcomes else "'' AS o, model_name AS m"
    key = f"list_position({outcomes}, o)" if outcomes else "0"
    for m in models:
        key = f"({key}) * {G + 1} + coalesce(g_{m}, {G})"
    full = "o || ':' || v.m" if outcomes else "v.m"
    return f"""{name}_w AS (SELECT o, {', '.join(f"max(bucket) FILTER (WHERE m = '{m}') AS g_{m}" for m in models)}, max(treatment) AS t, max(outcome) AS y
  FROM (SELECT {split}, source_row_id, CAST(least(rank * {G} // n, {G - 1}) AS INTEGER) AS bucket, treatment, outcome FROM {source}) GROUP BY o, source_row_id),
{name}_c AS MATERIALIZED (SELECT *, (({key}) * 4 + t * 2 + y)::BIGINT AS key FROM (SELECT o, {', '.join(f'g_{m}' for m in models)}, t, y, count(*) AS c FROM {name}_w GROUP BY ALL)),
{streams.poisson_tables_sql(name + '_p')},
{name}_d AS (SELECT *, {streams.poisson_quantile_sql('c', 'u', 'z')} AS w FROM (SELECT *, {streams.normal_quantile_sql('u')} AS z FROM (
  SELECT *, {streams.uniform_sql(f'(key * {bootstrap.MOST_REPLICATES} + replicate)', bootstrap.PAIRED_SEED)} AS u FROM {name}_c, range({replicates}) r(replicate))), {name}_p),
{name} AS (SELECT replicate, {full} AS model_name, v.bucket, coalesce(sum(w) FILTER (WHERE t = 0), 0) AS n0, coalesce(sum(w) FILTER (WHERE t = 1), 0) AS n1, coalesce(sum(w) FILTER (WHERE t = 0 AND y = 1), 0) AS y0, coalesce(sum(w) FILTER (WHERE t = 1 AND y = 1), 0) AS y1
  FROM {name}_d, LATERAL (VALUES {', '.join(f"('{m}', g_{m})" for m in models)}) v(m, bucket) WHERE v.bucket IS NOT NULL GROUP BY ALL)"""


def draw_curves_sql(name: str = "bl", to: str = "") -> str:
    """CTEs after ``paired_sql``: bc, the draws' curves, and ba, their areas; ``to`` and _ come before their names."""
    x = f"{to}_" if to else ""
    return f"""{x}bm AS (SELECT replicate, model_name, bucket, sum(n0) OVER w AS n0, sum(n1) OVER w AS n1, sum(y0) OVER w AS y0, sum(y1) OVER w AS y1 FROM {name} WINDOW w AS (PARTITION BY replicate, model_name ORDER BY bucket)),
{x}bc AS (SELECT replicate, model_name, (bucket + 1) / CAST({G} AS DOUBLE) AS target_fraction, (n0 + n1) * (p1 - p0) AS gain FROM (SELECT *, {_DIFF} FROM {x}bm)),
{x}br AS (SELECT *, (gain + coalesce(lag(gain) OVER w, 0.0)) / 2 * (target_fraction - coalesce(lag(target_fraction) OVER w, 0.0)) AS area FROM {x}bc WINDOW w AS (PARTITION BY replicate, model_name ORDER BY target_fraction)),
{x}ba AS (SELECT replicate, model_name, sum(area ORDER BY target_fraction) AS auuc, sum(area ORDER BY target_fraction) - 0.5 * arg_max(gain, target_fraction) AS qini FROM {x}br GROUP BY ALL)"""


def long_metrics_sql(areas: str, curve: str, name: str, percents: list[int] = curves.MAIN_PERCENTS, named: bool = True) -> str:
    """CTE ``name``: replicate, outcome, model, metric, value and paired differences, from areas and curve points."""
    place = lambda x: f"list_position({UPLIFT_MODELS}, {x}.m)"
    split = "split_part(model_name, ':', 1) AS o, split_part(model_name, ':', 2) AS m" if named else "'' AS o, model_name AS m"
    return f"""{name}_o AS (SELECT replicate, {split}, metric, value FROM (
  SELECT replicate, model_name, 'auuc' AS metric, auuc AS value FROM {areas} UNION ALL SELECT replicate, model_name, 'qini', qini FROM {areas}
  UNION ALL SELECT replicate, model_name, 'gain_at_' || CAST({_PERCENT} AS VARCHAR) || 'pct', gain FROM {curve} WHERE {_PERCENT} IN ({', '.join(map(str, percents))}))),
{name} AS (SELECT * FROM {name}_o UNION ALL SELECT a.replicate, a.o, a.m, a.metric || '_minus_response', a.value - b.value FROM {name}_o a JOIN {name}_o b USING (replicate, o, metric) WHERE b.m = '{RESPONSE_MODEL}' AND a.m <> b.m
  UNION ALL SELECT a.replicate, a.o, a.m, a.metric || '_minus_' || b.m, a.value - b.value FROM {name}_o a JOIN {name}_o b USING (replicate, o, metric) WHERE metric IN ('auuc', 'qini') AND {place('a')} > {place('b')} AND {place('b')} > 0)"""


def _paired_sql(models: list[str], replicates: int, percents: list[int] = curves.MAIN_PERCENTS, where: str = "true") -> str:
    return f"""WITH {_rk(models=models)}, {paired_sql(models, replicates)}, {draw_curves_sql()}, {long_metrics_sql('ba', 'bc', 'bv', percents, False)}
SELECT m AS model_name, metric, round(quantile_cont(value, 0.025), 5) + 0.0 AS ci_lower, round(quantile_cont(value, 0.975), 5) + 0.0 AS ci_upper, count(DISTINCT replicate) AS bootstrap_replicates FROM bv WHERE value IS NOT NULL AND {where} GROUP BY ALL"""


def _paired(spark, sf_dir, models, replicates, percents=curves.MAIN_PERCENTS):
    rows = _ranked(spark, sf_dir, models=models)
    cells = written(bootstrap.joint_cells(rows, models, G), "joint-cells")
    draws = written(bootstrap.paired_draws(cells, models, replicates, groups=G), "draws")
    return bootstrap.draw_metrics(draws, G, percents)


def _rounded_intervals(found):
    return rounded(found.withColumn("ci_lower", F.col("ci_lower") + F.lit(0.0)).withColumn("ci_upper", F.col("ci_upper") + F.lit(0.0)), 5)


_BM = ["s_learner", "x_learner", RESPONSE_MODEL]
_ALL = [*UPLIFT_MODELS, RESPONSE_MODEL]
_R = 200
_MANY = 2000


@query(_paired_sql(_BM, _R, where="metric IN ('qini', 'qini_minus_response')"))
def bootstrap_summary(spark, sf_dir):
    """Percentile intervals of Qini and of paired differences in it."""
    values = _paired(spark, sf_dir, _BM, _R).where(F.col("metric").isin("qini", "qini_minus_response"))
    return _rounded_intervals(bootstrap.bootstrap_summary(values))


@query(_paired_sql(_ALL, _R))
def paired_bootstrap(spark, sf_dir):
    return _rounded_intervals(bootstrap.bootstrap_summary(_paired(spark, sf_dir, _ALL, _R)))


@query(_paired_sql(_ALL, _MANY, [5, *curves.MAIN_PERCENTS]))
def bootstrap_sensitivity(spark, sf_dir):
    """The same intervals from ten times the draws, at 5 % of the rows too."""
    return _rounded_intervals(bootstrap.bootstrap_summary(_paired(spark, sf_dir, _ALL, _MANY, [5, *curves.MAIN_PERCENTS])))


_ARMS = f"ba_i AS (SELECT outcome, list_position(['visit', 'conversion'], outcome) AS place, arm, CASE arm WHEN 0 THEN n0 ELSE n1 END AS n, CASE arm WHEN 0 THEN y0 ELSE y1 END AS y FROM oc, (VALUES (0), (1)) v(arm))"


@query(
    f"""WITH {EXP}, oc AS ({_OC}), {_ARMS}, {streams.binomial_table_sql('ba_i', 'outcome, arm', 'ba_t')},
ba_u AS (SELECT *, {streams.normal_quantile_sql('u')} AS z FROM (SELECT *, {streams.uniform_sql(f'((place * 2 + arm) * {bootstrap.MOST_REPLICATES} + replicate)', bootstrap.BINOMIAL_SEED)} AS u FROM ba_t, range(50000) r(replicate))),
ba_p AS (SELECT outcome, replicate, max(p) FILTER (WHERE arm = 0) AS p0, max(p) FILTER (WHERE arm = 1) AS p1 FROM (SELECT *, {streams.binomial_quantile_sql('n', 'y', 'u', 'z')} / n AS p FROM ba_u) GROUP BY ALL),
ba_l AS MATERIALIZED (SELECT outcome, replicate, m.measure, m.value FROM ba_p, LATERAL (VALUES ('absolute_lift', p1 - p0), ('relative_lift', CASE WHEN p0 > 0 THEN (p1 - p0) / p0 END)) m(measure, value) WHERE m.value IS NOT NULL),
ba_h AS (SELECT total, outcome, measure, h, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi
  FROM (SELECT *, CASE h WHEN 0 THEN replicate < total // 2 WHEN 1 THEN replicate >= total // 2 ELSE true END AS inside FROM ba_l, (VALUES (10000), (50000)) t(total), range(3) r(h) WHERE replicate < total) WHERE inside GROUP BY ALL),
ba_s AS (SELECT total, bool_and(greatest(abs(a.lo - b.lo), abs(a.hi - b.hi)) / (c.hi - c.lo) <= 0.02) AS stable FROM ba_h a JOIN ba_h b USING (total, outcome, measure) JOIN ba_h c USING (total, outcome, measure) WHERE a.h = 0 AND b.h = 1 AND c.h = 2 GROUP BY total),
ba_n AS (SELECT CASE WHEN (SELECT stable FROM ba_s WHERE total = 10000) THEN 10000 ELSE 50000 END AS total),
ef AS (SELECT *, y0 / n0 AS p0, y1 / n1 AS p1, {_LOG_SE} AS log_se FROM oc),
an AS (SELECT outcome, m.* FROM ef, LATERAL (VALUES ('absolute_lift', p1 - p0 - 1.96 * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0), p1 - p0 + 1.96 * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)),
  ('relative_lift', exp(ln(p1 / p0) - 1.96 * log_se) - 1, exp(ln(p1 / p0) + 1.96 * log_se) - 1)) m(measure, al, au))
SELECT outcome, measure, round(lo, 9) + 0.0 AS ci_lower, round(hi, 9) + 0.0 AS ci_upper, round(abs(lo - al) / (au - al), 6) AS lower_difference, round(abs(hi - au) / (au - al), 6) AS upper_difference, round(abs((hi - lo) - (au - al)) / (au - al), 6) AS width_difference,
  greatest(abs(lo - al), abs(hi - au), abs((hi - lo) - (au - al))) / (au - al) <= 0.10 AS agrees, total::BIGINT AS bootstrap_replicates, stable
FROM ba_h JOIN ba_n USING (total) JOIN ba_s USING (total) JOIN an USING (outcome, measure) WHERE h = 2"""
)
def binomial_bootstrap(spark, sf_dir):
    """Bootstrap intervals of both lifts, how far the analytical ones agree, and whether halves of the draws do."""
    cells = _oc(spark, sf_dir)
    draws, n, stable = bootstrap.escalated_draws(cells, strict=False)
    found = effects.effect_summary(cells)
    pick = lambda m, lo, hi: F.struct(F.lit(m).alias("measure"), F.col(lo).alias("ci_lower"), F.col(hi).alias("ci_upper"))
    analytical = found.select("outcome", F.explode(F.array(pick("absolute_lift", "absolute_ci_lower", "absolute_ci_upper"), pick("relative_lift", "relative_ci_lower", "relative_ci_upper"))).alias("m")).select("outcome", "m.*")
    own = bootstrap.percentile_intervals(draws)
    agreement = bootstrap.interval_agreement(analytical, own).join(own, ["outcome", "measure"])
    return rounded(rounded(agreement, 9, ("lower_difference", "upper_difference", "width_difference")), 6, ("ci_lower", "ci_upper")).withColumn("bootstrap_replicates", F.lit(n).cast("long")).withColumn("stable", F.lit(stable))


@query(f"WITH {_curve()} SELECT model_name, CAST(round(target_fraction * {G}) AS INTEGER) AS point, selected_rows, gain AS cumulative_gain FROM cv")
def audit_row_level_curve(spark, sf_dir):
    """Running sums over rows, held against the group cells' curve."""
    return curves.row_level_curve(_ranked(spark, sf_dir), G)


@query(
    f"""WITH {EXP}, {PART}, te AS (SELECT *, CASE WHEN source_row_id % 89 = 4 THEN 0 ELSE source_row_id END AS id FROM part WHERE data_partition = 'test')
SELECT count(*) AS rows, {_flags('wrong_split', 'source_row_id % 97 = 1')}, {_flags('wrong_outcome', 'false')}, {_flags('wrong_model', 'source_row_id % 53 = 2')}, {_flags('unblinded_rows', 'source_row_id % 61 = 3')},
  {_flags('nonfinite_scores', 'source_row_id % 71 = 5')}, {_flags('wrong_config', 'source_row_id % 53 = 2')}, {_flags('wrong_source', 'source_row_id % 83 = 6')}, count(*) - count(DISTINCT id) AS repeated_ids FROM te"""
)
def prediction_artifact_checks(spark, sf_dir):
    """An artifact with planted violations of every kind but one."""
    what = {"split": "test", "outcome": "visit", "model": "s_learner", "config_hash": artifacts.canonical_hash({"seed": SEED}), "source_hash": "0" * 64}
    test = audit.with_partition(experiment(spark, sf_dir)).where("data_partition = 'test'")
    rows = artifacts.prediction_artifact(test, "f1", **what)
    every = lambda k, r: F.col("was") % k == r
    planted = rows.withColumn("was", F.col("source_row_id")).select(
        F.when(every(89, 4), F.lit(0)).otherwise(F.col("was")).alias("source_row_id"),
        F.when(every(97, 1), F.lit("train")).otherwise(F.col("split")).alias("split"),
        "outcome_name",
        F.when(every(53, 2), F.lit("t_learner")).otherwise(F.col("model_name")).alias("model_name"),
        "treatment",
        F.when(every(61, 3), F.lit(1)).cast("tinyint").alias("observed_outcome"),
        F.when(every(71, 5), F.lit(float("nan"))).otherwise(F.col("uplift_hat")).cast("float").alias("uplift_hat"),
        F.when(every(53, 2), F.lit("x")).otherwise(F.col("model_config_hash")).alias("model_config_hash"),
        F.when(every(83, 6), F.lit(None)).otherwise(F.col("source_file_sha256")).alias("source_file_sha256"),
    )
    return artifacts.artifact_checks(planted, **what)


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS left_only, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS right_only, 0::BIGINT AS repeated, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) = 0 AS equal")
def key_set_equality(spark, sf_dir):
    """Order keys against the order keys of line items."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k")).distinct()
    return audit.key_set_difference(orders, lines, "k").select("left_only", "right_only", "repeated", "equal")


@query(f"WITH {EXP} SELECT source_row_id, f0 AS visit_score, f1 AS conversion_score FROM exp")
def one_to_one_join(spark, sf_dir):
    """Two score tables aligned by id, each id once on either side."""
    view = experiment(spark, sf_dir, items=False)
    return audit.one_to_one(view.select("source_row_id", F.col("f0").alias("visit_score")), view.select("source_row_id", F.col("f1").alias("conversion_score")), "source_row_id")


@query(
    f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, {ARM} AS treatment, count(*) AS rows, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1, 2"""
)
def event_arm_counters(spark, sf_dir):
    return arm_counters(spark.read.parquet(f"{sf_dir}/events.parquet"))
