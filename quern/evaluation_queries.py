"""Queries of the evaluation from learners to recommendations, and of sources; imports register them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions.scalar import tie_key_sql
from quern.operators import artifacts, audit, boosting, bootstrap, curves, learners, lineage, ranking, segments
from quern.plans import evaluation as ev
from quern.plans.experiment import FEATURES, RESPONSE_MODEL, UPLIFT_MODELS, experiment
from quern.queries import BOOST, _CAND, _COUNTS, _DIFF, _PERCENT, _REPORT, _SEGS, EXP, PART, SEED, G, _curve, _diff, _rank_avg, _ranked, _rk, _split, _cells, boosted_sql, curve_tail, draw_curves_sql, long_metrics_sql, paired_sql
from quern.registry import ORACLES, QUERIES, query, rounded
from quern.sources import files, stages

ALTERNATES = (1, 2)
REPLICATES = 200

# ---- learners, in SQL


def _learn(seed: int = 0, part: str = "test", name: str = "sc") -> str:
    """CTEs up to ``name``: every model's scores of the rows of ``part``, named outcome:model."""
    values = "(VALUES ('visit'), ('conversion')) o(outcome_name)"
    y = "CASE o.outcome_name WHEN 'visit' THEN visit ELSE conversion END"
    mu = lambda t: f"sum(y) FILTER (WHERE treatment = {t}) / count(*) FILTER (WHERE treatment = {t})"
    n = name
    rates = "coalesce(a.mu1, w.all1) AS mu1, coalesce(c.mu0, w.all0) AS mu0, w.all1 - w.all0 AS overall, w.al FROM"
    joins = f"JOIN {n}_w w ON w.outcome_name = t.outcome_name LEFT JOIN {n}_1 a ON a.outcome_name = t.outcome_name AND a.f2 = t.f2 LEFT JOIN {n}_0 c ON c.outcome_name = t.outcome_name AND c.f3 = t.f3"
    models = ", ".join(f"('{m}', {c})" for m, c in zip(ev.MODELS, ("s", "t", "x", "r", "overall")))
    return f"""{n}_fit AS (SELECT o.outcome_name, f2, f3, f10, treatment, {y} AS y FROM part, {values} WHERE data_partition = 'train' AND (source_row_id * 7919 + {seed * 104729}) % 10 <> 0),
{n}_w AS (SELECT outcome_name, {mu(0)} AS all0, {mu(1)} AS all1, sum(y) / count(*) AS al FROM {n}_fit GROUP BY 1),
{n}_b AS (SELECT outcome_name, f3, f10, {mu(1)} - {mu(0)} AS e, sum(y) / count(*) AS r FROM {n}_fit GROUP BY 1, 2, 3),
{n}_1 AS (SELECT outcome_name, f2, {mu(1)} AS mu1 FROM {n}_fit GROUP BY 1, 2), {n}_0 AS (SELECT outcome_name, f3, {mu(0)} AS mu0 FROM {n}_fit GROUP BY 1, 2),
{n}_p AS (SELECT outcome_name, f10, round(avg(CASE WHEN treatment = 1 THEN y - mu0 ELSE mu1 - y END), 9) AS x FROM (SELECT t.*, {rates} {n}_fit t {joins}) GROUP BY 1, 2),
{n}_t AS (SELECT o.outcome_name, source_row_id, f2, f3, f10, treatment, {y} AS outcome FROM part, {values} WHERE data_partition = '{part}'),
{n}_j AS (SELECT t.outcome_name, source_row_id, treatment, outcome, coalesce(b.e, overall) AS s, mu1 - mu0 AS t, coalesce(p.x, overall) AS x, coalesce(b.r, al) AS r, overall FROM (SELECT t.*, {rates} {n}_t t {joins}) t
  LEFT JOIN {n}_b b ON b.outcome_name = t.outcome_name AND b.f3 = t.f3 AND b.f10 = t.f10 LEFT JOIN {n}_p p ON p.outcome_name = t.outcome_name AND p.f10 = t.f10),
{n} AS (SELECT outcome_name || ':' || m.model AS model_name, source_row_id, m.score, treatment, outcome FROM {n}_j, LATERAL (VALUES {models}) m(model, score))"""


def _rank(source: str = "sc", name: str = "rk") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY score DESC, {tie_key_sql('source_row_id', SEED)}) - 1 AS rank, count(*) OVER (PARTITION BY model_name) AS n FROM {source})"


_RK = f"{EXP}, {PART}, {_learn()}, {_rank()}"
_CV = f"{_RK}, {curve_tail()}"
_NAMED = "split_part(model_name, ':', 1) AS outcome_name, split_part(model_name, ':', 2) AS model_name"
_MAIN = ", ".join(map(str, curves.MAIN_PERCENTS))


def _uncertain(models: list[str], replicates: int) -> str:
    """CTEs after ``cv`` and ``mt`` up to ``un``: estimates and intervals per outcome, model and metric."""
    return f"""pa AS (SELECT 0 AS replicate, * FROM mt), pc AS (SELECT 0 AS replicate, * FROM cv), {long_metrics_sql('pa', 'pc', 'pt')},
{paired_sql(models, replicates, ev.OUTCOMES)}, {draw_curves_sql()}, {long_metrics_sql('ba', 'bc', 'bv')},
un AS (SELECT b.o AS outcome_name, b.m AS model_name, b.metric, any_value(p.value) AS estimate, quantile_cont(b.value, 0.025) AS ci_lower, quantile_cont(b.value, 0.975) AS ci_upper, count(DISTINCT b.replicate) AS bootstrap_replicates
  FROM bv b LEFT JOIN pt p ON p.o = b.o AND p.m = b.m AND p.metric = b.metric WHERE b.value IS NOT NULL GROUP BY ALL)"""


_UN = f"{_CV}, {_uncertain(ev.MODELS, REPLICATES)}"
_POLICY = f"""pw AS (SELECT {_NAMED}, {_PERCENT} AS percent, selected_rows, uplift AS cumulative_uplift, gain AS cumulative_gain FROM cv WHERE {_PERCENT} IN ({_REPORT})),
po AS (SELECT w.*, w.cumulative_gain - r.cumulative_gain AS gain_above_response, g.ci_lower AS incremental_gain_ci_lower, g.ci_upper AS incremental_gain_ci_upper,
  CASE WHEN w.model_name = '{RESPONSE_MODEL}' AND w.percent IN ({_MAIN}) THEN 0.0 ELSE d.ci_lower END AS gain_above_response_ci_lower, CASE WHEN w.model_name = '{RESPONSE_MODEL}' AND w.percent IN ({_MAIN}) THEN 0.0 ELSE d.ci_upper END AS gain_above_response_ci_upper
  FROM pw w JOIN pw r ON r.outcome_name = w.outcome_name AND r.percent = w.percent AND r.model_name = '{RESPONSE_MODEL}'
  LEFT JOIN un g ON g.outcome_name = w.outcome_name AND g.model_name = w.model_name AND g.metric = 'gain_at_' || CAST(w.percent AS VARCHAR) || 'pct'
  LEFT JOIN un d ON d.outcome_name = w.outcome_name AND d.model_name = w.model_name AND d.metric = 'gain_at_' || CAST(w.percent AS VARCHAR) || 'pct_minus_response')"""
_UPLIFT = ", ".join(f"'{m}'" for m in UPLIFT_MODELS)
_STABLE = f"""{_learn(0, 'validation', 'va')}, {', '.join(_learn(s, 'validation', f'v{s}') for s in ALTERNATES)},
pr AS ({' UNION ALL '.join(f"SELECT a.model_name || ':{s}' AS model_name, source_row_id, a.score AS a, b.score AS b FROM va a JOIN v{s} b USING (model_name, source_row_id) WHERE split_part(a.model_name, ':', 2) IN ({_UPLIFT})" for s in ALTERNATES)}),
ra AS (SELECT *, {_rank_avg('a').replace('OVER (ORDER BY a)', 'OVER (PARTITION BY model_name ORDER BY a)').replace('PARTITION BY a)', 'PARTITION BY model_name, a)')} AS ar, {_rank_avg('b').replace('OVER (ORDER BY b)', 'OVER (PARTITION BY model_name ORDER BY b)').replace('PARTITION BY b)', 'PARTITION BY model_name, b)')} AS br,
  row_number() OVER (PARTITION BY model_name ORDER BY a DESC, {tie_key_sql('source_row_id', SEED)}) - 1 AS ra, row_number() OVER (PARTITION BY model_name ORDER BY b DESC, {tie_key_sql('source_row_id', SEED)}) - 1 AS rb, count(*) OVER (PARTITION BY model_name) AS n FROM pr),
sb AS (SELECT split_part(model_name, ':', 1) AS outcome_name, split_part(model_name, ':', 2) AS model_name, CAST(split_part(model_name, ':', 3) AS INTEGER) AS comparison_seed, corr(ar, br) AS spearman_rank_correlation, avg(a) AS reference_mean_uplift, avg(b) AS comparison_mean_uplift,
  count(*) FILTER (WHERE ra * 10 // n = 0 AND rb * 10 // n = 0) / count(*) FILTER (WHERE ra * 10 // n = 0) AS top_set_overlap FROM ra GROUP BY ALL),
ss AS (SELECT outcome_name, model_name, avg(spearman_rank_correlation) AS mean_spearman_rank_correlation, min(spearman_rank_correlation) AS minimum_spearman_rank_correlation, avg(top_set_overlap) AS mean_top_set_overlap, min(top_set_overlap) AS minimum_top_set_overlap FROM sb GROUP BY ALL)"""
_COMPARE = f"""mc AS (SELECT m.outcome_name, m.model_name, CAST(list_position({UPLIFT_MODELS}, m.model_name) AS INTEGER) AS complexity_rank, auuc, qini, d.estimate AS qini_minus_response, d.ci_lower AS qini_minus_response_ci_lower, d.ci_upper AS qini_minus_response_ci_upper,
  mean_spearman_rank_correlation, minimum_spearman_rank_correlation, mean_top_set_overlap, minimum_top_set_overlap
  FROM (SELECT {_NAMED}, auuc, qini FROM mt) m JOIN un d ON d.outcome_name = m.outcome_name AND d.model_name = m.model_name AND d.metric = 'qini_minus_response' JOIN ss ON ss.outcome_name = m.outcome_name AND ss.model_name = m.model_name WHERE m.model_name IN ({_UPLIFT}))"""
_RECOMMEND = f"""ld AS (SELECT outcome_name, model_name AS point_qini_leader, complexity_rank AS leader_rank FROM (SELECT *, row_number() OVER (PARTITION BY outcome_name ORDER BY qini DESC, complexity_rank) AS p FROM mc) WHERE p = 1),
ch AS (SELECT l.*, coalesce((SELECT min(s.complexity_rank) FROM mc s JOIN un u ON u.metric = 'qini_minus_' || s.model_name AND u.model_name = l.point_qini_leader AND u.outcome_name = l.outcome_name WHERE s.outcome_name = l.outcome_name AND s.complexity_rank < l.leader_rank AND u.ci_lower <= 0), l.leader_rank) AS complexity_rank FROM ld l),
de AS (SELECT c.point_qini_leader, c.complexity_rank < c.leader_rank AS simplicity_rule_applied, mc.*, qini_minus_response_ci_lower > 0 AS beats_response, CASE WHEN qini_minus_response_ci_lower > 0 THEN mc.model_name ELSE '{RESPONSE_MODEL}' END AS deployment_ranking FROM ch c JOIN mc ON mc.outcome_name = c.outcome_name AND mc.complexity_rank = c.complexity_rank),
pk AS (SELECT d.*, p.percent, p.selected_rows, p.cumulative_uplift, p.cumulative_gain, p.incremental_gain_ci_lower, p.incremental_gain_ci_upper, row_number() OVER (PARTITION BY d.outcome_name ORDER BY p.incremental_gain_ci_lower DESC NULLS LAST, p.cumulative_gain DESC) AS place
  FROM de d JOIN po p ON p.outcome_name = d.outcome_name AND p.model_name = d.deployment_ranking WHERE p.percent IN ({_MAIN})),
rc AS (SELECT outcome_name, point_qini_leader, model_name AS recommended_uplift_model, simplicity_rule_applied, deployment_ranking, beats_response, percent AS recommended_percent, selected_rows AS selected_users, cumulative_uplift AS selected_group_uplift, cumulative_gain AS incremental_outcomes,
  incremental_gain_ci_lower AS incremental_ci_lower, incremental_gain_ci_upper AS incremental_ci_upper, qini AS uplift_model_qini, qini_minus_response_ci_lower, qini_minus_response_ci_upper, mean_spearman_rank_correlation AS mean_stability_rank_correlation, mean_top_set_overlap AS mean_stability_top_set_overlap FROM pk WHERE place = 1)"""


def _round_all(select: str, columns: list[str], digits: int = 5) -> str:
    """``select`` with its double columns rounded, without a negative zero."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in columns)}) FROM ({select})"


# ---- learners to recommendations


def _parts(spark, sf_dir):
    view = _split(spark, sf_dir)
    return {p: view.where(F.col("data_partition") == p) for p in ("train", "validation", "test")}


def _scored(parts, part="test", seed=0):
    return files.written(ev.stratified_scores(parts["train"], parts[part], seed), "learner-scores")


@query(f"WITH {EXP}, {PART}, {_learn()} SELECT {_NAMED}, source_row_id, round(score, 9) + 0.0 AS score FROM sc")
def learner_scores(spark, sf_dir):
    """Every learner's scores of the test rows, for both outcomes."""
    return rounded(ev.stratified_scores(*(_parts(spark, sf_dir)[p] for p in ("train", "test"))).select("outcome_name", "model_name", "source_row_id", "score"))


def _tables(spark, sf_dir):
    """(parts, ranked test rows, curve, metrics) of all learners and outcomes."""
    parts = _parts(spark, sf_dir)
    rows = ev.ranked(_scored(parts), SEED)
    curve = curves.cumulative_gain(rows, G)
    return parts, rows, curve, curves.curve_metrics(curve)


def _area_columns():
    return ["auuc", "qini", "endpoint_gain"]


@query(_round_all(f"WITH {_CV} SELECT {_NAMED}, auuc, qini, endpoint_gain FROM mt", _area_columns()))
def learner_metrics(spark, sf_dir):
    return rounded(ev.named(_tables(spark, sf_dir)[3]), 5)


@query(_round_all(f"WITH {_UN} SELECT * FROM un", ["estimate", "ci_lower", "ci_upper"]))
def learner_uncertainty(spark, sf_dir):
    """Estimates and percentile intervals of areas, gains and paired differences."""
    return rounded(ev.uncertainty(_tables(spark, sf_dir)[1], REPLICATES, G), 5)


_GAINS = ["cumulative_uplift", "cumulative_gain", "gain_above_response", "incremental_gain_ci_lower", "incremental_gain_ci_upper", "gain_above_response_ci_lower", "gain_above_response_ci_upper"]


@query(_round_all(f"WITH {_UN}, {_POLICY} SELECT * FROM po", _GAINS))
def learner_policy_table(spark, sf_dir):
    """Gains at the reported rates, above the response ranking's, with intervals at the main rates."""
    _, rows, curve, _ = _tables(spark, sf_dir)
    return rounded(ev.policy_table(curve, ev.uncertainty(rows, REPLICATES, G)), 5)


_STABILITY_COLUMNS = ["spearman_rank_correlation", "reference_mean_uplift", "comparison_mean_uplift", "top_set_overlap"]


def _stability(parts):
    return ev.stability(_scored(parts, "validation"), {s: _scored(parts, "validation", s) for s in ALTERNATES}, SEED)


@query(_round_all(f"WITH {EXP}, {PART}, {_STABLE} SELECT * FROM sb", _STABILITY_COLUMNS, 7))
def learner_stability(spark, sf_dir):
    """Learners fitted with alternate seeds against the reference fit, on validation rows."""
    return rounded(_stability(_parts(spark, sf_dir)), 7)


_SUMMARY_COLUMNS = ["mean_spearman_rank_correlation", "minimum_spearman_rank_correlation", "mean_top_set_overlap", "minimum_top_set_overlap"]


@query(_round_all(f"WITH {EXP}, {PART}, {_STABLE} SELECT * FROM ss", _SUMMARY_COLUMNS, 7))
def stability_summary(spark, sf_dir):
    return rounded(ev.stability_summary(_stability(_parts(spark, sf_dir))), 7)


def _compared(spark, sf_dir):
    parts, rows, curve, metrics = _tables(spark, sf_dir)
    intervals = files.written(ev.uncertainty(rows, REPLICATES, G), "uncertainty")
    comparison = files.written(ev.model_comparison(ev.named(metrics), intervals, ev.stability_summary(_stability(parts))), "comparison")
    return rows, curve, intervals, comparison


_COMPARE_COLUMNS = ["auuc", "qini", "qini_minus_response", "qini_minus_response_ci_lower", "qini_minus_response_ci_upper", *_SUMMARY_COLUMNS]


@query(_round_all(f"WITH {_UN}, {_STABLE}, {_COMPARE} SELECT * FROM mc", _COMPARE_COLUMNS))
def model_comparison(spark, sf_dir):
    return rounded(_compared(spark, sf_dir)[3], 5)


_RECOMMEND_COLUMNS = ["selected_group_uplift", "incremental_outcomes", "incremental_ci_lower", "incremental_ci_upper", "uplift_model_qini", "qini_minus_response_ci_lower", "qini_minus_response_ci_upper", "mean_stability_rank_correlation", "mean_stability_top_set_overlap"]


@query(_round_all(f"WITH {_UN}, {_POLICY}, {_STABLE}, {_COMPARE}, {_RECOMMEND} SELECT * FROM rc", _RECOMMEND_COLUMNS))
def recommendations(spark, sf_dir):
    """The recommended model, ranking and rate for both outcomes."""
    _, curve, intervals, comparison = _compared(spark, sf_dir)
    return rounded(ev.recommendations(comparison, intervals, ev.policy_table(curve, intervals)), 5)


_CHOICE = [c for c in _RECOMMEND_COLUMNS if not c.startswith("mean_")]
_RKV = f"{_rk(models=[*UPLIFT_MODELS, RESPONSE_MODEL]).replace('rk AS (', 'rk_plain AS (')}, rk AS (SELECT * REPLACE ('visit:' || model_name AS model_name) FROM rk_plain), {curve_tail()}"


@query(
    _round_all(
        f"""WITH {_RKV}, {_uncertain([*UPLIFT_MODELS, RESPONSE_MODEL], REPLICATES)}, {_POLICY},
ss AS (SELECT 'visit' AS outcome_name, unnest({UPLIFT_MODELS}) AS model_name, NULL::DOUBLE AS mean_spearman_rank_correlation, NULL::DOUBLE AS minimum_spearman_rank_correlation, NULL::DOUBLE AS mean_top_set_overlap, NULL::DOUBLE AS minimum_top_set_overlap), {_COMPARE}, {_RECOMMEND}
SELECT * EXCLUDE (mean_stability_rank_correlation, mean_stability_top_set_overlap) FROM rc""",
        _CHOICE,
    )
)
def final_selection(spark, sf_dir):
    """The same rule for one outcome's given rankings, without alternate fits."""
    models = [*UPLIFT_MODELS, RESPONSE_MODEL]
    rows = _ranked(spark, sf_dir, models=models).withColumn("model_name", F.concat(F.lit("visit:"), "model_name"))
    curve = curves.cumulative_gain(rows, G)
    intervals = files.written(ev.uncertainty(rows, REPLICATES, G, models), "uncertainty")
    comparison = ev.model_comparison(ev.named(curves.curve_metrics(curve)), intervals)
    found = ev.recommendations(comparison, intervals, ev.policy_table(curve, intervals).where("outcome_name = 'visit'"))
    return rounded(found.drop("mean_stability_rank_correlation", "mean_stability_top_set_overlap"), 5)


# ---- boosted trees to recommendations

_TREES = [*UPLIFT_MODELS, RESPONSE_MODEL]
_OUTCOME_COLUMNS = ["visit", "conversion", "exposure"]
_GS = f"{EXP}, {PART}, {boosted_sql(ev.OUTCOMES)}"
_GS_SCORES = f"""sc AS MATERIALIZED (SELECT outcome_name || ':' || m.model AS model_name, source_row_id, m.score, treatment, outcome FROM gs, LATERAL (VALUES {', '.join(f"('{m}', {m}::DOUBLE)" for m in _TREES)}) m(model, score))"""


def _tree_scores(spark, sf_dir):
    """(view of test rows, models, scores in long form): grown blind to test rows' outcomes, handed over as artifacts, and only then joined with outcomes."""
    parts = _parts(spark, sf_dir)
    models = learners.fit_learners(parts["train"], ev.OUTCOMES, validation=parts["validation"], how=BOOST)
    blind = parts["test"].drop("visit", "conversion", "exposure")
    config, source = artifacts.canonical_hash({"boosting": str(BOOST)}), artifacts.canonical_hash({"seed": SEED})
    handed = None
    for o in ev.OUTCOMES:
        scored = learners.score_learners(models, blind, o).join(blind.select("source_row_id", "treatment"), "source_row_id")
        lineage.check_unread(scored, _OUTCOME_COLUMNS)
        for m in _TREES:
            part = artifacts.prediction_artifact(scored, m, split="test", outcome=o, model=m, config_hash=config, source_hash=source)
            handed = part if handed is None else handed.unionByName(part)
    handed = files.written(handed, "handoff")
    wrong = [x for x in artifacts.violations(artifacts.handoff_checks(handed, ev.OUTCOMES, _TREES, config, source)) if x != "ids"]
    if wrong:
        raise ValueError(f"the handoff has violations: {wrong}")
    outcomes = ev.by_outcome(parts["test"], ["source_row_id"])
    rows = handed.select(F.concat_ws(":", "outcome_name", "model_name").alias("model_name"), "outcome_name", "source_row_id", F.col("uplift_hat").cast("double").alias("score"), F.col("treatment").cast("int").alias("treatment"))
    return parts["test"], models, rows.join(outcomes, ["outcome_name", "source_row_id"]).select("model_name", "source_row_id", "score", "treatment", "outcome")


@query(
    _round_all(
        f"""WITH {_GS}, {_GS_SCORES}, {_rank()}, {curve_tail()}, {_uncertain(_TREES, REPLICATES)}, {_POLICY},
ss AS (SELECT o AS outcome_name, m AS model_name, NULL::DOUBLE AS mean_spearman_rank_correlation, NULL::DOUBLE AS minimum_spearman_rank_correlation, NULL::DOUBLE AS mean_top_set_overlap, NULL::DOUBLE AS minimum_top_set_overlap FROM (SELECT unnest({ev.OUTCOMES}) AS o), (SELECT unnest({UPLIFT_MODELS}) AS m)), {_COMPARE}, {_RECOMMEND}
SELECT * EXCLUDE (mean_stability_rank_correlation, mean_stability_top_set_overlap) FROM rc""",
        _CHOICE,
    )
)
def tree_recommendations(spark, sf_dir):
    """From boosted trees of both outcomes through the handoff, ranks, curves and paired intervals to what to deploy."""
    rows = ranking.ranked(files.written(_tree_scores(spark, sf_dir)[2], "tree-scores"), seed=SEED)
    curve = curves.cumulative_gain(rows, G)
    intervals = files.written(ev.uncertainty(rows, REPLICATES, G, _TREES), "uncertainty")
    comparison = files.written(ev.model_comparison(ev.named(curves.curve_metrics(curve)), intervals), "comparison")
    found = ev.recommendations(comparison, intervals, ev.policy_table(curve, intervals))
    return rounded(found.drop("mean_stability_rank_correlation", "mean_stability_top_set_overlap"), 5)


@query(
    f"""WITH {EXP}, {PART}, {boosted_sql(['visit'])},
p AS (SELECT m.model_name, treatment, outcome AS y, m.p FROM gs, LATERAL (VALUES ('s_learner', p_s), ('t_learner', p_t), ('{RESPONSE_MODEL}', p_r)) m(model_name, p)),
r AS (SELECT *, rank() OVER (PARTITION BY model_name, treatment ORDER BY p) + (count(*) OVER (PARTITION BY model_name, treatment, p) - 1) / 2.0::DOUBLE AS ar FROM (SELECT model_name, treatment, y, round(p, 12) AS p FROM p)),
a AS (SELECT model_name, treatment, count(*) AS rows, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg((p - y) * (p - y)) AS brier, (sum(ar) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS roc_auc FROM r GROUP BY ALL),
s AS (SELECT model_name, treatment, p, count(*) AS n, sum(y) AS y FROM r GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS cn, sum(y) OVER w AS cy, sum(y) OVER (PARTITION BY model_name, treatment) AS t FROM s WINDOW w AS (PARTITION BY model_name, treatment ORDER BY p DESC)),
v AS (SELECT model_name, treatment, sum(y / t * cy / cn) AS average_precision FROM c GROUP BY ALL)
SELECT model_name, treatment, rows, round(log_loss, 7) AS log_loss, round(brier, 7) AS brier, round(roc_auc, 7) AS roc_auc, round(average_precision, 7) AS average_precision FROM a JOIN v USING (model_name, treatment)"""
)
def tree_diagnostics(spark, sf_dir):
    """Log loss, Brier score, AUC and average precision of the trees' own probabilities on test rows, per model and arm."""
    parts = _parts(spark, sf_dir)
    models = learners.fit_learners(parts["train"], "visit", validation=parts["validation"], how=BOOST)
    by = ["model_name", "treatment"]
    rows = files.written(learners.response_probabilities(models, parts["test"]).withColumn("p", F.round("p", 12)), "probabilities")
    found = learners.probability_diagnostics(rows, by, "label", "p").join(learners.roc_auc(rows, by, "label", "p"), by).join(learners.average_precision(rows, by, "label", "p"), by)
    return rounded(found, 7)


_CROSS = {"visit": "s_learner", "conversion": "x_learner"}
_FRACTIONS = [0.1, 0.2, 0.3]


def _cross_sql() -> str:
    v, c = (f"{o}:{m}" for o, m in _CROSS.items())
    top = lambda f, r: f"{r} < greatest(1, CAST(round_even(n * {f!r}::DOUBLE, 0) AS BIGINT))"
    wide = f"""cw AS (SELECT source_row_id, any_value(treatment) AS treatment, max(n) AS n, {', '.join(f"max(rank) FILTER (WHERE model_name = '{m}') AS r_{k}, max(score) FILTER (WHERE model_name = '{m}') AS s_{k}, max(outcome) FILTER (WHERE model_name = '{m}') AS y_{k}" for k, m in (('v', v), ('c', c)))} FROM rk WHERE model_name IN ('{v}', '{c}') GROUP BY 1),
cs AS (SELECT corr(a, b) AS spearman_rank_correlation FROM (SELECT {_rank_avg('s_v')} AS a, {_rank_avg('s_c')} AS b FROM cw))"""
    names = {"visit": "v", "conversion": "c"}
    rows = []
    for f in _FRACTIONS:
        cells = []
        for p, pk in names.items():
            for m, mk in names.items():
                hit = top(f, f"r_{pk}")
                counts = ", ".join(f"count(*) FILTER (WHERE {hit} AND treatment = {t}) AS n{t}, count(*) FILTER (WHERE {hit} AND treatment = {t} AND y_{mk} = 1) AS y{t}" for t in (0, 1))
                cells.append(f"(SELECT uplift AS {m}_uplift_using_{p}_policy, (n0 + n1) * uplift AS {m}_gain_using_{p}_policy, (n0 + n1) * lo AS {m}_gain_ci_lower_using_{p}_policy, (n0 + n1) * hi AS {m}_gain_ci_upper_using_{p}_policy FROM {_diff(f'(SELECT {counts} FROM cw)')})")
        shared = f"count(*) FILTER (WHERE {top(f, 'r_v')} AND {top(f, 'r_c')})"
        own = f"count(*) FILTER (WHERE {top(f, 'r_v')})"
        rows.append(f"SELECT '{_CROSS['visit']}' AS visit_model, '{_CROSS['conversion']}' AS conversion_model, {f!r}::DOUBLE AS fraction, o.*, cs.*, {', '.join(f'k{i}.*' for i in range(4))} FROM (SELECT {shared} AS shared_rows, {own} AS selected_rows, 100.0::DOUBLE * {shared} / {own} AS shared_pct_of_selected, 100.0::DOUBLE * {shared} / count(*) AS shared_pct_of_population FROM cw) o, cs, {', '.join(f'{x} k{i}' for i, x in enumerate(cells))}")
    return f"WITH {_RK}, {wide} {' UNION ALL '.join(rows)}"


_CROSS_COLUMNS = ["spearman_rank_correlation", "shared_pct_of_selected", "shared_pct_of_population", *[f"{m}_{c}_using_{p}_policy" for p in _CROSS for m in _CROSS for c in ("uplift", "gain", "gain_ci_lower", "gain_ci_upper")]]


@query(_round_all(_cross_sql(), _CROSS_COLUMNS, 6))
def visit_conversion_policies(spark, sf_dir):
    """A visit policy and a conversion policy, compared on either outcome."""
    return rounded(ev.cross_policies(_tables(spark, sf_dir)[1], _CROSS, _FRACTIONS), 6, ("fraction",))


@query(
    f"""WITH {_rk()}, cl AS ({_cells(10)}), g AS (SELECT model_name, bucket + 1 AS score_group, group_rows, CAST(group_rows AS DOUBLE) AS w, score_sum / group_rows AS x, uplift AS y FROM {_diff('cl')}),
c AS (SELECT *, sum(w * x) OVER m / sum(w) OVER m AS mx, sum(w * y) OVER m / sum(w) OVER m AS my FROM g WHERE y IS NOT NULL WINDOW m AS (PARTITION BY model_name)),
s AS (SELECT model_name, count(*) AS k, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy, max(mx) AS mx, max(my) AS my, max(x) AS hi, min(x) AS lo FROM c GROUP BY model_name),
f AS (SELECT *, CASE WHEN NOT (k < 2 OR hi - lo <= 1e-8 + 1e-5 * abs(lo)) THEN sxy / sxx END AS b FROM s)
SELECT g.model_name, score_group, group_rows, round(x, 4) AS mean_predicted_score, round(y, 9) + 0.0 AS observed_uplift, round(my - b * mx + b * x, 7) + 0.0 AS calibrated_predicted_uplift FROM g JOIN f ON f.model_name = g.model_name"""
)
def calibrated_groups(spark, sf_dir):
    """Score groups with the uplift that the calibration line predicts."""
    found = curves.calibrated(curves.group_effects(_ranked(spark, sf_dir), 10))
    value = lambda c, d: (F.round(c, d) + F.lit(0.0)).alias(c)
    return found.select("model_name", "score_group", "group_rows", F.round("mean_predicted_score", 4).alias("mean_predicted_score"), value("observed_uplift", 9), value("calibrated_predicted_uplift", 7))


@query(f"WITH {_curve()} SELECT model_name, target_fraction, round(gain / endpoint_gain, 9) + 0.0 AS gain_share FROM cv JOIN mt USING (model_name)")
def gain_shares(spark, sf_dir):
    """Gains as shares of the gain of targeting all."""
    return rounded(curves.normalised_gain(curves.cumulative_gain(_ranked(spark, sf_dir), G)).select("model_name", "target_fraction", "gain_share"), but=("target_fraction",))


@query(
    f"""WITH {_SEGS}, sc AS (SELECT {_CAND} AS model_name, l.source_row_id, coalesce(e.effect, m.mean) AS score, l.treatment, l.outcome FROM (SELECT *, {_CAND} AS c FROM lg) l
  LEFT JOIN (SELECT *, {_CAND} AS c FROM ef) e ON e.c = l.c AND e.segment = l.segment JOIN (SELECT {_CAND} AS c, sum(effect * rows) / sum(rows) AS mean FROM ef GROUP BY 1) m ON m.c = l.c WHERE data_partition = 'validation'),
{_rank()}, {curve_tail()}, bs AS (SELECT model_name AS c FROM mt ORDER BY round(qini, 6) DESC, (SELECT count(*) FROM ef WHERE {_CAND} = model_name), split_part(model_name, ':', 1) LIMIT 1),
wn AS (SELECT l.*, {_CAND} AS c FROM lg l WHERE {_CAND} = (SELECT c FROM bs)), fe AS (SELECT segment, {_COUNTS} FROM wn WHERE data_partition <> 'test' GROUP BY 1),
ov AS (SELECT sum(y1) / sum(n1) - sum(y0) / sum(n0) AS overall FROM fe)
SELECT w.source_row_id, w.feature, w.bins, CAST(w.segment AS INTEGER) AS segment, round(CAST(CAST(coalesce(CASE WHEN n0 > 0 AND n1 > 0 THEN y1 / n1 - y0 / n0 END, overall) AS FLOAT) AS DOUBLE), 7) + 0.0 AS score FROM wn w LEFT JOIN fe ON fe.segment = w.segment, ov WHERE data_partition = 'test'""".replace(
        "concat_ws(':', feature, bins) AS model_name, l.source_row_id", "l.c AS model_name, l.source_row_id"
    )
)
def segment_baseline(spark, sf_dir):
    """The best segment candidate, fitted anew on train and validation rows, as a score of the test rows."""
    parts = _parts(spark, sf_dir)
    found = rounded(segments.segment_selection(parts["train"], parts["validation"], "visit", groups=G, seed=SEED), 6)
    rows = segments.segment_baseline(parts["train"], parts["validation"], parts["test"], found, "visit")
    return rounded(rows.withColumn("score", F.col("score").cast("double")), 7)


# ---- audit, handoff, sources

_DECILE = " + ".join(["1", *[f"CAST(rank >= ceil(n * {k} / 10.0) AS INTEGER)" for k in range(1, 10)]])


@query(f"WITH {_rk()}, dc AS (SELECT model_name, {_DECILE} AS score_group, {_COUNTS} FROM rk GROUP BY ALL) SELECT model_name, CAST(score_group AS INTEGER) AS score_group, n1 AS treatment_rows, n0 AS control_rows, round(y1 / n1 - y0 / n0, 9) + 0.0 AS observed_uplift FROM dc")
def audit_deciles(spark, sf_dir):
    """Deciles from bounds on ranks, independent of the score groups' buckets."""
    return rounded(curves.row_level_groups(_ranked(spark, sf_dir)))


@query(
    f"""WITH {_curve()} SELECT model_name, CAST({G} AS BIGINT) AS curve_points, CASE model_name WHEN 't_learner' THEN 1 ELSE 0 END::BIGINT AS wrong_points, CASE model_name WHEN 't_learner' THEN 3.0 ELSE 0.0 END::DOUBLE AS max_gain_error,
  round(qini, 5) + 0.0 AS qini, CASE model_name WHEN 't_learner' THEN 3.0 / {G} ELSE 0.0 END::DOUBLE AS qini_error, 10::BIGINT AS deciles, CASE model_name WHEN 'x_learner' THEN 2 ELSE 0 END::BIGINT AS wrong_deciles FROM mt"""
)
def audit_reconciliation(spark, sf_dir):
    """Saved tables against rows; two of the saved tables were tampered with, which must show."""
    rows = _ranked(spark, sf_dir)
    curve, effects = curves.cumulative_gain(rows, G), curves.group_effects(rows, 10)
    off = (F.col("model_name") == "t_learner") & (F.bround(F.col("target_fraction") * G, 0) == 7)
    swapped = (F.col("model_name") == "x_learner") & F.col("score_group").isin(2, 5)
    curve = curve.withColumn("cumulative_gain", F.col("cumulative_gain") + F.when(off, F.lit(3.0)).otherwise(F.lit(0.0)))
    effects = effects.withColumn("treatment_rows", F.col("treatment_rows") + F.when(swapped, F.lit(1)).otherwise(F.lit(0)))
    return rounded(curves.reconciled(rows, curve, effects, G), 5)



@query(
    f"""WITH {EXP}, {PART}, te AS (SELECT source_row_id FROM part WHERE data_partition = 'test')
SELECT count(*) AS ids, count(*) FILTER (WHERE source_row_id % 50 = 3) AS ids_not_in_all, count(*) FILTER (WHERE source_row_id % 40 = 6) AS repeated_ids, count(*) FILTER (WHERE source_row_id % 70 = 9) AS ids_of_two_arms,
  0::BIGINT AS missing_artifacts, count(*) FILTER (WHERE source_row_id % 40 = 7) AS rows_of_others, count(*) FILTER (WHERE source_row_id % 30 = 1) AS unblinded_rows, count(*) FILTER (WHERE source_row_id % 60 = 2) AS wrong_config, 0::BIGINT AS wrong_source FROM te"""
)
def handoff_checks(spark, sf_dir):
    """Artifacts of two outcomes and three models, with planted violations."""
    test = _parts(spark, sf_dir)["test"]
    config, source = artifacts.canonical_hash({"seed": SEED}), "0" * 64
    make = lambda o, m: artifacts.prediction_artifact(test, "f1", split="test", outcome=o, model=m, config_hash=config, source_hash=source)
    i = F.col("source_row_id")
    tables = {(o, m): make(o, m) for o in ev.OUTCOMES for m in UPLIFT_MODELS}
    tables["visit", "s_learner"] = tables["visit", "s_learner"].where(i % 50 != 3)
    tables["conversion", "t_learner"] = tables["conversion", "t_learner"].withColumn("treatment", F.when(i % 70 == 9, 1 - F.col("treatment")).otherwise(F.col("treatment")).cast("tinyint"))
    tables["visit", "x_learner"] = tables["visit", "x_learner"].withColumn("observed_outcome", F.when(i % 30 == 1, F.lit(0)).cast("tinyint"))
    tables["visit", "t_learner"] = tables["visit", "t_learner"].withColumn("model_config_hash", F.when(i % 60 == 2, F.lit("x")).otherwise(F.col("model_config_hash")))
    rows = make("exposure", "s_learner").where(i % 40 == 7).unionByName(make("conversion", "x_learner").where(i % 40 == 6))
    for table in tables.values():
        rows = rows.unionByName(table)
    return artifacts.handoff_checks(rows, ev.OUTCOMES, UPLIFT_MODELS, config, source)


@query(
    f"""WITH {EXP}, a AS (SELECT source_row_id, treatment FROM exp WHERE source_row_id % 11 <> 2), b AS (SELECT source_row_id, CASE WHEN source_row_id % 13 = 4 THEN 1 - treatment ELSE treatment END AS treatment FROM exp WHERE source_row_id % 17 <> 5)
SELECT count(*) FILTER (WHERE b.source_row_id IS NULL) AS left_only, count(*) FILTER (WHERE a.source_row_id IS NULL) AS right_only, 0::BIGINT AS repeated, count(*) FILTER (WHERE a.treatment <> b.treatment) AS arms_differ, false AS aligned FROM a FULL JOIN b ON a.source_row_id = b.source_row_id"""
)
def cross_outcome_alignment(spark, sf_dir):
    """Rows of two outcomes of which some lack or have other arms."""
    view, i = experiment(spark, sf_dir, items=False).select("source_row_id", "treatment"), F.col("source_row_id")
    return audit.cross_outcome_alignment(view.where(i % 11 != 2), view.where(i % 17 != 5).withColumn("treatment", F.when(i % 13 == 4, 1 - F.col("treatment")).otherwise(F.col("treatment"))))


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 1 THEN 'Z' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_orderkey % 7 <> 3),
x AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS right_only) SELECT *, left_only = 0 AND right_only = 0 AS equal FROM x"""
)
def frame_difference(spark, sf_dir):
    """Line items against line items of which some were changed or taken away; rows may repeat."""
    a = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag")
    b = a.where("l_orderkey % 7 <> 3").withColumn("l_returnflag", F.when(F.col("l_orderkey") % 9 == 1, F.lit("Z")).otherwise(F.col("l_returnflag")))
    return audit.frame_difference(a, b.select("l_returnflag", "l_linenumber", "l_orderkey"))


_REPLAYED = ["s_learner", RESPONSE_MODEL]
_REPLAYS = 100


def _replay_sql(name: str, source: str) -> str:
    return f"{paired_sql(_REPLAYED, _REPLAYS, source=source, name=name)}, {draw_curves_sql(name, name)}, {long_metrics_sql(name + '_ba', name + '_bc', name + '_v', named=False)}"


@query(
    f"""WITH {_rk(models=_REPLAYED)}, tk AS (SELECT * REPLACE (CASE WHEN outcome = 1 AND source_row_id % 23 = 5 THEN 0 ELSE outcome END AS outcome) FROM rk),
{_replay_sql('ra', 'rk')}, {_replay_sql('rb', 'tk')},
x AS (SELECT a.value AS a, b.value AS b FROM ra_v a LEFT JOIN rb_v b USING (replicate, o, m, metric))
SELECT 'as saved' AS case_name, count(*) AS draws, 0::BIGINT AS wrong_draws, true AS replayed FROM x UNION ALL SELECT 'cells changed', count(*), count(*) FILTER (WHERE a IS DISTINCT FROM b AND NOT coalesce(abs(a - b) <= 1e-6 * greatest(1.0, abs(b)), false)), false FROM x
UNION ALL SELECT 'draws changed', count(*), count(*) FILTER (WHERE b IS NOT NULL AND metric = 'qini' AND replicate % 10 = 3), false FROM (SELECT metric, replicate, value AS b FROM ra_v)"""
)
def bootstrap_replay(spark, sf_dir):
    """The audit draws the bootstrap again from the saved cells and stream keys; a copy with other cells and one with other draws must show."""
    rows = _ranked(spark, sf_dir, models=_REPLAYED)
    saved = files.written(bootstrap.weighted_cells(bootstrap.joint_cells(rows, _REPLAYED, G), _REPLAYED, 1, groups=G).drop("replicate", "weight"), "saved-cells")
    cells = saved.drop("stream_key")
    values = files.written(bootstrap.draw_metrics(bootstrap.paired_draws(cells, _REPLAYED, _REPLAYS, groups=G), G), "saved-draws")
    lost = (F.col("outcome") == 1) & (F.col("source_row_id") % 23 == 5)
    other = bootstrap.joint_cells(rows.withColumn("outcome", F.when(lost, F.lit(0)).otherwise(F.col("outcome"))), _REPLAYED, G)
    shifted = F.when((F.col("metric") == "qini") & (F.col("replicate") % 10 == 3), F.col("value") + 1 + F.abs("value") * 0.01).otherwise(F.col("value"))
    cases = {"as saved": (saved, values), "cells changed": (bootstrap.with_stream_keys(other, _REPLAYED, G), values), "draws changed": (saved, values.withColumn("value", shifted))}
    out = None
    for name, (own, claimed) in cases.items():
        part = bootstrap.replayed(own, claimed, _REPLAYED, _REPLAYS, groups=G, tolerance=1e-6).select(F.lit(name).alias("case_name"), "draws", "wrong_draws", "replayed")
        out = part if out is None else out.unionByName(part)
    return out


#: (case, what it leaks)
_LEAKS = [("clean", ""), ("joined_features", ""), ("score", "score"), ("filter", "rows"), ("window", "rows,score"), ("aggregate", "rows,score"), ("python", "score"), ("order", "rows")]


@query("WITH p AS (" + f"WITH {EXP}, {PART} SELECT count(*) FILTER (WHERE data_partition = 'test') AS n FROM part" + ") SELECT case_name, leaked, leaked <> '' AS refused, n AS test_rows FROM p, (VALUES " + ", ".join(f"('{c}', '{x}')" for c, x in _LEAKS) + ") v(case_name, leaked)")
def leak_checks(spark, sf_dir):
    """Scorings of test rows of which most read an outcome, in one way or another; the proof from the plan must refuse just these."""
    test = _parts(spark, sf_dir)["test"]
    keys = ["source_row_id", "treatment"]
    plain = test.select(*keys, (F.col("f1") * 2 - F.col("f0")).alias("score"))

    def rescored(frames):
        for frame in frames:
            yield frame[["source_row_id", "treatment"]].assign(score=frame["visit"].astype("float64"))

    frames = {
        "clean": plain,
        "joined_features": plain.drop("score").join(test.groupBy("f3").agg(F.avg("f0").alias("mean")).join(test.select("source_row_id", "f3"), "f3"), "source_row_id").select(*keys, F.col("mean").alias("score")),
        "score": test.withColumn("y", F.col("conversion") + 0.0).select(*keys, (F.col("f1") + F.col("y") * 1e-6).alias("score")),
        "filter": test.where("visit = 1 or f1 > 0").select(*keys, F.col("f1").alias("score")),
        "window": test.select(*keys, F.row_number().over(Window.partitionBy("f3").orderBy("visit", "source_row_id")).alias("score")),
        "aggregate": test.groupBy(*keys, "exposure").agg(F.max("visit").alias("score")).drop("exposure"),
        "python": test.select(*keys, "visit").mapInPandas(rescored, "source_row_id long, treatment int, score double").select(F.lit(0).alias("source_row_id"), F.lit(0).alias("treatment"), "score"),
        "order": test.orderBy("conversion").select(*keys, F.col("f2").alias("score")),
    }
    found = []
    for name, df in frames.items():
        leaked = sorted(lineage.leaks(df, _OUTCOME_COLUMNS))
        found.append((name, ",".join(leaked), bool(leaked)))
    n = test.agg(F.count(F.lit(1)).alias("test_rows")).withColumn("k", F.lit(1))
    return spark.createDataFrame(found, "case_name string, leaked string, refused boolean").withColumn("k", F.lit(1)).join(F.broadcast(n), "k").drop("k")  # one row


@query(
    f"""WITH {EXP}, t AS (SELECT treatment, count(*) AS n, sum(visit) AS y FROM exp GROUP BY 1), u AS (SELECT treatment, count(*) AS n, sum(visit) AS y FROM exp WHERE source_row_id % 3 <> 1 GROUP BY 1)
SELECT step, action, versions, treatment, n, y::BIGINT AS y FROM (VALUES (1, 'built', 1), (2, 'reused', 1), (4, 'reused', 2), (5, 'built', 3), (6, 'repaired', 3)) s(step, action, versions), t
UNION ALL SELECT 3, 'built', 2, treatment, n, y FROM u"""
)
def resumed_stages(spark, sf_dir):
    """Arm counts as a stored stage: made, reused, made for a changed input, reused for the first one, made for another configuration, and repaired after a lost file."""
    view = experiment(spark, sf_dir, items=False)
    stored = stages.Stages(spark, files.scratch(spark, "stages"))
    part = view.where("source_row_id % 3 <> 1")
    steps = [(view, {"by": "arm"}), (view, {"by": "arm"}), (part, {"by": "arm"}), (view, {"by": "arm"}), (view, {"by": "arm", "seed": 2})]
    out = None

    def step(rows, configuration):
        return stored.table("arms", configuration, {"view": rows.select("source_row_id", "treatment", "visit")}, lambda: rows.groupBy("treatment").agg(F.count(F.lit(1)).alias("n"), F.sum("visit").alias("y")))

    for i, (rows, configuration) in enumerate([*steps, steps[-1]], 1):
        if i == len(steps) + 1:
            last = found.inputFiles()[0]
            path, fs = stored._fs(last.rsplit("/", 1)[0] + "/_SUCCESS")
            fs.delete(path, False)
        found, action = step(rows, configuration)
        own = files.written(found.select(F.lit(i).alias("step"), F.lit(action).alias("action"), F.lit(stored.keys("arms")).alias("versions"), "treatment", "n", "y"), "step")
        out = own if out is None else out.unionByName(own)
    return out


@query(
    """WITH o AS (SELECT count(*) AS n FROM orders) SELECT step, n AS rows, found FROM o, (VALUES ('created', 'made'), ('created_again', 'kept'), ('json', 'equal'), ('digest', 'equal'), ('digest_of_changed', 'differs'),
('cleaned', 'a.csv,b.json'), ('models', 'equal'), ('locked', 'refused,run,refused,run'), ('memoised', 'made,kept,made'), ('model_columns', 'refused,refused,accepted')) v(step, found)
UNION ALL SELECT 'described', count(*), string_agg(name, ',' ORDER BY name) FROM (SELECT unnest(['o_custkey', 'o_orderkey', 'o_totalprice']) AS name)"""
)
def sources_and_protocol(spark, sf_dir):
    """Files and the protocol over the orders table: created once, JSON and digests, description, clean-up, saved models, lock, memo, model columns."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    folder, out = files.scratch(spark, "protocol"), []
    made = []

    def make():
        made.append(1)
        return orders

    for name in ("created", "created_again"):
        before = len(made)
        table = files.create_if_absent(spark, f"{folder}/orders", make)
        out.append((name, "made" if len(made) > before else "kept"))
    n = table.count()
    value = {"rows": n, "sum": str(table.agg(F.sum("o_orderkey")).first()[0]), "text": "é\n"}
    files.write_json(spark, value, f"{folder}/value.json")
    out.append(("json", "equal" if files.read_json(spark, f"{folder}/value.json") == value else "differs"))
    files.create_if_absent(spark, f"{folder}/changed", lambda: orders.withColumn("changed", F.col("o_orderkey") % 2 == 0))
    digests = [files.table_sha256(spark, f"{folder}/{name}") for name in ("orders", "orders", "changed")]  # all files: the first one may have no rows
    out += [("digest", "equal" if digests[0] == digests[1] else "differs"), ("digest_of_changed", "equal" if digests[0] == digests[2] else "differs")]
    for name in ("a.csv", "b.json", "keep.md"):
        p, fs = stages.Stages(spark, folder)._fs(f"{folder}/generated/{name}")
        fs.create(p).close()
    out.append(("cleaned", ",".join(files.remove_generated(spark, f"{folder}/generated", (".csv", ".json")))))
    rows = experiment(spark, sf_dir, items=False).select("source_row_id", "f0", "f1", "treatment", "visit")
    grown = boosting.fit(rows, [boosting.Fit("m", ["f0", "f1", "treatment"], F.col("visit"))], boosting.Boosting(rounds=1, depth=2, bins=4))
    learners.save_models(grown, f"{folder}/models", spark)
    again = learners.load_models(f"{folder}/models", spark)
    both = rows.agg(F.count_if(~boosting.margin(grown["m"]).eqNullSafe(boosting.margin(again["m"]))).alias("n")).first().n
    out.append(("models", "equal" if both == 0 else "differs"))
    protocol, did = artifacts.Protocol(spark, folder), []
    for spec in (None, {"rates": [10]}, {"rates": [10]}, {"rates": [10, 20]}):
        if spec and len(did) != 2:
            protocol.lock(spec)
        try:
            protocol.evaluate(spec or {}, lambda: None)
            did.append("run")
        except ValueError:
            did.append("refused")
    out.append(("locked", ",".join(did)))
    memo, kinds = [], []
    for key in ({"k": 1}, {"k": 1}, {"k": 2}):
        before = len(memo)
        protocol.memoised("rows", key, lambda: memo.append(1) or n)
        kinds.append("made" if len(memo) > before else "kept")
    out.append(("memoised", ",".join(kinds)))
    checked = []
    for columns in ([*FEATURES, "visit"], FEATURES[1:], FEATURES):
        try:
            audit.check_model_columns(columns)
            checked.append("accepted")
        except ValueError:
            checked.append("refused")
    out.append(("model_columns", ",".join(checked)))
    found = spark.createDataFrame([(s, n, f) for s, f in out], "step string, rows long, found string")
    described = files.describe(orders).agg(F.lit("described").alias("step"), F.count(F.lit(1)).alias("rows"), F.array_join(F.sort_array(F.collect_list("column_name")), ",").alias("found"))
    return found.unionByName(described)


_COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _COUNTED))
def metadata_row_counts(spark, sf_dir):
    """Rows of every table, from footers."""
    out = None
    for t in _COUNTED:
        one = files.row_count(spark, f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS rows, CAST(sum(p_size) AS BIGINT) AS sizes, count(DISTINCT p_brand) AS brands, round(sum(p_retailprice), 2) AS prices FROM part")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read back with inferred types."""
    path = files.scratch(spark, "csv")
    files.write_csv(spark.read.parquet(f"{sf_dir}/part.parquet"), path)
    rows = files.read_csv(spark, path, None)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("p_size").cast("long")).alias("sizes"), F.count_distinct("p_brand").alias("brands"), F.round(F.sum("p_retailprice"), 2).alias("prices"))


@query("WITH r AS (SELECT row_number() OVER () - 1 AS id, o_orderkey FROM orders) SELECT count(*) AS rows, min(id) AS least_id, max(id) AS greatest_id, CAST(sum(id * (o_orderkey % 1000)) AS BIGINT) AS weighted FROM r")
def physical_row_ids(spark, sf_dir):
    """Dense ids in the order of the file."""
    rows = files.with_row_ids(spark, f"{sf_dir}/orders.parquet")
    i = F.col("source_row_id")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min(i).alias("least_id"), F.max(i).alias("greatest_id"), F.sum(i * (F.col("o_orderkey") % 1000)).alias("weighted"))


@query("SELECT p_brand, count(*) AS rows, min(p_size) AS least_size FROM part WHERE p_size > 10 GROUP BY p_brand")
def partitioned_sink(spark, sf_dir):
    """A table written once, in folders by brand, and read with a filter and chosen columns."""
    path = files.scratch(spark, "sink")
    files.write_parquet(spark.read.parquet(f"{sf_dir}/part.parquet"), path, partition_by=["p_brand"])
    rows = files.read_parquet(spark, path, ["p_brand", "p_size"], "p_size > 10")
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("rows"), F.min("p_size").alias("least_size"))


__all__ = ["ORACLES", "QUERIES"]
