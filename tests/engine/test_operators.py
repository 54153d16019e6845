"""Worked examples and invariants of single operators."""

import json
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.scalar import log_normal_tail, p_value_text, with_tie_key
from quern.operators import artifacts, audit, boosting, bootstrap, curves, effects, learners, policy, ranking, segments
from quern.operators.boosting import Boosting, Fit
from quern.plans import evaluation as ev
from quern.plans.experiment import FEATURES
from quern.sources import files

LONG = "model_name string, source_row_id long, score double, treatment int, outcome int"


def long(spark, rows, model="m"):
    return spark.createDataFrame([(model, *r) for r in rows], LONG)


def heterogeneous():
    out = []
    for i in range(20_000):
        t, hi = i % 2, i < 10_000
        y = int((t == 0 and i % 20 < 2) or (t == 1 and (i % 20 < 6 if hi else i % 20 < 2)))
        out.append((i, 0.2 if hi else 0.0, t, y))
    return out


def splitmix(x, seed):
    m = (1 << 64) - 1
    x = (x + seed + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def test_tie_key_is_splitmix(spark):
    ids = [0, 1, 2, 12345, 2**40, 2**62]
    got = with_tie_key(spark.createDataFrame([(i,) for i in ids], "i long"), "i", 17, "k").collect()
    assert {r.i: (r.k % (1 << 64)) ^ (1 << 63) for r in got} == {i: splitmix(i, 17) for i in ids}


def test_heterogeneous_effects_have_positive_qini(spark):
    curve = curves.cumulative_gain(ranking.ranked(long(spark, heterogeneous())), 20)
    m = curves.curve_metrics(curve).first()
    rows = heterogeneous()
    rate = lambda t: np.mean([r[3] for r in rows if r[2] == t])
    assert m.qini > 0 and math.isclose(m.endpoint_gain, 20_000 * (rate(1) - rate(0)))


def test_eight_rows(spark):
    t, y, s = [0, 1] * 4, [0, 1, 0, 1, 0, 0, 0, 0], [1.0] * 4 + [0.0] * 4
    m = curves.curve_metrics(curves.cumulative_gain(ranking.ranked(long(spark, list(zip(range(8), s, t, y)))), 2)).first()
    assert m.qini > 0 and m.endpoint_gain == 4.0


def test_ties_are_broken_by_hash(spark):
    rows = [(5, 0.5, 0, 0), (2, 0.5, 1, 0), (9, 0.1, 0, 0), (1, 0.1, 1, 0)]
    got = {r.source_row_id: r.b for r in ranking.ranked(long(spark, rows)).withColumn("b", ranking.bucket(2)).collect()}
    assert got == {5: 0, 2: 0, 9: 1, 1: 1}


def test_ranks_equal_a_sort(spark):
    rng = random.Random(5)
    frames = {m: [(i, float(rng.randrange(-3, 40)), 0, 0) for i in rng.sample(range(10**6), n)] for m, n in (("a", 700), ("b", 1), ("c", 300), ("d", 55))}
    df = None
    for m, rows in frames.items():
        df = long(spark, rows, m) if df is None else df.union(long(spark, rows, m))
    got = {(r.model_name, r.source_row_id): (r.rank, r.n) for r in ranking.ranked(df.repartition(7), seed=3).collect()}
    for m, rows in frames.items():
        order = sorted(rows, key=lambda r: (-r[1], splitmix(r[0], 3)))
        assert [got[m, r[0]] for r in order] == [(k, len(rows)) for k in range(len(rows))]


def test_top_fraction_takes_exactly_its_share(spark):
    rows = [(i, float(i < 50), 0, 0) for i in range(100)]
    top = ranking.ranked(long(spark, rows), seed=17).where(ranking.in_top(0.30)).collect()
    assert len(top) == 30 and all(r.score == 1.0 for r in top)


def test_average_ranks(spark):
    rng = random.Random(1)
    values = [(g, float(rng.randrange(12))) for g in "ab" for _ in range(200)]
    got = ranking.average_ranks(spark.createDataFrame(values, "g string, v double"), "v", ["g"]).collect()
    for r in got:
        own = [v for g, v in values if g == r.g]
        below, equal = sum(v < r.v for v in own), sum(v == r.v for v in own)
        assert r.v_rank == below + (equal + 1) / 2


def test_calibration_line(spark):
    rows = [("m", i + 1, 1000, 0.4 - 0.1 * i, 0.20 - 0.05 * i) for i in range(4)]
    schema = "model_name string, score_group int, group_rows long, mean_predicted_score double, observed_uplift double"
    r = curves.calibration(spark.createDataFrame(rows, schema)).first()
    assert math.isclose(r.slope, 0.5) and abs(r.intercept) < 1e-12 and r.ranking_changed is False
    flat = curves.calibration(spark.createDataFrame([("m", 1, 10, 0.1, 0.2), ("m", 2, 10, 0.1, 0.3)], schema)).first()
    assert flat.slope is None and flat.intercept is None


def test_pseudo_outcome(spark):
    df = spark.createDataFrame([(1, 1, 0.2, 0.7), (0, 1, 0.3, 0.8), (1, 0, 0.4, 0.6), (0, 0, 0.5, 0.4)], "t int, y int, a double, b double")
    got = [r.x for r in df.select(learners.pseudo_outcome(F.col("t"), F.col("y"), F.col("a"), F.col("b")).alias("x")).collect()]
    np.testing.assert_allclose(got, [0.8, -0.2, -0.4, 0.4])


def test_published_effects(spark):
    """Counts of a public experiment and the effects published for them."""
    cells = spark.createDataFrame(
        [("visit", 2_096_937, 11_882_655, 80_105, 576_824), ("conversion", 2_096_937, 11_882_655, 4_063, 36_711)], "outcome string, n0 long, n1 long, y0 long, y1 long"
    )
    got = {r.outcome: r for r in effects.effect_summary(cells).collect()}
    want = {"visit": (0.0103424, 0.0100556, 0.0106292, 0.270737, 0.261566, 0.279974, 122_895.2), "conversion": (0.00115187, 0.00108450, 0.00121924, 0.594488, 0.543697, 0.646951, 13_687.3)}
    for o, w in want.items():
        r = got[o]
        np.testing.assert_allclose((r.absolute_lift, r.absolute_ci_lower, r.absolute_ci_upper, r.relative_lift, r.relative_ci_lower, r.relative_ci_upper, r.incremental_treated), w, rtol=1e-5)
    tests = {r.outcome: r for r in effects.holm(effects.z_tests(cells)).collect()}
    np.testing.assert_allclose([tests["visit"].z_statistic, tests["conversion"].z_statistic], [65.2474, 28.5165], rtol=1e-5)
    np.testing.assert_allclose([tests["visit"].log10_p_value, tests["conversion"].log10_p_value], [-926.358, -178.136], rtol=1e-5)
    assert tests["visit"].p_value == 0.0 and tests["visit"].p_value_display == "<1e-926" and tests["conversion"].p_value_display.endswith("e-179")
    assert tests["visit"].reject and tests["conversion"].reject


def test_normal_tail(spark):
    zs = [0.0, 0.3, 1.0, 1.9, 1.999, 2.0, 2.001, 3.0, 6.0, 8.0, -2.5]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(log_normal_tail(F.col("z")).alias("p")).collect()
    np.testing.assert_allclose([r.p for r in got], [math.log(math.erfc(abs(z) / math.sqrt(2)) / 2) for z in zs], rtol=1e-9)


def test_p_value_text(spark):
    df = spark.createDataFrame([(0.0123456, -1.9), (0.0, -926.358)], "p double, l double")
    assert [r[0] for r in df.select(p_value_text(F.col("p"), F.col("l"))).collect()] == ["1.235e-02", "<1e-926"]


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "outcome string, p_value double")
    got = {r.outcome: r.holm_p_value for r in effects.holm(df).collect()}
    np.testing.assert_allclose([got[k] for k in "abcd"], [0.04, 0.09, 0.09, 0.9])


def test_empty_arm_is_undefined(spark):
    df = spark.createDataFrame([(0, 10, 0, 3)], "n0 long, n1 long, y0 long, y1 long")
    r = effects.difference_in_rates(df).first()
    assert r.uplift is None and r.uplift_ci_lower is None and r.p1 is None


def test_row_level_curve_equals_cells(spark):
    rng = random.Random(3)
    for n in (7, 20, 33, 1009):
        rows = [(i, float(rng.randrange(50)), rng.randrange(2), rng.randrange(2)) for i in range(n)]
        r = ranking.ranked(long(spark, rows))
        a = {round(x.target_fraction * 5): (x.selected_rows, x.cumulative_gain) for x in curves.cumulative_gain(r, 5).collect()}
        b = {x.point: (x.selected_rows, x.cumulative_gain) for x in curves.row_level_curve(r, 5).collect()}
        assert a == b


def test_segment_rule_puts_edges_above(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (3.0,)], "v double")
    got = [r[0] for r in df.select(segments.segment_of(F.col("v"), F.lit([2.0, 3.0]).cast("array<float>"))).collect()]
    assert got == [0, 1, 1, 2]


def test_segment_effects_recover_groups(spark):
    rows = [(i, t, int(i % 10 < (4 if g == 0 and t else 2)), g) for g in (0, 1) for t in (0, 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "source_row_id long, treatment int, outcome int, segment int").withColumn("feature", F.lit("f")).withColumn("bins", F.lit(2))
    got = {r.segment: r.effect for r in segments.segment_effects(df).collect()}
    assert got[0] > got[1] == 0.0


def test_bootstraps(spark):
    rows = heterogeneous()[::7]
    models = ["s_learner", "t_learner", "x_learner", "response_propensity"]
    factors = dict(zip(models, (1.0, 0.9, 1.1, -1.0)))
    df = None
    for m, f in factors.items():
        part = long(spark, [(i, s * f, t, y) for i, s, t, y in rows], m)
        df = part if df is None else df.union(part)
    ranked = ranking.ranked(df)
    cells = bootstrap.joint_cells(ranked, models, 20)
    assert cells.agg(F.sum("cell_rows")).first()[0] == len(rows)
    values = bootstrap.draw_metrics(bootstrap.paired_draws(cells, models, 20, seed=7))
    found = bootstrap.bootstrap_summary(values)
    metrics = {(r.model_name, r.metric) for r in found.collect()}
    assert ("s_learner", "qini_minus_response") in metrics and ("t_learner", "qini_minus_s_learner") in metrics and ("s_learner", "qini_minus_t_learner") not in metrics
    assert ("s_learner", "gain_at_10pct") in metrics and ("x_learner", "gain_at_30pct_minus_response") in metrics
    again = bootstrap.bootstrap_summary(bootstrap.draw_metrics(bootstrap.paired_draws(cells, models, 20, seed=7)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    curve = curves.cumulative_gain(ranked)
    named = ranked.withColumn("model_name", F.concat(F.lit("visit:"), "model_name"))
    intervals = ev.uncertainty(named, 200, 20, models)
    whole = curves.cumulative_gain(named)
    chosen = ev.recommendations(ev.model_comparison(ev.named(curves.curve_metrics(whole)), intervals), intervals, ev.policy_table(whole, intervals)).first()
    assert chosen.beats_response and chosen.deployment_ranking == chosen.recommended_uplift_model == "s_learner"
    kinds = F.col("metric").isin("auuc", "qini") | F.col("metric").rlike("^gain_at_[0-9]+pct$")
    assert intervals.where(kinds).where("estimate < ci_lower or estimate > ci_upper").isEmpty()
    points = policy.with_intervals(policy.policy_summary(curve), found).collect()
    assert all((r.incremental_gain_ci_lower is not None) == (r.percent in (10, 20, 30)) for r in points)
    cells2 = spark.createDataFrame([("visit", 1000, 5000, 100, 700)], "outcome string, n0 long, n1 long, y0 long, y1 long")
    draws, n, _ = bootstrap.escalated_draws(cells2, 200, 400, strict=False)
    assert n in (200, 400) and draws.count() == n
    with pytest.raises(ValueError, match="halves"):
        bootstrap.escalated_draws(cells2, 20, 30)
    for wrong in (0, bootstrap.MOST_REPLICATES + 1):
        with pytest.raises(ValueError, match="replicates"):
            bootstrap.binomial_draws(cells2, wrong)


def test_split_keeps_equal_rows_together(spark):
    df = spark.createDataFrame([tuple(float(i % 50 + j) for j in range(12)) for i in range(400)], ", ".join(f"{f} double" for f in FEATURES))
    parts = audit.with_partition(df)
    assert parts.groupBy(*FEATURES).agg(F.count_distinct("data_partition").alias("k")).where("k > 1").count() == 0
    assert audit.split_mismatches(parts).first().mismatches == 0


def test_model_columns():
    audit.check_model_columns(FEATURES)
    for bad in ([*FEATURES, "exposure"], FEATURES[1:], [*FEATURES, "f0"]):
        with pytest.raises(ValueError):
            audit.check_model_columns(bad)


def test_one_to_one_refuses_other_keys(spark):
    a, b = (spark.createDataFrame([(k, 1) for k in ks], "k long, v int") for ks in ([1, 2, 3], [1, 2, 2]))
    with pytest.raises(Exception, match="one to one"):
        audit.one_to_one(a, b.withColumnRenamed("v", "w"), "k").collect()
    diff = audit.key_set_difference(a, b, "k").first()
    assert (diff.left_only, diff.right_only, diff.repeated, diff.equal) == (1, 0, 1, False)


def test_artifacts_and_protocol(spark):
    rows = spark.createDataFrame([(i, i % 2, 0.1 * i) for i in range(4)], "source_row_id long, treatment int, s double")
    what = {"split": "test", "outcome": "visit", "model": "s_learner", "config_hash": "a", "source_hash": "b"}
    blind = artifacts.prediction_artifact(rows, "s", **what)
    assert blind.columns == artifacts.PREDICTION_COLUMNS and dict(blind.dtypes)["observed_outcome"] == "tinyint" and dict(blind.dtypes)["uplift_hat"] == "float"
    assert artifacts.violations(artifacts.artifact_checks(blind, **what)) == []
    seen = artifacts.prediction_artifact(rows.union(rows), "s", observed="treatment", **what)
    assert artifacts.violations(artifacts.artifact_checks(seen, **{**what, "model": "x"})) == ["repeated_ids", "unblinded_rows", "wrong_model"]
    protocol = artifacts.Protocol(spark, files.scratch(spark, "protocol"))
    with pytest.raises(ValueError):
        protocol.check_frozen({"a": 1}, "s")
    protocol.freeze({"a": 1}, "s")
    protocol.check_frozen({"a": 1}, "s")
    with pytest.raises(ValueError):
        protocol.check_frozen({"a": 2}, "s")
    protocol.lock({"rates": [10]})
    with pytest.raises(ValueError):
        protocol.evaluate({"rates": [20]}, dict)
    assert protocol.evaluate({"rates": [10]}, lambda: 5) == 5
    with pytest.raises(ValueError, match="used"):
        protocol.evaluate({"rates": [10]}, lambda: 6)
    assert protocol.evaluate({"rates": [10]}, lambda: 6, again=True) == 6
    protocol.lock({"rates": [10]}, inputs={"handoff": "a"})
    with pytest.raises(ValueError, match="locked"):
        protocol.evaluate({"rates": [10]}, dict, inputs={"handoff": "b"})
    assert protocol.evaluate({"rates": [10]}, lambda: 7, inputs={"handoff": "a"}) == 7
    assert protocol.memoised("m", {"k": 1}, lambda: 1) == protocol.memoised("m", {"k": 1}, lambda: 2) == 1
    assert protocol.memoised("m", {"k": 2}, lambda: 3) == 3
    assert artifacts.canonical_hash({"b": 1, "a": "é"}) == artifacts.canonical_hash(json.loads('{"a":"é","b":1}'))


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    made = []
    make = lambda: made.append(1) or spark.range(10).toDF("x")
    assert files.create_if_absent(spark, path, make).count() == files.create_if_absent(spark, path, make).count() == 10 and made == [1]
    files.write_parquet(spark.range(100).repartition(3), path)
    ids = [r.source_row_id for r in files.with_row_ids(spark, path).collect()]
    assert sorted(ids) == list(range(100))
    assert files.read_parquet(spark, path, ["id"], "id < 5").count() == 5
    import gzip

    header = ",".join([*FEATURES, "treatment", "conversion", "visit", "exposure"])
    with gzip.open(tmp_path / "raw.csv.gz", "wt") as f:
        f.write(header + "\n" + ",".join(["1.5"] * 12 + ["1", "0", "1", "0"]) + "\n")
    r = files.read_csv(spark, f"file://{tmp_path}/raw.csv.gz", partitions=2).first()
    assert (r.f0, r.treatment, r.conversion) == (1.5, 1, 0)
    files.write_csv(spark.range(3), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 3
    (tmp_path / "gen").mkdir()
    for n in ("a.txt", "b.json", "keep.md"):
        (tmp_path / "gen" / n).write_text("x")
    assert files.remove_generated(spark, f"file://{tmp_path}/gen", (".txt", ".json")) == ["a.txt", "b.json"]
    assert (tmp_path / "gen" / "keep.md").exists()
    import hashlib

    assert files.file_sha256(spark, f"file://{tmp_path}/gen/keep.md") == hashlib.sha256(b"x").hexdigest()
    assert files.describe(spark.range(1)).collect()[0].column_type == "bigint"


def test_learners_save_and_load(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, i % 2, int(rng.random() < (0.6 if i % 2 and i % 3 else 0.2)), *[float(rng.randrange(20)) for _ in range(12)]) for i in range(600)]
    df = spark.createDataFrame(rows, "source_row_id long, treatment int, visit int, " + ", ".join(f"{f} double" for f in FEATURES))
    models = learners.fit_learners(df, "visit", how=Boosting(rounds=2, depth=2))
    learners.save_models(models, f"file://{tmp_path}/models", spark)
    again = learners.load_models(f"file://{tmp_path}/models", spark)
    key = lambda r: r.source_row_id
    a, b = (sorted(learners.score_learners(m, df.drop("visit")).collect(), key=key) for m in (models, again))
    assert a == b and len(a) == 600
    assert dict(learners.score_learners(models, df).dtypes)["s_learner"] == "float"


def test_boosting_stops_early(spark):
    """Labels of noise: with validation rows, boosting ends far before its last round."""
    rng = random.Random(1)
    rows = [(i, i % 2, int(rng.random() < 0.5), *[float(rng.randrange(20)) for _ in range(12)]) for i in range(800)]
    df = spark.createDataFrame(rows, "source_row_id long, treatment int, visit int, " + ", ".join(f"{f} double" for f in FEATURES))
    own, held = df.where("source_row_id < 500"), df.where("source_row_id >= 500")
    how = Boosting(rounds=30, depth=2, rate=0.5, patience=3)
    fits = [Fit("a", FEATURES, F.col("visit"))]
    assert boosting.fit(own, fits, replace(how, rounds=8))["a"].best_round == 8
    model = boosting.fit(own, fits, how, held=held)["a"]
    assert len(model.losses) < 31 and model.best_round == model.losses.index(min(model.losses)) == len(model.losses) - 1 - how.patience


def test_last_ranks_of_null_and_nan(spark):
    rows = [(0, float("nan"), 0, 0), (1, None, 1, 0), (2, -5.0, 0, 1), (3, 7.0, 1, 1)]
    got = {r.source_row_id: r.rank for r in ranking.ranked(long(spark, rows)).collect()}
    assert (got[3], got[2]) == (0, 1) and {got[0], got[1]} == {2, 3}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.integers(0, 7, 501).astype(float), "b": rng.standard_normal(1000), "c": np.array([3.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("d", None)]
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.875, 1.0]
    got = {(r.g, r.share): r.quantile for r in segments.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares).collect()}
    assert set(got) == {(k, s) for k in values for s in shares}
    for (k, s), q in got.items():
        assert math.isclose(q, np.quantile(values[k], s), abs_tol=1e-12)


def test_average_precision_without_groups(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (0.05, 1), (None, 1)]
    found = learners.average_precision(spark.createDataFrame(rows, "p double, y int"), [], "y", "p").first().average_precision
    assert math.isclose(found, 1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)


def test_streaming_counters(spark, sf_dir, tmp_path):
    from quern.streaming.counters import arm_counters

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"file://{tmp_path}/in"
    events.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = arm_counters(stream).writeStream.outputMode("complete").format("memory").queryName("counters").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counters").collect())) == sorted(map(tuple, arm_counters(events).collect()))
