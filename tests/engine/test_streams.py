"""Random numbers from counters: quantiles against other implementations, moments, and the bootstrap against multinomial draws."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import streams
from quern.operators import bootstrap, curves, ranking


def test_normal_quantile_is_the_standard_librarys(spark):
    us = [1e-9, 1e-4, 0.02, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.9251, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(u,) for u in us], "u double").select("u", streams.normal_quantile(F.col("u")).alias("z")).collect()
    assert all(math.isclose(r.z, statistics.NormalDist().inv_cdf(r.u), rel_tol=1e-12, abs_tol=1e-12) for r in got)


def test_uniform_numbers(spark):
    rows = streams.with_uniform(spark.range(200_000).withColumnRenamed("id", "counter"), "counter", 5, "u")
    r = rows.agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.avg("u").alias("mean"), F.variance("u").alias("v"), F.count_distinct("u").alias("n"), F.corr("u", "counter").alias("c")).first()
    assert 0 < r.lo < 1e-4 and 1 - 1e-4 < r.hi < 1 and r.n == 200_000
    assert abs(r.mean - 0.5) < 0.003 and abs(r.v - 1 / 12) < 0.001 and abs(r.c) < 0.01
    few = rows.repartition(17).where("counter < 100").orderBy("counter").select("u").collect()
    assert few == rows.where("counter < 100").orderBy("counter").select("u").collect()  # wherever they are drawn


@pytest.mark.parametrize("mean", [1, 3, 31, 32, 400])
def test_poisson_moments(spark, mean):
    rows = streams.with_uniform(spark.range(100_000).withColumnRenamed("id", "counter"), "counter", mean, "u")
    r = rows.select(streams.poisson_quantile(F.lit(mean).cast("long"), F.col("u")).alias("w")).agg(F.avg("w").alias("m"), F.variance("w").alias("v"), F.skewness("w").alias("s"), F.min("w").alias("lo")).first()
    assert abs(r.m - mean) < 4 * math.sqrt(mean / 100_000) and abs(r.v / mean - 1) < 0.02 and abs(r.s - 1 / math.sqrt(mean)) < 0.05 and r.lo >= 0


@pytest.mark.parametrize("n,y", [(10, 3), (10, 0), (10, 10), (5000, 12), (5000, 4990), (100_000, 40_000)])
def test_binomial_moments(spark, n, y):
    rows = streams.with_uniform(spark.range(50_000).withColumnRenamed("id", "counter"), "counter", n + y, "u").withColumn("n", F.lit(n).cast("long")).withColumn("y", F.lit(y).cast("long"))
    drawn = rows.withColumn("t", streams.binomial_table(F.col("n"), F.col("y"))).select(streams.binomial_quantile(F.col("n"), F.col("y"), F.col("t"), F.col("u")).alias("k"))
    r = drawn.agg(F.avg("k").alias("m"), F.var_pop("k").alias("v"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    variance = y * (1 - y / n)
    assert 0 <= r.lo and r.hi <= n and abs(r.m - y) <= 4 * math.sqrt(variance / 50_000) and abs(r.v - variance) <= 0.03 * variance


def some_ranked(spark, rows=4000):
    rng = np.random.default_rng(3)
    data = []
    for i in range(rows):
        t, s = int(rng.integers(0, 2)), float(rng.random())
        y = int(rng.random() < 0.2 + 0.2 * t * s)
        data += [("s_learner", i, s, t, y), ("response_propensity", i, float((i * 37) % 101), t, y)]
    return ranking.ranked(spark.createDataFrame(data, "model_name string, source_row_id long, score double, treatment int, outcome int"))


def test_paired_draws_against_multinomial_ones(spark):
    models, n = ["s_learner", "response_propensity"], 400
    cells = bootstrap.joint_cells(some_ranked(spark), models, 20).cache()
    weighted = bootstrap.weighted_cells(cells, models, n)
    r = weighted.agg(F.sum("weight").alias("w"), F.sum("cell_rows").alias("c"), F.sum((F.col("weight") - F.col("cell_rows")) ** 2).alias("d")).first()
    assert abs(r.w / r.c - 1) < 0.002 and abs(r.d / r.c - 1) < 0.02  # mean and variance 1 for each row
    per = weighted.groupBy("replicate").agg(F.sort_array(F.collect_list(F.struct("stream_key", "weight"))).alias("x"))
    assert per.select(F.sha2(F.to_json("x"), 256).alias("h")).distinct().count() == n
    draws = bootstrap.paired_draws(cells, models, n)
    again = bootstrap.paired_draws(cells.repartition(13), models, n)
    assert draws.exceptAll(again).isEmpty()
    got = {(x.model_name, x.metric): (x.ci_lower, x.ci_upper) for x in bootstrap.bootstrap_summary(bootstrap.draw_metrics(draws, models=models[:1])).collect()}
    table = cells.toPandas()
    counts, rng, parts = table["cell_rows"].to_numpy(), np.random.default_rng(1), []
    for rep in range(n):
        w = rng.multinomial(counts.sum(), counts / counts.sum())
        for m in models:
            for b in range(20):
                own = [(w[(table[f"g_{m}"] == b) & (table["treatment"] == t) & (table["outcome"] >= y)].sum()) for t, y in ((0, 0), (1, 0), (0, 1), (1, 1))]
                parts.append((rep, m, b, *map(int, own)))
    other = spark.createDataFrame(parts, "replicate int, model_name string, bucket int, n0 long, n1 long, y0 long, y1 long")
    want = {(x.model_name, x.metric): (x.ci_lower, x.ci_upper) for x in bootstrap.bootstrap_summary(bootstrap.draw_metrics(other, models=models[:1])).collect()}
    assert set(got) == set(want)
    for key, (lo, hi) in want.items():
        width = hi - lo
        assert abs(got[key][0] - lo) < 0.2 * width and abs(got[key][1] - hi) < 0.2 * width, key  # 400 draws place an end within about a tenth
    widths = [(got[k][1] - got[k][0]) / (want[k][1] - want[k][0]) for k in want]
    assert abs(statistics.mean(widths) - 1) < 0.05


def test_too_many_rankings(spark):
    cells = spark.createDataFrame([(1, 1, 1, 5)], "g_a int, treatment int, outcome int, cell_rows long")
    with pytest.raises(ValueError, match="rankings"):
        bootstrap.weighted_cells(cells.select("*", *[F.lit(0).alias(f"g_{i}") for i in range(12)]), [str(i) for i in range(12)], 10)
