"""Stored stages, the proof of unread columns, ranks of few-valued scores, dealt average ranks, and the replay."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import bootstrap, curves, lineage, ranking, segments
from quern.sources import files, stages


def test_a_stage_is_built_once_and_published_whole(spark, tmp_path):
    store = stages.Stages(spark, f"file://{tmp_path}/stages")
    rows, calls = spark.range(100).withColumn("x", F.col("id") % 7), []

    def make():
        calls.append(1)
        return rows.groupBy("x").count()

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.table("s", {"a": 1}, {"rows": rows}, fails)
    assert store.keys("s") == 0  # nothing looks whole
    first, how = store.table("s", {"a": 1}, {"rows": rows}, make)
    again, then = store.table("s", {"a": 1}, {"rows": rows.orderBy(F.rand(3)).repartition(9)}, make)
    assert (how, then, len(calls)) == ("built", "reused", 1) and sorted(first.collect()) == sorted(again.collect())
    for configuration, inputs in (({"a": 2}, rows), ({"a": 1}, rows.where("id < 99")), ({"a": 1}, rows.withColumn("x", F.col("x").cast("int")))):
        assert store.table("s", configuration, {"rows": inputs}, make)[1] == "built"
    assert store.keys("s") == 4 and not [p for p in (tmp_path / "stages" / "s").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    part = next((tmp_path / "stages" / "s").glob("*/table/part-*.parquet"))
    for p in (tmp_path / "stages" / "s").glob("*/table/part-*.parquet"):
        p.unlink()
    assert part.name and store.table("s", {"a": 1}, {"rows": rows}, make)[1] == "repaired"


def test_digests_of_tables_take_all_their_files(spark, tmp_path):
    for name, kept in (("a", "id > 99"), ("b", "id > 99"), ("c", "id > 150"), ("none", "id < 0")):
        spark.range(0, 200, 1, 2).where(kept).write.parquet(f"file://{tmp_path}/{name}")  # the first file has no rows
    a, b, c, none = (files.table_sha256(spark, f"file://{tmp_path}/{name}") for name in ("a", "b", "c", "none"))
    assert a == b and len({a, c, none}) == 3


def test_a_changed_table_has_another_digest_whatever_its_keys(spark, sf_dir, tmp_path):
    from quern import evaluation_queries

    spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0").limit(200).write.parquet(f"file://{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.parquet(f"file://{tmp_path}/customer.parquet")
    found = {r.step: r.found for r in evaluation_queries.sources_and_protocol(spark, f"file://{tmp_path}").collect()}
    assert (found["digest"], found["digest_of_changed"]) == ("equal", "differs")


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    assert stages.fingerprint(a) == stages.fingerprint(a.repartition(3).select("s", "i"))
    others = [a.where("i = 1"), a.distinct(), a.withColumnRenamed("s", "t"), a.withColumn("s", F.coalesce("s", F.lit("")))]
    assert len({str(stages.fingerprint(x)) for x in [a, *others]}) == 5
    assert stages.fingerprint(a.limit(0))["rows"] == 0


@pytest.fixture(scope="module")
def scanned(spark):
    rows = spark.createDataFrame([(i, i % 2, i % 3, float(i)) for i in range(30)], "id long, y int, g int, f double")
    return files.written(rows, "scanned")


def test_lineage_of_columns(scanned):
    of, control = lineage.sources(scanned.select("id", (F.col("f") * 2 + F.col("g")).alias("s"), F.lit(1).alias("one")))
    assert of == {"id": {"id"}, "s": {"f", "g"}, "one": set()} and not control
    of, control = lineage.sources(scanned.groupBy("g").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 2"))
    assert of == {"g": {"g"}, "s": {"y"}, "n": set()} and control == {"g"}
    union = scanned.select("id", F.col("f").alias("v")).union(scanned.select("id", "y"))
    assert lineage.sources(union)[0]["v"] == {"f", "y"}
    exploded = scanned.select("id", F.explode(F.array("f", "y")).alias("e"))
    assert lineage.sources(exploded)[0] == {"id": {"id"}, "e": {"f", "y"}}
    ranked = scanned.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("f")))
    assert lineage.sources(ranked)[0]["r"] == {"g", "f"} and lineage.sources(ranked)[1] == {"g", "f"}
    joined = scanned.alias("a").join(scanned.withColumnRenamed("y", "z").alias("b"), F.col("a.id") == F.col("b.id")).select("a.id", "z")
    assert lineage.sources(joined) == ({"id": {"id"}, "z": {"y"}}, {"id"})


def test_leaks_are_refused(spark, scanned):
    assert lineage.check_unread(scanned.select("id", "f"), ["y"]).columns == ["id", "f"]
    scanned.createOrReplaceTempView("scanned_rows")
    for df in (
        scanned.select("id", (F.col("y") * 0).alias("s")),
        scanned.where("y = 1").select("id"),
        scanned.orderBy("y").select("id"),
        scanned.select("id", "y").mapInPandas(lambda b: b, "id long, s int").select("s"),
        spark.sql("SELECT id FROM scanned_rows WHERE f > (SELECT avg(y) FROM scanned_rows)"),
        scanned.join(scanned.groupBy("id").agg(F.max("y").alias("m")), "id").select("id", F.coalesce("m", "f").alias("s")),
    ):
        with pytest.raises(ValueError, match="before the lock"):
            lineage.check_unread(df, ["y"])


def test_few_valued_ranks_equal_sorted_ones(spark, monkeypatch):
    """Several blocks, ties within and across segments, nulls, and a segment that training lacks."""
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 0.0, 1.0, 2.0, 3.0]), rng.random(), rng.randrange(2), rng.randrange(2)) for i in range(900)]
    df = spark.createDataFrame(rows, "source_row_id long, f0 double, f1 double, treatment int, outcome int")
    effects = [("f0", 5, s, e) for s, e in ((0, 0.5), (1, 0.5), (2, -0.1), (4, 0.7))] + [("f1", 2, 0, 0.1), ("f1", 2, 1, 0.2)]
    Row = type("Row", (), {})
    found = []
    for f, b, s, e in effects:
        r = Row()
        r.feature, r.bins, r.segment, r.effect, r.rows = f, b, s, e, 10 + s
        found.append(r)
    edges = {("f0", 5): [0.5, 1.0, 2.0, 3.0], ("f1", 2): [0.4]}
    candidates, sizes = segments._candidate_groups(found, edges)
    assert sizes == {("f0", 5): 4, ("f1", 2): 2}
    monkeypatch.setattr(segments, "BLOCK_ROWS", 100)
    keyed = segments.with_tie_key(df, "source_row_id", 9, "_tie")
    got = sorted(map(tuple, segments.few_valued_cells(keyed, candidates, 20, ["f0", "f1"]).select("model_name", "bucket", "n0", "n1", "y0", "y1").collect()))
    mean = sum(e * (10 + s) for f, _, s, e in effects if f == "f0") / sum(10 + s for f, _, s, _ in effects if f == "f0")
    score = {0: {0: 0.5, 1: 0.5, 2: -0.1, 3: mean, 4: 0.7}, 1: {0: 0.1, 1: 0.2}}
    long = [(c, i, score[c][0 if v is None else sum(e <= v for e in edges[key])], t, y) for c, key, k in ((0, ("f0", 5), 1), (1, ("f1", 2), 2)) for r in rows for i, v, t, y in [(r[0], r[k], r[3], r[4])]]
    ranked = ranking.ranked(spark.createDataFrame(long, "model_name int, source_row_id long, score double, treatment int, outcome int"), seed=9)
    assert got == sorted(map(tuple, curves.cells(ranked, 20).select("model_name", "bucket", "n0", "n1", "y0", "y1").collect()))


def test_hot_values_are_dealt(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).otherwise(F.lit(7)).cast("double").alias("v"))
    key = lambda r: r.id
    plain, dealt = (sorted(ranking.average_ranks(rows, "v", by, least=least).collect(), key=key) for by, least in ((["g"], 10_000), (["g"], 1)))
    assert [tuple(r[c] for c in ("id", "v_rank")) for r in plain] == [tuple(r[c] for c in ("id", "v_rank")) for r in dealt]
    values = rows.toPandas()
    want = values.groupby("g")["v"].rank()
    assert [r.v_rank for r in dealt] == want.tolist()


def test_replay(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(a, b, t, y, rng.randrange(1, 60)) for a in range(20) for b in (a, (a * 7) % 20) for t in (0, 1) for y in (0, 1)], "g_s_learner int, g_response_propensity int, treatment int, outcome int, cell_rows long").dropDuplicates(["g_s_learner", "g_response_propensity", "treatment", "outcome"])
    models = ["s_learner", "response_propensity"]
    values = bootstrap.draw_metrics(bootstrap.paired_draws(cells, models, 30), 20)
    saved = bootstrap.with_stream_keys(cells, models)
    good = bootstrap.replayed(saved, values, models, 30).first()
    assert good.replayed and good.wrong_draws == 0 and good.draws == values.count()
    less = bootstrap.replayed(saved, values.where("replicate < 29"), models, 30).first()
    assert not less.replayed and less.wrong_draws == values.where("replicate = 29").count()
    off = bootstrap.replayed(saved, values.withColumn("value", F.when(F.col("replicate") == 4, F.col("value") + 1e-6).otherwise(F.col("value"))), models, 30).first()
    assert off.wrong_draws == values.where("replicate = 4 and value is not null").count()
    keyed = bootstrap.replayed(saved.withColumn("stream_key", F.when(F.col("cell_rows") == 7, F.lit(1)).otherwise(F.col("stream_key"))), values, models, 30).first()
    assert keyed.wrong_draws == keyed.draws
