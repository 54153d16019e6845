"""Boosting against a plain implementation over rows, its independence of partitions, and models as tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import boosting
from quern.operators.boosting import UNIT, Boosting, Fit

COLUMNS = ["a", "b", "c"]


def table(spark, n=700, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.choice([None, 1.0, 2.0, 3.0, float("nan")]), rng.randrange(50) / 7
        rows.append((i, a, b, rng.random(), int(rng.random() < (0.8 if b > 4 and a != 2.0 else 0.2)), rng.random() < 0.3))
    return spark.createDataFrame(rows, "source_row_id long, a double, b double, c double, y int, out boolean")


def by_hand(rows, edges, how, logistic=True):
    """(trees, losses): the same rule, row by row."""
    bins = lambda r: [0 if r[f] is None else len(edges[f]) if math.isnan(r[f]) else sum(e <= r[f] for e in edges[f]) for f in COLUMNS]
    train, held = [r for r in rows if not r["out"]], [r for r in rows if r["out"]]
    share = sum(r["y"] for r in train) / len(train)
    start = math.log(share / (1 - share)) if logistic else share
    m = {r["source_row_id"]: start for r in rows}
    sig = lambda x: 1 / (1 + math.exp(-x))
    losses, trees = [], []
    for r_ in range(how.rounds + 1):
        losses.append(sum(math.floor((-(math.log(sig(m[r["source_row_id"]])) if r["y"] else math.log(1 - sig(m[r["source_row_id"]]))) if logistic else (m[r["source_row_id"]] - r["y"]) ** 2) * (1 << 30) + 0.5) for r in held) / (1 << 30) / len(held))
        if r_ == how.rounds or r_ - losses.index(min(losses)) >= how.patience:
            break
        drawn = [r for r in train if boosting.hashed_unit(r["source_row_id"] * 4096 + r_ + 1, how.seed) < how.rows]
        allowed = [COLUMNS.index(f) for f in boosting.bagged_features(COLUMNS, r_ + 1, how)]
        g = {r["source_row_id"]: math.floor(((sig(m[r["source_row_id"]]) if logistic else m[r["source_row_id"]]) - r["y"]) * UNIT + 0.5) for r in drawn}
        h = {i: math.floor((sig(m[i]) * (1 - sig(m[i])) if logistic else 1.0) * UNIT + 0.5) for i in g}

        def grow(own, node, depth):
            total = (sum(g[r["source_row_id"]] for r in own), sum(h[r["source_row_id"]] for r in own), len(own))
            best = None
            if depth < how.depth:
                for f in allowed:
                    for cut in sorted({bins(r)[f] for r in own}):
                        left = [r for r in own if bins(r)[f] <= cut]
                        if min(len(left), len(own) - len(left)) < how.least_rows:
                            continue
                        lg, lh = sum(g[r["source_row_id"]] for r in left), sum(h[r["source_row_id"]] for r in left)
                        gain = boosting._score(lg, lh, how) + boosting._score(total[0] - lg, total[1] - lh, how) - boosting._score(total[0], total[1], how)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, cut)
            if best is None:
                return {node: boosting.leaf_value(total[0], total[1], how)}
            _, f, cut = best
            out = {("split", node): (f, cut)}
            out |= grow([r for r in own if bins(r)[f] <= cut], 2 * node, depth + 1)
            return out | grow([r for r in own if bins(r)[f] > cut], 2 * node + 1, depth + 1)

        tree = grow(drawn, 1, 0)
        trees.append(tree)
        for r in rows:
            node = 1
            while ("split", node) in tree:
                f, cut = tree["split", node]
                node = 2 * node + (bins(r)[f] > cut)
            m[r["source_row_id"]] += tree[node]
    return trees, losses


@pytest.mark.parametrize("logistic,how", [(True, Boosting(rounds=5, depth=3, rate=0.3, bins=8, patience=9)), (True, Boosting(rounds=12, depth=2, rate=0.9, bins=6, l1=2.0, l2=0.5, patience=2, rows=0.6, features=0.5, least_rows=40)), (False, Boosting(rounds=4, depth=2, rows=1.0, patience=9))])
def test_equals_a_plain_implementation(spark, logistic, how):
    df = table(spark)
    train, held = df.where("not out"), df.where("out")
    edges = boosting.bin_edges(train, COLUMNS, how.bins)
    model = boosting.fit(train, [Fit("m", COLUMNS, F.col("y"), logistic=logistic)], how, held=held, every=2)["m"]
    trees, losses = by_hand([r.asDict() for r in df.collect()], edges, how, logistic)
    assert model.losses == pytest.approx(losses, abs=1e-8)
    assert model.best_round == losses.index(min(losses))
    for r, tree in enumerate(trees, 1):
        own = {(n, f, t, v) for k, n, f, t, v in model.nodes if k == r}
        want = {(n[1], COLUMNS[x[0]], edges[COLUMNS[x[0]]][x[1]], None) if isinstance(n, tuple) else (n, None, None, x) for n, x in tree.items()}
        assert {x[:3] for x in own} == {x[:3] for x in want}
        values = {x[0]: x[3] for x in want if x[3] is not None}
        assert all(v == pytest.approx(values[n], abs=1e-12) for n, _, _, v in own if v is not None)


def test_any_number_of_partitions_grows_the_same_trees(spark):
    df = table(spark, 500)
    how = Boosting(rounds=4, depth=3, bins=8)
    grown = [boosting.fit(df.where("not out").repartition(k), [Fit("m", COLUMNS, F.col("y")), Fit("n", ["a"], F.col("b"), F.col("a") > 1, False)], how, held=df.where("out").repartition(k)) for k in (1, 37)]
    assert grown[0]["m"] == grown[1]["m"] and grown[0]["n"] == grown[1]["n"] and grown[0]["m"].nodes


def test_models_as_tables_columns_and_sql(spark):
    import duckdb

    df = table(spark, 400)
    how = Boosting(rounds=5, depth=3, bins=8, rate=0.5)
    models = boosting.fit(df.where("not out"), [Fit("m", COLUMNS, F.col("y")), Fit("n", ["b"], F.col("c"), logistic=False)], how, held=df.where("out"))
    again = boosting.models_of(boosting.nodes_table(spark, models))
    assert {k: (m.start, m.logistic, m.best_round, m.trees()) for k, m in again.items()} == {k: (m.start, m.logistic, m.best_round, m.trees()) for k, m in models.items()}
    rows = df.select("source_row_id", *COLUMNS, boosting.margin(again["m"]).alias("m"), boosting.predicted(again["n"]).alias("n"), boosting.predicted(again["m"], {"a": F.lit(3.0)}).alias("at")).toPandas()
    assert not any(math.isnan(x) for x in rows["m"])
    sql = duckdb.sql(f"SELECT source_row_id, {boosting.margin_sql(again['m'])} AS m, {boosting.margin_sql(again['n'])} AS n FROM (SELECT * REPLACE (CASE WHEN source_row_id IN (SELECT i FROM nan_rows) THEN 'nan'::DOUBLE ELSE a END AS a) FROM rows)".replace("nan_rows", "(SELECT unnest([" + ", ".join(str(r.source_row_id) for r in df.where("isnan(a)").collect()) + "]) AS i)")).df()
    both = rows.merge(sql, on="source_row_id", suffixes=("", "_sql"))
    assert len(both) == 400 and (abs(both["m"] - both["m_sql"]) < 1e-12).all() and (abs(both["n"] - both["n_sql"]) < 1e-12).all()


def test_few_rows_and_one_label(spark):
    df = table(spark, 60)
    how = Boosting(rounds=3, depth=2, least_rows=1)
    models = boosting.fit(df, [Fit("none", COLUMNS, F.col("y"), F.lit(False)), Fit("ones", COLUMNS, F.lit(1)), Fit("nulls", COLUMNS, F.when(F.col("source_row_id") % 2 == 0, F.col("y")))], how)
    assert models["none"].start == 0.0 and not models["none"].trees()
    p = df.select(boosting.predicted(models["ones"]).alias("p"), boosting.predicted(models["nulls"]).alias("q")).collect()
    assert all(r.p > 0.99 and 0 < r.q < 1 for r in p)


def test_levels_add_up_in_tasks(spark, monkeypatch):
    """No level makes a row of each row and feature: tasks hand on sums only."""

    def refuse(*_):
        raise AssertionError("rows are exploded by feature")

    df = table(spark, 300)
    edges = boosting.bin_edges(df, COLUMNS, 6)
    monkeypatch.setattr(boosting.F, "posexplode", refuse)
    how = Boosting(rounds=2, depth=2, bins=6)
    assert boosting.fit(df, [Fit("m", COLUMNS, F.col("y"))], how, edges=edges)["m"].nodes


def test_sums_are_exact_and_rows_drawn_as_hashed():
    import numpy as np

    values = np.array([(1 << 58) + 1, 3, -(1 << 57) - 5, 7])
    assert boosting._summed(np.array([0, 1, 0, 1]), values, 3).tolist() == [(1 << 57) - 4, 10, 0]
    how = Boosting(rows=0.6, seed=11)
    ids = np.arange(-50, 200)
    assert boosting._drawn(ids, 5, how).tolist() == [boosting.hashed_unit(int(i) * 4096 + 5, 11) < 0.6 for i in ids]
