"""Segments: quantile edges, effects per segment, and the search for the best segment ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import safe_ratio, with_tie_key
from quern.operators.curves import curve_from_cells, curve_metrics
from quern.operators.ranking import running_counts
from quern.plans.experiment import FEATURES
from quern.sources.files import written

BINS = (2, 3, 5, 8)


def quantile_edges(train: DataFrame, features: list[str] = FEATURES, bins: tuple[int, ...] = BINS) -> DataFrame:
    """(feature, bins, edges): inner quantiles, interpolated, made distinct as doubles, then floats.

    All features are sorted in one range shuffle of their distinct values (see ``quantiles``).
    """
    values = train.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("v")).select("v.*")
    shares = sorted({i / b for b in bins for i in range(1, b)})
    found = quantiles(values, "feature", "value", shares).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("share", "quantile"))).alias("q"))
    wanted = F.explode(F.array(*[F.struct(F.lit(b).alias("bins"), F.array(*[F.lit(i / b) for i in range(1, b)]).alias("shares")) for b in bins])).alias("w")
    edges = F.array_sort(F.array_distinct(F.transform("w.shares", lambda x: F.element_at("q", x)))).cast("array<float>")
    return found.select("feature", "q", wanted).select("feature", F.col("w.bins").alias("bins"), edges.alias("edges"))


def quantiles(rows: DataFrame, by: str, column: str, shares: list[float]) -> DataFrame:
    """(by, share, quantile): exact, interpolated quantiles of each group.

    Distinct values are counted and sorted over all tasks; a value's places follow from its partition's running count and
    the counts of the partitions before, so no task sees a whole group.
    """
    places = running_counts(rows.where(F.col(column).isNotNull()), column, [by])
    sizes = places.groupBy(by).agg(F.max(F.col("_before") + F.col("_c")).alias("_n"))
    at = lambda s: (F.col("_n") - 1) * F.lit(s)
    points = F.array(*[F.struct(F.lit(s).alias("share"), F.floor(at(s)).alias("lo"), F.ceil(at(s)).alias("hi"), (at(s) - F.floor(at(s))).alias("part")) for s in shares])
    named = places.join(F.broadcast(sizes), by)  # a row per group
    held = lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_c"))
    hits = named.select(by, column, F.explode(F.filter(points, lambda p: held(p["lo"]) | held(p["hi"]))).alias("p"), "_before", "_c")
    lo, hi = (F.max(F.when(held(F.col(f"p.{x}")), F.col(column))) for x in ("lo", "hi"))
    return hits.groupBy(by, F.col("p.share").alias("share")).agg((lo + (hi - lo) * F.max("p.part")).alias("quantile"))


def segment_of(value: Column, edges: Column) -> Column:
    """How many edges are at or below the value: a value equal to an edge belongs above it."""
    return F.size(F.filter(edges, lambda e: e <= value.cast("float")))


def long_segments(view: DataFrame, edges: DataFrame, outcome: str) -> DataFrame:
    """Rows of (feature, bins, segment, treatment, outcome, source_row_id) for every candidate; edges are a few rows."""
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES if f in view.columns]))
    more = [c for c in view.columns if c == "_tie"]
    long = view.select("source_row_id", "treatment", F.col(outcome).alias("outcome"), *more, values.alias("v")).select("*", "v.*").drop("v")
    return long.join(F.broadcast(edges), "feature").select("feature", "bins", segment_of(F.col("value"), F.col("edges")).alias("segment"), "treatment", "outcome", "source_row_id", *more)  # a row per candidate


def segment_effects(segments: DataFrame) -> DataFrame:
    """(feature, bins, segment, rows, effect): the difference of rates, or the overall one where an arm is empty."""
    some = lambda t, y=False: F.count_if((F.col("treatment") == t) & ((F.col("outcome") == 1) if y else F.lit(True)))
    own = segments.groupBy("feature", "bins", "segment").agg(some(0).alias("n0"), some(1).alias("n1"), some(0, True).alias("y0"), some(1, True).alias("y1"))
    effect = lambda c: safe_ratio(c("y1"), c("n1")) - safe_ratio(c("y0"), c("n0"))
    whole = Window.partitionBy("feature", "bins")
    overall = effect(lambda c: F.sum(c).over(whole))
    return own.withColumn("overall", overall).select("feature", "bins", "segment", (F.col("n0") + F.col("n1")).alias("rows"), F.coalesce(effect(F.col), "overall").alias("effect"))


#: rows of a block of hashed ids, about
BLOCK_ROWS = 1 << 18


def _candidate_groups(effects: list, edges: dict) -> tuple[list, dict]:
    """[(feature, bins, edges, the score group of each segment)] and each candidate's number of groups; a group is a distinct score, the highest first.

    A segment that the training rows lack gets the mean effect of the others.
    """
    own: dict[tuple, dict] = {}
    for r in effects:
        own.setdefault((r.feature, r.bins), {})[r.segment] = (r.effect, r.rows)
    out, sizes = [], {}
    for key in sorted(own):
        found = own[key]
        total = sum(n for _, n in found.values())
        mean = sum(e * n for e, n in found.values()) / total if total else 0.0
        scores = [found.get(i, (mean, 0))[0] for i in range(len(edges[key]) + 1)]
        order = sorted(set(scores), reverse=True)
        out.append((*key, np.array(edges[key], np.float32), np.array([order.index(x) for x in scores])))
        sizes[key] = len(found)
    return out, sizes


def few_valued_cells(rows: DataFrame, candidates: list, groups: int, features: list[str]) -> DataFrame:
    """(model_name, bucket, n0, n1, y0, y1) of rankings with few distinct scores, of all ``candidates`` at once.

    Equal scores are ordered by the hashed id ``_tie``.  Its leading bits deal the rows to blocks, so blocks follow one another in
    that order, for each score group of each candidate alike: rows before a row are those of better groups, those of its group in earlier
    blocks, and those before it in its block.  Rows are sorted once, within blocks.
    """
    n = rows.count()
    bits = max(0, (n // BLOCK_ROWS).bit_length())
    block = F.shiftrightunsigned(F.col("_tie").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")
    named = written(rows.select(block.alias("block"), "_tie", "source_row_id", F.array(*[F.coalesce(F.col(f).cast("float"), F.lit(float("-inf")).cast("float")) for f in features]).alias("x"), (F.col("treatment") * 2 + F.col("outcome")).cast("int").alias("kind")), "blocks")
    place = {f: i for i, f in enumerate(features)}

    def groups_of(frame: pd.DataFrame):
        x = np.stack(frame["x"].to_numpy()) if len(frame) else np.empty((0, len(features)), np.float32)
        for i, (feature, _, edges, group) in enumerate(candidates):
            yield i, group[np.searchsorted(edges, x[:, place[feature]], side="right")]

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for i, g in groups_of(frame):
            sizes = np.bincount(g)
            parts.append(pd.DataFrame({"block": frame["block"].iloc[0], "candidate": i, "score_group": np.arange(len(sizes)), "n": sizes}))
        return pd.concat(parts)

    counts = named.groupBy("block").applyInPandas(counted, "block long, candidate int, score_group int, n long")
    order = Window.partitionBy("candidate").orderBy("score_group", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = written(counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n"), "block-counts")

    def placed(frame: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_tie", "source_row_id"], kind="stable")
        kind, start = frame["kind"].to_numpy(), {k: v for k, v in offsets.groupby("candidate")}
        parts = []
        for i, g in groups_of(frame):
            own = start[i].sort_values("score_group")["before"].to_numpy()
            by_group = np.argsort(g, kind="stable")
            sizes = np.bincount(g, minlength=len(own))
            rank = np.arange(len(g)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(own, sizes)
            bucket = np.minimum(rank * groups // n, groups - 1)
            cells = np.bincount(bucket * 4 + kind[by_group], minlength=groups * 4).reshape(groups, 4)
            parts.append(pd.DataFrame({"candidate": i, "bucket": np.arange(groups), "n0": cells[:, 0] + cells[:, 1], "n1": cells[:, 2] + cells[:, 3], "y0": cells[:, 1], "y1": cells[:, 3]}))
        return pd.concat(parts)

    found = named.groupBy("block").cogroup(before.groupBy("block")).applyInPandas(placed, "candidate int, bucket int, n0 long, n1 long, y0 long, y1 long")
    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "y0", "y1")]
    return found.groupBy(F.col("candidate").alias("model_name"), "bucket").agg(*sums).where("n0 + n1 > 0")


def segment_selection(train: DataFrame, validation: DataFrame, outcome: str = "visit", *, groups: int = 20, seed: int = 0) -> DataFrame:
    """Every candidate's AUUC and Qini on the validation rows, best first (ties: fewer bins, then feature by name).

    Edges and effects are a few rows a candidate; the rows are sorted once for all candidates (see ``few_valued_cells``).
    """
    edges = written(quantile_edges(train), "edges")
    effects = segment_effects(long_segments(train, edges, outcome)).collect()  # at most 8 rows a candidate
    candidates, sizes = _candidate_groups(effects, {(r.feature, r.bins): r.edges for r in edges.collect()})
    features = [f for f in FEATURES if f in validation.columns]
    keyed = with_tie_key(validation.select("source_row_id", *features, "treatment", F.col(outcome).alias("outcome")), "source_row_id", seed, "_tie")
    found = curve_metrics(curve_from_cells(few_valued_cells(keyed, candidates, groups, features), groups))
    names = validation.sparkSession.createDataFrame([(i, f, b, sizes[f, b]) for i, (f, b, _, _) in enumerate(candidates)], "model_name int, feature string, bins int, actual_bins long")
    named = found.join(F.broadcast(names), "model_name")  # a row a candidate
    return named.select("feature", "bins", F.col("auuc").alias("validation_auuc"), F.col("qini").alias("validation_qini"), "actual_bins").orderBy(F.desc("validation_qini"), "bins", "feature")


def constant_effect(view: DataFrame, outcome: str = "visit") -> DataFrame:
    """The overall effect, the score that a constant ranking gives every row."""
    some = lambda t, y=False: F.count_if((F.col("treatment") == t) & ((F.col(outcome) == 1) if y else F.lit(True)))
    c = view.agg(some(0).alias("n0"), some(1).alias("n1"), some(0, True).alias("y0"), some(1, True).alias("y1"))
    return c.select((safe_ratio(F.col("y1"), F.col("n1")) - safe_ratio(F.col("y0"), F.col("n0"))).alias("effect"))


def segment_baseline(train: DataFrame, validation: DataFrame, test: DataFrame, selection: DataFrame, outcome: str = "visit") -> DataFrame:
    """(source_row_id, feature, bins, segment, score): test rows scored by the best candidate of ``selection``.

    Its edges are those of the training rows; its effects are fitted anew on training and validation rows, and
    a segment without either arm gets the effect of all.
    """
    best = selection.orderBy(F.desc("validation_qini"), "actual_bins", "feature").limit(1).select("feature", "bins")
    edges = quantile_edges(train).join(F.broadcast(best), ["feature", "bins"])  # one row
    both = long_segments(train.unionByName(validation), edges, outcome)
    effects = segment_effects(both).select("segment", "effect")
    overall = constant_effect(train.unionByName(validation), outcome).select(F.col("effect").alias("overall"))
    rows = long_segments(test.withColumn(outcome, F.lit(0)), edges, outcome).join(F.broadcast(effects), "segment", "left")  # a row per segment
    # one row, named by a constant key
    rows = rows.withColumn("k", F.lit(1)).join(F.broadcast(overall.withColumn("k", F.lit(1))), "k")
    return rows.select("source_row_id", "feature", "bins", "segment", F.coalesce("effect", "overall").cast("float").alias("score"))
