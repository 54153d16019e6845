"""Gradient boosted trees as tables, grown from distributed histograms; several fits grow side by side.

Rows lie in blocks of a fit's rows, with their features' bins (see ``bin_edges``) and margins as arrays.  A level of a tree is one aggregation: sums of gradients and Hessians per
fit, node, feature and bin, added up for each task's blocks first.  Only these sums, whose number depends on the parameters and not on the rows, come to the driver, which picks the
splits.  Gradients are fixed-point integers, so sums don't depend on the order of rows, and the same model comes from any number of partitions,
or from another engine.  Rows and features are bagged by hashes of the row's id, the feature and the round.  After each round the loss of
the held-out rows is summed; a fit stops when it hasn't fallen for ``patience`` rounds, and is cut back to its best round.

A model is a table of nodes; ``margin`` compiles it to one column expression, ``margin_sql`` to SQL.

Cases: a null feature counts as smaller than any value, NaN as larger.  A fit without held-out rows grows all rounds.  A fit without training rows, or with
labels of one value only, is a constant.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalar import GOLDEN, MIX_1, MIX_2
from quern.functions.streams import uniform_sql
from quern.operators.segments import quantiles
from quern.sources.files import written

UNIT = 1 << 20
LOSS_UNIT = 1 << 30
CLIP = 1e-9
#: rows of a block
BLOCK_ROWS = 1 << 16
BLOCK = "fit int, held boolean, n long, y_sum long, id binary, y binary, m binary, b binary"
SUMS = "fit int, held boolean, node int, f int, bin int, g long, h long, n long"
NODES = "fit string, round int, node int, feature string, threshold double, value double"


@dataclass(frozen=True)
class Boosting:
    """How to grow: ``l1`` and ``l2`` shrink leaves, ``least_rows`` are a leaf's at least, ``rows`` and ``features`` the bagged shares."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.1
    bins: int = 32
    l1: float = 0.0
    l2: float = 1.0
    least_rows: int = 20
    least_gain: float = 0.0
    rows: float = 0.8
    features: float = 0.8
    patience: int = 5
    seed: int = 7


@dataclass
class Fit:
    """One model to grow: rows where ``where`` holds, features, and a label; ``logistic`` ones are of 0 and 1."""

    name: str
    features: list[str]
    label: Column
    where: Column | None = None
    logistic: bool = True


@dataclass
class Model:
    """Nodes (round, node, feature, threshold, value); a leaf has no feature, and round 0 holds the start."""

    name: str
    logistic: bool
    start: float
    nodes: list[tuple] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    best_round: int = 0

    def trees(self) -> list[dict[int, tuple]]:
        """The trees up to the best round, as {node: (feature, threshold, value)}."""
        out: dict[int, dict] = {}
        for r, node, feature, threshold, value in self.nodes:
            if r <= self.best_round:
                out.setdefault(r, {})[node] = (feature, threshold, value)
        return [out[r] for r in sorted(out)]


def hashed_unit(counter: int, seed: int) -> float:
    """The number that ``with_uniform`` gives a counter, on the driver."""
    wrap = (1 << 64) - 1
    x = (counter + seed + GOLDEN) & wrap
    x = ((x ^ (x >> 30)) * MIX_1) & wrap
    x = ((x ^ (x >> 27)) * MIX_2) & wrap
    return (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53


def bagged_features(features: list[str], round_: int, how: Boosting) -> list[str]:
    """The features of a round's tree: the share with the least hashes, one at least."""
    order = sorted(features, key=lambda f: hashed_unit(round_ * 1_000_003 + features.index(f), how.seed))
    kept = set(order[: max(1, math.ceil(how.features * len(features)))])
    return [f for f in features if f in kept]


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct inner quantiles of every feature, ``bins`` - 1 at most."""
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("v")).select("v.*").where("value is not null and not isnan(value)")
    found = quantiles(values, "feature", "value", [i / bins for i in range(1, bins)])
    out: dict[str, set] = {f: set() for f in features}
    for r in found.collect():
        out[r.feature].add(r.quantile)
    return {f: sorted(x) for f, x in out.items()}


def _start(positives: float, n: float, logistic: bool) -> float:
    if not n:
        return 0.0
    if not logistic:
        return positives / n
    p = min(max(positives / n, CLIP), 1 - CLIP)
    return math.log(p / (1 - p))


def _soft(g: float, l1: float) -> float:
    return math.copysign(max(abs(g) - l1, 0.0), g)


def _score(g: int, h: int, how: Boosting) -> float:
    s = _soft(float(g), how.l1 * UNIT)
    return s * s / (float(h) + how.l2 * UNIT)


def leaf_value(g: int, h: int, how: Boosting) -> float:
    return -how.rate * _soft(float(g), how.l1 * UNIT) / (float(h) + how.l2 * UNIT)


def best_split(histogram: dict[int, list[tuple[int, int, int, int]]], allowed: list[int], total: tuple[int, int, int], how: Boosting) -> tuple | None:
    """(feature, bin, left sums) of greatest gain, ties to the earlier feature and bin; ``histogram`` maps a feature to (bin, g, h, n) in order."""
    best = None
    whole = _score(total[0], total[1], how)
    for f in allowed:
        g = h = n = 0
        for b, bg, bh, bn in histogram.get(f, []):
            g, h, n = g + bg, h + bh, n + bn
            if n < how.least_rows or total[2] - n < how.least_rows:
                continue
            gain = _score(g, h, how) + _score(total[0] - g, total[1] - h, how) - whole
            if gain > how.least_gain * UNIT and (best is None or gain > best[0]):
                best = (gain, f, b, (g, h, n))
    return best[1:] if best else None


def probability(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def _fixed(x: np.ndarray, unit: int = UNIT) -> np.ndarray:
    return np.floor(np.nan_to_num(x * unit, copy=False) + 0.5).astype(np.int64)


def _chance(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-m))


def _gradients(m: np.ndarray, y: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    if not logistic:
        return _fixed(m - y), np.full(len(m), UNIT)
    p = _chance(m)
    return _fixed(p - y), _fixed(p * (1 - p))


def _loss(m: np.ndarray, y: np.ndarray, logistic: bool) -> int:
    p = np.clip(_chance(m), CLIP, 1 - CLIP)
    return int(_fixed(-(y * np.log(p) + (1 - y) * np.log(1 - p)) if logistic else (m - y) * (m - y), LOSS_UNIT).sum())


def _drawn(ids: np.ndarray, round_: int, how: Boosting) -> np.ndarray:
    """The rows that a round's trees see: those whose ``hashed_unit`` is below the share."""
    x = ids.view(np.uint64) * np.uint64(4096) + np.uint64((round_ + how.seed + GOLDEN) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1 & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2 & ((1 << 64) - 1))
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5 < how.rows * 2.0**53


def _ended(bins: np.ndarray, tree: dict[int, tuple], levels: int) -> np.ndarray:
    """The node where each row ends after ``levels`` splits; ``bins`` has a line a feature."""
    feature, cut = np.full(1 << levels, -1), np.zeros(1 << levels, np.int64)
    for n, (f, b, *_) in tree.items():
        if n < 1 << levels:
            feature[n], cut[n] = f, b
    node, row = np.ones(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for level in range(levels):
        # a node of an earlier level is a leaf, which has no split
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + (bins[f, row] > cut[node]))
    return node


def _summed(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of integers by place."""
    if len(values) and int(np.abs(values).max()) * len(values) >= 1 << 53:
        out = np.zeros(size, np.int64)
        np.add.at(out, place, values)
        return out
    return np.bincount(place, values, size).astype(np.int64)


def _packed(rows: DataFrame, features: int, edges: list[list[float]]) -> DataFrame:
    """Blocks of rows of (fit, held, id, y, and the features as doubles)."""
    kind = _bin_kind(edges)

    def block(fit, held, parts):
        ids, y, bins = (np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
        blobs = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (ids, y, np.zeros(len(y)), bins)]
        return pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([held]), pa.array([len(y)], pa.int64()), pa.array([int(_fixed(y.copy()).sum())], pa.int64()), *blobs], names=["fit", "held", "n", "y_sum", "id", "y", "m", "b"])

    def run(batches):
        parts, size = {}, {}
        for batch in batches:
            fits, outs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ids, y = batch.column(2).fill_null(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            bins = np.empty((features, batch.num_rows), kind)
            for f in range(features):
                column = batch.column(4 + f)
                bins[f] = np.searchsorted(edges[f], column.to_numpy(zero_copy_only=False), "right")  # NaN is larger than any edge
                if column.null_count:
                    bins[f][column.is_null().to_numpy(zero_copy_only=False)] = 0
            for key in sorted(set(zip(fits.tolist(), outs.tolist()))):
                own = np.flatnonzero((fits == key[0]) & (outs == key[1]))
                parts.setdefault(key, []).append((ids[own], y[own], bins[:, own]))
                size[key] = size.get(key, 0) + len(own)
                if size[key] >= BLOCK_ROWS:
                    yield block(*key, parts.pop(key))
                    del size[key]
        for key, held in parts.items():
            yield block(*key, held)

    return rows.mapInArrow(run, BLOCK)


def _bin_kind(edges: list[list[float]]):
    return np.uint8 if all(len(e) < 256 for e in edges) else np.uint16


def _read(batches, features: int, kind, logistic: list[bool], starts: list[float] | None, since: list):
    """(fit, held, ids, y, margins after the rounds ``since`` the blocks were written, bins) of each block."""
    for batch in batches:
        fits, outs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, (fit, held) in enumerate(zip(fits, outs)):
            ids, y, m, bins = (np.frombuffer(batch.column(4 + k)[i].as_buffer(), t) for k, t in enumerate((np.int64, np.float64, np.float64, kind)))
            bins = bins.reshape(features, -1)
            m = m + starts[fit] if starts else m
            for trees, leaves, depth in since:
                at = np.zeros(2 << depth)
                at[list(leaves[fit])] = list(leaves[fit].values())
                m = m + at[_ended(bins, trees[fit], depth)]
            yield batch, i, fit, held, ids, y, m, bins


def fit(train: DataFrame, fits: list[Fit], how: Boosting = Boosting(), *, held: DataFrame | None = None, row_id: str = "source_row_id", every: int = 4, edges: dict[str, list[float]] | None = None) -> dict[str, Model]:
    """Models by name.  ``held`` rows decide when a fit stops; the growing margins are written each ``every`` rounds.

    ``edges`` are those of ``bin_edges``, if they are known.
    """
    features = list(dict.fromkeys(f for x in fits for f in x.features))
    place = {f: i for i, f in enumerate(features)}
    edges = edges or bin_edges(train, features, how.bins)
    parts = []
    for rows, out in ((train, False), (held, True)):
        if rows is None:
            continue
        for i, x in enumerate(fits):
            own = rows.where(x.where) if x.where is not None else rows
            parts.append(own.select(F.lit(i).alias("fit"), F.lit(out).alias("held"), F.col(row_id).cast("long").alias("id"), x.label.cast("double").alias("y"), *[F.col(f).cast("double").alias(f"b{k}") for k, f in enumerate(features)]))
    cuts = [edges[f] for f in features]
    blocks = _Blocks(written(_packed(reduce(DataFrame.unionByName, parts).where("y is not null"), len(features), cuts), "boosting"), len(features), _bin_kind(cuts), max(map(len, cuts)) + 1, [x.logistic for x in fits], how)
    sums = {r.fit: r for r in blocks.rows.where("not held").groupBy("fit").agg((F.sum("y_sum") / UNIT).alias("y"), F.sum("n").alias("n")).collect()}
    models = [Model(x.name, x.logistic, _start(*((sums[i].y, sums[i].n) if i in sums else (0.0, 0)), x.logistic)) for i, x in enumerate(fits)]
    growing = sorted(sums)
    blocks.starts = [m.start for m in models]
    best: dict[int, tuple[int, int]] = {}

    def judged(losses: dict[int, tuple[int, int]], r: int) -> None:
        """Losses after ``r`` rounds, of the fits that still grow."""
        for i, (loss, n) in losses.items():
            models[i].losses.append(loss / LOSS_UNIT / n)
            if i not in best or loss < best[i][0]:
                best[i] = (loss, r)

    for r in range(how.rounds):
        allowed = {i: [place[f] for f in bagged_features(fits[i].features, r + 1, how)] for i in growing}
        histograms, losses = blocks.histograms([{}] * len(fits), 0, r + 1, allowed)
        judged(losses, r)
        growing = [i for i in growing if i not in best or r - best[i][1] < how.patience]
        if not growing:
            break
        allowed = {i: allowed[i] for i in growing}
        trees, values = _tree(blocks, histograms, len(fits), r + 1, allowed, how)
        for i in growing:
            models[i].nodes += [(r + 1, n, features[f], edges[features[f]][b], None) for n, (f, b, _) in trees[i].items()] + [(r + 1, n, None, None, v) for n, v in values[i].items()]
            models[i].best_round = r + 1
        blocks.grown(trees, values, growing)
        if (r + 1) % every == 0 and r + 1 < how.rounds:
            blocks.write()
    else:
        if held is not None and growing:
            judged(blocks.histograms([{}] * len(fits), 0, how.rounds + 1, {i: [] for i in growing})[1], how.rounds)
    for i, (_, r) in best.items():
        models[i].best_round = r
    return {m.name: m for m in models}


class _Blocks:
    """The rows of all fits in blocks, written, and the trees grown since."""

    def __init__(self, rows: DataFrame, features: int, kind, bins: int, logistic: list[bool], how: Boosting):
        self.rows, self.features, self.kind, self.bins, self.logistic, self.how = rows, features, kind, bins, logistic, how
        self.starts: list[float] | None = None
        self.since: list = []

    def _reader(self):
        fixed = self.features, self.kind, self.logistic, self.starts, list(self.since)
        return lambda batches: _read(batches, *fixed)

    def grown(self, trees: list[dict], leaves: list[dict], growing: list[int]) -> None:
        self.since.append((trees, leaves, self.how.depth))
        self.rows = self.rows.where(F.col("fit").isin(growing))

    def write(self) -> None:
        """Margins as they are now take the place of the trees."""
        read = self._reader()

        def run(batches):
            for batch, i, _, _, _, _, m, _ in read(batches):
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*own.columns[:6], pa.array([m.tobytes()], pa.binary()), own.column(7)], names=batch.schema.names)

        self.rows, self.starts, self.since = written(self.rows.mapInArrow(run, BLOCK), "boosting"), None, []

    def histograms(self, trees: list[dict], level: int, round_: int, allowed: dict[int, list[int]]) -> tuple[dict, dict]:
        """Of the nodes of a level, {(fit, node): {feature: [(bin, g, h, n)]}}, and at the first level {fit: (loss, rows)} of held-out rows."""
        read, bins_, how, logistic = self._reader(), self.bins, self.how, self.logistic
        first, names = 1 << level, [x.split(" ")[0] for x in SUMS.split(", ")]

        def run(batches):
            held_out: dict[int, list[int]] = {}
            sums: dict[tuple[int, int], list[np.ndarray]] = {}
            for _, _, fit, held, ids, y, m, bins in read(batches):
                if held:
                    own = held_out.setdefault(fit, [0, 0])
                    own[0], own[1] = own[0] + _loss(m, y, logistic[fit]), own[1] + len(y)
                    continue
                if not allowed.get(fit):
                    continue
                if how.rows < 1:
                    own = np.flatnonzero(_drawn(ids, round_, how))
                    m, y, bins = m[own], y[own], bins[:, own]
                node = _ended(bins, trees[fit], level)
                if level:
                    own = np.flatnonzero(node >= first)
                    m, y, bins, node = m[own], y[own], bins[:, own], node[own]
                g, h = _gradients(m, y, logistic[fit])
                base = (node - first) * bins_
                for f in allowed[fit]:
                    at = base + bins[f]
                    parts = _summed(at, g, first * bins_), _summed(at, h, first * bins_), np.bincount(at, minlength=first * bins_)
                    sums[fit, f] = [a + b for a, b in zip(sums[fit, f], parts)] if (fit, f) in sums else list(parts)
            for (fit, f), (g, h, n) in sums.items():
                at = np.flatnonzero(n)
                k = len(at)
                columns = np.full(k, fit), np.zeros(k, bool), at // bins_ + first, np.full(k, f), at % bins_, g[at], h[at], n[at]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), *[pa.int32()] * 3, *[pa.int64()] * 3))], names=names)
            for fit, (loss, n) in held_out.items():
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((fit, True, 0, 0, 0, loss, 0, n), (pa.int32(), pa.bool_(), *[pa.int32()] * 3, *[pa.int64()] * 3))], names=names)

        rows = self.rows if level == 0 else self.rows.where("not held")
        found = rows.mapInArrow(run, SUMS).groupBy("fit", "held", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        histograms: dict[tuple, dict] = {}
        losses: dict[int, tuple[int, int]] = {}
        for x in sorted(found.collect(), key=lambda x: (x.fit, x.node, x.f, x.bin)):
            if x.held:
                losses[x.fit] = x.g, x.n
            else:
                histograms.setdefault((x.fit, x.node), {}).setdefault(x.f, []).append((x.bin, x.g, x.h, x.n))
        return histograms, losses


def _tree(blocks: _Blocks, histograms: dict, fits: int, round_: int, allowed: dict[int, list[int]], how: Boosting) -> tuple[list[dict], list[dict]]:
    """The next tree of every fit that ``allowed`` has features for: its splits {node: (feature, bin, sums)} and the values of its leaves.

    ``histograms`` are those of the roots.
    """
    trees: list[dict] = [{} for _ in range(fits)]
    sums: list[dict] = [{} for _ in range(fits)]
    for level in range(how.depth):
        if level:
            histograms = blocks.histograms(trees, level, round_, allowed)[0]
        for (i, at), histogram in histograms.items():
            first = next(iter(histogram.values()))
            total = tuple(sum(x[k] for x in first) for k in (1, 2, 3))
            sums[i].setdefault(at, total)
            split = best_split(histogram, allowed.get(i, []), total, how)
            if split:
                trees[i][at] = split
                left = split[2]
                sums[i][2 * at], sums[i][2 * at + 1] = left, tuple(a - b for a, b in zip(total, left))
    values = []
    for tree, own in zip(trees, sums):
        reached = [1] if not tree else sorted(c for n in tree for c in (2 * n, 2 * n + 1))
        values.append({n: leaf_value(*own.get(n, (0, 0, 0))[:2], how) for n in reached if n not in tree})
    return trees, values


def margin(model: Model, at: dict[str, Column] | None = None) -> Column:
    """The sum of the trees' values as one expression over the features; ``at`` gives some of them other values."""

    def walk(tree: dict, node: int) -> Column:
        feature, threshold, value = tree[node]
        if feature is None:
            return F.lit(value)
        own = (at or {}).get(feature, F.col(feature)).cast("double")
        return F.when(F.coalesce(own < F.lit(threshold), F.lit(True)), walk(tree, 2 * node)).otherwise(walk(tree, 2 * node + 1))

    return reduce(lambda a, t: a + walk(t, 1), model.trees(), F.lit(model.start))


def margin_sql(model: Model) -> str:
    def walk(tree: dict, node: int) -> str:
        feature, threshold, value = tree[node]
        if feature is None:
            return f"{value!r}::DOUBLE"
        return f"CASE WHEN coalesce({feature} < {threshold!r}::DOUBLE, true) THEN {walk(tree, 2 * node)} ELSE {walk(tree, 2 * node + 1)} END"

    return " + ".join([f"{model.start!r}::DOUBLE", *(walk(t, 1) for t in model.trees())])


def predicted(model: Model, at: dict[str, Column] | None = None) -> Column:
    m = margin(model, at)
    return probability(m) if model.logistic else m


def nodes_table(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """All models' nodes up to their best rounds; the start is round 0, and a logistic model's has the feature ``logit``."""
    rows = []
    for m in models.values():
        rows.append((m.name, 0, 0, "logit" if m.logistic else None, None, m.start))
        rows += [(m.name, r, n, f, t, v) for r, n, f, t, v in m.nodes if r <= m.best_round]
    return spark.createDataFrame(rows, NODES)


def models_of(nodes: DataFrame) -> dict[str, Model]:
    """Models from their saved nodes."""
    out: dict[str, Model] = {}
    for r in sorted(nodes.collect(), key=lambda r: (r.fit, r["round"], r.node)):
        if r["round"] == 0:
            out[r.fit] = Model(r.fit, r.feature == "logit", r.value)
        else:
            out[r.fit].nodes.append((r["round"], r.node, r.feature, r.threshold, r.value))
            out[r.fit].best_round = r["round"]
    return out


def boosting_sql(name: str, source: str, edges: str, features: list[str], fits: dict[str, tuple[list[str], bool]], how: Boosting) -> str:
    """CTEs up to ``name``_best: (fit, id, variant, m), the margins of all rows of ``source`` at each fit's best round.

    ``source`` has fit, id, part (train, held or another), variant, y and the features; ``edges`` has feature and edges.
    """
    n = name
    logistic = "fit IN (" + ", ".join(f"'{x}'" for x, (_, kind) in fits.items() if kind) + ")" if any(k for _, k in fits.values()) else "false"
    bins = ", ".join(f"coalesce(len(list_filter((SELECT edges FROM {edges} WHERE feature = '{f}'), lambda e: e <= {f})), 0)" for f in features)
    p = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-m)))"
    q = f"least(greatest({p}, {CLIP!r}::DOUBLE), {1 - CLIP!r}::DOUBLE)"
    share = f"s.y / s.n"
    clipped = f"least(greatest({share}, {CLIP!r}::DOUBLE), {1 - CLIP!r}::DOUBLE)"
    out = [
        f"{n}_b AS MATERIALIZED (SELECT fit, id, part, variant, y, [{bins}] AS b FROM {source})",
        f"{n}_s AS (SELECT fit, sum(CAST(floor(y * {UNIT} + 0.5) AS BIGINT))::DOUBLE / {UNIT} AS y, count(*) AS n FROM {n}_b WHERE part = 'train' GROUP BY fit)",
        f"{n}_0 AS MATERIALIZED (SELECT fit, id, part, variant, y, b, CASE WHEN {logistic} THEN ln({clipped} / (1 - {clipped})) ELSE {share} END AS m FROM {n}_b b JOIN {n}_s s USING (fit))".replace("SELECT fit, id, part, variant, y, b,", "SELECT fit, id, part, variant, b.y, b.b,"),
    ]
    soft = lambda g: f"(sign({g}::DOUBLE) * greatest(abs({g}::DOUBLE) - {how.l1 * UNIT!r}::DOUBLE, 0))"
    score = lambda g, h: f"({soft(g)} * {soft(g)} / ({h}::DOUBLE + {how.l2 * UNIT!r}::DOUBLE))"
    for r in range(1, how.rounds + 1):
        allowed = " OR ".join(f"fit = '{x}' AND f IN ({', '.join(str(features.index(f)) for f in bagged_features(own, r, how))})" for x, (own, _) in fits.items())
        drawn = f" AND {uniform_sql(f'(id * 4096 + {r})', how.seed)} < {how.rows!r}::DOUBLE" if how.rows < 1 else ""
        gh = f"CAST(floor((CASE WHEN {logistic} THEN {p} - y ELSE m - y END) * {UNIT} + 0.5) AS BIGINT) AS g, CAST(floor((CASE WHEN {logistic} THEN {p} * (1 - {p}) ELSE 1.0::DOUBLE END) * {UNIT} + 0.5) AS BIGINT) AS h"
        out.append(f"{n}_{r}_0 AS MATERIALIZED (SELECT fit, id, variant, part, b, 1 AS node, {gh}, part = 'train'{drawn} AS drawn FROM {n}_{r - 1})")
        for d in range(how.depth):
            t = f"{n}_{r}_{d}"
            out += [
                f"{t}h AS (SELECT fit, node, f, b[f + 1] AS bin, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h, count(*) AS n FROM {t}, range({len(features)}) x(f) WHERE drawn AND node >= {1 << d} GROUP BY ALL)",
                f"{t}c AS (SELECT fit, node, f, bin, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(n) OVER w AS n, sum(g) OVER v AS tg, sum(h) OVER v AS th, sum(n) OVER v AS tn FROM {t}h WINDOW w AS (PARTITION BY fit, node, f ORDER BY bin), v AS (PARTITION BY fit, node, f))",
                f"{t}s AS MATERIALIZED (SELECT fit, node, f, bin FROM (SELECT fit, node, f, bin, {score('g', 'h')} + {score('(tg - g)', '(th - h)')} - {score('tg', 'th')} AS gain FROM {t}c WHERE n >= {how.least_rows} AND tn - n >= {how.least_rows} AND ({allowed})) WHERE gain > {how.least_gain * UNIT!r} QUALIFY row_number() OVER (PARTITION BY fit, node ORDER BY gain DESC, f, bin) = 1)",
                f"{n}_{r}_{d + 1} AS MATERIALIZED (SELECT t.fit, id, variant, part, b, CASE WHEN s.f IS NULL THEN t.node WHEN b[s.f + 1] <= s.bin THEN 2 * t.node ELSE 2 * t.node + 1 END AS node, g, h, drawn FROM {t} t LEFT JOIN {t}s s ON s.fit = t.fit AND s.node = t.node)",
            ]
        last = f"{n}_{r}_{how.depth}"
        out += [
            f"{n}_{r}v AS (SELECT fit, node, -{how.rate!r}::DOUBLE * {soft('sum(g)')} / (sum(h)::DOUBLE + {how.l2 * UNIT!r}::DOUBLE) AS v FROM {last} WHERE drawn GROUP BY fit, node)",
            f"{n}_{r} AS MATERIALIZED (SELECT p.fit, p.id, p.part, p.variant, p.y, p.b, p.m + coalesce(v.v, 0.0) AS m FROM {n}_{r - 1} p JOIN {last} t ON t.fit = p.fit AND t.id = p.id AND t.part = p.part AND t.variant = p.variant LEFT JOIN {n}_{r}v v ON v.fit = t.fit AND v.node = t.node)",
        ]
    loss = f"CAST(floor((CASE WHEN {logistic} THEN -(y * ln({q}) + (1 - y) * ln(1 - {q})) ELSE (m - y) * (m - y) END) * {LOSS_UNIT} + 0.5) AS BIGINT)"
    losses = " UNION ALL ".join(f"SELECT fit, {r} AS r, sum({loss}) AS loss FROM {n}_{r} WHERE part = 'held' GROUP BY fit" for r in range(how.rounds + 1))
    out += [
        f"{n}_l AS MATERIALIZED ({losses})",
        # the first record that no later round within the patience beats
        f"{n}_r AS (SELECT fit, min(r) AS r FROM (SELECT fit, r, loss, min(loss) OVER (PARTITION BY fit ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(loss) OVER (PARTITION BY fit ORDER BY r ROWS BETWEEN 1 FOLLOWING AND {how.patience} FOLLOWING) AS after FROM {n}_l) WHERE loss < coalesce(before, loss + 1) AND loss <= coalesce(after, loss) GROUP BY fit)",
        f"{n}_best AS (" + " UNION ALL ".join(f"SELECT m.fit, id, part, variant, y, m FROM {n}_{r} m JOIN {n}_r b ON b.fit = m.fit AND b.r = {r}" for r in range(how.rounds + 1)) + ")",
    ]
    return ",\n".join(out)
