"""Quality by a sparse rule ensemble.

Statistics of each whole text feed small boosted trees; every path of a tree from its root to a node
is a conjunctive rule.  A lasso logistic regression over the rules keeps few of them, and the
result is compiled into one Spark column expression.

Fitting sees a sample of at most ``MAX_FIT_ROWS`` labelled rows (about; chosen by a hash of the id),
its statistics only, on the driver.  Everything else covers all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import table, with_text

MAX_FIT_ROWS = 10_000
THRESHOLD = 0.3

STATISTICS = (
    "chars", "words", "word_length", "word_length_deviation", "short_words", "long_words", "distinct_words",
    "repeated_neighbours", "top_byte", "lines", "line_words", "distinct_lines", "upper", "lower", "digits",
    "blanks", "stops", "commas", "shouts", "bars", "symbols", "other_bytes", "capitalised", "closing_punctuation",
)

_CLASSES = np.zeros((256, 10), np.int64)
for _i, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".", b",;:", b"!?", b"|", b"#$%&*+<=>@\\^_`~{}[]/")
):
    _CLASSES[list(_chars), _i] = 1
_CLASSES[128:, 9] = 1


def statistics(text: str | None) -> tuple[float, ...]:
    """The ``STATISTICS`` of a whole text; all 0 for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return (0.0,) * len(STATISTICS)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    share = (histogram @ _CLASSES) / size
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x]
    firsts = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    lasts = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    return (
        math.log1p(len(text)),
        math.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        len(set(words)) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        float(np.delete(histogram, 32).max()) / size,
        math.log1p(len(lines)),
        n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        *map(float, share),
        float(_CLASSES[firsts, 0].mean()) if len(firsts) else 0.0,
        float(_CLASSES[lasts, 4:8].sum() / len(lasts)) if len(lasts) else 0.0,
    )


def with_statistics(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row and its statistics as ``s_...`` columns."""
    names = [f"s_{n}" for n in STATISTICS]
    chosen, kept, texts = with_text(docs, keep, text_col)
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        for b in batches:
            found = np.array([statistics(t.as_py()) for t in texts(b)], np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(keep))] + [pa.array(found[:, i]) for i in range(len(names))], names=[*keep, *names]
            )

    return chosen.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold); ``above`` means ``>``, else ``<=``."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[n] > t if above else x[n] <= t for n, above, t in self.terms])

    def column(self) -> Column:
        parts = [F.col(f"s_{n}") > t if above else F.col(f"s_{n}") <= t for n, above, t in self.terms]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The score, from 0 to 1, over ``s_...`` columns."""
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            margin = margin + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _simplified(terms: list[tuple[str, bool, float]]) -> Rule:
    tight: dict[tuple[str, bool], float] = {}
    for name, above, t in terms:
        old = tight.get((name, above))
        tight[name, above] = t if old is None else (max if above else min)(old, t)
    return Rule(tuple(sorted((n, a, t) for (n, a), t in tight.items())))


def tree_rules(x: np.ndarray, y: np.ndarray, *, trees: int, depth: int, least: int, seed: int) -> list[Rule]:
    """The paths of boosted regression trees on logistic gradients, each grown on half the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 34)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    flat = binned + np.arange(x.shape[1]) * width
    margin = np.full(len(y), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    rules: dict[Rule, None] = {}

    def grow(rows, gradient, hessian, terms, level, update):
        if terms:
            rules.setdefault(_simplified(terms))
        g, h = gradient[rows], hessian[rows]
        value = g.sum() / (h.sum() + 1.0)
        if level == depth or len(rows) < 2 * least:
            update.append((terms, value))
            return
        own = flat[rows].ravel()
        cells = x.shape[1] * width
        gs, hs, ns = (
            np.bincount(own, weights=w, minlength=cells).reshape(-1, width).cumsum(axis=1)
            for w in (np.repeat(g, x.shape[1]), np.repeat(h, x.shape[1]), np.ones(len(own)))
        )
        total_g, total_h = g.sum(), h.sum()
        gain = gs**2 / (hs + 1.0) + (total_g - gs) ** 2 / (total_h - hs + 1.0) - total_g**2 / (total_h + 1.0)
        gain[(ns < least) | (len(rows) - ns < least)] = -1
        j, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, b] <= 1e-9:
            update.append((terms, value))
            return
        left = binned[rows, j] <= b
        name, t = STATISTICS[j], float(cuts[j][b])
        grow(rows[left], gradient, hessian, [*terms, (name, False, t)], level + 1, update)
        grow(rows[~left], gradient, hessian, [*terms, (name, True, t)], level + 1, update)

    columns = {n: x[:, j] for j, n in enumerate(STATISTICS)}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(2 * least, len(y) // 2)])
        leaves: list = []
        grow(rows, y - p, p * (1 - p) + 1e-6, [], 0, leaves)
        for terms, value in leaves:
            inside = Rule(tuple(terms)).holds(columns) if terms else np.ones(len(y), bool)
            margin[inside] += 0.2 * value
    return list(rules)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 2000, tolerance: float = 1e-5) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + penalty * sum |w|.

    Accelerated proximal steps, begun anew when they turn back, until none changes by more than ``tolerance``.
    """
    n, k = x.shape
    w, b = np.zeros(k), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    v = np.random.default_rng(0).standard_normal(k + 1)
    for _ in range(20):  # the largest eigenvalue of the curvature's bound
        z = x @ v[:k] + v[k]
        v = np.append(x.T @ z, z.sum())
        norm = np.linalg.norm(v)
        v /= norm
    rate = 4 * n / norm
    yw, yb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(x @ yw + yb))) - y
        new = yw - rate * (x.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = yb - rate * r.mean()
        if (yw - new) @ (new - w) + (yb - new_b) * (new_b - b) > 0:
            t = 1.0
        done = max(np.abs(new - yw).max(initial=0), abs(new_b - yb)) <= tolerance
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        yw, yb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
        if done:
            break
    return float(b), w


def fit_rules(
    x: np.ndarray, y: np.ndarray, *, trees: int = 24, depth: int = 3, penalty: float = 1e-3, seed: int = 8
) -> RuleEnsemble:
    """The ensemble for statistics ``x`` and labels ``y``; with fewer than 2 labels of either class, their share alone."""
    y = y.astype(np.float64)
    if min(y.sum(), len(y) - y.sum()) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(math.log(share / (1 - share)))
    least = max(2, min(20, len(y) // 50))
    rules = tree_rules(x, y, trees=trees, depth=depth, least=least, seed=seed)
    if not rules:
        return RuleEnsemble(math.log(y.mean() / (1 - y.mean())))
    columns = {n: x[:, j] for j, n in enumerate(STATISTICS)}
    held = np.stack([r.holds(columns) for r in rules], axis=1).astype(np.float64)
    intercept, weights = lasso_logistic(held, y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble(intercept, [rules[i] for i in kept], [float(weights[i]) for i in kept])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "quality",
    usable: Column | None = None,
    max_rows: int = MAX_FIT_ROWS,
) -> RuleEnsemble:
    """Fits on about ``max_rows`` labelled rows at most; ``usable`` restricts them by doc_id."""
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))  # of contradicting labels the lower one
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by max_rows
    columns = [f"s_{n}" for n in STATISTICS]
    # one row per labelled id, however often a table repeats it, so that the bound holds
    one = with_statistics(rows, "text", ["doc_id", "label"]).groupBy("doc_id").agg(F.min(F.struct("label", *columns)).alias("r"))
    data = one.select("doc_id", "r.*").toPandas()
    x = data[columns].to_numpy(np.float64)
    order = np.lexsort((*x.T, data["label"], data["doc_id"]))
    return fit_rules(x[order], (data["label"].to_numpy() > 0)[order])


def score_quality(docs: DataFrame, model: RuleEnsemble, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row and its ``score``.

    Cases: null and empty texts have statistics of 0 and a score like any other; repeated rows get
    equal scores; texts of any length count whole; an empty input gives no rows; columns of any name can be kept.
    """
    if not any(c.strip("`").startswith("s_") for c in keep):
        return with_statistics(docs, text_col, keep).select(*keep, model.column().alias("score"))
    inside = text_col.split(".")[0] in keep
    kept = F.struct(*keep).alias("kept")
    whole = docs.select(kept) if inside else docs.select(kept, F.col(text_col).alias("text"))
    return with_statistics(whole, f"kept.{text_col}" if inside else "text", ["kept"]).select("kept.*", model.column().alias("score"))


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), usable=fold(5) != 0)
    return score_quality(docs, model, ["doc_id"]).select(
        "doc_id",
        (fold(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
