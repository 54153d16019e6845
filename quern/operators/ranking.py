"""Global ranks without a global window, score groups and top fractions.

All rankings are kept in long form (model_name, source_row_id, score, ...).  One range shuffle sorts all
of them; a row's rank is its place in its partition, plus the rows of the partitions before, less the
first place of its model.  Only counts per partition and model are gathered, so neither one model nor
one score needs a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import with_tie_key
from quern.sources.files import written

_IN_PARTITION = (1 << 33) - 1


def ranked(scores: DataFrame, *, seed: int = 0, keep: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """Adds ``rank`` (0 for the highest score; ties by hashed id) and ``n`` (rows of the model).

    ``tie`` names a column with the hashed id where rows already have it (see ``with_tie_key``).  Rows whose score is
    null or NaN come last.  The sorted rows are written once, since a partition's content, which gives
    the places, must not change if a task runs again.
    """
    columns = keep or [c for c in scores.columns if c not in ("model_name", "source_row_id", "score", tie)]
    plain = scores.select("model_name", "source_row_id", "score", *columns, *([F.col(tie).alias("_tie")] if tie else []))
    keyed = plain if tie else with_tie_key(plain, "source_row_id", seed, "_tie")
    order = ["model_name", F.nanvl(F.col("score").cast("double"), F.lit(None)).desc_nulls_last(), "_tie", "source_row_id"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    fixed = written(placed.drop("_tie"), "ranked")
    part = F.shiftright("_at", 33)
    counts = fixed.groupBy(part.alias("_part"), "model_name").agg(F.count(F.lit(1)).alias("_n"))
    # a partition holds neighbouring models in order: rows of the same model in partitions before this one
    before = Window.partitionBy("model_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("model_name").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(
        "_part",
        "model_name",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("model_name")).alias("n"),
    )
    # a row per partition and model: partitions hold neighbouring models, so there are at most as many as partitions and models together
    rows = fixed.withColumn("_part", part).join(F.broadcast(places), ["_part", "model_name"])
    return rows.withColumn("rank", F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)) + F.col("_shift")).drop("_part", "_at", "_shift")


def bucket(groups: int, rank: str = "rank", n: str = "n") -> Column:
    """The zero-based group of equal population that holds a rank."""
    return F.least(F.floor(F.expr(f"{rank} * {groups} div {n}")), F.lit(groups - 1)).cast("int")


def top_size(n: Column, fraction: float) -> Column:
    """Rows in a top fraction: rounded, halves to even, and one at least."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(fraction), 0).cast("long"))


def in_top(fraction: float) -> Column:
    return F.col("rank") < top_size(F.col("n"), fraction)


def running_counts(df: DataFrame, column: str, by: list[str], more: list[Column] | None = None) -> DataFrame:
    """One row per distinct value (and ``by``): its rows ``_c`` and the rows of lesser values ``_before``.

    ``more`` are further aggregates, named columns; each gets a running sum too, as ``_before_<name>``.
    Values are sorted over all tasks; only sums per partition pass an ordered window.
    """
    values = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"), *(more or []))
    names = [c for c in values.columns if c not in (*by, column)]
    order = [*by, column]
    placed = written(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "values")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part"), *by).agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *by, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in names])
    so_far = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_part", part).select("*", *[F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(f"_run_{n}") for n in names])
    before = [(F.col(f"_off_{n}") + F.col(f"_run_{n}")).alias("_before" if n == "_c" else f"_before_{n}") for n in names]
    return rows.join(offsets, ["_part", *by]).select(*by, column, *names, *before)


#: values that are dealt as hot, at most; any other value has at most a 10,000th of all rows
HOT_VALUES = 10_000
SHARES = 64


def average_ranks(df: DataFrame, column: str, by: list[str] | None = None, *, least: int = 4096) -> DataFrame:
    """Adds ``<column>_rank``: 1-based ascending ranks, ties averaged.

    Ranks are found on distinct values (see ``running_counts``) and joined back.  The rows of a value that has over ``least`` rows and over a
    ``HOT_VALUES``-th of all are dealt to ``SHARES`` tasks, so no task waits for one value.
    """
    by = by or []
    counts = written(running_counts(df, column, by).select(*by, column, "_c", (F.col("_before") + (F.col("_c") + 1) / 2).alias(f"{column}_rank")), "ranks")
    total = counts.agg(F.sum("_c")).first()[0] or 0
    # at most HOT_VALUES rows
    hot = counts.where(F.col("_c") > max(least, total // HOT_VALUES)).select(*by, column)
    ranks = counts.drop("_c")
    if hot.isEmpty():
        return df.join(ranks, [*by, column])
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    dealt = df.join(marked, [*by, column], "left").withColumn("_turn", F.when(F.col("_hot"), F.floor(F.rand(1) * SHARES)).otherwise(0).cast("int"))
    turns = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    copies = ranks.join(marked, [*by, column], "left").withColumn("_turn", F.explode(turns)).drop("_hot")
    return dealt.drop("_hot").join(copies, [*by, column, "_turn"]).drop("_turn")
