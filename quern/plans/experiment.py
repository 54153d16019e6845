"""The experiment view: one row per order, with twelve features, an arm and nested outcomes.

Any table with these columns works with the operators; this view derives one from the star schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = [f"f{i}" for i in range(12)]
FLAGS = ["treatment", "conversion", "visit", "exposure"]
COLUMNS = ["source_row_id", *FEATURES, *FLAGS]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _cents(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def experiment(spark: SparkSession, sf_dir: str, *, items: bool = True) -> DataFrame:
    """The view over the tables in ``sf_dir``; without ``items``, f4 to f9 are left out and lineitem isn't read.

    lineitem is aggregated before the join, so the join has a row per order on either side.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    base = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    item_columns: list[Column] = []
    if items:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        per_order = lines.groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("n_items"),
            F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
            F.sum(_cents("l_extendedprice")).alias("item_cents"),
            F.sum(_cents("l_discount")).alias("discount"),
            F.max(F.to_date("l_shipdate")).alias("last_ship"),
            F.count_distinct("l_partkey").alias("parts"),
        )
        base = base.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        days = F.datediff("last_ship", F.to_date("o_orderdate"))
        item_columns = [
            F.coalesce(c, F.lit(0)).cast("double").alias(n)
            for n, c in zip(FEATURES[4:10], [F.col("n_items"), F.col("quantity"), F.col("item_cents"), F.col("discount"), days, F.col("parts")])
        ]
    treatment = F.when((F.col("o_orderkey") * 7919 + 13) % 100 < 85, 1).otherwise(0)
    converts = F.col("o_orderpriority").like("1%")
    visit = F.when((F.col("o_orderstatus") == "F") | ((treatment == 1) & (F.col("c_acctbal") > 5000) & (F.col("o_orderkey") % 3 == 0)), 1).otherwise(0)
    return base.select(
        F.col("o_orderkey").alias("source_row_id"),
        _cents("o_totalprice").cast("double").alias("f0"),
        _cents("c_acctbal").cast("double").alias("f1"),
        F.col("c_nationkey").cast("double").alias("f2"),
        F.ascii("c_mktsegment").cast("double").alias("f3"),
        *item_columns,
        F.substring("o_orderpriority", 1, 1).cast("double").alias("f10"),
        F.month("o_orderdate").cast("double").alias("f11"),
        treatment.alias("treatment"),
        F.when((visit == 1) & converts, 1).otherwise(0).alias("conversion"),
        visit.alias("visit"),
        F.when((treatment == 1) & (F.col("o_orderkey") % 28 == 0), 1).otherwise(0).alias("exposure"),
    )


#: The same view in DuckDB SQL.
EXPERIMENT_SQL = """
SELECT o_orderkey AS source_row_id,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS f0,
  CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS DOUBLE) AS f1,
  CAST(c_nationkey AS DOUBLE) AS f2, CAST(ascii(c_mktsegment) AS DOUBLE) AS f3,
  CAST(coalesce(n_items, 0) AS DOUBLE) AS f4, CAST(coalesce(quantity, 0) AS DOUBLE) AS f5,
  CAST(coalesce(item_cents, 0) AS DOUBLE) AS f6, CAST(coalesce(discount, 0) AS DOUBLE) AS f7,
  CAST(coalesce(date_diff('day', CAST(o_orderdate AS DATE), last_ship), 0) AS DOUBLE) AS f8,
  CAST(coalesce(parts, 0) AS DOUBLE) AS f9,
  CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS f10, CAST(month(o_orderdate) AS DOUBLE) AS f11,
  treatment, CASE WHEN visit = 1 AND o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS conversion, visit,
  CASE WHEN treatment = 1 AND o_orderkey % 28 = 0 THEN 1 ELSE 0 END AS exposure
FROM (
  SELECT *, CASE WHEN o_orderstatus = 'F' OR (treatment = 1 AND c_acctbal > 5000 AND o_orderkey % 3 = 0) THEN 1 ELSE 0 END AS visit
  FROM (SELECT *, CASE WHEN (o_orderkey * 7919 + 13) % 100 < 85 THEN 1 ELSE 0 END AS treatment FROM orders JOIN customer ON o_custkey = c_custkey)
) LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_items, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS item_cents,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount,
    max(CAST(l_shipdate AS DATE)) AS last_ship, count(DISTINCT l_partkey) AS parts
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""

#: Rankings to compare, as expressions over the view; higher is targeted first.
SCORES = {
    "s_learner": ("f1", lambda: F.col("f1")),
    "t_learner": ("f1 * 2 - f0", lambda: F.col("f1") * 2 - F.col("f0")),
    "x_learner": ("f1 + f2 * 1000", lambda: F.col("f1") + F.col("f2") * 1000),
    "response_propensity": ("f0", lambda: F.col("f0")),
    "constant_ate": ("0 * f0", lambda: F.lit(0.0)),
    "segment_uplift": ("f3", lambda: F.col("f3")),
}
UPLIFT_MODELS = ["s_learner", "t_learner", "x_learner"]
RESPONSE_MODEL = "response_propensity"


def scores(view: DataFrame, outcome: str = "visit", models: list[str] | None = None) -> DataFrame:
    """(model_name, source_row_id, score, treatment, outcome): every model's ranking in long form, in one scan."""
    chosen = models or list(SCORES)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), SCORES[m][1]().cast("double").alias("score")) for m in chosen])).alias("m")
    return view.select(rows, "source_row_id", "treatment", F.col(outcome).alias("outcome")).select("m.*", "source_row_id", "treatment", "outcome")


def scores_sql(outcome: str = "visit", models: list[str] | None = None) -> str:
    parts = [f"SELECT '{m}' AS model_name, source_row_id, CAST({SCORES[m][0]} AS DOUBLE) AS score, treatment, {outcome} AS outcome FROM exp" for m in models or SCORES]
    return " UNION ALL ".join(parts)
