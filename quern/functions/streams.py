"""Random numbers without a stream's state: a number's place is hashed, so any task, or another engine, draws it again.

``counter`` columns name a draw (a cell and a replicate, say).  SplitMix64 of the counter and a seed gives a uniform number, and
quantile functions in column arithmetic turn that into normal, Poisson and binomial ones.  Each function has the DuckDB SQL of the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import tie_key_sql, with_tie_key

#: Coefficients of algorithm AS 241 (Wichura 1988) for the normal quantile, constant terms first.
CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
#: below this mean Poisson numbers come from a table of their distribution, above it from a normal number with a correction for skewness
EXACT_MEAN = 32
#: below this variance binomial numbers come from their distribution
EXACT_VARIANCE = 100
BINOMIAL_STEPS = 320
_SPACING = 2.0**-53


def with_uniform(df: DataFrame, counter: str, seed: int, name: str) -> DataFrame:
    """Adds a number between 0 and 1, both excluded, with 53 random bits."""
    hashed = with_tie_key(df, counter, seed, name)
    bits = F.shiftrightunsigned(F.col(name).bitwiseXOR(F.lit(-(1 << 63))), 11)
    return hashed.withColumn(name, (bits.cast("double") + F.lit(0.5)) * F.lit(_SPACING))


def uniform_sql(counter: str, seed: int) -> str:
    return f"(((({tie_key_sql(counter, seed)}) >> 11)::DOUBLE + 0.5) * {_SPACING!r}::DOUBLE)"


def _horner(coefficients: tuple, x, number):
    out = number(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + number(c)
    return out


def normal_quantile(u: Column) -> Column:
    q = u - 0.5
    near = F.lit(0.180625) - q * q
    far = F.sqrt(-F.ln(F.least(u, 1 - u))) - 1.6
    centre = q * _horner(CENTRE[0], near, F.lit) / _horner(CENTRE[1], near, F.lit)
    tail = F.signum(q) * _horner(TAIL[0], far, F.lit) / _horner(TAIL[1], far, F.lit)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(tail)


class _Sql(str):
    def __mul__(self, other):
        return _Sql(f"({self} * {other})")

    def __add__(self, other):
        return _Sql(f"({self} + {other})")


def normal_quantile_sql(u: str) -> str:
    number = lambda c: _Sql(f"{c!r}::DOUBLE")
    q, near, far = f"({u} - 0.5)", f"(0.180625::DOUBLE - ({u} - 0.5) * ({u} - 0.5))", f"(sqrt(-ln(least({u}, 1 - {u}))) - 1.6::DOUBLE)"
    centre = f"{q} * {_horner(CENTRE[0], near, number)} / {_horner(CENTRE[1], near, number)}"
    tail = f"sign({q}) * {_horner(TAIL[0], far, number)} / {_horner(TAIL[1], far, number)}"
    return f"(CASE WHEN abs({q}) <= 0.425::DOUBLE THEN {centre} ELSE {tail} END)"


def poisson_table(mean: int) -> list[float]:
    """P(X <= k) of a Poisson number for k = 0, 1, ... until it no longer grows."""
    out, p, total, k = [], math.exp(-mean), 0.0, 0
    while total + p > total or k < mean:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return out


def poisson_quantile(mean: Column, u: Column) -> Column:
    """The Poisson number of a whole ``mean`` of 0 or more, at ``u``."""
    tables = F.array(*[F.array(*[F.lit(x) for x in poisson_table(m)]) for m in range(1, EXACT_MEAN)])
    exact = F.size(F.filter(F.element_at(tables, mean.cast("int")), lambda x: x <= u)).cast("long")
    z = normal_quantile(u)
    far = F.greatest(F.lit(0), F.floor(mean + F.sqrt(mean.cast("double")) * z + (z * z - 1) / 6 + 0.5))
    return F.when(mean <= 0, F.lit(0)).when(mean < EXACT_MEAN, exact).otherwise(far)


def poisson_quantile_sql(mean: str, u: str, z: str) -> str:
    """``z`` is the normal quantile of ``u``, given apart, since it is long; the tables are those of ``poisson_tables_sql``."""
    far = f"greatest(0, floor({mean} + sqrt({mean}::DOUBLE) * {z} + ({z} * {z} - 1) / 6 + 0.5))"
    return f"(CASE WHEN {mean} <= 0 THEN 0 WHEN {mean} < {EXACT_MEAN} THEN len(list_filter(poisson_tables[{mean}], lambda x: x <= {u})) ELSE {far} END)::BIGINT"


def poisson_tables_sql(name: str = "poisson") -> str:
    """A CTE of one row, ``poisson_tables``, that ``poisson_quantile_sql`` reads."""
    return f"{name} AS MATERIALIZED (SELECT {[poisson_table(m) for m in range(1, EXACT_MEAN)]}::DOUBLE[][] AS poisson_tables)"


def binomial_table(n: Column, y: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... of the rarer side of y in n; empty where its variance allows a normal number."""
    rare = F.least(y, n - y).cast("double")
    p = rare / n
    first = F.exp(n * F.log1p(-p))
    step = lambda s, k: F.struct((s["p"] * (n - k + 1) / k * p / (1 - p)).alias("p"), (s["sum"] + s["p"] * (n - k + 1) / k * p / (1 - p)).alias("sum"), F.concat(s["all"], F.array(s["sum"] + s["p"] * (n - k + 1) / k * p / (1 - p))).alias("all"))
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))
    table = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(BINOMIAL_STEPS)).cast("int")), start, step, lambda s: s["all"])
    return F.when((rare * (1 - p) < EXACT_VARIANCE) & (rare > 0), table).otherwise(F.array().cast("array<double>"))


def binomial_quantile(n: Column, y: Column, table: Column, u: Column) -> Column:
    """A binomial number of n draws with chance y / n, at ``u``; ``table`` is ``binomial_table``."""
    rare = F.least(y, n - y).cast("double")
    p, z = rare / n, normal_quantile(u)
    far = F.floor(rare + F.sqrt(rare * (1 - p)) * z + (1 - 2 * p) * (z * z - 1) / 6 + 0.5)
    drawn = F.when(rare <= 0, F.lit(0)).when(F.size(table) > 0, F.size(F.filter(table, lambda x: x <= u))).otherwise(F.least(F.greatest(far, F.lit(0)), n))
    return F.when(y <= n - y, drawn).otherwise(n - drawn).cast("long")


def binomial_table_sql(source: str, keys: str, name: str) -> str:
    """A CTE: ``keys``, n, y and ``cdf`` of every row of ``source``."""
    p = "least(y, n - y) / n"
    pmf = f"exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p}))"
    return f"""{name} AS MATERIALIZED (
  SELECT b.*, coalesce(c.cdf, []::DOUBLE[]) AS cdf FROM {source} b LEFT JOIN (
    SELECT {keys}, list(total ORDER BY k) AS cdf FROM (
      SELECT {keys}, k, sum({pmf}) OVER (PARTITION BY {keys} ORDER BY k) AS total
      FROM (SELECT * FROM {source} WHERE least(y, n - y) > 0 AND least(y, n - y) * (1 - {p}) < {EXACT_VARIANCE}), range({BINOMIAL_STEPS} + 1) r(k) WHERE k <= n) GROUP BY {keys}) c USING ({keys}))"""


def binomial_quantile_sql(n: str, y: str, u: str, z: str) -> str:
    rare = f"least({y}, {n} - {y})"
    p = f"({rare} / {n})"
    far = f"least(greatest(floor({rare} + sqrt({rare} * (1 - {p})) * {z} + (1 - 2 * {p}) * ({z} * {z} - 1) / 6 + 0.5), 0), {n})"
    drawn = f"(CASE WHEN {rare} <= 0 THEN 0 WHEN len(cdf) > 0 THEN len(list_filter(cdf, lambda x: x <= {u})) ELSE {far} END)"
    return f"(CASE WHEN {y} <= {n} - {y} THEN {drawn} ELSE {n} - {drawn} END)::BIGINT"
