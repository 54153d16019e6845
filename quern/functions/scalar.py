"""Column functions that Spark has no built-in for."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z_95 = NormalDist().inv_cdf(0.975)
Z_ROUNDED = 1.96
TAIL_STEPS = 40

# The constants of splitmix64.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


_LOW = (1 << 32) - 1


def _halves(c: Column) -> tuple[Column, Column]:
    """The upper and the lower 32 bits, each as a number of 0 to 2^32 - 1."""
    return F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(_LOW))


def _joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def _plus(c: Column, k: int) -> Column:
    """c + k modulo 2^64, without an overflow on the way."""
    high, low = _halves(c)
    total = low + F.lit(k & _LOW)
    return _joined(high + F.lit(k >> 32) + F.shiftrightunsigned(total, 32), total)


def _times(c: Column, k: int) -> Column:
    """c * k modulo 2^64 from products of 32 and 16 bits."""
    high, low = _halves(c)
    a, b, top = k & 0xFFFF, (k >> 16) & 0xFFFF, k >> 32
    first, second = low * F.lit(a), low * F.lit(b)
    total = first.bitwiseAND(F.lit(_LOW)) + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    cross = lambda x, y: x.bitwiseAND(F.lit(0xFFFF)) * F.lit(y) + F.shiftleft((F.shiftrightunsigned(x, 16) * F.lit(y)).bitwiseAND(F.lit(0xFFFF)), 16)
    upper = F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(second, 16) + F.shiftrightunsigned(total, 32)
    return _joined(upper + cross(low, top).bitwiseAND(F.lit(_LOW)) + cross(high, k & _LOW).bitwiseAND(F.lit(_LOW)), total)


def with_tie_key(df: DataFrame, row_id: str, seed: int, name: str) -> DataFrame:
    """Adds splitmix64 of ``row_id + seed``, an unsigned number shifted to order like one in a signed long.

    Each step is a projection of its own, so that nothing is computed twice; all are compiled JVM code.
    """
    columns = [F.col(f"`{c}`") for c in df.columns if c != name]
    x = F.col(name)
    steps = [
        _plus(F.col(row_id).cast("long"), (seed + GOLDEN) % (1 << 64)),
        x.bitwiseXOR(F.shiftrightunsigned(x, 30)),
        _times(x, MIX_1),
        x.bitwiseXOR(F.shiftrightunsigned(x, 27)),
        _times(x, MIX_2),
        x.bitwiseXOR(F.shiftrightunsigned(x, 31)).bitwiseXOR(F.lit(-(1 << 63))),
    ]
    for step in steps:
        df = df.select(*columns, step.alias(name))
    return df


def tie_key_sql(row_id: str, seed: int = 0) -> str:
    """DuckDB SQL of the same order: an unsigned 64-bit number."""
    wrap = lambda x: f"CAST(({x}) % 18446744073709551616 AS UBIGINT)"
    x = wrap(f"CAST({row_id} AS UHUGEINT) + {(seed + GOLDEN) % (1 << 64)}")
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        x = wrap(f"CAST(xor({x}, ({x}) >> {shift}) AS UHUGEINT) * CAST({factor} AS UHUGEINT)")
    return f"xor({x}, ({x}) >> 31)"


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def log_normal_tail(z: Column) -> Column:
    """ln P(Z > |z|): a continued fraction above 2, a series below, both in column arithmetic."""
    a = F.abs(z)
    fraction = a
    for k in range(TAIL_STEPS, 0, -1):
        fraction = a + F.lit(float(k)) / fraction
    far = -a * a / 2 - F.lit(0.5 * math.log(2 * math.pi)) - F.ln(fraction)
    # below 2 the tail is 1/2 minus the series of the density's integral
    series = F.lit(1.0)
    for k in range(24, 0, -1):
        series = 1 + a * a / F.lit(float(2 * k + 1)) * series
    near = F.ln(F.lit(0.5) - a * series * F.exp(-a * a / 2) / F.lit(math.sqrt(2 * math.pi)))
    return F.when(a > 2, far).otherwise(near)


def log_normal_tail_sql(z: str) -> str:
    """DuckDB SQL of ``log_normal_tail``."""
    fraction = f"abs({z})"
    for k in range(TAIL_STEPS, 0, -1):
        fraction = f"(abs({z}) + {float(k)} / {fraction})"
    series = "1.0"
    for k in range(24, 0, -1):
        series = f"(1 + {z} * {z} / {float(2 * k + 1)} * {series})"
    far = f"-{z} * {z} / 2 - {0.5 * math.log(2 * math.pi)!r} - ln({fraction})"
    near = f"ln(0.5 - abs({z}) * {series} * exp(-{z} * {z} / 2) / {math.sqrt(2 * math.pi)!r})"
    return f"(CASE WHEN abs({z}) > 2 THEN {far} ELSE {near} END)"


def p_value_text(p: Column, log10_p: Column) -> Column:
    """Three decimals in scientific form, or a bound where the value is below the least double."""
    bound = F.concat(F.lit("<1e"), (F.floor(log10_p) + 1).cast("string"))
    return F.when(p > 0, F.format_string("%.3e", p)).otherwise(bound)


def half_even(c: Column) -> Column:
    """Rounded to an integer, halves to the even one."""
    return F.bround(c, 0).cast("long")
