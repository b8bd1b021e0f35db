"""Tails of the normal, t, F and chi-squared distributions, and of signed ranks, as column expressions (H1).

The incomplete beta and gamma functions are continued fractions and series of a depth that follows from their parameters,
worked out from their innermost term outwards: an `aggregate` over a sequence, so no row leaves the JVM. The depths give
all the digits that a double has. A null or NaN parameter gives null. Tails of t for many rows are the same in numpy, by batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Terms of the expansion of the logarithm of the gamma function at large arguments: of 1/x, 1/x^3, 1/x^5 and so on.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 8
#: Depths: a constant part, and one by the square root of the parameter.
BETA_DEPTH, GAMMA_DEPTH = (12, 2.5), (50, 9.0)


def _column(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log_gamma(x: Column) -> Column:
    """For x > 0: the expansion at x + SHIFT, less the logarithms of what lies between."""
    y = x + SHIFT
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
    for k, c in enumerate(STIRLING):
        series = series + F.lit(c) / F.pow(y, F.lit(2.0 * k + 1))
    between = x
    for k in range(1, SHIFT):
        between = between * (x + k)
    return series - F.log(between)


def _depth(of: tuple[float, float], parameter: Column) -> Column:
    return (F.lit(of[0]) + F.ceil(F.lit(of[1]) * F.sqrt(parameter))).cast("int")


def _downwards(depth: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step(f, j) from j = depth down to 1, from start on."""
    return F.aggregate(F.sequence(depth, F.lit(1), F.lit(-1)), start, lambda f, j: step(f, j.cast("double")))


def _beta_part(a: Column, b: Column, x: Column) -> Column:
    """The incomplete beta function for x below its turning point (a + 1) / (a + b + 2)."""

    def both(f: Column, k: Column) -> Column:
        """Two terms at once: the odd one of m = k - 1, and the even one of k inside it."""
        at = a + 2 * k
        even = k * (b - k) * x / ((at - 1) * at)
        odd = (a + k - 1) * (a + b + k - 1) * x / ((at - 2) * (at - 1))
        return 1 - odd / (1 + even / f)

    fraction = _downwards(_depth(BETA_DEPTH, F.greatest(a, b)), F.lit(1.0), both)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return front / a / fraction


def beta_cdf(a: Column | str, b: Column | str, x: Column | str) -> Column:
    """The regularized incomplete beta function, for a, b > 0; 0 and 1 beyond the ends."""
    a, b, x = map(_column, (a, b, x))

    def inside(s: Column) -> Column:
        part = _let(F.struct(F.when(s["w"], s["b"]).otherwise(s["a"]).alias("a"), F.when(s["w"], s["a"]).otherwise(s["b"]).alias("b"), F.when(s["w"], 1 - s["x"]).otherwise(s["x"]).alias("x")), lambda t: _beta_part(t["a"], t["b"], t["x"]))
        return F.when(s["w"], 1 - part).otherwise(part)

    swap = x > (a + 1) / (a + b + 2)
    value = _let(F.struct(a.alias("a"), b.alias("b"), x.alias("x"), swap.alias("w")), inside)
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & x.isNotNull() & ~F.isnan(x) & (a > 0) & (b > 0)
    return F.when(known & (x <= 0), F.lit(0.0)).when(known & (x >= 1), F.lit(1.0)).when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def gamma_sf(s: Column | str, x: Column | str) -> Column:
    """The upper regularized incomplete gamma function, for s > 0: a series for small x, a continued fraction for large."""
    s, x = _column(s), _column(x)

    def inside(p: Column) -> Column:
        s, x, n = p["s"], p["x"], p["n"]
        scale = F.exp(s * F.log(x) - x - log_gamma(s))
        series = _downwards(n, F.lit(1.0), lambda f, k: 1 + x / (s + k) * f) / s
        fraction = _downwards(n, x + 2 * n + 1 - s, lambda f, k: x + 2 * k - 1 - s - k * (k - s) / f)
        return F.when(x < s + 1, 1 - scale * series).otherwise(scale / fraction)

    value = _let(F.struct(s.alias("s"), x.alias("x"), _depth(GAMMA_DEPTH, s).alias("n")), inside)
    known = s.isNotNull() & x.isNotNull() & ~F.isnan(s) & ~F.isnan(x) & (s > 0)
    return F.when(known & (x <= 0), F.lit(1.0)).when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def t_p(t: Column | str, df: Column | str) -> Column:
    """Two-sided; null for df of 0 or less."""
    t, df = _column(t), _column(df)
    return F.when(df > 0, beta_cdf(df / 2, F.lit(0.5), df / (df + t * t)))


def _log_gamma_values(x: np.ndarray) -> np.ndarray:
    """log_gamma in numpy."""
    y, between = x + SHIFT, x
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi)
    for k, c in enumerate(STIRLING):
        series = series + c / y ** (2 * k + 1)
    for k in range(1, SHIFT):
        between = between * (x + k)
    return series - np.log(between)


def t_p_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """t_p in numpy: NaN for a NaN, or for df of 0 or less. Rows of like depth are worked out together."""
    out = np.full(len(t), np.nan)
    with np.errstate(all="ignore"):
        x0 = df / (df + t * t)
        known = (df > 0) & np.isfinite(df) & ~np.isnan(x0)
        out[known & (x0 <= 0)], out[known & (x0 >= 1)] = 0.0, 1.0
        inner = np.flatnonzero(known & (x0 > 0) & (x0 < 1))
        a0, x0, b0 = df[inner] / 2, x0[inner], np.full(len(inner), 0.5)
        swap = x0 > (a0 + 1) / (a0 + b0 + 2)
        a, b, x = np.where(swap, b0, a0), np.where(swap, a0, b0), np.where(swap, 1 - x0, x0)
        depth = BETA_DEPTH[0] + np.ceil(BETA_DEPTH[1] * np.sqrt(np.maximum(a, b)))
        fraction, order = np.ones(len(x)), np.argsort(-depth, kind="stable")
        a, b, x, swap, depth, inner = (v[order] for v in (a, b, x, swap, depth, inner))
        for k in range(int(depth[0]) if len(depth) else 0, 0, -1):
            of = slice(0, np.searchsorted(-depth, -k, "right"))  # those that are as deep
            at = a[of] + 2 * k
            even = k * (b[of] - k) * x[of] / ((at - 1) * at)
            odd = (a[of] + k - 1) * (a[of] + b[of] + k - 1) * x[of] / ((at - 2) * (at - 1))
            fraction[of] = 1 - odd / (1 + even / fraction[of])
        part = np.exp(_log_gamma_values(a + b) - _log_gamma_values(a) - _log_gamma_values(b) + a * np.log(x) + b * np.log1p(-x)) / a / fraction
        out[inner] = np.clip(np.where(swap, 1 - part, part), 0.0, 1.0)
    return out


@F.arrow_udf(DoubleType())
def _t_p_batch(t: pa.Array, df: pa.Array) -> pa.Array:
    p = t_p_values(t.to_numpy(zero_copy_only=False).astype(float), df.to_numpy(zero_copy_only=False).astype(float))
    return pa.array(p, mask=np.isnan(p))


def t_p_batches(t: Column | str, df: Column | str) -> Column:
    """t_p for tables of a row a feature and pair of groups: numpy takes a batch of rows at once. Not for use inside lambdas or aggregates."""
    return _t_p_batch(_column(t), _column(df))


def f_p(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """The upper tail; null for degrees of freedom of 0 or less."""
    f, d1, d2 = map(_column, (f, d1, d2))
    return F.when((d1 > 0) & (d2 > 0), F.when(f <= 0, F.lit(1.0)).otherwise(beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))))


def chi2_p(x: Column | str, df: Column | str) -> Column:
    """The upper tail; null for df of 0 or less."""
    x, df = _column(x), _column(df)
    return F.when(df > 0, gamma_sf(df / 2, x / 2))


def normal_p(z: Column | str) -> Column:
    """Two-sided."""
    z = _column(z)
    return gamma_sf(F.lit(0.5) + z * 0, z * z / 2)


def signed_rank_p(n: Column | str, w: Column | str) -> Column:
    """The exact p of a signed-rank sum of at most w, of n pairs without ties: two-sided; null beyond 50 pairs.

    How many sets of the ranks 1 to n have each sum is made rank after rank, as an array of up to 1,276 counts.
    """
    n, w = (F.col(n) if isinstance(n, str) else n).cast("int"), _column(w)
    width = (n * (n + 1) / 2).cast("int")
    first = F.transform(F.sequence(F.lit(0), width), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(0.0))
    grow = lambda counts, k: F.transform(counts, lambda c, i: c + F.when(i >= k, F.get(counts, i - k)).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), n), first, grow)
    below = F.aggregate(F.slice(counts, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    return F.when((n > 0) & (n <= 50) & (w >= 0), F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n)))


# The same as SQL, for the registered queries


def _sql_log_gamma(x: str) -> str:
    return f"lgamma({x})"


def sql_beta_cdf(a: str, b: str, x: str) -> str:
    """DuckDB's text of beta_cdf, with its own lgamma; parameters are doubles."""
    depth = f"(2 * ({BETA_DEPTH[0]} + ceil({BETA_DEPTH[1]} * sqrt(greatest(arg_.a, arg_.b)))))::INT"
    term = "CASE WHEN j_ % 2 = 0 THEN floor(j_ / 2) * (arg_.b - floor(j_ / 2)) * arg_.x / ((arg_.a + 2 * floor(j_ / 2) - 1) * (arg_.a + 2 * floor(j_ / 2))) ELSE -(arg_.a + floor(j_ / 2)) * (arg_.a + arg_.b + floor(j_ / 2)) * arg_.x / ((arg_.a + 2 * floor(j_ / 2)) * (arg_.a + 2 * floor(j_ / 2) + 1)) END"
    fraction = f"list_reduce([i_::DOUBLE FOR i_ IN range({depth}, 0, -1)], lambda f_, j_: 1 + ({term}) / f_, 1.0::DOUBLE)"
    part = f"exp({_sql_log_gamma('arg_.a + arg_.b')} - {_sql_log_gamma('arg_.a')} - {_sql_log_gamma('arg_.b')} + arg_.a * ln(arg_.x) + arg_.b * ln(1 - arg_.x)) / arg_.a / {fraction}"
    swap = f"({x}) > (({a}) + 1) / (({a}) + ({b}) + 2)"
    packed = f"CASE WHEN {swap} THEN {{'a': ({b})::DOUBLE, 'b': ({a})::DOUBLE, 'x': (1 - ({x}))::DOUBLE}} ELSE {{'a': ({a})::DOUBLE, 'b': ({b})::DOUBLE, 'x': ({x})::DOUBLE}} END"
    value = f"list_transform([{packed}], lambda arg_: {part})[1]"
    return f"(CASE WHEN ({x}) IS NULL OR ({a}) IS NULL OR ({b}) IS NULL THEN NULL WHEN ({x}) <= 0 THEN 0 WHEN ({x}) >= 1 THEN 1 WHEN {swap} THEN greatest(0, 1 - {value}) ELSE least(1, {value}) END)"


def sql_gamma_sf(s: str, x: str) -> str:
    """DuckDB's text of gamma_sf."""
    depth = f"({GAMMA_DEPTH[0]} + ceil({GAMMA_DEPTH[1]} * sqrt(arg_.s)))::INT"
    numbers = f"[i_::DOUBLE FOR i_ IN range({depth}, 0, -1)]"
    series = f"list_reduce({numbers}, lambda f_, k_: 1 + arg_.x / (arg_.s + k_) * f_, 1.0::DOUBLE) / arg_.s"
    fraction = f"list_reduce({numbers}, lambda f_, k_: arg_.x + 2 * k_ - 1 - arg_.s - k_ * (k_ - arg_.s) / f_, arg_.x + 2 * {depth} + 1 - arg_.s)"
    scale = f"exp(arg_.s * ln(arg_.x) - arg_.x - {_sql_log_gamma('arg_.s')})"
    value = f"list_transform([{{'s': ({s})::DOUBLE, 'x': ({x})::DOUBLE}}], lambda arg_: CASE WHEN arg_.x < arg_.s + 1 THEN 1 - {scale} * {series} ELSE {scale} / {fraction} END)[1]"
    return f"(CASE WHEN ({x}) IS NULL OR ({s}) IS NULL THEN NULL WHEN ({x}) <= 0 THEN 1 ELSE greatest(0, least(1, {value})) END)"


def sql_t_p(t: str, df: str) -> str:
    return f"(CASE WHEN ({df}) > 0 THEN {sql_beta_cdf(f'({df}) / 2.0', '0.5', f'({df}) / (({df}) + ({t}) * ({t}))')} END)"


def sql_f_p(f: str, d1: str, d2: str) -> str:
    return f"(CASE WHEN ({d1}) > 0 AND ({d2}) > 0 THEN CASE WHEN ({f}) <= 0 THEN 1 ELSE {sql_beta_cdf(f'({d2}) / 2.0', f'({d1}) / 2.0', f'({d2}) / (({d2}) + ({d1}) * ({f}))')} END END)"


def sql_chi2_p(x: str, df: str) -> str:
    return f"(CASE WHEN ({df}) > 0 THEN {sql_gamma_sf(f'({df}) / 2.0', f'({x}) / 2.0')} END)"


def sql_normal_p(z: str) -> str:
    return sql_gamma_sf("0.5", f"({z}) * ({z}) / 2.0")
