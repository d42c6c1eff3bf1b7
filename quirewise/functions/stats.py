"""Statistics as Column expressions: distributions by finite sums, consistency tests of means and deviations, effect sizes.

Whole degrees of freedom, all that is ever extracted from text, make the sums finite (Abramowitz & Stegun 26.6, 26.7). Up to
``MAX_DF`` they are summed; beyond it, or where a first term would underflow, t has its normal limit, and chi-square and F have Temme's
uniform expansions or, with one number small, the sum over that one (checked to 1e-6).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DF = 2000


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def _series(n: Column, first: Column, ratio) -> Column:
    """first * (1 + r1 + r1 r2 + ...), n terms; ratio(k) leads from term k - 1 to term k."""
    start = F.struct(first.cast("double").alias("t"), F.lit(0.0).alias("s"))
    steps = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda a, k: F.struct((a["t"] * ratio(k.cast("double"))).alias("t"), (a["s"] + a["t"]).alias("s")))["s"]


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a normal deviate."""
    return 2 * normal_cdf(-F.abs(z))


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by a Taylor sum up to |z| = 6, beyond it 0 or 1 within 1e-9."""

    def upper(x: Column) -> Column:
        half = _series(F.lit(120), x, lambda k: x * x / (2 * k + 1)) * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        return F.when(x > 6, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 0.5 - half))

    return let(z.cast("double"), lambda v: let(let(F.abs(v), upper), lambda u: F.when(v < 0, u).otherwise(1 - u)))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function: a rational start (A&S 26.2.23) and three Newton steps."""

    def solve(p: Column) -> Column:
        q = F.least(p, 1 - p)
        x = let(F.sqrt(-2 * F.log(q)), lambda t: t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
        for _ in range(3):
            x = let(x, lambda v: v + ((1 - normal_cdf(v)) - q) / (F.exp(-v * v / 2) / math.sqrt(2 * math.pi)))
        return let(x, lambda v: F.when(p < 0.5, -v).otherwise(v))

    return let(F.when((p > 0) & (p < 1), p.cast("double")), solve)


def _t_series(v: Column, theta: Column) -> Column:
    def body(cs: Column) -> Column:
        c, s = cs["c"], cs["s"]
        even = s * _series((v / 2).cast("int"), F.lit(1.0), lambda k: (2 * k - 1) / (2 * k) * c * c)
        odd = 2 / math.pi * (theta + s * _series(((v - 1) / 2).cast("int"), c, lambda k: 2 * k / (2 * k + 1) * c * c))
        return F.greatest(F.lit(0.0), 1 - F.when(v % 2 == 0, even).otherwise(odd))

    return let(F.struct(F.cos(theta).alias("c"), F.sin(theta).alias("s")), body)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with whole degrees of freedom; null for none."""

    def body(x: Column) -> Column:
        small = let(F.atan(F.abs(x["t"]) / F.sqrt(x["v"])), lambda theta: _t_series(x["v"], theta))
        return F.when(x["t"].isNull() | x["v"].isNull() | (x["v"] <= 0), F.lit(None)).when(x["v"] > MAX_DF, normal_two_sided(x["t"])).otherwise(small)

    return let(F.struct(t.cast("double").alias("t"), df.cast("double").alias("v")), body)


def _uniform(n: Column, half: Column, plain: Column, limit: Column) -> Column:
    """Distribution function by Temme's first two terms: ``half`` is half the squared deviate a unit of n with the sign of ``plain``, the
    inverse of the plain deviate; ``limit`` is the second term's value near the centre."""

    def body(y: Column) -> Column:
        e = y["e"]
        second = F.when(F.abs(e) < 3e-4, y["l"]).otherwise(1 / e - y["i"])
        return normal_cdf(e * F.sqrt(y["n"])) + F.exp(-y["n"] * e * e / 2) / F.sqrt(2 * math.pi * y["n"]) * second

    deviate = F.signum(plain) * F.sqrt(2 * F.greatest(F.lit(0.0), half))
    return let(F.struct(n.alias("n"), deviate.alias("e"), plain.alias("i"), limit.alias("l")), body)


def _f_wide(f: Column, a: Column, b: Column) -> Column:
    """Upper p of F with two large numbers."""
    x0, r = b / (a + b), b / (b + a * f)
    s = F.sqrt(x0 * (1 - x0))
    half = -(x0 * F.log(r / x0) + (1 - x0) * F.log((1 - r) / (1 - x0)))
    return _uniform((a + b) / 2, half, F.when(r == x0, F.lit(0.0)).otherwise(s / (r - x0)), (1 - 2 * x0) / (3 * s))


def _f_long(f: Column, a: Column, b: Column) -> Column:
    """Upper p of F with a small first and a large second number: a sum over the first, Hill's normal deviate for the t it starts from."""

    def body(q: Column) -> Column:
        t2 = a * f
        z = let(F.sqrt((b - 0.5) * F.log1p(t2 / b)), lambda z: z + (z * z * z + 3 * z) / (48 * (b - 0.5) * (b - 0.5)))
        power = F.exp(-b / 2 * F.log1p(t2 / b))
        even = power * _series((a / 2).cast("int"), F.lit(1.0), lambda k: (b + 2 * k - 2) / (2 * k) * q)
        gamma = F.sqrt(b / 2) * (1 - 1 / (4 * b) + 1 / (32 * b * b))
        odd = normal_two_sided(z) + F.when(a > 1, 2 / math.sqrt(math.pi) * gamma * F.sqrt(q) * power * _series(((a - 1) / 2).cast("int"), F.lit(1.0), lambda k: (b + 2 * k - 1) / (2 * k + 1) * q)).otherwise(0.0)
        return F.when(a % 2 == 0, even).otherwise(odd)

    return let(a * f / (b + a * f), body)


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    """Upper p of F with whole degrees of freedom; null for none; 1 for F <= 0."""

    def odd(a: Column, b: Column, theta: Column) -> Column:
        def tail(cs: Column) -> Column:
            c, s = cs["c"], cs["s"]
            gamma = F.aggregate(F.when(b > 1, F.sequence(F.lit(1), ((b - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1 / math.sqrt(math.pi)), lambda r, k: r * (2 * k) / (2 * k - 1))
            return 2 / math.sqrt(math.pi) * gamma * s * F.pow(c, b) * _series(((a - 1) / 2).cast("int"), F.lit(1.0), lambda k: (b + 2 * k - 1) / (2 * k + 1) * s * s)

        return _t_series(b, theta) + F.when(a > 1, let(F.struct(F.cos(theta).alias("c"), F.sin(theta).alias("s")), tail)).otherwise(0.0)

    def body(x: Column) -> Column:
        f, a, b, r = x["f"], x["a"], x["b"], x["b"] / (x["b"] + x["a"] * x["f"])
        even1 = let(r, lambda q: F.pow(q, b / 2) * _series((a / 2).cast("int"), F.lit(1.0), lambda k: (b + 2 * k - 2) / (2 * k) * (1 - q)))
        even2 = let(r, lambda q: 1 - F.pow(1 - q, a / 2) * _series((b / 2).cast("int"), F.lit(1.0), lambda k: (a + 2 * k - 2) / (2 * k) * q))
        both = let(F.atan(F.sqrt(a * f / b)), lambda theta: odd(a, b, theta))
        wide = (F.least(a, b) > 500) & (F.greatest(a, b) > 1000)
        large = F.when(wide, _f_wide(f, a, b)).when(b > MAX_DF, _f_long(f, a, b)).when(a > MAX_DF, 1 - _f_long(1 / f, b, a))
        p = F.when(wide | (a > MAX_DF) | (b > MAX_DF), large).when(a % 2 == 0, even1).when(b % 2 == 0, even2).otherwise(both)
        return F.when(f.isNull() | a.isNull() | b.isNull() | (a <= 0) | (b <= 0), F.lit(None)).when(f <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))

    return let(F.struct(f.cast("double").alias("f"), df1.cast("double").alias("a"), df2.cast("double").alias("b")), body)


def chi2_p(x: Column, df: Column) -> Column:
    """Upper p of chi-square with whole degrees of freedom."""

    def body(y: Column) -> Column:
        x, v = y["x"], y["v"]
        even = F.exp(-x / 2) * _series((v / 2).cast("int"), F.lit(1.0), lambda k: x / 2 / k)
        odd = let(F.sqrt(x), lambda z: 2 * (1 - normal_cdf(z)) + 2 * F.exp(-x / 2) / math.sqrt(2 * math.pi) * _series(((v - 1) / 2).cast("int"), z, lambda k: x / (2 * k + 1)))
        mu = x / v - 1
        wide = 1 - _uniform(v / 2, mu - F.log1p(mu), F.when(mu == 0, F.lit(0.0)).otherwise(1 / mu), F.lit(1 / 3))
        return F.when(x.isNull() | v.isNull() | (v <= 0), F.lit(None)).when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when((v > MAX_DF) | (x > 1000), wide).when(v % 2 == 0, even).otherwise(odd))))

    return let(F.struct(x.cast("double").alias("x"), df.cast("double").alias("v")), body)


def grim(mean: Column, n: Column, decimals: int = 2) -> Column:
    """Whether a mean of n whole numbers can round to ``mean``: some sum s >= 0 near mean * n does."""
    near = let(F.bround(mean * n, 0).cast("long"), lambda base: F.sequence(base - 3, base + 3))
    return F.exists(near, lambda s: (s >= 0) & (F.bround(s / n, decimals) == F.bround(mean, decimals)))


def grim_sum(mean: Column, n: Column) -> Column:
    """The whole sum nearest to mean * n."""
    return F.bround(mean * n, 0).cast("long")


def grimmer(mean: Column, sd: Column, n: Column) -> Column:
    """Whether the sum of squares that mean and sd imply is nearer than a half to a whole number."""
    t = (n - 1) * sd * sd + n * mean * mean
    return F.abs(t - F.bround(t, 0)) < 0.5


def grimmer_strict(mean: Column, sd: Column, n: Column, decimals: int = 2) -> Column:
    """Whether some whole sum of squares gives an sd that rounds to ``sd``: the rounding interval holds a whole number."""
    e = 0.5 * 10.0**-decimals
    low = (n - 1) * F.pow(F.greatest(F.lit(0.0), sd - e), 2) + n * mean * mean
    high = (n - 1) * F.pow(sd + e, 2) + n * mean * mean
    return F.floor(high) >= F.ceil(low)


def max_sd(n: Column, low: Column, high: Column) -> Column:
    """Greatest sd of n values between two bounds; without n the limit for many."""
    half = (high - low) / 2
    return F.when(n.isNull() | (n <= 1), half).otherwise(F.sqrt(n / (n - 1)) * half)


def debit(mean: Column, sd: Column) -> Column:
    """Whether an sd fits a mean of zeros and ones; null if the mean isn't a share."""
    return F.when((mean >= 0) & (mean <= 1), (F.abs(sd - F.sqrt(mean * (1 - mean))) < 0.02) | (sd <= 0.5))


def welch_t(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    return (m1 - m2) / F.sqrt(s1 * s1 / n1 + s2 * s2 / n2)


def d_from_t(t: Column, n1: Column, n2: Column) -> Column:
    return F.when((n1 > 0) & (n2 > 0), t * F.sqrt(1 / n1 + 1 / n2))


def hedges(d: Column, df: Column) -> Column:
    return F.when(df > 0, d * (1 - 3 / (4 * df - 1)))


def dz_from_t(t: Column, n: Column) -> Column:
    return F.when(n >= 2, t / F.sqrt(n))


def r_from_t(t: Column, df: Column) -> Column:
    return F.when(df > 0, t / F.sqrt(t * t + df))


def eta2_from_f(f: Column, df1: Column, df2: Column) -> Column:
    return F.when((f >= 0) & (df1 > 0) & (df2 > 0), f * df1 / (f * df1 + df2))


def omega2_from_f(f: Column, df1: Column, df2: Column) -> Column:
    return F.when((f >= 0) & (df1 > 0) & (df2 > 0), F.greatest(F.lit(0.0), (f * df1 - df1) / (f * df1 + df2 + 1)))


def cohens_f(f: Column, df1: Column, df2: Column) -> Column:
    return F.when((f >= 0) & (df1 > 0) & (df2 > 0), F.sqrt(f * df1 / df2))


def phi_from_chi2(x: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(x / n))


def v_from_chi2(x: Column, n: Column, m: Column) -> Column:
    return F.when((n > 0) & (m > 0), F.sqrt(x / (n * m)))


def compare(reported: Column, computed: Column) -> Column:
    """PASS within .02, ERROR beyond .10 or a fifth, else WARN; SKIP if one is missing."""
    d = F.abs(reported - computed)
    return F.when(reported.isNull() | computed.isNull(), "SKIP").when(d <= 0.02, "PASS").when((d > 0.10) | (d > 0.2 * F.abs(reported)), "ERROR").otherwise("WARN")


def compare_interval(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """PASS if both bounds are within .06, ERROR if one is off by more than .20, else WARN; SKIP if not computed."""
    d = F.greatest(F.abs(lo - lo2), F.abs(hi - hi2))
    return F.when(lo2.isNull() | hi2.isNull(), "SKIP").when(d <= 0.06, "PASS").when(d > 0.20, "ERROR").otherwise("WARN")


def ci_d(d: Column, n1: Column, n2: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval of d by the normal approximation."""
    se = F.sqrt((n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2 - 2)))
    return d - z * se, d + z * se


def ci_r(r: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval of r by Fisher's z; null for n <= 3 or |r| >= 1."""
    ok = (n > 3) & (F.abs(r) < 1)
    return F.when(ok, F.tanh(F.atanh(r) - z / F.sqrt(n - 3))), F.when(ok, F.tanh(F.atanh(r) + z / F.sqrt(n - 3)))


# what no finite sum gives: intervals by inversion of noncentral distributions, on Arrow batches, all rows of a batch at once

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)
#: Elements of the matrices that are in memory at once, unless a single row has more.
_BLOCK = 1 << 18


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula, for n > 0."""
    small = np.minimum(n, 15.0)
    exact = _lgamma(small + 1).astype(float) - (small + 0.5) * np.log(small) + small - 0.5 * math.log(2 * math.pi)
    m = n * n
    return np.where(n > 15, (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m) / m) / m) / m) / n, exact)


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x log(x / m) + m - x without cancellation where both are near."""
    v = (x - m) / (x + m)
    near = (x - m) * v + 2 * x * sum(v ** (2 * j + 1) / (2 * j + 1) for j in range(1, 10))
    return np.where(np.abs(v) < 0.1, near, x * np.log(x / m) + m - x)


def _beta_term(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log of x^a y^b / (a B(a, b)), y = 1 - x, by Loader's saddle point form: what the incomplete beta loses from a to a + 1."""
    n = a + b
    return _stirling_error(n) - _stirling_error(a) - _stirling_error(b) - _deviance(a, n * x) - _deviance(b, n * y) + 0.5 * np.log(b / (2 * math.pi * a * n))


def _beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, y = 1 - x."""
    front = np.exp(_beta_term(a, b, x, y))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, y, x)
    h, on = np.empty_like(p), np.arange(len(p))
    c, d = np.ones_like(p), 1 / (1 - (p + q) * z / (p + 1))
    at, m = d.copy(), 0
    while len(on):
        m += 1
        u, v, w = p[on], q[on], z[on]
        for num in (m * (v - m) * w / ((u + 2 * m - 1) * (u + 2 * m)), -(u + m) * (u + v + m) * w / ((u + 2 * m) * (u + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / np.where(d == 0, 1e-30, d), np.where(c == 0, 1e-30, c)
            at = at * c * d
        done = ~(np.abs(c * d - 1) > 1e-15)
        h[on[done]] = at[done]
        on, c, d, at = on[~done], c[~done], d[~done], at[~done]
    return np.where(swap, 1 - front * a / b * h, front * h)


def _noncentral_f(f: np.ndarray, df1: np.ndarray, df2: np.ndarray, nc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distribution function of the noncentral F for f > 0, and its slope in nc: a Poisson mixture of incomplete betas over all places with
    weight (8.5 deviations around the mode and more), the betas from the last one downwards by their differences."""
    lam = nc / 2
    first = np.floor(np.maximum(0.0, lam - 8.5 * np.sqrt(lam) - 1))
    width = np.ceil(lam + 8.5 * np.sqrt(lam) + 25 - first).astype(int)
    p, slope = np.empty_like(f), np.empty_like(f)
    order, i = np.argsort(width), len(f)
    while i:
        w = width[order[i - 1]]
        i, part = (j := max(0, i - max(1, _BLOCK // w))), order[j:i]
        a, b, g = df1[part] / 2 + first[part], df2[part] / 2, df1[part] * f[part]
        x, y = g / (g + df2[part]), df2[part] / (g + df2[part])
        k, col = np.arange(1.0, w), (slice(None), None)
        mix = np.zeros((len(part), w))
        mix[:, 1:] = np.cumsum(np.log(lam[part][col] / (first[part][col] + k)), axis=1)
        mix = np.exp(mix - mix.max(axis=1)[col])
        mix /= mix.sum(axis=1)[col]
        lost = np.zeros((len(part), w))
        lost[:, 1:] = np.cumsum(np.log(x[col] * (a + b - 1)[col] + x[col] * k) - np.log(a[col] + k), axis=1)
        lost = np.exp(lost + _beta_term(a, b, x, y)[col])
        beta = np.cumsum(lost[:, ::-1], axis=1)[:, ::-1] + _beta_inc(a + w, b, x, y)[col]
        p[part], slope[part] = (mix * beta).sum(axis=1), -(mix * lost).sum(axis=1) / 2
    return p, slope


def noncentral_f_cdf(f: float, df1: float, df2: float, nc: float) -> float:
    """Distribution function of the noncentral F."""
    if f <= 0:
        return 0.0
    with np.errstate(all="ignore"):
        return float(_noncentral_f(*(np.array([x], dtype=float) for x in (f, df1, df2, nc)))[0][0])


def _noncentral_t(t: np.ndarray, df: np.ndarray, nc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distribution function of the noncentral t for t >= 0, and its slope in nc: the mean of the normal one over the chi factor, by Gauss
    and Legendre apart where it rises and where it is 1, so that neither a narrow rise nor a narrow factor falls between the nodes."""
    p, slope = np.empty_like(t), np.empty_like(t)
    step = _BLOCK // len(_NODES)
    for i in range(0, len(t), step):
        s = slice(i, i + step)
        v, m, u = df[s], nc[s], np.maximum(t[s], 1e-300)
        low, high = np.maximum(-1.0, -9 / np.sqrt(2 * v)), 9 / np.sqrt(2 * v)
        start, end = np.clip((m - 9) / u - 1, low, high), np.clip((m + 9) / u - 1, low, high)

        def panel(a, b, v=v):
            e = ((a + b) / 2)[:, None] + ((b - a) / 2)[:, None] * _NODES
            power = np.where(v[:, None] == 1, 0.0, (v[:, None] - 1) * np.log1p(e))
            return e, np.exp(power - v[:, None] * (e + e * e / 2)) * _WEIGHTS * ((b - a) / 2)[:, None]

        whole = panel(low, high)[1].sum(axis=1)
        e, weight = panel(start, end)
        z = (u - m)[:, None] + u[:, None] * e
        p[s] = ((weight * (_erfc(-z / math.sqrt(2)).astype(float) / 2)).sum(axis=1) + panel(end, high)[1].sum(axis=1)) / whole
        slope[s] = -(weight * np.exp(-z * z / 2)).sum(axis=1) / math.sqrt(2 * math.pi) / whole
    return p, slope


def _solve(g, target: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where falling functions g(rows, x) -> (value, slope) take their target, by Newton's steps on the logit, halving where they leave what
    is known to hold the root; lo where the value there is below the target, NaN where it is above it at hi."""
    out = np.full(len(target), np.nan)
    below = g(np.arange(len(target)), lo)[0] < target
    out[below] = lo[below]
    on = np.flatnonzero(~below)
    a, b, x, odds = lo.copy(), hi.copy(), np.clip(start, lo, hi), np.log(target / (1 - target))
    for step in range(300):
        if not len(on):
            break
        p, slope = g(on, x[on])
        high = p > target[on]
        lost = high & (x[on] >= hi[on])
        a[on], b[on] = np.where(high, x[on], a[on]), np.where(high, b[on], x[on])
        new = x[on] - (np.log(p / (1 - p)) - odds[on]) * p * (1 - p) / slope
        new = np.where(high & (new >= hi[on]) & (b[on] == hi[on]), hi[on], new)
        inside = (new >= a[on]) & (new <= b[on]) & (step < 40)
        new = np.where(inside, new, (a[on] + b[on]) / 2)
        fine = 1e-12 * np.maximum(1.0, np.abs(new))
        done = ~lost & ((np.abs(new - x[on]) <= fine) | (b[on] - a[on] <= fine))
        x[on] = new
        out[on[done]] = new[done]
        on = on[~lost & ~done]
    out[on] = x[on]
    return out


def _t_bound(t: np.ndarray, df: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Noncentralities at which t >= 0 has the probability ``target``."""
    start = t - np.array([NormalDist().inv_cdf(q) for q in target]) * np.sqrt(1 + t * t / (2 * df))
    span = np.maximum(50.0, 5 * t + 20)
    return _solve(lambda i, x: _noncentral_t(t[i], df[i], x), target, start, -span, span)


def _f_bound(f: np.ndarray, df1: np.ndarray, df2: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Noncentralities at which F has the probability ``target``; NaN beyond 1000 times the greater of 1 and f."""
    out, g = np.zeros_like(f), df1 * f
    hi = 1000 * np.maximum(1.0, f)
    far = (f > 1e6) & (g > 1e9)
    if far.any():  # the root of the numerator is normal then, with a mean of delta + (df1 - 1) / (2 delta)
        d = _t_bound(np.sqrt(df1[far]) * np.sqrt(f[far]), df2[far], target[far])
        d = np.where(d > 0, (d + np.sqrt(np.maximum(0.0, d * d - 2 * (df1[far] - 1)))) / 2, 0.0)
        out[far] = np.where(d * d <= hi[far], d * d, np.nan)
    i = np.flatnonzero(~far & (f > 0))
    if len(i):
        root = np.sqrt(g[i]) - np.array([NormalDist().inv_cdf(q) for q in target[i]]) * np.sqrt(1 + g[i] / (2 * df2[i]))
        start = np.maximum(0.0, root * np.abs(root) - df1[i] + 1)
        out[i] = _solve(lambda j, x: _noncentral_f(f[i[j]], df1[i[j]], df2[i[j]], x), target[i], start, np.zeros(len(i)), hi[i])
    return out


def eta2_intervals(f: np.ndarray, df1: np.ndarray, df2: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of eta squared: noncentralities at which f is the upper and the lower bound, turned into shares; NaN for none."""
    lo, hi = np.full(len(f), np.nan), np.full(len(f), np.nan)
    with np.errstate(all="ignore"):
        ok = np.isfinite(f) & (f >= 0) & (df1 > 0) & (df2 > 0)
        f, df1, df2, alpha = f[ok], df1[ok], df2[ok], (1 - level[ok]) / 2
        for out, target in ((lo, 1 - alpha), (hi, alpha)):
            nc = _f_bound(f, df1, df2, target)
            out[ok] = nc / (nc + df1 + df2 + 1)
    return lo, hi


def dz_intervals(t: np.ndarray, n: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of dz: noncentralities of t found by inversion of the noncentral t, those of -t being their mirror; NaN for none."""
    lo, hi = np.full(len(t), np.nan), np.full(len(t), np.nan)
    with np.errstate(all="ignore"):
        ok = np.isfinite(t) & (n >= 2)
        t, n, alpha = t[ok], n[ok], (1 - level[ok]) / 2
        low, high = (_t_bound(np.abs(t), n - 1, target) / np.sqrt(n) for target in (1 - alpha, alpha))
        lo[ok], hi[ok] = np.where(t < 0, -high, low), np.where(t < 0, -low, high)
    return lo, hi


def _one(bounds, *x: float) -> tuple[float | None, float | None]:
    lo, hi = (float(b[0]) for b in bounds(*(np.array([v], dtype=float) for v in x)))
    return None if math.isnan(lo) else lo, None if math.isnan(hi) else hi


def eta2_interval(f: float, df1: float, df2: float, level: float = 0.95) -> tuple[float | None, float | None]:
    """Interval of eta squared of a single test."""
    return _one(eta2_intervals, f, df1, df2, level)


def dz_interval(t: float, n: float, level: float = 0.95) -> tuple[float | None, float | None]:
    """Interval of dz of a single test."""
    return _one(dz_intervals, t, n, level)


def _interval_udf(bounds):
    def batches(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame(dict(zip(("lo", "hi"), bounds(*(c.to_numpy(dtype=float) for c in x)))))

    return batches


def eta2_interval_udf():
    """Arrow function of (f, df1, df2, level) for both bounds."""

    def bounds(it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from _interval_udf(eta2_intervals)(it)

    return F.pandas_udf(bounds, "struct<lo: double, hi: double>")


def dz_interval_udf():
    """Arrow function of (t, n, level) for both bounds."""

    def bounds(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from _interval_udf(dz_intervals)(it)

    return F.pandas_udf(bounds, "struct<lo: double, hi: double>")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def average_hash(pixels: Column, bits: int = 256) -> Column:
    """Average hash as longs of 32 bits each: bit k says whether cell k is at least the mean; arrays are cut or filled to ``bits``."""

    def of(px: Column) -> Column:
        return let(F.aggregate(px, F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size(px)), lambda mean: words(px, mean))

    def words(px: Column, mean: Column) -> Column:
        one = lambda k: F.when(F.coalesce(F.try_element_at(px, k + 1), F.lit(-1e30)) >= mean, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.transform(F.sequence(F.lit(0), F.lit(bits // 32 - 1)), lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, k: s * 2 + one(w * 32 + k)))

    return let(pixels, of)
