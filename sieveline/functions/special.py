"""Distribution functions in plain Python: normal, Student t, beta and chi-square, with inverses by bisection.

They run on a few rows (pools), on the driver or inside a pandas UDF.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()
#: The 97.5 % point of the normal law, and the sum with its 80 % point that the detectable effect uses.
Z975 = NORMAL.inv_cdf(0.975)
DETECTABLE = Z975 + NORMAL.inv_cdf(0.8)


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, evaluated by the modified Lentz scheme."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def gamma_cdf(x: float, shape: float) -> float:
    """The regularised lower incomplete gamma function by its series, which converges for every x."""
    if x <= 0:
        return 0.0
    if x > shape + 60 + 12 * math.sqrt(shape + 1):
        return 1.0
    term = total = 1.0 / shape
    k = shape
    while abs(term) > 1e-17 * abs(total):
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(shape * math.log(x) - x - math.lgamma(shape)))


def chi2_cdf(x: float, df: float) -> float:
    return gamma_cdf(x / 2, df / 2)


def inverse(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def beta_ppf(p: float, a: float, b: float) -> float:
    return inverse(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def t_ppf(p: float, df: float) -> float:
    return inverse(lambda x: t_cdf(x, df), p, -1e4, 1e4)


def chi2_ppf(p: float, df: float) -> float:
    return inverse(lambda x: chi2_cdf(x, df), p, 0.0, 1e5)


def assurance(estimate: float, prior_variance: float, se: float, alpha: float = 0.05) -> float:
    """Expected power of a trial with this standard error when the effect is normal about the estimate."""
    bound, spread = NORMAL.inv_cdf(1 - alpha / 2) * se, math.sqrt(prior_variance + se * se)
    return min(1.0, max(0.0, NORMAL.cdf((-bound - estimate) / spread) + NORMAL.cdf((estimate - bound) / spread)))


def beta_fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`beta_fraction` of many arguments at once."""
    kept = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1.0 / kept(1.0 - (a + b) * x / (a + 1.0))
    total = d.copy()
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 / kept(1.0 + term * d), kept(1.0 + term / c)
            total *= c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return total


def t_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tails of Student's law at t >= 0."""
    a, b, x, y = df / 2, np.full_like(df, 0.5), df / (df + t * t), t * t / (df + t * t)
    scale = np.array([math.lgamma(p + 0.5) - math.lgamma(p) - math.lgamma(0.5) for p in a])
    with np.errstate(divide="ignore"):
        front = np.exp(scale + a * np.log(x) + 0.5 * np.log(y))
    swapped = x >= (a + 1) / (a + b + 2)
    fraction = beta_fractions(np.where(swapped, b, a), np.where(swapped, a, b), np.where(swapped, y, x))
    return 0.5 * np.where(swapped, 1 - front * fraction / b, front * fraction / a)


#: From this many degrees of freedom on, Student's points are expanded about the normal ones.
MANY_DF = 10_000


def t_upper(tail: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Points of Student's law with these upper tails, many at once; infinite df stands for the normal law; nan where a
    tail isn't within (0, 1) or df isn't positive."""
    tail, df = np.asarray(tail, "float64"), np.asarray(df, "float64")
    out = np.full(tail.shape, np.nan)
    fine = (tail > 0) & (tail < 1) & (df > 0)
    half, sign = np.minimum(tail, 1 - tail), np.where(tail <= 0.5, 1.0, -1.0)
    if (many := fine & (df >= MANY_DF)).any():
        z, n = np.array([-NORMAL.inv_cdf(p) for p in half[many]]), df[many]
        out[many] = z + (z**3 + z) / (4 * n) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * n * n)
    if (few := fine & (df < MANY_DF)).any():
        low, high = np.full(few.sum(), -30.0), np.full(few.sum(), 50.0)
        for _ in range(70):
            middle = (low + high) / 2
            above = t_tails(np.exp(middle), df[few]) > half[few]
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        out[few] = np.where(half[few] == 0.5, 0.0, np.exp((low + high) / 2))
    return sign * out
