"""Distribution tails that built-in functions lack."""

from __future__ import annotations

import math
from statistics import NormalDist

N01 = NormalDist()


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_1_tail(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_tail(t: float, df: float) -> float:
    """P(T > t)."""
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k)."""
    if n > 500 and 0 < p < 1:  # in logarithms, as the coefficients are too large for doubles
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        return min(1.0, math.fsum(math.exp(log(i)) for i in range(k, n + 1)))
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact, for p = 1/2."""
    return min(1.0, 2 * binomial_tail(max(k, n - k), n)) if n else 1.0
