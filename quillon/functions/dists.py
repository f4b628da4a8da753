"""Distribution functions for a few aggregated numbers: normal, Student, chi-square, binomial, signed ranks."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by the continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + t * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + t / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def student_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def chi_square_sf(x: float, df: float) -> float:
    """Upper tail, by the series or the continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def binomial_cdf(k: int, n: int, p: float = 0.5) -> float:
    """P(X <= k)."""
    return 0.0 if k < 0 else 1.0 if k >= n else incomplete_beta(n - k, k + 1, 1 - p)


def studentized_range_sf(q: float, k: int) -> float:
    """Upper tail of the range of k standard normal numbers, by Simpson's rule over the smallest one's place."""
    if not q > 0 or k < 2:
        return 1.0 if k >= 2 and q <= 0 else float("nan")
    n, low, high = 4000, -9.0, 9.0
    step, total = (high - low) / n, 0.0
    for i in range(n + 1):
        z = low + i * step
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        value = density * (normal_cdf(z + q) - normal_cdf(z)) ** (k - 1)
        total += value * (1 if i in (0, n) else 4 if i % 2 else 2)
    return min(1.0, max(0.0, 1 - k * total * step / 3))


def quantile(cdf, q: float, low: float = -1e3, high: float = 1e3) -> float:
    """The point at which a distribution function reaches q, by bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < q else (low, mid)
    return (low + high) / 2


def signed_rank_cdf(w: float, n: int) -> float:
    """P(W <= w) of the sum of positive ranks, exactly; without ties and zeros."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(ways) - 1, rank - 1, -1):
            ways[s] += ways[s - rank]
    return sum(ways[: math.floor(w) + 1]) / 2**n


def p_value(cdf: float, sf: float, alternative: str) -> float:
    """From the lower and the upper tail."""
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError("alternative is two-sided, greater or less")
    return min(1.0, 2 * min(cdf, sf)) if alternative == "two-sided" else sf if alternative == "greater" else cdf
