"""Tails of distributions, for the driver: a few numbers, never rows."""

from __future__ import annotations

from math import exp, lgamma, log


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    found = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            found *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * found


def f_tail(f: float, d1: float, d2: float, shift: float = 0.0) -> float:
    """The chance of an F value of `f` or more with d1 and d2 degrees of freedom and a noncentrality: a Poisson mixture, from its largest term outwards."""
    x, half = d1 * f / (d1 * f + d2), shift / 2
    below, middle = 0.0, int(half)
    weight = lambda k: exp(k * log(half) - half - lgamma(k + 1)) if half > 0 else float(k == 0)
    for way in (range(middle, -1, -1), range(middle + 1, middle + 100_000)):
        for k in way:
            w = weight(k)
            below += w * beta_share(x, d1 / 2 + k, d2 / 2)
            if w < 1e-16:
                break
    return min(1.0, max(0.0, 1 - below))
