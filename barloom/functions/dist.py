"""Tail probabilities by series and continued fractions, for a handful of aggregated numbers on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(0, 1000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return min(1.0, front * (f - 1.0))


def incomplete_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    log = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * math.exp(log)
    b, c, d = x + 1 - a, 1e300, 1.0 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(log)


def student_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation over n pairs, by Student's t with n - 2 degrees of freedom."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    return student_two_sided(rho * math.sqrt((n - 2) / ((1 + rho) * (1 - rho))), n - 2)


def chi_square_tail(x: float, dof: float) -> float:
    return incomplete_gamma(dof / 2, x / 2)


def f_tail(x: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def binomial_two_sided_half(k: int, n: int) -> float:
    """Two-sided exact p of k successes of n at probability one half."""
    k = min(k, n - k)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(v - top) for v in logs))


def mackinnon_p(tau: float) -> float:
    """p of a Dickey-Fuller statistic with a constant (MacKinnon's 1994 approximation)."""
    # The published response surface.
    if tau > 2.74:
        return 1.0
    if tau < -18.83:
        return 0.0
    small, large = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
    return NORMAL.cdf(sum(c * tau**i for i, c in enumerate(small if tau <= -1.61 else large)))


def mackinnon_critical(n: int) -> dict[str, float]:
    """Critical values with a constant (MacKinnon 2010)."""
    # The published coefficients.
    table = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
    return {k: sum(c / n**i for i, c in enumerate(v)) for k, v in table.items()}


def kpss_p(statistic: float) -> float:
    """p of a level-stationarity statistic, interpolated in the published table and held within it."""
    # Published critical points.
    points = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
    if statistic <= points[0][0]:
        return points[0][1]
    for (a, p), (b, q) in zip(points, points[1:]):
        if statistic <= b:
            return p + (q - p) * (statistic - a) / (b - a)
    return points[-1][1]


# Euler's constant in the ten digits that results must match, and what is taken from the excess kurtosis.
EULER, KURTOSIS_LESS = 0.5772156649, 1


def deflated_sharpe(sharpe: float, n_obs: int, n_trials: int, skew: float = 0.0, excess_kurtosis: float = 0.0) -> float:
    """Probability that a Sharpe ratio exceeds the best expected of n_trials; the variance takes (kurtosis - 1) / 4 of
    the excess kurtosis, as the results to match do."""
    quantile = NORMAL.inv_cdf
    best = 0.0 if n_trials <= 1 else (1 - EULER) * quantile(1 - 1 / n_trials) + EULER * quantile(1 - 1 / (n_trials * math.e))
    spread = 1 - skew * sharpe + (excess_kurtosis - KURTOSIS_LESS) * sharpe**2 / 4
    return NORMAL.cdf((sharpe - best) * math.sqrt((n_obs - 1) / (spread if spread > 0 else 1.0)))
