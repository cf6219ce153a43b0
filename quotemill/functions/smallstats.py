"""Small dense numerics used inside tasks: Student's t, chi-square tail for two degrees, OLS."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 1e-15
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by bisection on the two-sided tail."""
    if p == 0.5:
        return 0.0
    sign, tail = (1.0, 2.0 * (1.0 - p)) if p > 0.5 else (-1.0, 2.0 * p)
    lo, hi = 0.0, 1.0
    while t_two_sided_p(hi, df) > tail:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if t_two_sided_p(mid, df) > tail else (lo, mid)
    return sign * (lo + hi) / 2.0


def chi2_2_tail(x: float) -> float:
    return math.exp(-x / 2.0)


def full_rank(a: np.ndarray) -> bool:
    """Rank test on a Gram matrix after scaling its diagonal to one."""
    d = np.sqrt(np.diag(a))
    if np.any(d <= 0) or not np.all(np.isfinite(a)):
        return False
    s = np.linalg.eigvalsh(a / np.outer(d, d))
    return bool(s[0] > 1e-10 * max(s[-1], 1.0))


def robust_cov(x: np.ndarray, e: np.ndarray, xtx_inv: np.ndarray, kind: str, maxlags: int) -> np.ndarray:
    """Parameter covariance: ``nonrobust``, ``HC1`` or ``HAC`` (Bartlett kernel)."""
    n, k = x.shape
    if kind == "nonrobust":
        return xtx_inv * float(e @ e) / (n - k)
    u = x * e[:, None]
    s = u.T @ u
    if kind == "HC1":
        s = s * n / (n - k)
    else:
        for lag in range(1, min(maxlags, n - 1) + 1):
            g = u[lag:].T @ u[:-lag]
            s = s + (1.0 - lag / (maxlags + 1.0)) * (g + g.T)
    return xtx_inv @ s @ xtx_inv


def plain_objects(out: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """Columns in order; text and empty columns as plain objects with None, for Arrow transfer."""
    out = out.reindex(columns=columns)
    for c in columns:
        typed = pd.api.types.is_numeric_dtype(out[c]) or pd.api.types.is_datetime64_any_dtype(out[c])
        if not typed or out[c].isna().all():  # an all-missing column carries no usable type
            values = out[c].astype(object)
            out[c] = pd.Series([None if pd.isna(v) else v for v in values], index=out.index, dtype=object)
    return out
