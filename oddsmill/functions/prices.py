
from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_SPREAD, TRADE_TOLERANCE = 0.20, 0.05
CLIP = 1e-6


def usable_price(price: Column, bid: Column, ask: Column, max_spread: float = MAX_SPREAD, tolerance: float = TRADE_TOLERANCE) -> Column:
    """One price from a trade and a quote: a trade without a full book stands; else the book must be sound, and the
    trade must lie within its tolerance, or the midpoint is taken."""
    middle = (bid + ask) / 2
    unsound = (ask < bid) | (ask - bid > max_spread)
    near = (price >= bid - tolerance) & (price <= ask + tolerance)
    return (
        F.when(bid.isNull() | ask.isNull(), price)
        .when(unsound, F.lit(None).cast("double"))
        .when(price.isNull(), middle)
        .when(near, price)
        .otherwise(middle)
    )


def quote_midpoint(price: Column, bid: Column, ask: Column) -> Column:
    """The trade, else the midpoint."""
    return F.coalesce(price, (bid + ask) / 2)


def coverage_ratio(days: Column, lifetime: Column) -> Column:
    """[F8] Share of its lifetime on which a market has rows, at most 1."""
    return F.when(lifetime <= 0, F.when(days > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(1.0), days / F.nullif(lifetime, F.lit(0))))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two places, 0 for nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(part * 100.0, whole), 2))


def wilson_interval(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """[2.12] Bounds of a binomial share; (0, 1) for no trials."""
    share = F.try_divide(hits.cast("double"), n)
    scale = F.try_divide(F.lit(z * z), n)
    centre = (share + scale / 2) / (1 + scale)
    half = z * F.sqrt(F.try_divide(share * (1 - share), n) + F.try_divide(scale, 4 * n)) / (1 + scale)
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return low, high


def clip_probability(p: Column, eps: float = CLIP) -> Column:
    """[2.12]"""
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def logit(p: Column, eps: float = CLIP) -> Column:
    """[2.12] Log odds of a clipped probability."""
    q = clip_probability(p, eps)
    return F.ln(q / (1 - q))


def momentum(now: Column, before: Column) -> Column:
    """[2.12] Change of log odds; 0 without an earlier price."""
    return F.when(before.isNull(), F.lit(0.0)).otherwise(logit(now) - logit(before))


def taker_fee(rate: Column, p: Column) -> Column:
    """[B1]"""
    return rate * p * (1 - p)


def probability_bin(p: Column, bins: int = 10) -> Column:
    """[A10] Index of the equal-width bin; 1 is in the last."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(p * bins).cast("int")))


def lifetime_hours(opened: Column, closed: Column) -> Column:
    """[F1]"""
    return (F.unix_timestamp(closed) - F.unix_timestamp(opened)) / 3600.0
