"""Scores of products, signals and rankings. The weights and tiers of each score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = ("unknown", "local", "regional", "national", "statute", "constitutional")
RRF = 60


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def share_of_max(value: Column, most: Column) -> Column:
    return F.when(most <= 0, F.lit(0.0)).otherwise(clamp(value / most))


def authority_value(level: Column) -> Column:
    ranks = F.create_map(*[x for i, a in enumerate(AUTHORITY) for x in (F.lit(a), F.lit(i))])
    return F.coalesce(F.try_element_at(ranks, F.lower(level)), F.lit(0))


def rrf_gain(rank: Column, constant: int = RRF) -> Column:
    return 1.0 / (constant + rank)


def stock_pressure(stock: Column) -> Column:
    return F.when(stock.isNull(), 0.35).when(stock <= 0, 1.0).when(stock <= 2, 0.95).when(stock <= 5, 0.82).when(stock <= 10, 0.58).otherwise(0.24)


def availability(stock: Column, most: Column) -> Column:
    ratio = F.least(stock / F.greatest(most, F.lit(1)), F.lit(1.0))
    return F.when(stock.isNull(), 0.15).when(stock <= 0, 0.0).otherwise(F.least(F.lit(1.0), 0.45 + ratio * 0.55))


def price_position(price: Column, low: Column, high: Column) -> Column:
    return F.when(price.isNull() | (high <= low), 0.5).otherwise(clamp((price - low) / (high - low)))


def price_fit(price: Column, low: float | None, high: float | None) -> Column:
    """1 within the budget, falling by the share by which the price misses it."""
    if low is None and high is None:
        return F.lit(0.0)
    fit = F.when(price.isNull(), 0.15)
    if low is not None:
        fit = fit.when(price < low, clamp(1.0 - (low - price) / max(low, 1.0)))
    if high is not None:
        fit = fit.when(price > high, clamp(1.0 - (price - high) / max(high, 1.0)))
    return fit.otherwise(1.0)


def restock_score(stock: Column, demand: Column, lead: Column, margin: Column, risk: Column, returns: Column) -> Column:
    return clamp(stock_pressure(stock) * 0.33 + demand * 0.27 + lead * 0.16 + clamp(margin) * 0.14 + clamp(risk) * 0.08 - clamp(returns) * 0.08)


def recommendation_score(fit: Column, kind: Column, evidence: Column, available: Column, style: Column, sold_out: Column) -> Column:
    total = fit * 0.52 + kind * 0.18 + evidence * 0.10 + available * 0.12 + style * 0.08
    return clamp(F.when(sold_out, total * 0.65).otherwise(total))


def business_priority(demand: Column, units: Column, stock: Column, lead: Column, returns: Column, lead_weight: float = 0.08) -> Column:
    tier = F.when(stock <= 0, 0.28).when(stock <= 5, 0.22).when(stock <= 10, 0.14).otherwise(0.0)
    score = 0.12 + F.coalesce(demand * 0.35, F.lit(0.0)) + F.coalesce(F.least(units / 80.0, F.lit(1.0)) * 0.25, F.lit(0.0)) + tier
    score = score + F.coalesce(F.least(lead / 45.0, F.lit(1.0)) * lead_weight, F.lit(0.0)) - F.coalesce(returns * 0.12, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), score))


def delivery_charge(subtotal: Column, near: Column) -> Column:
    return F.when(near & (subtotal >= 5000), 0.0).when(near, 80.0).otherwise(150.0)


def answer_confidence(top: Column, hits: Column, verified: Column, conflicts: Column) -> Column:
    value = 0.55 * F.least(top / 5.0, F.lit(1.0)) + 0.25 * F.least(hits / 3.0, F.lit(1.0)) + F.when(verified, 0.15).otherwise(-0.25) - F.when(conflicts > 0, 0.2).otherwise(0.0)
    return F.when(hits == 0, 0.0).otherwise(clamp(value))
