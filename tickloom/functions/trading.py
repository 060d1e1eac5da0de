"""Column arithmetic for costs, sizing, barriers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slippage and regulatory fees.
SLIPPAGE = 0.0001
SEC_FEE = 8.0 / 1_000_000
TAF_FEE_PER_SHARE = 0.000166
TAF_FEE_CAP = 8.30

ANNUAL_BARS = 252 * 50


def trade_cost(price: Column, qty: Column, side: Column) -> Column:
    """Slippage on the notional; sells also pay the two regulatory fees."""
    notional = price * qty
    selling = notional * SEC_FEE + F.least(qty * TAF_FEE_PER_SHARE, F.lit(TAF_FEE_CAP))
    return notional * SLIPPAGE + F.when(side == -1, selling).otherwise(0.0)


def kelly_fraction(confidence: Column, win_loss: float = 1.0) -> Column:
    """Half Kelly in [0, 1]; nothing at or below even odds."""
    half = 0.5 * (confidence - (1 - confidence) / win_loss)
    return F.when(confidence <= 0.5, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(half, F.lit(1.0))))


def bet_size(probability: Column, least: float = 0.5) -> Column:
    return F.when(probability < least, 0.0).otherwise(probability)


def barrier_prices(price: Column, vol: Column, side: Column, pt: float, sl: float) -> tuple[Column, Column]:
    """Profit-taking and stop-loss price, mirrored for shorts."""
    direction = F.when(side < 0, -1.0).otherwise(1.0)
    return price * (1 + direction * vol * pt), price * (1 - direction * vol * sl)


def order_qty(value: Column, weight: Column, kelly: Column, price: Column) -> Column:
    """Whole shares for the budget, never less than one; null at a price of zero."""
    shares = F.floor(F.try_divide(value * weight * kelly, price))
    return F.when(price == 0, None).otherwise(F.greatest(F.lit(1), shares)).cast("long")


def label_bin(ret: Column) -> Column:
    """Sign of the return, whichever barrier was touched."""
    return F.signum(ret).cast("int")


def meta_label(predicted: Column, actual: Column) -> Column:
    return (predicted == actual).cast("int")


def entry_allowed(signal: Column, confidence: Column, threshold: Column | float) -> Column:
    return (signal != 0) & (confidence > threshold)
