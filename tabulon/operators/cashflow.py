"""Present values of cash flows in rows: plain sums over a flow's period or day, with no list of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.values import DIV0, NUM, Val


def periods(frame: DataFrame, by: list[str], order: list[str], value: str, out: str = "period") -> DataFrame:
    """Flows numbered from 1 in each group; blank flows take no period and are left out."""
    return frame.where(F.col(value).isNotNull()).withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def npv(rate: float, value: Column, period: Column) -> Val:
    """NPV, an aggregate: the first flow is one period away."""
    return Val("number", F.sum(value / F.pow(F.lit(1.0 + rate), period)) if rate != -1 else F.lit(None).cast("double"), F.lit(DIV0) if rate == -1 else None)


def xnpv(rate: float, value: Column, day: Column) -> Val:
    """XNPV, an aggregate: days count from the first flow's; an earlier one is #NUM!."""
    if rate <= -1:
        return Val("number", F.lit(None).cast("double"), F.lit(NUM))
    early = F.min(day) < 0
    return Val("number", F.when(~early, F.sum(value * F.pow(F.lit(1.0 + rate), -day / 365))), F.when(early, F.lit(NUM)))


def mirr(finance: float, reinvest: float, value: Column, period: Column) -> Val:
    """MIRR, an aggregate: gains grow at one rate, losses are discounted at the other."""
    n = F.max(period)
    up = F.sum(F.when(value > 0, value / F.pow(F.lit(1.0 + reinvest), period)))
    low = F.sum(F.when(value < 0, value / F.pow(F.lit(1.0 + finance), period)))
    bad = up.isNull() | low.isNull() | (n < 2)
    found = F.pow(-up * F.pow(F.lit(1.0 + reinvest), n) / (low * (1.0 + finance)), F.try_divide(F.lit(1.0), n - 1)) - 1
    return Val("number", F.when(~bad, found), F.when(bad, F.lit(DIV0)))
