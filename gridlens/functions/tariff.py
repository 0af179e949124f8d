"""Time-of-use and progressive-block tariff as column expressions.

A :class:`Tariff` is a plain value; every function turns it into literals of
a column expression, so costing stays inside whole-stage codegen (no UDF, no
broadcast table).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import js_round


@dataclass(frozen=True)
class Block:
    min_kwh: float
    max_kwh: float  # math.inf for the open last block
    rate: float


@dataclass(frozen=True)
class Tariff:
    blocks: tuple
    low_rate: float
    currency: str

    def with_overrides(self, low_rate=None, block_rates=None, currency=None) -> "Tariff":
        """Same tariff with some rates or the currency replaced."""
        blocks = self.blocks
        if block_rates:
            blocks = tuple(
                replace(b, rate=float(r)) if r is not None else b
                for b, r in zip(blocks, list(block_rates) + [None] * len(blocks))
            )
        return Tariff(
            blocks=blocks,
            low_rate=float(low_rate) if low_rate is not None else self.low_rate,
            currency=currency or self.currency,
        )


# The default tariff (currency per kWh).  The one-kWh gaps
# between a block's max and the next block's min are part of the tariff.
DEFAULT_TARIFF = Tariff(
    blocks=(
        Block(0.0, 210.0, 4.4376),
        Block(211.0, 630.0, 5.5664),
        Block(631.0, 1050.0, 7.4314),
        Block(1051.0, math.inf, 18.3035),
    ),
    low_rate=1.9765,
    currency="MKD",
)

# Low-tariff hours.  Sunday all day, Saturday from 22:00, Monday
# before 07:00, and on every day 13:00-15:00 and 22:00-07:00.
LOW_AFTERNOON = (13, 15)
LOW_NIGHT_FROM, LOW_NIGHT_UNTIL = 22, 7
# Share of a day's energy assumed at high / low tariff for the quick estimate.
ESTIMATE_HIGH_SHARE, ESTIMATE_LOW_SHARE = 0.6, 0.4


def is_low_tariff_parts(day_of_week: Column, hour: Column) -> Column:
    """``day_of_week`` 1=Sunday..7=Saturday (Spark ``dayofweek``), ``hour`` 0-23."""
    return (
        (day_of_week == 1)
        | ((day_of_week == 7) & (hour >= LOW_NIGHT_FROM))
        | ((day_of_week == 2) & (hour < LOW_NIGHT_UNTIL))
        | ((hour >= LOW_AFTERNOON[0]) & (hour < LOW_AFTERNOON[1]))
        | (hour >= LOW_NIGHT_FROM)
        | (hour < LOW_NIGHT_UNTIL)
    )


def is_low_tariff(ts: Column) -> Column:
    return is_low_tariff_parts(F.dayofweek(ts), F.hour(ts))


def block_cost(kwh: Column, cumulative: Column | float = 0.0, tariff: Tariff = DEFAULT_TARIFF) -> Column:
    """Progressive block cost, rounded to 2 decimals.

    Closed form of walking the blocks in order: block i bills
    ``max(0, min(cum + kwh, max_i) - max(cum, min_i))`` kWh at its rate.
    """
    cum = cumulative if isinstance(cumulative, Column) else F.lit(float(cumulative))
    upto = cum + kwh
    total = None
    for b in tariff.blocks:
        hi = upto if math.isinf(b.max_kwh) else F.least(upto, F.lit(b.max_kwh))
        used = F.greatest(F.lit(0.0), hi - F.greatest(cum, F.lit(b.min_kwh)))
        term = used * F.lit(b.rate)
        total = term if total is None else total + term
    return js_round(total, 2)


def effective_rate(cumulative: Column, tariff: Tariff = DEFAULT_TARIFF) -> Column:
    """Rate of the first block whose max is >= cumulative kWh, else the last rate."""
    expr = None
    for b in tariff.blocks:
        cond = F.lit(True) if math.isinf(b.max_kwh) else (cumulative <= F.lit(b.max_kwh))
        expr = F.when(cond, F.lit(b.rate)) if expr is None else expr.when(cond, F.lit(b.rate))
    return expr.otherwise(F.lit(tariff.blocks[-1].rate))


def reading_cost(kwh: Column, low: Column, cumulative: Column | float = 0.0,
                 tariff: Tariff = DEFAULT_TARIFF) -> dict:
    """Cost of ``kwh`` consumed at a time whose low-tariff flag is ``low``.

    Returns columns ``cost``, ``tariff_type``, ``rate``, ``currency``.
    """
    cum = cumulative if isinstance(cumulative, Column) else F.lit(float(cumulative))
    return {
        "cost": F.when(low, js_round(kwh * F.lit(tariff.low_rate), 2)).otherwise(block_cost(kwh, cum, tariff)),
        "tariff_type": F.when(low, F.lit("low")).otherwise(F.lit("high")),
        "rate": F.when(low, F.lit(tariff.low_rate)).otherwise(effective_rate(cum + kwh, tariff)),
        "currency": F.lit(tariff.currency),
    }


def today_estimate(kwh_today: Column, current_hour: Column, tariff: Tariff = DEFAULT_TARIFF) -> dict:
    """Rough cost of today's energy: 60 % at the mean of blocks 1-2, 40 % low."""
    avg_high = (tariff.blocks[0].rate + tariff.blocks[1].rate) / 2
    est = (kwh_today * F.lit(ESTIMATE_HIGH_SHARE)) * F.lit(avg_high) + (kwh_today * F.lit(ESTIMATE_LOW_SHARE)) * F.lit(tariff.low_rate)
    hours = F.greatest(current_hour, F.lit(1))
    return {
        "value": js_round(est, 2),
        "currency": F.lit(tariff.currency),
        "confidence": confidence(hours),
        "projected_daily": js_round(est / hours * F.lit(24.0), 2),
    }


def confidence(hours: Column) -> Column:
    return F.when(hours < 8, "low").when(hours < 16, "medium").otherwise("high")
