"""Money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PULL = 0.25
MOST_DISCOUNT = 0.20


def payback_months(setup: Column, expected: Column, run: Column) -> Column:
    """Months until the setup cost is earned; null where the monthly gain isn't positive."""
    gain = expected - run
    return F.when(gain > 0, setup / gain)


def quote(floor: Column, ceiling: Column, ups: Column, downs: Column) -> Column:
    """A price from the middle of its range, a quarter up or down for each pull, within half to one
    and a half of the range."""
    middle = (floor + ceiling) / 2
    return F.round(F.greatest(floor * 0.5, F.least(ceiling * 1.5, middle * (1 + PULL * (ups - downs)))), 2)


def discounted(price: Column, asked: Column) -> Column:
    return F.round(price * (1 - F.least(F.greatest(asked, F.lit(0.0)), F.lit(MOST_DISCOUNT))), 2)


def convert(amount: Column, rate: Column) -> Column:
    return F.round(amount * rate, 2)
