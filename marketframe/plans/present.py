"""Output rounding for registered queries (shared rule with the SQL oracle).

Bars from the test tables carry prices in whole cents, so sums are exact and
trailing means are bit-identical in any engine. Price-like outputs are shown
in currency with 4 decimals, RSI and volume means with 4, ratios with 8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqltext import DIGITS, PRICE_LIKE


def shown(name: str, col: Column) -> Column:
    if name in PRICE_LIKE:
        return F.round(col / 100.0, 4).alias(name)
    return F.round(col, DIGITS.get(name, 8)).alias(name)
