"""Window specifications shared by every per-ticker computation.

Why one partition per ticker is safe at scale: the bar key is (Ticker, Date)
with one row per day, so a ticker's series is bounded by the number of days in
the data (about 25,000 rows per century of trading days), no matter how many
ticks produced it. Hash partitioning spreads tickers over tasks; a single
ticker can never outgrow one task. All per-ticker windows below use the same
partitioning and order, so Catalyst plans them as one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TICKER = "Ticker"
DATE = "Date"


def _cols(part) -> list[str]:
    return [part] if isinstance(part, str) else list(part)


def by_ticker(part: str | tuple = TICKER, order: str = DATE) -> WindowSpec:
    """w: every row of a ticker (or of a ticker and a tag), in date order."""
    return Window.partitionBy(*_cols(part)).orderBy(order)


def trailing(n: int, part: str | tuple = TICKER, order: str = DATE) -> WindowSpec:
    """wN: the current row and the n-1 rows before it."""
    return by_ticker(part, order).rowsBetween(-(n - 1), Window.currentRow)


def running(part: str | tuple = TICKER, order: str = DATE) -> WindowSpec:
    return by_ticker(part, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def row_index(part: str | tuple = TICKER, order: str = DATE) -> Column:
    """0-based position of the row in its ticker's series."""
    return F.row_number().over(by_ticker(part, order)) - 1


def full(n: int, part: str = TICKER, order: str = DATE) -> Column:
    """Warm-up guard: true once n rows are available (row index >= n-1)."""
    return row_index(part, order) >= (n - 1)


def lag(col: str | Column, k: int = 1, part: str = TICKER, order: str = DATE) -> Column:
    return F.lag(col, k).over(by_ticker(part, order))


def lead(col: str | Column, k: int = 1, part: str = TICKER, order: str = DATE) -> Column:
    return F.lead(col, k).over(by_ticker(part, order))
