"""Record shaping (S11): rows as typed structs, features as a name -> value map.

These are the response shapes of the original service, kept as DataFrame
columns (sink: ``write.json``) instead of Python objects built row by row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BAR_COLUMNS


def _clean(c: Column) -> Column:
    """NaN and null both become null (JSON null)."""
    return F.when(~F.isnan(c), c)


def feature_map(names: Iterable[str], cols: dict[str, Column] | None = None) -> Column:
    """MAP<string, double> of feature -> value; null where undefined."""
    names = list(names)
    cols = cols or {}
    pairs = []
    for n in names:
        pairs += [F.lit(n), _clean(cols.get(n, F.col(n)).cast("double"))]
    return F.create_map(*pairs)


def feature_records(features: DataFrame, names: Iterable[str]) -> DataFrame:
    """One record per (Ticker, Date): ``features`` map."""
    return features.select("Ticker", "Date", feature_map(names).alias("features"))


def bar_records(bars: DataFrame) -> DataFrame:
    """Per ticker: count and the list of OHLCV structs in date order.

    ``collect_list`` keeps a whole ticker in one group; that group is bounded
    by the number of days in the range asked for (one row per day)."""
    rec = F.struct(*[F.col(c) for c in BAR_COLUMNS if c != "Ticker"])
    g = bars.groupBy("Ticker").agg(F.count(F.lit(1)).alias("count"),
                                   F.array_sort(F.collect_list(rec)).alias("data"))
    return g


def to_json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON document (column ``value``), ready for ``write.text``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
