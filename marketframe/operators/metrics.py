"""Aggregate metrics: regression quality (A8) and request-latency histograms."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Latency histogram bucket bounds in seconds (upper bounds, "le").
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
QUANTILES = (0.95, 0.99)


def regression_metrics(df: DataFrame, by: Iterable[str] = ("Ticker", "split"),
                       label: str = "target", prediction: str = "prediction") -> DataFrame:
    """MAE, MSE, RMSE, R² per group in one aggregation.

    R² = 1 - SSres/SStot with SStot = sum((y - mean y)^2) = sum(y^2) - n*mean^2
    taken from the same pass; when SStot is 0 the convention is 1 for a
    perfect fit and 0 otherwise.
    """
    y, p = F.col(label), F.col(prediction)
    e = y - p
    g = df.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_ssres"),
        F.var_pop(y).alias("_vary"),
    )
    sstot = F.col("_vary") * F.col("n")
    r2 = (F.when(sstot > 0, 1.0 - F.col("_ssres") / sstot)
          .when(F.col("_ssres") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return g.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def bucket_of(seconds: Column, bounds=LATENCY_BUCKETS) -> Column:
    """Smallest bucket bound >= value ("le"); +Inf beyond the last bound."""
    expr = F.lit(float("inf"))
    for b in reversed(bounds):
        expr = F.when(seconds <= b, F.lit(b)).otherwise(expr)
    return expr


def latency_buckets(log: DataFrame, seconds: str = "latency_s", by: Iterable[str] = ()) -> DataFrame:
    """A5: request count per latency bucket (raw, not cumulative) and running total."""
    by = list(by)
    g = log.groupBy(*by, bucket_of(F.col(seconds)).alias("le")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("le").rowsBetween(Window.unboundedPreceding, 0) if by else \
        Window.orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("cumulative", F.sum("n").over(w))


def request_counts(log: DataFrame, name: str = "endpoint") -> DataFrame:
    """Requests per endpoint / metric name."""
    return log.groupBy(name).agg(F.count(F.lit(1)).alias("requests"))


def latency_quantiles(buckets: DataFrame, qs=QUANTILES, by: Iterable[str] = ()) -> DataFrame:
    """Histogram quantile = first bucket whose running count reaches q*total, in ms.

    ``buckets`` is the output of :func:`latency_buckets` (one row per bucket;
    a handful of rows per group).
    """
    by = list(by)
    tot = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy())
    b = buckets.withColumn("_total", tot)
    aggs = [F.min(F.when(F.col("cumulative") >= F.lit(q) * F.col("_total"), F.col("le"))).alias(f"p{round(q * 100)}")
            for q in qs]
    out = b.groupBy(*by).agg(*aggs) if by else b.agg(*aggs)
    return out.select(*by, *[(F.col(f"p{round(q * 100)}") * 1000.0).alias(f"p{round(q * 100)}_ms") for q in qs])


ACCURACY = 1000       # of the sketch that bounds the ranks: error of 1 / ACCURACY of the rows


WIDER = (4.0, 20.0, 100.0, 400.0)  # margins around a rank, in errors of the sketch


def _bounds(log: DataFrame, v: Column, qs: Iterable[float], accuracy: int):
    """(rows, [(low, high) value around each quantile's two ranks]) from one
    sketch. The margin is the first that holds three errors and two ranks; where
    none does, or it reaches beyond the ends, the extremes are the bounds."""
    margins = [w / accuracy for w in WIDER]
    at = sorted({min(1.0, max(0.0, q + s * m)) for q in qs for m in margins for s in (-1, 1)})
    r = log.agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
                F.percentile_approx(v, at, accuracy).alias("c")).first()
    if not r["n"]:
        return 0, []
    cut = dict(zip(at, r["c"]))
    m = next((m for m in margins if m >= 3.0 / accuracy + 2.0 / r["n"]), 1.0)
    return r["n"], [(r["least"] if q - m <= 0 else cut[q - m], r["most"] if q + m >= 1 else cut[q + m]) for q in qs]


def exact_quantiles(log: DataFrame, column: str, qs: Iterable[float], accuracy: int = ACCURACY) -> list[float | None]:
    """Exact quantiles with linear interpolation, all together in two reads.

    The first read makes a sketch, which bounds an interval of values around the
    ranks of every quantile. The second counts the rows below each interval
    and those inside it by value, and the ranks are looked up in the running
    sums: a window over the distinct values inside, a share of about
    8 / accuracy of a long log's rows, partitioned by quantile. A rank outside its
    interval (the sketch's error bound makes that impossible) is an error.
    """
    qs = list(qs)
    v = F.col(column).cast("double")
    n, bounds = _bounds(log, v, qs, accuracy)
    if not n:
        return [None] * len(qs)
    # per row and quantile: below the interval (one group), or inside it (by value)
    inside = F.array(*[F.when(v < low, F.struct(F.lit(i).alias("q"), F.lit(None).cast("double").alias("v")))
                       .when(v <= high, F.struct(F.lit(i).alias("q"), v.alias("v"))) for i, (low, high) in enumerate(bounds)])
    counted = (log.where(v.isNotNull()).select(F.explode(F.array_compact(inside)).alias("x")).select("x.*")
               .groupBy("q", "v").agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(Window.partitionBy("q").orderBy(F.col("v").asc_nulls_first()))
    ranks = [(math.floor(q * (n - 1)), math.ceil(q * (n - 1))) for q in qs]
    of = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in ranks]), F.col("q") + 1)
    rows = (counted.withColumn("upto", upto).where("v is not null").groupBy("q")
            .agg(F.min(F.when(F.col("upto") > of(0), F.col("v"))).alias("low"),
                 F.min(F.when(F.col("upto") > of(1), F.col("v"))).alias("high")).collect())
    held = {r["q"]: r for r in rows}
    out = []
    for i, q in enumerate(qs):
        r = held.get(i)
        if r is None or r["low"] is None or r["high"] is None:
            raise RuntimeError(f"rank of quantile {q} lies outside its interval")
        out.append(r["low"] + (r["high"] - r["low"]) * (q * (n - 1) - ranks[i][0]))
    return out


def percentile_latency(log: DataFrame, seconds: str = "latency_s", qs=QUANTILES, exact: bool = True) -> DataFrame:
    """Quantiles on raw values: exact with linear interpolation (two reads of the
    log for all of them), or bounded-memory ``percentile_approx``."""
    if not exact:
        return log.agg(*[(F.percentile_approx(F.col(seconds), q) * 1000.0).alias(f"p{round(q * 100)}_ms") for q in qs])
    row = [None if x is None else x * 1000.0 for x in exact_quantiles(log, seconds, qs)]
    names = [f"p{round(q * 100)}_ms" for q in qs]
    return log.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{n} double" for n in names))
