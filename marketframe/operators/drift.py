"""Feature drift between a reference and a current period.

Both periods are computed for all tickers, stacked in long form
(Ticker, feature, period, value) with ``unpivot``, and profiled in ONE
aggregation per (Ticker, feature) using conditional aggregates, so no pivot
or self-join is needed. The exact percentile keeps one group's values in
memory (bounded: one value per day); ``exact=False`` switches to the
bounded-memory ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import compute_features, compute_for_range

EPS = 1e-6            # fixed value: "near zero" threshold and percentile guard
QS = (0.25, 0.5, 0.75)


def _long(features: DataFrame, names: list[str], period: str | None = None) -> DataFrame:
    """(Ticker, period, feature, value) rows without nulls/NaN. ``period`` tags an
    untagged frame; otherwise the frame's own ``period`` column is used."""
    present = [n for n in names if n in features.columns]
    if not present:
        return None
    tag = F.lit(period) if period is not None else F.col("period")
    long = features.select("Ticker", tag.alias("period"), *[F.col(n).cast("double").alias(n) for n in present]) \
        .unpivot(["Ticker", "period"], present, "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _when(period: str) -> Column:
    return F.when(F.col("period") == period, F.col("value"))


ROWS = "_rows"        # pseudo-feature that counts the bars of a period


def _profile_long(long: DataFrame, exact: bool) -> DataFrame:
    g = _stats(long, exact)
    return g.where((F.col("ref_n") > 0) & (F.col("cur_n") > 0))


def _stats(long: DataFrame, exact: bool) -> DataFrame:
    pct = (lambda c: F.percentile(c, list(QS))) if exact else \
        (lambda c: F.percentile_approx(c, list(QS), 10000))
    aggs = []
    for p in ("ref", "cur"):
        v = _when(p)
        aggs += [F.count(v).alias(f"{p}_n"), F.avg(v).alias(f"{p}_mean"),
                 F.stddev_samp(v).alias(f"{p}_std"), pct(v).alias(f"{p}_q")]
    return long.groupBy("Ticker", "feature").agg(*aggs)


def skipped(stats: DataFrame, names: Iterable[str], present: Iterable[str], tickers: DataFrame) -> DataFrame:
    """Features left out of the comparison, with the reason, per ticker.

    ``stats`` is the profile of both periods with the row counts, ``tickers`` the
    list of all tickers. A feature that is not a column is "not computed"; one
    without a single defined value in a period is "no values in reference" /
    "no values in current".
    """
    names, present = list(names), set(present)
    held = stats.groupBy("Ticker").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("ref_n", "cur_n")))).alias("m"))
    wanted = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(n in present).alias("made")) for n in names])
    seen = F.try_element_at("m", F.col("w.feature"))
    each = tickers.join(held, "Ticker", "left").withColumn("w", F.explode(wanted)).select(
        "Ticker", "w.feature", "w.made", F.coalesce(seen["ref_n"], F.lit(0)).alias("r"), F.coalesce(seen["cur_n"], F.lit(0)).alias("c"))
    reason = F.when(~F.col("made"), "not computed").when(F.col("r") == 0, "no values in reference").when(F.col("c") == 0, "no values in current")
    return each.select("Ticker", "feature", reason.alias("reason")).where("reason is not null")


def profile(ref: DataFrame, cur: DataFrame, names: Iterable[str], exact: bool = True) -> DataFrame:
    """Per (Ticker, feature): count, mean, sample std and quartiles of each period.

    Features absent or empty in either period are left out (as in the reference).
    """
    names = list(names)
    parts = [p for p in (_long(ref, names, "ref"), _long(cur, names, "cur")) if p is not None]
    if len(parts) < 2:
        return None
    return _profile_long(parts[0].unionByName(parts[1]), exact)


def profile_tagged(features: DataFrame, names: Iterable[str], exact: bool = True) -> DataFrame:
    """D1 on one feature frame holding both periods (column ``period``)."""
    long = _long(features, list(names))
    return None if long is None else _profile_long(long, exact)


def _shift(cur: Column, ref: Column) -> Column:
    """abs((cur - ref) / ref) when |ref| > EPS, else abs(cur - ref)."""
    return F.when(F.abs(ref) > EPS, F.abs((cur - ref) / ref)).otherwise(F.abs(cur - ref))


def report(prof: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Mean, std and quartile shifts, their max and the strict flag."""
    mean_shift = _shift(F.col("cur_mean"), F.col("ref_mean"))
    # one-row periods have a null sample std; the reference's max() skips it
    std_shift = F.when(F.col("ref_std") > EPS, F.abs((F.col("cur_std") - F.col("ref_std")) / F.col("ref_std"))) \
        .otherwise(F.abs(F.col("cur_std") - F.col("ref_std")))
    qshift = F.aggregate(
        F.zip_with("cur_q", "ref_q", lambda c, r: F.abs((c - r) / (r + F.lit(EPS)))),
        F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(len(QS)))
    r = prof.select(
        "Ticker", "feature",
        mean_shift.alias("mean_shift"), std_shift.alias("std_shift"), qshift.alias("percentile_shift"),
        F.col("ref_mean").alias("reference_mean"), F.col("cur_mean").alias("current_mean"),
        F.col("ref_std").alias("reference_std"), F.col("cur_std").alias("current_std"), "ref_n", "cur_n",
    )
    mx = F.greatest("mean_shift", "std_shift", "percentile_shift")
    return r.withColumn("max_shift", mx).withColumn("drift_detected", F.col("max_shift") > F.lit(threshold)) \
        .withColumn("threshold", F.lit(threshold))


# The messages of the summary.
INSUFFICIENT = "Insufficient data for drift detection"
DRIFTED = "Drift detected in %d/%d features"
STEADY = "No significant drift detected"


def _compared() -> Column:
    return (F.col("feature") != ROWS) & (F.col("ref_n") > 0) & (F.col("cur_n") > 0)


def summary(shifts: DataFrame, tickers: DataFrame) -> DataFrame:
    """Per ticker, any-drift flag and the "k/n features" message.

    ``shifts`` is the report over the whole profile, row counts and features
    without a value included: one aggregate per ticker. ``tickers`` lists all
    tickers: one with an empty period (or none at all) has insufficient data; one
    with rows in both periods but no profiled feature is steady with 0 features.
    """
    rows = F.col("feature") == ROWS
    g = shifts.groupBy("Ticker").agg(
        F.max(F.when(rows, F.col("ref_n"))).alias("r"), F.max(F.when(rows, F.col("cur_n"))).alias("c"),
        F.count_if(_compared() & F.col("drift_detected")).alias("k"), F.count_if(_compared()).alias("n"))
    enough = F.coalesce((F.col("r") > 0) & (F.col("c") > 0), F.lit(False))
    k, n = F.when(enough, F.col("k")).otherwise(0), F.when(enough, F.col("n")).otherwise(0)
    message = F.when(~enough, F.lit(INSUFFICIENT)).when(k > 0, F.format_string(DRIFTED, "k", "n")).otherwise(F.lit(STEADY))
    return tickers.join(g, "Ticker", "left").select("Ticker", (k > 0).alias("drift_detected"), k.cast("bigint").alias("n_drifted"),
                                                    n.cast("bigint").alias("n_features"), message.alias("message"))


def flagged(rep: DataFrame) -> DataFrame:
    """Drifted features for display, shifts in percent."""
    return rep.where("drift_detected").select(
        "Ticker", "feature",
        (F.col("max_shift") * 100).alias("max_shift_pct"),
        (F.col("mean_shift") * 100).alias("mean_shift_pct"),
        (F.col("std_shift") * 100).alias("std_shift_pct"),
        "current_mean", "reference_mean",
    )


def periods(bars: DataFrame, ref: tuple[str, str], cur: tuple[str, str],
            tickers: Iterable[str] | None = None) -> DataFrame:
    """Bars of the two periods tagged ``period`` in {ref, cur}. Periods may
    overlap: a day in both appears once per period. The date bounds are a plain
    predicate, so bars of neither period are dropped below the exchanges."""
    b = bars if tickers is None else bars.where(F.col("Ticker").isin(list(tickers)))

    def inside(bounds: tuple[str, str]) -> Column:
        return F.col("Date").between(F.to_date(F.lit(bounds[0])), F.to_date(F.lit(bounds[1])))

    tags = F.array_compact(F.array(F.when(inside(ref), F.lit("ref")), F.when(inside(cur), F.lit("cur"))))
    return b.where(inside(ref) | inside(cur)).withColumn("period", F.explode(tags))


class Drift(NamedTuple):
    report: DataFrame
    summary: DataFrame
    skipped: DataFrame


def detect(bars: DataFrame, names: list[str], ref_start: str, ref_end: str, cur_start: str, cur_end: str,
           threshold: float = 0.05, tickers: Iterable[str] | None = None, warmup: str = "slice",
           exact: bool = True, **kw) -> Drift:
    """Full drift check for all (or the given) tickers: report, summary, skipped.

    Only bars of the two periods are read, aggregated and put through windows;
    row counts come from the same profile. The list of all tickers, which the
    summary and the skipped features need, reads nothing but the tickers.
    With slice warm-up, both periods go through one feature plan keyed by
    (Ticker, period), so each period warms up on its own rows.
    ``warmup="history"`` computes features on the whole history once and cuts
    both periods from it.
    """
    ref, cur = (ref_start, ref_end), (cur_start, cur_end)
    if warmup == "slice":
        feats = compute_features(periods(bars, ref, cur, tickers), names, by=("Ticker", "period"), **kw)
    else:
        full = compute_for_range(bars, tickers, None, max(ref_end, cur_end), names, warmup="history", **kw)
        feats = periods(full, ref, cur)
    present = [n for n in names if n in feats.columns]
    stats = _stats(_long(feats.withColumn(ROWS, F.lit(1.0)), [*present, ROWS]), exact)
    shifts = report(stats, threshold)
    every = bars if tickers is None else bars.where(F.col("Ticker").isin(list(tickers)))
    every = every.select("Ticker").distinct()
    return Drift(shifts.where(_compared()).drop("ref_n", "cur_n"), summary(shifts, every), skipped(stats, names, present, every))
