"""Backward scans of the store and features that go on from stored state."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from market_fixtures import bars_of
from marketframe.operators.features import DEFAULT_FEATURES, compute_features
from marketframe.plans.incremental import IncrementalFeatures
from marketframe.sources.store import BarStore, VersionedTable

D0 = dt.date(2020, 1, 1)


def series(ticker, start, n, seed=0):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(size=n))
    return [(D0 + dt.timedelta(days=start + k), ticker, float(c), float(c + 1), float(c - 1), float(c + 0.5), 1000 + k) for k, c in enumerate(close)]


@pytest.fixture()
def reads(monkeypatch):
    seen = []
    plain = VersionedTable._read_folders

    def spy(self, folders):
        seen.append((self.path.rsplit("/", 1)[-1], sorted(folders)))
        return plain(self, folders)

    monkeypatch.setattr(VersionedTable, "_read_folders", spy)
    return seen


def test_latest_bars_read_only_the_newest_folders(spark, tmp, reads):
    store = BarStore(spark, f"{tmp}/bars", buckets=2, period="month")
    store.upsert(bars_of(spark, series("A", 0, 700) + series("B", 0, 700, 1) + series("OLD", 0, 40, 2)))
    reads.clear()
    got = {(r.Ticker, r.Date) for r in store.latest_bars(3, ["A", "B"]).collect()}
    last = D0 + dt.timedelta(days=699)
    assert got == {(t, last - dt.timedelta(days=k)) for t in "AB" for k in range(3)}
    assert {f.split("period=")[1] for _, fs in reads for f in fs} == {"2021-11"}
    reads.clear()
    assert {r.Ticker: r.latest_date for r in store.latest_date(["A", "OLD"]).collect()} == {"A": last, "OLD": D0 + dt.timedelta(days=39)}
    assert len(reads) <= 6  # 23 months in steps of 1, 2, 4, ...
    assert {r.Ticker for r in store.latest_bars(1).collect()} == {"A", "B", "OLD"}
    assert store.latest_bars(1, ["NOBODY"]).collect() == []


def test_newest_before_a_day(spark, tmp):
    store = BarStore(spark, f"{tmp}/bars", buckets=2, period="month")
    store.upsert(bars_of(spark, series("A", 0, 100) + series("B", 0, 100, 1)))
    wanted = spark.createDataFrame([("A", D0 + dt.timedelta(days=50)), ("B", None)], "Ticker string, before date")
    got = sorted((r.Ticker, (r.Date - D0).days) for r in store.table.newest(2, wanted).collect())
    assert got == [("A", 48), ("A", 49), ("B", 98), ("B", 99)]


def whole(spark, rows):
    f = compute_features(bars_of(spark, rows), DEFAULT_FEATURES).toPandas()
    return f.sort_values(["Ticker", "Date"]).reset_index(drop=True)[["Ticker", "Date", *DEFAULT_FEATURES]]


def same(kept, spark, rows):
    got = kept.features.read().toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)
    want = whole(spark, rows)
    assert list(got.Ticker) == list(want.Ticker) and list(got.Date) == list(want.Date)
    for n in DEFAULT_FEATURES:
        np.testing.assert_allclose(got[n].astype(float), want[n].astype(float), rtol=1e-9, atol=1e-9, err_msg=n)


def test_batches_corrections_and_new_tickers_equal_one_computation(spark, tmp):
    kept = IncrementalFeatures(spark, f"{tmp}/inc", DEFAULT_FEATURES, buckets=2, period="month")
    a, b, c = series("A", 0, 300), series("B", 0, 20, 1), series("C", 250, 50, 2)
    kept.ingest(bars_of(spark, a[:260] + b[:8]))
    kept.ingest(bars_of(spark, a[260:261] + b[8:] + c[:3]))        # a daily batch; B is still short, C is new
    wrong = a[200][:2] + (1.0, 2.0, 0.5, 1.0, 5)
    kept.ingest(bars_of(spark, a[261:] + c[3:] + [wrong]))          # a day long past is overwritten
    same(kept, spark, a[:200] + [wrong] + a[201:] + b + c)
    kept.ingest(bars_of(spark, [a[200]]))                           # and put right again
    same(kept, spark, a + b + c)
    assert kept.ingest(bars_of(spark, [])) == 0


def test_a_daily_batch_reads_context_and_its_own_rows(spark, tmp, reads):
    kept = IncrementalFeatures(spark, f"{tmp}/inc", DEFAULT_FEATURES, buckets=1, period="month")
    a = series("A", 0, 900)
    kept.ingest(bars_of(spark, a[:899]))
    reads.clear()
    kept.ingest(bars_of(spark, a[899:]))
    firsts = spark.createDataFrame([("A", a[899][0])], "Ticker string, first date")
    assert kept.frame(firsts).count() == kept.context + 1
    assert kept.frame(firsts).where("_live").count() == 1
    touched = {(t, f.split("period=")[1]) for t, fs in reads for f in fs}
    assert min(p for t, p in touched if t == "bars") >= "2022-02" and {p for t, p in touched if t == "state"} == {"2022-06"}
