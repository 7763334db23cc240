import datetime as dt

import pytest
from pyspark.sql import functions as F

from market_fixtures import SF001, bars_of
from marketframe.operators import bars as B
from marketframe.operators import ingest as ING
from marketframe.sources import readers as RD
from marketframe.sources.store import BarStore, FeatureStore
from marketframe.operators.features import compute_features

D = dt.date


def aapl(n, start=D(2024, 1, 1), close0=100.5, ticker="AAPL"):
    return [(start + dt.timedelta(days=k), ticker, close0 + k, close0 + k + 1, close0 + k - 1, close0 + k,
             1_000_000 + 100_000 * k) for k in range(n)]


def test_upsert_count_and_reread(spark, tmp):
    s = BarStore(spark, f"{tmp}/bars")
    assert s.upsert(bars_of(spark, aapl(2))) == 2
    assert s.read().count() == 2
    assert s.upsert(bars_of(spark, [])) == 0


def test_inclusive_range_scan(spark, tmp):
    s = BarStore(spark, f"{tmp}/bars")
    s.upsert(bars_of(spark, aapl(3)))
    got = s.scan("AAPL", "2024-01-01", "2024-01-02").collect()
    assert [r.Date for r in got] == [D(2024, 1, 1), D(2024, 1, 2)]


def test_latest_date_and_tickers(spark, tmp):
    s = BarStore(spark, f"{tmp}/bars")
    assert s.latest_date().count() == 0              # nothing stored: no row (None)
    s.upsert(bars_of(spark, aapl(2)))
    s.upsert(bars_of(spark, aapl(1, ticker="MSFT")))
    assert {r.Ticker: r.latest_date for r in s.latest_date().collect()} == {"AAPL": D(2024, 1, 2),
                                                                         "MSFT": D(2024, 1, 1)}
    assert sorted(r.Ticker for r in s.tickers().collect()) == ["AAPL", "MSFT"]


def test_overwrite_upsert_is_idempotent(spark, tmp):
    s = BarStore(spark, f"{tmp}/bars")
    s.upsert(bars_of(spark, aapl(3)))
    fix = [(D(2024, 1, 2), "AAPL", 1.0, 2.0, 0.5, 1.5, 7)]
    s.upsert(bars_of(spark, fix))
    s.upsert(bars_of(spark, fix))                    # twice = once
    rows = {r.Date: r.Close for r in s.read().collect()}
    assert rows == {D(2024, 1, 1): 100.5, D(2024, 1, 2): 1.5, D(2024, 1, 3): 102.5}


def test_upsert_rejects_duplicates_and_missing_columns(spark, tmp):
    s = BarStore(spark, f"{tmp}/bars")
    dup = aapl(1) + aapl(1)
    with pytest.raises(ValueError, match="duplicate"):
        s.upsert(bars_of(spark, dup))
    with pytest.raises(ValueError, match="Missing required columns"):
        s.upsert(spark.createDataFrame([(1.0,)], "Close double"))


def test_untouched_tickers_survive(spark, tmp):
    s = BarStore(spark, f"{tmp}/bars")
    s.upsert(bars_of(spark, aapl(2) + aapl(2, ticker="MSFT")))
    s.upsert(bars_of(spark, aapl(1, start=D(2024, 1, 3))))
    cnt = {r.Ticker: r["count"] for r in s.read().groupBy("Ticker").count().collect()}
    assert cnt == {"AAPL": 3, "MSFT": 2}


def test_latest_bars_top_n(spark):
    b = bars_of(spark, aapl(5) + aapl(2, ticker="MSFT"))
    got = B.latest_bars(b, 2).collect()
    assert sorted((r.Ticker, r.Date.day) for r in got) == [("AAPL", 4), ("AAPL", 5), ("MSFT", 1), ("MSFT", 2)]


def test_source_registry_and_normalise(spark):
    with pytest.raises(ValueError, match="Unknown provider"):
        RD.get_source("nope")
    vendor = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1 + k), 100.0 + k, 101.0 + k, 99.0 + k, 100.5 + k, 1_000_000 + 100_000 * k, 0.0)
         for k in range(5)], "Date timestamp, Open double, High double, Low double, Close double, Volume long, Dividends double")
    n = RD.normalise(vendor, "AAPL")
    assert n.columns == ["Date", "Ticker", "Open", "High", "Low", "Close", "Volume"]
    assert n.schema["Date"].dataType.simpleString() == "date" and n.count() == 5
    with pytest.raises(ValueError, match="No data returned"):
        RD.require_rows(n.where("Close < 0"), "AAPL")


def test_missing_tickers(spark):
    b = bars_of(spark, aapl(2))
    got = [r.Ticker for r in RD.missing_tickers(spark, ["AAPL", "MSFT"], b).collect()]
    assert got == ["MSFT"]


def test_incremental_fetch_start_rereads_latest(spark):
    stored = bars_of(spark, aapl(3))
    source = bars_of(spark, aapl(6) + aapl(4, ticker="NEW"))
    got = ING.incremental(source, stored, "2024-01-02").collect()
    days = sorted((r.Ticker, r.Date.day) for r in got)
    assert days == [("AAPL", 3), ("AAPL", 4), ("AAPL", 5), ("AAPL", 6),
                    ("NEW", 2), ("NEW", 3), ("NEW", 4)]


def test_split_batch_rejects_bad_ticker_only(spark):
    rows = aapl(3) + [(D(2024, 1, 1), "BAD", 1.0, 0.5, 1.0, 0.0, 1)]
    acc, bad = ING.split_batch(bars_of(spark, rows))
    assert acc.count() == 3
    assert [(r.Ticker, r.reason) for r in bad.collect()] == [("BAD", "high below low")] or \
        [r.Ticker for r in bad.collect()] == ["BAD"]


def test_feature_store_roundtrip(spark, tmp):
    fs = FeatureStore(spark, f"{tmp}/fs", ttl_seconds=3600)
    b = bars_of(spark, aapl(30) + aapl(30, ticker="MSFT"))
    f = compute_features(b, ["sma_5", "returns"])
    now = dt.datetime(2024, 6, 1, 12, 0)
    fs.set(f, computed_at=now)
    got = fs.get(["AAPL"], ["sma_5", "returns"], "2024-01-10", "2024-01-20", as_of=now).orderBy("Date").toPandas()
    exp = f.where("Ticker = 'AAPL' AND Date BETWEEN '2024-01-10' AND '2024-01-20'").orderBy("Date").toPandas()
    assert len(got) == 11
    assert (got["sma_5"].values == exp["sma_5"].values).all()
    assert fs.exists("AAPL", ["sma_5"], as_of=now) and not fs.exists("AAPL", ["rsi_14"], as_of=now)
    assert not fs.exists("AAPL", ["sma_5"], as_of=now + dt.timedelta(hours=2))   # expired
    fs.delete("AAPL")
    assert fs.get(None, ["sma_5"], as_of=now).select("Ticker").distinct().count() == 1
    fs.clear()
    assert fs.get(None, ["sma_5"], as_of=now).count() == 0


def test_stream_equals_batch(spark, tmp):
    from marketframe.plans import catalog as C
    stream = C.ingest_stream(spark, SF001)
    batch = C.bars_upsert(spark, SF001)
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_stream_repeat_is_noop_and_new_landing_applies(spark, tmp):
    from marketframe.streaming.ingest_stream import run_available
    land, store, ck = f"{tmp}/landing", f"{tmp}/bars", f"{tmp}/ck"
    bars_of(spark, aapl(3)).write.parquet(f"{land}/batch=0001")
    bad = f"{tmp}/rejected"
    run_available(spark, land, store, ck, bad)
    first = sorted(BarStore(spark, store).read().collect())
    run_available(spark, land, store, ck, bad)                 # nothing new landed
    assert sorted(BarStore(spark, store).read().collect()) == first
    fix = [(D(2024, 1, 3), "AAPL", 1.0, 2.0, 0.5, 1.5, 7), (D(2024, 1, 4), "AAPL", 2.0, 3.0, 1.5, 2.5, 8)]
    bars_of(spark, fix).write.parquet(f"{land}/batch=0002")
    run_available(spark, land, store, ck, bad)
    rows = {r.Date: r.Close for r in BarStore(spark, store).read().collect()}
    assert rows == {D(2024, 1, 1): 100.5, D(2024, 1, 2): 101.5, D(2024, 1, 3): 1.5, D(2024, 1, 4): 2.5}


def test_record_shaping(spark):
    from marketframe.functions.records import bar_records, feature_records, to_json_lines
    b = bars_of(spark, aapl(3))
    f = compute_features(b, ["sma_5", "returns"])
    recs = feature_records(f, ["sma_5", "returns"]).orderBy("Date").collect()
    assert recs[0].features == {"sma_5": None, "returns": None}
    assert recs[1].features["returns"] == pytest.approx(101.5 / 100.5 - 1)
    r = bar_records(b).collect()[0]
    assert r["count"] == 3 and [x.Date for x in r.data] == [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)]
    line = to_json_lines(feature_records(f, ["returns"]).orderBy("Date")).collect()[1].value
    assert '"returns":' in line and '"Ticker":"AAPL"' in line


def test_numeric_looking_ticker_stays_text(spark, tmp):
    """The bar schema keeps the column text (the S5 repair case)."""
    s = BarStore(spark, f"{tmp}/bars")
    s.upsert(bars_of(spark, aapl(2, ticker="1234")))
    df = s.read()
    assert df.schema["Ticker"].dataType.simpleString() == "string"
    assert {r.Ticker for r in df.collect()} == {"1234"}


def test_feature_store_staleness_after_upsert(spark, tmp):
    bs = BarStore(spark, f"{tmp}/bars")
    bs.upsert(bars_of(spark, aapl(10) + aapl(10, ticker="MSFT")))
    fs = FeatureStore(spark, f"{tmp}/fs", ttl_seconds=None)
    fs.set(compute_features(bs.read(), ["sma_5"]))
    assert fs.stale(bs.latest_date()).count() == 0
    bs.upsert(bars_of(spark, aapl(1, start=D(2024, 1, 11))))          # a new AAPL bar
    st = fs.stale(bs.latest_date()).collect()
    assert [(r.Ticker, r.latest_date, r.source_max_date) for r in st] == [("AAPL", D(2024, 1, 11), D(2024, 1, 10))]


def test_odd_ticker_names_are_deleted(spark, tmp):
    names = ["^GSPC", "ES=F", "BRK/B", "a b", "AAPL"]
    fs = FeatureStore(spark, f"{tmp}/fs", ttl_seconds=None, buckets=2, period="year")
    fs.set(compute_features(bars_of(spark, [r for n in names for r in aapl(8, ticker=n)]), ["sma_5"]))
    for n in names[:4]:
        assert fs.exists(n, ["sma_5"])
        fs.delete(n)
        assert not fs.exists(n, ["sma_5"])
    assert {r.Ticker for r in fs.rows().select("Ticker").distinct().collect()} == {"AAPL"}


def test_batch_is_evaluated_once(spark, tmp):
    """Every evaluation of the batch adds its rows to an accumulator."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    batch = bars_of(spark, aapl(40) + aapl(40, ticker="MSFT"))
    counted = batch.mapInArrow(count, batch.schema)
    store = BarStore(spark, f"{tmp}/bars")
    store.upsert(batch)
    store.upsert(counted)
    assert seen.value == 80
    # the projection must not be folded away
    fs = FeatureStore(spark, f"{tmp}/fs")
    frame = counted.select("Ticker", "Date", "Close")
    fs.set(frame)
    assert seen.value == 160


def test_failed_write_leaves_the_table(spark, tmp, monkeypatch):
    store = BarStore(spark, f"{tmp}/bars")
    store.upsert(bars_of(spark, aapl(3)))
    before = sorted(store.read().collect())

    def broken(batches):
        for b in batches:
            raise RuntimeError("lost")
            yield b

    batch = bars_of(spark, aapl(5, close0=7.0))
    with pytest.raises(Exception, match="lost"):
        store.upsert(batch.mapInArrow(broken, batch.schema))
    assert sorted(store.read().collect()) == before
    # the new folders are written but never published
    def fail(*a):
        raise OSError("no")

    monkeypatch.setattr(store.table, "_publish", fail)
    with pytest.raises(OSError):
        store.upsert(batch)
    assert sorted(BarStore(spark, store.path).read().collect()) == before


def test_second_writer_of_a_version_fails(spark, tmp):
    store = BarStore(spark, f"{tmp}/bars")
    store.upsert(bars_of(spark, aapl(1)))
    number, manifest = store.table._latest()
    store.upsert(bars_of(spark, aapl(2)))
    with pytest.raises(RuntimeError, match="another writer"):
        store.table._publish(number + 1, manifest)


def test_reads_list_only_the_folders_asked_for(spark, tmp):
    store = BarStore(spark, f"{tmp}/bars", buckets=8)
    store.upsert(bars_of(spark, aapl(100) + aapl(100, ticker="MSFT")))
    assert len(store.table.read().inputFiles()) >= 4
    part = store.table.read(["AAPL"], "2024-02-03", "2024-02-20")
    assert len(part.inputFiles()) == 1 and part.count() == 18
    assert store.table.read(["NONE"]).count() == 0


def test_null_keys_are_rejected(spark, tmp):
    rows = spark.createDataFrame([(None, "AAPL", 1.0, 1.0, 1.0, 1.0, 1)], "Date date, Ticker string, Open double, High double, Low double, Close double, Volume long")
    with pytest.raises(ValueError, match="null in key"):
        BarStore(spark, f"{tmp}/bars").upsert(rows)


NAN_ROWS = ("Date date, Ticker string, Open double, High double, Low double, Close double, Volume long",
            [(D(2024, 1, 1), "OK", 1.0, 2.0, 0.5, 1.5, 1), (D(2024, 1, 1), "NAN", 1.0, 2.0, 0.5, float("nan"), 1),
             (D(2024, 1, 2), "NAN", 1.0, 2.0, 0.5, 1.0, 1), (D(2024, 1, 1), None, 1.0, 2.0, 0.5, 1.5, 1),
             (D(2024, 1, 1), "INF", float("nan"), 2.0, 0.5, 1.5, 1), (None, "DAY", 1.0, 2.0, 0.5, 1.5, 1)])


def test_nan_and_null_keys_never_pass(spark):
    from marketframe.schema import conform, violations
    b = spark.createDataFrame(NAN_ROWS[1], NAN_ROWS[0])
    acc, bad = ING.split_batch(b)
    assert [r.Ticker for r in acc.collect()] == ["OK"]
    assert {(r.Ticker, r.reason) for r in bad.collect()} == {(t, "null field") for t in ("NAN", None, "INF", "DAY")}
    assert conform(b).where("isnan(Close)").count() == 0
    assert {(r.Ticker, r.reason) for r in violations(b).collect()} == {
        ("NAN", "null Close"), ("INF", "null Open"), (None, "null Ticker"), ("DAY", "null Date")}


def test_last_landed_file_wins_and_rejected_rows_are_kept(spark, tmp):
    import glob
    import os
    from marketframe.streaming.ingest_stream import run_available
    land, store, ck, bad = f"{tmp}/landing", f"{tmp}/bars", f"{tmp}/ck", f"{tmp}/rejected"
    bars_of(spark, aapl(1)).coalesce(1).write.parquet(f"{land}/batch=z_first")
    bars_of(spark, aapl(1, close0=7.5) + aapl(1, ticker="TWICE") + aapl(1, ticker="TWICE")).coalesce(1).write.parquet(f"{land}/batch=a_second")
    for k, part in enumerate(("batch=z_first", "batch=a_second")):
        for f in glob.glob(f"{land}/{part}/*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)
    run_available(spark, land, store, ck, bad)
    assert [(r.Ticker, r.Close) for r in BarStore(spark, store).read().collect()] == [("AAPL", 7.5)]
    left = spark.read.parquet(bad).collect()
    assert [(r.Ticker, r.reason) for r in left] == [("TWICE", "duplicate key")] * 2


def test_no_machine_local_checkpoint_on_a_cluster(monkeypatch):
    from types import SimpleNamespace
    from marketframe.session import ensure_checkpoint_dir
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"),
                           conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)
