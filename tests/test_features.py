import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from market_fixtures import SF001, bars_of, ramp
from marketframe.functions import indicators as IND
from marketframe.functions.scan import Recurrence, block_range, linear_scan
from marketframe.operators import features as FE
from marketframe.operators.features import compute_features
from marketframe.sources.adapters import bars_from_orders

SIGMA_POP = math.sqrt(33.25)
SIGMA_SAMP = math.sqrt(35.0)


def _pdf(df):
    return df.orderBy("Ticker", "Date").toPandas()


def first_defined(s: pd.Series) -> int:
    return int(s.notna().values.argmax())


def test_ramp_goldens(spark):
    f = _pdf(compute_features(ramp(spark, 100)))
    close = 100.0 + np.arange(100)
    assert len(f) == 100
    expect = {
        "sma_5": (4, close - 2.0), "sma_10": (9, close - 4.5), "sma_20": (19, close - 9.5),
        "sma_50": (49, close - 24.5), "ema_12": (11, close - 5.5), "ema_26": (25, close - 12.5),
        "macd": (25, np.full(100, 7.0)), "macd_signal": (33, np.full(100, 7.0)),
        "macd_histogram": (33, np.zeros(100)), "rsi_14": (14, np.full(100, 100.0)),
        "bb_middle": (19, close - 9.5), "bb_upper": (19, close - 9.5 + 2 * SIGMA_POP),
        "bb_lower": (19, close - 9.5 - 2 * SIGMA_POP), "volatility_20": (19, np.full(100, SIGMA_SAMP)),
        "atr_14": (14, np.full(100, 2.0)), "volume_sma_20": (19, np.full(100, 1e6)),
        "volume_ratio": (19, np.ones(100)), "high_low_ratio": (0, (close + 1) / (close - 1)),
        "close_open_ratio": (0, np.ones(100)),
    }
    for name, (first, values) in expect.items():
        col = f[name]
        assert first_defined(col) == first, name
        assert col.iloc[:first].isna().all(), name
        np.testing.assert_allclose(col.iloc[first:].to_numpy(float), values[first:], rtol=1e-9, atol=1e-9,
                                   err_msg=name)
    prev = close[:-1]
    np.testing.assert_allclose(f["returns"].iloc[1:], close[1:] / prev - 1, rtol=1e-12)
    np.testing.assert_allclose(f["log_returns"].iloc[1:], np.log(close[1:] / prev), rtol=1e-12)
    assert f["returns"].isna().iloc[0] and f["log_returns"].isna().iloc[0]


def test_missing_columns_raise(spark):
    df = spark.createDataFrame([(100.0,), (101.0,), (102.0,)], "Close double")
    with pytest.raises(ValueError, match="Missing required columns"):
        compute_features(df)


def test_empty_in_empty_out(spark):
    df = bars_of(spark, [])
    out = compute_features(df, ["sma_20", "rsi_14"])
    assert out.count() == 0
    assert out.columns == ["Date", "Ticker", "sma_20", "rsi_14"]


def test_tickers_are_independent(spark):
    a = ramp(spark, 60, "AAA", base=100.0)
    b = ramp(spark, 60, "BBB", base=5000.0)
    both = _pdf(compute_features(a.unionByName(b), ["sma_20", "ema_12", "rsi_14", "atr_14"]))
    alone = _pdf(compute_features(a, ["sma_20", "ema_12", "rsi_14", "atr_14"]))
    got = both[both.Ticker == "AAA"].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, alone)


def test_short_series_gives_null_column(spark):
    f = _pdf(compute_features(ramp(spark, 10), ["sma_20", "volatility_20", "ema_12", "macd_signal"]))
    assert len(f) == 10
    for c in ["sma_20", "volatility_20", "ema_12", "macd_signal"]:
        assert f[c].isna().all(), c


def test_flat_and_zero_prices(spark):
    d0 = dt.date(2024, 1, 1)
    rows = [(d0 + dt.timedelta(days=k), "FLAT", 10.0, 10.0, 10.0, 10.0, 0) for k in range(30)]
    rows += [(d0 + dt.timedelta(days=k), "ZERO", 1.0, 1.0, 0.0, 0.0 if k == 3 else 1.0, 5) for k in range(6)]
    f = _pdf(compute_features(bars_of(spark, rows), ["rsi_14", "volume_ratio", "returns", "log_returns",
                                                      "high_low_ratio"]))
    flat = f[f.Ticker == "FLAT"]
    assert flat["rsi_14"].isna().all()          # 0/0
    assert flat["volume_ratio"].isna().all()    # zero volume mean
    zero = f[f.Ticker == "ZERO"].reset_index(drop=True)
    assert zero["high_low_ratio"].isna().all()  # Low = 0
    assert zero.loc[3, "returns"] == -1.0 and pd.isna(zero.loc[3, "log_returns"])
    assert pd.isna(zero.loc[4, "returns"]) and pd.isna(zero.loc[4, "log_returns"])


def test_unknown_feature_skipped(spark):
    with pytest.warns(UserWarning, match="not found"):
        out = compute_features(ramp(spark, 30), ["sma_5", "nope"])
    assert out.columns == ["Date", "Ticker", "sma_5"]


def test_failing_feature_dropped(spark):
    reg = FE.get_registry().child()
    reg.register("boom", lambda ctx: 1 / 0)
    reg.register("bad_col", lambda ctx: F.col("NoSuchColumn") * 2)
    out = compute_features(ramp(spark, 30), ["sma_5", "boom", "bad_col"], registry=reg)
    assert out.columns == ["Date", "Ticker", "sma_5"]
    with pytest.raises(ZeroDivisionError):
        compute_features(ramp(spark, 30), ["boom"], registry=reg, on_error="raise")


def test_registry_layers():
    base = FE.DEFAULT_REGISTRY
    assert base.list_features()[:3] == ["sma_5", "sma_10", "sma_20"] and len(base.list_features()) == 21
    with pytest.raises(ValueError):
        base.register("x", IND.sma(3))
    child = base.child()
    child.register("sma_3", IND.sma(3), {"length": 3})
    assert child.has("sma_3") and not base.has("sma_3")
    assert child.get_config("sma_3") == {"length": 3}
    assert child.get_config("bb_upper") == {"length": 20, "std": 2.0}
    assert child.list_features()[-1] == "sma_3"
    with pytest.warns(UserWarning, match="overwriting"):
        child.register("sma_3", IND.sma(3))
    assert FE.group("volume") == ["volume_sma_20", "volume_ratio"]
    assert len(FE.DEFAULT_FEATURES) == 9


def test_custom_tiers(spark):
    reg = FE.get_registry().child()
    reg.register("mid", lambda ctx: (ctx.c("High") + ctx.c("Low")) / 2)                     # tier 1

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:                                                      # tier 2
        return float(v.max() - v.min())
    reg.register("range_5", lambda ctx: ctx.guard(4, spread(ctx.c("Close")).over(ctx.trailing(5))))

    class Obj:                                                                               # tier 3
        name = "cummax"

        def compute(self, pdf):
            return pdf["Close"].cummax()
    reg.register("cummax", Obj())
    out = compute_features(ramp(spark, 30), ["mid", "range_5", "cummax"], registry=reg)
    assert out.columns == ["Date", "Ticker", "mid", "range_5", "cummax"]
    f = _pdf(out)
    close = 100.0 + np.arange(30)
    np.testing.assert_allclose(f["mid"], close)
    assert f["range_5"].iloc[:4].isna().all()
    np.testing.assert_allclose(f["range_5"].iloc[4:], 4.0)
    np.testing.assert_allclose(f["cummax"], close)


def test_multi_output_flatten(spark):
    reg = FE.get_registry().child()
    reg.register("bands", lambda ctx: {"hi": IND.bb_upper()(ctx), "lo": IND.bb_lower()(ctx)})
    out = compute_features(ramp(spark, 30), ["bands"], registry=reg)
    assert out.columns == ["Date", "Ticker", "bands_hi", "bands_lo"]


def test_laws_on_real_bars(spark):
    f = compute_features(bars_from_orders(spark, SF001), ["bb_middle", "sma_20", "macd", "macd_signal",
                                                         "macd_histogram", "rsi_14"]).toPandas()
    pd.testing.assert_series_equal(f["bb_middle"], f["sma_20"], check_names=False)
    d = (f["macd"] - f["macd_signal"] - f["macd_histogram"]).abs().max()
    assert d < 1e-6
    r = f["rsi_14"].dropna()
    assert ((r >= 0) & (r <= 100)).all()


def _pandas_ema(x: pd.Series, n: int) -> pd.Series:
    """Brute force: SMA seed at row n-1, then the recursion row by row."""
    a = 2.0 / (n + 1)
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return pd.Series(out)
    y = x.iloc[:n].mean()
    out[n - 1] = y
    for t in range(n, len(x)):
        y = a * x.iloc[t] + (1 - a) * y
        out[t] = y
    return pd.Series(out)


def test_scan_multi_block_matches_brute_force(spark):
    """Smallest admissible block forces several blocks per ticker (carry path)."""
    b = bars_from_orders(spark, SF001)
    lo = 40
    small = compute_features(b, ["ema_12", "ema_26", "rsi_14", "atr_14", "macd_signal"], block=lo).toPandas()
    big = compute_features(b, ["ema_12", "ema_26", "rsi_14", "atr_14", "macd_signal"]).toPandas()
    key = ["Ticker", "Date"]
    small, big = small.sort_values(key).reset_index(drop=True), big.sort_values(key).reset_index(drop=True)
    for c in ["ema_12", "ema_26", "rsi_14", "atr_14", "macd_signal"]:
        np.testing.assert_allclose(small[c], big[c], rtol=1e-11, atol=1e-6, err_msg=c)  # cents
    bars = b.orderBy("Ticker", "Date").toPandas()
    for t, g in bars.groupby("Ticker"):
        exp = _pandas_ema(g["Close"].reset_index(drop=True), 12)
        got = small[small.Ticker == t]["ema_12"].reset_index(drop=True)
        np.testing.assert_allclose(got, exp, rtol=1e-12, err_msg=t)


def test_linear_scan_direct(spark):
    rows = [("A", i, float(i % 7) - 3.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "Ticker string, _i long, x double")
    q = 0.9
    out = linear_scan(df, [Recurrence("y", F.col("x"), q)], block=block_range(q)[1] // 5).orderBy("_i").toPandas()
    y, exp = 0.0, []
    for v in out["x"]:
        y = v + q * y
        exp.append(y)
    np.testing.assert_allclose(out["y"], exp, rtol=1e-12, atol=1e-12)


def test_range_warmup_modes(spark):
    b = ramp(spark, 120)
    s = FE.compute_for_range(b, ["AAPL"], "2024-03-01", "2024-03-31", ["sma_20"], warmup="slice").toPandas()
    h = FE.compute_for_range(b, ["AAPL"], "2024-03-01", "2024-03-31", ["sma_20"], warmup="history").toPandas()
    assert len(s) == len(h) == 31
    assert s["sma_20"].isna().sum() == 19 and h["sma_20"].notna().all()


def test_min_rows_and_fill(spark):
    a, b = ramp(spark, 60, "AAA"), ramp(spark, 30, "BBB")
    f = compute_features(a.unionByName(b), ["sma_20"])
    assert {r.Ticker for r in FE.min_rows(f, 50).select("Ticker").distinct().collect()} == {"AAA"}
    fz = FE.fill_missing(f, "zero").where("Ticker = 'AAA'").orderBy("Date").toPandas()
    assert (fz["sma_20"].iloc[:19] == 0).all()
    fb = FE.fill_missing(f, "backward").where("Ticker = 'AAA'").orderBy("Date").toPandas()
    assert (fb["sma_20"].iloc[:19] == fb["sma_20"].iloc[19]).all()
    fm = FE.fill_missing(f, "mean").where("Ticker = 'BBB'").orderBy("Date").toPandas()
    assert fm["sma_20"].notna().all()
    with pytest.raises(ValueError):
        FE.fill_missing(f, "sideways")


def test_shared_order_same_values(spark):
    b = bars_from_orders(spark, SF001)
    names = ["sma_20", "ema_12", "rsi_14", "macd_signal", "atr_14"]
    a = compute_features(b, names).orderBy("Ticker", "Date").toPandas()
    s = compute_features(b, names, shared_order=True).orderBy("Ticker", "Date").toPandas()
    for c in names:
        np.testing.assert_allclose(a[c], s[c], rtol=1e-11, atol=1e-6, err_msg=c)
