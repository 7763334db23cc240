import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from market_fixtures import SF001, ramp
from marketframe.operators import dataset as DS
from marketframe.operators import metrics as MET
from marketframe.operators import models as MO
from marketframe.operators import scoring as SC
from marketframe.plans import training as TR
from marketframe.sources.adapters import bars_from_orders
from marketframe.sources.store import RunLog


def test_training_set_sizes(spark):
    ts = DS.prepare(ramp(spark, 100), ["sma_20", "rsi_14"], "returns", 1)
    assert ts.frame.count() == 80 and ts.feature_cols == ["sma_20", "rsi_14"]
    ts2 = DS.prepare(ramp(spark, 200), ["sma_20"], "returns", 1)
    assert ts2.frame.count() == 180
    sp = {r.split: r["count"] for r in DS.split(ts2.frame, 0.2).groupBy("split").count().collect()}
    assert sp == {"train": 144, "test": 36}


def test_target_named_feature_is_not_an_input(spark):
    ts = DS.prepare(ramp(spark, 60), ["sma_5", "returns"], "returns", 1)
    assert ts.feature_cols == ["sma_5"]
    with pytest.raises(ValueError, match="no input column left"):
        DS.feature_columns(ts.frame, ["returns"], "returns")


def test_price_target_is_forward_return(spark):
    f = DS.add_target(ramp(spark, 10).select("Ticker", "Date", "Close"), "Close", 3).orderBy("Date").toPandas()
    c = f["Close"].to_numpy()
    np.testing.assert_allclose(f["target"].iloc[:7], c[3:] / c[:7] - 1)
    assert f["target"].iloc[7:].isna().all()


def test_model_registry_and_params(spark):
    with pytest.raises(ValueError, match="Unknown model type"):
        MO.MODELS.create("svm")
    rf = MO.MODELS.create("random_forest", learning_rate=0.3, n_estimators=7)
    assert rf.getNumTrees() == 7 and rf.getMaxDepth() == 10 and rf.getSeed() == 42
    lin = MO.MODELS.create("linear_regression", learning_rate=0.1, max_depth=3, n_estimators=5)
    assert lin.getRegParam() == 0.0
    g = MO.MODELS.create("lightgbm", max_depth=3)
    assert g.getMaxIter() == 100 and g.getMaxDepth() == 3 and g.getStepSize() == 0.1
    assert set(MO.MODELS.list_models()) == {"xgboost", "lightgbm", "random_forest", "linear_regression"}


def test_ols_exact_coefficients(spark):
    rng = np.random.default_rng(7)
    x1, x2 = rng.uniform(size=200), rng.uniform(size=200)
    pdf = pd.DataFrame({"Ticker": ["A"] * 100 + ["B"] * 100, "x1": x1, "x2": x2})
    pdf["target"] = np.where(pdf.Ticker == "A", 2 * x1 - 3 * x2 + 1, -x1 + 0.5 * x2 + 4)
    co = {r.Ticker: r for r in MO.ols_fit(spark.createDataFrame(pdf), ["x1", "x2"]).collect()}
    np.testing.assert_allclose([co["A"].intercept, co["A"].coef_0, co["A"].coef_1], [1, 2, -3], atol=1e-9)
    np.testing.assert_allclose([co["B"].intercept, co["B"].coef_0, co["B"].coef_1], [4, -1, 0.5], atol=1e-9)


def test_ols_collinear_falls_back(spark):
    x = np.arange(50, dtype=float)
    pdf = pd.DataFrame({"Ticker": "A", "a": x, "b": 2 * x, "target": 3 * x + 1})
    co = MO.ols_fit(spark.createDataFrame(pdf), ["a", "b"]).collect()[0]
    pred = co.intercept + co.coef_0 * x + co.coef_1 * 2 * x
    np.testing.assert_allclose(pred, 3 * x + 1, atol=1e-6)


def test_r2_conventions(spark):
    rows = [("A", "t", 1.0, 1.0), ("A", "t", 1.0, 1.0), ("B", "t", 2.0, 2.0), ("B", "t", 2.0, 3.0),
            ("C", "t", 1.0, 1.5), ("C", "t", 3.0, 2.5)]
    df = spark.createDataFrame(rows, "Ticker string, split string, target double, prediction double")
    m = {r.Ticker: r for r in MET.regression_metrics(df).collect()}
    assert m["A"].r2 == 1.0 and m["B"].r2 == 0.0
    assert m["C"].r2 == pytest.approx(1 - 0.5 / 2.0) and m["C"].mae == pytest.approx(0.5)
    assert m["C"].rmse == pytest.approx(0.5)


def test_business_day_shift_matches_pandas(spark):
    days = [dt.date(2024, 3, 1) + dt.timedelta(days=k) for k in range(40)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (0, 1, 3, 7):
        got = [r.s for r in df.select(SC.business_day_shift(F.col("d"), n).alias("s")).collect()]
        exp = [(pd.Timestamp(d) + pd.offsets.BDay(n)).date() if n else d for d in days]
        assert got == exp, n


def test_tree_fit_is_deterministic(spark):
    b = bars_from_orders(spark, SF001)
    _, _, s1 = TR.scored_splits(b, "random_forest", ["sma_20", "rsi_14"], {"n_estimators": 5, "max_depth": 4})
    _, _, s2 = TR.scored_splits(b, "random_forest", ["sma_20", "rsi_14"], {"n_estimators": 5, "max_depth": 4})
    a = s1.select("Ticker", "Date", "prediction").orderBy("Ticker", "Date").toPandas()
    c = s2.select("Ticker", "Date", "prediction").orderBy("Ticker", "Date").toPandas()
    pd.testing.assert_frame_equal(a, c)


def test_train_log_predict_latest(spark, tmp):
    b = ramp(spark, 200)
    log = RunLog(spark, f"{tmp}/runs")
    s = TR.train(b, "linear_regression", ["sma_20", "rsi_14"], runlog=log)
    assert s["feature_names"] == ["sma_20", "rsi_14"]
    assert s["params"]["n_train_samples"] + s["params"]["n_test_samples"] == 180
    run = log.run(s["run_id"])
    assert run["features"] == ["sma_20", "rsi_14"] and run["params"]["n_features"] == "2"
    preds = TR.predict(b, log, s["run_id"]).orderBy("feature_date").toPandas()
    assert len(preds) == 200 and preds["prediction"].iloc[:19].isna().all()
    assert (preds["Date"] > preds["feature_date"]).all()
    last = TR.predict_latest(b, log, s["run_id"], n=3).toPandas()
    assert len(last) == 3 and last["prediction"].notna().all()
    with pytest.raises(ValueError, match="Run not found"):
        log.run("missing")
    with pytest.raises(ValueError, match="Model not found"):
        log.load_model("missing")


def test_validation_fraction_and_config(spark):
    b = ramp(spark, 200)
    m = MO.mark_validation(DS.prepare(b, ["sma_20"]).frame, 0.25)
    assert m.where("is_validation").count() == 45
    s = TR.train_from_config(b, {"model": {"type": "xgboost", "params": {"n_estimators": 5, "max_depth": 2}},
                                 "features": ["sma_20", "rsi_14"], "data": {"test_size": 0.25},
                                 "validation_fraction": 0.2})
    assert s["params"]["n_test_samples"] == 45 and s["model_type"] == "xgboost"
    with pytest.raises(ValueError, match="unknown config keys"):
        TR.train_from_config(b, {"model_type": "xgboost", "features": ["sma_20"], "colour": "red"})
    with pytest.raises(ValueError, match="boosted-tree"):
        TR.train_from_config(b, {"model_type": "linear_regression", "features": ["sma_20"],
                                 "validation_fraction": 0.1})


@pytest.mark.parametrize("p", [1, 2, 3])
def test_ols_paths_agree_with_numpy(spark, p):
    rng = np.random.default_rng(p)
    n = 300
    X = rng.normal(size=(n, p)) * [1.0, 50.0, 0.01][:p] + [3.0, -2.0, 100.0][:p]
    y = X @ np.array([0.5, -0.02, 7.0][:p]) + rng.normal(size=n) * 0.1
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(p)])
    pdf["target"], pdf["Ticker"] = y, "T"
    pdf["fit"] = np.arange(n) < 200
    df = spark.createDataFrame(pdf)
    cols = [f"x{i}" for i in range(p)]
    A = np.c_[np.ones(200), X[:200]]
    beta = np.linalg.lstsq(A, y[:200], rcond=None)[0]
    co = MO.ols_fit(df.where("fit"), cols).collect()[0]
    np.testing.assert_allclose([co.intercept, *[co[f"coef_{i}"] for i in range(p)]], beta, rtol=1e-8, atol=1e-10)
    pred = MO.ols_fit_predict(df, cols, F.col("fit")).toPandas()
    np.testing.assert_allclose(pred["prediction"], np.c_[np.ones(n), X] @ beta, rtol=1e-8, atol=1e-8)


# content of a job file of the kind users have
JOB = {"ticker": "AAPL", "model_type": "linear_regression", "feature_names": ["sma_5", "returns"],
       "model_params": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "random_state": 42},
       "target": "returns", "lookback_days": 1, "test_size": 0.2, "start_date": None, "end_date": None, "use_cache": True,
       "training": {"early_stopping_rounds": 10, "validation_split": 0.1, "verbose": True},
       "registry": {"name": "models", "stage": "staging"}}


def test_job_file_trains(spark):
    job = {**JOB, "model_params": {}}
    s = TR.train_from_config(ramp(spark, 60), job)
    assert s["feature_names"] == ["sma_5"] and s["ticker"] == "AAPL"
    assert TR.flatten_config(JOB)["validation_split"] == 0.1
    with pytest.raises(ValueError, match="unknown config keys"):
        TR.flatten_config({**JOB, "colour": 1})
    with pytest.raises(ValueError, match="model type and features"):
        TR.train_from_config(ramp(spark, 60), {"model_type": "linear_regression"})


def test_empty_training_set_is_an_error(spark):
    with pytest.raises(ValueError, match="empty training set"):
        TR.train(ramp(spark, 30), "linear_regression", ["sma_50"])


def test_fit_layout_follows_the_session(spark):
    b = ramp(spark, 60)
    assert TR.fit_partitions(b, "random_forest", None) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert TR.fit_partitions(b, "random_forest", 3) == 3
    assert TR.fit_partitions(b, "linear_regression", 3) is None


def test_exact_quantiles_read_the_log_twice(spark, tmp):
    """Ties, heavy values and the extremes; every query execution over the log is one read."""
    from marketframe.operators import metrics as MET
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.exponential(size=3000), np.full(1500, 0.25), [5.0, 5.0]])
    spark.createDataFrame([(float(v),) for v in x] + [(None,)], "latency_s double").write.parquet(f"{tmp}/log")
    log = spark.read.parquet(f"{tmp}/log")
    qs = (0.0, 0.5, 0.95, 0.999, 1.0)
    jobs = []
    for name in ("agg", "where"):
        original = getattr(type(log), name)

        def spy(self, *a, _f=original, _n=name, **k):
            jobs.append(_n) if self is log else None
            return _f(self, *a, **k)
        setattr(type(log), name, spy)
        try:
            got = MET.exact_quantiles(log, "latency_s", qs)
        finally:
            setattr(type(log), name, original)
        np.testing.assert_allclose(got, np.quantile(x, qs), rtol=1e-12)
    assert sorted(jobs) == ["agg", "where"]  # the sketch and the counting pass
    assert MET.exact_quantiles(log.where("false"), "latency_s", qs) == [None] * len(qs)
    few = spark.createDataFrame([(1.0,), (3.0,)], "latency_s double")
    assert MET.exact_quantiles(few, "latency_s", (0.5, 0.25)) == [2.0, 1.5]


def test_nearly_collinear_inputs_keep_their_digits(spark):
    """Condition number 1e8: factors against numpy, in many small partitions."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for t in ("A", "B"):
        x = rng.normal(size=(400, 3))
        x[:, 2] = x[:, 0] + 1e-8 * rng.normal(size=400)
        y = 1.5 + x @ np.array([2.0, -1.0, 3.0]) + 1e-12 * rng.normal(size=400)
        assert 1e7 < np.linalg.cond(x - x.mean(0)) < 1e9
        want[t] = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
        rows += [(t, *map(float, v), float(z)) for v, z in zip(x, y)]
    df = spark.createDataFrame(rows, "Ticker string, a double, b double, c double, target double").repartition(13)
    for r in MO.ols_fit(df, ["a", "b", "c"]).collect():
        np.testing.assert_allclose([r.intercept, r.coef_0, r.coef_1, r.coef_2], want[r.Ticker], rtol=1e-5)
        assert r.n == 400


def test_few_rows_and_null_tickers_in_the_factors(spark):
    rows = [("A", 1.0, 2.0, 3.0, 4.0), (None, 1.0, 0.0, 0.0, 1.0), (None, 0.0, 1.0, 0.0, 2.0), (None, 0.0, 0.0, 1.0, 3.0), (None, 0.0, 0.0, 0.0, 0.0), ("B", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "Ticker string, a double, b double, c double, target double").repartition(3)
    got = {r.Ticker: r for r in MO.ols_fit(df, ["a", "b", "c"]).collect()}
    assert set(got) == {"A", None} and got["A"].intercept == pytest.approx(4.0) and got["A"].coef_0 == 0
    np.testing.assert_allclose([got[None][f"coef_{i}"] for i in range(3)] + [got[None].intercept], [1, 2, 3, 0], atol=1e-12)


def test_boosted_fit_deals_rows_by_their_number(spark, monkeypatch):
    """A few rows are one task a job; the forest, which draws by partition, keeps its layout."""
    b, few = ramp(spark, 120), {"n_estimators": 2, "max_depth": 2}
    parts = {m: TR.train(b, m, ["sma_20", "rsi_14"], few)["params"]["fit_partitions"] for m in ("xgboost", "random_forest")}
    assert parts == {"xgboost": 1, "random_forest": int(spark.conf.get("spark.sql.shuffle.partitions"))}
    assert TR.train(b, "xgboost", ["sma_20"], few, partitions=3)["params"]["fit_partitions"] == 3
    monkeypatch.setattr(TR, "ROWS_A_TASK", 50)
    ts = TR.training_frame(b, ["sma_20", "rsi_14"])
    assert TR.fit_layout(ts, "xgboost", None) == 2  # 80 training rows
    monkeypatch.setattr(TR, "ROWS_A_TASK", 1)
    assert TR.fit_layout(ts, "xgboost", None) == TR.fit_partitions(ts.frame, "xgboost", None)
