"""Daily profiles: moments exact, quartiles within the sketch's rank error."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.operators import profiles as PR

D0 = dt.date(2015, 1, 1)


def frame(spark, values, name="x"):
    return spark.createDataFrame([(D0 + dt.timedelta(days=k), "T", v) for k, v in enumerate(values)], f"Date date, Ticker string, {name} double")


def day(k):
    return str(D0 + dt.timedelta(days=k))


def test_any_two_periods_from_one_table(spark):
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=3000)                      # a large mean: sums of squares would cancel
    x[::97] = np.nan
    prof = PR.daily_profiles(frame(spark, [float(v) for v in x]), ["x", "absent"]).persist()
    for a, b in ((0, 2999), (10, 40), (500, 1700)):
        r = PR.period_profile(prof, day(a), day(b), "p").first()
        part = x[a:b + 1]
        part = part[~np.isnan(part)]
        assert r.p_n == len(part)
        assert r.p_mean == pytest.approx(part.mean(), rel=1e-14) and r.p_std == pytest.approx(part.std(ddof=1), rel=1e-9)
        ranks = [(part <= q).mean() for q in r.p_q]
        np.testing.assert_allclose(ranks, PR.QS, atol=0.02 + 1 / len(part))
    prof.unpersist()


def test_many_values_a_day_and_defined_cases(spark):
    rows = [(D0, "T", float(v)) for v in range(1000)] + [(D0 + dt.timedelta(days=1), "T", None), (D0 + dt.timedelta(days=2), "T", 7.0)]
    df = spark.createDataFrame(rows, "Date date, Ticker string, x double")
    prof = PR.daily_profiles(df, ["x"])
    assert {r.Date: r.n for r in prof.collect()} == {D0: 1000, D0 + dt.timedelta(days=2): 1}
    r = PR.period_profile(prof, day(0), day(0), "p").first()
    assert (r.p_n, r.p_mean) == (1000, 499.5) and r.p_std == pytest.approx(np.arange(1000).std(ddof=1))
    np.testing.assert_allclose(r.p_q, [250, 500, 750], atol=20)
    one = PR.period_profile(prof, day(2), day(9), "p").first()
    assert (one.p_n, one.p_std, list(one.p_q)) == (1, None, [7.0, 7.0, 7.0])
    assert PR.period_profile(prof, day(1), day(1), "p").collect() == []
    assert PR.compare(prof, (day(0), day(0)), (day(1), day(1))).collect() == []
    assert PR.daily_profiles(df.where("false"), ["x"]).collect() == []
    shifts = PR.compare(prof, (day(0), day(0)), (day(2), day(2))).first()
    assert shifts.mean_shift == pytest.approx((499.5 - 7) / 499.5) and shifts.drift_detected


def test_profiles_do_not_depend_on_partitions(spark):
    df = frame(spark, [float(k % 17) / 7 for k in range(400)])
    a, b = (PR.period_profile(PR.daily_profiles(x, ["x"]), day(0), day(399), "p").select("p_n", "p_mean", "p_std").first()
            for x in (df, df.repartition(9, F.col("x"))))
    assert a == b
