"""Property: the blocked window scan equals the row-by-row recurrence."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketframe.functions.scan import Recurrence, block_range, linear_scan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(q=st.floats(min_value=0.3, max_value=0.97),
       lengths=st.lists(st.integers(min_value=1, max_value=900), min_size=1, max_size=3),
       seed=st.integers(min_value=0, max_value=10_000),
       scale=st.sampled_from([1.0, 1e-3, 1e6]))
def test_scan_matches_loop(spark, q, lengths, seed, scale):
    rng = np.random.default_rng(seed)
    rows, expect = [], {}
    for t, n in enumerate(lengths):
        x = rng.normal(size=n) * scale
        x[rng.random(n) < 0.2] = 0.0          # runs of zeros: the carry must survive them
        y, ys = 0.0, []
        for v in x:
            y = v + q * y
            ys.append(y)
        expect[f"T{t}"] = np.array(ys)
        rows += [(f"T{t}", i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "Ticker string, _i long, x double")
    size = block_range(q)[1] // 8 + 1 + seed % 50       # several blocks
    out = linear_scan(df, [Recurrence("y", F.col("x"), q)], block=size).toPandas()
    for t, g in out.groupby("Ticker"):
        got = g.sort_values("_i")["y"].to_numpy()
        tol = 1e-12 * scale * 10 / (1 - q)
        np.testing.assert_allclose(got, expect[t], rtol=1e-10, atol=tol)


@pytest.mark.parametrize("block", [1, 2, 7, 30, None])
def test_any_block_size_on_a_collapsing_series(spark, block):
    """Falls by 18 orders of magnitude, again and again, whatever the blocks."""
    q, n = 13 / 14, 240
    x = [1e9 if i < 30 else 1e-9 if i < 200 else 1e-30 for i in range(n)]
    y, want = 0.0, []
    for v in x:
        y = v + q * y
        want.append(y)
    df = spark.createDataFrame([("T", i, v) for i, v in enumerate(x)], "Ticker string, _i long, x double")
    got = linear_scan(df, [Recurrence("y", F.col("x"), q)], block=block).orderBy("_i").toPandas()["y"].to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-11)


def test_older_blocks_are_not_dropped(spark):
    """With blocks of one row a value crosses every block in between."""
    q = 0.9
    df = spark.createDataFrame([("T", i, 1.0 if i == 0 else 0.0) for i in range(60)], "Ticker string, _i long, x double")
    got = linear_scan(df, [Recurrence("y", F.col("x"), q)], block=1).orderBy("_i").toPandas()["y"].to_numpy()
    np.testing.assert_allclose(got, q ** np.arange(60), rtol=1e-12)
