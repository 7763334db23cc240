"""Leaf-wise boosting against a plain learner on arrays, and stopping by patience."""

import heapq

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from marketframe.operators import boosting as B
from marketframe.operators import models as MO
from marketframe.plans import training as TR
from market_fixtures import SF001
from marketframe.sources.adapters import bars_from_orders


def plain(x, y, rounds, leaves, depth, step, min_rows, edges):
    """Best leaf first, one leaf at a time."""
    bins = np.stack([np.searchsorted(e, x[:, i], side="left") if len(e) else np.zeros(len(x), int) for i, e in enumerate(edges)], 1)
    f = np.full(len(y), y.mean())

    def best(at, r):
        found = None
        for i in range(x.shape[1]):
            for b in np.unique(bins[at, i]):
                low = at & (bins[:, i] <= b)
                high = at & ~low
                if low.sum() >= min_rows and high.sum() >= min_rows:
                    gain = r[low].sum() ** 2 / low.sum() + r[high].sum() ** 2 / high.sum() - r[at].sum() ** 2 / at.sum()
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, low, high)
        return found

    for _ in range(rounds):
        r = y - f
        everything = np.ones(len(y), bool)
        done, queue, tick = [], [], 0

        def offer(at, level):
            nonlocal tick
            cut = best(at, r) if level < depth else None
            tick += 1
            if cut is None:
                done.append(at)
            else:
                heapq.heappush(queue, (-cut[0], tick, at, cut, level))

        offer(everything, 0)
        while queue and len(done) + len(queue) < leaves:
            _, _, at, (_, low, high), level = heapq.heappop(queue)
            offer(low, level + 1)
            offer(high, level + 1)
        for at in done + [q[2] for q in queue]:
            f = f + np.where(at, step * r[at].mean(), 0)
    return f


def frame(spark, x, y, **more):
    rows = [(i, *map(float, v), float(t), *(c[i] for c in more.values())) for i, (v, t) in enumerate(zip(x, y))]
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, ", ".join(["id long", *(f"{n} double" for n in names), "target double", *(f"{k} boolean" for k in more)]))
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)


def predicted(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("id").collect()])


@pytest.mark.parametrize("leaves, depth", [(2, 1), (5, 6), (8, 3), (31, 2)])
def test_trees_equal_a_plain_best_first_learner(spark, leaves, depth):
    rng = np.random.default_rng(leaves)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * np.abs(x[:, 1]) + 0.3 * rng.normal(size=400)
    df = frame(spark, x, y)
    est = B.LeafwiseRegressor(maxIter=3, numLeaves=leaves, maxDepth=depth, stepSize=0.4, maxBins=8, minRows=15, binning="width")
    model = est.setLabelCol("target").fit(df)
    want = plain(x, y, 3, leaves, depth, 0.4, 15, model.parts["edges"])
    np.testing.assert_allclose(predicted(model, df), want, rtol=1e-9, atol=1e-9)


def test_row_order_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 2)), rng.normal(size=300) * 1e6
    df = frame(spark, x, y)
    est = B.LeafwiseRegressor(maxIter=2, numLeaves=6, minRows=10).setLabelCol("target")
    assert est.fit(df).parts == est.fit(df.repartition(7, "id").sortWithinPartitions(F.desc("id"))).parts


def test_missing_values_go_left_and_models_are_stored(spark, tmp):
    x = np.array([[np.nan if i % 5 == 0 else float(i), 1.0] for i in range(100)])
    y = np.array([0.0 if i % 5 == 0 or i < 50 else 1.0 for i in range(100)])
    df = frame(spark, x, y)
    model = B.LeafwiseRegressor(maxIter=1, numLeaves=2, stepSize=1.0, maxBins=100).setLabelCol("target").fit(df)
    np.testing.assert_allclose(predicted(model, df), y, atol=0.02)
    PipelineModel([model]).write().overwrite().save(f"{tmp}/m")
    again = PipelineModel.load(f"{tmp}/m")
    np.testing.assert_allclose(predicted(again, df), predicted(model, df))


def test_degenerate_inputs(spark):
    x, y = np.ones((30, 1)), np.arange(30.0)
    df = frame(spark, x, y)
    model = B.LeafwiseRegressor(maxIter=2, numLeaves=4).setLabelCol("target").fit(df)
    np.testing.assert_allclose(predicted(model, df), 14.5)
    with pytest.raises(ValueError, match="no rows"):
        B.LeafwiseRegressor().setLabelCol("target").fit(df.where("false"))


def test_patience_keeps_the_best_round(spark):
    """Labels of the measuring rows are turned round, so the error soon grows."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    y = x[:, 0] + 0.1 * rng.normal(size=300)
    flag = [bool(i % 4 == 0) for i in range(300)]
    y[::4] = 0.35 * y[::4]
    df = frame(spark, x, y, is_validation=flag)
    est = B.LeafwiseRegressor(maxIter=25, numLeaves=4, stepSize=0.3, validationCol="is_validation", patience=3).setLabelCol("target")
    model = est.fit(df)
    errors = model.parts["errors"]
    assert model.rounds == int(np.argmin(errors)) + 1 and len(errors) == model.rounds + 3 < 25
    m = df.where("is_validation").toPandas()
    p = model.transform(df.where("is_validation")).toPandas().prediction
    assert np.mean((m.target - p) ** 2) == pytest.approx(min(errors))


def test_patient_rounds():
    assert B.patient_rounds([5, 4, 3, 3, 4, 1], 2) == 3
    assert B.patient_rounds([5, 4, 3, 3, 4, 1], 0) == 6
    assert B.patient_rounds([1.0], 3) == 1


def test_depth_wise_trees_keep_the_argmin_too(spark):
    """The kept model is the beginning of the full one, up to the smallest error."""
    b = bars_from_orders(spark, SF001)
    ts = TR.training_frame(b, ["sma_20", "rsi_14"])
    train = ts.frame.where("split = 'train'")
    full = MO.fit(train.where("true"), "xgboost", ts.feature_cols, n_estimators=6, max_depth=3, validation_fraction=None)
    kept = MO.fit(train, "xgboost", ts.feature_cols, partitions=4, n_estimators=6, max_depth=3, validation_fraction=0.2, early_stopping_rounds=2)
    marked = MO.deterministic_input(MO.mark_validation(train, 0.2), 4)
    again = MO.fit(marked.where("not is_validation"), "xgboost", ts.feature_cols, n_estimators=6, max_depth=3)
    errors = MO.validation_errors(again, marked.where("is_validation"))
    assert kept.stages[-1].getNumTrees == B.patient_rounds(errors, 2) <= full.stages[-1].getNumTrees


def test_lightgbm_is_its_own_learner():
    est = MO.MODELS.create("lightgbm", num_leaves=7, n_estimators=5)
    assert isinstance(est, B.LeafwiseRegressor) and est.getOrDefault("numLeaves") == 7
