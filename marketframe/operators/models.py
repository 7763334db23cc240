"""Regression models (M1-M6): registry of pyspark.ml estimators and per-ticker OLS.

Two ways to fit:

* pooled: one ``pyspark.ml`` Pipeline (VectorAssembler + estimator) over the
  rows of all selected tickers - MLlib distributes the fit;
* per ticker, linear only: with one or two inputs ONE grouped aggregation
  (means and co-variances of x and y per ticker, merged map-side) and a closed
  form; with more, triangular factors per partition that merge per ticker.
  No per-ticker driver loop, no per-ticker model objects.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import LeafwiseRegressor, patient_rounds

# ---- fixed values: model defaults and parameter names ---------------------------------
DEFAULTS = {
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "random_state": 42},
    "lightgbm": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "random_state": 42},
    "random_forest": {"n_estimators": 100, "max_depth": 10, "random_state": 42},
    "linear_regression": {},
}
# parameters each model type does not take (dropped before construction)
DROPPED = {
    "random_forest": ("learning_rate",),
    "linear_regression": ("learning_rate", "max_depth", "n_estimators"),
}
RENAME_TREES = {"max_depth": "maxDepth", "random_state": "seed"}
LEAFWISE_NAMES = {"num_leaves": "numLeaves", "max_bin": "maxBins", "min_data_in_leaf": "minRows", "lambda_l2": "ridge"}
# ------------------------------------------------------------------------------------------


def _gbt(**kw) -> GBTRegressor:
    p = {**DEFAULTS["xgboost"], **kw}
    return GBTRegressor(maxIter=int(p.pop("n_estimators")), maxDepth=int(p.pop("max_depth")),
                        stepSize=float(p.pop("learning_rate")), seed=int(p.pop("random_state")),
                        **_spark_names(p))


def _forest(**kw) -> RandomForestRegressor:
    p = {**DEFAULTS["random_forest"], **kw}
    return RandomForestRegressor(numTrees=int(p.pop("n_estimators")), maxDepth=int(p.pop("max_depth")),
                                 seed=int(p.pop("random_state")), featureSubsetStrategy="all",
                                 **_spark_names(p))


def _leafwise(**kw) -> LeafwiseRegressor:
    p = {**DEFAULTS["lightgbm"], **kw}
    p.pop("random_state")  # nothing is drawn
    return LeafwiseRegressor(maxIter=int(p.pop("n_estimators")), maxDepth=int(p.pop("max_depth")),
                             stepSize=float(p.pop("learning_rate")), **{LEAFWISE_NAMES.get(k, k): v for k, v in p.items()})


def _linear(**kw) -> LinearRegression:
    return LinearRegression(regParam=0.0, elasticNetParam=0.0, solver="normal", **_spark_names(kw))


def _spark_names(p: dict) -> dict:
    return {RENAME_TREES.get(k, k): v for k, v in p.items()}


UNKNOWN_MODEL = "Unknown model type: {}"   # fixed value: message that callers match


class ModelRegistry(dict):
    """Estimator factories by name (M5, M6). A factory gets the parameters that
    its model type takes; the others are left out."""

    def register(self, name: str, factory: Callable[..., object]) -> None:
        if name in self:
            warnings.warn(f"estimator factory of {name!r} replaced", stacklevel=2)
        self[name] = factory

    def create(self, model_type: str, **params):
        try:
            factory = self[model_type]
        except KeyError:
            raise ValueError(UNKNOWN_MODEL.format(model_type)) from None
        left_out = set(DROPPED.get(model_type, ()))
        return factory(**{name: value for name, value in params.items() if name not in left_out})

    def list_models(self) -> list[str]:
        return sorted(self)


MODELS = ModelRegistry()
MODELS.register("xgboost", _gbt)
MODELS.register("lightgbm", _leafwise)
MODELS.register("random_forest", _forest)
MODELS.register("linear_regression", _linear)


def estimator_pipeline(model_type: str, feature_cols: list[str], label: str = "target", **params) -> Pipeline:
    est = MODELS.create(model_type, **params)
    est = est.setFeaturesCol("features").setLabelCol(label).setPredictionCol("prediction")
    return Pipeline(stages=[VectorAssembler(inputCols=feature_cols, outputCol="features",
                                            handleInvalid="keep"), est])


def deterministic_input(df: DataFrame, partitions: int) -> DataFrame:
    """Tree fits repeat bit for bit only on a fixed row layout: hash-partition
    on (Ticker, Date) with a fixed count and sort inside partitions. The count
    is part of the model's parameters (the forest bootstraps per partition)."""
    keys = ("Ticker", "Date") if partitions > 1 else ()
    return df.repartition(partitions, *keys).sortWithinPartitions("Ticker", "Date")


def mark_validation(train: DataFrame, fraction: float, col: str = "is_validation") -> DataFrame:
    """Flag the chronologically last ``fraction`` of each ticker's training
    rows as the validation set (windowed count and row number, one pass)."""
    from pyspark.sql import Window
    n = F.count(F.lit(1)).over(Window.partitionBy("Ticker"))
    rn = F.row_number().over(Window.partitionBy("Ticker").orderBy("Date"))
    return train.withColumn(col, rn > F.floor(n * F.lit(1.0 - fraction)))


def fit(train: DataFrame, model_type: str, feature_cols: list[str], label: str = "target",
        partitions: int | None = None, validation_fraction: float | None = None,
        validation_tol: float = 0.01, early_stopping_rounds: int | None = None, **params) -> PipelineModel:
    """Fit the pipeline. With ``validation_fraction`` (boosted trees only) the
    last rows of each ticker's training span only measure (X6). With
    ``early_stopping_rounds`` the round with the smallest error on them is kept,
    and rounds end when it has not improved for so many; without it, depth-wise
    trees stop when the error improves by less than ``validation_tol``."""
    p = estimator_pipeline(model_type, feature_cols, label, **params)
    data, est = train, p.getStages()[-1]
    if validation_fraction:
        if not isinstance(est, (GBTRegressor, LeafwiseRegressor)):
            raise ValueError("validation_fraction applies to boosted-tree models")
        data = mark_validation(train, validation_fraction)
    if partitions is not None:
        data = deterministic_input(data, partitions)
    if validation_fraction and isinstance(est, LeafwiseRegressor):
        est.setParams(validationCol="is_validation", patience=int(early_stopping_rounds or 0))
    elif validation_fraction and early_stopping_rounds:
        return _fit_patient(p, data, early_stopping_rounds)
    elif validation_fraction:
        est.setParams(validationIndicatorCol="is_validation", validationTol=validation_tol)
    return p.fit(data)


def validation_errors(model: PipelineModel, rows: DataFrame) -> list[float]:
    """Squared error on ``rows`` after every round of a boosted model."""
    trees = model.stages[-1]
    return trees.evaluateEachIteration(model.stages[0].transform(rows), "squared")


def _fit_patient(p: Pipeline, data: DataFrame, patience: int) -> PipelineModel:
    """All rounds once, the error of each on the validation rows, and a model of
    the rounds to keep: rounds follow one another, so that is its beginning."""
    fits, measures = data.where("not is_validation"), data.where("is_validation")
    model = p.fit(fits)
    if measures.isEmpty():
        return model
    keep = patient_rounds(validation_errors(model, measures), patience)
    est = p.getStages()[-1]
    return model if keep >= est.getMaxIter() else p.copy({est.maxIter: keep}).fit(fits)


def score(model: PipelineModel, df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Predict every row; rows with a missing input get a null prediction."""
    out = model.transform(df).drop("features")
    complete = F.lit(True)
    for c in feature_cols:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(c)
    return out.withColumn("prediction", F.when(complete, F.col("prediction")))


# ---- per-ticker OLS by normal equations -------------------------------------------------------

HELD_FACTORS = 4096  # tickers whose factors a task holds before it emits them


def ols_factors(df: DataFrame, feature_cols: list[str], label: str = "target", by: str = "Ticker") -> DataFrame:
    """(by, n, r) per partition and ticker: the triangular factor of its rows
    [1, inputs, label]. Factors of parts, stacked and factored again, give that of
    all rows, so partitions of any size and order merge (tall-skinny QR), and
    nothing is squared: the digits that a condition number costs are lost
    once, not twice as in normal equations."""
    p = len(feature_cols)
    xs, y = [F.col(c).cast("double") for c in feature_cols], F.col(label).cast("double")
    ok = y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    rows = df.where(ok).select(F.col(by).alias("key"), *[x.alias(f"x{i}") for i, x in enumerate(xs)], y.alias("y"))

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()),
                 pa.array([r.ravel() for _, r in held.values()], pa.list_(pa.float64()))], names=[by, "n", "r"])
            held.clear()
            return out

        for b in batches:
            coded = b.column(0).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_pandas().to_numpy()
            m = np.column_stack([np.ones(b.num_rows), *(b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(p + 1))])
            code = np.where(np.isnan(code), len(names), code).astype(int) if b.column(0).null_count else code
            order = np.argsort(code, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if not len(at):
                    continue
                name = names[code[at[0]]] if code[at[0]] < len(names) else None
                n, r = held.get(name, (0, np.zeros((0, p + 2))))
                held[name] = (n + len(at), _triangle(np.vstack([r, m[at]])))
            if len(held) > HELD_FACTORS:
                yield emit()
        if held:
            yield emit()

    return rows.mapInArrow(factor, f"`{by}` string, n long, r array<double>")


def _triangle(m: np.ndarray) -> np.ndarray:
    """Square upper triangular factor (rows of zeros where m has fewer rows)."""
    r = np.linalg.qr(m, mode="r")
    return np.vstack([r, np.zeros((m.shape[1] - len(r), m.shape[1]))])


RANK_CUT = 1e-13  # smallest share of the largest singular value (inputs scaled to one length) that counts


def ols_solve(factors: DataFrame, p: int, by: str = "Ticker") -> DataFrame:
    """Coefficients per ticker: intercept + one slope per feature.

    The factor of all rows without its first row and column is that of the
    centred inputs and label. A system without full rank (collinear features,
    constant input) takes the solution of least length. Runs on the factors
    only: a few small matrices per ticker.
    """
    schema = f"`{by}` string, n long, intercept double, " + ", ".join(f"coef_{i} double" for i in range(p))

    def solve(group: pa.Table) -> pa.Table:
        r = _triangle(np.concatenate([np.array(x).reshape(-1, p + 2) for x in group["r"].to_pylist()]))
        inner, right = r[1:-1, 1:-1], r[1:-1, -1]
        size = np.linalg.norm(inner, axis=0)
        known = size > 0
        unit = np.where(known, size, 1.0)
        s = np.linalg.svd(inner / unit, compute_uv=False)
        if known.all() and s[-1] > RANK_CUT * s[0]:
            beta = np.linalg.solve(inner / unit, right) / unit
        else:
            beta = np.linalg.pinv(inner, rcond=RANK_CUT) @ right
        intercept = (r[0, -1] - r[0, 1:-1] @ beta) / r[0, 0]
        n = sum(group["n"].to_pylist())
        return pa.table([pa.array(group[by].to_pylist()[:1], pa.string()), pa.array([n], pa.int64()), pa.array([float(intercept)]),
                         *(pa.array([float(x)]) for x in beta)], names=[by, "n", "intercept", *(f"coef_{i}" for i in range(p))])

    return factors.groupBy(by).applyInArrow(solve, schema)


PINV_RCOND = 1e-15   # fixed value: relative cut-off of the pseudo-inverse (numpy's default)


def _closed_form(p: int, n: Column, my: Column, mx: list[Column], cxx: dict, cxy: list[Column]):
    """Intercept and slopes of OLS from moments, as Column expressions (p <= 2).

    Same answer as ``solve`` / ``pinv`` on the p x p covariance system: the
    inverse when the system is well conditioned, the pseudo-inverse (rank-1
    part, or zero) when it is not.
    """
    if p == 1:
        a = cxx[(0, 0)]
        b0 = F.when(a > 0, cxy[0] / a).otherwise(F.lit(0.0))
        return my - b0 * mx[0], [b0]
    a, b, c = cxx[(0, 0)], cxx[(0, 1)], cxx[(1, 1)]
    y0, y1 = cxy
    disc = F.sqrt(((a - c) / 2.0) * ((a - c) / 2.0) + b * b)
    lmax = (a + c) / 2.0 + disc                      # eigenvalues of the 2x2 covariance
    det = a * c - b * b
    lmin = F.when(lmax > 0, det / lmax)              # stable form of the small eigenvalue
    full_rank = lmin > lmax * PINV_RCOND             # numpy: solve, or pinv inverting both
    l2 = lmax * lmax
    # rank one: pseudo-inverse = M / lmax^2; rank zero: 0
    b0 = F.when(full_rank, (c * y0 - b * y1) / det).when(lmax > 0, (a * y0 + b * y1) / l2).otherwise(F.lit(0.0))
    b1 = F.when(full_rank, (a * y1 - b * y0) / det).when(lmax > 0, (b * y0 + c * y1) / l2).otherwise(F.lit(0.0))
    return my - (b0 * mx[0] + b1 * mx[1]), [b0, b1]


def _moment_exprs(xs, y, agg_over=None):
    """n, mean y, mean x_i, cov(x_i, x_j), cov(x_i, y) as aggregate Columns."""
    o = (lambda c: c.over(agg_over)) if agg_over is not None else (lambda c: c)
    p = len(xs)
    n = o(F.count(y))
    my = o(F.avg(y))
    mx = [o(F.avg(x)) for x in xs]
    cxx = {(i, j): o(F.covar_pop(xs[i], xs[j])) for i in range(p) for j in range(i, p)}
    cxy = [o(F.covar_pop(x, y)) for x in xs]
    return n, my, mx, cxx, cxy


def ols_fit(df: DataFrame, feature_cols: list[str], label: str = "target", by: str = "Ticker") -> DataFrame:
    """M1 per ticker: (Ticker, n, intercept, coef_0..coef_p-1).

    Up to two features one grouped aggregation of moments (partial aggregation
    map-side) and a solve that is a column expression; beyond it triangular
    factors per partition, merged per ticker.
    """
    p = len(feature_cols)
    if p > 2:
        return ols_solve(ols_factors(df, feature_cols, label, by), p, by)
    xs = [F.col(c).cast("double") for c in feature_cols]
    y = F.col(label).cast("double")
    ok = y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    n, my, mx, cxx, cxy = _moment_exprs(xs, y)
    names = ["n", "my"] + [f"mx_{i}" for i in range(p)] + [f"cxx_{i}_{j}" for (i, j) in cxx] + \
        [f"cxy_{i}" for i in range(p)]
    g = df.where(ok).groupBy(by).agg(*[e.alias(a) for e, a in zip([n, my, *mx, *cxx.values(), *cxy], names)])
    icpt, coefs = _closed_form(p, F.col("n"), F.col("my"), [F.col(f"mx_{i}") for i in range(p)],
                               {k: F.col(f"cxx_{k[0]}_{k[1]}") for k in cxx}, [F.col(f"cxy_{i}") for i in range(p)])
    return g.select(by, "n", icpt.alias("intercept"), *[c.alias(f"coef_{i}") for i, c in enumerate(coefs)])


def ols_fit_predict(df: DataFrame, feature_cols: list[str], fit_rows: Column, label: str = "target",
                    by: str = "Ticker") -> DataFrame:
    """Fit per ticker on the rows where ``fit_rows`` holds and predict every row.

    Up to two features this is one pass: the moments are window aggregates
    over the ticker partition (no join back, no second scan of the input),
    the solve a column expression. More features: grouped fit + join.
    Rows with a missing input get a null prediction.
    """
    p = len(feature_cols)
    xs = [F.col(c).cast("double") for c in feature_cols]
    if p > 2:
        co = ols_fit(df.where(fit_rows), feature_cols, label, by)
        return ols_predict(df, co, feature_cols, by)
    y = F.col(label).cast("double")
    ok = fit_rows & y.isNotNull()
    for x in xs:
        ok = ok & x.isNotNull()
    fx = [F.when(ok, x) for x in xs]
    fy = F.when(ok, y)
    from pyspark.sql import Window
    w = Window.partitionBy(by)
    n, my, mx, cxx, cxy = _moment_exprs(fx, fy, agg_over=w)
    icpt, coefs = _closed_form(p, n, my, mx, cxx, cxy)
    pred = icpt
    for c, x in zip(coefs, xs):
        pred = pred + c * x
    return df.withColumn("prediction", F.when(n > 0, pred))


def ols_predict(df: DataFrame, coefs: DataFrame, feature_cols: list[str], by: str = "Ticker") -> DataFrame:
    """prediction = intercept + sum coef_i * x_i (null if any input is null).

    ``coefs`` has one row per ticker; it is joined on the ticker key (Spark
    broadcasts it only under the size threshold).
    """
    pred = F.col("intercept")
    for i, c in enumerate(feature_cols):
        pred = pred + F.col(f"coef_{i}") * F.col(c)
    cols = [F.col(c) for c in ["intercept", *[f"coef_{i}" for i in range(len(feature_cols))]]]
    return df.join(coefs.select(by, *cols), by, "left").withColumn("prediction", pred) \
        .drop("intercept", *[f"coef_{i}" for i in range(len(feature_cols))])
