"""End-to-end training and prediction (T7, P1, P5) over the DataFrame operators.

The prepared, split training frame is evaluated once, into files of the shared
folder: its counts say whether there is anything to fit, and fit, scoring and
metrics start from it, so the bars are aggregated once per run. Only counts, the
metric rows (two per run) and the run summary come back to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dataset as D
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import models as MO
from ..operators import scoring as SC
from ..session import written
from ..sources.store import RunLog

# Names of the run parameters and metrics that readers of a run rely on.
RUN_PARAMS = ("ticker", "model_type", "target", "lookback_days", "test_size", "n_features", "n_train_samples", "n_test_samples")
RUN_METRICS = ("mae", "mse", "rmse", "r2")


def fit_partitions(bars: DataFrame, model_type: str, partitions: int | None) -> int | None:
    """Row layout of a tree fit: the session's shuffle parallelism unless given
    (logged with the run, since trees repeat only on the same layout). A linear
    fit sums moments and needs no layout."""
    if model_type == "linear_regression":
        return None
    return partitions or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))


ROWS_A_TASK = 20_000  # training rows that a task of a boosted fit takes at least, where there are so many


def fit_layout(ts: D.TrainingSet, model_type: str, partitions: int | None) -> int | None:
    """Partitions of the rows of a fit. Boosting runs a few hundred small jobs one
    after another, each with a task per partition, and draws nothing by partition:
    its rows are dealt by their number, up to the session's parallelism."""
    most = fit_partitions(ts.frame, model_type, partitions)
    if model_type != "xgboost" or partitions:
        return most
    rows = ts.frame.where("split = 'train'").count()
    return max(1, min(most, -(-rows // ROWS_A_TASK)))


def training_frame(bars: DataFrame, feature_names: list[str], target: str = "returns", lookback: int = 1,
                   test_size: float = 0.2, start: str | None = None, end: str | None = None,
                   tickers: Iterable[str] | None = None) -> D.TrainingSet:
    """The prepared rows with their split, evaluated once."""
    ts = D.prepare(bars, feature_names, target, lookback, start, end, tickers)
    return D.TrainingSet(written(D.split(ts.frame, test_size), "training"), ts.feature_cols, ts.target)


def fitted(ts: D.TrainingSet, model_type: str, model_params: dict | None = None, partitions: int | None = None):
    """(model, scored rows of both splits) of a training frame. No row is an error."""
    if ts.frame.isEmpty():
        raise ValueError("empty training set: no row has all features and the target (see dataset.dropped_features)")
    model = MO.fit(ts.frame.where(F.col("split") == "train"), model_type, ts.feature_cols,
                   partitions=fit_layout(ts, model_type, partitions), **(model_params or {}))
    return model, MO.score(model, ts.frame, ts.feature_cols)


def scored_splits(bars: DataFrame, model_type: str, feature_names: list[str], model_params: dict | None = None,
                  target: str = "returns", lookback: int = 1, test_size: float = 0.2,
                  start: str | None = None, end: str | None = None, tickers: Iterable[str] | None = None,
                  partitions: int | None = None):
    ts = training_frame(bars, feature_names, target, lookback, test_size, start, end, tickers)
    return ts, *fitted(ts, model_type, model_params, partitions)


def train(bars: DataFrame, model_type: str, feature_names: list[str], model_params: dict | None = None,
          target: str = "returns", lookback: int = 1, test_size: float = 0.2, start: str | None = None,
          end: str | None = None, tickers: Iterable[str] | None = None, run_name: str | None = None,
          runlog: RunLog | None = None, partitions: int | None = None) -> dict:
    """Prepare, split, fit, score both splits, metrics, log, summary.

    An empty training set raises ``ValueError`` before anything is fitted.
    """
    ts, model, scored = scored_splits(bars, model_type, feature_names, model_params, target, lookback,
                                      test_size, start, end, tickers, partitions)
    by_split = {r["split"]: r.asDict() for r in M.regression_metrics(scored, by=["split"]).collect()}
    nothing = {"n": 0, **dict.fromkeys(RUN_METRICS)}
    metrics = {f"{part}_{k}": float("nan") if v is None else float(v)
               for part in ("train", "test") for k, v in by_split.get(part, nothing).items() if k in RUN_METRICS}
    label = "all" if tickers is None else ",".join(tickers)
    name = run_name or f"{label}_{model_type}_{target}"
    counts = [int(by_split.get(part, nothing)["n"]) for part in ("train", "test")]
    params = dict(zip(RUN_PARAMS, (label, model_type, target, lookback, test_size, len(ts.feature_cols), *counts)))
    params["fit_partitions"] = fit_layout(ts, model_type, partitions)
    params.update(model_params or {})
    run_id = None
    if runlog is not None:
        run_id = runlog.new_run_id()
        runlog.log(run_id, name, params, metrics, model, ts.feature_cols)
    return {"run_id": run_id, "run_name": name, "ticker": label, "model_type": model_type,
            "train_metrics": {k: v for k, v in metrics.items() if k.startswith("train_")},
            "test_metrics": {k: v for k, v in metrics.items() if k.startswith("test_")},
            "feature_names": ts.feature_cols, "params": params}


def predict(bars: DataFrame, runlog: RunLog, run_id: str, tickers: Iterable[str] | None = None,
            feature_names: list[str] | None = None, start: str | None = None, end: str | None = None,
            warmup: str = "slice") -> DataFrame:
    """Score a stored model on its run's inputs (or the given ones), in order."""
    run = runlog.run(run_id)
    names = D.selection(feature_names or run["features"])
    feats = FE.compute_for_range(bars, tickers, start, end, names, warmup=warmup)
    scored = MO.score(runlog.load_model(run_id), feats, D.feature_columns(feats, names))
    return SC.dated_predictions(scored, int(run["params"]["lookback_days"]))


def predict_latest(bars: DataFrame, runlog: RunLog, run_id: str, n: int = 1,
                   tickers: Iterable[str] | None = None, feature_names: list[str] | None = None) -> DataFrame:
    """P5: last n predictions per ticker, with indicators warmed up on history."""
    preds = predict(bars, runlog, run_id, tickers, feature_names, warmup="history")
    return SC.latest(preds, n)


# ---- X7: a training job from a configuration mapping ------------------------------------------

# Keys of a job file. Switches of a service are known and have no effect here.
CONFIG_KEYS = ("model_type", "features", "model_params", "target", "lookback_days", "test_size",
               "start_date", "end_date", "tickers", "run_name", "validation_fraction", "validation_split", "early_stopping_rounds")
SERVICE_KEYS = ("use_cache", "registry", "verbose")
ALIASES = {"feature_names": "features", "type": "model_type",
           "params": "model_params", "ticker": "tickers"}
SECTIONS = ("model", "data", "training")


def flatten_config(config: dict) -> dict:
    """Flat job settings from nested sections or flat keys. Flat keys win over
    sections; unknown keys raise ``ValueError``."""
    flat: dict = {}
    unknown = []
    nested = [(k, v) for s in SECTIONS if isinstance(config.get(s), dict) for k, v in config[s].items()]
    plain = [(k, v) for k, v in config.items() if not (k in SECTIONS and isinstance(v, dict))]
    for key, value in nested + plain:
        key = ALIASES.get(key, key)
        if key in SERVICE_KEYS:
            continue
        if key not in CONFIG_KEYS:
            unknown.append(key)
        flat[key] = [value] if key == "tickers" and isinstance(value, str) else value
    if unknown:
        raise ValueError(f"unknown config keys: {sorted(unknown)}")
    return flat


def train_from_config(bars: DataFrame, config: dict, runlog: RunLog | None = None) -> dict:
    """Run :func:`train` from a mapping (e.g. a parsed YAML/JSON job file).

    ``validation_fraction`` asks for early stopping and is an error for models
    that cannot stop early; the ``validation_split`` and ``early_stopping_rounds``
    of a training section apply to boosted trees only.
    """
    job = flatten_config(config)
    if not job.get("model_type") or not job.get("features"):
        raise ValueError("config needs model type and features")
    params = dict(job.get("model_params") or {})
    share = job.get("validation_fraction")
    if share is None and job["model_type"] in ("xgboost", "lightgbm"):
        share = job.get("validation_split")
    if share:
        params["validation_fraction"] = share
        if job.get("early_stopping_rounds"):
            params["early_stopping_rounds"] = int(job["early_stopping_rounds"])
    settings = {"target": "target", "start": "start_date", "end": "end_date", "tickers": "tickers", "run_name": "run_name"}
    chosen = {arg: job[key] for arg, key in settings.items() if job.get(key) is not None}
    return train(bars, job["model_type"], list(job["features"]), params, lookback=int(job.get("lookback_days", 1)),
                 test_size=float(job.get("test_size", 0.2)), runlog=runlog, **chosen)
