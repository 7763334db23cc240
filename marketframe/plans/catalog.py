"""Named queries over the test tables, each with its DuckDB oracle statement.

Every query reads the given tables (or bars Spark derives from them) in
full; parameters such as date ranges or ticker lists are part of the
operator being exercised, not a way to make the check cheaper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import by_ticker
from ..operators import bars as B
from ..operators.features import DEFAULT_BUILDERS, compute_features
from ..session import scratch
from ..sources.adapters import bars_from_orders
from . import sqltext as S
from .present import shown

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_orders(spark, sf_dir)


PRICE_COLS = ("Open", "High", "Low", "Close")


def _bar_cols_spark(df: DataFrame) -> DataFrame:
    return df.select("Ticker", "Date", *[F.round(F.col(c) / 100.0, 2).alias(c) for c in PRICE_COLS], "Volume")


BAR_COLS_SQL = '"Ticker", "Date", ' + ", ".join(f'round("{c}" / 100, 2) AS "{c}"' for c in PRICE_COLS) + ', "Volume"'
WITH_BARS = "WITH " + S.BARS_ORDERS + "\n"

# ---- S1 / S7 / S8 / S9 / S10 / A1 / A4 -------------------------------------------------


@query("bars_source", WITH_BARS + f"SELECT {BAR_COLS_SQL} FROM bars")
def bars_source(spark, sf_dir):
    """Bars of a registered source (all tickers, open range)."""
    return _bar_cols_spark(RD.fetch_bars(spark, "orders", sf_dir))


SCAN_TICKERS = ("1-URGENT", "5-LOW")
SCAN_START, SCAN_END = "1996-03-01", "1997-02-28"


@query("bars_scan", WITH_BARS + f"SELECT {BAR_COLS_SQL} FROM bars WHERE \"Ticker\" IN ('1-URGENT', '5-LOW') "
       f"AND \"Date\" >= DATE '{SCAN_START}' AND \"Date\" <= DATE '{SCAN_END}'")
def bars_scan(spark, sf_dir):
    return _bar_cols_spark(B.scan(bars(spark, sf_dir), SCAN_TICKERS, SCAN_START, SCAN_END))


@query("latest_date", WITH_BARS + 'SELECT "Ticker", max("Date") AS latest_date FROM bars GROUP BY 1')
def latest_date(spark, sf_dir):
    return B.latest_date(bars(spark, sf_dir))


@query("tickers", WITH_BARS + 'SELECT DISTINCT "Ticker" FROM bars')
def tickers(spark, sf_dir):
    return B.tickers(bars(spark, sf_dir))


LATEST_N = 5


@query("latest_bars", WITH_BARS + f"""SELECT {BAR_COLS_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) AS rk FROM bars) WHERE rk <= {LATEST_N}""")
def latest_bars(spark, sf_dir):
    return _bar_cols_spark(B.latest_bars(bars(spark, sf_dir), LATEST_N))


@query("bar_summary", WITH_BARS + """SELECT "Ticker", round(avg("Close") / 100, 4) AS mean_close,
  round(max("Close") / 100, 2) AS max_close, round(min("Close") / 100, 2) AS min_close,
  CAST(sum("Volume") AS BIGINT) AS total_volume FROM bars GROUP BY 1""")
def bar_summary(spark, sf_dir):
    s = B.summary(bars(spark, sf_dir))
    return s.select("Ticker", F.round(F.col("mean_close") / 100.0, 4).alias("mean_close"),
                    F.round(F.col("max_close") / 100.0, 2).alias("max_close"),
                    F.round(F.col("min_close") / 100.0, 2).alias("min_close"), "total_volume")


@query("bar_counts", WITH_BARS + """SELECT "Ticker", count(*) AS n_bars, min("Date") AS first_date,
  max("Date") AS last_date FROM bars GROUP BY 1""")
def bar_counts(spark, sf_dir):
    return B.counts(bars(spark, sf_dir))


# ---- F1-F21: one query per indicator ------------------------------------------------------

def _feature_query(name: str) -> Query:
    def run(spark, sf_dir):
        f = compute_features(bars(spark, sf_dir), [name])
        return f.select("Ticker", "Date", shown(name, F.col(name)))
    run.__name__ = f"feat_{name}"
    return run


for _name in DEFAULT_BUILDERS:
    query(f"feat_{_name}", S.feature_sql(_name))(_feature_query(_name))


# ---- F0a-F0f, X2-X4: feature engine ---------------------------------------------------------------

from ..operators import features as FE  # noqa: E402
from ..functions import indicators as IND  # noqa: E402


def _shown_all(df: DataFrame, names: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select("Ticker", "Date", *extra, *[shown(n, F.col(n)) for n in names])


def _features_oracle(names: list[str], bars_where: str | None = None, out_where: str | None = None) -> str:
    prefix, _ = S.features_sql(names, bars_where)
    where = f" WHERE {out_where}" if out_where else ""
    return prefix + f'SELECT feat."Ticker", feat."Date", {S.shown_list(names)} FROM feat{where}'


ALL = list(DEFAULT_BUILDERS)


@query("features_default", _features_oracle(FE.DEFAULT_FEATURES))
def features_default(spark, sf_dir):
    return _shown_all(compute_features(bars(spark, sf_dir), FE.DEFAULT_FEATURES), FE.DEFAULT_FEATURES)


@query("features_all", _features_oracle(ALL))
def features_all(spark, sf_dir):
    return _shown_all(compute_features(bars(spark, sf_dir)), ALL)


RANGE_START, RANGE_END = "1997-01-01", "1998-12-31"
RANGE_TICKERS = ("1-URGENT", "2-HIGH", "3-MEDIUM")
_tick_sql = ", ".join(f"'{t}'" for t in RANGE_TICKERS)


@query("features_range_slice", _features_oracle(
    FE.DEFAULT_FEATURES,
    bars_where=f"\"Ticker\" IN ({_tick_sql}) AND \"Date\" >= DATE '{RANGE_START}' AND \"Date\" <= DATE '{RANGE_END}'"))
def features_range_slice(spark, sf_dir):
    f = FE.compute_for_range(bars(spark, sf_dir), RANGE_TICKERS, RANGE_START, RANGE_END,
                             FE.DEFAULT_FEATURES, warmup="slice")
    return _shown_all(f, FE.DEFAULT_FEATURES)


@query("features_range_history", _features_oracle(
    FE.DEFAULT_FEATURES, bars_where=f"\"Ticker\" IN ({_tick_sql}) AND \"Date\" <= DATE '{RANGE_END}'",
    out_where=f"feat.\"Date\" >= DATE '{RANGE_START}'"))
def features_range_history(spark, sf_dir):
    f = FE.compute_for_range(bars(spark, sf_dir), RANGE_TICKERS, RANGE_START, RANGE_END,
                             FE.DEFAULT_FEATURES, warmup="history")
    return _shown_all(f, FE.DEFAULT_FEATURES)


def _bbands(ctx):
    """Multi-output feature: one builder, three columns."""
    return {"upper": IND.bb_upper(20, 2.0)(ctx), "middle": IND.bb_middle(20, 2.0)(ctx),
            "lower": IND.bb_lower(20, 2.0)(ctx)}


MULTI_COLS = ["bbands_upper", "bbands_middle", "bbands_lower"]
S.PRICE_LIKE.update(MULTI_COLS)


@query("features_multi", S.with_bars() + 'SELECT "Ticker", "Date", '
       + ", ".join([S.shown("bbands_upper", S.PLAIN["bb_upper"]), S.shown("bbands_middle", S.PLAIN["bb_middle"]),
                    S.shown("bbands_lower", S.PLAIN["bb_lower"])]) + " FROM b")
def features_multi(spark, sf_dir):
    reg = FE.DEFAULT_REGISTRY.child()
    reg.register("bbands", _bbands, {"length": 20, "std": 2.0})
    return _shown_all(compute_features(bars(spark, sf_dir), ["bbands"], registry=reg), MULTI_COLS)


# custom features: a column expression, a parametrised built-in, a recursive built-in
CUSTOM = ["typical_price", "sma_7", "ema_9"]
S.PRICE_LIKE.update(CUSTOM)


def custom_registry():
    reg = FE.get_registry().child()
    reg.register("typical_price", lambda ctx: (ctx.c("High") + ctx.c("Low") + ctx.c("Close")) / 3.0)
    reg.register("sma_7", IND.sma(7), {"length": 7})
    reg.register("ema_9", IND.ema(9), {"length": 9})
    return reg


@query("feature_custom", S.with_bars(S.ema_cte("e9", 9)) + 'SELECT b."Ticker", b."Date", '
       + S.shown("typical_price", '(b."High" + b."Low" + b."Close") / 3.0') + ", "
       + S.shown("sma_7", 'CASE WHEN b.i >= 6 THEN avg(b."Close") OVER (PARTITION BY b."Ticker" ORDER BY b."Date" '
                 'ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END') + ", "
       + S.shown("ema_9", "e9.y") + ' FROM b LEFT JOIN e9 ON e9."Ticker" = b."Ticker" AND e9.i = b.i')
def feature_custom(spark, sf_dir):
    return _shown_all(compute_features(bars(spark, sf_dir), CUSTOM, registry=custom_registry()), CUSTOM)


def _rolling_median_5(pdf):
    """Tier 3 example: an arbitrary pandas series function (per ticker)."""
    return pdf["Close"].rolling(5).median()


S.PRICE_LIKE.add("median_5")


@query("feature_custom_pandas", S.with_bars() + 'SELECT "Ticker", "Date", '
       + S.shown("median_5", S.guard(4, f'median("Close") OVER {S.trail(5)}')) + " FROM b")
def feature_custom_pandas(spark, sf_dir):
    reg = FE.get_registry().child()
    reg.register("median_5", FE.SeriesFeature(_rolling_median_5))
    return _shown_all(compute_features(bars(spark, sf_dir), ["median_5"], registry=reg), ["median_5"])


def _params_json(name: str) -> str:
    """A feature's registered parameters as canonical JSON text."""
    import json
    return json.dumps(FE.get_registry().get_config(name) or {}, sort_keys=True)


def _catalog_sql() -> str:
    prefix, _ = S.features_sql(ALL)
    groups = {n: g for g, ns in FE.FEATURE_GROUPS.items() for n in ns}
    vals = ", ".join(f"('{n}', {k}, '{groups.get(n, '')}', '{_params_json(n)}')" for k, n in enumerate(ALL))
    unp = ", ".join(ALL)
    return prefix + f"""SELECT r.name, r.position, r.feature_group, r.params,
  CAST(coalesce(c.n_values, 0) AS BIGINT) AS n_values, c.first_defined
FROM (VALUES {vals}) AS r(name, position, feature_group, params)
LEFT JOIN (SELECT feature, count(*) AS n_values, min(i) AS first_defined
           FROM (UNPIVOT (SELECT i, {unp} FROM feat) ON {unp} INTO NAME feature VALUE value)
           GROUP BY feature) c ON c.feature = r.name"""


@query("feature_catalog", _catalog_sql())
def feature_catalog(spark, sf_dir):
    """F0e: registered features with their group, position and parameters,
    plus coverage over the bars: number of defined values and the first
    defined row."""
    names = FE.get_registry().list_features()
    groups = {n: g for g, ns in FE.FEATURE_GROUPS.items() for n in ns}
    reg = spark.createDataFrame([(n, k, groups.get(n, ""), _params_json(n)) for k, n in enumerate(names)],
                                "name string, position int, feature_group string, params string")
    f = compute_features(bars(spark, sf_dir), names, keep=())
    f = f.select("Ticker", "Date", F.row_number().over(by_ticker()).alias("_rn"), *names)
    long = f.unpivot(["Ticker", "Date", "_rn"], names, "feature", "value").where(F.col("value").isNotNull())
    cov = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_values"),
                                      (F.min("_rn") - 1).alias("first_defined"))
    return reg.join(cov, reg.name == cov.feature, "left").select(
        "name", "position", "feature_group", "params",
        F.coalesce("n_values", F.lit(0)).cast("bigint").alias("n_values"),
        F.col("first_defined").cast("bigint").alias("first_defined"))


LINE_PRICE = "l.l_extendedprice / l.l_quantity"
LINE_KEY = f"(l.l_orderkey, l.l_linenumber, {LINE_PRICE})"
BARS_SUPPLIERS = f"""bars AS (
  SELECT CAST(l.l_shipdate AS DATE) AS "Date", 'S' || l.l_suppkey || '/' || CAST(round(l.l_discount * 100) AS INTEGER) AS "Ticker",
         arg_min({LINE_PRICE}, {LINE_KEY}) AS "Open", max({LINE_PRICE}) AS "High", min({LINE_PRICE}) AS "Low",
         arg_max({LINE_PRICE}, {LINE_KEY}) AS "Close", CAST(sum(l.l_quantity) AS BIGINT) AS "Volume"
  FROM lineitem l GROUP BY 1, 2)"""
MR_NAMES = ["sma_20", "returns"]


def _min_rows_sql() -> str:
    prefix, _ = S.features_sql(MR_NAMES, bars=BARS_SUPPLIERS)
    return prefix + 'SELECT feat."Ticker", feat."Date", ' + ", ".join(f"round(feat.{n}, 4) AS {n}" for n in MR_NAMES) + f""" FROM feat
WHERE feat."Ticker" IN (SELECT "Ticker" FROM bars GROUP BY 1 HAVING count(*) >= {FE.MIN_ROWS})"""


@query("features_min_rows", _min_rows_sql())
def features_min_rows(spark, sf_dir):
    """Only tickers with enough bars (supplier series: some are too short)."""
    from ..sources.adapters import bars_from_suppliers
    f = FE.min_rows(compute_features(bars_from_suppliers(spark, sf_dir), MR_NAMES), FE.MIN_ROWS)
    return f.select("Ticker", "Date", *[F.round(n, 4).alias(n) for n in MR_NAMES])


DROP_NAMES = ["sma_50", "sma_5", "returns"]


def _dropped_sql() -> str:
    prefix, _ = S.features_sql(DROP_NAMES, bars=BARS_SUPPLIERS)
    union = " UNION ALL ".join(f"""SELECT "Ticker", '{n}' AS feature, count(*) AS rows FROM feat GROUP BY 1 HAVING count({n}) = 0""" for n in DROP_NAMES)
    return prefix + f"SELECT \"Ticker\", feature, 'series shorter than the warm-up' AS reason, rows FROM ({union})"


@query("training_dropped", _dropped_sql())
def training_dropped(spark, sf_dir):
    """T4/T5: indicators without any value for a ticker, with its number of bars."""
    from ..operators import dataset as DS
    from ..sources.adapters import bars_from_suppliers
    return DS.dropped_features(bars_from_suppliers(spark, sf_dir), DROP_NAMES)


FILL_NAMES = ["sma_50", "returns", "volatility_20"]
_W = 'PARTITION BY "Ticker" ORDER BY "Date"'
_FILL_SQL = {
    "forward": lambda c: f"last_value(feat.{c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "backward": lambda c: f"first_value(feat.{c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "zero": lambda c: f"coalesce(feat.{c}, 0)",
    "mean": lambda c: f'coalesce(feat.{c}, avg(feat.{c}) OVER (PARTITION BY "Ticker"))',
}


def _fill_query(method: str):
    def run(spark, sf_dir):
        f = compute_features(bars(spark, sf_dir), FILL_NAMES)
        return _shown_all(FE.fill_missing(f, method), FILL_NAMES)
    run.__name__ = f"fill_{method}"
    prefix, _ = S.features_sql(FILL_NAMES)
    sql = prefix + 'SELECT "Ticker", "Date", ' + ", ".join(S.shown(c, _FILL_SQL[method](c)) for c in FILL_NAMES) \
        + " FROM feat"
    return run, sql


for _m in FE.FILL_METHODS:
    _fn, _sql = _fill_query(_m)
    query(f"fill_{_m}", _sql)(_fn)


# ---- T1-T6, J1-J2: training sets ---------------------------------------------------------------

from ..operators import dataset as DS  # noqa: E402
from ..operators import metrics as MET  # noqa: E402
from ..operators import models as MOD  # noqa: E402
from ..operators import scoring as SCO  # noqa: E402

S.DIGITS.update({"target": 8, "Close_c": 2})


def _feat_prefix(names, keep=("Close",)):
    prefix, _ = S.features_sql(names, keep=keep)
    return prefix


_WT = 'PARTITION BY "Ticker" ORDER BY "Date"'


@query("target_returns", _feat_prefix(["sma_20", "returns"]) + f"""SELECT "Ticker", "Date",
  {S.shown("sma_20", "sma_20")}, {S.shown("returns", "returns")},
  {S.shown("target", f"lead(returns, 1) OVER ({_WT})")} FROM feat""")
def target_returns(spark, sf_dir):
    """target = the returns feature one bar ahead."""
    f = compute_features(bars(spark, sf_dir), ["sma_20", "returns"])
    t = DS.add_target(f, "returns", 1)
    return _shown_all(t, ["sma_20", "returns", "target"])


@query("target_returns_derived", _feat_prefix(["sma_20", "rsi_14"]) + f"""SELECT "Ticker", "Date",
  {S.shown("sma_20", "sma_20")}, {S.shown("rsi_14", "rsi_14")}, round("Close" / 100, 2) AS "Close",
  {S.shown("returns", "r")}, {S.shown("target", f"lead(r, 1) OVER ({_WT})")}
FROM (SELECT *, "Close" / NULLIF(lag("Close") OVER ({_WT}), 0) - 1 AS r FROM feat)""")
def target_returns_derived(spark, sf_dir):
    """Returns not requested -> derived from the carried Close."""
    f = compute_features(bars(spark, sf_dir), ["sma_20", "rsi_14"], keep=["Close"])
    t = DS.add_target(f, "returns", 1)
    return _shown_all(t, ["sma_20", "rsi_14", "returns", "target"],
                      extra=(F.round(F.col("Close") / 100.0, 2).alias("Close"),))


FWD_K = 5


@query("target_forward_return", _feat_prefix(["sma_20"]) + f"""SELECT "Ticker", "Date",
  {S.shown("sma_20", "sma_20")}, round("Close" / 100, 2) AS "Close",
  {S.shown("target", f'lead("Close", {FWD_K}) OVER ({_WT}) / NULLIF("Close", 0) - 1')} FROM feat""")
def target_forward_return(spark, sf_dir):
    """Price target -> forward k-bar return."""
    f = compute_features(bars(spark, sf_dir), ["sma_20"], keep=["Close"])
    t = DS.add_target(f, "Close", FWD_K)
    return _shown_all(t, ["sma_20", "target"], extra=(F.round(F.col("Close") / 100.0, 2).alias("Close"),))


TRAIN_NAMES = ["sma_20", "rsi_14", "returns", "volume_ratio"]


def _training_sql(names, tail: str) -> str:
    """Training rows: features + target = lead(returns), rows with any null dropped."""
    prefix = _feat_prefix(names)
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in [*names, "target", '"Close"'])
    return prefix + f"""tr AS (SELECT * FROM (SELECT *, lead(returns, 1) OVER ({_WT}) AS target FROM feat)
       WHERE {not_null})
{tail}"""


@query("training_rows", _training_sql(TRAIN_NAMES, f"""SELECT "Ticker", "Date", {", ".join(S.shown(n, n) for n in TRAIN_NAMES)},
  {S.shown("target", "target")} FROM tr""").replace("WITH RECURSIVE", "WITH RECURSIVE", 1).replace("\ntr AS", ",\ntr AS"))
def training_rows(spark, sf_dir):
    """T4/T5: null rows dropped after the lead; model inputs exclude the target's name."""
    ts = DS.prepare(bars(spark, sf_dir), TRAIN_NAMES, "returns", 1)
    return _shown_all(ts.frame, [*TRAIN_NAMES, "target"])


TEST_SIZE = 0.2


@query("train_test_split", _training_sql(TRAIN_NAMES, f"""SELECT "Ticker", "Date", {S.shown("target", "target")},
  CASE WHEN row_number() OVER ({_WT}) <= floor(count(*) OVER (PARTITION BY "Ticker") * CAST(1 - {TEST_SIZE} AS DOUBLE))
       THEN 'train' ELSE 'test' END AS split FROM tr""").replace("\ntr AS", ",\ntr AS"))
def train_test_split(spark, sf_dir):
    """Chronological per-ticker split after the null drop."""
    ts = DS.prepare(bars(spark, sf_dir), TRAIN_NAMES, "returns", 1)
    s = DS.split(ts.frame, TEST_SIZE)
    return s.select("Ticker", "Date", shown("target", F.col("target")), "split")


@query("train_join_close", WITH_BARS.replace("WITH ", "WITH RECURSIVE ", 1).rstrip("\n") + ",\n"
       + _feat_prefix(["sma_20"], keep=()).replace("WITH RECURSIVE ", "", 1).replace(S.BARS_ORDERS + ",\n", "", 1)
       + f"""SELECT f."Ticker", f."Date", {S.shown("sma_20", "f.sma_20")}, round(b2."Close" / 100, 2) AS "Close"
FROM feat f JOIN bars b2 ON b2."Ticker" = f."Ticker" AND b2."Date" = f."Date\"""")
def train_join_close(spark, sf_dir):
    """Features joined to Close on (Ticker, Date)."""
    bs = bars(spark, sf_dir)
    j = DS.join_price(compute_features(bs, ["sma_20"]), bs, "Close")
    return _shown_all(j, ["sma_20"], extra=(F.round(F.col("Close") / 100.0, 2).alias("Close"),))


@query("train_join_target", _feat_prefix(["sma_20"], keep=()) + f"""SELECT f."Ticker", f."Date", {S.shown("sma_20", "f.sma_20")},
  round(b2."High" / 100, 2) AS "High",
  {S.shown("target", f'lead(b2."High", 1) OVER (PARTITION BY f."Ticker" ORDER BY f."Date") / NULLIF(b2."High", 0) - 1')}
FROM feat f JOIN bars b2 ON b2."Ticker" = f."Ticker" AND b2."Date" = f."Date\"""")
def train_join_target(spark, sf_dir):
    """Features joined to a target price column, forward return on it."""
    bs = bars(spark, sf_dir)
    j = DS.add_target(DS.join_price(compute_features(bs, ["sma_20"]), bs, "High"), "High", 1)
    return _shown_all(j, ["sma_20", "target"], extra=(F.round(F.col("High") / 100.0, 2).alias("High"),))


# ---- A8, M1, P1-P5, S15: per-ticker linear model ------------------------------------------------------

from ..sources import store as ST  # noqa: E402
from . import training as TR  # noqa: E402

OLS_X = "high_low_ratio"


def _ols_frame(spark, sf_dir):
    ts = DS.prepare(bars(spark, sf_dir), [OLS_X], "returns", 1)
    return DS.split(ts.frame, TEST_SIZE), ts.feature_cols


def _ols_sql_prefix() -> str:
    prefix = _feat_prefix([OLS_X])
    return prefix + f""",
tr0 AS (SELECT * FROM (SELECT *, "Close" / NULLIF(lag("Close") OVER ({_WT}), 0) - 1 AS returns FROM feat)),
tr1 AS (SELECT * FROM (SELECT *, lead(returns, 1) OVER ({_WT}) AS target FROM tr0)
        WHERE {OLS_X} IS NOT NULL AND returns IS NOT NULL AND target IS NOT NULL AND "Close" IS NOT NULL),
tr AS (SELECT *, CASE WHEN row_number() OVER ({_WT}) <= floor(count(*) OVER (PARTITION BY "Ticker") * CAST(1 - {TEST_SIZE} AS DOUBLE))
       THEN 'train' ELSE 'test' END AS split FROM tr1),
co AS (SELECT "Ticker", count(*) AS n, regr_intercept(target, {OLS_X}) AS intercept, regr_slope(target, {OLS_X}) AS coef_0
       FROM tr WHERE split = 'train' GROUP BY 1)
""".replace("\n,\ntr0", ",\ntr0")


def _fix(sql: str) -> str:
    return sql.replace("\n,\ntr0", ",\ntr0")


@query("ols_fit", _fix(_ols_sql_prefix() + """SELECT "Ticker", n, round(intercept, 6) AS intercept,
  round(coef_0, 6) AS coef_0 FROM co"""))
def ols_fit(spark, sf_dir):
    """M1 per ticker by normal equations (one aggregation + tiny solve)."""
    df, cols = _ols_frame(spark, sf_dir)
    co = MOD.ols_fit(df.where(F.col("split") == "train"), cols)
    return co.select("Ticker", "n", F.round("intercept", 6).alias("intercept"), F.round("coef_0", 6).alias("coef_0"))


@query("regression_metrics", _fix(_ols_sql_prefix() + f""", pr AS (SELECT tr.*, co.intercept + co.coef_0 * tr.{OLS_X} AS prediction
  FROM tr JOIN co ON co."Ticker" = tr."Ticker")
SELECT "Ticker", split, count(*) AS n, round(avg(abs(target - prediction)), 6) AS mae,
  round(avg((target - prediction) * (target - prediction)), 6) AS mse,
  round(sqrt(avg((target - prediction) * (target - prediction))), 6) AS rmse,
  round(CASE WHEN var_pop(target) * count(*) > 0
        THEN 1 - sum((target - prediction) * (target - prediction)) / (var_pop(target) * count(*))
        WHEN sum((target - prediction) * (target - prediction)) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2
FROM pr GROUP BY 1, 2""").replace("co.coef_0 * tr.", "co.coef_0 * tr.").replace('\n, pr AS', ',\npr AS'))
def regression_metrics(spark, sf_dir):
    """MAE, MSE, RMSE, R² per (Ticker, split) of the per-ticker linear model."""
    df, cols = _ols_frame(spark, sf_dir)
    scored = MOD.ols_fit_predict(df, cols, F.col("split") == "train")
    m = MET.regression_metrics(scored, by=("Ticker", "split"))
    return m.select("Ticker", "split", "n", *[F.round(c, 6).alias(c) for c in ("mae", "mse", "rmse", "r2")])


BD_SHIFTS = (1, 3, 7)


def _bd_sql(d: str, n: int) -> str:
    wd = f"(isodow({d}) - 1)"
    k = f"(least({wd}, 4) + {n})"
    return f"CAST({d} - CAST({wd} AS INTEGER) + CAST(floor({k} / 5) * 7 + {k} % 5 AS INTEGER) AS DATE)"


@query("business_day_shift", WITH_BARS + 'SELECT "Ticker", "Date", '
       + ", ".join(f'{_bd_sql(chr(34) + "Date" + chr(34), n)} AS bd_{n}' for n in BD_SHIFTS) + " FROM bars")
def business_day_shift(spark, sf_dir):
    """Bar date + n business days (Mon-Fri)."""
    b = bars(spark, sf_dir)
    return b.select("Ticker", "Date", *[SCO.business_day_shift(F.col("Date"), n).alias(f"bd_{n}") for n in BD_SHIFTS])


# ols_fit_2 / ols_fit_4: the oracle makes the inputs orthogonal on the training
# rows one after the other, so every coefficient is a slope of its own

OLS_MANY = ["rsi_14", "volume_ratio", "high_low_ratio", "volatility_20"]


def _orthogonal_sql(names: list[str]) -> str:
    prefix = _feat_prefix(names)
    w = 'OVER (PARTITION BY "Ticker")'
    tr = lambda c: f"CASE WHEN split = 'train' THEN {c} END"
    known = " AND ".join(f"{n} IS NOT NULL" for n in names)
    sql = prefix + f""",
tr0 AS (SELECT *, "Close" / NULLIF(lag("Close") OVER ({_WT}), 0) - 1 AS returns FROM feat),
tr1 AS (SELECT * FROM (SELECT *, lead(returns, 1) OVER ({_WT}) AS target FROM tr0)
        WHERE {known} AND returns IS NOT NULL AND target IS NOT NULL AND "Close" IS NOT NULL),
g0 AS (SELECT *, CASE WHEN row_number() OVER ({_WT}) <= floor(count(*) OVER (PARTITION BY "Ticker") * CAST(1 - {TEST_SIZE} AS DOUBLE))
       THEN 'train' ELSE 'test' END AS split FROM tr1)"""
    for k, n in enumerate(names):
        less = "".join(f" - coalesce(regr_slope({tr(n)}, z{m}) {w}, 0) * z{m}" for m in range(k))
        sql += f",\ng{k + 1} AS (SELECT *, {n} - avg({tr(n)}) {w}{less} AS z{k} FROM g{k})"
    fit = " + ".join([f"avg({tr('target')}) {w}"] + [f"coalesce(regr_slope({tr('target')}, z{m}) {w}, 0) * z{m}" for m in range(len(names))])
    return (sql + f'\nSELECT "Ticker", "Date", split, round({fit}, 6) AS prediction FROM g{len(names)}').replace("\n,\ntr0", ",\ntr0")


def _ols_many(spark, sf_dir, names):
    ts = DS.prepare(bars(spark, sf_dir), names, "returns", 1)
    df = DS.split(ts.frame, TEST_SIZE)
    scored = MOD.ols_fit_predict(df, ts.feature_cols, F.col("split") == "train")
    return scored.select("Ticker", "Date", "split", F.round("prediction", 6).alias("prediction"))


@query("ols_fit_2", _orthogonal_sql(OLS_MANY[:2]))
def ols_fit_2(spark, sf_dir):
    """M1 per ticker, two inputs (closed form over window moments)."""
    return _ols_many(spark, sf_dir, OLS_MANY[:2])


@query("ols_fit_4", _orthogonal_sql(OLS_MANY))
def ols_fit_4(spark, sf_dir):
    """M1 per ticker, four inputs (grouped moments and a small solve)."""
    return _ols_many(spark, sf_dir, OLS_MANY)


# ---- stored models: one pooled input with warm-up nulls -----------------------------------------------

POOLED_X = "rsi_14"


def _pooled_sql(x: str) -> str:
    prefix = _feat_prefix([x])
    return (prefix + f""",
tr0 AS (SELECT *, "Close" / NULLIF(lag("Close") OVER ({_WT}), 0) - 1 AS returns FROM feat),
tr1 AS (SELECT * FROM (SELECT *, lead(returns, 1) OVER ({_WT}) AS target FROM tr0)
        WHERE {x} IS NOT NULL AND returns IS NOT NULL AND target IS NOT NULL AND "Close" IS NOT NULL),
tr AS (SELECT *, CASE WHEN row_number() OVER ({_WT}) <= floor(count(*) OVER (PARTITION BY "Ticker") * CAST(1 - {TEST_SIZE} AS DOUBLE))
       THEN 'train' ELSE 'test' END AS split FROM tr1),
co AS (SELECT regr_intercept(target, {x}) AS intercept, regr_slope(target, {x}) AS coef_0 FROM tr WHERE split = 'train'),
pr AS (SELECT tr.*, co.intercept + co.coef_0 * {x} AS prediction FROM tr, co),
mt AS (SELECT split, count(*) AS n, sqrt(avg((target - prediction) * (target - prediction))) AS rmse,
       1 - sum((target - prediction) * (target - prediction)) / (var_pop(target) * count(*)) AS r2 FROM pr GROUP BY 1)
""").replace("\n,\ntr0", ",\ntr0")


def _metric_sql(split: str, name: str) -> str:
    return f"(SELECT {name} FROM mt WHERE split = '{split}')"


_PRED_SQL = _pooled_sql(POOLED_X) + f""", sc AS (SELECT feat."Ticker", feat."Date" AS feature_date,
   co.intercept + co.coef_0 * feat.{POOLED_X} AS prediction FROM feat, co)
"""


def _stored_run(spark, sf_dir, x: str = POOLED_X, log=None):
    """Train the pooled one-input model, save it and log the run."""
    log = log or ST.RunLog(spark, scratch(spark, "runs"))
    s = TR.train(bars(spark, sf_dir), "linear_regression", [x], test_size=TEST_SIZE, runlog=log, run_name=f"linear_{x}")
    return log, s


@query("predict_linear", _PRED_SQL + f"""SELECT round(prediction, 6) AS prediction, {_bd_sql("feature_date", 1)} AS "Date",
  feature_date, "Ticker" FROM sc""")
def predict_linear(spark, sf_dir):
    """Every feature row scored by the stored model, dated one business
    day ahead; rows without the input (warm-up) get a null prediction."""
    log, s = _stored_run(spark, sf_dir)
    p = TR.predict(bars(spark, sf_dir), log, s["run_id"])
    return p.select(F.round("prediction", 6).alias("prediction"), "Date", "feature_date", "Ticker")


LATEST_PRED = 5


@query("predict_latest", _PRED_SQL + f"""SELECT round(prediction, 6) AS prediction, {_bd_sql("feature_date", 1)} AS "Date",
  feature_date, "Ticker" FROM (SELECT *, row_number() OVER (PARTITION BY "Ticker" ORDER BY feature_date DESC) AS rk FROM sc)
WHERE rk <= {LATEST_PRED}""")
def predict_latest(spark, sf_dir):
    """P5: the latest predictions of every ticker by the stored model."""
    log, s = _stored_run(spark, sf_dir)
    p = TR.predict_latest(bars(spark, sf_dir), log, s["run_id"], LATEST_PRED)
    return p.select(F.round("prediction", 6).alias("prediction"), "Date", "feature_date", "Ticker")


COMPARED = ("rsi_14", "high_low_ratio")


def _compare_sql() -> str:
    """One statement per run; the shared bars are derived in each."""
    parts = [f"""SELECT * FROM ({_pooled_sql(x)} SELECT 'linear_{x}' AS run_name, round({_metric_sql("test", "r2")}, 6) AS test_r2,
  round({_metric_sql("test", "rmse")}, 6) AS test_rmse)""" for x in COMPARED]
    return "\nUNION ALL ".join(parts)


@query("runs_compare", _compare_sql())
def runs_compare(spark, sf_dir):
    """Logged runs side by side, test R² and RMSE, read from the run table."""
    log = None
    for x in COMPARED:
        log, _ = _stored_run(spark, sf_dir, x, log)
    c = ST.compare_runs(log.runs())
    return c.select("run_name", F.round("test_r2", 6).alias("test_r2"), F.round("test_rmse", 6).alias("test_rmse"))


BARS_LINEITEM = """bars AS (
  SELECT CAST(l.l_shipdate AS DATE) AS "Date", p.p_brand AS "Ticker",
         arg_min(l.l_extendedprice / l.l_quantity, (l.l_orderkey, l.l_linenumber, l.l_extendedprice / l.l_quantity)) AS "Open",
         max(l.l_extendedprice / l.l_quantity) AS "High", min(l.l_extendedprice / l.l_quantity) AS "Low",
         arg_max(l.l_extendedprice / l.l_quantity, (l.l_orderkey, l.l_linenumber, l.l_extendedprice / l.l_quantity)) AS "Close",
         CAST(sum(l.l_quantity) AS BIGINT) AS "Volume"
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2)"""


# ---- S3-S6, S11-S12, I1-I2: sources, store, ingest -----------------------------------------------------

from ..operators import ingest as ING  # noqa: E402
from ..schema import violations as _violations  # noqa: E402
from ..sources import readers as RD  # noqa: E402

@query("bars_normalise", WITH_BARS + f"""SELECT {BAR_COLS_SQL} FROM (
  SELECT CAST(CAST("Date" AS TIMESTAMP) AS DATE) AS "Date", "Ticker", "Open", "High", "Low", "Close", "Volume" FROM bars)""")
def bars_normalise(spark, sf_dir):
    """S3: a vendor-shaped frame of all tickers (timestamp index) -> bar schema."""
    b = bars(spark, sf_dir)
    vendor = b.select(F.col("Date").cast("timestamp").alias("Date"), "Ticker", "Open", "High", "Low", "Close", "Volume")
    return _bar_cols_spark(RD.normalise(vendor))


REQUESTED = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE", "0-TEST")


@query("missing_tickers", WITH_BARS + f"""SELECT r."Ticker" FROM (VALUES {", ".join(f"('{t}')" for t in REQUESTED)}) AS r("Ticker")
WHERE r."Ticker" NOT IN (SELECT DISTINCT "Ticker" FROM bars)""")
def missing_tickers(spark, sf_dir):
    """Requested tickers without bars."""
    return RD.missing_tickers(spark, REQUESTED, bars(spark, sf_dir))


# an existing table (up to 2000-06-30) and a corrected batch overlapping it from 2000-01-01
UPSERT_CUT, UPSERT_FROM = "2000-06-30", "2000-01-01"


def _existing_new(spark, sf_dir):
    b = bars(spark, sf_dir)
    existing = b.where(F.col("Date") <= F.to_date(F.lit(UPSERT_CUT)))
    new = b.where(F.col("Date") >= F.to_date(F.lit(UPSERT_FROM))) \
        .withColumn("Close", F.col("Close") + 1.0)
    return existing, new


_EXISTING_NEW_SQL = WITH_BARS.rstrip("\n") + f""",
existing AS (SELECT * FROM bars WHERE "Date" <= DATE '{UPSERT_CUT}'),
new AS (SELECT "Date", "Ticker", "Open", "High", "Low", "Close" + 1 AS "Close", "Volume" FROM bars WHERE "Date" >= DATE '{UPSERT_FROM}')
"""


@query("bars_violations", _EXISTING_NEW_SQL + """, faulty AS (
  SELECT "Ticker", "Date", CASE WHEN month("Date") = 3 THEN NULL ELSE "Open" END AS "Open", "High", "Low",
         CASE WHEN month("Date") = 4 THEN CAST('NaN' AS DOUBLE) ELSE "Close" END AS "Close", "Volume"
  FROM (SELECT * FROM existing UNION ALL SELECT * FROM new))
SELECT "Ticker", "Date", 'duplicate key' AS reason, count(*) AS n FROM faulty GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT "Ticker", "Date", 'null Open', 1 FROM faulty WHERE "Open" IS NULL
UNION ALL SELECT "Ticker", "Date", 'null Close', 1 FROM faulty WHERE isnan("Close")""")
def bars_violations(spark, sf_dir):
    """Contract check on a naive append of the batch, with null opens in
    March and NaN closes in April (duplicate keys, nulls, NaN)."""
    existing, new = _existing_new(spark, sf_dir)
    month = F.month("Date")
    faulty = existing.unionByName(new).withColumn("Open", F.when(month != 3, F.col("Open"))) \
        .withColumn("Close", F.when(month == 4, F.lit(float("nan"))).otherwise(F.col("Close")))
    return _violations(faulty)


# the test tables hold a few bars per month and ticker: yearly folders
STORE_LAYOUT = {"buckets": 4, "period": "year"}


def _bar_store(spark):
    return ST.BarStore(spark, scratch(spark, "bars"), **STORE_LAYOUT)


_UPSERT_SQL = _EXISTING_NEW_SQL + f"""SELECT {BAR_COLS_SQL} FROM (
  SELECT * FROM existing e WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n."Ticker" = e."Ticker" AND n."Date" = e."Date")
  UNION ALL SELECT * FROM new)"""


@query("bars_upsert", _UPSERT_SQL)
def bars_upsert(spark, sf_dir):
    """The stored table after an upsert (replaced keys take the batch's values)."""
    existing, new = _existing_new(spark, sf_dir)
    store = _bar_store(spark)
    store.upsert(existing)
    store.upsert(new)
    return _bar_cols_spark(store.read())


INGEST_START = "2000-03-01"


@query("incremental_bars", _EXISTING_NEW_SQL + f"""SELECT {BAR_COLS_SQL} FROM (
  SELECT b.* FROM bars b LEFT JOIN (SELECT "Ticker", max("Date") AS latest FROM existing GROUP BY 1) l USING ("Ticker")
  WHERE b."Date" >= greatest(coalesce(l.latest, DATE '{INGEST_START}'), DATE '{INGEST_START}'))""")
def incremental_bars(spark, sf_dir):
    """Fetch from max(latest stored, window start); the latest day is re-read."""
    existing, _ = _existing_new(spark, sf_dir)
    return _bar_cols_spark(ING.incremental(bars(spark, sf_dir), existing, INGEST_START))


def _faulty_sql() -> str:
    return "WITH " + BARS_LINEITEM + """, f AS (
  SELECT "Date", CASE WHEN "Ticker" = 'Brand#21' AND month("Date") = 6 THEN NULL ELSE "Ticker" END AS "Ticker",
         CASE WHEN "Ticker" = 'Brand#13' AND month("Date") = 3 THEN -"Open" ELSE "Open" END AS "Open",
         CASE WHEN "Ticker" = 'Brand#14' AND month("Date") = 4 THEN "Low" - 1 ELSE "High" END AS "High", "Low",
         CASE WHEN "Ticker" = 'Brand#11' AND month("Date") = 1 THEN NULL
              WHEN "Ticker" = 'Brand#12' AND month("Date") = 2 THEN CAST('NaN' AS DOUBLE) ELSE "Close" END AS "Close", "Volume" FROM bars),
batch AS (SELECT * FROM f UNION ALL SELECT * FROM f WHERE "Ticker" = 'Brand#15' AND month("Date") = 5),
bad AS (SELECT "Ticker", min(reason) AS reason FROM (
  SELECT "Ticker", CASE WHEN "Ticker" IS NULL OR "Close" IS NULL OR isnan("Close") THEN 'null field'
                        WHEN NOT ("Open" > 0 AND "High" > 0 AND "Low" > 0 AND "Close" > 0) THEN 'non-positive price'
                        WHEN "High" < "Low" THEN 'high below low' END AS reason FROM batch
  UNION ALL SELECT "Ticker", 'duplicate key' FROM batch WHERE "Ticker" IS NOT NULL GROUP BY "Ticker", "Date" HAVING count(*) > 1)
  WHERE reason IS NOT NULL GROUP BY 1)
"""


def _faulty_batch(spark, sf_dir):
    """Brand bars with one kind of fault per brand and month: null close, NaN
    close, negative open, high below low, repeated keys, missing ticker."""
    from ..sources.adapters import bars_from_lineitem
    b = bars_from_lineitem(spark, sf_dir)

    def at(brand: str, month: int):
        return (F.col("Ticker") == brand) & (F.month("Date") == month)

    low = F.when(at("Brand#14", 4), F.col("Low") - 1).otherwise(F.col("High"))
    close = F.when(at("Brand#12", 2), F.lit(float("nan"))).when(~at("Brand#11", 1), F.col("Close"))
    f = b.select("Date", F.when(~at("Brand#21", 6), F.col("Ticker")).alias("Ticker"),
                 F.when(at("Brand#13", 3), -F.col("Open")).otherwise(F.col("Open")).alias("Open"),
                 low.alias("High"), "Low", close.alias("Close"), "Volume")
    twice = F.when(at("Brand#15", 5), 2).otherwise(1)
    return f.withColumn("_copy", F.explode(F.sequence(F.lit(1), twice))).drop("_copy")


@query("ingest_accepted", _faulty_sql() + """SELECT "Ticker", "Date", "Open", "High", "Low", "Close", "Volume" FROM batch
WHERE "Ticker" IS NOT NULL AND "Ticker" NOT IN (SELECT "Ticker" FROM bad WHERE "Ticker" IS NOT NULL)""")
def ingest_accepted(spark, sf_dir):
    """Bars of tickers that passed validation (a batch with every kind of fault)."""
    acc, _ = ING.split_batch(_faulty_batch(spark, sf_dir))
    return acc.select("Ticker", "Date", *PRICE_COLS, "Volume")


@query("ingest_rejected", _faulty_sql() + 'SELECT "Ticker", reason FROM bad')
def ingest_rejected(spark, sf_dir):
    """Tickers set aside, with the reason; they do not stop the others."""
    _, bad = ING.split_batch(_faulty_batch(spark, sf_dir))
    return bad


REC_NAMES = ["sma_20", "rsi_14", "returns"]


@query("feature_records", _feat_prefix(REC_NAMES, keep=()) + """SELECT "Ticker", "Date",
  MAP(['sma_20', 'rsi_14', 'returns'], [round(sma_20 / 100, 4), round(rsi_14, 4), round(returns, 8)]) AS features FROM feat""")
def feature_records(spark, sf_dir):
    """One record per (Ticker, Date) with a feature -> value map (null when undefined)."""
    from ..functions.records import feature_map
    f = compute_features(bars(spark, sf_dir), REC_NAMES)
    m = feature_map(REC_NAMES, {n: shown(n, F.col(n)) for n in REC_NAMES})
    return f.select("Ticker", "Date", m.alias("features"))


STORE_NAMES = FE.DEFAULT_FEATURES


def _feature_store(spark, sf_dir):
    """The default features of all tickers, set into a new store."""
    f = _shown_all(compute_features(bars(spark, sf_dir), STORE_NAMES), STORE_NAMES)
    store = ST.FeatureStore(spark, scratch(spark, "features"), ttl_seconds=None, **STORE_LAYOUT)
    store.set(f)
    return store


_PUT_SQL = _feat_prefix(STORE_NAMES, keep=()) + f"""SELECT "Ticker", "Date", feature, value FROM (
  UNPIVOT (SELECT "Ticker", "Date", {", ".join(S.shown(n, n) for n in STORE_NAMES)} FROM feat)
  ON {", ".join(STORE_NAMES)} INTO NAME feature VALUE value)"""


@query("feature_store_put", _PUT_SQL)
def feature_store_put(spark, sf_dir):
    """S12 set: the long-form rows that the feature table holds (defined values)."""
    rows = _feature_store(spark, sf_dir).rows()
    return rows.where(F.col("value").isNotNull()).select("Ticker", "Date", "feature", "value")


GET_TICKERS = ("2-HIGH", "4-NOT SPECIFIED")
GET_START, GET_END = "1998-01-01", "1999-12-31"
GET_NAMES = ["sma_20", "rsi_14", "macd"]


@query("feature_store_get", _feat_prefix(STORE_NAMES, keep=()) + f"""SELECT "Ticker", "Date", {", ".join(S.shown(n, n) for n in GET_NAMES)}
FROM feat WHERE "Ticker" IN ({", ".join(f"'{t}'" for t in GET_TICKERS)}) AND "Date" BETWEEN DATE '{GET_START}' AND DATE '{GET_END}'""")
def feature_store_get(spark, sf_dir):
    """S12 get: scan of the stored rows (tickers, range, names) -> pivot back."""
    return _feature_store(spark, sf_dir).get(GET_TICKERS, GET_NAMES, GET_START, GET_END).select("Ticker", "Date", *GET_NAMES)


@query("feature_store_delete", _PUT_SQL + f""" WHERE "Ticker" <> '{GET_TICKERS[0]}'""")
def feature_store_delete(spark, sf_dir):
    """S12 delete: what is left in the feature table without one ticker."""
    store = _feature_store(spark, sf_dir)
    store.delete(GET_TICKERS[0])
    return store.rows().where(F.col("value").isNotNull()).select("Ticker", "Date", "feature", "value")


# ---- D1-D7: drift ------------------------------------------------------------------------------------------

from ..operators import drift as DR  # noqa: E402

DRIFT_NAMES = ["sma_20", "rsi_14", "macd", "volatility_20", "returns", "volume_ratio", "high_low_ratio"]
REF = ("1997-01-01", "1997-12-31")
CUR = ("1998-01-01", "1998-12-31")
THRESHOLD = 0.05
_PRICE_FEATS = [n for n in DRIFT_NAMES if n in S.PRICE_LIKE]


def _scaled(col):
    """Feature-unit statistic shown like its feature: price-like in currency."""
    return F.when(F.col("feature").isin(_PRICE_FEATS), F.round(col / 100.0, 2)).otherwise(F.round(col, 6))


def _scaled_sql(expr: str) -> str:
    fl = ", ".join(f"'{n}'" for n in _PRICE_FEATS)
    return f"CASE WHEN feature IN ({fl}) THEN round(({expr}) / 100, 2) ELSE round({expr}, 6) END"


def _drift_frames(spark, sf_dir):
    return DR.detect(bars(spark, sf_dir), DRIFT_NAMES, *REF, *CUR, threshold=THRESHOLD)


def _drift_sql_prefix() -> str:
    def period(p, rng):
        w = f"\"Date\" >= DATE '{rng[0]}' AND \"Date\" <= DATE '{rng[1]}'"
        return S.features_ctes(DRIFT_NAMES, bars_where=w, suffix=f"_{p}")
    cols = ", ".join(DRIFT_NAMES)

    def stats(p):
        f = f"FILTER (WHERE period = '{p}')"
        return (f"count(value) {f} AS {p}_n, avg(value) {f} AS {p}_mean, stddev_samp(value) {f} AS {p}_std, "
                f"quantile_cont(value, 0.25) {f} AS {p}_p25, quantile_cont(value, 0.5) {f} AS {p}_p50, "
                f"quantile_cont(value, 0.75) {f} AS {p}_p75")
    eps = DR.EPS
    return "WITH RECURSIVE " + S.BARS_ORDERS + ",\n" + period("ref", REF) + ",\n" + period("cur", CUR) + f""",
long AS (
  SELECT "Ticker", 'ref' AS period, feature, value FROM (UNPIVOT (SELECT "Ticker", {cols} FROM feat_ref) ON {cols} INTO NAME feature VALUE value)
  UNION ALL
  SELECT "Ticker", 'cur' AS period, feature, value FROM (UNPIVOT (SELECT "Ticker", {cols} FROM feat_cur) ON {cols} INTO NAME feature VALUE value)),
prof AS (SELECT "Ticker", feature, {stats("ref")}, {stats("cur")} FROM long GROUP BY 1, 2),
prof2 AS (SELECT * FROM prof WHERE ref_n > 0 AND cur_n > 0),
rep0 AS (SELECT "Ticker", feature,
  CASE WHEN abs(ref_mean) > {eps} THEN abs((cur_mean - ref_mean) / ref_mean) ELSE abs(cur_mean - ref_mean) END AS mean_shift,
  CASE WHEN ref_std > {eps} THEN abs((cur_std - ref_std) / ref_std) ELSE abs(cur_std - ref_std) END AS std_shift,
  ((abs((cur_p25 - ref_p25) / (ref_p25 + {eps})) + abs((cur_p50 - ref_p50) / (ref_p50 + {eps})))
    + abs((cur_p75 - ref_p75) / (ref_p75 + {eps}))) / 3.0 AS percentile_shift,
  ref_mean AS reference_mean, cur_mean AS current_mean, ref_std AS reference_std, cur_std AS current_std FROM prof2),
rep AS (SELECT *, greatest(mean_shift, std_shift, percentile_shift) AS max_shift,
  greatest(mean_shift, std_shift, percentile_shift) > {THRESHOLD} AS drift_detected FROM rep0)
"""


@query("drift_profile", _drift_sql_prefix() + "SELECT \"Ticker\", feature, ref_n, cur_n, " + ", ".join(
    f"{_scaled_sql(f'{p}_{s}')} AS {p}_{s}" for p in ("ref", "cur") for s in ("mean", "std", "p25", "p50", "p75"))
    + " FROM prof2")
def drift_profile(spark, sf_dir):
    """Per (Ticker, feature) count, mean, std and quartiles of both periods."""
    feats = compute_features(DR.periods(bars(spark, sf_dir), REF, CUR), DRIFT_NAMES, by=("Ticker", "period"))
    p = DR.profile_tagged(feats, DRIFT_NAMES)
    cols = []
    for per in ("ref", "cur"):
        cols += [_scaled(F.col(f"{per}_mean")).alias(f"{per}_mean"), _scaled(F.col(f"{per}_std")).alias(f"{per}_std")]
        cols += [_scaled(F.col(f"{per}_q")[k]).alias(f"{per}_{n}") for k, n in enumerate(("p25", "p50", "p75"))]
    return p.select("Ticker", "feature", "ref_n", "cur_n", *cols)


@query("drift_report", _drift_sql_prefix() + f"""SELECT "Ticker", feature, round(mean_shift, 6) AS mean_shift,
  round(std_shift, 6) AS std_shift, round(percentile_shift, 6) AS percentile_shift, round(max_shift, 6) AS max_shift,
  drift_detected, {_scaled_sql("reference_mean")} AS reference_mean, {_scaled_sql("current_mean")} AS current_mean,
  {_scaled_sql("reference_std")} AS reference_std, {_scaled_sql("current_std")} AS current_std, CAST({THRESHOLD} AS DOUBLE) AS threshold
FROM rep""")
def drift_report(spark, sf_dir):
    """Shifts, max and the strict threshold flag per (Ticker, feature)."""
    rep = _drift_frames(spark, sf_dir).report
    return rep.select("Ticker", "feature", *[F.round(c, 6).alias(c) for c in
                                              ("mean_shift", "std_shift", "percentile_shift", "max_shift")],
                      "drift_detected", *[_scaled(F.col(c)).alias(c) for c in
                                          ("reference_mean", "current_mean", "reference_std", "current_std")],
                      "threshold")


@query("drift_summary", _drift_sql_prefix() + f""", pr AS (SELECT "Ticker",
    count(*) FILTER (WHERE "Date" BETWEEN DATE '{REF[0]}' AND DATE '{REF[1]}') AS ref_rows,
    count(*) FILTER (WHERE "Date" BETWEEN DATE '{CUR[0]}' AND DATE '{CUR[1]}') AS cur_rows FROM bars GROUP BY 1),
  agg AS (SELECT t."Ticker", coalesce(bool_or(drift_detected), false) AS d,
    count(*) FILTER (WHERE drift_detected) AS k, count(feature) AS n
    FROM (SELECT DISTINCT "Ticker" FROM bars) t LEFT JOIN rep USING ("Ticker") GROUP BY 1)
SELECT agg."Ticker",
  CASE WHEN coalesce(ref_rows, 0) = 0 OR coalesce(cur_rows, 0) = 0 THEN false ELSE d END AS drift_detected,
  CAST(CASE WHEN coalesce(ref_rows, 0) = 0 OR coalesce(cur_rows, 0) = 0 THEN 0 ELSE k END AS BIGINT) AS n_drifted,
  CAST(CASE WHEN coalesce(ref_rows, 0) = 0 OR coalesce(cur_rows, 0) = 0 THEN 0 ELSE n END AS BIGINT) AS n_features,
  CASE WHEN coalesce(ref_rows, 0) = 0 OR coalesce(cur_rows, 0) = 0 THEN 'Insufficient data for drift detection'
       WHEN d THEN 'Drift detected in ' || CAST(k AS VARCHAR) || '/' || CAST(n AS VARCHAR) || ' features'
       ELSE 'No significant drift detected' END AS message
FROM agg LEFT JOIN pr USING ("Ticker")""".replace("\n, pr AS", ",\npr AS"))
def drift_summary(spark, sf_dir):
    """Per ticker, any drift and "k/n features"."""
    return _drift_frames(spark, sf_dir).summary


# a period after the last bar of the short suppliers' series: some tickers have nothing there
SKIP_NAMES = ["sma_50", "rsi_14", "returns"]
SKIP_REF, SKIP_CUR = ("1992-01-01", "1995-12-31"), ("1998-06-01", "1998-12-31")


def _skip_sql() -> str:
    def period(p, rng):
        w = f"\"Date\" >= DATE '{rng[0]}' AND \"Date\" <= DATE '{rng[1]}'"
        return S.features_ctes(SKIP_NAMES, bars_where=w, suffix=f"_{p}")
    counts = ", ".join(f"count({n}) AS {n}" for n in SKIP_NAMES)
    union = " UNION ALL ".join(f"""SELECT t."Ticker", '{n}' AS feature, coalesce(r.{n}, 0) AS r, coalesce(c.{n}, 0) AS c
  FROM t LEFT JOIN r ON r."Ticker" = t."Ticker" LEFT JOIN c ON c."Ticker" = t."Ticker\"""" for n in SKIP_NAMES)
    return "WITH RECURSIVE " + BARS_SUPPLIERS + ",\n" + period("ref", SKIP_REF) + ",\n" + period("cur", SKIP_CUR) + f""",
t AS (SELECT DISTINCT "Ticker" FROM bars), r AS (SELECT "Ticker", {counts} FROM feat_ref GROUP BY 1),
c AS (SELECT "Ticker", {counts} FROM feat_cur GROUP BY 1), u AS ({union})
SELECT "Ticker", feature, CASE WHEN r = 0 THEN 'no values in reference' ELSE 'no values in current' END AS reason
FROM u WHERE r = 0 OR c = 0"""


@query("drift_skipped", _skip_sql())
def drift_skipped(spark, sf_dir):
    """Features left out of the comparison because a period has no value (many short series)."""
    from ..sources.adapters import bars_from_suppliers
    return DR.detect(bars_from_suppliers(spark, sf_dir), SKIP_NAMES, *SKIP_REF, *SKIP_CUR).skipped


@query("drift_flagged", _drift_sql_prefix() + f"""SELECT "Ticker", feature, round(max_shift * 100, 4) AS max_shift_pct,
  round(mean_shift * 100, 4) AS mean_shift_pct, round(std_shift * 100, 4) AS std_shift_pct,
  {_scaled_sql("current_mean")} AS current_mean, {_scaled_sql("reference_mean")} AS reference_mean
FROM rep WHERE drift_detected""")
def drift_flagged(spark, sf_dir):
    """Drifted features with shifts in percent."""
    rep = _drift_frames(spark, sf_dir).report
    fl = DR.flagged(rep)
    return fl.select("Ticker", "feature", *[F.round(c, 4).alias(c) for c in
                                              ("max_shift_pct", "mean_shift_pct", "std_shift_pct")],
                     *[_scaled(F.col(c)).alias(c) for c in ("current_mean", "reference_mean")])


# ---- A5-A7: request latency histogram (event log as the request log) ------------------------------------------

def request_log(spark, sf_dir):
    """Each event is a request: endpoint = event type, latency = value in ms."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("endpoint"), (F.col("value") / 1000.0).alias("latency_s"))


def _bucket_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} <= {b} THEN {b}" for b in MET.LATENCY_BUCKETS)
    return f"CASE {parts} ELSE CAST('inf' AS DOUBLE) END"


_LOG_SQL = f"""WITH lg AS (SELECT event_type AS endpoint, value / 1000.0 AS latency_s FROM events),
bk AS (SELECT {_bucket_sql("latency_s")} AS le, count(*) AS n FROM lg GROUP BY 1),
cb AS (SELECT le, n, sum(n) OVER (ORDER BY le ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM bk)
"""


@query("latency_buckets", _LOG_SQL + "SELECT le, n, CAST(cumulative AS BIGINT) AS cumulative FROM cb")
def latency_buckets(spark, sf_dir):
    """A5: requests per latency bucket (raw counts) and the running total."""
    return MET.latency_buckets(request_log(spark, sf_dir))


@query("request_counts", _LOG_SQL + "SELECT endpoint, count(*) AS requests FROM lg GROUP BY 1")
def request_counts(spark, sf_dir):
    """Requests per endpoint."""
    return MET.request_counts(request_log(spark, sf_dir))


@query("latency_quantile", _LOG_SQL + """SELECT """ + ", ".join(
    f"min(le) FILTER (WHERE cumulative >= {q} * (SELECT sum(n) FROM bk)) * 1000.0 AS p{round(q * 100)}_ms"
    for q in MET.QUANTILES) + " FROM cb")
def latency_quantile(spark, sf_dir):
    """First bucket whose running count reaches q of all requests, in ms."""
    return MET.latency_quantiles(MET.latency_buckets(request_log(spark, sf_dir)))


# ---- M2-M4, T7, S13-S14, I3: rows-only (model fits, writes, streaming) ------------------------------------------

POOLED_NAMES = ["sma_20", "rsi_14", "volume_ratio", "high_low_ratio"]


def _pooled_metrics(spark, sf_dir, model_type):
    _, _, scored = TR.scored_splits(bars(spark, sf_dir), model_type, POOLED_NAMES)
    m = MET.regression_metrics(scored, by=["split"])
    return m.select(F.lit(model_type).alias("model_type"), "split", "n",
                    *[F.round(c, 6).alias(c) for c in ("mae", "mse", "rmse", "r2")])


@query("forest_metrics")
def forest_metrics(spark, sf_dir):
    """M2: random forest (100 trees, depth 10, seed 42), pooled over tickers."""
    return _pooled_metrics(spark, sf_dir, "random_forest")


@query("gbt_metrics")
def gbt_metrics(spark, sf_dir):
    """M3/M4: gradient-boosted trees (100 rounds, depth 6, step 0.1, seed 42)."""
    return _pooled_metrics(spark, sf_dir, "xgboost")


_SUMMARY_SCHEMA = ("run_name string, model_type string, n_features int, n_train_samples long, "
                   "n_test_samples long, train_r2 double, test_r2 double, train_rmse double, test_rmse double")
_SUMMARY_SQL = _pooled_sql(POOLED_X) + f"""SELECT 'linear_{POOLED_X}' AS run_name, 'linear_regression' AS model_type, 1 AS n_features,
  {_metric_sql("train", "n")} AS n_train_samples, {_metric_sql("test", "n")} AS n_test_samples,
  """ + ", ".join(f"round({_metric_sql(p, m)}, 6) AS {p}_{m}" for m in ("r2", "rmse") for p in ("train", "test"))


@query("train_summary", _SUMMARY_SQL)
def train_summary(spark, sf_dir):
    """End-to-end training of the pooled linear model; the run summary as a row."""
    s = TR.train(bars(spark, sf_dir), "linear_regression", [POOLED_X], test_size=TEST_SIZE, run_name=f"linear_{POOLED_X}")
    p, a, b = s["params"], s["train_metrics"], s["test_metrics"]
    row = (s["run_name"], s["model_type"], int(p["n_features"]), int(p["n_train_samples"]), int(p["n_test_samples"]),
           round(a["train_r2"], 6), round(b["test_r2"], 6), round(a["train_rmse"], 6), round(b["test_rmse"], 6))
    return spark.createDataFrame([row], _SUMMARY_SCHEMA)


@query("runs_append", _pooled_sql(POOLED_X) + f"""SELECT 'linear_{POOLED_X}' AS run_name, 'default' AS experiment,
  ['{POOLED_X}'] AS features, CAST({_metric_sql("train", "n")} AS VARCHAR) AS n_train_samples, true AS has_model,
  round({_metric_sql("train", "r2")}, 6) AS train_r2, round({_metric_sql("test", "r2")}, 6) AS test_r2""")
def runs_append(spark, sf_dir):
    """Train, save the model, append the run row; the row read back
    (without its random id), with the stored model loaded."""
    log, s = _stored_run(spark, sf_dir)
    has_model = len(log.load_model(s["run_id"]).stages) > 0
    return log.runs().select("run_name", "experiment", "features", F.col("params")["n_train_samples"].alias("n_train_samples"),
                             F.lit(has_model).alias("has_model"), F.round(F.col("metrics")["train_r2"], 6).alias("train_r2"),
                             F.round(F.col("metrics")["test_r2"], 6).alias("test_r2"))


@query("ingest_stream", _UPSERT_SQL)
def ingest_stream(spark, sf_dir):
    """Two landings (a table and an overlapping corrected batch) ingested by
    the streaming job; the stored table equals the batch upsert (bars_upsert)."""
    from ..streaming.ingest_stream import run_available
    root = scratch(spark, "ingest")
    existing, new = _existing_new(spark, sf_dir)
    store = ST.BarStore(spark, f"{root}/bars", **STORE_LAYOUT)
    for part, landed in (("batch=0001", existing), ("batch=0002", new)):
        landed.write.parquet(f"{root}/landing/{part}")
        run_available(spark, f"{root}/landing", store.path, f"{root}/checkpoint", f"{root}/rejected", store=store)
    return _bar_cols_spark(store.read())


# ---- bars with more tickers: part brands from lineitem ---------------------------------------------------

BRAND_NAMES = ["sma_20", "ema_12", "rsi_14", "macd_signal", "bb_upper", "volatility_20", "atr_14", "returns"]
BRAND_DIGITS = 4   # unit prices in currency: 1/100 of a cent


def _brand_sql() -> str:
    prefix, _ = S.features_sql(BRAND_NAMES, bars=BARS_LINEITEM)
    return prefix + 'SELECT feat."Ticker", feat."Date", ' + ", ".join(
        f"round(feat.{n}, {BRAND_DIGITS}) AS {n}" for n in BRAND_NAMES) + " FROM feat"


@query("features_brands", _brand_sql())
def features_brands(spark, sf_dir):
    """Indicators over unit-price bars of every part brand (lineitem ⋈ part)."""
    from ..sources.adapters import bars_from_lineitem
    f = compute_features(bars_from_lineitem(spark, sf_dir), BRAND_NAMES)
    return f.select("Ticker", "Date", *[F.round(n, BRAND_DIGITS).alias(n) for n in BRAND_NAMES])


@query("latency_percentile", _LOG_SQL + """SELECT round(quantile_cont(latency_s, 0.95) * 1000.0, 6) AS p95_ms,
  round(quantile_cont(latency_s, 0.99) * 1000.0, 6) AS p99_ms FROM lg""")
def latency_percentile(spark, sf_dir):
    """A7 on raw values: exact percentiles (linear interpolation) of request latency, in ms."""
    p = MET.percentile_latency(request_log(spark, sf_dir))
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


# ---- M4, X6: leaf-wise boosting and the validation rows --------------------------------------------------

STUMP_X = ["high_low_ratio", "close_open_ratio"]
STUMP = {"num_leaves": 2, "n_estimators": 3, "learning_rate": 0.5, "max_bin": 16, "binning": "width", "min_data_in_leaf": 20}


def _split_sql(names: list[str]) -> str:
    known = " AND ".join(f"{n} IS NOT NULL" for n in names)
    return (_feat_prefix(names) + f""",
tr0 AS (SELECT *, "Close" / NULLIF(lag("Close") OVER ({_WT}), 0) - 1 AS returns FROM feat),
tr1 AS (SELECT * FROM (SELECT *, lead(returns, 1) OVER ({_WT}) AS target FROM tr0)
        WHERE {known} AND returns IS NOT NULL AND target IS NOT NULL AND "Close" IS NOT NULL),
tr AS (SELECT *, CASE WHEN row_number() OVER ({_WT}) <= floor(count(*) OVER (PARTITION BY "Ticker") * CAST(1 - {TEST_SIZE} AS DOUBLE))
       THEN 'train' ELSE 'test' END AS split FROM tr1)
""").replace("\n,\ntr0", ",\ntr0")


def _stumps_sql() -> str:
    """Round by round: sums per bin, running sums, the best cut, the new value."""
    bins, step, least = STUMP["max_bin"], STUMP["learning_rate"], STUMP["min_data_in_leaf"]
    rng = ", ".join(f"min({x}) AS lo{i}, max({x}) AS hi{i}" for i, x in enumerate(STUMP_X))
    cut = ", ".join(f"(SELECT count(*) FROM range(1, {bins}) t(k) WHERE lo{i} + (hi{i} - lo{i}) * k / {bins} < {x}) AS b{i}"
                    for i, x in enumerate(STUMP_X))
    sql = _split_sql(STUMP_X).rstrip("\n") + f""",
rg AS (SELECT {rng} FROM tr WHERE split = 'train'),
r0 AS (SELECT "Ticker", "Date", split, target, {cut}, (SELECT avg(target) FROM tr WHERE split = 'train') AS f FROM tr, rg)"""
    for m in range(STUMP["n_estimators"]):
        each = " UNION ALL ".join(f"SELECT {i} AS input, b{i} AS bin, sum(target - f) AS g, count(*) AS n FROM r{m} WHERE split = 'train' GROUP BY b{i}"
                                  for i in range(len(STUMP_X)))
        pick = " ".join(f"WHEN c.input = {i} THEN b{i}" for i in range(len(STUMP_X)))
        sql += f""",
h{m} AS ({each}),
p{m} AS (SELECT input, bin, sum(g) OVER (PARTITION BY input ORDER BY bin) AS gl, sum(n) OVER (PARTITION BY input ORDER BY bin) AS nl,
       sum(g) OVER (PARTITION BY input) AS g, sum(n) OVER (PARTITION BY input) AS n FROM h{m}),
c{m} AS (SELECT * FROM p{m} WHERE nl >= {least} AND n - nl >= {least}
       ORDER BY gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n DESC, input, bin LIMIT 1),
r{m + 1} AS (SELECT r."Ticker", r."Date", split, target, {", ".join(f"b{i}" for i in range(len(STUMP_X)))},
       f + {step} * CASE WHEN (CASE {pick} END) <= c.bin THEN c.gl / c.nl ELSE (c.g - c.gl) / (c.n - c.nl) END AS f FROM r{m} r, c{m} c)"""
    return sql + f'\nSELECT "Ticker", "Date", split, round(f, 8) AS prediction FROM r{STUMP["n_estimators"]}'


@query("boosted_stumps", _stumps_sql())
def boosted_stumps(spark, sf_dir):
    """M4: three rounds of the leaf-wise learner with two leaves, two inputs, pooled over tickers."""
    _, _, scored = TR.scored_splits(bars(spark, sf_dir), "lightgbm", STUMP_X, STUMP, test_size=TEST_SIZE)
    return scored.select("Ticker", "Date", "split", F.round("prediction", 8).alias("prediction"))


@query("leafwise_metrics")
def leafwise_metrics(spark, sf_dir):
    """M4: leaf-wise boosted trees (12 rounds, 15 leaves, step 0.1), stopped by patience."""
    params = {"n_estimators": 12, "num_leaves": 15, "validation_fraction": 0.1, "early_stopping_rounds": 3}
    _, _, scored = TR.scored_splits(bars(spark, sf_dir), "lightgbm", POOLED_NAMES, params)
    m = MET.regression_metrics(scored, by=["split"])
    return m.select(F.lit("lightgbm").alias("model_type"), "split", "n", *[F.round(c, 6).alias(c) for c in ("mae", "mse", "rmse", "r2")])


VALIDATION = 0.1


@query("validation_split", _split_sql([OLS_X]).rstrip("\n") + f"""
SELECT "Ticker", "Date", row_number() OVER ({_WT}) > floor(count(*) OVER (PARTITION BY "Ticker") * CAST(1 - {VALIDATION} AS DOUBLE)) AS is_validation
FROM tr WHERE split = 'train'""")
def validation_split(spark, sf_dir):
    """Which training rows only measure: the last ones of each ticker."""
    df, _ = _ols_frame(spark, sf_dir)
    return MOD.mark_validation(df.where(F.col("split") == "train"), VALIDATION).select("Ticker", "Date", "is_validation")


# ---- S8/S10 on the store, features batch by batch --------------------------------------------------------

STORE_LATEST = 3


@query("store_latest_bars", WITH_BARS + f"""SELECT {BAR_COLS_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY "Ticker" ORDER BY "Date" DESC) AS rk FROM bars) WHERE rk <= {STORE_LATEST}""")
def store_latest_bars(spark, sf_dir):
    """The last bars of every stored ticker, read from the newest period back."""
    store = _bar_store(spark)
    store.upsert(bars(spark, sf_dir))
    return _bar_cols_spark(store.latest_bars(STORE_LATEST))


STATE_CUT, STATE_FIXED = "1998-06-30", "1998-03-10"


@query("features_incremental", _features_oracle(FE.DEFAULT_FEATURES))
def features_incremental(spark, sf_dir):
    """The default features after two batches, of which the second corrects a
    day of the first; each batch goes on from the stored indicator state."""
    from .incremental import IncrementalFeatures
    b = bars(spark, sf_dir)
    fixed, cut = F.col("Date") == F.to_date(F.lit(STATE_FIXED)), F.to_date(F.lit(STATE_CUT))
    kept = IncrementalFeatures(spark, scratch(spark, "incremental"), FE.DEFAULT_FEATURES, **STORE_LAYOUT)
    kept.ingest(b.where(F.col("Date") <= cut).withColumn("Close", F.when(fixed, F.col("Close") * 3).otherwise(F.col("Close"))))
    kept.ingest(b.where((F.col("Date") > cut) | fixed))
    return _shown_all(kept.features.read().select("Date", "Ticker", *FE.DEFAULT_FEATURES), FE.DEFAULT_FEATURES)


# ---- D1-D6 from stored daily profiles ---------------------------------------------------------------------

from ..operators import profiles as PR  # noqa: E402


def _profiles_sql() -> str:
    cols = ", ".join(DRIFT_NAMES)

    def stats(p, rng):
        f = f"FILTER (WHERE \"Date\" BETWEEN DATE '{rng[0]}' AND DATE '{rng[1]}')"
        return f"count(value) {f} AS {p}_n, avg(value) {f} AS {p}_mean, stddev_samp(value) {f} AS {p}_std"
    eps = DR.EPS
    return (_feat_prefix(DRIFT_NAMES, keep=()) + f""",
long AS (SELECT "Ticker", "Date", feature, value FROM (UNPIVOT (SELECT "Ticker", "Date", {cols} FROM feat) ON {cols} INTO NAME feature VALUE value)),
prof AS (SELECT "Ticker", feature, {stats("ref", REF)}, {stats("cur", CUR)} FROM long GROUP BY 1, 2)
SELECT "Ticker", feature, ref_n, cur_n,
  round(CASE WHEN abs(ref_mean) > {eps} THEN abs((cur_mean - ref_mean) / ref_mean) ELSE abs(cur_mean - ref_mean) END, 6) AS mean_shift,
  round(CASE WHEN ref_std > {eps} THEN abs((cur_std - ref_std) / ref_std) ELSE abs(cur_std - ref_std) END, 6) AS std_shift,
  {_scaled_sql("ref_mean")} AS reference_mean, {_scaled_sql("cur_mean")} AS current_mean,
  {_scaled_sql("ref_std")} AS reference_std, {_scaled_sql("cur_std")} AS current_std
FROM prof WHERE ref_n > 0 AND cur_n > 0""").replace("\n,\nlong AS", ",\nlong AS")


@query("drift_from_profiles", _profiles_sql())
def drift_from_profiles(spark, sf_dir):
    """Two periods compared from the stored daily profiles of all features (indicators on
    the whole history); quartiles come from sketches and are compared in the tests."""
    table = ST.VersionedTable(spark, scratch(spark, "profiles"), PR.PROFILE, ("Ticker", "Date", "feature"), **STORE_LAYOUT)
    table.upsert(PR.daily_profiles(compute_features(bars(spark, sf_dir), DRIFT_NAMES), DRIFT_NAMES))
    rep = PR.compare(table.read(start=REF[0], end=CUR[1]), REF, CUR, THRESHOLD)
    return rep.select("Ticker", "feature", "ref_n", "cur_n", *[F.round(c, 6).alias(c) for c in ("mean_shift", "std_shift")],
                      *[_scaled(F.col(c)).alias(c) for c in ("reference_mean", "current_mean", "reference_std", "current_std")])


# ---- J1 on co-located tables, S1 as a data source ----------------------------------------------------------

@query("train_join_bucketed", ORACLE["train_join_close"])
def train_join_bucketed(spark, sf_dir):
    """Features joined to Close between two tables bucketed by ticker: no exchange."""
    import uuid
    from ..sources.bucketed import save_bucketed
    tag, root = uuid.uuid4().hex, scratch(spark, "bucketed")
    bs = save_bucketed(bars(spark, sf_dir), f"bars_{tag}", f"{root}/bars", buckets=4)
    feats = save_bucketed(compute_features(bs, ["sma_20"]), f"features_{tag}", f"{root}/features", buckets=4)
    j = DS.join_price(feats, bs.hint("merge"), "Close")  # bucket by bucket, also where one side would be small enough to broadcast
    return _shown_all(j, ["sma_20"], extra=(F.round(F.col("Close") / 100.0, 2).alias("Close"),))


@query("bars_datasource", WITH_BARS + f"""SELECT {BAR_COLS_SQL} FROM bars
WHERE "Ticker" IN ({", ".join(f"'{t}'" for t in SCAN_TICKERS)}) AND "Date" BETWEEN DATE '{SCAN_START}' AND DATE '{SCAN_END}'""")
def bars_datasource(spark, sf_dir):
    """Landed vendor files read by the data source, ticker and dates pushed to it."""
    from ..sources import landed
    root = scratch(spark, "landed")
    b = bars(spark, sf_dir)
    b.withColumn("Date", F.col("Date").cast("timestamp_ntz")).write.partitionBy("Ticker").parquet(root)
    landed.register(spark)
    df = spark.read.format(landed.NAME).load(root)
    between = F.col("Date").between(F.to_date(F.lit(SCAN_START)), F.to_date(F.lit(SCAN_END)))
    return _bar_cols_spark(df.where(F.col("Ticker").isin(*SCAN_TICKERS) & between))
