"""SQL text for the DuckDB oracle of each registered query.

The oracle is an independent statement of each definition: plain window SQL
for trailing windows, recursive CTEs (row-by-row recurrences) for the
exponential averages. It is written for DuckDB against the raw test tables.
"""

from __future__ import annotations

# Bars from orders: ticker = priority, price = whole cents, open/close by order key.
BARS_ORDERS = """bars AS (
  SELECT CAST(o_orderdate AS DATE) AS "Date", o_orderpriority AS "Ticker",
         arg_min(px, o_orderkey) AS "Open", max(px) AS "High", min(px) AS "Low",
         arg_max(px, o_orderkey) AS "Close", CAST(count(*) AS BIGINT) AS "Volume"
  FROM (SELECT *, round(o_totalprice * 100) AS px FROM orders) GROUP BY 1, 2)"""

W = 'PARTITION BY "Ticker" ORDER BY "Date"'
INDEXED = f"""b AS (SELECT *, row_number() OVER ({W}) - 1 AS i,
                    lag("Close") OVER ({W}) AS pc FROM bars)"""


def trail(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def guard(first: int, expr: str) -> str:
    return f"CASE WHEN i >= {first} THEN {expr} END"


def price(expr: str, name: str) -> str:
    return f"round(({expr}) / 100, 4) AS {name}"


# Plain (window) definitions over table b (bars + i + pc).
PLAIN = {
    "sma_5": guard(4, f'avg("Close") OVER {trail(5)}'),
    "sma_10": guard(9, f'avg("Close") OVER {trail(10)}'),
    "sma_20": guard(19, f'avg("Close") OVER {trail(20)}'),
    "sma_50": guard(49, f'avg("Close") OVER {trail(50)}'),
    "bb_upper": guard(19, f'avg("Close") OVER {trail(20)} + 2.0 * stddev_pop("Close") OVER {trail(20)}'),
    "bb_middle": guard(19, f'avg("Close") OVER {trail(20)}'),
    "bb_lower": guard(19, f'avg("Close") OVER {trail(20)} - 2.0 * stddev_pop("Close") OVER {trail(20)}'),
    "volume_sma_20": guard(19, f'avg("Volume") OVER {trail(20)}'),
    "volume_ratio": 'CAST("Volume" AS DOUBLE) / NULLIF('
                    + guard(19, f'avg("Volume") OVER {trail(20)}') + ', 0)',
    "returns": '"Close" / NULLIF(pc, 0) - 1',
    "log_returns": 'CASE WHEN "Close" / NULLIF(pc, 0) > 0 THEN ln("Close" / pc) END',
    "high_low_ratio": '"High" / NULLIF("Low", 0)',
    "close_open_ratio": '"Close" / NULLIF("Open", 0)',
    "volatility_20": guard(19, f'stddev_samp("Close") OVER {trail(20)}'),
}

PRICE_LIKE = {"sma_5", "sma_10", "sma_20", "sma_50", "ema_12", "ema_26", "macd", "macd_signal",
              "macd_histogram", "bb_upper", "bb_middle", "bb_lower", "volatility_20", "atr_14"}
DIGITS = {"rsi_14": 4, "volume_sma_20": 4}   # everything else not price-like: 8


def shown(name: str, expr: str) -> str:
    """Rounded output column, the same rule as ``present.shown`` on the Spark side."""
    if name in PRICE_LIKE:
        return f"round(({expr}) / 100, 4) AS {name}"
    return f"round({expr}, {DIGITS.get(name, 8)}) AS {name}"


def ema_cte(name: str, n: int, src: str = "b", x: str = '"Close"', first_valid: int = 0) -> str:
    """Recursive CTE ``name``(Ticker, i, y): EMA with alpha 2/(n+1), SMA seed."""
    a = f"(2.0 / {n + 1})"
    start = first_valid + n - 1
    return f"""{name}_in AS (SELECT "Ticker", i, {x} AS x,
        avg({x}) OVER (PARTITION BY "Ticker" ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS seed
      FROM {src}),
    {name} AS (
      SELECT "Ticker", i, seed AS y FROM {name}_in WHERE i = {start}
      UNION ALL
      SELECT s."Ticker", s.i, {a} * s.x + (1 - {a}) * r.y
      FROM {name} r JOIN {name}_in s ON s."Ticker" = r."Ticker" AND s.i = r.i + 1)"""


def wilder_cte(name: str, x: str, n: int, src: str = "b") -> str:
    """Recursive CTE ``name``(Ticker, i, m): weighted mean of x from row 1 with
    weights (1-1/n)^k, normalised (pandas ewm(adjust=True) form)."""
    q = f"(1 - 1.0 / {n})"
    return f"""{name}_in AS (SELECT "Ticker", i, {x} AS x FROM {src}),
    {name} AS (
      SELECT "Ticker", i, x AS m, CAST(1.0 AS DOUBLE) AS wsum FROM {name}_in WHERE i = 1
      UNION ALL
      SELECT s."Ticker", s.i, (s.x + {q} * r.wsum * r.m) / (1 + {q} * r.wsum), 1 + {q} * r.wsum
      FROM {name} r JOIN {name}_in s ON s."Ticker" = r."Ticker" AND s.i = r.i + 1)"""


def with_bars(*ctes: str, bars: str = BARS_ORDERS) -> str:
    parts = [bars, INDEXED, *ctes]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# Recursive features: the CTEs each needs (name -> SQL) and their value expression
# over the joined CTE aliases (pf = plain-feature row with index i).
def _rec_ctes(src: str) -> dict[str, str]:
    return {
        "r_e12": ema_cte("r_e12", 12, src=src),
        "r_e26": ema_cte("r_e26", 26, src=src),
        "r_m": f"""r_m AS (SELECT {src}."Ticker", {src}.i, r_e12.y - r_e26.y AS macd FROM {src}
                  LEFT JOIN r_e12 ON r_e12."Ticker" = {src}."Ticker" AND r_e12.i = {src}.i
                  LEFT JOIN r_e26 ON r_e26."Ticker" = {src}."Ticker" AND r_e26.i = {src}.i)""",
        "r_g": ema_cte("r_g", 9, src="r_m", x="macd", first_valid=25),
        "r_up": wilder_cte("r_up", 'greatest("Close" - pc, 0)', 14, src=src),
        "r_dn": wilder_cte("r_dn", 'greatest(pc - "Close", 0)', 14, src=src),
        "r_tr": wilder_cte("r_tr", 'greatest("High" - "Low", abs("High" - pc), abs("Low" - pc))', 14, src=src),
    }


REC_NEEDS = {
    "ema_12": ["r_e12"], "ema_26": ["r_e26"],
    "macd": ["r_e12", "r_e26", "r_m"], "macd_signal": ["r_e12", "r_e26", "r_m", "r_g"],
    "macd_histogram": ["r_e12", "r_e26", "r_m", "r_g"],
    "rsi_14": ["r_up", "r_dn"], "atr_14": ["r_tr"],
}
REC_EXPR = {
    "ema_12": "r_e12.y", "ema_26": "r_e26.y", "macd": "r_m.macd", "macd_signal": "r_g.y",
    "macd_histogram": "r_m.macd - r_g.y",
    "rsi_14": "CASE WHEN pf.i >= 14 THEN 100 * r_up.m / NULLIF(r_up.m + r_dn.m, 0) END",
    "atr_14": "CASE WHEN pf.i >= 14 THEN r_tr.m END",
}
JOIN_OF = {"r_e12", "r_e26", "r_m", "r_g", "r_up", "r_dn", "r_tr"}


def features_sql(names: list[str], bars_where: str | None = None, raw: bool = False,
                 keep: tuple[str, ...] = (), bars: str = BARS_ORDERS) -> tuple[str, str]:
    """(WITH-prefix defining CTE ``feat``, column list) for a set of default features.

    ``feat`` has Ticker, Date, i, the ``keep`` bar columns and one column per
    name, unrounded. ``bars_where`` filters the bars before the indicators
    (slice warm-up).
    """
    src = "bars" if bars_where is None else "bars_f"
    ctes = [bars]
    if bars_where is not None:
        ctes.append(f"bars_f AS (SELECT * FROM bars WHERE {bars_where})")
    ctes.append(f"""b AS (SELECT *, row_number() OVER ({W}) - 1 AS i,
                    lag("Close") OVER ({W}) AS pc FROM {src})""")
    plain = [n for n in names if n in PLAIN]
    rec = [n for n in names if n in REC_EXPR]
    plain_cols = ", ".join(f"{PLAIN[n]} AS {n}" for n in plain)
    ctes.append(f"pf AS (SELECT *{', ' + plain_cols if plain_cols else ''} FROM b)")
    rc = _rec_ctes("b")
    need = []
    for n in rec:
        for c in REC_NEEDS[n]:
            if c not in need:
                need.append(c)
    ctes += [rc[c] for c in need]
    joins = " ".join(f'LEFT JOIN {c} ON {c}."Ticker" = pf."Ticker" AND {c}.i = pf.i' for c in need)
    cols = ", ".join([f"pf.{n}" for n in plain] + [f"{REC_EXPR[n]} AS {n}" for n in rec])
    keep_cols = "".join(f', pf."{k}"' for k in keep)
    ctes.append(f'feat AS (SELECT pf."Ticker", pf."Date", pf.i{keep_cols}{", " + cols if cols else ""} FROM pf {joins})')
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n", ", ".join(n for n in names)


_CTE_NAMES = ("bars_f", "b", "pf", "feat", "r_e12_in", "r_e26_in", "r_g_in", "r_up_in", "r_dn_in", "r_tr_in",
              "r_e12", "r_e26", "r_m", "r_g", "r_up", "r_dn", "r_tr")


def features_ctes(names: list[str], bars_where: str | None = None, suffix: str = "",
                  keep: tuple[str, ...] = ()) -> str:
    """The feature CTEs of :func:`features_sql` without the WITH and bars parts,
    every CTE name suffixed (so several feature sets can live in one query)."""
    import re
    prefix, _ = features_sql(names, bars_where, keep=keep)
    body = prefix[len("WITH RECURSIVE "):].replace(BARS_ORDERS + ",\n", "", 1)
    if suffix:
        pat = re.compile(r"\b(" + "|".join(_CTE_NAMES) + r")\b")
        body = pat.sub(lambda m: m.group(1) + suffix, body)
    return body.rstrip("\n")


def shown_list(names: list[str], table: str = "feat") -> str:
    return ", ".join(shown(n, f"{table}.{n}") for n in names)


def feature_sql(name: str) -> str:
    prefix, _ = features_sql([name])
    return prefix + f'SELECT feat."Ticker", feat."Date", {shown(name, "feat." + name)} FROM feat'
