"""Technical-indicator builders (F1-F21 and their parametrised forms).

A builder takes a :class:`Ctx` and returns a Column. Plain indicators are
window expressions over the per-ticker date order; recursive ones ask the
context for a :class:`~marketframe.functions.scan.Recurrence`, which the
engine evaluates with the linear-recurrence scan. Every output is null during
its warm-up (never NaN), and zero denominators give null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .scan import Recurrence
from .windows import TICKER


@dataclass
class Ctx:
    """What a builder may use: bar columns, the row index, windows, recurrences."""

    part: tuple = (TICKER,)
    order: tuple = ("Date",)
    index: str = "_i"
    recurrences: dict = field(default_factory=dict)   # out name -> (level, Recurrence)
    level: int = 0                                      # highest recurrence level used so far

    memo: dict = field(default_factory=dict)          # shared Column / WindowSpec objects

    def _m(self, key, make):
        """Build each distinct expression once: every Column or WindowSpec is a
        JVM object, and feature sets reuse the same ones many times."""
        if key not in self.memo:
            self.memo[key] = make()
        return self.memo[key]

    # --- columns -----------------------------------------------------------
    def c(self, name: str) -> Column:
        return self._m(("col", name), lambda: F.col(name))

    inline_index: bool = False                          # row index as a window expression
    resumed: bool = False                               # the frame goes on from stored state (see operators.features)

    @property
    def i(self) -> Column:
        """0-based row position. Inline (a row_number window of the same spec as
        the other windows) in the first projection, the ``_i`` column after it."""
        if self.inline_index:
            base = F.col("_base") if self.resumed else F.lit(0)
            return self._m(("rn",), lambda: F.row_number().over(self.w()) - 1 + base)
        return self.c(self.index)

    # --- windows -----------------------------------------------------------
    def w(self):
        return self._m(("w",), lambda: Window.partitionBy(*self.part).orderBy(*self.order))

    def trailing(self, n: int):
        return self._m(("trail", n), lambda: self.w().rowsBetween(-(n - 1), Window.currentRow))

    def lag(self, col: str, k: int = 1) -> Column:
        return self._m(("lag", col, k), lambda: F.lag(col, k).over(self.w()))

    def rolling(self, fn: str, col: str, n: int) -> Column:
        """Trailing aggregate ``fn`` (avg, stddev_pop, ...) of a bar column over n rows."""
        return self._m(("roll", fn, col, n), lambda: getattr(F, fn)(self.c(col)).over(self.trailing(n)))

    def guard(self, first_row: int, value: Column) -> Column:
        """Null before ``first_row`` (0-based): the warm-up rule."""
        return F.when(self.i >= first_row, value)

    # --- recurrences ---------------------------------------------------------
    def recur(self, key: str, u: Column, q: float, after: int = 0) -> Column:
        """Column of y = u + q*y_prev. ``after`` is the level of u's inputs."""
        out = f"_r_{key}"
        if self.resumed:  # rows before the first new one are in the stored value
            u = F.when(F.col("_live"), u).otherwise(F.lit(0.0))
        if out not in self.recurrences:
            self.recurrences[out] = (after + 1, Recurrence(out, u, q))
        lvl = self.recurrences[out][0]
        self.level = max(self.level, lvl)
        return F.col(out)

    def level_of(self, *cols_keys: str) -> int:
        return max([self.recurrences[f"_r_{k}"][0] for k in cols_keys] or [0])


# --- shared pieces -------------------------------------------------------------

def _ema_of(ctx: Ctx, key: str, x: Column, n: int, first_valid: int = 0, after: int = 0) -> Column:
    """EMA with alpha = 2/(n+1), seeded with the mean of its first n values.

    ``first_valid`` is the first row where x is defined; the output starts at
    row first_valid + n - 1.
    """
    a = 2.0 / (n + 1)
    start = first_valid + n - 1
    seed = F.avg(x).over(ctx.trailing(n))
    u = F.when(ctx.i == start, seed).when(ctx.i > start, a * x).otherwise(F.lit(0.0))
    y = ctx.recur(key, u, 1.0 - a, after=after)
    return ctx.guard(start, y)


def _wilder(ctx: Ctx, key: str, x: Column, n: int) -> Column:
    """Unnormalised Wilder sum of x from row 1 on (alpha = 1/n)."""
    u = F.when(ctx.i >= 1, x).otherwise(F.lit(0.0))
    return ctx.recur(key, u, 1.0 - 1.0 / n)


# --- builders ----------------------------------------------------------------------

def sma(n: int, col: str = "Close"):
    def build(ctx: Ctx) -> Column:
        return ctx.guard(n - 1, ctx.rolling("avg", col, n))
    return build


def ema(n: int, col: str = "Close"):
    def build(ctx: Ctx) -> Column:
        return _ema_of(ctx, f"ema_{col}_{n}", ctx.c(col), n)
    return build


def _macd_parts(ctx: Ctx, fast: int, slow: int, signal: int):
    fast_ema = _ema_of(ctx, f"ema_Close_{fast}", ctx.c("Close"), fast)
    slow_ema = _ema_of(ctx, f"ema_Close_{slow}", ctx.c("Close"), slow)
    line = fast_ema - slow_ema
    first = max(fast, slow) - 1
    after = ctx.level_of(f"ema_Close_{fast}", f"ema_Close_{slow}")
    sig = _ema_of(ctx, f"macd_signal_{fast}_{slow}_{signal}", line, signal,
                  first_valid=first, after=after)
    return line, sig


def macd(fast: int = 12, slow: int = 26, signal: int = 9):
    def build(ctx: Ctx) -> Column:
        return _macd_parts(ctx, fast, slow, signal)[0]
    return build


def macd_signal(fast: int = 12, slow: int = 26, signal: int = 9):
    def build(ctx: Ctx) -> Column:
        return _macd_parts(ctx, fast, slow, signal)[1]
    return build


def macd_histogram(fast: int = 12, slow: int = 26, signal: int = 9):
    def build(ctx: Ctx) -> Column:
        line, sig = _macd_parts(ctx, fast, slow, signal)
        return line - sig
    return build


def rsi(n: int = 14):
    def build(ctx: Ctx) -> Column:
        diff = ctx.c("Close") - ctx.lag("Close")
        up = _wilder(ctx, f"rsi_up_{n}", F.greatest(diff, F.lit(0.0)), n)
        down = _wilder(ctx, f"rsi_down_{n}", F.greatest(-diff, F.lit(0.0)), n)
        return ctx.guard(n, F.try_divide(100.0 * up, up + down))
    return build


def _bands(n: int, k: float, sign: int):
    def build(ctx: Ctx) -> Column:
        mid = ctx.rolling("avg", "Close", n)
        if sign == 0:
            return ctx.guard(n - 1, mid)
        return ctx.guard(n - 1, mid + sign * k * ctx.rolling("stddev_pop", "Close", n))
    return build


def bb_upper(n: int = 20, k: float = 2.0):
    return _bands(n, k, +1)


def bb_middle(n: int = 20, k: float = 2.0):
    return _bands(n, k, 0)


def bb_lower(n: int = 20, k: float = 2.0):
    return _bands(n, k, -1)


def volume_sma(n: int = 20):
    return sma(n, "Volume")


def volume_ratio(n: int = 20):
    def build(ctx: Ctx) -> Column:
        return F.try_divide(ctx.c("Volume").cast("double"), sma(n, "Volume")(ctx))
    return build


def returns():
    def build(ctx: Ctx) -> Column:
        return F.try_divide(ctx.c("Close"), ctx.lag("Close")) - 1.0
    return build


def log_returns():
    def build(ctx: Ctx) -> Column:
        return F.ln(F.try_divide(ctx.c("Close"), ctx.lag("Close")))
    return build


def ratio(num: str, den: str):
    def build(ctx: Ctx) -> Column:
        return F.try_divide(ctx.c(num), ctx.c(den))
    return build


def volatility(n: int = 20, col: str = "Close"):
    def build(ctx: Ctx) -> Column:
        return ctx.guard(n - 1, ctx.rolling("stddev_samp", col, n))
    return build


def true_range(ctx: Ctx) -> Column:
    prev = ctx.lag("Close")
    h, lo = ctx.c("High"), ctx.c("Low")
    return F.greatest(h - lo, F.abs(h - prev), F.abs(lo - prev))


def atr(n: int = 14):
    """Average true range, exponentially weighted with alpha = 1/n and
    normalised by the weight sum (1 - q^m) / (1 - q) of the m ranges so far."""
    def build(ctx: Ctx) -> Column:
        q = 1.0 - 1.0 / n
        s = _wilder(ctx, f"tr_{n}", true_range(ctx), n)
        weight = (1.0 - F.pow(F.lit(q), ctx.i)) / (1.0 - q)
        return ctx.guard(n, s / weight)
    return build
