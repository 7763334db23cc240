"""Linear-recurrence scan (LRS): y_i = u_i + q * y_(i-1), per ticker, with windows.

Exponential averages (EMA, Wilder smoothing, the MACD signal line) are
recurrences on their own output, which a window frame cannot express
directly. A step is the affine map y -> q * y + u, and maps compose
associatively: (a, b) after (c, d) is (a * c, a * d + b). The series is cut into
blocks of B rows and the maps are composed in two levels:

1. blk = i div B, j = i mod B.
2. Within a block the map of its first j + 1 rows has the factor q^(j+1) and the
   constant loc = q^j * sum_(<=j) u * q^-j, a running sum over
   partitionBy(Ticker, blk) - plain Spark aggregation, no Python.
3. A whole block is the map (q^B, loc of its last row). The maps of the blocks
   before a row are composed in order, from 0 on, to the value E that enters
   its block; every block takes part, nothing is dropped.
4. The row's map is applied to it: y = loc + q^(j+1) * E.

B only has to keep q^-B from overflowing (<= 2^900); any smaller size gives the
same values. The default is the largest size that suits all ratios, so that a
ticker has few blocks (a handful a century) and all recurrences share one
pass. All windows run on data already hash-partitioned by Ticker (no new
exchange); steps 2 and 3 share one sort on (Ticker, blk, i).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import TICKER

_HIGH_BITS = 900   # q^-B must stay below 2^900 (double overflows at 2^1024)


@dataclass(frozen=True)
class Recurrence:
    """y = u + q * y_prev; ``u`` is 0 on rows before the recurrence starts."""

    out: str
    u: Column
    q: float


def block_range(q: float) -> tuple[int, int]:
    """Smallest and largest admissible block size for ratio q (0 < q < 1)."""
    return 1, max(1, math.floor(_HIGH_BITS * math.log(2) / -math.log(q)))


def common_block(qs: list[float], block: int | None = None) -> int | None:
    """The block size of a set of ratios: ``block`` cut to what they admit, by
    default the largest they admit (None if no ratio is positive). With it all
    recurrences of a feature set - and every other window of it - can be ordered
    by (block, index): one sort."""
    admitted = [block_range(q)[1] for q in qs if q > 0.0]
    if not admitted:
        return None
    return min(admitted) if block is None else max(1, min(block, *admitted))


def linear_scan(df: DataFrame, recs: list[Recurrence], *, index: str = "_i",
                part: str | tuple = TICKER, block: int | None = None, blk_col: str | None = None) -> DataFrame:
    """Add one column per recurrence. ``index`` is 0..n-1, contiguous per ``part``.

    With ``blk_col`` the caller has already cut the series into blocks of
    ``block`` rows (column = index div block) and ordered its own windows by
    (blk_col, index); every recurrence then shares that block size.
    """
    if not recs:
        return df
    for r in recs:
        if not (0.0 <= r.q < 1.0):
            raise ValueError(f"recurrence {r.out}: ratio must be in [0, 1), got {r.q}")
    keep = list(df.columns)
    trivial = [r for r in recs if r.q == 0.0]
    scans = [r for r in recs if r.q > 0.0]
    if trivial:
        df = df.select("*", *[r.u.alias(r.out) for r in trivial])
        keep += [r.out for r in trivial]
    if blk_col is not None and (block is None or (scans and common_block([r.q for r in scans], block) != block)):
        raise ValueError("blk_col needs a block size admissible for every recurrence")
    if scans:
        df = _scan_pass(df, scans, index, part, common_block([r.q for r in scans], block), blk_col)
        keep += [r.out for r in scans]
    return df.select(*keep)


def _scan_pass(df: DataFrame, recs: list[Recurrence], index: str, part: str, b: int,
               blk_col: str | None = None) -> DataFrame:
    i = F.col(index)
    blk = F.floor(i / F.lit(b)).cast("long") if blk_col is None else F.col(blk_col)
    extra = [] if blk_col == "_blk" else [blk.alias("_blk")]
    d = df.select("*", *[r.u.cast("double").alias(f"_u_{r.out}") for r in recs], *extra,
                  (i - blk * F.lit(b)).alias("_j"))
    j = F.col("_j")
    parts = [part] if isinstance(part, str) else list(part)
    in_block = Window.partitionBy(*parts, "_blk").orderBy(index) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*parts).orderBy("_blk", index) \
        .rowsBetween(Window.unboundedPreceding, -1)
    locs = [
        (F.pow(F.lit(r.q), j) * F.sum(F.col(f"_u_{r.out}") * F.pow(F.lit(r.q), -j)).over(in_block))
        .alias(f"_loc_{r.out}")
        for r in recs
    ]
    d = d.select("*", *locs)
    # maps of the blocks before, composed to the value that enters this one (one
    # projection: the window result is used inside the arithmetic directly)
    def entering(r: Recurrence) -> Column:
        ends = F.collect_list(F.when(j == b - 1, F.col(f"_loc_{r.out}"))).over(before)
        return F.aggregate(ends, F.lit(0.0), lambda y, loc: y * F.lit(r.q ** b) + loc)

    outs = [(F.col(f"_loc_{r.out}") + F.pow(F.lit(r.q), j + 1) * entering(r)).alias(r.out) for r in recs]
    return d.select(*df.columns, *outs)
