"""Features kept up to date batch by batch (S12, I3), from indicator state.

Next to the bars a table holds, per bar, its row number and the value of every
recurrence (EMA, Wilder sums, signal line). A batch computes only its own days:
for each of its tickers the state of the last bar before the batch's first day
and the ``CONTEXT`` bars behind it, which the trailing windows need, are read
from the newest period back; the recurrences go on from the state. A corrected
day is the same case: the state before it is still there, so the ticker is
rewound to it and its bars from that day on are computed again.

A ticker with no more than ``CONTEXT`` bars before the batch is computed from its
first bar. Bars, features and state are versioned tables; a batch that fails
midway is repeated as a whole and gives the same tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import compute_features, state_columns
from ..schema import BAR_COLUMNS
from ..session import written
from ..sources.store import BarStore, VersionedTable

CONTEXT = 64  # bars behind the state: no indicator looks back further


class IncrementalFeatures:
    """Bars, features and indicator state under one root folder."""

    def __init__(self, spark: SparkSession, root: str, names: Iterable[str], context: int = CONTEXT, **layout) -> None:
        self.spark, self.names, self.context = spark, list(names), context
        self.recurrences = state_columns(self.names)
        key = [T.StructField("Ticker", T.StringType(), False), T.StructField("Date", T.DateType(), False)]
        double = lambda ns: [T.StructField(n, T.DoubleType()) for n in ns]
        self.bars = BarStore(spark, f"{root}/bars", **layout)
        self.features = VersionedTable(spark, f"{root}/features", T.StructType(key + double(self.names)), ("Ticker", "Date"), **layout)
        self.state = VersionedTable(spark, f"{root}/state", T.StructType([*key, T.StructField("_i", T.LongType()), *double(self.recurrences)]),
                                    ("Ticker", "Date"), **layout)

    def frame(self, firsts: DataFrame) -> DataFrame:
        """What a batch reads: per ticker the context before its first new day and
        the bars from that day on, with the state to go on from."""
        before = firsts.select("Ticker", F.col("first").alias("before"))
        state = self.state.newest(1, before).select("Ticker", F.col("_i").alias("_seed_i"), F.struct(*self.recurrences).alias("_seeds"))
        start = firsts.agg(F.min("first").alias("d")).first()["d"]
        changed = self.bars.table.read(start=None if start is None else str(start)).join(firsts, "Ticker").where("Date >= first")
        context = self.bars.table.newest(self.context, before).join(firsts, "Ticker")
        rows = context.unionByName(changed).join(state, "Ticker", "left")
        seeded = F.coalesce(F.col("_seed_i") >= self.context, F.lit(False))  # more bars before than the context holds
        return rows.select(*BAR_COLUMNS, "first", F.when(seeded, F.col("_seed_i") + 1 - self.context).otherwise(0).alias("_base"),
                           (~seeded | (F.col("Date") >= F.col("first"))).alias("_live"),
                           F.when(seeded, F.col("_seed_i")).otherwise(-1).alias("_seed_i"),
                           F.when(seeded, F.col("_seeds")).alias("_seeds"))

    def ingest(self, batch: DataFrame) -> int:
        """Store a batch of bars and bring features and state up to date; returns its rows."""
        batch = written(batch.select(*BAR_COLUMNS), "batch")
        n = self.bars.upsert(batch)
        if not n:
            return 0
        firsts = written(batch.groupBy("Ticker").agg(F.min("Date").alias("first")), "firsts")
        made = compute_features(self.frame(firsts), self.names, keep=("first",), state=True)
        made = written(made.where("Date >= first").drop("first"), "made")
        self.features.upsert(made.select("Ticker", "Date", *self.names))
        self.state.upsert(made.select("Ticker", "Date", "_i", *self.recurrences))
        return n
