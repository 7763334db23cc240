"""Connected components of a link table by min-label joins with pointer jumping.

Each round a node takes the smallest label among itself and its neighbours,
then the label of that label. Rounds are written to the shared folder, so a
lost executor costs at most one round. Nodes are longs; links with a null end
are ignored, self links and repeats do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of ``links``; comp is the component's smallest node."""
    ab = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    edges = stored(ab.union(ab.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        step = labels.join(near, "node").select("node", F.least("comp", "m").alias("c"), F.col("comp").alias("old"))
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = stored(step.join(jump, "c").select("node", F.least("c", "cc").alias("comp"), "old"), "labels")
        if new.where("comp != old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
