"""Leaf-wise histogram boosting for regression (M4) and stopping by patience.

Inputs are cut into bins once. A tree grows from one leaf: every leaf has a
histogram (sum of gradients and rows per input and bin), prefix sums over the bins
give the gain of every cut, and the leaf with the largest gain is split next
until the tree has ``numLeaves`` leaves. Splitting one leaf changes no other, so
the histograms of all leaves of a depth come from one grouped aggregate, the best
cut of each leaf from a window over its bins, and the driver sees one row a
leaf; best-first order is decided there, on those rows. Gradients are
summed as decimals in units of the largest label, so that on given bins trees do
not depend on the order or the partitions of the rows.

Rows stay where they are: a round adds the new tree's value to a column as an
expression over the bins; every ``KEPT`` rounds the rows are written and read
again. With validation rows and ``patience`` the error of every round is measured
on them, rounds end when it has not improved for ``patience`` rounds, and the
trees up to the best round are kept.

Defined cases: a missing or NaN input goes left in every cut; an input with one
value is never cut; a leaf keeps at least ``minRows`` rows; without a cut of
positive gain the tree is a single leaf; equal gains go to the smaller input,
then the smaller bin; no rows is an error.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

KEPT = 10  # rounds after which the rows are written again


class _Settings(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize):
    numLeaves = Param(Params._dummy(), "numLeaves", "leaves of a tree at most", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree at most", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of an input at most", TypeConverters.toInt)
    minRows = Param(Params._dummy(), "minRows", "rows of a leaf at least", TypeConverters.toInt)
    ridge = Param(Params._dummy(), "ridge", "added to a leaf's rows in its value", TypeConverters.toFloat)
    binning = Param(Params._dummy(), "binning", "quantile or width", TypeConverters.toString)
    validationCol = Param(Params._dummy(), "validationCol", "flag of rows that only measure", TypeConverters.toString)
    patience = Param(Params._dummy(), "patience", "rounds without a better error; 0: all rounds", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(maxIter=100, numLeaves=31, maxDepth=6, stepSize=0.1, maxBins=64, minRows=20, ridge=0.0,
                         binning="quantile", validationCol="", patience=0)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)


def bin_edges(df: DataFrame, inputs: list[str], bins: int, binning: str) -> list[list[float]]:
    """Upper bounds of all bins but the last, ascending; one aggregate for all inputs."""
    if binning == "quantile":
        at = [k / bins for k in range(1, bins)]
        aggs = [F.percentile_approx(F.when(~F.isnan(x), F.col(x)), at, 100 * bins).alias(x) for x in inputs]
        found = df.agg(*aggs).first()
        return [sorted(set(found[x] or [])) for x in inputs]
    if binning != "width":
        raise ValueError(f"binning must be quantile or width, got {binning!r}")
    known = [F.when(~F.isnan(x), F.col(x)) for x in inputs]
    found = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(known) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i in range(len(inputs)):
        lo, hi = found[f"lo{i}"], found[f"hi{i}"]
        out.append([] if lo is None or lo == hi else [lo + (hi - lo) * k / bins for k in range(1, bins)])
    return out


def _bin(x: Column, edges: list[float]) -> Column:
    """0-based bin: how many edges are below the value; missing values are in bin 0."""
    if not edges:
        return F.lit(0)
    above = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x))
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(above)


# A tree is a nested dict: {"leaf": id, "value": v} or {"input", "bin", "low", "high"}.

def leaf_of(tree: dict, bins: list[Column]) -> Column:
    if "leaf" in tree:
        return F.lit(tree["leaf"])
    return F.when(bins[tree["input"]] <= tree["bin"], leaf_of(tree["low"], bins)).otherwise(leaf_of(tree["high"], bins))


def value_of(tree: dict, bins: list[Column]) -> Column:
    if "leaf" in tree:
        return F.lit(float(tree["value"]))
    return F.when(bins[tree["input"]] <= tree["bin"], value_of(tree["low"], bins)).otherwise(value_of(tree["high"], bins))


def best_cuts(rows: DataFrame, leaf: Column, bins: list[str], gradient: Column, min_rows: int, ridge: float) -> dict[int, dict]:
    """Per leaf its rows and gradient, and its best cut if one has a positive gain."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("input"), F.col(b).alias("bin")) for i, b in enumerate(bins)]))
    histogram = (rows.select(leaf.alias("leaf"), gradient.cast("decimal(28, 16)").alias("g"), each.alias("x"))
                 .groupBy("leaf", "x.input", "x.bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")))
    line = Window.partitionBy("leaf", "input")
    upto = line.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = (histogram.select("leaf", "input", "bin", F.sum("n").over(upto).alias("nl"), F.sum("n").over(line).alias("n"),
                             F.sum("g").over(upto).cast("double").alias("gl"), F.sum("g").over(line).cast("double").alias("g")))
    power = lambda g, n: g * g / (n + F.lit(ridge))
    gain = power(F.col("gl"), F.col("nl")) + power(F.col("g") - F.col("gl"), F.col("n") - F.col("nl")) - power(F.col("g"), F.col("n"))
    allowed = (F.col("nl") >= min_rows) & (F.col("n") - F.col("nl") >= min_rows)
    cut = F.when(allowed & (gain > 0), F.struct(gain.alias("gain"), (-F.col("input")).alias("input"), (-F.col("bin")).alias("bin"), "nl", "gl"))
    best = sums.groupBy("leaf").agg(F.max("n").alias("n"), F.first("g").alias("g"), F.max(cut).alias("cut")).collect()
    return {r["leaf"]: {"n": r["n"], "g": r["g"], "cut": r["cut"]} for r in best}


def grow(rows: DataFrame, bins: list[str], gradient: Column, leaves: int, depth: int, min_rows: int, ridge: float) -> dict:
    """One tree, best leaf first, from one aggregate per depth.

    A node is only reached after the nodes above it, so the splits that best-first
    order makes are those with the largest gain on the narrowest place of their
    path. Level by level, the children of every node that can still be among
    the first ``leaves - 1`` are measured in one aggregate; then the order is
    played through on the known gains.
    """
    columns = [F.col(b) for b in bins]
    root = best_cuts(rows, F.lit(0), bins, gradient, min_rows, ridge)[0]
    nodes = [{"n": root["n"], "g": root["g"], "cut": root["cut"], "narrow": root["cut"]["gain"] if root["cut"] else 0.0}]

    def tree(i: int, chosen) -> dict:
        node = nodes[i]
        if "low" not in node or i not in chosen:
            return {"leaf": i, "value": node["g"] / (node["n"] + ridge)}
        return {"input": -node["cut"]["input"], "bin": -node["cut"]["bin"],
                "low": tree(node["low"], chosen), "high": tree(node["high"], chosen)}

    level, reached = [0], 0
    while level and reached < depth:
        known = sorted((x["narrow"] for x in nodes if x["cut"]), reverse=True)
        bar = known[leaves - 2] if 0 < leaves - 1 <= len(known) else 0.0
        level = [i for i in level if nodes[i]["cut"] and nodes[i]["narrow"] >= bar and leaves > 1]
        below = []
        for i in level:
            at, cut = nodes[i], nodes[i]["cut"]
            at["low"], at["high"] = len(nodes), len(nodes) + 1
            for n, g in ((cut["nl"], cut["gl"]), (at["n"] - cut["nl"], at["g"] - cut["gl"])):
                below.append(len(nodes))
                nodes.append({"n": n, "g": g, "cut": None, "narrow": 0.0, "above": at["narrow"]})
        reached += 1
        if below and reached < depth:
            leaf = leaf_of(tree(0, range(len(nodes))), columns)
            held = rows.withColumn("leaf", leaf).where(F.col("leaf").isin(below))
            for i, found in best_cuts(held, F.col("leaf"), bins, gradient, min_rows, ridge).items():
                if found["cut"]:
                    nodes[i].update(cut=found["cut"], narrow=min(nodes[i]["above"], found["cut"]["gain"]))
        level = below

    queue, chosen = [(-nodes[0]["narrow"], 0)], set()
    while queue and len(chosen) < leaves - 1:
        _, i = heapq.heappop(queue)
        if "low" in nodes[i]:
            chosen.add(i)
            for j in (nodes[i]["low"], nodes[i]["high"]):
                if nodes[j]["cut"]:
                    heapq.heappush(queue, (-nodes[j]["cut"]["gain"], j))
    return tree(0, chosen)


def _scaled(tree: dict, by: float) -> dict:
    if "leaf" in tree:
        return {"leaf": tree["leaf"], "value": tree["value"] * by}
    return {**tree, "low": _scaled(tree["low"], by), "high": _scaled(tree["high"], by)}


class LeafwiseRegressor(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Leaf-wise boosted trees on squared error."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._set(**self._input_kwargs)

    def setParams(self, **kwargs):
        return self._set(**kwargs)

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def setLabelCol(self, value):
        return self._set(labelCol=value)

    def setPredictionCol(self, value):
        return self._set(predictionCol=value)

    def _fit(self, dataset: DataFrame) -> "LeafwiseModel":
        get = self.getOrDefault
        label, flag = F.col(get("labelCol")).cast("double"), get("validationCol")
        size = dataset.select(F.size(vector_to_array(get("featuresCol"))).alias("k")).first()
        if size is None:
            raise ValueError("no rows to fit")
        inputs = [f"x{i}" for i in range(size["k"])]
        rows = dataset.select(vector_to_array(get("featuresCol")).alias("x"), label.alias("y"),
                              (F.col(flag) if flag else F.lit(False)).alias("measures"))
        rows = rows.select(*[F.col("x")[i].alias(c) for i, c in enumerate(inputs)], "y", "measures").where("y is not null and not isnan(y)")
        fits = ~F.col("measures")
        edges = bin_edges(rows.where(fits), inputs, get("maxBins"), get("binning"))
        bins = [f"b{i}" for i in range(len(inputs))]
        rows = written(rows.select(*[_bin(F.col(c), e).alias(b) for c, e, b in zip(inputs, edges, bins)], "y", "measures"), "boost")
        most = rows.where(fits).agg(F.max(F.abs("y")).alias("most")).first()["most"]
        if most is None:
            raise ValueError("no rows to fit")
        unit = most or 1.0
        total = rows.where(fits).agg(F.sum((F.col("y") / unit).cast("decimal(28, 16)")).alias("s"), F.count("y").alias("n")).first()
        mean = float(total["s"]) / total["n"] * unit
        rows = rows.withColumn("f", F.lit(mean))
        trees, errors, best = [], [], 0
        for k in range(get("maxIter")):
            if k and k % KEPT == 0:
                rows = written(rows, "boost")
            gradient = (F.col("y") - F.col("f")) / F.lit(unit)
            tree = grow(rows.where(fits), bins, gradient, get("numLeaves"), get("maxDepth"), get("minRows"), get("ridge"))
            tree = _scaled(tree, unit * get("stepSize"))
            trees.append(tree)
            rows = rows.withColumn("f", F.col("f") + value_of(tree, [F.col(b) for b in bins]))
            if flag:
                error = rows.where("measures").agg(F.avg((F.col("y") - F.col("f")) * (F.col("y") - F.col("f"))).alias("e")).first()["e"]
                errors.append(math.inf if error is None else error)
                if errors[-1] < errors[best]:
                    best = k
                if get("patience") and k - best >= get("patience"):
                    break
        kept = trees[:best + 1] if flag and errors and errors[best] < math.inf else trees
        model = LeafwiseModel(json.dumps({"start": mean, "edges": edges, "trees": kept, "errors": errors}))
        return self._copyValues(model)


class LeafwiseModel(Model, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Trees over bins as one JSON text: start, edges, trees, validation error per round."""

    ensemble = Param(Params._dummy(), "ensemble", "start, edges and trees as JSON", TypeConverters.toString)

    def __init__(self, ensemble: str | None = None):
        super().__init__()
        if ensemble is not None:
            self._set(ensemble=ensemble)

    @property
    def parts(self) -> dict:
        return json.loads(self.getOrDefault("ensemble"))

    @property
    def rounds(self) -> int:
        return len(self.parts["trees"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts, x = self.parts, vector_to_array(self.getOrDefault("featuresCol"))
        names = [f"_bin_{self.uid}_{i}" for i in range(len(parts["edges"]))]
        df = dataset.select("*", *[_bin(x[i], e).alias(n) for i, (e, n) in enumerate(zip(parts["edges"], names))])
        total = F.lit(float(parts["start"]))
        for tree in parts["trees"]:
            total = total + value_of(tree, [F.col(f"`{n}`") for n in names])
        return df.withColumn(self.getOrDefault("predictionCol"), total).drop(*names)


def patient_rounds(errors: list[float], patience: int) -> int:
    """How many rounds to keep: up to the smallest error before the first run of
    ``patience`` rounds without a better one."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif patience and k - best >= patience:
            break
    return best + 1
