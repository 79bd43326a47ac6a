"""Gradient-boosted trees on binned features: histograms by grouped aggregates, splits level by level.

Features become bins by the quantiles of their group's training rows.  For each
tree and level the sums of residuals by (group, node, feature, bin) are one
aggregate, summed up where the rows lie first; running sums over the bins give
every split's gain, and the best one of each node is a row of a small table.
Rows find their node by joins with these tables.  The work grows with the rows;
what is brought together grows with groups x nodes x features x bins only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline import scratch
from barline.operators.quantiles import quantiles

#: Bins of a feature, boosting rounds, levels of a tree, learning rate, rows of a leaf at least, penalty on leaves.
SETTINGS = {"bins": 32, "trees": 20, "depth": 3, "rate": 0.1, "least": 20, "penalty": 1.0}


def _binned(df: DataFrame, features: Sequence[str], bins: int, by) -> DataFrame:
    """``_bins``: each feature's bin from 0; null has the last of all, ``bins``."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(features)))).alias("e")
    long = df.where("_train").select(*by, each).select(*by, F.col("e.f").alias("_f"), F.col("e.x").alias("_x"))
    edges = quantiles(long, "_x", [i / bins for i in range(1, bins)], (*by, "_f"), "_e")
    wide = edges.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_f", "_e"))).alias("_edges"))  # features x bins numbers a group

    def place(i: int, name: str):
        below = F.filter(F.col("_edges")[i], lambda edge: F.col(name).cast("double") > edge)
        return F.when(F.col(name).isNull(), bins).otherwise(F.coalesce(F.size(below), F.lit(0)))

    return df.join(wide, list(by), "left").withColumn("_bins", F.array(*(place(i, c) for i, c in enumerate(features)))).drop("_edges")


def _at_nodes(rows: DataFrame, splits: list[DataFrame], by) -> DataFrame:
    """Rows with ``_node``, 1 at the root, by the splits of the levels so far."""
    out = rows.withColumn("_node", F.lit(1).cast("long"))
    for level in splits:
        out = out.join(level, [*by, "_node"], "left")
        right = (F.get("_bins", F.col("_feature")) > F.col("_bin")).cast("long")
        out = out.withColumn("_node", F.when(F.col("_bin").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + right)).drop("_feature", "_bin")
    return out


def _splits(rows: DataFrame, least: int, penalty: float, by) -> DataFrame:
    """(by, _node, _feature, _bin): the best split of each node that has one; rows up to ``_bin`` go left."""
    cells = rows.where("_train").select(*by, "_node", "_rest", F.posexplode("_bins").alias("_feature", "_bin"))
    sums = cells.groupBy(*by, "_node", "_feature", "_bin").agg(F.sum("_rest").alias("g"), F.count(F.lit(1)).alias("n"))
    node = Window.partitionBy(*by, "_node", "_feature")
    upto = node.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = sums.select(*by, "_node", "_feature", "_bin", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"), F.sum("g").over(node).alias("ga"), F.sum("n").over(node).alias("na"))
    part = lambda g, n: g * g / (n + penalty)
    gain = part(F.col("gl"), F.col("nl")) + part(F.col("ga") - F.col("gl"), F.col("na") - F.col("nl")) - part(F.col("ga"), F.col("na"))
    best = F.max(F.struct(F.round(gain, 12).alias("gain"), (-F.col("_feature")).alias("f"), (-F.col("_bin")).alias("b")))
    found = sides.where((F.col("nl") >= least) & (F.col("na") - F.col("nl") >= least)).groupBy(*by, "_node").agg(best.alias("s")).where("s.gain > 0")
    return found.select(*by, "_node", (-F.col("s.f")).alias("_feature"), (-F.col("s.b")).alias("_bin"))


def boosted(df: DataFrame, features: Sequence[str], target: str, train: str, by=("sym", "fold"), output: str = "predicted", **settings: float) -> DataFrame:
    """``df`` with the prediction of a model for each group, fitted to rows where ``train`` (a condition) holds.

    Squared loss; of equal gains the first feature and bin wins.  Null features
    have a bin of their own, on the right of all splits; training rows without
    a target are left out of the fit; groups without training rows get null.
    Columns called ``predicted`` are replaced.
    """
    k = SETTINGS | settings
    keep = [c for c in df.columns if c != output]
    marked = df.select(*keep, F.coalesce(F.expr(train) & F.col(target).isNotNull(), F.lit(False)).alias("_train"))
    rows = _binned(marked, features, int(k["bins"]), by)
    base = marked.where("_train").groupBy(*by).agg(F.avg(F.col(target).cast("double")).alias("_sum"))
    rows = scratch.table(rows.join(base, list(by), "left"), "boosting")
    for _ in range(int(k["trees"])):
        rest = rows.withColumn("_rest", F.col(target).cast("double") - F.col("_sum"))
        splits: list[DataFrame] = []
        for _ in range(int(k["depth"])):
            splits.append(scratch.table(_splits(_at_nodes(rest, splits, by), int(k["least"]), k["penalty"], by), "splits"))
        placed = _at_nodes(rest, splits, by)
        leaf = placed.where("_train").groupBy(*by, "_node").agg((k["rate"] * F.sum("_rest") / (F.count(F.lit(1)) + k["penalty"])).alias("_leaf"))
        told = placed.join(leaf, [*by, "_node"], "left").withColumn("_sum", F.col("_sum") + F.coalesce("_leaf", F.lit(0.0)))
        rows = scratch.table(told.drop("_node", "_leaf", "_rest"), "boosting")
    return rows.select(*keep, F.col("_sum").alias(output))
