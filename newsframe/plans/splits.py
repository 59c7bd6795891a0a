"""Decision trees and boosted stumps on sparse rows, with exact splits from one aggregation per level.

The cells of all rows are counted by (node, term, value) and label. Rows without a cell have the value 0: their weights are
what is missing from the node's total, so no dense column is ever made and every value is tried as a border, not a number
of bins. Rows find their node, and their boosted weight, by an expression made of the splits so far.
"""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsframe.plans.paths import sparse_rows


def _value(index: int) -> Column:
    """The row's value of a term, 0 where it has no cell."""
    place = F.array_position("indices", F.lit(index).cast("int")).cast("int")
    return F.coalesce(F.get("values", place - 1), F.lit(0.0))


def best_splits(rows: DataFrame, node: Column, weight: Column) -> DataFrame:
    """(node, index, threshold, gain): the split of every node that lowers the Gini impurity the most, where one does.

    ``rows`` has label (0 or 1), indices and values, which are not negative. Rows go right above the threshold, which lies
    half way between two values. Ties, up to 12 digits of the gain, go to the lower term and then the lower threshold.
    """
    marked = rows.select(node.alias("node"), "label", weight.cast("double").alias("w"), "indices", "values")
    named = lambda prefix: [F.coalesce(F.sum(F.when(F.col("label") == label, F.col("w"))), F.lit(0.0)).alias(f"{prefix}{label}")
                            for label in (0, 1)]
    totals = marked.groupBy("node").agg(*named("t"))  # a row per node
    cells = marked.select("node", "label", "w", F.inline(F.arrays_zip("indices", "values")).alias("index", "value")).filter("value > 0")
    counts = cells.groupBy("node", "index", "value").agg(*named("w"))
    return best_borders(counts, totals)


def best_borders(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(node, index, threshold, gain) from the weights (node, index, value, w0, w1) of the values other than 0 and the nodes' (node, t0, t1).

    What is missing from a node's total has the value 0. Every value stands for the border between it and its neighbour towards 0.
    """
    term = Window.partitionBy("node", "index")  # the distinct values of a term in a node
    upto = term.orderBy("value")
    above = F.col("value") > 0
    near = F.when(above, F.greatest(F.lag("value").over(upto), F.lit(0.0))).otherwise(F.least(F.lead("value").over(upto), F.lit(0.0)))
    spread = counts.select(
        "node", "index", "value", near.alias("near"), above.alias("above"),
        *[(F.sum(f"w{label}").over(upto) - F.when(above, F.col(f"w{label}") + F.sum(f"w{label}").over(term)).otherwise(F.lit(0.0))).alias(f"d{label}") for label in (0, 1)])
    left = [F.when(F.col("above"), F.col(f"t{label}")).otherwise(F.lit(0.0)) + F.col(f"d{label}") for label in (0, 1)]
    right = [F.col(f"t{label}") - one for label, one in enumerate(left)]
    pure = lambda one, two: F.when(one + two > 1e-12, (one * one + two * two) / (one + two)).otherwise(0.0)
    total = F.col("t0") + F.col("t1")
    gain = F.round((pure(*left) + pure(*right) - pure(F.col("t0"), F.col("t1"))) / total, 12)
    tried = (spread.join(F.broadcast(totals), "node")  # totals: one row per node of small trees
             .filter((left[0] + left[1] > 1e-9) & (right[0] + right[1] > 1e-9)).select("node", "index", ((F.col("near") + F.col("value")) / 2).alias("threshold"), gain.alias("gain")))
    best = F.max(F.struct("gain", (-F.col("index")).alias("index"), (-F.col("threshold")).alias("threshold"))).alias("best")
    return tried.filter("gain > 0").groupBy("node").agg(best).select(
        "node", (-F.col("best.index")).alias("index"), (-F.col("best.threshold")).alias("threshold"), F.col("best.gain").alias("gain"))


@dataclass
class SplitTree:
    """Splits by node number (root 1, children 2n and 2n + 1) and the class of every leaf."""
    splits: dict = field(default_factory=dict)
    leaves: dict = field(default_factory=dict)

    def node(self, number: int = 1) -> Column:
        """The leaf of a row with ``indices`` and ``values``."""
        if number not in self.splits:
            return F.lit(number)
        index, threshold = self.splits[number]
        return F.when(_value(index) > threshold, self.node(2 * number + 1)).otherwise(self.node(2 * number))

    def guess(self) -> Column:
        ones = [number for number, label in self.leaves.items() if label == 1]
        return self.node().isin(ones).cast("double") if ones else F.lit(0.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return _with_arrays(df).withColumn("prediction", self.guess()).drop("indices", "values")


def _with_arrays(df: DataFrame) -> DataFrame:
    cells = F.unwrap_udt(F.col("features"))
    return df.withColumn("indices", cells["indices"]).withColumn("values", cells["values"])


def grow(rows: DataFrame, depth: int, weight: Column | None = None) -> SplitTree:
    """A tree of at most ``depth`` levels of splits; a pass per level and one for the leaves."""
    tree, weight = SplitTree(), F.lit(1.0) if weight is None else weight
    for level in range(depth):
        found = best_splits(rows, tree.node(), weight).collect()  # a row per node of the level
        fresh = {row["node"]: (row["index"], row["threshold"]) for row in found if row["node"] >= 1 << level}
        if not fresh:
            break
        tree.splits.update(fresh)
    sums = rows.select(tree.node().alias("node"), "label", weight.alias("w")).groupBy("node").agg(F.sum(F.col("w") * (2 * F.col("label") - 1)).alias("lean"))
    tree.leaves = {row["node"]: int(row["lean"] > 0) for row in sums.collect()}  # a row per leaf
    return tree


@dataclass
class ExactTree:
    """Decision tree with exact splits; equal votes in a leaf give class 0."""
    depth: int = 2

    def fit(self, train: DataFrame) -> SplitTree:
        rows = sparse_rows(train, ["label"]).persist()
        tree = grow(rows, self.depth)
        rows.unpersist()
        return tree


@dataclass
class VotingStumps:
    """Weighted vote of trees with one split."""
    stumps: list

    def transform(self, df: DataFrame) -> DataFrame:
        vote = F.lit(0.0)
        for tree, share in self.stumps:
            vote = vote + F.lit(share) * (2 * tree.guess() - 1)
        return _with_arrays(df).withColumn("prediction", (vote > 0).cast("double")).drop("indices", "values")


@dataclass
class ExactAdaBoost:
    """Discrete boosting of stumps: rows that a stump gets wrong weigh more for the next one.

    The weight of a row is an expression of the stumps so far. Boosting ends early at a stump without error, or with one
    that is wrong for half of the weight.
    """
    rounds: int = 2

    def fit(self, train: DataFrame) -> VotingStumps:
        rows, stumps, weight = sparse_rows(train, ["label"]).persist(), [], F.lit(1.0)
        for _ in range(self.rounds):
            tree = grow(rows, 1, weight)
            wrong = (tree.guess() != F.col("label")).cast("double")
            total, lost = rows.agg(F.sum(weight), F.sum(weight * wrong)).first()
            error = lost / total if total else 0.5
            if error <= 0 or error >= 0.5:
                if error <= 0 or not stumps:
                    stumps.append((tree, 1.0))
                break
            share = math.log((1 - error) / error)
            stumps.append((tree, share))
            weight = weight * F.exp(F.lit(share) * wrong)
        rows.unpersist()
        return VotingStumps(stumps)
