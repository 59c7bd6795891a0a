"""Random forest on sparse rows: bootstrapped trees with exact splits, each node over its own random terms.

A pass per level serves all trees. A task finds the node of its rows in every tree, keeps the cells whose term the node has drawn,
and counts them by (tree and node, term, value) and label; rows without a cell are what is missing from the node's total. So no row
is spread over all terms, and what is shuffled are the counts of the cells drawn, about one term in the square root of all for a tree.
The draws and the bootstrap follow from hashes of the seed, so every task makes them for itself.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.plans.splits import best_borders
from newsframe.session import discard, materialise

ROWS = 1024  # rows whose values of all split terms a task holds at once
POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(19)])


def _cells(features: str = "features"):
    """Indices and values of sparse and dense vectors, and the number of their columns."""
    cells = F.unwrap_udt(F.col(features))
    dense = cells["type"] == 1
    return (F.when(dense, F.transform(cells["values"], lambda _, at: at)).otherwise(cells["indices"]), cells["values"],
            F.when(dense, F.size(cells["values"])).otherwise(cells["size"]))


def _flat(indices: pa.ListArray, values: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and value of every cell that is not zero."""
    owner = np.repeat(np.arange(len(indices)), np.diff(indices.offsets.to_numpy()))
    at, value = (part.flatten().to_numpy(zero_copy_only=False) for part in (indices, values))
    kept = value != 0
    return owner[kept], at[kept], value[kept]


def bootstrap(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often every row is drawn for every tree: Poisson numbers of mean 1 from a hash of row, tree and seed."""
    with np.errstate(over="ignore"):
        mixed = (rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        mixed = mixed + np.uint64(seed % (1 << 32)) * np.uint64(0x8CB92BA72F3D8DD7)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed = mixed ^ (mixed >> np.uint64(31))
    return np.searchsorted(POISSON, (mixed >> np.uint64(11)) * 2.0 ** -53, side="right")


def drawn(size: int, trees: int, seed: int, tree: int, node: int) -> np.ndarray:
    """The terms that a node may split on: the square root of all in a forest, all in a single tree."""
    if trees == 1:
        return np.arange(size)
    return np.random.default_rng([seed, tree, node]).choice(size, math.ceil(math.sqrt(size)), replace=False, shuffle=False)


def _nodes(term: np.ndarray, threshold: np.ndarray, depth: int, owner, at, value, rows: int) -> np.ndarray:
    """The node of every row in every tree; ``term`` is -1 where a node has no split (yet)."""
    trees, every = np.arange(len(term)), np.arange(rows)[:, None]
    used = np.unique(term[term >= 0])
    table = np.zeros((rows, len(used) + 1))
    place = np.searchsorted(used, at)
    hit = np.append(used, -1)[place] == at
    table[owner[hit], place[hit]] = value[hit]
    column = np.searchsorted(used, term)
    node = np.ones((rows, len(term)), np.int64)
    for _ in range(depth):
        right = table[every, column[trees, node]] > threshold[trees, node]
        node = np.where(term[trees, node] >= 0, 2 * node + right, node)
    return node


@dataclass
class ForestModel:
    """Adds ``probability`` of both classes, the mean of the trees' shares, and ``prediction``; an even vote gives class 0."""
    depth: int
    term: np.ndarray
    threshold: np.ndarray
    share: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        depth, term, threshold, share = self.depth, self.term, self.threshold, self.share

        @F.pandas_udf("double")
        def vote(indices: pd.Series, values: pd.Series) -> pd.Series:
            found = []
            for start in range(0, len(indices), ROWS):
                at, value = (list(part.iloc[start:start + ROWS]) for part in (indices, values))
                owner = np.repeat(np.arange(len(at)), [len(one) for one in at])
                node = _nodes(term, threshold, depth, owner, np.concatenate(at).astype(np.int64), np.concatenate(value), len(at))
                found.append((share[np.arange(len(term)), node] - 0.5).sum(axis=1))
            return pd.Series(np.concatenate(found) if found else np.zeros(0))

        indices, values, _ = _cells()
        one = 0.5 + F.col("_vote") / len(term)
        return (df.withColumn("_vote", vote(indices, values)).withColumn("probability", array_to_vector(F.array(1 - one, one)))
                .withColumn("prediction", (F.col("_vote") > 0).cast("double")).drop("_vote"))


@dataclass
class SparseForest:
    """Forest of ``trees`` trees with at most ``depth`` levels of splits for the labels 0 and 1."""
    depth: int = 5
    trees: int = 100
    seed: int = 0

    def fit(self, train: DataFrame) -> ForestModel:
        indices, values, size = _cells()
        # Stored with a number for every row: the bootstrap has to draw the same rows at every level.
        rows = materialise(train.select("label", indices.alias("indices"), values.alias("values"), F.monotonically_increasing_id().alias("_row")))
        n, known = rows.agg(F.count("*"), F.count("label")).first()
        if known < n or not n:
            raise ValueError("every row needs a label, and there must be rows")
        size, width, trees = train.select(size.alias("size")).first()["size"], 2 << self.depth, self.trees
        term, threshold, share = np.full((trees, width), -1, np.int64), np.zeros((trees, width)), np.zeros((trees, width))
        live = [(tree, 1) for tree in range(trees)]
        for level in range(self.depth + 1):
            counts = materialise(self._counts(rows, size, term, threshold, live, level).groupBy("node", "index", "value").agg(
                F.sum("w0").alias("w0"), F.sum("w1").alias("w1")))
            totals = counts.filter("index < 0").select("node", F.col("w0").alias("t0"), F.col("w1").alias("t1"))  # a row per node of a level
            mixed = {}
            for row in totals.collect():
                tree, node = divmod(row["node"], width)
                share[tree, node] = row["t1"] / (row["t0"] + row["t1"])
                mixed[tree, node] = row["t0"] > 0 and row["t1"] > 0
            fresh = []
            if level < self.depth and size:
                for row in best_borders(counts.filter("index >= 0"), totals).collect():  # a row per node of a level
                    tree, node = divmod(row["node"], width)
                    if mixed[tree, node]:
                        term[tree, node], threshold[tree, node] = row["index"], row["threshold"]
                        fresh += [(tree, 2 * node), (tree, 2 * node + 1)]
            discard(counts)
            live = fresh
            if not live:
                break
        discard(rows)
        return ForestModel(self.depth, term, threshold, share)

    def _counts(self, rows: DataFrame, size: int, term: np.ndarray, threshold: np.ndarray, live: list, level: int) -> DataFrame:
        """(node, index, value, w0, w1) of the drawn cells, and the totals of the nodes under the index -1; node is tree * width + number."""
        depth, trees, seed, width = self.depth, self.trees, self.seed, term.shape[1]
        splits = level < depth

        def counted(batches):
            terms = [drawn(size, trees, seed, tree, node) for tree, node in live] if splits else []
            codes = np.repeat([tree * width + node for tree, node in live], [len(own) for own in terms]) if splits else np.zeros(0, np.int64)
            terms = np.concatenate(terms) if splits else np.zeros(0, np.int64)
            order = np.argsort(terms, kind="stable")
            codes, (distinct, starts) = codes[order], np.unique(terms[order], return_index=True)
            ends = np.append(starts[1:], len(codes))
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    owner, at, value = _flat(batch.column("indices"), batch.column("values"))
                    label = batch.column("label").to_numpy(zero_copy_only=False) > 0
                    node = _nodes(term, threshold, depth, owner, at, value, batch.num_rows)
                    weight = np.where(node >= 1 << level, bootstrap(batch.column("_row").to_numpy(), trees, seed), 0)
                    node = node + np.arange(trees) * width
                    row, tree = np.nonzero(weight)
                    parts = [(node[row, tree], np.full(len(row), -1), np.zeros(len(row)), weight[row, tree], label[row])]
                    place = np.searchsorted(distinct, at)
                    hit = np.flatnonzero(np.append(distinct, -1)[place] == at)
                    many = ends[place[hit]] - starts[place[hit]]
                    cell = np.repeat(hit, many)
                    code = codes[np.repeat(starts[place[hit]] - (np.cumsum(many) - many), many) + np.arange(len(cell))]
                    row, tree = owner[cell], code // width
                    kept = (node[row, tree] == code) & (weight[row, tree] > 0)
                    cell, code, row, tree = cell[kept], code[kept], row[kept], tree[kept]
                    parts.append((code, at[cell], value[cell], weight[row, tree], label[row]))
                    node_, index, number, weight, label = (np.concatenate(part) for part in zip(*parts, strict=True))
                    sums = pa.table({"node": node_.astype(np.int64), "index": index.astype(np.int64), "value": number,
                                     "w0": weight * ~label * 1.0, "w1": weight * label * 1.0}).group_by(["node", "index", "value"]).aggregate([("w0", "sum"), ("w1", "sum")])
                    yield from sums.select(["node", "index", "value", "w0_sum", "w1_sum"]).rename_columns(["node", "index", "value", "w0", "w1"]).combine_chunks().to_batches()

        return rows.mapInArrow(counted, "node long, index long, value double, w0 double, w1 double")
