"""One sigmoid unit over the vectors of padded sequences, one after the other, fitted from the numbers of the words.

A row of ``m`` words and vectors of ``d`` numbers has m * d features, but only m numbers of its own: the vectors are frozen and
belong to the model. The fit keeps the numbers. In a task the weights of a place times the vectors give a table of what every
word adds at that place, a row's margin is the sum of m of its cells, and the slope is the sum of the rests at every (place, word)
times the vectors. No row is ever made as long as its features.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.plans.paths import _Run

ROWS = 10_000  # rows that a task goes through in a scan


@dataclass
class FlatUnit:
    """Adds ``probability`` of both classes and ``prediction`` to rows with the vectors of ``features.embedded_sequences``."""
    weights: np.ndarray
    bias: float

    def transform(self, df: DataFrame) -> DataFrame:
        parts = ElementwiseProduct(scalingVec=Vectors.dense(self.weights), inputCol="features", outputCol="_parts").transform(df)
        rows = parts.withColumn("_margin", F.aggregate(vector_to_array("_parts"), F.lit(self.bias), lambda total, x: total + x))
        one = 1 / (1 + F.exp(-F.col("_margin")))
        return (rows.withColumn("probability", array_to_vector(F.array(1 - one, one)))
                .withColumn("prediction", (F.col("_margin") > 0).cast("double")).drop("_parts", "_margin"))


@dataclass
class FrozenEmbeddings:
    """Logistic regression without a penalty on standardised features, from rows with ``label`` and ``sequence``.

    ``vectors`` has the vector of number i in row i; other numbers, such as the padding, count as zeros. It is sent to the tasks once
    and has as many rows as the index of the words, which ``sequence_index`` bounds.
    """
    vectors: np.ndarray
    max_iter: int = 100
    tol: float = 1e-6

    def fit(self, train: DataFrame) -> FlatUnit:
        rows = train.select(F.col("label").cast("double").alias("label"), "sequence")
        n, ones, known = rows.agg(F.count("*"), F.sum("label"), F.count("label")).first()
        if known < n or not n:
            raise ValueError("every row needs a label, and there must be rows")
        length, (words, dimensions) = rows.select(F.size("sequence")).first()[0], self.vectors.shape
        if ones in (0, n):
            return FlatUnit(np.zeros(length * dimensions), float("inf") if ones else float("-inf"))
        rows = rows.repartition(-(-n // ROWS)).persist()
        sent = rows.sparkSession.sparkContext.broadcast(self.vectors.astype(float))

        def scan(work, *numbers):
            """Sums over all tasks of what ``work(label, places, vectors, numbers)`` gives."""
            def summed(batches):
                total = 0.0
                for batch in batches:
                    words_ = batch.column("sequence").flatten().to_numpy().reshape(-1, length)
                    words_ = np.where((words_ > 0) & (words_ < words), words_, 0)
                    total = total + work(batch.column("label").to_numpy(), words_ + np.arange(length) * words, sent.value, *numbers)
                if not np.isscalar(total):
                    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

            # A number or two for every feature from every task, as the driver has them in its weights.
            return sum(np.frombuffer(row["sums"]) for row in rows.mapInArrow(summed, "sums binary").collect())

        def moments(label, places, vectors):
            counts = np.bincount(places.ravel(), minlength=length * words).reshape(length, words)
            return np.concatenate([(counts @ vectors).ravel(), (counts @ vectors ** 2).ravel()])

        def slopes(label, places, vectors, weights, bias):
            margin = (weights.reshape(length, dimensions) @ vectors.T).ravel()[places].sum(axis=1) + bias
            rest = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - label
            sums = np.bincount(places.ravel(), np.repeat(rest, length), minlength=length * words).reshape(length, words)
            return np.concatenate([(sums @ vectors).ravel(), [rest.sum(), np.logaddexp(0, np.where(label > 0, -margin, margin)).sum()]])

        first, second = np.split(scan(moments), 2)
        mean = first / n
        spread = np.sqrt(np.maximum(second - n * mean ** 2, 0) / max(n - 1, 1))
        scale = np.where(spread > 1e-9, 1 / np.where(spread > 1e-9, spread, 1), 0)  # features that never change get no weight
        run = _Run(np.append(np.zeros(len(mean)), np.log(ones / (n - ones))))

        def plain(point):
            weights = point[:-1] * scale
            return weights, float(point[-1] - weights @ mean)

        while not run.done:
            found = scan(slopes, *plain(run.tried())) / n
            slope = np.append((found[:-2] - mean * found[-2]) * scale, found[-2])
            if run.slope is None:
                run.first = float(np.linalg.norm(slope))
            run.take(found[-1], slope, self.tol, self.max_iter)
        rows.unpersist()
        sent.destroy()
        return FlatUnit(*plain(run.point))
