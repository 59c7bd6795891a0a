"""Binary metrics with 1 (fake) as the positive class."""

import time
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: list[str] | None = None) -> DataFrame:
    """(by..., tn, fp, fn, tp) in one aggregate."""
    y, guess = F.col(label).cast("int") == 1, F.col(prediction).cast("int") == 1
    cells = {"tn": ~y & ~guess, "fp": ~y & guess, "fn": y & ~guess, "tp": y & guess}
    return df.groupBy(*(by or [])).agg(*[F.count_if(cell).alias(name) for name, cell in cells.items()])


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
            by: list[str] | None = None) -> DataFrame:
    """(by..., acc, precision, recall, f1, tn, fp, fn, tp); 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    return confusion(df, label, prediction, by).select(
        *(by or []), _ratio(tp + tn, tp + tn + fp + fn).alias("acc"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "tn", "fp", "fn", "tp")


def at_threshold(score: Column, threshold: float = 0.5) -> Column:
    """1 above the threshold, else 0 (a score of one half rounds to the even 0)."""
    return (score > threshold).cast("int")


METRIC_COLUMNS = ("name string, split string, train_acc double, acc double, precision double, recall double, "
                  "f1 double, time double, confusion_matrix array<array<long>>")


def try_models(models: Iterable[tuple], data: DataFrame, fit: Callable | None = None, parallelism: int = 4) -> DataFrame:
    """Fits each (estimator, name) on the split ``train`` and scores all other splits of ``data``.

    ``data`` has the columns split, label and features and should be a stored table. One pass over it scores all
    splits of a model; the models are fitted side by side.
    """
    fit = fit or (lambda estimator, train: estimator.fit(train))
    train = data.filter(F.col("split") == "train")
    # No persist: the iterative estimators cache the blocks they build from the rows themselves.

    def score(spec: tuple) -> list:
        estimator, name = spec
        start = time.time()
        model = fit(estimator, train)
        seconds = round(time.time() - start, 2)
        # A handful of rows: one per split.
        scores = {row.split: row for row in metrics(model.transform(data), by=["split"]).collect()}
        train_acc = scores["train"].acc if "train" in scores else 0.0
        return [(name or type(estimator).__name__, split, train_acc, row.acc, row.precision, row.recall, row.f1,
                 seconds, [[row.tn, row.fp], [row.fn, row.tp]])
                for split, row in sorted(scores.items()) if split != "train"]

    with ThreadPool(parallelism) as pool:
        rows = [row for found in pool.map(score, list(models)) for row in found]
    return data.sparkSession.createDataFrame(rows, METRIC_COLUMNS)


def ranked(results: DataFrame) -> DataFrame:
    """Results by split and falling F1."""
    return results.orderBy(F.desc("split"), F.desc("f1"), "name")
