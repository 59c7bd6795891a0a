"""Lists of (data, text column, vectoriser, models) experiments."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsframe.functions import text
from newsframe.operators import features
from newsframe.plans.evaluate import try_models
from newsframe.plans.models import cluster_terms, kmeans
from newsframe.session import materialise
from newsframe.sources.writers import read_vectors, write_vectors

SPLITS = {0: "train", 1: "val", 2: "test", 3: "second"}


@dataclass
class Experiment:
    """One data frame, its text column, a vectoriser and the (model, name) pairs to try on the vectors.

    ``vectoriser`` takes the training rows and the name of the word column. ``models`` may also be a function of the
    number of training rows, for models that need it. An entry with ``fit_all``, such as a ``LogisticPath``, fits several
    models together, whose names are put before the entry's. ``ngrams`` are the least and the largest number of words of a term.
    """
    name: str
    data: DataFrame
    column: str
    vectoriser: Callable
    models: list | Callable
    key: str = "doc_id"
    flag: str = "type_binary"
    set_col: str = "set"
    ngrams: tuple[int, int] = (1, 1)


bag_of_words = features.count_vectoriser
tfidf = features.tfidf_vectoriser


def create_vectors(path: str, experiments: list[Experiment], second: DataFrame | None = None) -> None:
    """Fits each vectoriser on set 0 and writes the vectors of all sets, and of a second corpus as set 3.

    ``second`` has the columns key (unique), text and label.
    """
    for at, experiment in enumerate(experiments):
        rows = experiment.data.select(
            F.col(experiment.key).cast("string").alias("key"), F.col(experiment.set_col).cast("int").alias("set"),
            F.col(experiment.flag).cast("int").alias("label"), F.col(experiment.column).alias("text"))
        if second is not None:
            rows = rows.unionByName(second.select(F.concat(F.lit("second:"), F.col("key")).alias("key"), F.lit(3).alias("set"),
                                                  F.col("label").cast("int"), "text"))
        rows = rows.withColumn("words", text.vectoriser_tokens(text.blank_if_missing(F.col("text"))))
        # The words are read twice, to fit the vectoriser and to apply it: cut and store them once.
        rows = materialise(rows.withColumn("words", text.ngrams(F.col("words"), *experiment.ngrams)).drop("text"))
        model = experiment.vectoriser(rows.filter(F.col("set") == 0), "words")
        write_vectors(model.vectors(rows, "key", "words", ["set", "label"]), path, experiment.name, append=at > 0)


def with_clusters(df: DataFrame, key: str, words: str, column: str, k: int = 5, max_iter: int = 100, restarts: int = 10,
                  train: str = "set = 0") -> DataFrame:
    """Adds content_with_cluster_name and content_with_top_terms: the text and the name, or terms, of its topic.

    Topics are k-means clusters of the TF-IDF vectors; vectoriser and clusters are fitted on the training rows.
    """
    rows = materialise(df)
    model = features.tfidf_vectoriser(rows.filter(train), words)
    found = kmeans(model.vectors(rows.filter(train), key, words), k, max_iter, restarts)
    placed = materialise(found.transform(model.vectors(rows, key, words)).select(key, F.col("prediction").alias("cluster")))
    named = rows.join(placed, key).withColumn(
        "content_with_cluster_name", features.with_cluster_name(F.col(column), F.col("cluster")))
    return features.with_cluster_terms(named, column, "cluster", cluster_terms(found, model.terms))


def test_vectors(spark: SparkSession, path: str, experiments: list[Experiment],
                 results: DataFrame | None = None) -> DataFrame:
    """Reads the stored vectors of each experiment and scores its models; appends to earlier results."""
    name = F.element_at(F.create_map(*[F.lit(part) for pair in SPLITS.items() for part in pair]), F.col("set"))
    for experiment in experiments:
        data = read_vectors(spark, path, experiment.name).withColumn("split", name)
        models = experiment.models
        if callable(models):
            models = models(data.filter(F.col("split") == "train").count())
        train, fitted = data.filter(F.col("split") == "train"), []
        for estimator, label in models:
            fitted += [(model, f"{own}_{label}") for model, own in estimator.fit_all(train)] if hasattr(estimator, "fit_all") else [(estimator, label)]
        scores = try_models(fitted, data, fit=lambda estimator, rows: estimator.fit(rows) if hasattr(estimator, "fit") else estimator)
        results = scores if results is None else results.unionByName(scores)
    return results


test_vectors.__test__ = False
