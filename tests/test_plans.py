import random

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from newsframe.functions import text
from newsframe.operators import rows
from newsframe.plans import evaluate, experiments, models, paths, presets, projection, splits
from newsframe.plans.steps import Steps, keep, run_files


def planted(spark, n=240, seed=0):
    """Texts whose class shows in a few words among noise."""
    rng = random.Random(seed)
    noise = [f"word{i}" for i in range(40)]
    out = []
    for i in range(n):
        fake = rng.random() < 0.4
        words = rng.choices(noise, k=12) + rng.choices(["shock", "secret"] if fake else ["report", "council"], k=2)
        rng.shuffle(words)
        out.append((i, " ".join(words), fake, 0 if i < n * 0.6 else 1 if i < n * 0.8 else 2))
    return spark.createDataFrame(out, "id long, text string, type_binary boolean, set int")


def vectors(spark):
    data = planted(spark).withColumn("words", text.tokens(F.col("text")))
    data = CountVectorizer(inputCol="words", outputCol="features").fit(data).transform(data)
    name = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("set") + 1)
    return data.select("id", name.alias("split"), F.col("type_binary").cast("int").alias("label"), "features")


def test_steps_fold_in_order_and_filter(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "x string, y int")
    steps = Steps([(F.upper, "x"), (lambda y: y * 10, "y", "z"), (keep(lambda x: x != "A"), "x"),
                   (lambda col: F.concat(col("x"), col("z")), None, "w"), (lambda d: d.drop("y"), None)])
    out = df.transform(steps)
    assert out.columns == ["x", "z", "w"] and [tuple(r) for r in out.collect()] == [("B", 20, "B20")]
    assert df.columns == ["x", "y"]
    with pytest.raises(ValueError):
        Steps([("x",)])


def test_run_files(spark):
    written = []
    out = run_files(spark, lambda s: s.range(10), [(lambda c: c + 1, "id")], written.append, total_rows=3, order="id")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3] and len(written) == 1
    assert run_files(spark, lambda s: s.range(10), None, total_rows=4).count() == 4


def test_article_preset(spark):
    df = spark.createDataFrame(
        [(1, "Site-A.com", "fake", "The cats are running, 5 of them!", "A Title", "Bob, Ann"),
         (2, "b.org", "reliable", "", "the", None)], "id long, domain string, type string, content string, title string, authors string")
    one, two = (presets.article_steps() + presets.article_sentiment())(df).orderBy("id").collect()
    assert one.content_no_swords == ["cats", "running", "<NUM>", "!"] and one.content_no_swords_combined == "cat run <num> !"
    assert one.content_no_swords_domain_authors_title == "cat run <num> ! sitea bobann titl"
    assert two.content_no_swords_combined == " " and two.title == " " and two.content_authors == " "
    assert (one.type_binary, two.type_binary) == (True, False) and tuple(two.sentence_analysis_no_swords) == (0.0, 0.0)


def test_usable_articles(spark):
    df = spark.createDataFrame([("x", "fake", "d"), ("Error 404", "fake", "d"), ("error", "fake", "d"), (None, "fake", "d"),
                                ("x", "state", "d"), ("x", None, "d"), ("x", "bias", None)], "content string, type string, domain string")
    assert [r.content for r in rows.usable_articles(df).collect()] == ["x", "error"]


def test_metrics_with_empty_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "label int, prediction int")
    row = evaluate.metrics(df).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (2, 1, 1, 1) and (row.acc, row.precision, row.recall, row.f1) == (0.6, 0.5, 0.5, 0.5)
    row = evaluate.metrics(df.filter("label = 0 and prediction = 0")).first()
    assert (row.acc, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_models_learn_a_planted_signal(spark):
    data = vectors(spark)
    n = data.filter("split = 'train'").count()
    tried = [(models.logistic_regression(n), "logistic"), (models.naive_bayes(), "bayes"),
             (models.random_forest(trees=20), "forest"), (splits.ExactTree(), "tree"),
             (splits.ExactAdaBoost(4), "boost"), (models.linear_svm(n), None)]
    results = evaluate.ranked(evaluate.try_models(tried, data)).collect()
    assert {r.name for r in results} == {"logistic", "bayes", "forest", "tree", "boost", "LinearSVC"}
    assert {r.split for r in results} == {"val", "test"}
    # Always guessing the larger class has F1 0.
    assert all(r.f1 > 0.6 for r in results), [(r.name, r.f1) for r in results]
    assert all(sum(map(sum, r.confusion_matrix)) == 48 for r in results)


def test_grid_search(spark):
    data = vectors(spark).select("id", "label", "features")
    search = paths.GridSearch("id", cs=(1, 200), max_iter=60)
    found = search.fit(data)
    assert len(search.scores) == 2 and max(search.scores) > 0.8 and search.best in (1, 200)
    assert found.penalty == pytest.approx(1 / (search.best * data.count())) and search.scans < 200
    sizes = search.fold(data).groupBy("label", "fold").count().groupBy("label").agg(F.max("count") - F.min("count")).collect()
    assert all(gap <= 1 for _, gap in sizes)
    assert evaluate.metrics(found.transform(data)).first().f1 > 0.9


def test_shared_scans_equal_separate_fits(spark):
    """Weights of a path are those of fits one by one, with one task and with several, and a slope check can fail."""
    data = vectors(spark).select("id", "label", "features")
    size, n = data.first().features.size, data.count()
    rows = paths.sparse_rows(data.withColumn("fold", (F.col("id") % 3).cast("int")), ["label", "fold"]).repartition(3).persist()
    scans = []
    found = paths.fit_paths(rows, size, [(1 / n, None), (0.1, None), (0.1, 2)], tol=1e-7, on_scan=scans.append)
    assert scans[0] == 3 and len(scans) < 150
    for model, penalty, own in ((found[0], 1 / n, data), (found[1], 0.1, data), (found[2], 0.1, data.filter("id % 3 <> 2"))):
        alone = models.logistic_regression(1.0, 1 / penalty, 500, 1e-12).fit(own)
        assert np.abs(alone.coefficients.toArray() - model.weights).max() < 2e-4 and abs(alone.intercept - model.bias) < 2e-4
    assert paths.slope_share(found[0], data) < 1e-5
    assert paths.slope_share(paths.LinearModel(found[0].weights * 0.5, found[0].bias, 1 / n), data) > 0.005
    again = paths.fit_paths(rows, size, [(0.1, None)], tol=1e-7, start=[np.append(found[1].weights, found[1].bias)], on_scan=lambda live: scans.append("again"))
    assert scans.count("again") <= 3 and np.allclose(again[0].weights, found[1].weights, atol=1e-6)


def plain_split(table, label, weight):
    """(gain, index, threshold) of the best split of a dense table, by trying every border."""
    pure = lambda at: (weight[at & (label == 0)].sum() ** 2 + weight[at & (label == 1)].sum() ** 2) / max(weight[at].sum(), 1e-300)
    everyone = np.ones(len(table), bool)
    tried = []
    for index in range(table.shape[1]):
        values = np.unique(np.append(table[:, index], 0.0))
        for one, two in zip(values[:-1], values[1:], strict=True):
            right = table[:, index] > (one + two) / 2
            if right.any() and not right.all():
                tried.append((round((pure(right) + pure(~right) - pure(everyone)) / weight.sum(), 12), -index, -(one + two) / 2))
    return max(tried)


def test_splits_are_exact(spark):
    rng = np.random.default_rng(3)
    table = rng.poisson(0.6, (200, 12)).astype(float)
    table[:, 3] += 1  # a term that every row has
    label = ((table[:, 5] > 1) ^ (rng.random(200) < 0.2)).astype(int)
    weight = rng.integers(1, 5, 200).astype(float)
    data = spark.createDataFrame([(i, int(label[i]), float(weight[i]), Vectors.sparse(12, [(j, v) for j, v in enumerate(table[i]) if v])) for i in range(200)],
                                 ["id", "label", "w", "features"])
    rows = paths.sparse_rows(data, ["label", "w"])
    for name, used in (("1.0", np.ones(200)), ("w", weight)):
        found = splits.best_splits(rows, F.lit(1), F.expr(name)).first()
        gain, index, threshold = plain_split(table, label, used)
        assert (found["index"], found["threshold"]) == (-index, -threshold) and found["gain"] == pytest.approx(gain, abs=2e-12)
    tree = splits.ExactTree(2).fit(data)
    root, border = tree.splits[1]
    for child, side in ((2, table[:, root] <= border), (3, table[:, root] > border)):
        _, index, threshold = plain_split(table[side], label[side], np.ones(side.sum()))
        assert tree.splits[child] == (-index, -threshold)
    right = {row["id"]: row["prediction"] for row in tree.transform(data).collect()}
    assert sum(right[i] == label[i] for i in range(200)) >= max(label.sum(), 200 - label.sum())
    assert splits.best_splits(rows.filter("label = 1"), F.lit(1), F.lit(1.0)).count() == 0
    assert splits.ExactTree(2).fit(data.filter("false")).transform(data).filter("prediction <> 0").count() == 0


def test_principal_axes_of_all_columns(spark):
    rng = np.random.default_rng(0)
    table = rng.poisson(0.3, (120, 30)) * rng.random(30) * 3
    table[:40, :5] += 2
    table[40:80, 5:9] += 1.5
    table[7] = 0
    cells = spark.createDataFrame([(row, at, float(table[row, at])) for row in range(120) for at in range(30) if table[row, at]], "id long, index int, value double")
    found = projection.principal_axes(cells, spark.range(120), "id", extra=6, tol=1e-8)
    centred = table - table.mean(0)
    _, sizes, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(found.variances, sizes[:2] ** 2 / 120, rtol=1e-6) and found.total == pytest.approx((sizes ** 2).sum() / 120)
    got = {row["index"]: (row.a0, row.a1) for row in found.axes.collect()}
    places = {row.id: (row.x0, row.x1) for row in found.scores.collect()}
    for at in range(2):
        axis = axes[at] * np.sign(axes[at][np.abs(axes[at]).argmax()])
        assert np.abs(np.array([got[index][at] for index in range(30)]) - axis).max() < 1e-3
        assert np.abs(np.array([places[row][at] for row in range(120)]) - centred @ axis).max() < 1e-2
    empty = projection.principal_axes(cells.filter("false"), spark.range(3), "id")
    assert empty.variances == [0.0, 0.0] and [(row.x0, row.x1) for row in empty.scores.collect()] == [(0.0, 0.0)] * 3


def test_clusters(spark):
    rng = random.Random(1)
    points = [(i, Vectors.dense([10.0 * (i % 3) + rng.random(), rng.random(), float(i % 3 == 1)])) for i in range(90)]
    data = spark.createDataFrame(points, ["id", "features"])
    found = models.kmeans(data, 3, restarts=2)
    terms = models.cluster_terms(found, spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "word string, index int"), 2)
    assert terms.count() == 6 and {r.term for r in terms.filter("rank = 1").collect()} >= {"x"}
    curve = {r.k: r.sse for r in models.elbow(data, range(2, 5), restarts=2).collect()}
    assert curve[2] > 5 * curve[3] > 0


def test_experiments_are_stored_and_replayed(spark, tmp_path):
    data = planted(spark)
    second = data.select(F.col("id").alias("key"), "text", F.col("type_binary").cast("int").alias("label")).limit(50)
    runs = [experiments.Experiment("count", data, "text", experiments.bag_of_words, [(models.naive_bayes(), "bayes")], key="id"),
            experiments.Experiment("tfidf", data, "text", experiments.tfidf, lambda n: [(models.logistic_regression(n, 250), "logistic")],
                                   key="id", ngrams=(1, 2))]
    path = str(tmp_path / "vectors")
    experiments.create_vectors(path, runs, second)
    results = experiments.test_vectors(spark, path, runs).collect()
    assert {(r.name, r.split) for r in results} == {(m, s) for m in ("bayes", "logistic") for s in ("val", "test", "second")}
    assert all(r.f1 > 0.7 for r in results)
    assert isinstance(spark.read.parquet(path).first().features, SparseVector)


def test_kmeans_keeps_one_model(spark, monkeypatch):
    """Restarts follow each other; a model that lost is let go before the next run, and the earliest wins a tie."""
    import weakref
    alive, most = weakref.WeakSet(), []
    costs = [5.0, 3.0, 4.0, 3.0, 6.0, 3.5]

    class Fitted:
        def __init__(self, seed):
            self.seed, self.summary = seed, type("Summary", (), {"trainingCost": costs[seed]})()

    class Fake:
        def __init__(self, k, maxIter, seed):  # noqa: N803 - named like the estimator's
            self.seed = seed

        def fit(self, data):
            model = Fitted(self.seed)
            alive.add(model)
            most.append(len(alive))
            return model

    monkeypatch.setattr(models, "KMeans", Fake)
    assert models.kmeans(spark.range(3), 2, restarts=6).seed == 1
    assert max(most) <= 2 and len(most) == 6


def test_kmeans_has_a_task_for_every_core_at_most(spark, monkeypatch):
    """Every task gives back whole centres, so rows of many files are brought together before the fits."""
    data = spark.createDataFrame([(i, Vectors.dense([10.0 * (i % 3), float(i % 7)])) for i in range(90)], ["id", "features"]).repartition(40)
    seen, fit = [], models.KMeans.fit
    monkeypatch.setattr(models.KMeans, "fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.is_cached)) or fit(self, rows))
    assert len(models.kmeans(data, 3, restarts=2).clusterCenters()) == 3 and models.elbow(data, range(2, 4), restarts=2).count() == 2
    assert len(seen) == 6 and all(tasks <= spark.sparkContext.defaultParallelism and kept for tasks, kept in seen)


def test_word_vectors_are_learned_in_tasks(spark):
    tasks = lambda n: models.averaged_words(n_train=n).getStages()[0].getNumPartitions()
    assert [tasks(n) for n in (None, 0, 1, 5000, 5001, 123_000)] == [1, 1, 1, 1, 2, 25]


def test_terms_of_one_row_are_one_column(spark):
    """A fit over merged columns gives the weights of all terms, and needs fewer columns than there are terms."""
    rng = np.random.default_rng(5)
    table = rng.poisson(0.5, (60, 10)).astype(float)
    own = np.zeros((60, 150))
    for term in range(140):
        own[term % 50, term] = rng.integers(1, 4)
    table = np.hstack([own, table])
    label = (table[:, 151] + rng.random(60) > 0.9).astype(int)
    data = spark.createDataFrame([(i, int(label[i]), Vectors.sparse(160, [(j, v) for j, v in enumerate(table[i]) if v])) for i in range(60)], ["id", "label", "features"])
    rows = paths.sparse_rows(data.withColumn("fold", (F.col("id") % 3).cast("int")), ["label", "fold"]).repartition(4).persist()
    columns = paths.merged_columns(rows, 160)
    assert columns.size == 50 + 10 and columns.rows.count() == 60
    specs = [(0.02, None), (0.1, 1)]
    plain, found = paths.fit_paths(rows, 160, specs, tol=1e-8), paths.fit_paths(columns.rows, columns.size, specs, tol=1e-8)
    for one, two in zip(plain, map(columns.whole, found), strict=True):
        assert np.abs(one.weights - two.weights).max() < 1e-6 and abs(one.bias - two.bias) < 1e-6
    assert np.abs(columns.whole(found[0]).weights[:140]).min() > 1e-4
    model = paths.LogisticPath((5,), tol=1e-7).fit_all(data)[0][0]
    assert len(model.weights) == 160 and paths.slope_share(model, data) < 1e-5
    nothing = paths.merged_columns(rows.filter("false"), 7)
    assert nothing.size == 0 and len(nothing.whole(paths.LinearModel(np.zeros(0), 0.5)).weights) == 7


def test_forest_splits_sparse_rows(spark):
    """The root of a tree is the best split of its bootstrapped rows over the terms drawn, whatever the sign of the values."""
    from newsframe.plans import forest
    rng = np.random.default_rng(9)
    table = rng.poisson(0.6, (200, 30)) * rng.choice([-1.0, 1.0, 1.0], (200, 30))
    label = ((table[:, 4] > 0) ^ (rng.random(200) < 0.2)).astype(int)
    data = spark.createDataFrame([(int(label[i]), Vectors.sparse(30, [(j, v) for j, v in enumerate(table[i]) if v])) for i in range(200)],
                                 ["label", "features"]).coalesce(1)
    stored = data.select(F.monotonically_increasing_id().alias("at"), "label").collect()
    assert [row.label for row in stored] == list(label)
    found = models.random_forest(depth=2, trees=8, seed=3).fit(data)
    weights = forest.bootstrap(np.arange(200), 8, 3)
    assert 0.8 < weights.mean() < 1.2 and len({tuple(column) for column in weights.T}) == 8
    for tree in range(8):
        terms = np.sort(forest.drawn(30, 8, 3, tree, 1))
        assert len(set(terms)) == 6
        _, index, threshold = plain_split(table[:, terms], label, weights[:, tree].astype(float))
        assert (found.term[tree, 1], found.threshold[tree, 1]) == (terms[-index], -threshold)
    share = lambda node: sum(found.share[tree, node(tree)] for tree in range(8)) / 8
    for row, got in zip(table[:20], found.transform(data).limit(20).collect(), strict=True):
        def leaf(tree, row=row):
            node = 1
            while found.term[tree, node] >= 0:
                node = 2 * node + int(row[found.term[tree, node]] > found.threshold[tree, node])
            return node
        assert got.probability[1] == pytest.approx(share(leaf)) and got.prediction == float(got.probability[1] > 0.5)
    with pytest.raises(ValueError, match="label"):
        models.random_forest().fit(data.withColumn("label", F.lit(None).cast("int")))


def test_forest_of_very_many_terms(spark):
    """Rows are not spread over all terms: 30 million columns, of which Spark's forest makes 120 MB a row."""
    size = 30_000_000
    rows = [(i % 2, Vectors.sparse(size, sorted({i % 2, 5 + i % 7, size - 1 - i}), [1.0] * 3)) for i in range(60)]
    data = spark.createDataFrame(rows, ["label", "features"])
    found = models.random_forest(trees=2).fit(data)
    assert found.transform(data).filter("probability is not null").count() == 60


def test_frozen_embeddings_fit_on_numbers(spark):
    """The fit on the words' numbers is Spark's fit on the flattened vectors, and it needs no vector of a row."""
    from newsframe.operators import features
    rng = np.random.default_rng(0)
    vectors_ = rng.normal(size=(50, 4)).astype(np.float32)
    vectors_[0] = 0
    seq = rng.integers(0, 60, (600, 6))  # 50 to 59 have no vector
    wide = np.vstack([vectors_, np.zeros((10, 4))])[seq].reshape(600, -1)
    label = (1 / (1 + np.exp(-wide @ rng.normal(size=24) * 0.5)) > rng.random(600)).astype(int)
    data = spark.createDataFrame([(i, int(label[i]), seq[i].tolist()) for i in range(600)], "id long, label int, sequence array<int>")
    matrix = spark.createDataFrame([(at, vectors_[at].tolist()) for at in range(1, 50)], "index int, vec array<float>")
    flat = features.embedded_sequences(data, "id", matrix, 4)
    assert all(np.array_equal(row.features.toArray(), wide[row.id]) for row in flat.collect())
    mine = models.frozen_embeddings(matrix, 4).fit(data)
    spark_fit = models.LogisticRegression(regParam=0.0, maxIter=100).fit(flat)
    assert np.abs(mine.weights - spark_fit.coefficients.toArray()).max() < 1e-3 and abs(mine.bias - spark_fit.intercept) < 1e-3
    both = mine.transform(flat).select("id", F.col("probability").alias("mine")).join(spark_fit.transform(flat).select("id", "probability"), "id").collect()
    assert len(both) == 600 and max(abs(row.mine[1] - row.probability[1]) for row in both) < 1e-3
    one = models.frozen_embeddings(matrix, 4).fit(data.withColumn("label", F.lit(1)))
    assert one.transform(flat).filter("prediction = 1").count() == 600


def test_principal_axes_leave_the_cells_in_place(spark, monkeypatch):
    """Several blocks give the axes of one, keys may come twice, and a round reads its cells from blocks that are not shuffled again."""
    rng = np.random.default_rng(4)
    table = rng.poisson(0.3, (90, 40)) * rng.random(40) * 3
    table[:30, :5] += 2
    table[30:60, 5:9] += 1.5
    table[:, 30:] = 0
    table[5, 30:] = rng.random(10)  # columns of one row, and so of one block
    cells = spark.createDataFrame([(row, at, float(table[row, at])) for row in range(90) for at in range(40) if table[row, at]], "id long, index int, value double")
    monkeypatch.setattr(projection, "CELLS", 250)
    found = projection.principal_axes(cells, spark.range(90), "id", tol=1e-7)
    centred = table - table.mean(0)
    _, sizes, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(found.variances, sizes[:2] ** 2 / 90, rtol=1e-6) and found.total == pytest.approx((sizes ** 2).sum() / 90)
    got = {row["index"]: (row.a0, row.a1) for row in found.axes.collect()}
    places = {row.id: (row.x0, row.x1) for row in found.scores.collect()}
    assert len(got) == 40 and len(places) == 90
    for at in range(2):
        axis = axes[at] * np.sign(axes[at][np.abs(axes[at]).argmax()])
        assert np.abs(np.array([got[index][at] for index in range(40)]) - axis).max() < 1e-3
        assert np.abs(np.array([places[row][at] for row in range(90)]) - centred @ axis).max() < 1e-2
    twice = projection.principal_axes(cells, spark.range(90).unionByName(spark.range(5)), "id", rounds=2)
    assert twice.scores.count() == 95 and twice.scores.filter("id < 5").count() == 10
