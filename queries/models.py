"""Models and experiments.

SQL cannot fit them, but it can say what has to hold of a fit: the rows of every split (the cells of the confusion matrix
must add up to them), the number of terms, and the checks that each query makes on its own model. Naive Bayes and the
nearest neighbours have an exact SQL form.
"""

import uuid

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsframe.functions import text
from newsframe.operators import features, neighbours
from newsframe.operators.sampling import quota_split
from newsframe.plans import evaluate, experiments, models, paths, projection, splits
from newsframe.session import materialise, shared_folder
from queries import sql
from queries.registry import labelled, query, table, texts

_SPLITS = """doc AS (SELECT doc_id, text, source, (quality = 0 OR toxic = 1)::INT AS label, row_number() OVER (ORDER BY doc_id) - 1 AS pos,
count(*) OVER () AS n FROM documents JOIN labels USING (doc_id)),
split AS (SELECT *, CASE WHEN pos < floor(0.6 * n) THEN 0 WHEN pos < floor(0.6 * n) + floor(0.2 * n) THEN 1
WHEN pos < floor(0.6 * n) + 2 * floor(0.2 * n) THEN 2 END AS set FROM doc),
everything AS (SELECT doc_id::VARCHAR AS key, text, label, set FROM split WHERE set IS NOT NULL
UNION ALL SELECT 'second:' || conv_id || ':' || turn, text, (role = 'user')::INT, 3 FROM conversations)"""
_TERMS = f"""term AS (SELECT key, set, label, unnest(regexp_extract_all(lower(text), '[{text.WORD}]{{2,}}')) AS word FROM everything)"""
_NAMES = "CASE set WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'second' END"
_ROWS = f"SELECT {_NAMES} AS split, count(*) AS rows FROM everything WHERE set > 0 GROUP BY set"
_SIZE = "(SELECT count(DISTINCT word) FROM term WHERE set = 0)"


def _checked(names, sound: str = "sound") -> str:
    return (f"WITH {_SPLITS}, {_TERMS} SELECT name, split, rows, {_SIZE} AS terms, true AS {sound} FROM ({_ROWS}) "
            f"CROSS JOIN (SELECT unnest([{', '.join(repr(name) for name in names)}]) AS name)")


def _labelled_sets(spark, sf):
    """Labelled documents in the splits train, val and test."""
    rows = labelled(spark, sf).withColumn("kind", F.when(F.col("fake"), "fake").otherwise("reliable"))
    rows = materialise(rows.withColumnRenamed("fake", "type_binary"))
    return quota_split(rows, rows.count(), [0.6, 0.2, 0.2], [False] * 3, "doc_id", "kind")


def _second(spark, sf):
    """The second corpus: user turns count as fake."""
    return table(spark, sf, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("key"), "text", (F.col("role") == "user").cast("int").alias("label"))


def _words(spark, sf):
    rows = _labelled_sets(spark, sf).select(F.col("doc_id").cast("string").alias("key"), "set", F.col("type_binary").cast("int").alias("label"), "text")
    other = _second(spark, sf).select(F.concat(F.lit("second:"), "key").alias("key"), F.lit(3).alias("set"), "label", "text")
    return materialise(rows.unionByName(other).withColumn("words", text.vectoriser_tokens(F.col("text"))).drop("text"))


def _vectors(spark, sf):
    """Bag of words over all terms of the training split: (split, label, features) and the number of terms."""
    words = _words(spark, sf)
    model = features.count_vectoriser(words.filter("set = 0"), "words")
    name = F.element_at(F.array(*[F.lit(part) for part in experiments.SPLITS.values()]), F.col("set") + 1)
    return model.vectors(words.withColumn("split", name), "key", "words", ["split", "label"]), model.size


class _Kept:
    """Keeps the model that an estimator gives, for the checks after the scores."""

    def __init__(self, estimator):
        self.estimator, self.model = estimator, None

    def fit(self, train):
        self.model = self.estimator.fit(train)
        return self.model


def _try(spark, sf, make, sound):
    """Rows per model and split, with the result of ``sound(kept model, training rows)``."""
    data, terms = _vectors(spark, sf)
    train = data.filter("split = 'train'")
    tried = [(_Kept(estimator), name) for estimator, name in make(train.count())]
    scores = evaluate.try_models(tried, data)
    # One row per model: the checks are numbers of the fits themselves.
    checks = spark.createDataFrame([(name, bool(sound(kept, train))) for kept, name in tried], "name string, sound boolean")
    rows = F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("long"), lambda a, x: a + x)
    return scores.join(F.broadcast(checks), "name").select("name", "split", rows.alias("rows"), F.lit(terms).cast("long").alias("terms"), "sound")


def _beats_majority(kept, train):
    """At least as many training rows are right as for the more frequent label."""
    right, ones, total = kept.model.transform(train).agg(
        F.count_if(F.col("prediction") == F.col("label")), F.sum("label"), F.count("*")).first()
    return right >= max(ones, total - ones)


def _lower_hinge(kept, train):
    """The penalised hinge loss is below that of the model without weights, which is 1."""
    raw = vector_to_array("rawPrediction")[1]
    loss = kept.model.transform(train).agg(F.avg(F.greatest(F.lit(0.0), 1 - (2 * F.col("label") - 1) * raw))).first()[0]
    weights = kept.model.coefficients.toArray()
    return loss + 0.5 * kept.estimator.getRegParam() * float(weights @ weights) < 1


@query(_checked(["logistic_c1", "logistic_c0.1", "logistic_c250"]))
def logistic_regressions(spark, sf):
    # One search for the three penalties; sound: Spark's own sums of the slope are small at every model.
    data, terms = _vectors(spark, sf)
    train = data.filter("split = 'train'")
    found = paths.LogisticPath().fit_all(train)
    scores = evaluate.try_models(found, data, fit=lambda model, _: model)
    checks = spark.createDataFrame([(name, paths.slope_share(model, train) <= 0.005) for model, name in found], "name string, sound boolean")
    rows = F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("long"), lambda a, x: a + x)
    return scores.join(F.broadcast(checks), "name").select("name", "split", rows.alias("rows"), F.lit(terms).cast("long").alias("terms"), "sound")


@query(f"""WITH {_SPLITS}, {_TERMS}, sizes AS (SELECT label, count(*) AS docs FROM everything WHERE set = 0 GROUP BY label),
voc AS (SELECT word, sum((label = 1)::INT) AS one, sum((label = 0)::INT) AS zero FROM term WHERE set = 0 GROUP BY word),
whole AS (SELECT count(*) AS v, sum(one) AS ones, sum(zero) AS zeros FROM voc),
weights AS (SELECT word, ln((one + 1.0) / (ones + v)) - ln((zero + 1.0) / (zeros + v)) AS w FROM voc, whole),
prior AS (SELECT ln((SELECT docs FROM sizes WHERE label = 1) + 1.0) - ln((SELECT docs FROM sizes WHERE label = 0) + 1.0) AS p),
guess AS (SELECT e.key, any_value(e.set) AS set, any_value(e.label) AS label, (any_value(p) + coalesce(sum(w), 0) > 0)::INT AS guess
FROM everything e CROSS JOIN prior LEFT JOIN term USING (key) LEFT JOIN weights ON term.word = weights.word WHERE e.set > 0 GROUP BY e.key)
SELECT 'naive_bayes' AS name, {_NAMES} AS split, sum((label = 0 AND guess = 0)::INT)::BIGINT AS tn, sum((label = 0 AND guess = 1)::INT)::BIGINT AS fp,
sum((label = 1 AND guess = 0)::INT)::BIGINT AS fn, sum((label = 1 AND guess = 1)::INT)::BIGINT AS tp FROM guess GROUP BY set""")
def naive_bayes(spark, sf):
    scores = evaluate.try_models([(models.naive_bayes(), "naive_bayes")], _vectors(spark, sf)[0])
    cells = F.flatten("confusion_matrix")
    return scores.select("name", "split", *[cells[at].alias(cell) for at, cell in enumerate(("tn", "fp", "fn", "tp"))])


@query(_checked(["random_forest"]))
def random_forest(spark, sf):
    return _try(spark, sf, lambda n: [(models.random_forest(), "random_forest")], _beats_majority)


@query(_checked(["decision_tree"]))
def decision_tree(spark, sf):
    return _try(spark, sf, lambda n: [(splits.ExactTree(), "decision_tree")], _beats_majority)


@query(_checked(["ada_boost"]))
def ada_boost(spark, sf):
    return _try(spark, sf, lambda n: [(splits.ExactAdaBoost(2), "ada_boost")], _beats_majority)


def _split_sql(name: str, rows: str) -> str:
    """The best split of every node of a CTE (key, node, label, w), as the CTE ``name`` (node, word, threshold)."""
    pure = lambda one, two: f"CASE WHEN {one} + {two} > 1e-12 THEN ({one} * {one} + {two} * {two}) / ({one} + {two}) ELSE 0 END"
    return f"""{name}_sums AS (SELECT node, word, v, coalesce(sum(w) FILTER (label = 0), 0) AS w0, coalesce(sum(w) FILTER (label = 1), 0) AS w1
FROM cells JOIN {rows} USING (key) GROUP BY ALL),
{name}_tot AS (SELECT node, coalesce(sum(w) FILTER (label = 0), 0) AS t0, coalesce(sum(w) FILTER (label = 1), 0) AS t1 FROM {rows} GROUP BY node),
{name}_run AS (SELECT *, coalesce(lag(v) OVER upto, 0) AS before, sum(w0) OVER upto - w0 - sum(w0) OVER whole AS d0, sum(w1) OVER upto - w1 - sum(w1) OVER whole AS d1
FROM {name}_sums WINDOW upto AS (PARTITION BY node, word ORDER BY v), whole AS (PARTITION BY node, word)),
{name}_side AS (SELECT node, word, (before + v) / 2 AS threshold, t0, t1, t0 + d0 AS l0, t1 + d1 AS l1, -d0 AS r0, -d1 AS r1 FROM {name}_run JOIN {name}_tot USING (node)),
{name}_gain AS (SELECT *, round(({pure('l0', 'l1')} + {pure('r0', 'r1')} - {pure('t0', 't1')}) / (t0 + t1), 12) AS gain FROM {name}_side
WHERE l0 + l1 > 1e-9 AND r0 + r1 > 1e-9),
{name} AS MATERIALIZED (SELECT node, word, threshold FROM {name}_gain WHERE gain > 0
QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, word, threshold) = 1)"""


@query(f"""WITH {_SPLITS}, {_TERMS}, cells AS MATERIALIZED (SELECT key, word, count(*)::DOUBLE AS v FROM term WHERE set = 0 GROUP BY ALL),
r1 AS MATERIALIZED (SELECT key, 1 AS node, label, 1.0::DOUBLE AS w FROM everything WHERE set = 0), {_split_sql('root', 'r1')},
placed AS MATERIALIZED (SELECT r1.key, label, CASE WHEN coalesce(v, 0) > threshold THEN 3 ELSE 2 END AS node, w FROM r1 CROSS JOIN root
LEFT JOIN cells ON cells.key = r1.key AND cells.word = root.word), {_split_sql('child', 'placed')},
leaf AS (SELECT node, (sum(w * (2 * label - 1)) > 0)::INT AS guess FROM placed GROUP BY node),
judged AS (SELECT key, label, (guess <> label)::INT AS wrong FROM placed JOIN leaf USING (node)),
share AS (SELECT (count(*) - sum(wrong)) / sum(wrong) AS up FROM judged),
r2 AS MATERIALIZED (SELECT key, 1 AS node, label, CASE WHEN wrong = 1 THEN up ELSE 1 END AS w FROM judged, share), {_split_sql('second', 'r2')}
SELECT 'tree' AS model, node::INT AS node, word, threshold FROM (SELECT * FROM root UNION ALL SELECT * FROM child)
UNION ALL SELECT 'boost 1', 1, word, threshold FROM root UNION ALL SELECT 'boost 2', 1, word, threshold FROM second""")
def tree_splits(spark, sf):
    """The splits of a tree of two levels and of two rounds of boosting, as words and numbers of occurrences."""
    words = _words(spark, sf)
    model = features.count_vectoriser(words.filter("set = 0"), "words")
    train = model.vectors(words.filter("set = 0"), "key", "words", ["label"])
    tree, boost = splits.ExactTree(2).fit(train), splits.ExactAdaBoost(2).fit(train)
    found = [("tree", node, *split) for node, split in tree.splits.items()]
    found += [(f"boost {number}", 1, *stump.splits[1]) for number, (stump, _) in enumerate(boost.stumps, start=1) if stump.splits]
    rows = spark.createDataFrame(found, "model string, node int, index int, threshold double")  # a row per split of a small tree
    return model.terms.join(F.broadcast(rows), "index").select("model", "node", "word", "threshold")


@query(_checked(["svm"]))
def linear_svm(spark, sf):
    return _try(spark, sf, lambda n: [(models.linear_svm(n), "svm")], _lower_hinge)


@query("""WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS nb, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
FROM t a, t b), votes AS (SELECT vec_id, label, count(*) AS n FROM d WHERE rank <= 2 GROUP BY vec_id, label)
SELECT vec_id AS id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1""")
def nearest_neighbours(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return neighbours.classify(rows, rows, 2)


@query(f"""WITH {_SPLITS}, {_TERMS}, tf AS (SELECT key, set, label, word, count(*) AS n FROM term WHERE set < 3
AND word IN (SELECT word FROM term WHERE set = 0) GROUP BY ALL), norm AS (SELECT key, any_value(set) AS set, any_value(label) AS label, sum(n * n) AS s FROM tf GROUP BY key),
dots AS (SELECT a.key AS q, b.key AS t, sum(a.n * b.n) AS dot FROM tf a JOIN tf b USING (word) WHERE a.set > 0 AND b.set = 0 GROUP BY ALL),
far AS (SELECT q.key AS q, t.key AS t, t.label, q.s + t.s - 2 * coalesce(dot, 0) AS d FROM norm q JOIN norm t ON q.set > 0 AND t.set = 0 LEFT JOIN dots ON q.key = dots.q AND t.key = dots.t),
near AS (SELECT q, label FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS r FROM far) WHERE r <= 2)
SELECT q AS key, CASE WHEN sum(label) = 2 THEN 1 ELSE 0 END AS prediction FROM near GROUP BY q""")
def text_neighbours(spark, sf):
    words = _words(spark, sf).filter("set < 3")
    cells = materialise(features.count_vectoriser(words.filter("set = 0"), "words").entries(words, "key", "words")
                        .join(words.select("key", "set", "label"), "key"))
    return neighbours.vote(neighbours.nearest_texts(cells.filter("set = 0"), cells.filter("set > 0"), 2, "key"), "key")


def _kept_rows(names) -> str:
    return (f"WITH {_SPLITS} SELECT name, split, rows FROM (SELECT {_NAMES} AS split, count(*) AS rows FROM split WHERE set > 0 GROUP BY set) "
            f"CROSS JOIN (SELECT unnest([{', '.join(repr(name) for name in names)}]) AS name)")


def _row_counts(scores):
    return scores.select("name", "split", F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("long"), lambda a, x: a + x).alias("rows"))


@query(_kept_rows(["frozen_embeddings"]))
def frozen_embeddings(spark, sf):
    rows = materialise(_labelled_sets(spark, sf).select("doc_id", "set", F.col("type_binary").cast("int").alias("label"),
                                                        text.sequence_tokens(F.col("text")).alias("words")))
    index = materialise(features.sequence_index(rows.filter("set = 0"), "words", 10_000, oov=False))
    vectors = index.join(table(spark, sf, "embeddings"), F.col("index") == F.col("vec_id") + 1).select(
        "word", F.col("embedding").alias("vec"))
    matrix = materialise(features.embedding_rows(index, vectors, 64))
    sequences = features.padded_sequences(rows, "doc_id", "words", index, 100, oov=False, keep_first=False)
    name = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("set") + 1)
    data = materialise(sequences.join(rows.select("doc_id", "label", name.alias("split")), "doc_id"))
    # The fit keeps the numbers of the words; the vectors of whole sequences are made where they are scored, and not stored.
    flat = features.embedded_sequences(data, "doc_id", matrix, 64)
    return _row_counts(evaluate.try_models([(models.frozen_embeddings(matrix, 64), "frozen_embeddings")], flat,
                                           fit=lambda unit, _: unit.fit(data.filter("split = 'train'"))))


@query(_kept_rows(["averaged_words"]))
def averaged_word_vectors(spark, sf):
    rows = _labelled_sets(spark, sf).select("set", F.col("type_binary").cast("int").alias("label"),
                                            text.sequence_tokens(F.col("text")).alias("words"))
    name = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("set") + 1)
    data = materialise(rows.select("label", "words", name.alias("split")))
    n = data.filter("split = 'train'").count()
    return _row_counts(evaluate.try_models([(models.averaged_words(n_train=n), "averaged_words")], data))


@query(f"""WITH {_SPLITS} SELECT name, split, rows, true AS flat, true AS shared, true AS stratified FROM
(SELECT {_NAMES} AS split, count(*) AS rows FROM everything WHERE set > 0 GROUP BY set) CROSS JOIN (SELECT 'grid_search' AS name)""")
def grid_search(spark, sf):
    data, _ = _vectors(spark, sf)
    data = data.withColumnRenamed("key", "row_key")
    train = data.filter("split = 'train'")
    search = paths.GridSearch("row_key")
    found = search.fit(train)
    scores = _row_counts(evaluate.try_models([(found, "grid_search")], data, fit=lambda model, _: model))
    # Flat: Spark's own sums of the slope are small at the refitted model. Shared: three searches of at most 500 steps in all,
    # where separate fits would scan once per step and model.
    flat = paths.slope_share(found, train) <= 0.005 and len(search.scores) == 4 and search.scores[search.cs.index(search.best)] == max(search.scores)
    sizes = search.fold(train).groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("gap")).agg(F.max("gap")).first()[0]
    return scores.select("*", F.lit(bool(flat)).alias("flat"), F.lit(search.scans <= 1500).alias("shared"), F.lit(sizes <= 1).alias("stratified"))


def _topics(spark, sf):
    """TF-IDF vectors of all documents without stop words, over all terms."""
    words = text.remove_stop_words(text.vectoriser_tokens(F.col("text")))
    rows = materialise(texts(spark, sf).select("doc_id", words.alias("words")))
    model = features.tfidf_vectoriser(rows, "words")
    return model, model.vectors(rows, "doc_id", "words")


@query("SELECT unnest(range(2, 11))::INT AS k, true AS falls")
def elbow_curve(spark, sf):
    _, data = _topics(spark, sf)
    curve = models.elbow(data).collect()  # nine rows
    # More centres cannot be much worse, as every number is the best of ten runs.
    return spark.createDataFrame([(row.k, at == 0 or row.sse <= 1.02 * curve[at - 1].sse) for at, row in enumerate(curve)], "k int, falls boolean")


@query("SELECT (SELECT count(*) FROM documents) AS rows, 5 AS clusters, true AS nearest, true AS centred")
def clusters(spark, sf):
    _, data = _topics(spark, sf)
    found = models.kmeans(data, 5)
    centres = np.asarray(found.clusterCenters())
    placed = found.transform(data)
    # A centre is the mean of its rows up to the tolerance of the fit, and the fit's cost that of the nearest centres.
    means = [(row.prediction, row.n, row.mean.toArray()) for row in placed.groupBy("prediction").agg(
        F.count("*").alias("n"), Summarizer.mean(F.col("features")).alias("mean")).collect()]
    centred = all(np.linalg.norm(mean - centres[cluster]) < 0.05 for cluster, _, mean in means)
    spread = sum(n * (1 - 2 * float(mean @ centres[cluster]) + float(centres[cluster] @ centres[cluster])) for cluster, n, mean in means)
    nearest = abs(spread - found.summary.trainingCost) <= 0.02 * found.summary.trainingCost
    return spark.createDataFrame([(sum(n for _, n, _ in means), len(means), bool(nearest), bool(centred))],
                                 "rows long, clusters int, nearest boolean, centred boolean")


@query("SELECT cluster::INT AS cluster, rank::INT AS rank, true AS known, true AS falling FROM range(0, 5) a(cluster), range(1, 11) b(rank)")
def cluster_terms(spark, sf):
    model, data = _topics(spark, sf)
    terms = models.cluster_terms(models.kmeans(data, 5), model.terms)
    before = F.lag("weight").over(Window.partitionBy("cluster").orderBy("rank"))
    return terms.select("cluster", "rank", F.col("term").isNotNull().alias("known"), F.coalesce(before >= F.col("weight"), F.lit(True)).alias("falling"))


def _power_sql(rounds: int) -> str:
    """The greatest variance of the centred TF-IDF rows by power rounds, each a step from terms to documents and back."""
    words = sql.without_stop_words(f"regexp_extract_all(lower(text), '[{text.WORD}]{{2,}}')")
    steps = [f"""w AS MATERIALIZED (SELECT doc_id, {words} AS words FROM documents), n AS (SELECT count(*) AS n FROM documents),
tf AS MATERIALIZED (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(words) AS word FROM w) GROUP BY ALL),
idf AS MATERIALIZED (SELECT word, ln((1.0 + n) / (1 + count(*))) + 1 AS i FROM tf, n GROUP BY word, n),
raw AS (SELECT doc_id, word, c * i AS v FROM tf JOIN idf USING (word)),
cell AS MATERIALIZED (SELECT doc_id, word, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM raw),
mu AS MATERIALIZED (SELECT word, sum(v) / n AS m FROM cell, n GROUP BY word, n),
x0 AS MATERIALIZED (SELECT word, (hash(word) % 1000) / 1000.0 AS x FROM mu)"""]
    for at in range(rounds):
        steps.append(f"""o{at} AS MATERIALIZED (SELECT sum(m * x) AS o FROM mu JOIN x{at} USING (word)),
s{at} AS MATERIALIZED (SELECT doc_id, coalesce(s, 0) - o AS s FROM documents LEFT JOIN (SELECT doc_id, sum(v * x) AS s FROM cell JOIN x{at} USING (word) GROUP BY doc_id)
USING (doc_id), o{at}), y{at} AS MATERIALIZED (SELECT word, sum(v * s) AS y FROM cell JOIN s{at} USING (doc_id) GROUP BY word),
x{at + 1} AS MATERIALIZED (SELECT word, y / (SELECT sqrt(sum(y * y)) FROM y{at}) AS x FROM y{at})""")
    last = rounds - 1
    return (f"WITH {', '.join(steps)} SELECT (SELECT n FROM n) AS rows, round((SELECT sum(v * v) / any_value(n) FROM cell, n) - (SELECT sum(m * m) FROM mu), 6) AS total, "
            f"round((SELECT sqrt(sum(y * y)) FROM y{last}) / (SELECT n FROM n), 4) AS lead, true AS centred, true AS uncorrelated, true AS ordered")


@query(_power_sql(40))
def principal_axes(spark, sf):
    words = text.remove_stop_words(text.vectoriser_tokens(F.col("text")))
    rows = materialise(texts(spark, sf).select("doc_id", words.alias("words")))
    cells = materialise(features.tfidf_vectoriser(rows, "words").entries(rows, "doc_id", "words"))
    found = projection.principal_axes(cells, rows, "doc_id")
    n, x, y, xx, yy, xy = found.scores.agg(F.count("*"), F.avg("x0"), F.avg("x1"), F.var_pop("x0"), F.var_pop("x1"), F.covar_pop("x0", "x1")).first()
    sound = abs(x) + abs(y) < 1e-8, abs(xy) < 1e-8, xx >= yy > 0 and abs(xx - found.variances[0]) < 1e-6
    return spark.createDataFrame([(n, round(found.total, 6), round(found.variances[0], 4), *map(bool, sound))],
                                 "rows long, total double, lead double, centred boolean, uncorrelated boolean, ordered boolean")


#: Runs on the unbalanced sets: logistic regressions with three C, or with C = 1 alone.
_THREE, _ONE = ["combined", "unigrams", "trigrams", "all"], ["bigrams", "title", "domain", "authors", "clusters", "terms"]
_EVEN = {"types": (0.1, ("en", "fr", "de", "es")), "binary": (0.1, ("fake", "reliable")), "reliable_fake": (0.05, ("fake", "reliable"))}
_NAMED = ([f"logistic_c{c}_{name}" for name in _THREE for c in (1, 0.1, 250)] + [f"logistic_c1_{name}" for name in _ONE] + ["bayes_combined", "grid_combined"])


@query(f"""WITH {_SPLITS}, names AS (SELECT unnest([{', '.join(map(repr, _NAMED))}]) AS name)
SELECT name, split, rows FROM names CROSS JOIN ({_ROWS}) """ + " ".join(f"""
UNION ALL SELECT 'logistic_c1_{name}', 'val', {len(classes)} * floor(({share} * (SELECT any_value(n) FROM doc)) / {len(classes)})::BIGINT
UNION ALL SELECT 'logistic_c1_{name}', 'second', count(*) FROM everything WHERE set = 3""" for name, (share, classes) in _EVEN.items()))
def experiment_runs(spark, sf):
    # All columns, n-gram ranges, cluster features and a grid search on the unbalanced sets, and the text on three kinds of balanced ones.
    toxic = table(spark, sf, "labels").select("doc_id", "toxic")
    title, authors = F.substring_index("text", "\n", 1), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("author"), F.col("doc_id") % 7))
    rows = materialise(labelled(spark, sf).join(toxic, "doc_id").withColumn("type_binary", F.col("fake"))
                       .withColumn("kind", F.when(F.col("fake"), "fake").otherwise("reliable"))
                       .withColumn("strict", F.when(F.col("toxic") == 1, "fake").when(~F.col("fake"), "reliable"))
                       .withColumn("with_title", F.concat_ws(" ", "text", title)).withColumn("with_domain", F.concat_ws(" ", "text", "source"))
                       .withColumn("with_authors", F.concat_ws(" ", "text", authors)).withColumn("everything", F.concat_ws(" ", "text", "source", authors, title)))
    size = rows.count()
    data = materialise(quota_split(rows, size, [0.6, 0.2, 0.2], [False] * 3, "doc_id", "kind"))
    topics = materialise(experiments.with_clusters(data.withColumn("words", text.vectoriser_tokens(F.col("text"))), "doc_id", "words", "text").drop("words"))
    one, three = paths.LogisticPath((1,)), paths.LogisticPath((1, 0.1, 250))
    count, tfidf, run = experiments.bag_of_words, experiments.tfidf, experiments.Experiment
    runs = [run("combined", data, "text", count, [(three, "combined"), (models.naive_bayes(), "bayes_combined"), (paths.GridSearch("key"), "grid_combined")]),
            run("unigrams", data, "text", tfidf, [(three, "unigrams")]), run("bigrams", data, "text", tfidf, [(one, "bigrams")], ngrams=(1, 2)),
            run("trigrams", data, "text", tfidf, [(three, "trigrams")], ngrams=(1, 3)), run("title", data, "with_title", count, [(one, "title")]),
            run("domain", data, "with_domain", count, [(one, "domain")]), run("authors", data, "with_authors", count, [(one, "authors")]),
            run("all", data, "everything", count, [(three, "all")]),
            run("clusters", topics, "content_with_cluster_name", count, [(one, "clusters")]), run("terms", topics, "content_with_top_terms", count, [(one, "terms")])]
    for name, (share, classes) in _EVEN.items():
        label = {"types": "lang", "binary": "kind", "reliable_fake": "strict"}[name]
        even = materialise(quota_split(rows, size, [share, share], [True, True], "doc_id", label, list(classes)))
        runs.append(run(name, even, "text", count, [(one, name)]))
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    experiments.create_vectors(path, runs, _second(spark, sf))
    return _row_counts(evaluate.ranked(experiments.test_vectors(spark, path, runs)))
