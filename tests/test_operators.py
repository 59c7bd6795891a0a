import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsframe.operators import features, frequency, joins, neighbours, ordering, sampling, summary, vocabulary
from newsframe.operators.neighbours import classify, nearest
from newsframe.operators.sampling import merge_summaries, sample_per_group, sample_summary
from newsframe.operators.sentiment import scoped_sentiment, sentiment, sentiment_of


def test_dense_index_of_sparse_keys(spark):
    rng = random.Random(3)
    keys = rng.sample(range(-10 ** 12, 10 ** 12), 3000) + list(range(500))
    df = spark.createDataFrame([(key,) for key in keys], "k long").repartition(7)
    rows = {row.k: row.row_id for row in ordering.dense_index(df, "k").collect()}
    assert rows == {key: at for at, key in enumerate(sorted(keys))}


def test_shuffled_index_is_a_permutation(spark):
    df = spark.range(2000)
    one = {row.id: row.position for row in ordering.shuffled_index(df, ["id"], 1).collect()}
    other = {row.id: row.position for row in ordering.shuffled_index(df, ["id"], 2).collect()}
    assert sorted(one.values()) == list(range(2000)) and one != other
    order = [row.id for row in ordering.shuffle_rows(df, ["id"], 1).collect()]
    assert order == sorted(one, key=one.get)


def test_nth_keys(spark):
    rng = random.Random(4)
    rows = [(key, rng.choice("ab")) for key in rng.sample(range(10 ** 14), 1000)]
    df = spark.createDataFrame(rows, "k long, l string")
    by = {name: sorted(key for key, label in rows if label == name) for name in "ab"}
    found = ordering.nth_keys(df, "k", {"a": 7, "b": 300, "c": 1}, "l")
    assert found == {"a": by["a"][6], "b": by["b"][299], "c": None}
    assert ordering.nth_keys(df, "k", {None: 1001}) == {None: None}
    assert ordering.nth_keys(df, "k", {None: 1000}) == {None: max(by["a"] + by["b"])}


def brute_split(labels, total, splits, balanced, classes):
    """Walks over the rows once, as a person with one pile per set would."""
    piles = [{None: int(share * total)} if not even else dict.fromkeys(classes, int(share * total / len(classes)))
             for share, even in zip(splits, balanced)]
    out, at = [], 0
    for label in labels:
        chosen = None
        while at < len(piles):
            slot = label if balanced[at] else None
            if slot not in piles[at]:
                break
            if sum(piles[at].values()) == 0:
                at += 1
                continue
            if piles[at][slot] > 0:
                piles[at][slot] -= 1
                chosen = at
            break
        out.append(chosen)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_quota_split_equals_a_walk_over_the_rows(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d"]
    weights = [rng.random() + 0.05 for _ in names]
    labels = [rng.choices([*names, None], [*weights, 0.1])[0] for _ in range(rng.randint(5, 120))]
    classes = rng.sample(names, rng.randint(1, 3))
    splits = [rng.choice([0, 0.1, 0.2, 0.35]) for _ in range(3)]
    balanced = [rng.random() < 0.6 for _ in range(3)]
    keys = sorted(rng.sample(range(10 ** 9), len(labels)))
    df = spark.createDataFrame(list(zip(keys, labels)), "k long, type string")
    got = sampling.quota_split(df, len(labels), splits, balanced, "k", classes=classes, delete=False)
    rows = {row.k: row["set"] for row in got.collect()}
    assert [rows[key] for key in keys] == brute_split(labels, len(labels), splits, balanced, classes)


def test_quota_split_with_boolean_classes(spark):
    df = spark.range(40).withColumn("flag", F.col("id") % 4 == 0)
    got = sampling.quota_split(df, 20, [0.5, 0.25], [True, False], "id", "flag", [True, False])
    expected = brute_split([i % 4 == 0 for i in range(40)], 20, [0.5, 0.25], [True, False], [True, False])
    assert {row.id: row["set"] for row in got.collect()} == {i: s for i, s in enumerate(expected) if s is not None}
    report = sampling.split_report(got, 20, [0.5, 0.25], [True, False], "flag", [True, False])
    assert sorted((r["set"], r.label or "", r.wanted, r.got) for r in report.collect()) == [
        (0, "false", 5, 5), (0, "true", 5, 5), (1, "", 5, 5)]


def test_sample_per_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 20, "few").otherwise("many"))
    got = ordering.sample_per_group(df, "g", ["id"], 100, 5).groupBy("g").count().collect()
    assert {row.g: row["count"] for row in got} == {"few": 18, "many": 100}
    again = [{row.id for row in ordering.sample_per_group(df, "g", ["id"], 100, 5).collect()} for _ in range(2)]
    assert again[0] == again[1]


def test_quantiles(spark):
    rng = random.Random(6)
    rows = [("hot", float(rng.randint(0, 5))) for _ in range(3000)] + [("wide", rng.gauss(0, 10)) for _ in range(2001)]
    rows += [("one", 4.0), (None, 1.0), (None, 2.0), ("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(row.g, row.probability): row["quantile"] for row in ordering.quantiles(df, ["g"], "v", ps).collect()}
    for group in ("hot", "wide", "one", None):
        values = [v for g, v in rows if g == group and v is not None]
        assert [got[group, p] for p in ps] == pytest.approx(list(np.quantile(values, ps)))
    assert len(got) == 24


def test_box_stats(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 100, -50]
    df = spark.createDataFrame([(True, v) for v in values], "f boolean, v int")
    row = summary.box_stats(df, {"v": F.col("v")}, ["f"]).first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert (row.q1, row.median, row.q3) == (q1, 4.5, q3)
    assert (row.low, row.high, row.outliers) == (1, 8, 2)


def test_frequencies(spark):
    df = spark.createDataFrame([(True, ["a", "a", "b"]), (False, ["b", "c"]), (None, ["z"]), (True, [])], "fake boolean, w array<string>")
    rows = {(r.word, r.n): r.percentage for r in frequency.with_share(frequency.word_counts(df, "w")).collect()}
    assert rows == {("a", 2): 200 / 7, ("b", 2): 200 / 7, ("c", 1): 100 / 7, ("z", 1): 100 / 7, (None, 1): 100 / 7}
    best = frequency.word_frequency_by_class(df, "w", "fake", 1).collect()
    assert sorted((r.fake, r.word, r["rank"], r.percentage) for r in best) == [(False, "b", 1, 50.0), (True, "a", 1, 50.0)]
    regions = {r.word: r.region for r in frequency.shared_top_words(df.filter("size(w) > 0"), "w", "fake", 2).collect()}
    assert regions == {"a": "fake", "b": "both", "c": "reliable"}
    kinds = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (None,), (None,)], "k string")
    assert [tuple(r) for r in frequency.counts_with_none(kinds, "k", "kind").collect()] == [("none", 3), ("x", 2), ("y", 1)]


def test_vocabulary(spark):
    df = spark.createDataFrame([(0, ["running", "runs", "the"]), (1, ["the", "the"])], "set int, w array<string>")
    counts = vocabulary.vocabulary(df, "w")
    assert [r.word for r in vocabulary.frequency_band(counts, 0.1, 0.3).collect()] == ["running", "runs"]
    assert {r.stem: r.n for r in vocabulary.stem_counts(counts).collect()} == {"run": 2, "the": 3}
    assert {(r["set"], r.word): r.n_t for r in vocabulary.set_vocabulary(df, "w").collect()}[1, "the"] == 2
    assert {(r["set"]): r.n for r in vocabulary.set_sizes(df.drop("set")).collect()} == {0: 2}


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_lookup_join_by_bytes(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        _look_up(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _look_up(spark):
    rows = spark.range(1000).withColumn("word", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 5)))
    table = spark.createDataFrame([("hot", 1), ("w0", 2), ("w1", 3)], "word string, v int")
    left = joins.lookup_join(rows, table, "word", "left")
    assert left.count() == 1000 and left.filter("v is null").count() == 180
    assert joins.lookup_join(rows, table, "word").groupBy("v").count().filter("v = 1").first()["count"] == 700


def test_corpus_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, 0, ["a", "a", "b"]), (2, 0, ["b"]), (3, 1, ["a"])] + [(i, 0, ["z"]) for i in range(4, 40)],
                               "id int, set int, w array<string>")
    counts = features.count_rows(df, "id", "w", ["set"])
    got = features.corpus_tfidf(counts, vocabulary.set_vocabulary(df, "w"), vocabulary.set_sizes(df), "id")
    rows = {(r.id, r.word): r.tfidf for r in got.collect()}
    # 38 documents in set 0: ln(38 / 2) = 2.94 is cut to 2, (ln 2 + 1) * 2 = 3.39 to 3.
    assert rows[1, "a"] == 3 and rows[1, "b"] == 2 and rows[3, "a"] == 0 and rows[5, "z"] == 0


def test_padded_sequences(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "x"]), (2, []), (3, ["b"] * 6)], "id int, w array<string>")
    train = spark.createDataFrame([(["a", "a", "a", "b", "b", "c"],)], "w array<string>")
    index = features.sequence_index(train, "w", 4)
    got = {r.id: r.sequence for r in features.padded_sequences(df, "id", "w", index, 5).collect()}
    assert got == {1: [0, 2, 3, 2, 1], 2: [0] * 5, 3: [3] * 5}
    index = features.sequence_index(train, "w", 3, oov=False)
    got = {r.id: r.sequence for r in features.padded_sequences(df, "id", "w", index, 3, oov=False, keep_first=False).collect()}
    assert got == {1: [1, 2, 1], 2: [0] * 3, 3: [2] * 3}


def test_cluster_features(spark):
    df = spark.createDataFrame([("x", 0), ("y", 3)], "t string, c int")
    named = df.select(features.with_cluster_name(F.col("t"), F.col("c")).alias("n"))
    assert [r.n for r in named.collect()] == ["x redCluster", "y violetCluster"]
    terms = spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "cluster int, rank int, term string")
    assert sorted(r.content_with_top_terms for r in features.with_cluster_terms(df, "t", "c", terms).collect()) == ["x a b", "y"]


def test_sentiment_forms_agree(spark):
    lexicon = {"good": (1.0, 0.5), "bad": (-1.0, 1.0)}
    df = spark.createDataFrame([(1, ["good", "bad", "good", "x"]), (2, ["x"]), (3, [])], "id int, w array<string>")
    table = spark.createDataFrame([(w, p, s) for w, (p, s) in lexicon.items()], "word string, polarity double, subjectivity double")
    joined = {r.id: (r.polarity, r.subjectivity) for r in sentiment(df, "id", "w", table).collect()}
    direct = {r.id: tuple(r.s) for r in df.select("id", sentiment_of(F.col("w"), lexicon).alias("s")).collect()}
    assert all(joined[i] == pytest.approx(direct[i]) for i in (1, 2, 3)) and direct[1] == pytest.approx((1 / 3, 2 / 3)) and direct[3] == (0.0, 0.0)


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_neighbours_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(size=(120, 3)), np.zeros((80, 3))])  # 40 percent copies of one vector
    asked = np.concatenate([rng.normal(size=(60, 3)) * 2, np.zeros((30, 3))])
    labels = rng.integers(0, 3, len(points))
    train = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(points, labels))], "id long, vector array<double>, label int")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id long, vector array<double>")
    got = {(r.id, r["rank"]): r.neighbour for r in nearest(train, queries, 3).collect()}
    for i, v in enumerate(asked):
        order = np.lexsort((np.arange(len(points)), np.sqrt(((points - v) ** 2).sum(axis=1))))[:3]
        assert [got[i, rank] for rank in (1, 2, 3)] == order.tolist()
    votes = {r.id: r.prediction for r in classify(train, queries, 3).collect()}
    assert len(votes) == len(asked)


@pytest.mark.parametrize("slice_, kind", [(512, "float"), (7, "double")])
def test_neighbours_of_copies_and_odd_numbers(spark, monkeypatch, slice_, kind):
    """Rows that only rounding tells apart, copies, and vectors without a finite length."""
    monkeypatch.setattr(neighbours, "SLICE", slice_)
    rng = np.random.default_rng(9)
    points = np.round(rng.normal(size=(700, 4)), 1).astype(np.float32).astype(float)
    points[100:400] = points[99] + np.float32(1000)
    points[400:420] = points[400]
    asked = points[::9]
    if kind == "double":
        points[3, 1], points[5, 0] = np.inf, np.nan
    train = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(points)], f"id long, vector array<{kind}>, label int")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], f"id long, vector array<{kind}>")
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in nearest(train, queries, 3).collect()}
    for i, v in enumerate(asked):
        far = np.sqrt(((points - v) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(points)), far))[:3]
        assert [got[i, rank] for rank in (1, 2, 3)] == [(int(at), float(far[at])) for at in order]


@pytest.mark.parametrize("dense", [1, 10 ** 9])
def test_text_neighbours_by_cells_and_by_matrices(spark, monkeypatch, dense):
    for name, value in {"DENSE": dense, "PAIRS": 50, "TERMS": 3, "SLICE": 8, "SPARSE_BLOCK": 32}.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = random.Random(18)
    cells = [(key, term, float(rng.randint(1, 4))) for key in range(90) for term in {min(int(rng.expovariate(0.1)), 60) for _ in range(12)}]
    df = spark.createDataFrame([(*cell, cell[0] % 3) for cell in cells], "id int, index int, value double, label int")
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in neighbours.nearest_texts(df.filter("id < 60"), df.filter("id >= 60").drop("label"), 2).collect()}
    table = np.zeros((90, 61))
    for key, term, value in cells:
        table[key, term] = value
    for query in range(60, 90):
        far = np.sqrt(((table[:60] - table[query]) ** 2).sum(1))
        best = sorted(range(60), key=lambda at: (far[at], at))[:2]
        assert [got[query, rank] for rank in (1, 2)] == [(at, float(far[at])) for at in best]


def test_rows_are_spread_over_shuffle_partitions(spark):
    from newsframe.session import spread
    df, cores = spark.range(0, 100, 1, 8), spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        assert spread(df.coalesce(2)).rdd.getNumPartitions() == cores
        assert spread(df, shuffled=True).rdd.getNumPartitions() == max(24, cores) and spread(df, shuffled=True).count() == 100
        assert spread(df.repartition(40), shuffled=True).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_first_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), F.concat(F.lit("t"), F.col("id")).alias("t")).repartition(5)
    plan = lambda frame: frame._jdf.queryExecution().toString()
    first = ordering.first_rows(df, 1200, "k")
    assert "TakeOrderedAndProject" not in plan(first) and sorted(r.k for r in first.collect()) == list(range(1200))
    assert sorted(r.t for r in ordering.first_rows(df, 700, "t").collect()) == sorted(f"t{at}" for at in range(5000))[:700]
    ties = spark.createDataFrame([(1,), (2,), (2,), (2,), (None,), (3,)], "k long")
    for n in range(8):
        assert [r.k for r in ordering.first_rows(ties, n, "k").orderBy("k").collect()] == [None, 1, 2, 2, 2, 3][:n]


def test_top_of_many(spark):
    counts = spark.range(4000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), (F.col("id") % 50).alias("n"))
    best = frequency.top(counts, 1500, "word", rank="rank")
    rows = sorted(((r.word, r.n) for r in counts.collect()), key=lambda r: (-r[1], r[0]))[:1500]
    assert [(r.word, r.n, r["rank"]) for r in best.orderBy("rank").collect()] == [(*row, at) for at, row in enumerate(rows, start=1)]
    assert "TakeOrderedAndProject" not in best._jdf.queryExecution().toString()


def test_group_index(spark):
    df = spark.range(900).withColumn("g", F.when(F.col("id") % 9 == 0, "few").otherwise(F.when(F.col("id") < 800, "many")))
    rows = ordering.group_index(df, "g", ["id"]).collect()
    for group in ("few", "many", None):
        places = sorted(r.position for r in rows if r.g == group)
        assert places == list(range(len(places))) and places


def test_quota_split_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "a")], "id long, type string")
    with pytest.raises(ValueError, match="unique"):
        sampling.quota_split(df, 4, [0.5], [False], "id", classes=["a"])


def test_vectors_hold_every_term(spark):
    df = spark.createDataFrame([(1, 0, ["b", "a", "b"]), (2, 0, ["c"]), (3, 1, ["zz", "c", "a"]), (4, 1, [])], "id int, set int, w array<string>")
    model = features.count_vectoriser(df.filter("set = 0"), "w")
    rows = {r.id: r for r in model.vectors(df, "id", "w", ["set"]).collect()}
    assert model.size == 3 and [rows[at].features.toArray().tolist() for at in (1, 2, 3, 4)] == [[1, 2, 0], [0, 0, 1], [1, 0, 1], [0, 0, 0]]
    assert rows[3]["set"] == 1
    unit = {r.id: r.features for r in features.tfidf_vectoriser(df.filter("set = 0"), "w").vectors(df, "id", "w").collect()}
    weight = np.log(3 / 2) + 1
    assert unit[1].toArray() == pytest.approx(np.array([weight, 2 * weight, 0]) / np.hypot(weight, 2 * weight)) and unit[2][2] == 1
    band = spark.createDataFrame([("a",), ("c",)], "word string")
    assert features.count_vectoriser(df.filter("set = 0"), "w", band).size == 2


def test_text_neighbours(spark, monkeypatch):
    rng = random.Random(8)
    cells = [(key, term, float(rng.randint(1, 4))) for key in range(60) for term in rng.sample(range(40), 6)]
    df = spark.createDataFrame([(*cell, cell[0] % 3) for cell in cells], "id int, index int, value double, label int")
    monkeypatch.setattr(neighbours, "SPARSE_BLOCK", 16)
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in neighbours.nearest_texts(df.filter("id < 40"), df.filter("id >= 40").drop("label"), 2).collect()}
    dense = np.zeros((60, 40))
    for key, term, value in cells:
        dense[key, term] = value
    for query in range(40, 60):
        far = np.sqrt(((dense[:40] - dense[query]) ** 2).sum(1))
        best = sorted(range(40), key=lambda at: (round(far[at], 9), at))[:2]
        assert [got[query, rank][0] for rank in (1, 2)] == best and got[query, 1][1] == pytest.approx(far[best[0]])


def test_approximate_neighbours_are_near(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(at, Vectors.dense([float(at // 10) * 50, float(at % 10) / 10])) for at in range(50)], ["id", "features"])
    rows = neighbours.approximate_nearest(df, df, 2.0, 3).collect()
    assert rows and all(r.id // 10 == r.neighbour // 10 for r in rows)


def plain_sentiment(words, lexicon, negations, factors, scope):
    """Polarity, subjectivity, negated and intensified words of one text, word by word."""
    turned, last, factor, hits, counts = None, None, 1.0, [], [0, 0]
    for at, word in enumerate(words or []):
        strength = factor if last == at - 1 else 1.0
        if word in lexicon:
            inside = turned is not None and at - turned <= scope
            counts[0] += inside
            counts[1] += strength != 1.0
            polarity, felt = lexicon[word]
            hits.append((max(-1.0, min(1.0, polarity * strength * (-0.5 if inside else 1.0))), max(0.0, min(1.0, felt * strength))))
            factor, last = 1.0, at
        elif word in negations or word in factors:
            turned = at if word in negations else turned
            factor, last = (strength * factors[word] if word in factors else 1.0), at
    size = max(1, len(hits))
    return tuple(round(sum(hit[side] for hit in hits) / size, 9) for side in (0, 1)) + tuple(counts)


def test_scoped_sentiment_follows_the_words(spark):
    rng = random.Random(3)
    lexicon = {"good": (0.7, 0.6), "awful": (-0.9, 1.0), "so": (0.1, 0.1)}
    negations, factors = ["not", "no"], {"very": 1.5, "hardly": 0.4, "so": 9.0}
    rows = [(at, rng.choices(["good", "awful", "not", "no", "very", "hardly", "so", "x", "y"], k=rng.randint(0, 14))) for at in range(150)]
    rows += [(200, None), (201, ["not"] * 3000 + ["good"]), (202, ["very"] * 5 + ["awful"]), (203, ["very", "not", "good"])]
    words = spark.createDataFrame(rows, "id long, words array<string>")
    table = spark.createDataFrame([(word, *values) for word, values in lexicon.items()], "word string, polarity double, subjectivity double")
    got = {r[0]: (round(r[1], 9), round(r[2], 9), r[3], r[4]) for r in scoped_sentiment(words, "id", "words", table, negations, factors).collect()}
    want = {at: plain_sentiment(found, lexicon, negations, factors, 3) for at, found in rows}
    assert all(got[at] == pytest.approx(want[at], abs=1e-8) for at in want) and len(got) == len(want)


def test_sample_summaries_merge(spark):
    """Any cut of a table, with any overlap and in any order, gives the sample of the whole."""
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else f"g{i % 3 if i > 40 else 3}") for i in range(600)], "id long, kind string")
    whole = sorted(map(tuple, sample_per_group(rows, "kind", ["id"], 25, seed=4).select("id", "kind").collect()))
    for cut in (lambda: [F.col("id") % 4 == part for part in range(4)], lambda: [F.col("id") < 300, F.col("id") >= 10, F.col("id") % 5 == 0]):
        parts = [sample_summary(rows.filter(one), "kind", ["id"], 25, seed=4) for one in cut()]
        merged = merge_summaries(parts[::-1], "kind", ["id"], 25)
        again = merge_summaries([merged, parts[0], merged], "kind", ["id"], 25)
        assert sorted(map(tuple, merged.drop("place").collect())) == sorted(map(tuple, again.drop("place").collect())) == whole
    assert sample_summary(rows.filter("false"), "kind", ["id"], 5).count() == 0


def test_terms_are_looked_up_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(features, "WORDS", 60)
    rng = random.Random(3)
    docs = [(key, (key or 0) % 3 > 0, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]) for key in [*range(60), 4, 4, None]]
    docs += [(70, True, None)]
    df = spark.createDataFrame(docs, "id int, train boolean, w array<string>")

    def runs(words):
        return [" ".join(words[at:at + n]) for n in (1, 2, 3) for at in range(len(words) - n + 1)]

    counts, train = {}, {}
    for key, inside, words in docs:
        for term in runs(words or []):
            counts.setdefault(key, Counter())[term] += 1
            if inside:
                train.setdefault(term, set()).add(key)
    want = {}
    for key, own in counts.items():
        weights = {term: n * (np.log(41 / (1 + len(train[term]))) + 1) for term, n in own.items() if term in train}
        length = np.sqrt(sum(value * value for value in weights.values()))
        want |= {(key, term): value / length for term, value in weights.items()}
    blocks = features.in_blocks(df, "id", "w", ["train"], (1, 3))
    terms = blocks.terms().collect()
    assert blocks.size > 3 and len({(r["_block"], r.word) for r in terms}) == len(terms) < sum(map(len, counts.values()))
    idf = features.smooth_idf(blocks, "train", 40)
    got = features.vectoriser_tfidf(blocks, idf).collect()
    assert len(got) == len(want) and {(r.id, r.word): r.tfidf for r in got} == pytest.approx(want)
    bare = features.vectoriser_tfidf(blocks, idf, None)
    assert bare.columns == ["id", "tfidf"] and sorted(r.tfidf for r in bare.collect()) == pytest.approx(sorted(want.values()))
    # Vectors: rows with one key share the counts of all of them, and a row without a key is empty.
    model = features.count_vectoriser(df.filter("train"), "w")
    place = {r.word: r["index"] for r in model.terms.collect()}
    sums = {key: {place[term]: float(n) for term, n in own.items() if term in place} for key, own in counts.items()}
    rows = model.vectors(df, "id", "w", ["train"]).collect()
    assert sorted((r.id is None, r.id or 0, r.train) for r in rows) == sorted((key is None, key or 0, inside) for key, inside, _ in docs)
    for r in rows:
        assert dict(zip(r.features.indices.tolist(), r.features.values.tolist(), strict=True)) == (sums.get(r.id, {}) if r.id is not None else {})
    cells = {(r.id, r["index"]): r.value for r in model.entries(df, "id", "w").collect()}
    assert cells == {(key, at): n for key, own in sums.items() for at, n in own.items()}


def test_terms_travel_in_packets(spark, monkeypatch):
    """A block sends a row for every part and none for every term; words with blanks, empty and missing words make the same terms as joined text."""
    monkeypatch.setattr(features, "WORDS", 400)
    monkeypatch.setattr(features, "PARTS", 3)
    rng = random.Random(5)
    words = ["a", "b", "a b", "b c", "c", "", None, "é"]
    docs = [(key, key % 2 > 0, [rng.choice(words) for _ in range(rng.randint(0, 30))]) for key in range(200)]
    df = spark.createDataFrame(docs, "id int, train boolean, w array<string>")
    runs = {key: Counter(" ".join(own[at:at + n]) for n in (2, 3) for at in range(len(own) - n + 1) if None not in own[at:at + n]) for key, _, own in docs}
    train = Counter(term for key, inside, _ in docs if inside for term in runs[key])
    want = {}
    for key, own in runs.items():
        weights = {term: n * (np.log(101 / (1 + train[term])) + 1) for term, n in own.items() if term in train}
        want |= {(key, term): value / np.sqrt(sum(value * value for value in weights.values())) for term, value in weights.items()}
    blocks = features.in_blocks(df, "id", "w", ["train"], (2, 3))
    idf = features.smooth_idf(blocks, "train", 100)
    assert blocks.size > 4 and 0 < idf.count() <= blocks.size * 3 < len(train)
    got = features.vectoriser_tfidf(blocks, idf).collect()
    assert len(got) == len(want) and {(r.id, r.word): r.tfidf for r in got} == pytest.approx(want)


def test_sparse_rows_are_copied_in_packets(spark, monkeypatch):
    """Blocks of several packets give what a plain search gives; a packet takes few bytes a cell, where a row of numbers takes 16."""
    rng = np.random.default_rng(8)
    rows = [(None if key == 7 else f"k{key}", key % 2, [(int(at), float(rng.integers(1, 4))) for at in rng.choice(400, 60, replace=False)]) for key in range(150)]
    df = spark.createDataFrame([(key, label, at, value) for key, label, cells in rows for at, value in cells], "id string, label int, index int, value double")
    monkeypatch.setattr(neighbours, "SPARSE_BLOCK", 8)
    monkeypatch.setattr(neighbours, "PACKETS", 3)
    table = np.zeros((150, 400))
    for at, (_, _, cells) in enumerate(rows):
        for index, value in cells:
            table[at, index] = value
    train = list(range(100))
    want = {}
    for query in range(100, 150):
        far = sorted((float(((table[query] - table[at]) ** 2).sum()) ** 0.5, rows[at][0] or "", at) for at in train)
        want |= {(rows[query][0], rank): (rows[at][0], distance, rows[at][1]) for rank, (distance, _, at) in enumerate(far[:3], start=1)}
    left, right = (df.filter(f"{side}(coalesce(int(substr(id, 2)), 7) < 100)") for side in ("", "not "))
    got = {(r.id, r["rank"]): (r.neighbour, r.distance, r.label) for r in neighbours.nearest_texts(left, right.drop("label"), 3).collect()}
    assert got.keys() == want.keys() and all(got[at][::2] == want[at][::2] and got[at][1] == pytest.approx(want[at][1]) for at in want)
    cells = df.groupBy(F.col("id").alias("_key"), F.col("label").alias("_label")).agg(F.flatten(F.collect_list(F.array(F.col("index").cast("double"), "value"))).alias("_cells"))
    packets, number = neighbours._packets(cells)
    found = packets.collect()
    assert len(found) > 10 and number == 19 and sum(r["count"] for r in found) == 9000 and sum(len(r.cells) for r in found) < 4 * 9000
