"""Toxicity, conversation repair and ranked search against plain versions, with nulls, ties, long texts and clashing columns."""

import math
import random
import re

import numpy as np
from plain_chats import expected
from pyspark.sql import functions as F

from newsframe.llm.common import table
from newsframe.llm.conversations import repair, repair_damaged
from newsframe.llm.lexical import ranked_documents
from newsframe.llm.passages import held_out
from newsframe.llm.textbytes import span_hashes
from newsframe.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity

CHATS = "conv_id long, turn long, role string, text string"


def test_span_hashes_have_no_polynomial_collisions():
    line = [bin(number).count("1") % 2 for number in range(1024)]
    one, two = ("".join("ab"[bit ^ flip] for bit in line).encode() for flip in (0, 1))
    data = np.frombuffer(one + two + one[:3] + one[:3] + b"\0", np.uint8)
    starts, ends = np.array([0, 1024, 2048, 2051, 5, 2048]), np.array([1024, 2048, 2051, 2054, 5, 2055])
    found = span_hashes(data, starts, ends)
    assert found[0] != found[1] and found[2] == found[3] and len(set(found.tolist())) == 5


def test_repair_equals_search_over_audits(spark):
    rng = random.Random(4)
    texts = ["Hi.", "Hi", "Well?", "", " \t", "no end", "Yes!", None, "Ä.", "a\nb!"]
    rows = [(conv, rng.choice([None, *range(size)]) if rng.random() < 0.3 else turn,
             rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts))
            for conv in [None, *range(60)] for size in [rng.randint(1, 14)] for turn in range(size)]
    rows += rows[:9]
    found = {row[0]: tuple(row)[1:] for row in repair_damaged(spark.createDataFrame(rows, CHATS).withColumn("seq", F.lit(1))).collect()}
    assert found == expected(rows)


def test_repair_of_one_long_conversation_and_an_empty_table(spark):
    rng = random.Random(9)
    rows = [(7, turn, rng.choice(["user", "assistant", "system"]), f"text {turn % 300}" + rng.choice([".", ""])) for turn in range(400)]
    frame = spark.createDataFrame(rows, CHATS).repartition(5)
    assert {row[0]: tuple(row)[1:] for row in repair_damaged(frame).collect()} == expected(rows)
    assert repair_damaged(frame.filter("false")).count() == 0
    assert repair(frame.filter("false")).count() == 0


def plain_search(docs, items, k):
    cut = lambda text: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    bags = [(doc, cut(text)) for doc, text in docs]
    total, terms = sum(bool(words) for _, words in bags), sum(len(words) for _, words in bags)
    df = {}
    for _, words in bags:
        for word in set(words):
            df[word] = df.get(word, 0) + 1
    found = []
    for item, text in items:
        scores = []
        for doc, words in bags:
            m = 50 + (50 * len(words) * total) // max(terms, 1)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[word] + 1))) * ((10 ** 9 * words.count(word)) // (1000 * words.count(word) + 20 * m))
                        for word in set(cut(text)) & set(words))
            if score > 0:
                scores.append((-score, doc is None, doc, score))
        found += [(item, rank, row[2], row[3]) for rank, row in enumerate(sorted(scores, key=lambda row: (row[0], row[1], row[2] or 0))[:k], 1)]
    return sorted(found, key=str)


def test_search_equals_plain_scores(spark):
    rng = random.Random(2)
    words = [f"w{number}" for number in range(40)] + ["É", "ß9", "Ünd"]
    docs = [(number, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for number in range(150)]
    docs += [(number, "same W1 w2, W3") for number in range(200, 260)] + [(300, None), (301, ""), (302, "..!"), (303, "w1 " * 5000), (5, "w1 w7")]
    items = [(1, "w1 W2 w2 w40"), (2, None), (3, "É ß9 nothing"), (4, "unheard"), (5, " ".join(words))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class", F.lit("x")).withColumn("n", F.lit(3)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("word", F.lit(0))
    for k in (3, 50):
        assert sorted(map(tuple, ranked_documents(frame, asked, k).collect()), key=str) == plain_search(docs, items, k)
    assert ranked_documents(frame.filter("false"), asked).count() == 0
    assert ranked_documents(frame, asked.filter("false")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    scored = score_toxicity(docs.withColumn("score", F.lit("x")).withColumn("__score", F.lit(1)), fit_toxicity(docs, labels))
    assert scored.columns == [*docs.columns, "score", "__score"] and scored.count() == docs.count()
    judged = scored.join(labels, "doc_id").filter(held_out("doc_id") & (F.col("lang") == "en"))
    toxic, caught, clean, left = judged.agg(F.sum("toxic"), F.sum(F.expr("int(toxic = 1 and score >= 0.3)")), F.sum(F.expr("int(toxic = 0)")),
                                            F.sum(F.expr("int(toxic = 0 and score < 0.3)"))).first()
    assert caught >= 0.8 * toxic and left >= 0.9 * clean


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "bad x"), (1, "bad x"), (1, None), (2, ""), (3, None), (4, "fine " * 40_000), (None, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 0), (4, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels, prior=0.2)
    scores = [row.score for row in score_toxicity(docs, model).collect()]
    assert len(scores) == 7 and all(0 <= score <= 1 for score in scores)
    assert score_toxicity(docs.filter("false"), model).count() == 0
    none = fit_toxicity(docs, labels.filter("false"))
    assert none.constant == 0.5 and {row.score for row in score_toxicity(docs, none).collect()} == {0.5}


def test_risk_learns_from_positive_and_unlabelled_rows_alone():
    rng = np.random.default_rng(1)
    text = lambda toxic: np.concatenate([rng.integers(100, 5000, (30, 5)), np.full((toxic, 5), 7)]).astype(np.int32)
    hidden = [number % 5 == 0 for number in range(1000)]
    model = ToxicityModel().fit([text(1) for _ in range(200)], [text(int(toxic)) for toxic in hidden], 0.2)
    fresh = [text(number % 2) for number in range(200)]
    scores = np.concatenate([model.score(rows, np.array([0, len(rows)])) for rows in fresh])
    right = (scores >= 0.3) == (np.arange(200) % 2 == 1)
    assert right.mean() >= 0.95
    assert abs((scores >= 0.3).mean() - 0.5) < 0.05
