"""LM scoring, quality rules, the quality classifier and HTML extraction."""

import html as entities
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsframe.llm import lmscore
from newsframe.llm.compression import measure, quality_rules
from newsframe.llm.htmlblocks import BlockLabeller, block_features, extract_main_text, fit_labeller, page_blocks
from newsframe.llm.lmscore import matched_models, score_against_corpus, score_documents
from newsframe.llm.passages import fit_quality, held_out, keep_quality, score_quality

FOLDER = "/root/testdata/sf0.01"


def plain_losses(texts, target, background, order=4):
    """Losses per token from counters alone."""
    def symbols(text):
        return [int(lmscore._SYMBOL[ord(c)]) if ord(c) < 128 else 31 for c in text or ""]

    def grams(texts):
        found = Counter()
        for text in texts:
            row = [0] * (order - 1) + symbols(text)
            found.update(tuple(row[at:at + order]) for at in range(len(row) - order + 1))
        return found
    tables = [grams(target), grams(background)]
    least = min(sum(table.values()) for table in tables)
    losses = []
    for table in tables:
        scale = least / sum(table.values())
        sums = {}
        for gram, n in table.items():
            for size in range(0, order + 1):
                sums[gram[order - size:]] = sums.get(gram[order - size:], 0) + n * scale
        heads = {}
        for gram, n in table.items():
            for size in range(0, order):
                heads[size, gram[order - 1 - size:order - 1]] = heads.get((size, gram[order - 1 - size:order - 1]), 0) + n * scale

        def chance(gram):
            p = 1 / 32
            for size in range(1, order + 1):
                own = gram[order - size:]
                p = (sums.get(own, 0) + 20 * p) / (heads.get((size - 1, own[:-1]), 0) + 20)
            return p
        rows = []
        for text in texts:
            row = [0] * (order - 1) + symbols(text)
            parts = [math.log(chance(tuple(row[at:at + order]))) for at in range(len(row) - order + 1)]
            rows.append(-sum(parts) / len(parts) if parts else None)
        losses.append(rows)
    return losses


def test_lm_scores_against_counters(spark, edge_docs, no_docs):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc de.\né9#") for _ in range(rng.randint(0, 90))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(at, text, 5.0) for at, text in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    docs = docs.withColumn("good", F.when(F.col("doc_id") % 3 == 0, True))
    want = plain_losses(texts, [text for at, text in enumerate(texts) if at % 3 == 0], texts)
    rows = sorted(score_documents(docs, matched_models(docs, "good")).collect(), key=lambda row: row.doc_id)
    for at, row in enumerate(rows):
        assert row.n_tokens == len(texts[at] or "")
        if texts[at]:
            assert row.target_loss == pytest.approx(want[0][at], abs=1e-4) and row.background_loss == pytest.approx(want[1][at], abs=1e-4)
            assert row.score == pytest.approx(row.target_loss - row.background_loss)
        else:
            assert row.score is None
    assert score_documents(edge_docs, matched_models(edge_docs.withColumn("good", F.lit(False)), "good")).count() == 11
    assert score_documents(no_docs, matched_models(no_docs.withColumn("good", F.lit(True)), "good")).count() == 0


def test_lm_scores_over_all_code_points(spark, edge_docs, no_docs):
    """Other scripts, accents, digits and case are told apart, as by counters alone."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(row) for _ in range(rng.randint(0, 90))) for row in ("漢字仮名😀", "абвгд", "aAéè1239 ") * 14] + [None, "", "\0x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs = docs.withColumn("good", F.when(F.col("doc_id") % 4 == 0, True))
    rows = sorted(score_against_corpus(docs, "good").collect(), key=lambda row: row.doc_id)
    grams = [[(("",) * 3 + tuple(text or ""))[at:at + 4] for at in range(len(text or ""))] for text in texts]
    size = len({gram[3] for row in grams for gram in row})
    tables = [Counter(gram for at, row in enumerate(grams) if at % 4 == 0 for gram in row), Counter(gram for row in grams for gram in row)]
    for name, table in zip(("target_loss", "background_loss"), tables, strict=True):
        scale = min(t.total() for t in tables) / table.total()
        sums, heads = Counter(), Counter()
        for gram, n in table.items():
            for width in range(1, 5):
                sums[gram[4 - width:]] += n * scale
                heads[width, gram[4 - width:3]] += n * scale
        for row, own in zip(rows, grams, strict=True):
            losses = []
            for gram in own:
                p = 1 / size
                for width in range(1, 5):
                    p = (sums[gram[4 - width:]] + 20 * p) / (heads[width, gram[4 - width:3]] + 20)
                losses.append(-math.log(p))
            assert row.n_tokens == len(own)
            assert row[name] == (pytest.approx(sum(losses) / len(own), abs=1e-4) if own else None)
    wide = spark.createDataFrame([(1, "漢字" * 30, True), (2, "仮名" * 30, None)], "doc_id long, text string, good boolean")
    low, high = (row.score for row in score_against_corpus(wide, "good").orderBy("doc_id").collect())
    assert low < 0 < high
    assert score_against_corpus(edge_docs.withColumn("good", F.lit(False)), "good").count() == 11
    assert score_against_corpus(no_docs.withColumn("good", F.lit(True)), "good").count() == 0


def test_lm_blocks_of_many_symbols():
    """More distinct symbols than fit one number are still counted exactly."""
    letters = np.random.default_rng(5).permutation(np.concatenate((np.arange(32, 0xD800), np.arange(0xE000, 0x20000))))
    text = "".join(map(chr, letters))
    buffer, offsets = lmscore.text_bytes(pa.array([text, "ab"]))
    symbols, places, counts = lmscore.code_point_grams(buffer, offsets)
    found = [pair for part, distinct, _, cells in lmscore._pieces(symbols, places) for pair in zip(*lmscore._pair_columns(cells, distinct), strict=True)]
    row = [0, 0, 0, *(ord(c) + 1 for c in text)]
    assert counts.tolist() == [len(text), 2] and [tuple(map(int, pair)) for pair in found[:len(text)]] == [
        (row[at] << 22 | row[at + 1], row[at + 2] << 22 | row[at + 3]) for at in range(len(text))]
    hi, lo = np.array(found).T
    got, sums = lmscore.score_group(pa.array([text, "ab"]), hi, lo, np.arange(len(found), dtype=float))
    assert got.tolist() == [len(text), 2] and sums[0].tolist() == [len(text) * (len(text) - 1) / 2, 2 * len(text) + 1]


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[at:at + 3]) for at in range(len(words) - 2))
    covered = {at + step for at in range(len(words) - 2) if windows[tuple(words[at:at + 3])] > 1 for step in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_against_plain_counts(spark, edge_docs, no_docs):
    rng = random.Random(2)
    rows = [(at, "".join(rng.choice("ab \n#é\t") for _ in range(rng.randint(0, 70)))) for at in range(400)]
    rows += [(row.doc_id, row.text) for row in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(row)[:7] for row in quality_rules(docs).collect())
    want = sorted((key, *plain, plain[0] < 50 or 100 * plain[4] > 50 * plain[0]) for key, plain in ((key, plain_rules(text)) for key, text in rows))
    assert got == want
    assert quality_rules(edge_docs).count() == 11 and quality_rules(no_docs).count() == 0


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(3)
    words = [row[0] for row in spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id = 6").select("text").collect()][0].split()
    clean = " ".join(rng.choice(words) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(8)) for _ in range(3000))
    rare = " ".join(f"{word} {at % 7}" for at, word in enumerate(["same old line of words"] * 900))
    docs = spark.createDataFrame([(1, clean), (2, noise), (3, rare), (4, clean[:700])], "doc_id long, text string")
    assert {row.doc_id: row.kept for row in quality_rules(docs).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_classifier_on_held_out_rows(spark, edge_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels"))
    scored = score_quality(docs.withColumn("score", F.lit("old")), fit_quality(docs, labels)).select("doc_id", "score", held_out("doc_id").alias("held"))
    rows = scored.join(labels, "doc_id").toPandas()
    assert all(row.held == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) for row in rows.itertuples())
    held = rows[rows.held]
    assert ((held.score >= 0.7) == (held.quality == 1)).mean() > 0.95 and rows.score.between(0, 1).all()
    model = fit_quality(docs, labels)
    edge = score_quality(edge_docs, model)
    assert edge.columns == edge_docs.columns and edge.filter("score between 0 and 1").count() == 11
    assert score_quality(no_docs, model).count() == 0
    assert keep_quality(edge_docs, labels.limit(0)).count() == 11
    assert keep_quality(docs, labels).columns == docs.columns


def test_classifier_gradient():
    """The fit lowers the loss on a rule that one passage decides."""
    from newsframe.llm.passages import FEATURES, AttentionModel
    rng = np.random.default_rng(4)
    documents = [rng.standard_normal((rng.integers(1, 9), FEATURES)).astype(np.float32) for _ in range(300)]
    labels = np.array([float(rows[:, 5].max() < 1.2) for rows in documents])
    model = AttentionModel().fit(documents, labels)
    score = model.score(np.concatenate(documents), np.array([len(rows) for rows in documents]))
    assert ((score >= 0.5) == labels).mean() > 0.85


PAGE = ("<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>A</a>"
        "</li><li><a>B</a></li></ul></nav><!-- ad --><div class='ad'>Buy now.</div><article><h1>Head&nbsp;line</h1><p><b>bo</b>ld &lt;x&gt;<br>next"
        "<p>a < b\n\t c</article><footer>&copy; me</footer>")


@pytest.mark.parametrize("tag", ["<svg width='1'/>", "<math/>", "<object data='x'>", "<select>", "<svg-icon></svg-icon>", "<iframe>", "<template>",
                                 "<noscript>", "<script-box></script-box>", "<style-x>"])
def test_blocks_after_open_containers(tag):
    """A container that is closed in itself, never, or by another name loses none of the rest of the page."""
    texts = [text for _, text, _ in page_blocks(f"<article><p>before</p>{tag}<p>after one</p><p>after two</p></article>")]
    assert texts == ["before", "after one", "after two"]
    inner = page_blocks("<p>so <math><mi>x</mi></math></p><object><p>in it</p></object><textarea><p>no</textarea><script>if(a<b)</script>")
    assert [text for _, text, _ in inner] == ["so", "x", "in it"]


def test_blocks():
    blocks = page_blocks(PAGE)
    assert [text for _, text, _ in blocks] == ["T & x", "A", "B", "Buy now.", "Head line", "bold <x> next", "a < b c", "© me"]
    assert [".ad" in names for names, _, _ in blocks][3] and blocks[1][2] == 1.0
    assert page_blocks("") == [] and page_blocks("<p></p><script>x") == [] and page_blocks("<div") == [((), "<div", 0.0)]
    assert page_blocks("x" * 100_000 + "<" * 50_000)[0][1].startswith("xxx")
    assert len(page_blocks("<div>" * 3000 + "deep")) == 1


def test_labeller_gradient_descends():
    rng = np.random.default_rng(5)
    pages = [[((name,), "some words here", 0.0) for name in rng.choice(["p", "li", "td"], rng.integers(2, 9))] for _ in range(60)]
    labels = [np.cumsum([block[0][0] == "td" for block in page]).clip(0, 1).astype(float) for page in pages]  # on from the first td
    rows = np.split(block_features(pages).astype(float), np.cumsum([len(page) for page in pages])[:-1])
    scores = BlockLabeller().fit(rows, labels, steps=150).label(rows)
    assert np.mean([((score >= 0.5) == own).mean() for score, own in zip(scores, labels, strict=True)]) > 0.97


def test_extraction(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    model = fit_labeller(pages)
    got = extract_main_text(pages.withColumn("n_chars", F.lit("old")), model).collect()
    for row in got:
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", row.html, re.S).group(1))
        assert row.text == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", body)).split()) and row.n_chars == len(row.text)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<p></p>"), (None, PAGE), (4, PAGE), (4, PAGE)], "page_id long, html string")
    texts = [(row.page_id, row.text) for row in extract_main_text(odd, model).collect()]
    assert texts[:3] == [(1, ""), (2, ""), (3, "")] and len(set(text for _, text in texts[3:])) == 1
    assert extract_main_text(odd.limit(0), model).count() == 0


def test_measure_of_nothing():
    assert measure(np.zeros(0, np.uint8), np.zeros(1, np.int64)) == []


def test_classifier_with_hot_keys_long_texts_and_clashing_columns(spark):
    """Keys that many documents share, texts of many passages, and columns named like the result."""
    rows = [(1, f"word{at % 50} " * 40) for at in range(300)] + [(2, "good text here. " * 20_000)] + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("__score", F.lit(1)).withColumn("__quality", F.lit(2))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (1, 1), (2, None)], "doc_id long, quality int")
    scored = score_quality(docs, fit_quality(docs, labels))
    assert scored.columns == ["doc_id", "text", "score", "__score", "__quality"]
    assert scored.count() == 302 and all(0 <= row.score <= 1 for row in scored.collect())
    assert keep_quality(docs, labels).columns == docs.columns


def test_lines_are_compared_by_sound_hashes(spark):
    """Two lines whose polynomial hashes modulo 2^64 are equal are still two lines."""
    bits = [bin(number).count("1") % 2 for number in range(1024)]
    one, two = ("".join("ab"[bit ^ flip] for bit in bits) for flip in (0, 1))
    rows = quality_rules(spark.createDataFrame([(1, f"{one}\n{two}"), (2, f"{one}\n{one}")], "doc_id long, text string")).collect()
    assert {row.doc_id: row.n_dup_lines for row in rows} == {1: 0, 2: 1}
