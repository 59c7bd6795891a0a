"""The pipeline's stages and the queries without SQL against plain versions, over whole tables."""

import hashlib
from collections import Counter

import corpus_pipeline
from test_models import plain_rules
from test_native import plain_hits, plain_poisson
from test_pairs import plain_join, plain_repeats

from newsframe.llm.mixing import repetition_rates
from newsframe.llm.passages import fit_quality, score_quality
from newsframe.llm.queries import QUERIES
from newsframe.session import materialise

FOLDER = "/root/testdata/sf0.001"


def rows_of(spark, name="documents"):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    assert [name.split("_")[0] for name in QUERIES] == [f"op{at}" for at in range(1, 14)]


def test_stages_against_plain_versions(spark):
    docs, stages = rows_of(spark), [stage for _, stage in corpus_pipeline.STAGES]
    columns, bench = docs.columns, [tuple(row) for row in rows_of(spark, "benchmark").select("item_id", "text").collect()]
    scored = score_quality(docs, fit_quality(docs, rows_of(spark, "labels"))).collect()

    good = materialise(stages[0](spark, docs, FOLDER))
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in scored if r.score >= 0.7}

    single = materialise(stages[1](spark, good, FOLDER))
    want = plain_join([(r.doc_id, r.text) for r in good.collect()], 5, 80, 100)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted({component for _, _, component in want})

    clean = materialise(stages[2](spark, single, FOLDER))
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not plain_hits(r.text, bench)[4]}

    mixed = materialise(stages[3](spark, clean, FOLDER))
    rates = {r.source: r.rate for r in repetition_rates(clean).collect()}
    wanted = {r.doc_id: plain_poisson(rates[r.source], None, 0, r.doc_id) for r in clean.collect()}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({key: n for key, n in wanted.items() if n})

    placed = stages[4](spark, mixed, FOLDER).collect()
    assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in mixed.collect())
    for row in placed:
        best = max(range(16), key=lambda shard: hashlib.md5(f"0:{shard}:{row.doc_id}".encode()).hexdigest())
        assert row["shard"] == best
    for shard in {row["shard"] for row in placed}:
        assert sorted(row.slot for row in placed if row["shard"] == shard) == list(range(sum(row["shard"] == shard for row in placed)))
    assert sorted((r.doc_id, r["shard"], r.slot) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(
        (r.doc_id, r["shard"], r.slot) for r in placed)


def test_suffix_query(spark):
    docs = sorted((r.doc_id, r.text) for r in rows_of(spark).select("doc_id", "text").collect())
    want = dict(zip((key for key, _ in docs), plain_repeats([text.encode() for _, text in docs]), strict=True))
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op1_suffix_dedup"](spark, FOLDER).collect()} == want


def test_rules_query(spark):
    want = {r.doc_id: plain_rules(r.text) for r in rows_of(spark).collect()}
    for row in QUERIES["op5_quality_rules"](spark, FOLDER).collect():
        assert tuple(row)[1:6] == want[row.doc_id]
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words) and not (row.base_failed and row.kept)


def test_rows_of_the_other_queries(spark):
    for name, table in (("op3_lm_scoring", "documents"), ("op7_quality", "documents"), ("op8_html_extraction", "pages")):
        assert QUERIES[name](spark, FOLDER).count() == rows_of(spark, table).count()
