"""URL filter, mixing, decontamination and sharding."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from newsframe.llm.decontamination import benchmark_hits, drop_contaminated
from newsframe.llm.mixing import mix_sources, repetition_rates
from newsframe.llm.sharding import shard_rows
from newsframe.llm.urlfilter import judge_urls, url_host, url_path

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]


def test_url_parts(spark):
    cases = {"https://A.Example.ORG/En/x?q#f": ("a.example.org", "/En/x"), "no scheme": ("", ""), None: ("", ""), "": ("", ""),
             "http://h": ("h", ""), "http://h?x=/y": ("h", ""), "x://a://b/c": ("a:", "//b/c"), "://É.org#": ("É.org", ""), "a#://h/p": ("h", "/p")}
    df = spark.createDataFrame([(url,) for url in cases], "url string")
    got = {row[0]: (row[1], row[2]) for row in df.select("url", url_host("url"), url_path("url")).collect()}
    assert got == cases


def test_url_verdicts(spark):
    rows = [(1, "http://x.example.org/es/1", "old"), (2, "http://example.org/en/12", "old"), (3, "http://badexample.org/es/", "old"),
            (4, "https://www.spam.net/a/?b=1&utm_source=z", None), (5, "http://spam.net:80/a?b=1#f", None), (6, "http://spam.net/other", None),
            (None, None, None), (7, "junk", None), (4, "https://www.spam.net/a/?b=1&utm_source=z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    listed = spark.createDataFrame([("spam.net/a?b=1",), ("spam.net/a?b=1",), (None,)], "canonical string")
    got = [(r.page_id, r.rule, r.verdict) for r in judge_urls(pages, listed, RULES).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "example.org/es/", "block"), (2, "example.org/en/1", "block"), (3, "org/", "allow"), (4, None, "block"), (4, None, "block"),
        (5, None, "block"), (6, None, "allow"), (None, None, "allow"), (7, None, "allow")], key=str)
    assert judge_urls(pages.limit(0), listed, RULES).count() == 0
    assert judge_urls(pages, listed.limit(0), RULES).filter("verdict = 'block'").count() == 2


def test_filter_has_no_false_results(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 50, F.lit(".net/"), "id").alias("url"))
    listed = spark.range(0, 5000, 7).select(F.concat(F.lit("h"), F.col("id") % 50, F.lit(".net/"), "id").alias("canonical"))
    got = {r.page_id for r in judge_urls(pages, listed, []).filter("verdict = 'block'").collect()}
    assert got == set(range(0, 5000, 7))


def plain_poisson(mean, number, seed, key):
    parts = max(math.ceil(mean / 8), 1)
    total = 0
    for part in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}:{part}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        p = bound = math.exp(-mean / parts)
        k = 0
        while bound < u and k < 64:
            k += 1
            p *= mean / parts / k
            bound += p
            total += 1
    return total


def test_mixing_inverts_the_distribution(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 10 else 1), f"s{min(i % 10, 2)}") for i in range(600)], "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in repetition_rates(docs).collect()}
    got = Counter(r.doc_id for r in mix_sources(docs).collect())
    assert rates["s0"] > 8
    for i in range(600):
        assert got[i] == plain_poisson(rates[f"s{min(i % 10, 2)}"], None, 0, i)
    mixed = mix_sources(docs)
    shares = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert max(shares.values()) < 1.4 * min(shares.values())
    assert mixed.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0


def test_mixing_edge_rows(edge_docs, no_docs):
    mixed = mix_sources(edge_docs, weights={"s": 3.0}, total=2_000_000.0)
    assert set(edge_docs.columns) <= set(mixed.columns) and mixed.count() > 0
    assert mix_sources(no_docs).count() == 0
    assert mix_sources(edge_docs.filter("text is null or text = ''")).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i, "x" * (i % 7 + 1), f"s{i % 3}", 0.5, "c", "o", "p") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double, copy string, order_key string, __parts string")
    mixed = mix_sources(docs, copy="c1", order_key="o1")
    assert mixed.columns == [*docs.columns, "c1", "o1"]
    assert {(r.rate, r.copy, r.order_key, r["__parts"]) for r in mixed.collect()} == {(0.5, "c", "o", "p")}
    assert mix_sources(docs).schema["copy"].dataType.simpleString() == "int"


def test_rows_of_one_hot_key_are_numbered_by_salts(spark):
    docs = spark.createDataFrame([(7, "same")] * 900 + [(i, f"t{i}") for i in range(1200)] + [(None, None)] * 300, "doc_id long, text string").repartition(6)
    placed = shard_rows(docs, "doc_id", [1.0] * 3, rows_per_bucket=50).toPandas()
    assert len(placed) == 2400 and placed[placed.doc_id == 7]["shard"].nunique() == 1
    for _, rows in placed.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    plain = shard_rows(docs, "doc_id", [1.0] * 3, rows_per_bucket=10_000).toPandas()
    alone = lambda frame: {(r.doc_id, r.shard, r.slot) for r in frame.itertuples() if r.doc_id == r.doc_id and r.doc_id != 7}
    assert alone(placed) == alone(plain)


def test_shards(spark, edge_docs, no_docs):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id").withColumn("slot", F.lit("old"))
    placed = shard_rows(docs, "doc_id", [1.0] * 16, grown_weights=[1.0] * 17, rows_per_bucket=20).toPandas()
    assert ((placed.shard == placed.grown_shard) | (placed.grown_shard == 16)).all()
    for _, rows in placed.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows))) and 180 < len(rows) < 330
    weighted = shard_rows(docs, "doc_id", [3.0, 1.0, 0.0]).groupBy("shard").count().collect()
    assert {r["shard"] for r in weighted} == {0, 1} and 2800 < max(r["count"] for r in weighted) < 3200
    edge = shard_rows(edge_docs, "doc_id", [1.0, 1.0]).toPandas()
    assert len(edge) == 11 and all(sorted(rows.slot) == list(range(len(rows))) for _, rows in edge.groupby("shard"))
    assert edge[edge.doc_id.isna()]["shard"].nunique() == 1 and edge[edge.doc_id == 1]["shard"].nunique() == 1
    assert shard_rows(no_docs, "doc_id", [1.0]).count() == 0


def plain_hits(text, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    doc, hit, found = words(text), set(), set()
    for key, item in items:
        item = words(item)
        size = min(width, len(item))
        windows = {tuple(item[at:at + size]) for at in range(len(item) - size + 1)} if item else set()
        for at in range(len(doc) - size + 1 if windows else 0):
            if tuple(doc[at:at + size]) in windows:
                hit |= set(range(at, at + size))
                found.add(str(key))
    return (len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(doc))


def test_decontamination_against_brute_force(spark, edge_docs, no_docs):
    import random

    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choice(["a", "B", "c", "dé", "x1"]) for _ in range(n))
    items = [(i, draw(rng.choice([1, 2, 3, 5, 13, 14, 30]))) for i in range(25)] + [(90, ""), (91, None), (7, "One TWO three four")]
    texts = [(i, draw(rng.randint(0, 80))) for i in range(60)]
    texts += [(100 + i, f"{draw(9)} {rng.choice(items[:25])[1]}, {draw(5)}") for i in range(40)] + [(200, None), (201, ""), (0, texts[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((key, *plain_hits(text, items)) for key, text in texts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for bound in (before, "-1"):  # the plan is the same, whether Spark sends the windows to the words or shuffles both
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        got = benchmark_hits(docs.withColumn("window", F.lit(1)).withColumn("row", F.lit("r")), bench).drop("text_hash").collect()
        assert sorted(tuple(row) for row in got) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(row[0] for row in want if not row[5])
    assert benchmark_hits(edge_docs, bench).count() == 11 and benchmark_hits(no_docs, bench).count() == 0
    assert benchmark_hits(edge_docs, bench.limit(0)).filter("n_hit > 0").count() == 0
