"""Positions, quota splits, stratified batches."""

from pyspark.sql import functions as F

from newsframe.operators.ordering import (dense_index, file_number, file_order_index, nth_keys, sample_per_group,
                                          shuffled_index)
from newsframe.operators.sampling import quota_split, split_report
from queries import sql
from queries.registry import labelled, query, table

_MD5 = "md5(concat_ws(':', '7', doc_id::VARCHAR))"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_MD5}, doc_id) - 1 AS position FROM documents")
def shuffled_positions(spark, sf):
    return shuffled_index(table(spark, sf, "documents").select("doc_id"), ["doc_id"], seed=7)


@query(f"WITH {sql.LABELLED} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM labelled")
def dense_keys(spark, sf):
    return dense_index(labelled(spark, sf).select("doc_id"), "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents")
def file_order_keys(spark, sf):
    return file_order_index(table(spark, sf, "documents")).select("doc_id", "row_id")


@query("""SELECT lpad(CAST(floor((rn - 1) / 100) + 1 AS INTEGER)::VARCHAR, 3, '0') AS file, count(*) AS n, min(doc_id) AS first_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY file""")
def split_file_numbers(spark, sf):
    rows = dense_index(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return (rows.groupBy(file_number(F.col("row_id"), 100).alias("file"))
            .agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")))


@query("""SELECT lang, max(doc_id) AS nth_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn
FROM documents) WHERE rn <= 50 GROUP BY lang HAVING count(*) = 50""")
def nth_key_per_language(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    found = nth_keys(docs, "doc_id", {name: 50 for name in ("en", "de", "fr", "es")}, "lang")
    rows = [(name, key) for name, key in found.items() if key is not None]
    return spark.createDataFrame(rows, "lang string, nth_id long")


_N = "n AS (SELECT count(*) AS n FROM documents)"


@query(f"WITH {sql.SETS} SELECT doc_id, set FROM sets")
def unbalanced_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return quota_split(docs, docs.count(), [0.6, 0.2, 0.2], [False] * 3, "doc_id", "lang").select("doc_id", "set")


def _balanced(classes: str, share: str, size: int) -> str:
    """A balanced set followed by two unbalanced ones of 10 percent each."""
    return f"""{_N}, q AS (SELECT CAST(floor({share}::DOUBLE * n / {size}) AS BIGINT) AS q, CAST(floor(0.1::DOUBLE * n) AS BIGINT) AS u FROM n),
c AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE lang IN ({classes})),
s0 AS (SELECT doc_id FROM c, q WHERE rn <= q),
e0 AS (SELECT max(doc_id) AS last FROM c, q WHERE rn = q HAVING count(*) = {size}),
b1 AS (SELECT min(doc_id) AS first FROM c, e0 WHERE doc_id > last),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents, b1 WHERE doc_id >= first),
split AS (SELECT doc_id, 0 AS set FROM s0 UNION ALL SELECT doc_id, 1 FROM r, q WHERE rn <= u
UNION ALL SELECT doc_id, 2 FROM r, q WHERE rn > u AND rn <= 2 * u)"""


@query(f"""WITH {_balanced("'en', 'fr', 'de', 'es'", '0.3', 4)} SELECT doc_id, set FROM split""")
def balanced_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return quota_split(docs, docs.count(), [0.3, 0.1, 0.1], [True, False, False], "doc_id", "lang",
                       ["en", "fr", "de", "es"]).select("doc_id", "set")


@query(f"""WITH {_balanced("'fr', 'de'", '0.1', 2)} SELECT doc_id, coalesce(set, -1) AS set FROM documents LEFT JOIN split USING (doc_id)""")
def balanced_split_keeping_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return quota_split(docs, docs.count(), [0.1, 0.1, 0.1], [True, False, False], "doc_id", "lang", ["fr", "de"],
                       delete=False).select("doc_id", F.coalesce("set", F.lit(-1)).alias("set"))


@query(f"""WITH {_N}, w AS (SELECT lang AS label, CAST(floor(0.8::DOUBLE * n / 4) AS BIGINT) AS wanted FROM n,
(VALUES ('en'), ('fr'), ('de'), ('es')) v(lang)), g AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang)
SELECT 0 AS set, label, wanted, coalesce(least(c, wanted), 0) AS got FROM w LEFT JOIN g ON lang = label
UNION ALL SELECT 1, NULL, CAST(floor(0.1::DOUBLE * n) AS BIGINT), 0 FROM n""")
def short_split_report(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    plan = dict(total_size=docs.count(), splits=[0.8, 0.1], balanced=[True, False], label="lang",
                classes=["en", "fr", "de", "es"])
    return split_report(quota_split(docs, key="doc_id", **plan), **plan)


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY
md5(concat_ws(':', '3', doc_id::VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 60""")
def stratified_batch(spark, sf):
    return sample_per_group(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 60, seed=3)
