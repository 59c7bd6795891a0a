"""Readers, writers and codecs, checked by writing tables and reading them back."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsframe.functions import text, vectors
from newsframe.operators import features
from newsframe.operators.ordering import file_number
from newsframe.operators.rows import preview
from newsframe.plans.steps import run_files
from newsframe.session import materialise, shared_folder
from newsframe.sources import codecs, readers, writers
from newsframe.streaming import incremental
from queries import sql
from queries.registry import documents_in_sets, labelled_words, query, table, texts


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


_DOCS = "SELECT doc_id, lang, source, md5(text) AS text_md5, length(text) AS n FROM documents"


@query(_DOCS)
def csv_round_trip(spark, sf):
    path = _folder(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    writers.write_csv(docs, path)
    back = readers.read_csv(spark, path, T.StructType(docs.schema.fields))
    return back.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


@query("SELECT conv_id || '.json' AS id, role AS label, md5(text) AS statement_md5, turn AS barely_true FROM conversations")
def tsv_statements(spark, sf):
    path = _folder(spark)
    empty = F.lit(None).cast("string")
    rows = table(spark, sf, "conversations").select(
        F.concat("conv_id", F.lit(".json")), F.col("role"), F.col("text"), *[empty.alias(f"e{i}") for i in range(5)],
        F.col("turn"), *[F.lit(0).alias(f"z{i}") for i in range(4)], empty.alias("context"))
    rows.write.option("sep", "\t").option("header", False).option("quote", '"').option("escape", '"').csv(path)
    back = readers.read_tsv(spark, path, multi_line=True)
    return back.select("id", "label", F.md5("statement").alias("statement_md5"), F.col("barely_true").cast("long").alias("barely_true"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def limited_rows(spark, sf):
    return readers.read_columns(spark, f"{sf}/documents.parquet", ["doc_id", "source"], 100, "doc_id")


@query("SELECT doc_id, lang FROM documents")
def pruned_columns(spark, sf):
    return readers.read_columns(spark, f"{sf}/documents.parquet", ["doc_id", "lang"])


@query("""SELECT doc_id AS id, md5(text) AS text_md5, lang AS kind FROM documents UNION ALL SELECT conv_id, md5(text), role FROM conversations
UNION ALL SELECT item_id, md5(text), 'none' FROM benchmark""")
def combined_files(spark, sf):
    frames = [table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("kind")),
              table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text", F.col("role").alias("kind")),
              table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")]
    return readers.combine(*frames).select("id", F.md5("text").alias("text_md5"), F.coalesce("kind", F.lit("none")).alias("kind"))


@query("""SELECT lpad(CAST(doc_id // 250 + 1 AS VARCHAR), 3, '0') AS file, count(*) AS n, sum(length(text))::BIGINT AS chars
FROM documents GROUP BY file""")
def split_files(spark, sf):
    path = _folder(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    writers.write_split(docs, path, "doc_id", 250, 2)
    back = (spark.read.schema("doc_id long, text string").option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))
    files = back.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return files.select(file_number(F.col("first"), 250).alias("file"), "n", "chars")


@query("SELECT doc_id AS id, source AS domain, lang AS type, md5(text) AS text_md5, NULL::VARCHAR AS title FROM documents")
def csv_by_header(spark, sf):
    """A raw file as it comes: an unnamed first column, others in any order, one unknown and some missing."""
    path = _folder(spark)
    docs = table(spark, sf, "documents")
    rows = docs.select((F.col("doc_id") + 7).alias(" "), F.col("text").alias("content"), F.lit("x").alias("unknown"),
                       F.col("lang").alias("type"), F.col("doc_id").alias("id"), F.col("source").alias("domain"))
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).csv(path)
    return readers.read_csv(spark, path).select("id", "domain", "type", F.md5("content").alias("text_md5"), "title")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'bad' ELSE 'good' END AS row FROM documents WHERE doc_id % 10 <> 4")
def csv_bad_rows(spark, sf):
    """Lines with a cell too many, or a number that is none, are told apart from good ones."""
    path = _folder(spark)
    line = F.when(F.col("doc_id") % 10 == 3, F.concat_ws(",", "doc_id", "source", F.lit("more"))).when(
        F.col("doc_id") % 10 == 4, F.concat_ws(",", F.lit("none"), "source")).otherwise(F.concat_ws(",", "doc_id", "source"))
    docs = table(spark, sf, "documents")
    # As many files as the rows ask for, each with the header as its first line.
    files = max(4, -(-docs.count() // 50_000))
    lines = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("file"), F.lit(1).alias("turn"), line.alias("value"))
    headers = spark.range(files).select(F.col("id").alias("file"), F.lit(0).alias("turn"), F.lit("id,domain").alias("value"))
    placed = headers.unionByName(lines).repartition("file").sortWithinPartitions("file", "turn").select("file", "value")
    placed.write.partitionBy("file").text(path)
    rows = readers.read_csv(spark, f"{path}/file=*", multi_line=False, bad_rows="raw")
    return rows.filter("not (id is null and raw is not null)").select("id", F.when(F.col("raw").isNull(), "good").otherwise("bad").alias("row"))


@query(f"SELECT doc_id, {sql.clean('text')} AS cleaned FROM documents ORDER BY doc_id LIMIT 20")
def preview_rows(spark, sf):
    first = preview(table(spark, sf, "documents").select("doc_id", "text"), 20, "doc_id")
    return run_files(spark, lambda _: first, [(text.clean_text, "text", "cleaned")]).select("doc_id", "cleaned")


@query(f"SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words FROM (SELECT doc_id, {sql.words_of('text')} AS w FROM documents)")
def word_list_round_trip(spark, sf):
    rows = texts(spark, sf).select("doc_id", text.tokens(text.clean_text(F.col("text"))).alias("w"))
    written = F.when(F.size("w") == 0, F.lit("[]")).otherwise(F.concat(F.lit("['"), F.array_join("w", "', '"), F.lit("']")))
    back = rows.select("doc_id", written.alias("line")).select("doc_id", codecs.parse_word_list(F.col("line")).alias("w"))
    return back.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words"))


@query("""SELECT vec_id, array_to_string(v, ' ') AS line, list_sum(v)::BIGINT AS total FROM
(SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 100) AS INTEGER)) AS v FROM embeddings)""")
def vector_text_round_trip(spark, sf):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int"))
    rows = table(spark, sf, "embeddings").select("vec_id", vectors.vector_text(whole).alias("line"))
    total = F.aggregate(vectors.text_vector(F.col("line")), F.lit(0), lambda a, x: a + x)
    return rows.select("vec_id", "line", total.cast("long").alias("total"))


@query("""SELECT 'rows_cols' AS file, 'Number of rows' AS name, count(*) AS n FROM documents
UNION ALL SELECT 'rows_cols', 'Number of cols', 3 UNION ALL SELECT 'types', lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'domain', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'content_length', length(text)::VARCHAR, count(*) FROM documents GROUP BY length(text)""")
def statistics_files(spark, sf):
    path = _folder(spark)
    docs = table(spark, sf, "documents").select(F.col("lang").alias("type"), F.col("source").alias("domain"), F.col("text").alias("content"))
    writers.write_statistics(docs, path)

    def read(name: str):
        return spark.read.schema("name string, n long").option("header", True).csv(f"{path}/{name}").select(F.lit(name).alias("file"), "name", "n")

    lengths = read("content_length").groupBy("file", "name").agg(F.count("*").alias("n"))
    return read("rows_cols").unionByName(read("types")).unionByName(read("domain")).unionByName(lengths)


@query(f"""WITH {sql.LABELLED}, {sql.SETS} SELECT set, fake::INTEGER AS label, count(*) AS n FROM sets JOIN labelled USING (doc_id) GROUP BY set, fake""")
def vector_store(spark, sf):
    rows = labelled_words(spark, sf).join(documents_in_sets(spark, sf).select("doc_id", "set"), "doc_id").select(
        "doc_id", "set", F.col("fake").cast("int").alias("label"), "words")
    rows = materialise(rows)
    model = features.count_vectoriser(rows.filter(F.col("set") == 0), "words")
    path = _folder(spark)
    writers.write_vectors(model.vectors(rows, "doc_id", "words", ["set", "label"]), path, "counts")
    return writers.read_vectors(spark, path, "counts").groupBy("set", "label").agg(F.count("features").alias("n"))


@query("""SELECT 'w' || vec_id AS word, len(embedding) AS size, round(embedding[1]::DOUBLE, 5) AS first,
round(embedding[64]::DOUBLE, 5) AS last FROM embeddings""")
def word_vector_lines(spark, sf):
    path = _folder(spark)
    lines = table(spark, sf, "embeddings").select(
        F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), vectors.vector_text(F.col("embedding"))).alias("value"))
    lines.write.text(path)
    rows = readers.read_word_vectors(spark, path)
    return rows.select("word", F.size("vec").cast("long").alias("size"), F.round(F.col("vec")[0].cast("double"), 5).alias("first"),
                       F.round(F.col("vec")[63].cast("double"), 5).alias("last"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def utf8_decoding(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return raw.select("doc_id", F.md5(codecs.decode_utf8(F.col("raw"))).alias("text_md5"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS line
FROM events""")
def json_values(spark, sf):
    rows = table(spark, sf, "events").select("event_id", codecs.from_json_text(F.col("props"), "k long").alias("value"),
                                             codecs.from_json_text(F.col("props")).alias("variant"))
    return rows.select("event_id", F.try_variant_get("variant", "$.k", "long").alias("k"),
                       codecs.to_json_text(F.col("value")).alias("line"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({sql.words_of('text')}) AS word FROM documents) GROUP BY word")
def incremental_word_counts(spark, sf):
    schema = table(spark, sf, "documents").schema
    arriving = _folder(spark)
    docs = table(spark, sf, "documents")
    # The table arrives in two loads; the second run must only see the new files.
    counts, checkpoint = _folder(spark), _folder(spark)
    for part in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1):
        docs.filter(part).repartition(8).write.mode("append").parquet(arriving)
        stream = incremental.read_new_files(spark, arriving, schema, files_per_batch=8)
        words = stream.select(text.tokens(text.clean_text(F.col("text"))).alias("words"))
        incremental.add_word_counts(words, "words", counts, checkpoint)
    return incremental.running_word_counts(spark, counts)


@query(f"SELECT page_id, {sql.clean('html')} AS cleaned FROM pages")
def incremental_cleaning(spark, sf):
    schema = table(spark, sf, "pages").schema
    arriving, out, checkpoint = _folder(spark), _folder(spark), _folder(spark)
    table(spark, sf, "pages").repartition(4).write.parquet(arriving)
    stream = incremental.read_new_files(spark, arriving, schema)
    incremental.run_steps(stream, lambda df: df.select("page_id", text.clean_text(F.col("html")).alias("cleaned")), out, checkpoint)
    return spark.read.parquet(out)


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY
md5(concat_ws(':', '3', doc_id::VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 60""")
def incremental_sample(spark, sf):
    """The sample per class of files that arrive in three loads, some rows twice, equals that of the whole table."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    arriving, parts, checkpoint = _folder(spark), _folder(spark), _folder(spark)
    for load in (F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 == 1, F.col("doc_id") % 3 > 0):
        docs.filter(load).repartition(4).write.mode("append").parquet(arriving)
        stream = incremental.read_new_files(spark, arriving, docs.schema, files_per_batch=2)
        incremental.add_samples(stream, "lang", ["doc_id"], 60, parts, checkpoint, seed=3)
    return incremental.running_sample(spark, parts, "lang", ["doc_id"], 60)


_IN_FOUR = "n AS (SELECT count(*) AS n FROM documents), q AS (SELECT floor(0.3::DOUBLE * n / 4)::BIGINT AS q, floor(0.2::DOUBLE * n)::BIGINT AS u FROM n)"


@query(f"""WITH {_IN_FOUR}, p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id % 3, doc_id) AS pos FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) AS rn FROM p), s0 AS (SELECT doc_id FROM c, q WHERE rn <= q),
e0 AS (SELECT max(pos) AS last FROM c, q WHERE rn = q HAVING count(*) = 4), b1 AS (SELECT min(pos) AS first FROM p, e0 WHERE pos > last)
SELECT doc_id, 0 AS set FROM s0 UNION ALL SELECT doc_id, CASE WHEN pos < first + u THEN 1 ELSE 2 END FROM p, b1, q WHERE pos >= first AND pos < first + 2 * u""")
def incremental_quota_split(spark, sf):
    """Sets of documents that arrive in three loads, the later ones with rows that have come before, as of the whole table."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    size = docs.count()
    arriving, found, checkpoint = _folder(spark), _folder(spark), _folder(spark)
    for load in range(3):
        docs.filter((F.col("doc_id") % 3 == load) | ((F.col("doc_id") % 3 < load) & (F.col("doc_id") % 5 == 0))).write.mode("append").parquet(arriving)
        stream = incremental.read_new_files(spark, arriving, docs.schema)
        incremental.add_quota_split(stream, size, [0.3, 0.2, 0.2], [True, False, False], "doc_id", found, checkpoint, "lang", ["en", "de", "fr", "es"])
    return incremental.running_split(spark, found).select("doc_id", "set")
