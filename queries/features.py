"""Feature queries in the relational form, and row counts of the vector form."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsframe.functions import text, vectors
from newsframe.operators import features
from newsframe.operators.frequency import top
from newsframe.operators.vocabulary import frequency_band, set_sizes, set_vocabulary, vocabulary
from newsframe.session import materialise
from queries import sql
from queries.registry import documents_in_sets, query, table, texts

_WORDS = f"wd AS (SELECT doc_id, set, {sql.words_of('text')} AS words FROM sets)"
_VEC = f"vd AS (SELECT doc_id, set, regexp_extract_all(lower(text), '[{text.WORD}]{{2,}}') AS words FROM sets)"


# The words are read by several jobs of one query (vocabulary, weights, features): they are cut and stored once.

def _cleaned(spark, sf):
    return materialise(documents_in_sets(spark, sf).select(
        "doc_id", "set", text.tokens(text.clean_text(F.col("text"))).alias("words")))


def _vectorised(spark, sf):
    return materialise(documents_in_sets(spark, sf).select(
        "doc_id", "set", text.vectoriser_tokens(F.col("text")).alias("words")))


@query(f"""WITH {sql.SETS}, {_WORDS}, occ AS (SELECT doc_id, unnest(words) AS word FROM wd),
cnt AS (SELECT word, count(*) AS n FROM occ GROUP BY word),
band AS (SELECT word FROM cnt WHERE n::DOUBLE / (SELECT sum(n) FROM cnt) BETWEEN 0.00002 AND 0.01)
SELECT doc_id, word, count(*) AS n FROM occ JOIN band USING (word) GROUP BY doc_id, word""")
def count_vectors_over_vocabulary(spark, sf):
    rows = _cleaned(spark, sf)
    band = frequency_band(vocabulary(rows, "words"), 0.00002, 0.01)
    return features.count_rows(rows, "doc_id", "words", vocabulary_words=band)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 100) AS INTEGER)) AS v FROM embeddings)
SELECT vec_id, array_to_string(v, ' ') AS counts, list_transform(v, lambda x: round(CASE WHEN list_sum(v) = 0 THEN x * 1000000.0 ELSE x * 1000000.0 / list_sum(v) END)::BIGINT::VARCHAR).array_to_string(' ') AS millionths FROM v""")
def normalised_vectors(spark, sf):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int"))
    rows = table(spark, sf, "embeddings").select("vec_id", whole.alias("v"))
    rows = rows.withColumn("share", vectors.normalise(F.col("v")))
    millionths = F.transform("share", lambda x: F.round(x * 1000000).cast("long").cast("string"))
    return rows.select("vec_id", vectors.vector_text(F.col("v")).alias("counts"), F.array_join(millionths, " ").alias("millionths"))


_TFIDF = f"""WITH {sql.SETS}, {_WORDS}, occ AS (SELECT doc_id, set, unnest(words) AS word FROM wd),
nt AS (SELECT set, word, count(*) AS n_t FROM occ GROUP BY set, word), nd AS (SELECT set, count(*) AS n FROM wd GROUP BY set),
tf AS (SELECT doc_id, set, word, count(*) AS n FROM occ GROUP BY doc_id, set, word)"""


def _corpus_tfidf(spark, sf, exact: bool):
    rows = _cleaned(spark, sf)
    return features.corpus_tfidf(features.count_rows(rows, "doc_id", "words", ["set"]), set_vocabulary(rows, "words"),
                                 set_sizes(rows), "doc_id", exact)


@query(f"""{_TFIDF} SELECT doc_id, set, word, CAST(trunc((ln(tf.n) + 1) * trunc(ln(nd.n / n_t))) AS INTEGER) AS tfidf
FROM tf JOIN nt USING (set, word) JOIN nd USING (set)""")
def corpus_tfidf(spark, sf):
    return _corpus_tfidf(spark, sf, False)


@query(f"""{_TFIDF} SELECT doc_id, set, word, round((ln(tf.n) + 1) * ln(nd.n / n_t), 6) AS tfidf
FROM tf JOIN nt USING (set, word) JOIN nd USING (set)""")
def corpus_tfidf_exact(spark, sf):
    return _corpus_tfidf(spark, sf, True).withColumn("tfidf", F.round("tfidf", 6))


@query(f"""WITH {sql.SETS}, {_VEC}, occ AS (SELECT doc_id, set, unnest(words) AS word FROM vd),
voc AS (SELECT DISTINCT word FROM occ WHERE set = 0)
SELECT doc_id, set, word, count(*) AS n FROM occ JOIN voc USING (word) GROUP BY doc_id, set, word""")
def bag_of_words(spark, sf):
    rows = _vectorised(spark, sf)
    known = vocabulary(rows.filter(F.col("set") == 0), "words")
    return features.count_rows(rows, "doc_id", "words", ["set"], known)


def _cells(vectors_):
    """(doc_id, index, value): the cells of the vector column itself."""
    inner = vectors_.select("doc_id", F.unwrap_udt("features").alias("v"))
    return (inner.select("doc_id", F.explode(F.arrays_zip("v.indices", "v.values")).alias("cell"))
            .select("doc_id", F.col("cell.indices").cast("long").alias("index"), F.round("cell.values", 6).alias("value")))


_PLACES = "voc AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS index FROM (SELECT DISTINCT word FROM occ WHERE set = 0))"


@query(f"""WITH {sql.SETS}, {_VEC}, occ AS (SELECT doc_id, set, unnest(words) AS word FROM vd), {_PLACES}
SELECT doc_id, index, count(*)::DOUBLE AS value FROM occ JOIN voc USING (word) GROUP BY doc_id, index""")
def bag_of_words_vectors(spark, sf):
    rows = _vectorised(spark, sf)
    return _cells(features.count_vectoriser(rows.filter(F.col("set") == 0), "words").vectors(rows, "doc_id", "words"))


def _vectoriser_sql(words: str) -> str:
    return f"""WITH {sql.SETS}, {_VEC}, terms AS (SELECT doc_id, set, {words} AS words FROM vd),
occ AS (SELECT doc_id, set, unnest(words) AS word FROM terms),
tf AS (SELECT doc_id, set, word, count(*) AS n FROM occ GROUP BY doc_id, set, word),
idf AS (SELECT word, ln((1.0 + (SELECT count(*) FROM sets WHERE set = 0)) / (1 + count(*))) + 1 AS idf FROM tf WHERE set = 0 GROUP BY word),
w AS (SELECT doc_id, word, n * idf AS w FROM tf JOIN idf USING (word)),
tfidf AS (SELECT doc_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""


def _vectoriser(spark, sf, low: int, high: int, word: str | None = "word"):
    rows = _vectorised(spark, sf)
    blocks = features.in_blocks(rows, "doc_id", "words", ["set"], (low, high))
    size = rows.filter(F.col("set") == 0).count()
    return features.vectoriser_tfidf(blocks, features.smooth_idf(blocks, "set = 0", size), word)


@query(f"{_vectoriser_sql('words')} SELECT doc_id, word, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf_unigrams(spark, sf):
    return _vectoriser(spark, sf, 1, 1).withColumn("tfidf", F.round("tfidf", 6))


def _runs(n: int) -> str:
    return f"list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(list_slice(words, i, i + {n - 1}), ' '))"


_PER_DOC = "SELECT doc_id, count(*) AS terms, round(sum(tfidf), 5) AS total, round(max(tfidf), 6) AS largest FROM tfidf GROUP BY doc_id"


def _per_document(df):
    return df.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("tfidf"), 5).alias("total"),
                                    F.round(F.max("tfidf"), 6).alias("largest"))


@query(f"{_vectoriser_sql(f'list_concat(words, {_runs(2)})')} {_PER_DOC}")
def tfidf_bigrams(spark, sf):
    return _per_document(_vectoriser(spark, sf, 1, 2, None))


@query(f"{_vectoriser_sql(f'list_concat(list_concat(words, {_runs(2)}), {_runs(3)})')} {_PER_DOC}")
def tfidf_trigrams(spark, sf):
    return _per_document(_vectoriser(spark, sf, 1, 3, None))


@query(f"""{_vectoriser_sql('words')}, {_PLACES} SELECT doc_id, index, round(tfidf, 6) AS value FROM tfidf JOIN voc USING (word)""")
def tfidf_vectors(spark, sf):
    rows = _vectorised(spark, sf)
    return _cells(features.tfidf_vectoriser(rows.filter(F.col("set") == 0), "words").vectors(rows, "doc_id", "words"))


_FILTERED = f"translate(lower(text), {sql.quoted(text.SEQUENCE_FILTERS)}, repeat(' ', {len(text.SEQUENCE_FILTERS)}))"
_SEQ = f"""WITH {sql.SETS}, sd AS (SELECT doc_id, set, list_filter(string_split({_FILTERED}, ' '), lambda w: w <> '') AS words FROM sets),
occ AS (SELECT doc_id, set, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM sd),
ranked AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM occ WHERE set = 0 GROUP BY word)"""


def _sequence_words(spark, sf):
    return materialise(documents_in_sets(spark, sf).select(
        "doc_id", "set", text.sequence_tokens(F.col("text")).alias("words")))


@query(f"""{_SEQ}, num AS (SELECT doc_id, pos, CASE WHEN rank + 1 < 10000 THEN rank + 1 ELSE 1 END AS i FROM occ LEFT JOIN ranked USING (word) WHERE pos <= 60),
seq AS (SELECT doc_id, list(i ORDER BY pos) AS s FROM num GROUP BY doc_id)
SELECT doc_id, array_to_string(list_concat(list_transform(range(60 - len(coalesce(s, []))), lambda x: 0), coalesce(s, [])), ' ') AS sequence
FROM sets LEFT JOIN seq USING (doc_id)""")
def padded_sequences(spark, sf):
    rows = _sequence_words(spark, sf)
    index = features.sequence_index(rows.filter(F.col("set") == 0), "words")
    out = features.padded_sequences(rows, "doc_id", "words", index, 60)
    return out.select("doc_id", vectors.vector_text(F.col("sequence")).alias("sequence"))


@query(f"""{_SEQ}, num AS (SELECT doc_id, pos, rank AS i, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS back
FROM occ JOIN ranked USING (word) WHERE rank < 10000),
seq AS (SELECT doc_id, list(i ORDER BY pos) AS s FROM num WHERE back <= 100 GROUP BY doc_id)
SELECT doc_id, array_to_string(list_concat(list_transform(range(100 - len(coalesce(s, []))), lambda x: 0), coalesce(s, [])), ' ') AS sequence
FROM sets LEFT JOIN seq USING (doc_id)""")
def padded_sequences_known_words(spark, sf):
    rows = _sequence_words(spark, sf)
    index = features.sequence_index(rows.filter(F.col("set") == 0), "words", oov=False)
    out = features.padded_sequences(rows, "doc_id", "words", index, 100, oov=False, keep_first=False)
    return out.select("doc_id", vectors.vector_text(F.col("sequence")).alias("sequence"))


def _word_vectors(spark, sf, rows):
    """Pretrained vectors for the most frequent words: word number i gets embedding number i."""
    words = top(vocabulary(rows, "words"), table(spark, sf, "embeddings").count(), "word", rank="rank")
    return words.join(table(spark, sf, "embeddings"), F.col("rank") == F.col("vec_id") + 1).select(
        "word", F.col("embedding").alias("vec"))


@query(f"""{_SEQ}, allr AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS ar FROM occ GROUP BY word),
vec AS (SELECT word, embedding FROM allr JOIN embeddings ON ar = vec_id + 1)
SELECT word, rank AS index, array_to_string(list_transform(coalesce(embedding, list_transform(range(64), lambda x: 0::FLOAT)), lambda x: round(x::DOUBLE * 1000000)::BIGINT), ' ') AS vec
FROM ranked LEFT JOIN vec USING (word)""")
def embedding_matrix(spark, sf):
    # All words of the training set, not only those below a number.
    rows = _sequence_words(spark, sf)
    index = features.sequence_index(rows.filter(F.col("set") == 0), "words", None, oov=False)
    matrix = features.embedding_rows(index, _word_vectors(spark, sf, rows), 64)
    millionths = F.transform("vec", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return matrix.select("word", F.col("index").cast("long").alias("index"), F.array_join(millionths, " ").alias("vec"))


@query("""SELECT doc_id, text || ' ' || CASE CAST(substr(source, 4) AS INTEGER) % 6 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' WHEN 2 THEN 'green'
WHEN 3 THEN 'violet' WHEN 4 THEN 'yellow' ELSE 'orange' END || 'Cluster' AS content FROM documents""")
def cluster_name_feature(spark, sf):
    cluster = F.substring("source", 4, 10).cast("int") % 6
    return table(spark, sf, "documents").select("doc_id", features.with_cluster_name(F.col("text"), cluster).alias("content"))


@query(f"""WITH occ AS (SELECT lang, unnest({sql.words_of('text')}) AS word FROM documents),
r AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rank FROM occ GROUP BY lang, word),
line AS (SELECT lang, string_agg(word, ' ' ORDER BY rank) AS terms FROM r WHERE rank <= 10 GROUP BY lang)
SELECT doc_id, text || ' ' || terms AS content_with_top_terms FROM documents JOIN line USING (lang)""")
def cluster_terms_feature(spark, sf):
    # Languages stand for clusters, their most frequent words for the heaviest terms.
    words = texts(spark, sf).select("lang", text.tokens(text.clean_text(F.col("text"))).alias("words"))
    counts = words.select("lang", F.explode_outer("words").alias("term")).filter(F.col("term").isNotNull()).groupBy(
        "lang", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))
    terms = counts.withColumn("rank", rank).filter(F.col("rank") <= 10).select(F.col("lang").alias("cluster"), "rank", "term")
    return features.with_cluster_terms(table(spark, sf, "documents"), "text", "lang", terms).select("doc_id", "content_with_top_terms")
