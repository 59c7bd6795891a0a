"""Corpus statistics and vocabularies."""

from pyspark.sql import functions as F

from newsframe.functions import stem, text
from newsframe.operators import frequency, summary, vocabulary
from newsframe.operators.sentiment import sentiment
from newsframe.session import materialise
from queries import sql
from queries.registry import documents_in_sets, labelled, labelled_words, query, table, texts


def _clean(spark, sf, name: str = "documents", *columns: str):
    return texts(spark, sf, name).select(*columns, text.tokens(text.clean_text(F.col("text"))).alias("words"))


def _share(df, *names: str):
    return df.withColumns({name: F.round(name, 6) for name in names})


_DOC_WORDS = f"dw AS (SELECT doc_id, lang, source, {sql.words_of('text')} AS words FROM documents)"
_OCC = f"WITH {_DOC_WORDS}, occ AS (SELECT doc_id, lang, unnest(words) AS word FROM dw), cnt AS (SELECT word, count(*) AS n FROM occ GROUP BY word)"
_LOCC = f"WITH {sql.LABELLED_WORDS}, occ AS (SELECT doc_id, fake, unnest(words) AS word FROM lw), cnt AS (SELECT fake, word, count(*) AS n FROM occ GROUP BY fake, word)"


@query("""SELECT 'Number of rows' AS statistic, count(*) AS count FROM documents
UNION ALL SELECT 'Number of cols', count(*) FROM (DESCRIBE documents)""")
def table_shape(spark, sf):
    return frequency.table_shape(table(spark, sf, "documents"))


@query("""SELECT coalesce(nullif(lang, 'es'), 'none') AS types, count(*) AS count FROM documents GROUP BY types""")
def type_counts(spark, sf):
    docs = table(spark, sf, "documents").select(F.nullif("lang", F.lit("es")).alias("type"))
    return frequency.counts_with_none(docs, "type", "types")


@query("SELECT coalesce(nullif(source, 'src3'), 'none') AS domains, count(*) AS count FROM documents GROUP BY domains")
def domain_counts(spark, sf):
    docs = table(spark, sf, "documents").select(F.nullif("source", F.lit("src3")).alias("domain"))
    return frequency.counts_with_none(docs, "domain", "domains")


@query("SELECT length(text) AS content_length, count(*) AS n FROM documents GROUP BY content_length")
def content_lengths(spark, sf):
    return (table(spark, sf, "documents").select(F.length("text").cast("long").alias("content_length"))
            .groupBy("content_length").agg(F.count("*").alias("n")))


@query(f"""{_OCC}, none AS (SELECT count(*) AS n FROM dw WHERE len(words) = 0),
allw AS (SELECT word, n FROM cnt UNION ALL SELECT NULL, n FROM none WHERE n > 0)
SELECT word, n, round(100.0 * n / (SELECT sum(n) FROM allw), 6) AS percentage FROM allw""")
def word_frequency(spark, sf):
    return _share(frequency.with_share(frequency.word_counts(_clean(spark, sf), "words")), "percentage")


@query(f"""{_LOCC} SELECT fake, word, n, rank, percentage FROM (SELECT fake, word, n, row_number() OVER (PARTITION BY fake ORDER BY n DESC, word) AS rank,
round(100.0 * n / sum(n) OVER (PARTITION BY fake), 6) AS percentage FROM cnt) WHERE rank <= 25""")
def top_words_by_class(spark, sf):
    words = labelled(spark, sf).select("fake", text.tokens(text.clean_text(F.col("text"))).alias("words"))
    return _share(frequency.word_frequency_by_class(words, "words", "fake", 25), "percentage")


@query(f"""WITH {sql.LABELLED}, lw AS (SELECT fake, {sql.without_stop_words(sql.words_of('text'))} AS words FROM labelled),
raw AS (SELECT fake, unnest(words) AS word FROM lw), {sql.stem_ctes('raw')},
cnt AS (SELECT fake, stem AS word, count(*) AS n FROM raw JOIN stems USING (word) GROUP BY fake, stem)
SELECT * FROM (SELECT fake, word, n, row_number() OVER (PARTITION BY fake ORDER BY n DESC, word) AS rank FROM cnt) WHERE rank <= 25""")
def top_stems_by_class(spark, sf):
    # Words are counted before they are stemmed: the stemmer sees each distinct word of a class once.
    words = labelled(spark, sf).select("fake", text.remove_stop_words(text.tokens(text.clean_text(F.col("text")))).alias("words"))
    counts = frequency.occurrences(words, "words", "fake").groupBy("fake", "word").agg(F.count("*").alias("n"))
    stems = counts.groupBy("fake", stem.stem_word(F.col("word")).alias("word")).agg(F.sum("n").alias("n"))
    return frequency.top(stems, 25, "word", ["fake"], "rank")


def _describe(source: str, flag: str) -> str:
    return f"""cls AS (SELECT 'total' AS class, v FROM {source} UNION ALL
SELECT CASE WHEN {flag} THEN 'fake' ELSE 'reliable' END, v FROM {source})
SELECT class, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max,
round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3
FROM cls GROUP BY class"""


@query(f"""WITH {sql.LABELLED}, wc AS (SELECT fake, len({sql.tokens('text')})::DOUBLE AS v FROM labelled), {_describe('wc', 'fake')}""")
def word_count_summary(spark, sf):
    rows = labelled(spark, sf).select("fake", text.word_count(F.col("text")).alias("n_words"))
    return _share(summary.describe_by_class(rows, "n_words", "fake"), "mean", "std", "q1", "median", "q3")


def _box(source: str, by: str) -> str:
    """Box-plot numbers of ``source(measure, by..., v)``."""
    return f"""qs AS (SELECT measure, {by}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3
FROM {source} GROUP BY measure, {by}),
box AS (SELECT s.measure, s.{by}, q1, med, q3, count(*) AS count, min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS lo,
max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS hi,
sum(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END)::BIGINT AS outliers
FROM {source} s JOIN qs ON s.measure = qs.measure AND s.{by} = qs.{by} GROUP BY s.measure, s.{by}, q1, med, q3)
SELECT measure, {by}, count, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
round(least(coalesce(lo, q1), q1), 6) AS low, round(greatest(coalesce(hi, q3), q3), 6) AS high, outliers FROM box"""


def _rounded_box(df):
    return _share(df, "q1", "median", "q3", "low", "high")


_MARKED = sql.replace_all("text", "([.!?])", r" \1 ")
_PRONOUNS = {"first": text.FIRST_PRONOUNS, "second": text.SECOND_PRONOUNS, "third": text.THIRD_PRONOUNS,
             "all": text.FIRST_PRONOUNS + text.SECOND_PRONOUNS + text.THIRD_PRONOUNS}
_MEASURES = {
    "words": "len(raw)", "exclamations": sql.count_in("words", ["!"]), "questions": sql.count_in("words", ["?"]),
    "sentence_length": """CASE WHEN len(list_filter(marked, lambda x: x IN ('.', '!', '?'))) = 0 THEN 0 ELSE
list_max(list_transform(marked, lambda x, i: CASE WHEN x IN ('.', '!', '?') THEN i END))::DOUBLE
/ len(list_filter(marked, lambda x: x IN ('.', '!', '?'))) END""",
    **{f"pronouns_{name}": sql.count_in("words", listed) for name, listed in _PRONOUNS.items()},
    "negations": f"{sql.count_in('words', text.NEGATIONS)} + 2 * {sql.count_in('words', ['neither'])}",
}


@query(f"""WITH {sql.LABELLED}, m AS (SELECT fake, {sql.tokens('text')} AS raw, {sql.words_of('text')} AS words,
{sql.tokens(_MARKED)} AS marked FROM labelled),
v AS ({" UNION ALL ".join(f"SELECT '{name}' AS measure, fake, ({e})::DOUBLE AS v FROM m" for name, e in _MEASURES.items())}),
{_box('v', 'fake')}""")
def box_plots_by_class(spark, sf):
    rows = labelled(spark, sf).select(
        "fake", text.tokens(F.col("text")).alias("raw"), text.tokens(text.clean_text(F.col("text"))).alias("words"),
        text.tokens(F.regexp_replace("text", "([.!?])", " $1 ")).alias("marked"))
    words = F.col("words")
    measures = {"words": F.size("raw"), "exclamations": text.count_of(words, ["!"]),
                "questions": text.count_of(words, ["?"]), "sentence_length": text.mean_sentence_length(F.col("marked")),
                **{f"pronouns_{name}": column for name, column in text.pronoun_counts(words).items()},
                "negations": text.negation_count(words)}
    return _rounded_box(summary.box_stats(rows, measures, ["fake"]))


@query(f"""WITH {sql.LABELLED}, lx AS (SELECT word, avg(size) AS p FROM (SELECT 1000 / (1000 + n_chars::DOUBLE) AS size, unnest(
{sql.tokens('text')}) AS word FROM documents) GROUP BY word),
t AS (SELECT doc_id, fake, unnest({sql.tokens('text')}) AS word FROM labelled),
s AS (SELECT doc_id, avg(p) AS p, avg(1 - p) AS s FROM t JOIN lx USING (word) GROUP BY doc_id),
v AS (SELECT 'polarity' AS measure, fake, round(coalesce(p, 0), 9) AS v FROM labelled LEFT JOIN s USING (doc_id)
UNION ALL SELECT 'subjectivity', fake, round(coalesce(s, 0), 9) FROM labelled LEFT JOIN s USING (doc_id)), {_box('v', 'fake')}""")
def sentiment_box_plots(spark, sf):
    # A lexicon made from all documents: the score of a word is the mean shortness of the texts it stands in.
    sized = texts(spark, sf).select((F.lit(1000.0) / (F.lit(1000.0) + F.col("n_chars"))).alias("size"), text.tokens(F.col("text")).alias("words"))
    lexicon = frequency.occurrences(sized, "words", "size").groupBy("word").agg(F.avg("size").alias("polarity"))
    lexicon = lexicon.withColumn("subjectivity", 1 - F.col("polarity"))
    rows = labelled(spark, sf).select("doc_id", "fake", text.tokens(F.col("text")).alias("words"))
    scored = sentiment(rows, "doc_id", "words", lexicon).join(rows.select("doc_id", "fake"), "doc_id")
    return _rounded_box(summary.box_stats(scored, {"polarity": F.round("polarity", 9), "subjectivity": F.round("subjectivity", 9)}, ["fake"]))


@query("SELECT lang AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS percentage FROM documents GROUP BY lang")
def type_distribution(spark, sf):
    return _share(frequency.value_frequency(table(spark, sf, "documents"), "lang"), "percentage")


@query(f"WITH {sql.LABELLED} SELECT fake AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM labelled), 6) AS percentage FROM labelled GROUP BY fake")
def flag_distribution(spark, sf):
    return _share(frequency.value_frequency(labelled(spark, sf), "fake"), "percentage")


@query("""SELECT source AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS percentage
FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 7""")
def top_domains(spark, sf):
    return _share(frequency.value_frequency(table(spark, sf, "documents"), "source", n=7), "percentage")


_CELLS = """cells AS (SELECT source, lang, count(text) AS n FROM documents GROUP BY source, lang),
pct AS (SELECT source, lang, n, 100.0 * n / sum(n) OVER (PARTITION BY lang) AS percentage FROM cells)"""


@query(f"WITH {_CELLS} SELECT source, lang, n, round(percentage, 6) AS percentage FROM pct WHERE percentage >= 5")
def domain_contribution(spark, sf):
    return _share(frequency.contribution(table(spark, sf, "documents"), "source", "lang", "text", 5), "percentage")


@query(f"""WITH {_CELLS} SELECT source, round(max(CASE WHEN lang = 'de' THEN percentage END), 6) AS de,
round(max(CASE WHEN lang = 'en' THEN percentage END), 6) AS en, round(max(CASE WHEN lang = 'es' THEN percentage END), 6) AS es,
round(max(CASE WHEN lang = 'fr' THEN percentage END), 6) AS fr FROM pct WHERE percentage >= 5 GROUP BY source""")
def domain_contribution_table(spark, sf):
    kinds = ["de", "en", "es", "fr"]
    return _share(frequency.contribution_table(table(spark, sf, "documents"), "source", "lang", "text", kinds, 5), *kinds)


@query("""SELECT source, lang, count(text) AS n FROM documents GROUP BY source, lang HAVING count(text) >= 8""")
def domain_contribution_counts(spark, sf):
    return frequency.contribution(table(spark, sf, "documents"), "source", "lang", "text", 8, percentage=False)


@query(f"""{_LOCC}, best AS (SELECT fake, word FROM (SELECT fake, word, row_number() OVER (PARTITION BY fake ORDER BY n DESC, word) AS rank
FROM cnt) WHERE rank <= 40)
SELECT word, CASE WHEN count(*) = 2 THEN 'both' WHEN bool_and(fake) THEN 'fake' ELSE 'reliable' END AS region FROM best GROUP BY word""")
def shared_top_words(spark, sf):
    return frequency.shared_top_words(labelled_words(spark, sf), "words", "fake", 40)


_STATEMENTS = "st AS (SELECT conv_id, text, nullif(role, 'system') AS party, length(text) % 2 = 1 AS fake FROM conversations)"


_PARTY = "coalesce(party, 'none')"


def _by_class(source: str, value: str, top: int) -> str:
    return f"""cnt AS (SELECT fake, {value} AS value, count(*) AS n FROM {source} GROUP BY fake, value)
SELECT * FROM (SELECT fake, value, n, row_number() OVER (PARTITION BY fake ORDER BY n DESC, value NULLS LAST) AS rank,
round(100.0 * n / sum(n) OVER (PARTITION BY fake), 6) AS percentage FROM cnt) WHERE rank <= {top}"""


def _statements(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "text", F.nullif("role", F.lit("system")).alias("party"), (F.length("text") % 2 == 1).alias("fake"))


@query(f"WITH {_STATEMENTS}, {_by_class('st', _PARTY, 25)}")
def party_frequency(spark, sf):
    return _share(frequency.value_frequency_by_class(_statements(spark, sf), "party", "fake", 25, fill_none=True), "percentage")


@query(f"WITH {_STATEMENTS}, {_by_class('st', 'conv_id', 25)}")
def speaker_frequency(spark, sf):
    return _share(frequency.value_frequency_by_class(_statements(spark, sf).withColumn("speaker", F.col("conv_id")),
                                                     "speaker", "fake", 25), "percentage")


_SUBJECTS = "sub AS (SELECT lang || ',' || source AS subjects FROM documents)"


@query(f"""WITH {_SUBJECTS} SELECT subjects AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM sub), 6) AS percentage
FROM sub GROUP BY subjects""")
def subject_frequency(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat_ws(",", "lang", "source").alias("subjects"))
    return _share(frequency.value_frequency(docs, "subjects"), "percentage")


@query(f"""WITH {_SUBJECTS}, one AS (SELECT unnest(string_split(subjects, ',')) AS value FROM sub)
SELECT value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM one), 6) AS percentage FROM one GROUP BY value""")
def single_subject_frequency(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat_ws(",", "lang", "source").alias("subjects"))
    return _share(frequency.value_frequency(docs, "subjects", split=","), "percentage")


_BOTH = f"""both_c AS (SELECT 'articles' AS corpus, lang AS kind, text FROM documents UNION ALL SELECT 'statements', role, text FROM conversations)"""


def _corpora(spark, sf):
    articles = texts(spark, sf).select(F.lit("articles").alias("corpus"), F.col("lang").alias("kind"), "text")
    return articles.unionByName(texts(spark, sf, "conversations").select(
        F.lit("statements").alias("corpus"), F.col("role").alias("kind"), "text"))


@query(f"""WITH {_BOTH}, cnt AS (SELECT corpus, word, count(*) AS n FROM (SELECT corpus, unnest({sql.words_of('text')}) AS word FROM both_c) GROUP BY corpus, word)
SELECT * FROM (SELECT corpus, word, n, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, word) AS rank,
round(100.0 * n / sum(n) OVER (PARTITION BY corpus), 6) AS percentage FROM cnt) WHERE rank <= 25""")
def corpora_word_frequency(spark, sf):
    rows = _corpora(spark, sf).select("corpus", text.tokens(text.clean_text(F.col("text"))).alias("words"))
    return _share(frequency.word_frequency_by_class(rows, "words", "corpus", 25), "percentage")


@query(f"""WITH {_BOTH}, v AS (SELECT 'words' AS measure, corpus, len({sql.tokens('text')})::DOUBLE AS v FROM both_c), {_box('v', 'corpus')}""")
def corpora_word_counts(spark, sf):
    rows = _corpora(spark, sf).select("corpus", text.word_count(F.col("text")).alias("n_words"))
    return _rounded_box(summary.box_stats(rows, {"words": F.col("n_words")}, ["corpus"]))


@query(f"""WITH {_BOTH} SELECT corpus, kind AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY corpus), 6) AS percentage
FROM both_c GROUP BY corpus, kind""")
def corpora_type_distribution(spark, sf):
    counts = _corpora(spark, sf).groupBy("corpus", F.col("kind").alias("value")).agg(F.count("*").alias("n"))
    return _share(frequency.with_share(counts, ["corpus"]), "percentage")


@query(f"{_OCC} SELECT word, n FROM cnt")
def vocabulary_counts(spark, sf):
    return vocabulary.vocabulary(_clean(spark, sf), "words")


@query(f"""WITH {sql.SETS}, occ AS (SELECT set, unnest({sql.words_of('text')}) AS word FROM sets)
SELECT set, word, count(*) AS n_t FROM occ GROUP BY set, word""")
def set_vocabulary(spark, sf):
    rows = documents_in_sets(spark, sf).select("set", text.tokens(text.clean_text(F.col("text"))).alias("words"))
    return vocabulary.set_vocabulary(rows, "words")


@query(f"WITH {sql.SETS} SELECT set, count(*) AS n FROM sets GROUP BY set")
def set_sizes(spark, sf):
    return vocabulary.set_sizes(documents_in_sets(spark, sf))


@query(f"""{_OCC} SELECT word, n, round(n::DOUBLE / t, 9) AS frequency FROM cnt, (SELECT sum(n) AS t FROM cnt)
WHERE n::DOUBLE / t BETWEEN 0.00005 AND 0.005""")
def frequency_band(spark, sf):
    band = vocabulary.frequency_band(vocabulary.vocabulary(_clean(spark, sf), "words"), 0.00005, 0.005)
    return band.withColumn("frequency", F.round("frequency", 9))


@query(f"{_OCC} SELECT word, round(n::DOUBLE / (SELECT sum(n) FROM cnt), 9) AS frequency FROM cnt")
def word_frequencies(spark, sf):
    return vocabulary.frequencies(vocabulary.vocabulary(_clean(spark, sf), "words")).withColumn("frequency", F.round("frequency", 9))


@query(f"""{_OCC} SELECT word, n, round(n::DOUBLE / (SELECT sum(n) FROM cnt), 9) AS frequency,
row_number() OVER (ORDER BY n DESC, word) AS rank FROM cnt ORDER BY n DESC, word LIMIT 50""")
def most_frequent_words(spark, sf):
    best = vocabulary.most_frequent(vocabulary.vocabulary(_clean(spark, sf), "words"), 50, freq=True, rank=True)
    return best.withColumn("frequency", F.round("frequency", 9))


@query(f"""{_OCC}, kept AS (SELECT word FROM cnt WHERE word NOT IN {sql.in_list(text.STOP_WORDS)}), {sql.stem_ctes('kept')},
s AS (SELECT (SELECT count(*) FROM cnt) AS vocabulary, (SELECT count(*) FROM kept) AS no_stop_words,
(SELECT count(DISTINCT stem) FROM stems) AS stemmed)
SELECT *, round((vocabulary - no_stop_words)::DOUBLE / vocabulary * 100, 6) AS no_stop_words_reduction,
round((vocabulary - stemmed)::DOUBLE / vocabulary * 100, 6) AS stemmed_reduction FROM s""")
def vocabulary_reduction(spark, sf):
    counts = materialise(vocabulary.vocabulary(_clean(spark, sf), "words"))
    rates = vocabulary.count_reduction(counts, text.STOP_WORDS)
    return _share(rates, "no_stop_words_reduction", "stemmed_reduction")
