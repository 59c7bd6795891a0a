"""Text operators on documents, pages and conversations."""

from pyspark.sql import functions as F

from newsframe.functions import stem, text
from newsframe.operators.frequency import occurrences, word_counts
from newsframe.operators.sentiment import scoped_sentiment as scoped
from newsframe.operators.sentiment import sentiment
from newsframe.operators.vocabulary import stem_counts, vocabulary
from newsframe.session import materialise, spread
from queries import sql
from queries.registry import flags, query, rounded, table, texts


@query(f"SELECT doc_id, {sql.clean('text')} AS cleaned FROM documents")
def clean_documents(spark, sf):
    return texts(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT page_id, {sql.clean('html')} AS cleaned FROM pages")
def clean_pages(spark, sf):
    return texts(spark, sf, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query(f"SELECT doc_id, {sql.clean('text', '.,')} AS cleaned FROM documents")
def clean_keeping_punctuation(spark, sf):
    return texts(spark, sf).select("doc_id", text.clean_text(F.col("text"), False).alias("cleaned"))


@query(f"""SELECT doc_id, len(w) AS n_words, array_to_string(w, '|') AS words
FROM (SELECT doc_id, {sql.words_of('text')} AS w FROM documents)""")
def tokenize_documents(spark, sf):
    return (texts(spark, sf).select("doc_id", text.tokens(text.clean_text(F.col("text"))).alias("w"))
            .select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", "|").alias("words")))


@query(f"""SELECT doc_id, len(w) AS n_words, array_to_string(w, '|') AS words
FROM (SELECT doc_id, {sql.without_stop_words(sql.words_of('text'))} AS w FROM documents)""")
def stop_word_removal(spark, sf):
    words = text.remove_stop_words(text.tokens(text.clean_text(F.col("text"))))
    return (texts(spark, sf).select("doc_id", words.alias("w"))
            .select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", "|").alias("words")))


_STEMMED_DOCS = f"""WITH tok AS (SELECT doc_id, {sql.without_stop_words(sql.words_of('text'))} AS ws FROM documents),
occ AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM tok), {sql.stem_ctes('occ')},
joined AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS stems FROM occ JOIN stems USING (word) GROUP BY doc_id)"""


@query(f"""{_STEMMED_DOCS} SELECT tok.doc_id, coalesce(stems, ' ') AS stems FROM tok LEFT JOIN joined USING (doc_id)""")
def stemmed_documents(spark, sf):
    words = text.remove_stop_words(text.tokens(text.clean_text(F.col("text"))))
    return texts(spark, sf).select("doc_id", text.joined(stem.stem_words(words)).alias("stems"))


@query(f"""WITH occ AS (SELECT unnest({sql.words_of('text')}) AS word FROM documents), {sql.stem_ctes('occ')}
SELECT stem, count(*) AS n FROM occ JOIN stems USING (word) GROUP BY stem""")
def stemmed_vocabulary(spark, sf):
    docs = texts(spark, sf).select(text.tokens(text.clean_text(F.col("text"))).alias("words"))
    return stem_counts(vocabulary(docs, "words"))


_AUTHORS = sql.replace_all(f"lower(trim(x, {sql.quoted(text.SPACE_CHARS)}))", f"[^A-Za-z0-9{text.SPACE}]", "")


@query(f"""SELECT page_id, array_to_string(list_transform(string_split(raw, ','), lambda x: {_AUTHORS}), '') AS authors
FROM (SELECT page_id, concat(split_part(url, '/', 3), ', ', split_part(url, '/', 4), ' O''Neil ,', url) AS raw FROM pages)
UNION ALL SELECT conv_id * 1000 + turn, coalesce(array_to_string(list_transform(
string_split(nullif(role, 'user'), ','), lambda x: {_AUTHORS}), ''), '') FROM conversations""")
def author_cleaning(spark, sf):
    # Author lists are made from the parts of page addresses; user turns stand for missing authors.
    part = F.split("url", "/")
    pages = table(spark, sf, "pages").select("page_id", F.concat(part[2], F.lit(", "), F.coalesce(F.get(part, F.lit(3)), F.lit("")),
                                                                F.lit(" O'Neil ,"), F.col("url")).alias("raw"))
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), F.nullif("role", F.lit("user")).alias("raw"))
    return pages.unionByName(turns).select("page_id", text.clean_authors(F.col("raw")).alias("authors"))


@query(f"""SELECT page_id, {sql.replace_all("lower(split_part(split_part(url, '/', 3), '.', 1))", f"[^A-Za-z0-9{text.SPACE}]", "")}
AS domain FROM pages""")
def domain_cleaning(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_domain(F.split("url", "/")[2]).alias("domain"))


_LEXICON = """lexicon AS (SELECT word, (sum(CASE WHEN fake THEN 0 ELSE 1 END) - sum(CASE WHEN fake THEN 1 ELSE 0 END)) / count(*) AS polarity,
2.0 * least(sum(CASE WHEN fake THEN 0 ELSE 1 END), sum(CASE WHEN fake THEN 1 ELSE 0 END)) / count(*) AS subjectivity
FROM (SELECT fake, unnest(words) AS word FROM lw) GROUP BY word HAVING count(*) >= 5)"""


@query(f"""WITH {sql.LABELLED_WORDS}, {_LEXICON},
tok AS (SELECT doc_id, unnest({sql.words_of('text')}) AS word FROM documents),
s AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS s FROM tok JOIN lexicon USING (word) GROUP BY doc_id)
SELECT doc_id, round(coalesce(p, 0), 6) AS polarity, round(coalesce(s, 0), 6) AS subjectivity
FROM documents LEFT JOIN s USING (doc_id)""")
def lexicon_sentiment(spark, sf):
    docs = materialise(texts(spark, sf).select("doc_id", text.tokens(text.clean_text(F.col("text"))).alias("words")))
    scores = sentiment(docs, "doc_id", "words", _learned_lexicon(spark, sf, docs))
    return scores.select("doc_id", rounded("polarity").alias("polarity"), rounded("subjectivity").alias("subjectivity"))


def _learned_lexicon(spark, sf, docs):
    """Words of the labelled documents: those of reliable ones are positive, mixed words subjective."""
    seen = occurrences(docs.join(flags(spark, sf), "doc_id"), "words", "fake").groupBy("word").agg(
        F.count_if("fake").alias("bad"), F.count_if(~F.col("fake")).alias("good"))
    total = F.col("good") + F.col("bad")
    return seen.filter(total >= 5).select(
        "word", ((F.col("good") - F.col("bad")) / total).alias("polarity"),
        (2.0 * F.least("good", "bad") / total).alias("subjectivity"))


_TURNS, _FACTORS = ["the", "la", "die", "que"], {"of": 1.3, "and": 0.6, "de": 1.5, "der": 0.5, "to": 1.2}


@query(f"""WITH {sql.LABELLED_WORDS}, {_LEXICON}, long AS (SELECT * FROM lexicon WHERE length(word) > 4),
factors(word, f) AS (VALUES {', '.join(f"('{word}', {value}::DOUBLE)" for word, value in _FACTORS.items())}),
w AS (SELECT doc_id, {sql.words_of('text')} AS words FROM documents),
tok AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w),
m AS (SELECT tok.*, polarity, subjectivity, f, CASE WHEN word IN {sql.in_list(_TURNS)} THEN place END AS turn
FROM tok LEFT JOIN long USING (word) LEFT JOIN factors USING (word)),
runs AS (SELECT doc_id, place, f, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM m WHERE f IS NOT NULL),
strong AS (SELECT doc_id, max(place) + 1 AS place, product(f) AS f FROM runs GROUP BY doc_id, run),
seen AS (SELECT *, max(turn) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
hits AS (SELECT s.doc_id, coalesce(s.place - before <= 3, false) AS turned, coalesce(g.f, 1) AS strength,
greatest(-1, least(1, polarity * coalesce(g.f, 1) * CASE WHEN coalesce(s.place - before <= 3, false) THEN -0.5 ELSE 1 END)) AS p,
greatest(0, least(1, subjectivity * coalesce(g.f, 1))) AS s
FROM seen s LEFT JOIN strong g ON s.doc_id = g.doc_id AND s.place = g.place WHERE polarity IS NOT NULL)
SELECT doc_id, round(coalesce(avg(p), 0), 6) AS polarity, round(coalesce(avg(s), 0), 6) AS subjectivity,
count(*) FILTER (turned)::INT AS negated, count(*) FILTER (strength <> 1)::INT AS intensified
FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id""")
def scoped_sentiment(spark, sf):
    # Some frequent short words of the four languages stand for negations and intensifiers; the lexicon has long words only.
    docs = materialise(texts(spark, sf).select("doc_id", text.tokens(text.clean_text(F.col("text"))).alias("words")))
    lexicon = _learned_lexicon(spark, sf, docs).filter(F.length("word") > 4)
    scores = scoped(docs, "doc_id", "words", lexicon, _TURNS, _FACTORS)
    return scores.withColumn("polarity", rounded("polarity")).withColumn("subjectivity", rounded("subjectivity"))


@query(f"SELECT doc_id, len({sql.tokens('text')}) AS n_words, length(text) AS n_chars FROM documents")
def text_lengths(spark, sf):
    return texts(spark, sf).select(
        "doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_chars"))


# Marks become words of their own before sentences are measured.
_MARKED = sql.tokens(sql.replace_all("text", "([.!?])", r" \1 "))


@query(f"""SELECT doc_id, round(CASE WHEN marks = 0 THEN 0 ELSE last / marks END, 6) AS mean_length FROM (
SELECT doc_id, len(list_filter(w, lambda x: x IN ('.', '!', '?'))) AS marks,
list_max(list_transform(w, lambda x, i: CASE WHEN x IN ('.', '!', '?') THEN i END)) AS last
FROM (SELECT doc_id, {_MARKED} AS w FROM documents))""")
def sentence_lengths(spark, sf):
    words = text.tokens(F.regexp_replace("text", "([.!?])", " $1 "))
    return texts(spark, sf).select("doc_id", words.alias("words")).select(
        "doc_id", rounded(text.mean_sentence_length(F.col("words"))).alias("mean_length"))


def _words(spark, sf):
    return texts(spark, sf).select("doc_id", text.tokens(text.clean_text(F.col("text"))).alias("words"))


_ALL = f"(SELECT doc_id, {sql.words_of('text')} AS w FROM documents)"


@query(f"SELECT doc_id, {sql.count_in('w', ['!'])} AS exclamations, {sql.count_in('w', ['?'])} AS questions FROM {_ALL}")
def mark_counts(spark, sf):
    return _words(spark, sf).select("doc_id", text.count_of(F.col("words"), ["!"]).cast("long").alias("exclamations"),
                                    text.count_of(F.col("words"), ["?"]).cast("long").alias("questions"))


@query(f"""SELECT doc_id, {sql.count_in('w', text.FIRST_PRONOUNS)} AS "first", {sql.count_in('w', text.SECOND_PRONOUNS)} AS "second",
{sql.count_in('w', text.THIRD_PRONOUNS)} AS "third",
{sql.count_in('w', text.FIRST_PRONOUNS + text.SECOND_PRONOUNS + text.THIRD_PRONOUNS)} AS "all" FROM {_ALL}""")
def pronoun_counts(spark, sf):
    counts = text.pronoun_counts(F.col("words"))
    return _words(spark, sf).select("doc_id", *[column.cast("long").alias(name) for name, column in counts.items()])


@query(f"""SELECT doc_id, {sql.count_in('w', text.NEGATIONS)} + 2 * {sql.count_in('w', ['neither'])} AS negations,
{sql.count_in('w', text.NEGATIONS)} AS negations_deduped FROM {_ALL}""")
def negation_counts(spark, sf):
    return _words(spark, sf).select("doc_id", text.negation_count(F.col("words")).cast("long").alias("negations"),
                                    text.negation_count(F.col("words"), True).cast("long").alias("negations_deduped"))


def _runs(n: int) -> str:
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))"


@query(f"""SELECT term, count(*) AS n FROM (SELECT unnest(list_concat(list_concat(w, {_runs(2)}), {_runs(3)})) AS term FROM
(SELECT regexp_extract_all(lower(text), '[{text.WORD}]{{2,}}') AS w FROM conversations)) GROUP BY term""")
def ngram_counts(spark, sf):
    # Nearly every term of three words is a row of its own in the task that counts it.
    turns = spread(table(spark, sf, "conversations"), shuffled=True).select(text.vectoriser_tokens(F.col("text")).alias("words"))
    return (turns.select(text.ngrams(F.col("words"), 1, 3).alias("terms")).transform(word_counts, "terms")
            .filter(F.col("word").isNotNull()).withColumnRenamed("word", "term"))


@query(f"""SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[{text.WORD}]{{2,}}') AS w FROM documents)""")
def vectoriser_tokens(spark, sf):
    return (texts(spark, sf).select("doc_id", text.vectoriser_tokens(F.col("text")).alias("w"))
            .select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words")))
