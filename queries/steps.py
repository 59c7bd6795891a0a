"""Step lists, row filters, label maps and metrics."""

from pyspark.sql import functions as F

from newsframe.functions import labels, text
from newsframe.operators import rows
from newsframe.plans import evaluate, presets
from newsframe.plans.steps import Steps, keep, run_files
from newsframe.session import shared_folder
from newsframe.sources import writers
from queries import sql
from queries.registry import documents_in_sets, labelled, query, table, texts

# Languages stand for article types, roles for statement labels.
_TYPE = "CASE lang WHEN 'en' THEN 'reliable' WHEN 'fr' THEN 'fake' WHEN 'de' THEN 'state' ELSE 'rumour' END"


def _type():
    return (F.when(F.col("lang") == "en", "reliable").when(F.col("lang") == "fr", "fake")
            .when(F.col("lang") == "de", "state").otherwise("rumour"))


def _articles(spark, sf):
    docs = texts(spark, sf)
    return docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".News.com")).alias("domain"), _type().alias("type"),
                       F.col("text").alias("content"), F.substring_index("text", ".", 1).alias("title"),
                       F.when(F.col("lang") != "es", F.concat_ws(", ", "lang", "source")).alias("authors"))


_STEMMED = sql.without_stop_words(sql.words_of("content"))
_ARTICLES = f"""a AS (SELECT doc_id AS id, source || '.News.com' AS domain, {_TYPE} AS type, text AS content, split_part(text, '.', 1) AS title,
CASE WHEN lang <> 'es' THEN lang || ', ' || source ELSE '' END AS authors FROM documents),
tok AS (SELECT id, 'content' AS part, {sql.without_stop_words(sql.words_of('content'))} AS ws FROM a
UNION ALL SELECT id, 'title', {sql.without_stop_words(sql.words_of('title'))} FROM a),
occ AS (SELECT id, part, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM tok), {sql.stem_ctes('occ')},
j AS (SELECT id, part, string_agg(stem, ' ' ORDER BY pos) AS s FROM occ JOIN stems USING (word) GROUP BY id, part),
p AS (SELECT a.id, type NOT IN ('reliable', 'clickbait', 'political') AS type_binary, split_part(lower(domain), '.', 1) AS domain,
replace(replace(authors, ',', ''), ' ', '') AS authors, coalesce(c.s, ' ') AS combined, coalesce(t.s, ' ') AS title
FROM a LEFT JOIN j c ON c.id = a.id AND c.part = 'content' LEFT JOIN j t ON t.id = a.id AND t.part = 'title')"""


def _joined(*names: str) -> str:
    line = " || ' ' || ".join(("combined", *names))
    return f"md5(coalesce(nullif(trim({line}, ' '), ''), ' '))"


@query(f"""WITH {_ARTICLES} SELECT id, type_binary, domain, authors, title, md5(combined) AS combined_md5,
{_joined('authors')} AS content_authors_md5, {_joined('title')} AS content_title_md5,
{_joined('domain')} AS content_domain_md5, {_joined('domain', 'authors', 'title')} AS all_md5 FROM p""")
def article_preset(spark, sf):
    done = presets.article_steps()(_articles(spark, sf))
    return done.select("id", "type_binary", "domain", "authors", "title", F.md5("content_no_swords_combined").alias("combined_md5"),
                       F.md5("content_authors").alias("content_authors_md5"), F.md5("content_title").alias("content_title_md5"),
                       F.md5("content_domain").alias("content_domain_md5"),
                       F.md5("content_no_swords_domain_authors_title").alias("all_md5"))


_LEX = {"the": (0.5, 0.25), "and": (-0.25, 0.5), "of": (0.125, 1.0), "est": (-1.0, 0.75)}


@query(f"""WITH st AS (SELECT conv_id || '.' || turn || '.json' AS raw, conv_id, turn, role, text FROM conversations),
tok AS (SELECT conv_id, turn, {sql.tokens(sql.clean('text'))} AS ws FROM st),
occ AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM tok), {sql.stem_ctes('occ')},
lex(stem, p, s) AS (VALUES {', '.join(f"('{w}', {p}::DOUBLE, {s}::DOUBLE)" for w, (p, s) in _LEX.items())}),
j AS (SELECT conv_id, turn, string_agg(stem, ' ' ORDER BY pos) AS joined, avg(p) AS p, avg(s) AS s
FROM occ JOIN stems USING (word) LEFT JOIN lex USING (stem) GROUP BY conv_id, turn)
SELECT split_part(raw, '.', 1) AS id, st.turn, role IN ('false') AS label_binary, md5(coalesce(joined, ' ')) AS combined_md5,
round(coalesce(p, 0), 6) AS polarity, round(coalesce(s, 0), 6) AS subjectivity FROM st LEFT JOIN j USING (conv_id, turn)""")
def statement_preset(spark, sf):
    rows_ = texts(spark, sf, "conversations").select(
        F.concat_ws(".", "conv_id", "turn", F.lit("json")).alias("id"), "turn", F.col("role").alias("label"),
        F.col("text").alias("statement"))
    done = presets.statement_steps(stop_words=[], lexicon=_LEX)(rows_)
    score = F.col("sentence_analysis")
    return done.select("id", "turn", "label_binary", F.md5("statement_combined").alias("combined_md5"),
                       F.round(score.polarity, 6).alias("polarity"), F.round(score.subjectivity, 6).alias("subjectivity"))


@query("""SELECT doc_id, upper(source) AS source, length(text) AS size, lang || '/' || upper(source) AS place, 'x' AS mark
FROM documents WHERE lang IN ('de', 'fr') AND length(text) > 500""")
def step_kinds(spark, sf):
    # One step of every kind: rewrite, filter, derive, derive from the row, map the table.
    steps = Steps([
        (F.upper, "source"), (keep(lambda lang: lang.isin("de", "fr")), "lang"),
        (lambda content: F.length(content).cast("long"), "text", "size"), (keep(lambda size: size > 500), "size"),
        (lambda col: F.concat_ws("/", col("lang"), col("source")), None, "place"),
        (lambda df: df.withColumn("mark", F.lit("x")), None)])
    return table(spark, sf, "documents").transform(steps).select("doc_id", "source", "size", "place", "mark")


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def run_from_file_to_file(spark, sf):
    import uuid
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    run_files(spark, lambda session: table(session, sf, "documents"), [(F.length, "text", "size")],
              lambda out: writers.write_parquet(out.select("lang", "size"), path))
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'es')")
def listed_values(spark, sf):
    return rows.keep_values(table(spark, sf, "documents"), "lang", ["fr", "es"]).select("doc_id", "lang")


@query(f"""SELECT doc_id AS id, source AS domain, {_TYPE} AS type FROM documents
WHERE NOT starts_with(text, 'L') AND {_TYPE} IN ('reliable', 'fake') AND source <> 'src3'""")
def usable_articles(spark, sf):
    articles = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.nullif("source", F.lit("src3")).alias("domain"), _type().alias("type"),
        F.col("text").alias("content"), F.lit("t").alias("title"), F.lit("a").alias("authors"), F.lit("u").alias("url"))
    kept = rows.usable_columns(rows.usable_articles(articles, error_prefix="L"))
    return kept.select("id", "domain", "type")


@query(f"""WITH {sql.LABELLED}, {sql.SETS} SELECT CASE set WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, fake::INTEGER AS label,
count(*) AS n, sum(length(s.text))::BIGINT AS chars FROM sets s JOIN labelled USING (doc_id) GROUP BY set, fake""")
def split_by_set(spark, sf):
    data = documents_in_sets(spark, sf).select("doc_id", "set").join(labelled(spark, sf), "doc_id")
    frames = rows.split_frames(data, "text", "fake")
    parts = [frame.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
             .withColumn("split", F.lit(name)) for name, frame in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT conv_id, turn, coalesce(party, ' ') AS blank, coalesce(party, 'none') AS named, CASE WHEN trim(coalesce(party || ' ', '') || extra) = ''
THEN ' ' ELSE trim(coalesce(party || ' ', '') || extra) END AS joined,
CASE WHEN len(words) = 0 THEN ' ' ELSE array_to_string(words, ' ') END AS combined FROM (SELECT conv_id, turn, nullif(role, 'user') AS party,
CASE WHEN turn % 2 = 0 THEN '' ELSE ' ' || role || ' ' END AS extra, list_filter([role, 'x'], lambda w: role <> 'user') AS words FROM conversations)""")
def missing_value_columns(spark, sf):
    role = F.col("role")
    data = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.nullif("role", F.lit("user")).alias("party"),
        F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit(" "), role, F.lit(" "))).alias("extra"),
        F.when(role != "user", F.array("role", F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("words"))
    party = F.col("party")
    return data.select("conv_id", "turn", text.blank_if_missing(party).alias("blank"), text.none_if_missing(party).alias("named"),
                       text.join_columns(party, F.col("extra")).alias("joined"),
                       text.joined(F.col("words")).alias("combined"))


@query(f"""SELECT doc_id, CASE WHEN lang = 'es' THEN TRUE ELSE {_TYPE} NOT IN ('reliable', 'clickbait', 'political') END AS article,
source IN ('src1', 'src4') AS statement, doc_id || '' AS id FROM documents""")
def label_flags(spark, sf):
    mapped = F.when(F.col("source") == "src1", "pants-fire").when(F.col("source") == "src4", "barely-true").when(
        F.col("source") == "src7", "true").when(F.col("source") == "src9", None).otherwise("half-true")
    kind = F.when(F.col("lang") == "es", None).otherwise(_type())
    return table(spark, sf, "documents").select(
        "doc_id", labels.article_flag(kind).alias("article"), labels.statement_flag(mapped).alias("statement"),
        labels.statement_id(F.concat("doc_id", F.lit(".json.x"))).alias("id"))


@query("SELECT doc_id FROM documents WHERE source = 'src5'")
def missing_value_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.nullif("source", F.lit("src5")).alias("source"))
    return rows.missing_values(docs, "source", "doc_id")


# Low quality is the truth, toxic the guess.
_CONFUSION = """c AS (SELECT {by} sum(CASE WHEN y AND g THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN NOT y AND g THEN 1 ELSE 0 END)::BIGINT AS fp,
sum(CASE WHEN y AND NOT g THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN NOT y AND NOT g THEN 1 ELSE 0 END)::BIGINT AS tn FROM guesses {group})
SELECT {by} round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS acc, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1, tn, fp, fn, tp FROM c"""


def _four(df):
    return df.withColumns({name: F.round(name, 6) for name in ("acc", "precision", "recall", "f1")})


@query(f"WITH guesses AS (SELECT quality = 0 AS y, toxic = 1 AS g FROM labels), {_CONFUSION.format(by='', group='')}")
def binary_metrics(spark, sf):
    guesses = table(spark, sf, "labels").select((1 - F.col("quality")).alias("label"), F.col("toxic").alias("prediction"))
    return _four(evaluate.metrics(guesses))


@query("""SELECT sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS tn FROM labels""")
def confusion_matrix(spark, sf):
    guesses = table(spark, sf, "labels").select((1 - F.col("quality")).alias("label"), F.col("toxic").alias("prediction"))
    return evaluate.confusion(guesses)


@query(f"""WITH guesses AS (SELECT lang, quality = 0 AS y, (n_chars % 1000) / 999.0 > 0.5 AS g FROM labels JOIN documents USING (doc_id)),
{_CONFUSION.format(by='lang,', group='GROUP BY lang')} ORDER BY f1 DESC""")
def threshold_metrics(spark, sf):
    scored = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    score = F.col("n_chars") % 1000 / 999.0
    guesses = scored.select("lang", (1 - F.col("quality")).alias("label"), evaluate.at_threshold(score).alias("prediction"))
    return _four(evaluate.metrics(guesses, by=["lang"])).orderBy(F.desc("f1"))
