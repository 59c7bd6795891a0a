import random
import re
import time

import pytest
from pyspark.sql import functions as F

from newsframe.functions import labels, stem, text, vectors
from newsframe.sources import codecs

# The cleaning rules as plain patterns, used as the brute-force statement of the same function.
PLAIN_RULES = [
    (r"<.*?>", ""),
    (r"[<>]", ""),
    (r"(?:https?://)?(?:www\.)?[a-zA-Z0-9\-_+=.:~@#%]+\.[a-zA-Z0-9()]{1,6}\b[a-zA-Z0-9\-_.:\\/@#$%&()=+~?]*", " <URL> "),
    (r"(?:https?://)?w{0,3}\.?[a-z]+\.[a-z]\w*[\w/\-]*", " <URL> "),
    (r"(?:\d{1,2}(?:[:\-/\\]|(?:,\s)?)){2}\d{2,4}|\d{2,4}(?:(?:[:\-/\\]|(?:,\s)?)\d{1,2}){2}", " <DATE> "),
    (r"(?:" + text.MONTHS + r")(?:[:\-/\\]|(?:,\s)?)\d{1,2}(?:[:\-/\\]|(?:,\s)?)\d{1,4}", " <DATE> "),
    (r"[\w.\-]+@(?:[\w\-]+\.)+[\w\-]{2,4}|@\w+", " <EMAIL> "),
    (r"(?:\r\n|\n|\r)+", " "),
    (r"\t+", " "),
    (r"\?", " ? "),
    (r"!", " ! "),
    (r"-", " "),
    (r"'", " "),
    (r"[^A-Za-z0-9\s<>?!]", ""),
    (r"\d+(?:th)?", " <NUM> "),
    (r" +", " "),
]


def plain_clean(value: str) -> str:
    value = value.lower()
    for pattern, by in PLAIN_RULES:
        value = re.sub(pattern, by, value)
    return value


def column(spark, values, function, schema="string"):
    df = spark.createDataFrame([(i, value) for i, value in enumerate(values)], f"i int, x {schema}")
    return [row.y for row in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cleaning_examples(spark):
    cases = {
        "a.b@c.com": " <URL> ", "3.14": " <URL> ", "u.s.": " <URL> ", "ends.Next": " <URL> ", "1234": " <DATE> ",
        "123456": " <DATE> ", "12:30": " <DATE> ", "2016-01-05": " <DATE> <NUM> ", "Jan 5 2016": "jan <NUM> <DATE> ",
        "4th": " <NUM> ", "1st": " <NUM> st", "café": "caf", "line<a\nb>x": "linea bx", "@handle": " <EMAIL> ",
        "It's <b>bold</b>!": "it s bold ! ", "": "", None: None, "\n" * 5000: " ",
    }
    assert column(spark, list(cases), text.clean_text) == list(cases.values())
    assert column(spark, ["Well, e. g. no?"], lambda c: text.clean_text(c, False)) == ["well, e. g. no ? "]


def test_cleaning_equals_the_plain_rules(spark):
    rng = random.Random(1)
    pieces = ["a", "w", "www.", "http://", "https://", "b.c", ".", "..", "@", "-", "_", "é", "jan", "may ", "5", "12", "th", " ",
              "\n", ",", ", ", ":", "/", "<", ">", "?", "!", "'", "(", ")", "%", "\xa0", " ", "abcdefgh", "日", "$", "~", "\x1c"]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(6000)]
    assert column(spark, values, text.clean_text) == [plain_clean(value) for value in values]


def test_cleaning_equals_the_plain_rules_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    values = [row.text for row in docs]
    assert column(spark, values, text.clean_text) == [plain_clean(value) for value in values]


def test_cleaning_rules_run_only_where_they_can_match(spark):
    rules = [(text._ANY_LINK, text._LINK), (text._ANY_LINK, text._LINK_PLAIN), (text._ANY_DATE, text._DATE), (text._ANY_DATE, text._MONTH_DATE), ("@", text._EMAIL),
             ("<", text._TAG), (text._PAST_ASCII, text._OTHER_SYMBOLS)]
    rng = random.Random(2)
    pieces = ["a", "www.", "http://", "b.c", ".", "@", "-", "é", "jan", "may", "5", "٣", " ", ",", ":", "/", "<", ">", "(", "日", "\x85", "\u2003"]
    df = spark.createDataFrame([("".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))),) for _ in range(4000)], "x string")
    found = df.select(*[F.count_if(F.col("x").rlike(rule)).alias(f"f{at}") for at, (_, rule) in enumerate(rules)],
                      *[F.count_if(F.col("x").rlike(rule) & ~F.col("x").rlike(needed)).alias(f"m{at}") for at, (needed, rule) in enumerate(rules)]).first()
    assert all(found[f"f{at}"] > 0 and found[f"m{at}"] == 0 for at in range(len(rules)))
    assert column(spark, ["a", None], lambda c: text._replaced(c, lambda value: F.lit(False), ("a", "b"))) == ["a", None]
    assert column(spark, ["a", None], lambda c: text._replaced(c, lambda value: F.lit(True), ("a", "b"), ("b", "c"))) == ["c", None]


@pytest.mark.parametrize("value", [
    "a" * 300_000, "<" * 300_000, "a." * 100_000, "x@" + "abcdefgh." * 50_000, "@" * 200_000, "." * 200_000,
    "1" * 300_000, "w" * 300_000, "http" * 60_000, "\n" * 300_000, "é" * 200_000, "a-" * 100_000, " " * 300_000,
    "abcdefgh@" * 30_000], ids=lambda value: value[:10])
def test_cleaning_takes_linear_time(spark, value):
    start = time.time()
    column(spark, [value], text.clean_text)
    assert time.time() - start < 20


def test_tokens_and_stop_words(spark):
    assert column(spark, [" a  b\xa0c　d\n", "", " ", None], text.tokens) == [["a", "b", "c", "d"], [], [], None]
    words = column(spark, [["the", "The", "cat", "the", "cat"]], text.remove_stop_words, "array<string>")
    assert words == [["The", "cat", "cat"]]
    assert column(spark, [["a", "b"], []], text.joined, "array<string>") == ["a b", " "]
    assert column(spark, ["The U.S. has 2 cats_x, é è"], text.vectoriser_tokens) == [["the", "has", "cats_x"]]
    assert column(spark, ["A-b <NUM> it's\tc"], text.sequence_tokens) == [["a", "b", "num", "it's", "c"]]


def test_counts(spark):
    rows = [["neither", "no", "cat"], []]
    assert column(spark, rows, text.negation_count, "array<string>") == [4, 0]
    assert column(spark, rows, lambda c: text.negation_count(c, True), "array<string>") == [2, 0]
    rows = [["i", "see", "you", "and", "them", "i"]]
    assert [column(spark, rows, lambda c, n=n: text.pronoun_counts(c)[n], "array<string>")[0]
            for n in ("first", "second", "third", "all")] == [2, 1, 1, 4]


def test_mean_sentence_length(spark):
    rng = random.Random(2)
    lists = [[rng.choice(["a", "b", ".", "!", "?"]) for _ in range(rng.randint(0, 12))] for _ in range(300)]

    def brute(words):
        closed = "".join("." if word in ".!?" else "x" for word in words).split(".")[:-1]
        return sum(len(part) + 1 for part in closed) / len(closed) if closed else 0.0
    assert column(spark, lists, text.mean_sentence_length, "array<string>") == pytest.approx([brute(words) for words in lists])


def test_ngrams(spark):
    rows = [["a", "b", "c"], ["a"], []]
    assert column(spark, rows, lambda c: text.ngrams(c, 1, 3), "array<string>") == [
        ["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_names_and_labels(spark):
    assert column(spark, [" Anne O'Neil , Bo-B", None, ""], text.clean_authors) == ["anne oneilbob", "", ""]
    assert column(spark, ["News-Site.co.uk", None], text.clean_domain) == ["newssite", None]
    kinds = [*labels.ARTICLE_FLAGS, "rumour", None]
    assert column(spark, kinds, labels.article_flag) == [*labels.ARTICLE_FLAGS.values(), True, True]
    statements = ["pants-fire", "false", "barely-true", "half-true", "mostly-true", "true", None]
    assert column(spark, statements, labels.statement_flag) == [True, True, True, False, False, False, False]
    assert column(spark, ["12.json", "12"], labels.statement_id) == ["12", "12"]


def test_stems(spark):
    pairs = """caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor sing sing
    conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss failing fail filing file
    happy happi sky sky skies sky dying die news news relational relat conditional condit rational ration valenci valenc
    digitizer digit radicalli radic vileli vile vietnamization vietnam operator oper feudalism feudal hopefulness hope
    formaliti formal sensibiliti sensibl triplicate triplic formative form electrical electr goodness good revival reviv
    allowance allow inference infer airliner airlin adjustable adjust defensible defens replacement replac adoption adopt
    homologou homolog communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate
    cease ceas controll control roll roll died die spied spi <URL> <url> by by enjoy enjoy fly fli owed owe""".split()
    assert column(spark, pairs[::2], stem.stem_word) == pairs[1::2]
    assert column(spark, [["Cats", "is", "RUNNING"], []], stem.stem_words, "array<string>") == [["cat", "is", "run"], []]


def test_vectors_and_codecs(spark):
    assert column(spark, [[1, 1, 2], [1, -1], []], vectors.normalise, "array<int>") == [[0.25, 0.25, 0.5], [1.0, -1.0], []]
    assert column(spark, ["1 2  3", ""], vectors.text_vector) == [[1, 2, 3], []]
    lists = ["['a', 'b']", '["it\'s", \'c\']', "[]", r"['it\'s']"]
    assert column(spark, lists, codecs.parse_word_list) == [["a", "b"], ["it's", "c"], [], ["it's"]]


def test_fixed_lists_are_as_written_down():
    """The SQL of the queries takes these lists from the code, so a slip in them would not show there."""
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 179
    assert {"i", "ourselves", "you've", "itself", "doesn't", "ma", "wouldn't"} < set(text.STOP_WORDS) and "would" not in text.STOP_WORDS
    assert text.FIRST_PRONOUNS == ["i", "me", "my", "mine", "we", "us", "our", "ours"] and text.SECOND_PRONOUNS == ["you", "your", "yours"]
    assert text.THIRD_PRONOUNS == ["he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "theirs"]
    assert text.NEGATIONS.count("neither") == 3 and len(text.NEGATIONS) == 16
    for month in "january jan february feb march mar april apr may june jun july jul august aug september sep october oct november nov december dec".split():
        assert re.fullmatch(text.MONTHS, month)


def test_sequence_tokens_are_split_at_once(spark):
    """One split at all separators gives the words that blanks in their place would give, and no character is translated first."""
    texts = [None, "", "  ", "!a!", "a\\b-c^d&&e[f]g h\ti\nj\rk\xa0l", "İ\x00b {x}|~", "\"#$%()*+,./:;<=>?@_`"]
    assert column(spark, texts, text.sequence_tokens) == [
        None, [], [], ["a"], ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j\rk\xa0l"], ["i̇\x00b", "x"], []]
    assert "translate" not in str(text.sequence_tokens(F.col("text")))
