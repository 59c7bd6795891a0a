"""Lexicon sentiment: mean polarity and subjectivity of the words of a text that stand in a lexicon."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.operators.joins import lookup_join

# A small lexicon of our own: word -> (polarity, subjectivity).
LEXICON = {
    "good": (0.7, 0.6), "great": (0.8, 0.75), "best": (1.0, 0.3), "better": (0.5, 0.5), "happy": (0.8, 1.0),
    "true": (0.35, 0.65), "real": (0.2, 0.3), "right": (0.3, 0.5), "free": (0.4, 0.8), "new": (0.15, 0.45),
    "bad": (-0.7, 0.65), "worst": (-1.0, 1.0), "worse": (-0.4, 0.6), "wrong": (-0.5, 0.9), "false": (-0.4, 0.6),
    "fake": (-0.5, 1.0), "sad": (-0.5, 1.0), "dead": (-0.2, 0.4), "poor": (-0.4, 0.6), "evil": (-1.0, 1.0),
}


def sentiment(df: DataFrame, key: str, words: str, lexicon: DataFrame) -> DataFrame:
    """(key, polarity, subjectivity) for a lexicon table (word, polarity, subjectivity) of any size.

    0 for texts without a lexicon word. Words are looked up by join and averaged per text; the words of a text are
    combined before the shuffle.
    """
    table = lexicon.select("word", "polarity", "subjectivity")
    hits = lookup_join(df.select(key, F.explode_outer(words).alias("word")), table, "word", how="left")
    return hits.groupBy(key).agg(F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"),
                                 F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias("subjectivity"))


# Words that turn the next words round, and words that make them stronger or weaker.
NEGATIONS = ["not", "no", "never", "none", "nothing", "neither", "nor", "cannot", "without"]
INTENSIFIERS = {"very": 1.3, "really": 1.3, "extremely": 1.6, "so": 1.2, "too": 1.2, "quite": 1.1, "absolutely": 1.5, "most": 1.4,
                "slightly": 0.6, "somewhat": 0.7, "hardly": 0.4, "barely": 0.4, "rather": 0.9}
SCOPE = 3  # words after a negation that it still turns


def scoped_sentiment(df: DataFrame, key: str, words: str, lexicon: DataFrame, negations: list[str] | None = None,
                     intensifiers: dict[str, float] | None = None, scope: int = SCOPE) -> DataFrame:
    """(key, polarity, subjectivity, negated, intensified) with the words before a lexicon word taken into account.

    Going through the words in order, a negation turns the polarity of the next ``scope`` words to minus one half of it, and
    intensifiers side by side multiply polarity and subjectivity of the word right after them; both are cut to -1 .. 1 and 0 .. 1.
    A word that is in the lexicon counts there, even where it also is a negation or intensifier, and ends the row of
    intensifiers. The values of a text are the means over its lexicon words (0 without one); ``negated`` and ``intensified`` count them.

    The lexicon is a table (word, polarity, subjectivity) of any size that is looked up by join. State is carried by a fold
    over the marked words of a text alone, that is over lexicon words, negations and intensifiers with their places, so the
    list that meets in one row is shorter than the text. A null or empty list has zeros; the key must be unique.
    """
    negations = NEGATIONS if negations is None else negations
    factors = INTENSIFIERS if intensifiers is None else intensifiers
    placed = df.select(key, F.posexplode_outer(words).alias("_at", "word"))
    found = lookup_join(placed, lexicon.select("word", "polarity", "subjectivity"), "word", how="left")
    factor = F.lit(None).cast("double")
    for word, value in factors.items():
        factor = F.when(F.col("word") == word, F.lit(float(value))).otherwise(factor)
    known = F.col("polarity").isNotNull()
    marks = F.struct("_at", "polarity", "subjectivity", (~known & F.col("word").isin(list(negations))).alias("turns"),
                     F.when(~known, factor).alias("factor"))
    kept = F.when(known | F.col("word").isin(list(negations)) | factor.isNotNull(), marks)
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(kept)).alias("_marks"))
    start = F.struct(F.lit(-1 - scope).alias("turned"), F.lit(-2).alias("at"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("polarity"),
                     F.lit(0.0).alias("subjectivity"), F.lit(0).alias("n"), F.lit(0).alias("negated"), F.lit(0).alias("intensified"))

    def step(state, mark):
        hit = mark["polarity"].isNotNull()
        strength = F.when(mark["_at"] == state["at"] + 1, state["factor"]).otherwise(F.lit(1.0))
        turned = mark["_at"] - state["turned"] <= scope
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mark["polarity"] * strength * F.when(turned, -0.5).otherwise(1.0)))
        felt = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mark["subjectivity"] * strength))
        return F.struct(
            F.when(mark["turns"], mark["_at"]).otherwise(state["turned"]).alias("turned"), mark["_at"].alias("at"),
            F.coalesce(mark["factor"] * strength, F.lit(1.0)).alias("factor"),
            (state["polarity"] + F.when(hit, value).otherwise(0.0)).alias("polarity"), (state["subjectivity"] + F.when(hit, felt).otherwise(0.0)).alias("subjectivity"),
            (state["n"] + hit.cast("int")).alias("n"), (state["negated"] + (hit & turned).cast("int")).alias("negated"),
            (state["intensified"] + (hit & (strength != 1.0)).cast("int")).alias("intensified"))

    total = rows.select(key, F.aggregate("_marks", start, step).alias("_t"))
    size = F.greatest(F.col("_t.n"), F.lit(1))
    return total.select(key, (F.col("_t.polarity") / size).alias("polarity"), (F.col("_t.subjectivity") / size).alias("subjectivity"),
                        F.col("_t.negated").alias("negated"), F.col("_t.intensified").alias("intensified"))


def sentiment_of(words: Column, lexicon: dict | None = None) -> Column:
    """The same as a column expression, for a small lexicon given as ``{word: (polarity, subjectivity)}``."""
    lexicon = LEXICON if lexicon is None else lexicon
    table = F.create_map(*[part for word, (polarity, subjectivity) in lexicon.items() for part in (
        F.lit(word), F.struct(F.lit(float(polarity)).alias("polarity"), F.lit(float(subjectivity)).alias("subjectivity")))])
    scores = F.transform(F.filter(words, lambda word: word.isin(list(lexicon))), lambda word: F.element_at(table, word))
    start = F.struct(F.lit(0.0).alias("polarity"), F.lit(0.0).alias("subjectivity"), F.lit(0).alias("n"))

    def add(total, score):
        return F.struct((total["polarity"] + score["polarity"]).alias("polarity"),
                        (total["subjectivity"] + score["subjectivity"]).alias("subjectivity"),
                        (total["n"] + 1).alias("n"))

    def mean(total):
        size = F.greatest(total["n"], F.lit(1))
        return F.struct((total["polarity"] / size).alias("polarity"), (total["subjectivity"] / size).alias("subjectivity"))

    return F.aggregate(scores, start, add, mean)
