"""Vocabularies: word counts, frequency bands, reduction rates, stems."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.functions.stem import stem_word
from newsframe.operators.frequency import occurrences, top, with_share


def vocabulary(df: DataFrame, words: str) -> DataFrame:
    """(word, n) over all documents."""
    return occurrences(df, words).groupBy("word").agg(F.count("*").alias("n"))


def set_vocabulary(df: DataFrame, words: str, set_col: str = "set") -> DataFrame:
    """(set, word, n_t): occurrences per set; without a set column everything is set 0."""
    number = F.col(set_col) if set_col in df.columns else F.lit(0)
    return (occurrences(df, words, number.cast("int").alias("set")).groupBy("set", "word")
            .agg(F.count("*").alias("n_t")))


def set_sizes(df: DataFrame, set_col: str = "set") -> DataFrame:
    """(set, n): documents per set."""
    number = F.col(set_col) if set_col in df.columns else F.lit(0)
    return df.groupBy(number.cast("int").alias("set")).agg(F.count("*").alias("n"))


def frequency_band(counts: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Words whose share of all words lies in [low, high], in alphabetical order."""
    shares = with_share(counts, name="frequency", scale=1.0)
    return shares.filter(F.col("frequency").between(low, high)).orderBy("word")


def frequencies(counts: DataFrame) -> DataFrame:
    """(word, frequency), most frequent first."""
    return with_share(counts, name="frequency", scale=1.0).orderBy(F.desc("n"), "word").select("word", "frequency")


def most_frequent(counts: DataFrame, n: int, freq: bool = False, rank: bool = False) -> DataFrame:
    """The n most frequent words with count or frequency; ``rank`` adds the position for a frequency line."""
    source = with_share(counts, name="frequency", scale=1.0) if freq else counts
    return top(source, n, "word", rank="rank" if rank else None)


def stem_counts(counts: DataFrame) -> DataFrame:
    """(stem, n) from (word, n): every distinct word is stemmed once, however often it occurs."""
    return counts.groupBy(stem_word(F.col("word")).alias("stem")).agg(F.sum("n").alias("n"))


def count_reduction(counts: DataFrame, stop_words: Iterable[str]) -> DataFrame:
    """Vocabulary sizes after stop words and after stems, from (word, n): every distinct word is looked at once.

    Sizes and their reduction in % against the whole vocabulary, in the columns vocabulary, no_stop_words, stemmed,
    no_stop_words_reduction and stemmed_reduction.
    """
    kept = counts.select("word", (~F.col("word").isin(list(stop_words))).alias("kept"))
    stems = kept.filter("kept").select(stem_word(F.col("word")).alias("stem")).distinct().agg(F.count("*").alias("stemmed"))
    sizes = kept.agg(F.count("*").alias("vocabulary"), F.count_if("kept").alias("no_stop_words")).crossJoin(F.broadcast(stems))
    return sizes.select("*", *[((F.col("vocabulary") - F.col(name)) / F.col("vocabulary") * 100).alias(f"{name}_reduction")
                               for name in ("no_stop_words", "stemmed")])


def reduction_rates(df: DataFrame, before: str, columns: dict[str, str]) -> DataFrame:
    """Vocabulary sizes and their reduction in % against ``before``.

    ``columns`` maps a result name to a word-list column. All lists are counted in one pass.
    """
    names = {"vocabulary": before, **columns}
    pairs = F.explode_outer(F.array(*[F.struct(F.lit(name).alias("step"), F.col(column).alias("words"))
                                for name, column in names.items()]))
    words = (occurrences(df.select(pairs.alias("pair")), "pair.words", "pair.step")
             .groupBy("step", "word").agg(F.lit(1).alias("one")))
    sizes = words.agg(*[F.count_if(F.col("step") == name).alias(name) for name in names])
    return sizes.select("*", *[
        ((F.col("vocabulary") - F.col(name)) / F.col("vocabulary") * 100).alias(f"{name}_reduction")
        for name in columns])
