r"""Text columns: cleaning, tokens, stop words, per-document counts, n-grams.

All functions are compositions of built-in expressions. The patterns spell out the Unicode classes instead of
using ``\w``, ``\s`` and ``\b``, so that they mean the same in every regex engine, and they are written to run in
linear time and constant stack on any input: a run of a million letters or ten thousand domain labels is fine.
"""

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, as a word character and as a digit in Unicode text.
SPACE = r"\t\n\x{0b}\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
               + "\u2028\u2029\u202f\u205f\u3000")

# Character classes and month names of the cleaning rules.
URL_CHARS = r"a-zA-Z0-9\-_+=.:~@#%"
URL_TAIL = r"a-zA-Z0-9\-_.:\\/@#$%&()=+~?"
MONTHS = ("[Jj]an(?:uary)?|[Ff]eb(?:ruary)?|[Mm]ar(?:ch)?|[Aa]pr(?:il)?|[Mm]ay|[Jj]un(?:e)?|[Jj]ul(?:y)?|"
          "[Aa]ug(?:ust)?|[Ss]ep(?:tember)?|[Oo]ct(?:ober)?|[Nn]ov(?:ember)?|[Dd]ec(?:ember)?")
DATE_GLUE = rf"(?:[:\-/\\]|(?:,[{SPACE}])?)"

_EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# A tag is cut out; a '<' without '>' on its line keeps its text and is skipped in one step.
_TAG = r"<[^>\n]*+>|(<[^>\n]*+)"

# A link may start only at the beginning of a run of link characters: if it fails there it fails inside, too.
_LINK = rf"(?:https?://|(?<![{URL_CHARS}]))[{URL_CHARS}]+\.[a-zA-Z0-9()]{{1,6}}{_EDGE}[{URL_TAIL}]*"
_LINK_PLAIN = rf"(?:https?://w{{0,3}}\.?|(?<![a-z])w{{0,3}}\.?|\.)[a-z]+\.[a-z][{WORD}/\-]*"

# The look-aheads only reject most positions early.
_DATE = (rf"(?={DIGIT})(?:(?:{DIGIT}{{1,2}}{DATE_GLUE}){{2}}{DIGIT}{{2,4}}"
         rf"|{DIGIT}{{2,4}}(?:{DATE_GLUE}{DIGIT}{{1,2}}){{2}})")
_MONTH_DATE = rf"(?=[jfmasond][a-z]{{2}})(?:{MONTHS}){DATE_GLUE}{DIGIT}{{1,2}}{DATE_GLUE}{DIGIT}{{1,4}}"

# Domain labels are consumed by possessive loops, one chunk per dot that is followed by two or more characters.
_LABEL = rf"[{WORD}\-]"
_DOMAIN = (rf"(?:(?:{_LABEL}+\.(?!{_LABEL}{{2}}))*+{_LABEL}+\.(?={_LABEL}{{2}}))++{_LABEL}{{2,4}}")
_EMAIL = rf"(?:(?<![{WORD}.\-])|\G)[{WORD}.\-]++@{_DOMAIN}|@[{WORD}]+"

# What a text must hold for the rules of links or dates to find anything. Both are single cheap scans.
_ANY_LINK, _ANY_DATE = r"\.[a-zA-Z0-9()]", DIGIT

# Symbols in ASCII (without the zero character), and what is left of them elsewhere.
_SYMBOLS = "".join(char for char in map(chr, range(1, 128)) if not (char.isascii() and char.isalnum()) and char not in SPACE_CHARS + "<>?!")
_PAST_ASCII = r"[^\x{01}-\x{7f}]"
_OTHER_SYMBOLS = rf"{_PAST_ASCII}(?<![{SPACE}])"

# English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
that that'll these those am is are was were be been being have has had having do does did doing a an the and but
if or because as until while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
weren weren't won won't wouldn wouldn't
""".split()

# Personal pronouns and negations.
FIRST_PRONOUNS = ["i", "me", "my", "mine", "we", "us", "our", "ours"]
SECOND_PRONOUNS = ["you", "your", "yours"]
THIRD_PRONOUNS = ["he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "theirs"]
NEGATIONS = ["not", "never", "neither", "nor", "barely", "hardly", "scarcely", "seldom", "rarely", "no",
             "neither", "neither", "nothing", "none", "nobody", "nowhere"]

SENTENCE_ENDS = [".", "!", "?"]


def _replaced(text: Column, needed: Callable, *rules: tuple[str, str]) -> Column:
    """Texts for which ``needed`` is true with the rules applied in order; the others cannot hold a match.

    The array of one makes the text a variable, so the steps before are written, and computed, once.
    """
    def apply(value: Column) -> Column:
        done = value
        for pattern, by in rules:
            done = F.regexp_replace(done, pattern, by)
        return F.when(needed(value), done).otherwise(value)
    return F.get(F.transform(F.array(text), apply), F.lit(0))


def clean_text(text: Column, remove_punct: bool = True) -> Column:
    """Lower-cased text with tags dropped, links, dates, addresses and numbers masked, symbols removed.

    Missing text stays missing. ``remove_punct=False`` keeps full stops and commas.
    """
    out = _replaced(F.lower(text), lambda value: F.contains(value, F.lit("<")), (_TAG, "$1"))
    # Line ends and tabs become blanks, left-over angle brackets go; runs of blanks shrink in the last step.
    out = F.translate(out, "\r\n\t<>", "   ")
    out = _replaced(out, lambda value: value.rlike(_ANY_LINK), (_LINK, " <URL> "), (_LINK_PLAIN, " <URL> "))
    out = _replaced(out, lambda value: value.rlike(_ANY_DATE), (_DATE, " <DATE> "), (_MONTH_DATE, " <DATE> "))
    out = _replaced(out, lambda value: F.contains(value, F.lit("@")), (_EMAIL, " <EMAIL> "))
    for mark, spaced in (("?", " ? "), ("!", " ! "), ("-", " "), ("'", " ")):
        out = F.replace(out, F.lit(mark), F.lit(spaced))
    out = F.translate(out, _SYMBOLS if remove_punct else _SYMBOLS.replace(".", "").replace(",", ""), "")
    out = _replaced(out, lambda value: value.rlike(_PAST_ASCII), (_OTHER_SYMBOLS, ""))
    out = F.regexp_replace(out, "[0-9]+(?:th)?", " <NUM> ")
    return F.regexp_replace(out, " +", " ")


def tokens(text: Column) -> Column:
    """Words between white space, no empty ones."""
    return F.array_remove(F.split(text, f"(?![!-~])[{SPACE}]+"), "")


def remove_stop_words(words: Column, stop_words: list[str] | None = None) -> Column:
    """Words that are not in the list (exact match); order and repetitions stay."""
    listed = STOP_WORDS if stop_words is None else stop_words
    return F.filter(words, lambda word: ~word.isin(listed)) if listed else words


def joined(words: Column) -> Column:
    """Words with blanks between them; one blank for an empty list."""
    return F.regexp_replace(F.array_join(words, " "), "^$", " ")


def join_columns(*columns: Column) -> Column:
    """Non-missing texts with blanks between them, stripped; one blank if nothing is left."""
    return F.regexp_replace(F.trim(F.concat_ws(" ", *columns), F.lit(SPACE_CHARS)), "^$", " ")


def blank_if_missing(text: Column) -> Column:
    return F.coalesce(text, F.lit(" "))


def none_if_missing(text: Column) -> Column:
    return F.coalesce(text, F.lit("none"))


def clean_authors(authors: Column) -> Column:
    """Comma-separated names, each stripped, lower-cased and cleared of symbols, written without separator."""
    names = F.transform(
        F.split(authors, ","),
        lambda name: F.regexp_replace(F.lower(F.trim(name, F.lit(SPACE_CHARS))), rf"[^A-Za-z0-9{SPACE}]", ""))
    return F.coalesce(F.array_join(names, ""), F.lit(""))


def clean_domain(domain: Column) -> Column:
    """First label of a host name, lower-cased, without symbols; missing stays missing."""
    return F.regexp_replace(F.lower(F.substring_index(domain, ".", 1)), rf"[^A-Za-z0-9{SPACE}]", "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def count_of(words: Column, listed: list[str]) -> Column:
    """How many words are in the list; a word listed k times counts k times."""
    repeats = {word: listed.count(word) for word in listed}
    parts = [F.size(F.filter(words, lambda word: word.isin(list(repeats))))]
    # array_remove keeps all other words, so the difference in size is the number of occurrences.
    parts += [F.lit(k - 1) * (F.size(words) - F.size(F.array_remove(words, term)))
              for term, k in repeats.items() if k > 1]
    return reduce(lambda left, right: left + right, parts)


def mean_sentence_length(words: Column) -> Column:
    """Mean number of words per closed sentence (the closing mark counts); 0 without any closing mark.

    The open rest after the last mark is ignored, so the mean is the position of the last mark over the number
    of marks.
    """
    marks = F.size(F.filter(words, lambda word: word.isin(SENTENCE_ENDS)))
    last = F.array_max(F.transform(words, lambda word, at: F.when(word.isin(SENTENCE_ENDS), at + 1)))
    return F.when(marks == 0, F.lit(0.0)).otherwise(last / marks)


def pronoun_counts(words: Column) -> dict[str, Column]:
    return {
        "first": count_of(words, FIRST_PRONOUNS),
        "second": count_of(words, SECOND_PRONOUNS),
        "third": count_of(words, THIRD_PRONOUNS),
        "all": count_of(words, FIRST_PRONOUNS + SECOND_PRONOUNS + THIRD_PRONOUNS),
    }


def negation_count(words: Column, dedupe_terms: bool = False) -> Column:
    """Negations; one term stands three times in the list and counts three times unless ``dedupe_terms``."""
    return count_of(words, list(dict.fromkeys(NEGATIONS)) if dedupe_terms else NEGATIONS)


def vectoriser_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


# Characters that separate words in padded sequences.
SEQUENCE_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"


def sequence_tokens(text: Column) -> Column:
    """Lower-cased words between blanks after the punctuation has become blanks."""
    return F.array_remove(F.split(F.lower(text), f"[{re.escape(SEQUENCE_FILTERS)} ]+"), "")


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """All runs of ``low`` to ``high`` neighbouring words, joined by blanks, shorter runs first."""
    def runs(n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.array_join(F.slice(words, at, n), " "))
    return F.concat(*[runs(n) for n in range(low, high + 1)])
