"""Porter stemming (M. F. Porter, "An algorithm for suffix stripping", 1980) as array expressions.

Every step is one ``transform`` over the word list, written as an SQL lambda over the word ``w``, so the whole chain
runs in one stage without Python workers.
The variant is the common library default with its short-word and irregular-form additions. A word's shape is a
string of ``c`` (consonant) and ``v`` (vowel); the measure of the paper is the number of ``vc`` changes in it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular forms and their stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix tables of steps 2, 3 and 4.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
          ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
          ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
          ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
          "ate", "iti", "ous", "ive", "ize"]

# Marks at the end of a word: '#' for a cut -ed or -ing that still needs tidying, '=' for words no step may touch.
_OPEN, _DONE = "#", "="


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _shape(word: str) -> str:
    # y is a vowel after a consonant and a consonant elsewhere; runs of y alternate.
    plain = f"translate(regexp_replace({word}, '[^aeiouy]', 'c'), 'aeiou', 'vvvvv')"
    mixed = f"regexp_replace(replace({plain}, 'cy', 'cv'), '(^|v)y', '$1c')"
    return f"if(contains(w, 'y'), translate(replace({mixed}, 'yy', 'vc'), 'y', 'v'), {plain})"


def _some(stem: str) -> str:
    return f"contains({_shape(stem)}, 'vc')"


def _many(stem: str) -> str:
    return f"{_shape(stem)} rlike 'vc+v+c'"


def _closed(stem: str) -> str:
    """Ends consonant-vowel-consonant (last one not w, x or y), or is exactly vowel-consonant."""
    shape = _shape(stem)
    return f"((endswith({shape}, 'cvc') and right({stem}, 1) not in ('w', 'x', 'y')) or {shape} = 'vc')"


def _rules(rules: list[tuple]) -> str:
    """The first rule whose suffix fits decides, also when its condition fails.

    A cheap test on the last two letters keeps most words away from the rules.
    """
    cases = " ".join(
        f"when endswith(w, '{suffix}') then if({condition(_cut(len(suffix)))}, concat({_cut(len(suffix))}, '{ending}'), w)"
        for suffix, ending, condition in rules)
    last_two = ", ".join(f"'{pair}'" for pair in sorted({suffix[-2:] for suffix, _, _ in rules}))
    return f"case when right(w, 2) not in ({last_two}) then w {cases} else w end"


def _steps() -> list[str]:
    stem = _cut(1)
    irregular = " ".join(f"when '{word}' then '{root}{_DONE}'" for word, root in IRREGULAR.items())
    names = ", ".join(f"'{word}'" for word in IRREGULAR)
    return [
        f"""case when length(w) <= 2 then concat(w, '{_DONE}') when w in ({names}) then case w {irregular} end
            else w end""",
        f"""case when not endswith(w, 's') then w when endswith(w, 'ies') and length(w) = 4 then {stem}
            when endswith(w, 'sses') or endswith(w, 'ies') then {_cut(2)} when endswith(w, 'ss') then w
            else {stem} end""",
        f"""case when right(w, 2) not in ('ed', 'ng') then w
            when endswith(w, 'ied') then if(length(w) = 4, {stem}, {_cut(2)})
            when endswith(w, 'eed') then if({_some(_cut(3))}, {stem}, w)
            when endswith(w, 'ed') then if(contains({_shape(_cut(2))}, 'v'), concat({_cut(2)}, '{_OPEN}'), w)
            when endswith(w, 'ing') then if(contains({_shape(_cut(3))}, 'v'), concat({_cut(3)}, '{_OPEN}'), w)
            else w end""",
        f"""case when not endswith(w, '{_OPEN}') then w
            when endswith({stem}, 'at') or endswith({stem}, 'bl') or endswith({stem}, 'iz') then concat({stem}, 'e')
            when length(w) >= 3 and substr(w, -2, 1) = substr(w, -3, 1) and endswith({_shape(stem)}, 'c')
              then if(substr(w, -2, 1) in ('l', 's', 'z'), {stem}, {_cut(2)})
            when {_some(stem)} and not {_many(stem)} and {_closed(stem)} then concat({stem}, 'e') else {stem} end""",
        f"if(endswith(w, 'y') and length(w) > 2 and endswith({_shape(stem)}, 'c'), concat({stem}, 'i'), w)",
        f"if(endswith(w, 'alli') and {_some(_cut(4))}, {_cut(2)}, w)",
        _rules([(suffix, ending, (lambda s: _some(f"concat({s}, 'l')")) if suffix == "logi" else _some)
                for suffix, ending in STEP_2]),
        _rules([(suffix, ending, _some) for suffix, ending in STEP_3]),
        _rules([(suffix, "", (lambda s: f"(right({s}, 1) in ('s', 't') and {_many(s)})") if suffix == "ion" else _many)
                for suffix in STEP_4]),
        f"if(endswith(w, 'e') and ({_many(stem)} or ({_some(stem)} and not {_closed(stem)})), {stem}, w)",
        f"if(endswith(w, 'll') and {_many(stem)}, {stem}, w)",
        f"if(endswith(w, '{_DONE}'), {stem}, w)",
    ]


def stem_words(words: Column) -> Column:
    """Stem of every word, lower-cased, in order."""
    out = F.call_function("transform", words, F.expr("w -> lower(w)"))
    for step in _steps():
        out = F.call_function("transform", out, F.expr(f"w -> {step}"))
    return out


def stem_word(word: Column) -> Column:
    return stem_words(F.array(word))[0]
