"""SQL fragments shared by the oracle texts (DuckDB dialect, RE2 patterns)."""

from newsframe.functions import stem
from newsframe.functions import text as t


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(value) for value in dict.fromkeys(values)) + ")"


def replace_all(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(by)}, 'g')"


_TAIL_SYMBOLS = r"\-.:\\/@#$%&()=+~?"
# A link ends at a word edge; the character behind the edge is captured and put back.
_LINK = (rf"(?:https?://)?[{t.URL_CHARS}]+\.[a-zA-Z0-9()]{{0,5}}"
         rf"(?:[a-zA-Z0-9](?:[{_TAIL_SYMBOLS}][{t.URL_TAIL}]*|$|([^{t.URL_TAIL}\p{{L}}\p{{N}}]))"
         rf"|[()](?:[a-zA-Z0-9_][{t.URL_TAIL}]*|([\p{{L}}\p{{N}}])))")
_W = t.WORD


def clean(expr: str, kept: str = "") -> str:
    out = f"lower({expr})"
    for pattern, by in (
        (r"<[^>\n]*>", ""), ("[<>]", ""), (_LINK, r" <URL> \1\2"),
        (rf"(?:https?://)?w{{0,3}}\.?[a-z]+\.[a-z][{_W}]*[{_W}/\-]*", " <URL> "),
        (rf"(?:{t.DIGIT}{{1,2}}{t.DATE_GLUE}){{2}}{t.DIGIT}{{2,4}}|{t.DIGIT}{{2,4}}(?:{t.DATE_GLUE}{t.DIGIT}{{1,2}}){{2}}", " <DATE> "),
        (rf"(?:{t.MONTHS}){t.DATE_GLUE}{t.DIGIT}{{1,2}}{t.DATE_GLUE}{t.DIGIT}{{1,4}}", " <DATE> "),
        (rf"[{_W}.\-]+@(?:[{_W}\-]+\.)+[{_W}\-]{{2,4}}|@[{_W}]+", " <EMAIL> "),
        (r"[\r\n]+", " "), (r"\t+", " "), (r"\?", " ? "), ("!", " ! "), ("-", " "), ("'", " "),
        (rf"[^A-Za-z0-9{t.SPACE}<>?!{kept}]", ""), (r"[0-9]+(?:th)?", " <NUM> "), (" +", " "),
    ):
        out = replace_all(out, pattern, by)
    return out


def tokens(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {quoted(f'[{t.SPACE}]+')}), lambda w: w <> '')"


def without_stop_words(expr: str) -> str:
    return f"list_filter({expr}, lambda w: w NOT IN {in_list(t.STOP_WORDS)})"


def words_of(expr: str) -> str:
    return tokens(clean(expr))


def count_in(expr: str, values) -> str:
    return f"len(list_filter({expr}, lambda w: w IN {in_list(values)}))"


LABELLED = """labelled AS (SELECT d.doc_id, d.text, d.source, d.lang, (l.quality = 0 OR l.toxic = 1) AS fake
FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
LABELLED_WORDS = f"{LABELLED}, lw AS (SELECT *, {words_of('text')} AS words FROM labelled)"
SETS = """sets AS (SELECT doc_id, text, lang, CASE WHEN rn <= floor(0.6::DOUBLE * n) THEN 0
WHEN rn <= floor(0.6::DOUBLE * n) + floor(0.2::DOUBLE * n) THEN 1 ELSE 2 END AS set
FROM (SELECT doc_id, text, lang, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)
WHERE rn <= floor(0.6::DOUBLE * n) + 2 * floor(0.2::DOUBLE * n))"""


# Porter stemming as a chain of CTEs over distinct words.

def _shape(e: str) -> str:
    plain = f"translate(regexp_replace({e}, '[^aeiouy]', 'c', 'g'), 'aeiou', 'vvvvv')"
    mixed = f"regexp_replace(replace({plain}, 'cy', 'cv'), '(^|v)y', '\\1c', 'g')"
    return f"replace(replace({mixed}, 'yy', 'vc'), 'y', 'v')"


def _cut(n: int, e: str = "w") -> str:
    return f"left({e}, greatest(length({e}) - {n}, 0))"


def _some(e: str) -> str:
    return f"contains({_shape(e)}, 'vc')"


def _many(e: str) -> str:
    return f"regexp_matches({_shape(e)}, 'vc+v+c')"


def _closed(e: str) -> str:
    return f"((suffix({_shape(e)}, 'cvc') AND right({e}, 1) NOT IN ('w', 'x', 'y')) OR {_shape(e)} = 'vc')"


def _rules(rules) -> str:
    cases = " ".join(f"WHEN suffix(w, '{s}') THEN CASE WHEN {cond(_cut(len(s)))} THEN {_cut(len(s))} || '{by}' ELSE w END"
                     for s, by, cond in rules)
    return f"CASE {cases} ELSE w END"


def stem_ctes(source: str, column: str = "word") -> str:
    """CTE text that ends in ``stems(word, stem)`` for the distinct words of ``source``."""
    irregular = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in stem.IRREGULAR.items())
    s1 = _cut(1)
    steps = [
        f"""CASE WHEN suffix(w, 'ies') AND length(w) = 4 THEN {s1} WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {_cut(2)}
        WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN {s1} ELSE w END""",
        f"""CASE WHEN suffix(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {s1} ELSE {_cut(2)} END
        WHEN suffix(w, 'eed') THEN CASE WHEN {_some(_cut(3))} THEN {s1} ELSE w END
        WHEN suffix(w, 'ed') THEN CASE WHEN contains({_shape(_cut(2))}, 'v') THEN {_cut(2)} || '#' ELSE w END
        WHEN suffix(w, 'ing') THEN CASE WHEN contains({_shape(_cut(3))}, 'v') THEN {_cut(3)} || '#' ELSE w END ELSE w END""",
        f"""CASE WHEN NOT suffix(w, '#') THEN w WHEN regexp_matches(w, '(at|bl|iz)#$') THEN {s1} || 'e'
        WHEN length(w) >= 3 AND substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND suffix({_shape(s1)}, 'c')
          THEN CASE WHEN substr(w, length(w) - 1, 1) IN ('l', 's', 'z') THEN {s1} ELSE {_cut(2)} END
        WHEN {_some(s1)} AND NOT {_many(s1)} AND {_closed(s1)} THEN {s1} || 'e' ELSE {s1} END""",
        f"CASE WHEN suffix(w, 'y') AND length(w) > 2 AND suffix({_shape(s1)}, 'c') THEN {s1} || 'i' ELSE w END",
        f"CASE WHEN suffix(w, 'alli') AND {_some(_cut(4))} THEN {_cut(2)} ELSE w END",
        _rules([(s, by, (lambda e: _some(f"({e} || 'l')")) if s == "logi" else _some) for s, by in stem.STEP_2]),
        _rules([(s, by, _some) for s, by in stem.STEP_3]),
        _rules([(s, "", (lambda e: f"(right({e}, 1) IN ('s', 't') AND {_many(e)})") if s == "ion" else _many)
                for s in stem.STEP_4]),
        f"CASE WHEN suffix(w, 'e') AND ({_many(s1)} OR ({_some(s1)} AND NOT {_closed(s1)})) THEN {s1} ELSE w END",
        f"CASE WHEN suffix(w, 'll') AND {_many(s1)} THEN {s1} ELSE w END",
    ]
    ctes = [f"st0 AS (SELECT DISTINCT {column} AS word, lower({column}) AS low, lower({column}) AS w FROM {source})"]
    ctes += [f"st{i} AS (SELECT word, low, {step} AS w FROM st{i - 1})" for i, step in enumerate(steps, start=1)]
    ctes.append(f"""stems AS (SELECT word, CASE low {irregular} ELSE CASE WHEN length(low) <= 2 THEN low ELSE w END END AS stem
    FROM st{len(steps)})""")
    return ", ".join(ctes)
