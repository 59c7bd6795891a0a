"""DuckDB SQL of the queries that SQL can express."""

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = rf"""
WITH cut AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*', 0), {UPPER_LOWER}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM cut),
canon AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> ''
      AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid)(=.*)?$'))) AS kept FROM parts),
named AS (
  SELECT page_id, host, path, html, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(host, '^www[.]|:(80|443)$', '', 'g')
    || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM canon),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(lower(html), 'casino|pills|lottery|bonus') AND canonical IS NOT NULL),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
  (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
  coalesce((SELECT max_by(rules.verdict, length(rule_host || rule_path)) FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
   CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named
"""

OP4 = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM sizes WHERE size > 0)::DOUBLE
    / (SELECT count(*) FROM sizes WHERE size > 0) / size ELSE 0 END AS rate FROM sizes),
parts AS (SELECT source, greatest(ceil(rate / 8), 1)::INT AS n, rate / greatest(ceil(rate / 8), 1)::INT AS mean FROM rates),
terms AS (
  SELECT source, k, exp(-mean) * mean ** k / coalesce((SELECT product(i::DOUBLE) FROM range(1, k + 1) t(i)), 1) AS p
  FROM parts, range(0, 65) r(k)),
sums AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS bound FROM terms),
bounds AS (SELECT source, list(bound ORDER BY k) AS bounds FROM sums GROUP BY source),
draws AS (
  SELECT doc_id, text, lang, d.source, n_chars, bounds, n, list_sum(list_transform(range(1, n + 1), lambda part:
    len(list_filter(bounds, lambda b: b < (('0x' || substr(md5('0:' || part || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))
      ::BIGINT + 0.5::DOUBLE) / 4503599627370496)))) AS number
  FROM documents d JOIN parts ON d.source IS NOT DISTINCT FROM parts.source JOIN bounds ON d.source IS NOT DISTINCT FROM bounds.source)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
  md5('order 0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS order_key
FROM (SELECT *, unnest(range(1, number::BIGINT + 1)) AS copy FROM draws)
"""

#: The checksum's table has one entry per byte value; every bit step is a shift and, for an odd value, a XOR.
_STEP = "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

OP10 = f"""
WITH sized AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, coalesce(text, '') AS text FROM documents),
crc AS (SELECT list(list_reduce(range(0, 8)::BIGINT[], {_STEP}, byte) ORDER BY byte) AS steps FROM range(0, 256) t(byte)),
sums AS (
  SELECT text, xor(list_reduce(
      list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT text FROM sized), crc),
placed AS (
  SELECT doc_id, size, text,
    arg_max(s, md5('0:' || s || ':' || coalesce(doc_id::VARCHAR, 'null'))) FILTER (s < 16) AS shard,
    arg_max(s, md5('0:' || s || ':' || coalesce(doc_id::VARCHAR, 'null'))) AS grown_shard
  FROM sized, range(0, 17) t(s) GROUP BY doc_id, size, text)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, 'null')), doc_id) - 1 AS slot,
  grown_shard::INT AS grown_shard
FROM placed JOIN sums USING (text)
"""

OP6 = f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {UPPER_LOWER}), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 90 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE walk AS (SELECT doc_id AS node, doc_id AS seen FROM sizes UNION SELECT node, b FROM walk JOIN edges ON a = seen)
  SELECT node, min(seen) AS least FROM walk GROUP BY node)
SELECT doc_id, n AS n_shingles, least AS component_id FROM sizes JOIN reach ON node = doc_id
"""

OP9 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(s) WHERE len(w) > 0),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) t(s)),
hits AS (SELECT doc_id, s, windows.n, item_id FROM places JOIN windows USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Cheapest edits from the end: for each of the four states (start, after s, u, a) the pair of cost and audit, of which the
#: least is kept; an edit in front of two audits keeps their order. A row may have up to two inserted ones before it.
def _pair(cost: str, letter: str, rest: str) -> str:
    return f"struct_pack(c := {cost} + {rest}.c, a := '{letter}' || {rest}.a)"


def _state_costs() -> str:
    follow, legal = [3, 3, 4, 3], [("s", 2, "u", 3), ("u", 3), ("a", 4), ("u", 3)]
    rows = []
    for state in range(4):
        keep = " ".join(f"WHEN '{legal[state][at]}' THEN " + _pair("3 * x.cut", "K", f"y[{legal[state][at + 1]}]") for at in range(0, len(legal[state]), 2))
        own = [_pair("4", "D", f"y[{state + 1}]"), f"CASE WHEN NOT x.must THEN CASE x.i {keep} END END",
               f"CASE WHEN NOT x.must THEN {_pair('3 + 3 * x.cut', 'R', f'y[{follow[state]}]')} END"]
        rows.append(f"list_min([{', '.join(own)}])")
    return ", ".join(rows)


def _inserted(b: str) -> str:
    """The four pairs where up to two rows may be inserted first."""
    two = {state: f"list_min([{b}[{state}], {_pair('3', 'I', f'{b}[{7 - state}]')}])" for state in (3, 4)}
    first = [f"list_min([{b}[{state}], {_pair('3', 'I', two[3])}])" for state in (1, 2)]
    return f"[{first[0]}, {first[1]}, {two[3]}, {two[4]}]"


_END = "[struct_pack(c := 0, a := ''), struct_pack(c := 6, a := 'II'), struct_pack(c := 3, a := 'I'), struct_pack(c := 0, a := '')]"
_WALK = """lambda z, x: struct_pack(s := CASE WHEN x.e = 'D' THEN z.s WHEN x.e = 'K' THEN x.i WHEN z.s = 'u' THEN 'a' ELSE 'u' END,
  lines := CASE WHEN x.e = 'D' THEN z.lines WHEN x.e = 'K' THEN list_append(z.lines, x.role || ':' || x.text)
    ELSE list_append(z.lines, CASE WHEN z.s = 'u' THEN 'assistant:' ELSE 'user:' END || x.text) END)"""

OP12 = rf"""
WITH crc AS (SELECT list(list_reduce(range(0, 8)::BIGINT[], {_STEP}, byte) ORDER BY byte) AS steps FROM range(0, 256) t(byte)),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hurt AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT),
    lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM named, crc),
rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hurt, range(0, 2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, copy) AS pos FROM (
    SELECT *, sha256(strlen(role) || ':' || role || text) AS digest, substr(role, 1, 1) AS i,
      regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS closing FROM rows)),
judged AS (
  SELECT *, closing = '' AS blank, closing <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate,
    lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM placed),
faults AS (SELECT *, NOT blank AND NOT duplicate AND closing NOT IN ('.', '!', '?') AS truncated FROM judged),
chats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list(struct_pack(i := i, must := blank OR duplicate, cut := truncated::INT, role := role, text := text) ORDER BY pos) AS said
  FROM faults GROUP BY conv_id),
solved AS (
  SELECT *, list_reduce(list_reverse(said), lambda y, x: list_reduce([[{_state_costs()}]], lambda u, b: {_inserted('b')}, y), {_END})[1] AS best FROM chats),
letters AS (
  SELECT conv_id, best.a AS audit, said, regexp_replace(best.a, 'I', '', 'g') AS own,
    list_filter(range(1, length(best.a) + 1), lambda k: substr(best.a, k, 1) <> 'I') AS places FROM solved),
walked AS (
  SELECT conv_id, list_reduce(list_transform(range(1, length(audit) + 1), lambda k: CASE WHEN substr(audit, k, 1) = 'I'
      THEN struct_pack(e := 'I', i := '', role := '', text := '')
      ELSE struct_pack(e := substr(audit, k, 1), i := said[list_position(places, k)].i, role := said[list_position(places, k)].role,
        text := said[list_position(places, k)].text) END),
    {_WALK}, struct_pack(s := '', lines := []::VARCHAR[])).lines AS lines FROM letters)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN walked w ON o.conv_id IS NOT DISTINCT FROM w.conv_id
"""

OP13 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
whole AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
tf AS (
  SELECT doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY doc_id, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
score AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN weight USING (term), whole GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
WHERE rank <= 50
"""

ORACLES = {"op2_url_filter": OP2, "op4_mixing": OP4, "op6_ngram_join": OP6, "op9_decontamination": OP9,
           "op10_sharding": OP10, "op12_conversation_repair": OP12, "op13_ranked_search": OP13}
