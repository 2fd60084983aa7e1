"""DuckDB SQL of the corpus queries that SQL can express, over the same tables."""

from __future__ import annotations

from assayer.llm.language import SIZE
from assayer.llm.quality import RATIOS, RULES, STOP_WORDS

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _broken() -> str:
    """Whether a row breaks a rule of the threshold table."""
    parts = []
    for rule in RULES:
        value = rule.feature
        if value in RATIOS:
            part, base = RATIOS[value]
            value = f"{part} / nullif({base}, 0)"
        if rule.low is not None:
            parts.append(f"coalesce({value} < {rule.low}, false)")
        if rule.high is not None:
            parts.append(f"coalesce({value} > {rule.high}, false)")
    return " OR ".join(parts)


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END"
    byte = f"list_reduce([xor(c, b)] || range(0, 8), lambda v, i: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {codes}, lambda c, b: {byte}), 4294967295)"


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format(text="t")} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT r, i, words[i:i + 4] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
often AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM windows JOIN often USING (r, g), range(0, 5) AS s(o) GROUP BY r),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop_words,
        coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest_word_chars
      FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ({_broken()}) AS kept
FROM f
"""

REPEATS = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT r, doc_id, i, words[i:i + 12] AS g FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
gone AS (SELECT DISTINCT r, i + o AS i FROM windows JOIN firsts USING (g), range(0, 13) AS s(o) WHERE least < doc_id),
words AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
        ELSE list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""

TRIE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, role, text, CAST(len({_WORDS.format(text="text")}) AS BIGINT) AS words, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, left(role, 32), left(text, 32), md5(concat(length(role), ':', role, text))) AS place FROM t),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t),
whole AS (SELECT c.conv_id, 0 AS part, p.place, p.role, p.text, p.words FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
  UNION ALL SELECT c.conv_id, 1, p.place, p.role, p.text, p.words FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h),
paths AS (SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, place) FILTER (words IS NOT NULL), []) AS path,
    coalesce(list(words ORDER BY part, place) FILTER (words IS NOT NULL), []) AS words FROM convs LEFT JOIN whole USING (conv_id) GROUP BY conv_id),
prefixes AS (SELECT conv_id, len(path) AS total, words, path[1:d] AS path, d FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN d > 0 THEN words[d] ELSE 0 END) AS words,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = d), '') AS ends FROM prefixes GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (SELECT n.path[1:u] AS path, u AS d, sum((n_convs - 1) * words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM nodes) n LEFT JOIN kids k ON k.path = n.path AND k.d = n.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256, CASE WHEN n.d > 0 THEN n.words END AS last_words
FROM nodes n JOIN below b ON b.path = n.path AND b.d = n.d LEFT JOIN kids k ON k.path = n.path AND k.d = n.d
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > least.least THEN 'E' ELSE '' END AS fails
  FROM d JOIN least USING (t) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x(c) AS (SELECT unnest(['A', 'B', 'C', 'D', 'E'])),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier, filter_order[1:step] AS upto
  FROM orders, range(1, 6) AS s(step)),
r AS (SELECT part, filter_order, step, filter,
    sum(n) FILTER (translate(fails, upto, '') = fails) AS kept,
    sum(n) FILTER (contains(fails, filter) AND translate(fails, earlier, '') = fails) AS removed,
    sum(n) FILTER (contains(fails, filter) AND translate(fails, earlier, '') <> fails) AS redundant,
    sum(n) FILTER (fails = filter) AS unique_fails,
    sum(good) FILTER (contains(fails, filter) AND translate(fails, earlier, '') = fails) AS good_lost,
    sum(toxic) FILTER (contains(fails, filter) AND translate(fails, earlier, '') = fails) AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
FROM r
"""

LANGUAGE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce({crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0, false) AS held_out,
    regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS words FROM documents),
w AS (SELECT r, ' ' || unnest(words) || ' ' AS w FROM d),
g AS (SELECT r, w[i:i + s - 1] AS g FROM w, range(1, 4) AS z(s), unnest(range(1, length(w) - s + 2)) AS y(i)),
own AS (SELECT r, g, count(*) AS n FROM g WHERE g <> ' ' GROUP BY r, g),
profile AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS rank
  FROM own JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY rank < {SIZE}),
mine AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, length(g), g) - 1 AS rank FROM own QUALIFY rank < {SIZE}),
hit AS (SELECT r, p.lang, sum(abs(p.rank - mine.rank) - {SIZE}) AS gain FROM mine JOIN profile p USING (g) GROUP BY r, p.lang),
near AS (SELECT m.r, l.lang, m.n * {SIZE} + coalesce(gain, 0) AS distance, m.n * {SIZE} AS most
  FROM (SELECT r, count(*) AS n FROM mine GROUP BY r) m, (SELECT DISTINCT lang FROM profile) l LEFT JOIN hit ON hit.r = m.r AND hit.lang = l.lang
  QUALIFY row_number() OVER (PARTITION BY m.r ORDER BY distance, l.lang) = 1)
SELECT doc_id, held_out, coalesce(near.lang, 'und') AS lang_pred, coalesce(1 - CAST(distance AS DOUBLE) / most, 0) AS score
FROM d LEFT JOIN near USING (r)
"""
