"""DuckDB twins of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

from .quality_rules import CLASS_SHARES, COMMON_WORDS, word_limit

#: Words of a text; null has none.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: A-Z alone in lower case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS c FROM w),
s AS (SELECT doc_id, unnest(range(1, c - 11)) AS p, ws FROM n WHERE c >= 13),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k FROM s),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
r AS (SELECT DISTINCT g.doc_id, unnest(range(p, p + 13)) AS q FROM g JOIN m USING (k) WHERE m.least < g.doc_id),
l AS (SELECT doc_id, list(q) AS qs FROM r GROUP BY doc_id),
x AS (SELECT n.doc_id, c, coalesce(len(qs), 0) AS gone, list_filter(ws, lambda v, i: NOT list_contains(coalesce(qs, []), i)) AS kept
      FROM n LEFT JOIN l USING (doc_id))
SELECT doc_id, c AS n_words, gone AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM x
""",
    "op4_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) AS size FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark) WHERE len(ws) > 0),
t AS (SELECT item_id, size, array_to_string(ws[p:p + size - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS p FROM b)),
z AS (SELECT DISTINCT size FROM t),
g AS (SELECT doc_id, size, p, array_to_string(ws[p:p + size - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS p FROM d, z)),
h AS (SELECT doc_id, item_id, size, p FROM g JOIN t USING (size, k)),
q AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS w FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR) ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN i USING (doc_id)
""",
}


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists."""
    part = "CASE WHEN {a}[i] > 0 THEN {a}[i]*log2({a}[i]/((" + p + ")[i]/2 + (" + q + ")[i]/2)) ELSE 0.0 END"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({q}) + 1), lambda i: {part.format(a=f'({p})')} + {part.format(a=f'({q})')}))/2, 0.0))"


def _quality() -> str:
    shares = "CASE lang " + " ".join(f"WHEN '{k}' THEN [[{', '.join(f'{x}::DOUBLE' for x in v)}]]" for k, v in CLASS_SHARES.items()) + f" ELSE [{', '.join('[' + ', '.join(f'{x}::DOUBLE' for x in v) + ']' for v in CLASS_SHARES.values())}] END"
    words = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items()) + " END"
    usual = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(f'{x / 1000}::DOUBLE' for x in v.values())}, {1 - sum(v.values()) / 1000}::DOUBLE]" for k, v in COMMON_WORDS.items()) + " END"
    limit = "CASE lang " + " ".join(f"WHEN '{k}' THEN {word_limit(v, 0.1)!r}::DOUBLE" for k, v in COMMON_WORDS.items()) + " END"
    count = "len(regexp_extract_all(t, '{}'))"
    return rf"""
WITH d AS (SELECT doc_id, lower(lang) AS lang, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, ws FROM d WHERE len(ws) >= 5),
k AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS k FROM g),
r AS (SELECT doc_id, p FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS w FROM r) GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count.format("[#*$%&|<>]")} AS n_symbols,
        len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, length(t) AS n_chars, {count.format("[A-Z]")} AS up, {count.format("[0-9]")} AS dg, {count.format("[.,;:!?''" + '"' + "()-]")} AS pt, {count.format(r"[@\[\]\\^_`{{}}~+=/]".replace("{{", "{").replace("}}", "}"))} AS ot
      FROM d LEFT JOIN c USING (doc_id)),
h AS (SELECT *, list_transform([word_chars - up - dg - pt - n_symbols - ot, up, dg, n_chars - word_chars, pt, n_symbols + ot], lambda x: CAST(x AS DOUBLE)/greatest(n_chars, 1)) AS s, {shares} AS refs, {usual} AS usual,
        list_transform({words}, lambda f: CAST(len(list_filter(ws, lambda x: lower(x) = f)) AS DOUBLE)/greatest(n_words, 1)) AS used FROM b),
j AS (SELECT *, list_min(list_transform(refs, lambda q: {_distance("s", "q")})) AS cd,
        CASE WHEN usual IS NOT NULL THEN {_distance("list_append(used, 1 - list_sum(used))", "usual")} END AS wd, n_words < 10 OR 100*n_repeat_words > 20*n_words AS base_failed FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ((word_chars >= 200 AND cd > 0.30) OR (n_words >= 100 AND coalesce(wd > {limit}, FALSE))) AS kept
FROM j
"""


SQL["op6_quality_rules"] = _quality()
SQL["op8_suffix_dedup"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, p, b[p:p + 49] AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS p FROM d WHERE octet_length(b) >= 50)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
r AS (SELECT doc_id, p FROM g JOIN m USING (k) WHERE least < doc_id),
o AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w <= 50 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
u AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM o),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM u GROUP BY doc_id, run),
n AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS gone FROM s GROUP BY doc_id),
f AS (SELECT doc_id, 1 AS x, (SELECT min(a) FROM s WHERE s.doc_id = d.doc_id) AS y FROM d
      UNION ALL SELECT doc_id, e, lead(a) OVER (PARTITION BY doc_id ORDER BY a) FROM s),
q AS (SELECT f.doc_id, string_agg(hex(b[x:coalesce(y - 1, octet_length(b))]), '' ORDER BY x) AS h FROM f JOIN d USING (doc_id) WHERE x <= coalesce(y - 1, octet_length(b)) GROUP BY f.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN q USING (doc_id)
"""
SQL["op10_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[p:p + 2], ' ') END AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100*c >= 85*(a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS least FROM w UNION SELECT l.y, r.least FROM r JOIN l ON l.x = r.x),
m AS (SELECT x AS doc_id, min(least) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

