"""DuckDB's SQL for the operators that SQL can express, each the plain way rather than the operator's.

Without a twin are those that need XXH64 (3), PNG (4), byte-pair encoding (5, 10), a segmentation of least cost (1),
zstandard (9), and the pipeline of these; they are tested against brute-force versions.
"""

from __future__ import annotations

from tidemark.llm import mixing, secrets


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Lengths of strings added up, 0 for none.
SUM = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"


def _spans(kind: str, pattern: str) -> str:
    """Rows (doc_id, n, run, s, e) of all matches, n from 1."""
    s = f"{SUM.format('g[1:n]')} + {SUM.format('f[1:n - 1]')}"
    return f"SELECT doc_id, '{kind}' AS kind, {secrets.KINDS.index(kind)} AS rank, n, f[n] AS run, CAST({s} AS BIGINT) AS s, CAST({s} + length(f[n]) AS BIGINT) AS e FROM (SELECT doc_id, f, g, unnest(range(1, len(f) + 1)) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {lit(pattern)}) AS f, string_split_regex(coalesce(text, ''), {lit(pattern)}) AS g FROM documents WHERE regexp_matches(text, {lit(pattern)})))"


def _found(level: int, kind: str, chars: str, bits: float, holds: str) -> str:
    """Spans of one class: windows of candidates by entropy, those at most a window apart as one."""
    w = secrets.WINDOW
    needs = " AND ".join(f"regexp_matches(run, '{x}')" for x in ("[0-9]", "[A-Z]", "[a-z]")) if holds == secrets.BOTH_CASES_AND_DIGIT else f"regexp_matches(run, {lit(holds)})"
    allow = f"{secrets.ALLOW_WORDS}|^(?:{secrets.BETWEEN})?{secrets.PART}(?:{secrets.BETWEEN}{secrets.PART})*$"
    clogc = f"list_sum(list_transform(map_values(list_histogram(string_split(substring(run, i, {w}), ''))), lambda c: {secrets.CLOGC}[CAST(c AS BIGINT) + 1]))"
    return f"""SELECT doc_id, '{kind}' AS kind, {secrets.KINDS.index(kind)} AS rank, min(a) AS s, max(a) + {w} AS e, {level} AS level
FROM (SELECT *, sum(CASE WHEN a - prev <= {w} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, n ORDER BY a) AS g
FROM (SELECT *, lag(a) OVER (PARTITION BY doc_id, n ORDER BY a) AS prev
FROM (SELECT doc_id, n, s + i - 1 AS a FROM (SELECT *, unnest(range(1, length(run) - {w - 2})) AS i FROM ({_spans(kind, f'[{chars}]{{{w},}}')}) WHERE {needs} AND NOT regexp_matches(run, {lit(allow)})) WHERE {clogc} <= {secrets.most_clogc(bits)})))
GROUP BY doc_id, n, g"""


def _joined(where: str = "") -> str:
    return f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e){where}, '')"


OP2 = f"""WITH assign AS ({_spans('assign', secrets.ASSIGN)}), kept AS (SELECT * FROM assign WHERE length(regexp_extract(run, {lit(secrets.ASSIGN)}, 2)) >= {secrets.ASSIGN_LEAST}),
base AS (SELECT doc_id, kind, rank, s, e, 0 AS level FROM kept UNION ALL SELECT doc_id, kind, rank, s, e, 0 FROM ({_spans('access', secrets.ACCESS)}) UNION ALL SELECT doc_id, kind, rank, s, e, 0 FROM ({_spans('hex', secrets.HEX)})),
hot AS (SELECT * FROM base UNION ALL {' UNION ALL '.join(f'({_found(i, *c)})' for i, c in enumerate(secrets.CLASSES, 1))}),
found AS (SELECT *, level = 0 AS is_base FROM hot h WHERE level = 0 OR NOT EXISTS (SELECT 1 FROM hot b WHERE b.doc_id = h.doc_id AND b.level < h.level AND b.s <= h.s AND h.e <= b.e))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256({_joined(' FILTER (is_base)')}) AS base_sha256, {_joined()} AS spans, count(*) FILTER (NOT is_base) AS n_added FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""

OP6 = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY p) AS c FROM win) WHERE c > 1), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM dup),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

OP7 = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM tri WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\\p{{L}}\\p{{M}}]+', '', 'g')) AS n_letters, len(list_distinct(regexp_split_to_array(lower(t), '[\\x20\\x09-\\x0D]+'))) AS n_distinct, len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_broken FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT * EXCLUDE (n_letters, n_distinct, n_broken), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines OR 5 * n_letters < 2 * word_chars OR 25 * n_distinct < n_words OR 2 * n_broken > n_lines) AS kept FROM m"""

_G = "[" + ", ".join(f"{g}::DOUBLE" for g in mixing.SLOPES) + f"][r % {len(mixing.SLOPES)} + 1]"
OP8 = f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substring(md5(concat_ws(':', doc_id, text)), 1, 15) AS BIGINT) AS h FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source), tw AS (SELECT *, {list(mixing.WEIGHTS)}[r % {len(mixing.WEIGHTS)} + 1] AS w, {_G} AS g FROM t),
f AS (SELECT *, row_number() OVER o AS k, CAST(3 * sum(s) OVER () - 4 * (sum(s) OVER o - s) AS BIGINT) AS left2, CAST(sum(w) OVER () - (sum(w) OVER o - w) AS BIGINT) AS rest FROM tw WINDOW o AS (ORDER BY s::DOUBLE / w, r ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, min(CASE WHEN w * left2 <= 4 * s * rest THEN k END) OVER () AS k0 FROM f),
targets AS (SELECT l.source, l.s, l.g, CASE WHEN l.k < l.k0 THEN CAST(2 * l.s AS DOUBLE) ELSE CAST(l.w * z.left2 AS DOUBLE) / CAST(2 * z.rest AS DOUBLE) END AS target FROM l JOIN l z ON z.k = l.k0),
p AS (SELECT d.doc_id, d.size, x.s AS source_size, x.target, x.g, CAST(round(x.target) AS BIGINT) AS want, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start FROM d JOIN targets x ON x.source IS NOT DISTINCT FROM d.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size * size + greatest(0, least(size, want - want // source_size * source_size - start)) ELSE 0 END AS taken FROM p),
u AS (SELECT *, CASE WHEN taken > 0 THEN least(1.0::DOUBLE, start / target) END AS u1, CASE WHEN taken > size THEN least(1.0::DOUBLE, (start + source_size) / target) END AS u2 FROM y)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, round(2 * u1 / ((1 - g) + sqrt((1 - g) * (1 - g) + 4 * g * u1)), 9) AS position, round(2 * u2 / ((1 - g) + sqrt((1 - g) * (1 - g) + 4 * g * u2)), 9) AS again_position FROM u"""

ORACLES = {"op2_secret_scan": OP2, "op6_substring_dedup": OP6, "op7_quality_rules": OP7, "op8_mixing": OP8}
