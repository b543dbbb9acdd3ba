"""DuckDB's SQL for the registered queries."""

from __future__ import annotations

from tidemark.functions import classify as C
from tidemark.functions import text as X
from tidemark.operators import context, sessions
from tidemark.plans.queries import EXCERPT_QUERY, FTS_QUERIES, HYBRID_QUERY, JOT_TS, QUERY, SCOPE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


TYPES = "['rule','decision','note','incident','pointer','excerpt','constraint']"
NODES = f"""nodes AS (
  SELECT *, type || ':' || ord AS id FROM (
    SELECT doc_id AS ord, {TYPES}[doc_id % 7 + 1] AS type, text, lang,
      '2024-' || lpad(CAST(doc_id // 28 % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS ts,
      CASE WHEN source = 'src0' THEN 'global' ELSE source END AS scope,
      [lang, ['security','ops','decision','risk','style'][doc_id % 5 + 1]] AS tags,
      doc_id * 7 % 100 AS priority,
      CASE WHEN doc_id % 5 <> 0 THEN 'doc://' || doc_id END AS source_path,
      list_transform(list_filter([
        CASE WHEN doc_id // 20 % 5 IN (2, 3) OR (doc_id // 20 % 5 = 4 AND doc_id % 8 = 0) THEN doc_id - 20 END,
        CASE WHEN doc_id // 20 % 5 = 2 AND doc_id % 4 = 0 THEN doc_id + 20 END,
        CASE WHEN doc_id // 20 % 5 = 0 THEN doc_id + 1000000000 END,
        CASE WHEN doc_id // 20 % 5 = 1 THEN doc_id - 1 END], lambda x: x >= 0), lambda x: {TYPES}[x % 7 + 1] || ':' || x) AS supersedes,
      '{{"note": "m' || doc_id % 13 || '"}}' AS meta_json
    FROM documents))"""
MESSAGES = "messages AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS ord, role, text, '2024-01-01T' || lpad(CAST(turn // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00Z' AS ts FROM conversations)"
WAL = "wal AS (SELECT event_id AS ord, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, 'user:' || user_id AS node_id, concat_ws(' ', event_type, props) AS text, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events)"
CHUNKS = "chunks AS (SELECT vec_id, 'vec:' || vec_id AS node_id, 'p' || label AS project_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 4 <> 0 THEN 'doc://' || vec_id END AS source_path FROM embeddings), q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0)"
BONUS = "type IN ('rule', 'decision', 'incident')"
NODE_TEXT = "concat_ws(' ', id, type, scope, text, array_to_string(tags, ' '), meta_json)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9_\\-]{{3,}}')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '^\\s+', ''), '\\s+$', '')"


def preview(x: str, n: int = 180) -> str:
    return f"substring(replace({strip(x)}, chr(10), ' '), 1, {n})"


def clip(x: str, n: int) -> str:
    s = strip(f"regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g')")
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE substring({s}, 1, {n - 3}) || '...' END"


def hits(haystack: str, needles: str) -> str:
    return f"len(list_filter({needles}, lambda t: contains(lower({haystack}), t)))"


QUERY_TOKENS = tokens(lit(QUERY))
POSTINGS = f"{NODES}, postings AS (SELECT DISTINCT unnest({tokens(NODE_TEXT)}) AS token, id AS node_id FROM nodes)"


def indexed(queries: str, most: int | None, weight: int) -> str:
    """scored(query_id, node_id, score, first_pos)."""
    cut = tokens("query") if most is None else f"{tokens('query')}[1:{most}]"
    return f"""{POSTINGS}, queries AS ({queries}), terms AS (SELECT query_id, token, min(pos) AS pos, count(*) AS times FROM (SELECT query_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM (SELECT query_id, {cut} AS ts FROM queries)) GROUP BY ALL),
scored AS (SELECT query_id, node_id, CAST(sum(times) * {weight} AS BIGINT) AS score, min(pos) AS first_pos FROM terms JOIN postings USING (token) GROUP BY ALL)"""


PROBES = "SELECT item_id AS query_id, text AS query FROM benchmark"
LOOKUP = "SELECT query_id, rank, s.node_id, s.score, n.ts FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, first_pos, node_id) AS rank FROM (SELECT scored.*, nodes.ts FROM scored JOIN nodes ON id = node_id)) s JOIN nodes n ON n.id = s.node_id"
SCAN = f"{NODES}, found AS (SELECT *, 2 * {hits(NODE_TEXT, QUERY_TOKENS + '[1:30]')} + CASE WHEN {BONUS} THEN 2 ELSE 0 END AS score FROM nodes)"
COSINE = "list_inner_product(e, qe) / (CASE WHEN sqrt(list_inner_product(e, e)) = 0 THEN 1 ELSE sqrt(list_inner_product(e, e)) END * CASE WHEN sqrt(list_inner_product(qe, qe)) = 0 THEN 1 ELSE sqrt(list_inner_product(qe, qe)) END)"


def hash_byte(x: str, i: str) -> str:
    return f"(CAST('0x' || substring(sha256({x}), 1 + 2 * (({i}) % 32), 2) AS INTEGER) / 127.5 - 1.0)"


def hash_vector(x: str) -> str:
    return f"list_transform(range(96), lambda i: {hash_byte(x, 'i')})"


def decay(score: str) -> str:
    age = "greatest(0, floor((epoch(TIMESTAMP '2025-01-01 00:00:00') - epoch(CAST(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP))) / 86400))"
    return f"({score}) * (0.5 + 0.5 * exp(-0.693 * {age} / 14.0))"


def hybrid(scope: str | None, k: int = 12, lexical_n: int = 50, vector_n: int = 20, penalty: float = 0.2) -> str:
    where = f"WHERE project_id = '{scope}'" if scope else ""
    bonus = 0.1 if scope else 0.0
    return f"""WITH {CHUNKS}, asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0),
vec AS (SELECT query_id, node_id, v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, node_id) AS r FROM (SELECT query_id, node_id, {COSINE} AS v FROM chunks, asked {where})) WHERE r <= {vector_n}),
within AS (SELECT c.node_id, {tokens('d.text')} AS ts FROM (SELECT * FROM chunks {where}) c JOIN documents d ON d.doc_id = c.vec_id), words AS (SELECT DISTINCT unnest({tokens(lit(HYBRID_QUERY))}) AS token),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM within), tf AS (SELECT node_id, dl, token, count(*) AS tf FROM (SELECT node_id, len(ts) AS dl, unnest(ts) AS token FROM within) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
lex AS (SELECT query_id, node_id FROM (SELECT node_id FROM tf JOIN words USING (token) JOIN df USING (token), stats GROUP BY node_id HAVING count(*) = (SELECT count(*) FROM words)
  ORDER BY round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) DESC, node_id LIMIT {lexical_n}), asked),
keys AS (SELECT coalesce(lex.query_id, vec.query_id) AS query_id, coalesce(lex.node_id, vec.node_id) AS node_id, lex.node_id IS NOT NULL AS l, v FROM lex FULL JOIN vec ON lex.node_id = vec.node_id AND lex.query_id = vec.query_id),
s AS (SELECT query_id, c.node_id, c.project_id, coalesce(v, 0.0) + CASE WHEN l THEN 0.05 ELSE 0.0 END + {bonus} - CASE WHEN source_path IS NOT NULL THEN 0.0 ELSE {penalty} END AS score FROM keys JOIN chunks c USING (node_id))
SELECT query_id, rank, node_id, project_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project_id DESC, node_id DESC) AS rank FROM s) WHERE rank <= {k}"""


def vector_search(scope: str | None) -> str:
    where = f"WHERE project_id = '{scope}'" if scope else ""
    return f"""WITH {CHUNKS}, asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0), scored AS (SELECT query_id, node_id, project_id, {COSINE} AS s FROM chunks, asked {where})
SELECT query_id, node_id, project_id, round(s, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS rank FROM scored) WHERE rank <= 20"""


def named(pairs, x: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({x}, {lit(p)}) THEN {lit(n)} END" for n, p in pairs)
    return f"list_filter([{cases}], lambda v: v IS NOT NULL)"


LOW = "lower(trim(coalesce(t, '')))"
SIGNALS = items(context.SIGNAL_TAGS)
CORE = items(context.CORE_TAGS)
BULLET = "trim('- (' || id || ') ' || text)"


def budget(chars: int, header: int, most: int | None) -> str:
    limit = chars // 6 + 1 if most is None else most
    return f"SELECT rank, id, priority, bullet, used FROM (SELECT row_number() OVER o AS rank, id, CAST(priority AS BIGINT) AS priority, {BULLET} AS bullet, CAST(sum(length({BULLET}) + 1) OVER (ORDER BY priority DESC, id, ord ROWS UNBOUNDED PRECEDING) + {header} AS BIGINT) AS used FROM rules WINDOW o AS (ORDER BY priority DESC, id, ord)) WHERE used <= {chars} AND rank <= {limit}"


HEADER = sum(len(x) + 1 for x in context.policy_header(900))
RULES = "SELECT conv_id * 1000 + turn AS ord, 'rule:' || (conv_id * 1000 + turn) AS id, 'rule' AS type, 'global' AS scope, text, [['security', 'ops', 'core', 'risk'][(conv_id * 1000 + turn) % 4 + 1]] AS tags, 2000 - length(text) AS priority FROM conversations"
CORE_RULES = f"SELECT * FROM short WHERE type = 'rule' AND scope = 'global' AND (list_has_any(tags, {CORE}) OR priority >= 50)"
TOPICAL = f"{MESSAGES}, topical AS (SELECT session, ord, role, ts, ['Memory index', 'rate limit', 'the loop', 'plain', 'changed JOBS'][(CAST(session AS BIGINT) + ord) % 5 + 1] || ' ' || text AS text FROM messages)"
TOPIC_LIST = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), {lit(k.lower())})" for k in words) + f" THEN {lit(topic)} END" for topic, words in C.TOPICS.items()) + "], lambda v: v IS NOT NULL)"
STOP = items(X.STOPWORDS)
WORDS4 = f"list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda w: NOT list_contains({STOP}, w))"


def blanked(x: str) -> str:
    for words in C.TOPICS.values():
        for k in words:
            x = f"replace({x}, {lit(k.lower())}, ' ')"
    return x


UNKNOWN_TOKENS = f"tokens1 AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all({blanked('lower(text)')}, '[a-z]{{4,}}'), lambda w: NOT list_contains({STOP}, w))) AS term FROM topical WHERE len({TOPIC_LIST}) = 0) GROUP BY ALL)"
UNKNOWN_PAIRS = f"pairs AS (SELECT term, count(*) AS n FROM (SELECT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {WORDS4} AS w FROM topical WHERE len({TOPIC_LIST}) = 0))) GROUP BY ALL)"
ETOKENS = f"list_distinct(regexp_extract_all({lit(EXCERPT_QUERY.lower())}, '[a-z0-9]{{3,}}'))[1:30]"
ANCHORS = f"""{MESSAGES}, scores AS (SELECT session, ord, ts, CAST((length(lower(text)) - length(replace(lower(text), {lit(EXCERPT_QUERY)}, ''))) // {len(EXCERPT_QUERY)} AS BIGINT) AS exact,
  CAST({hits('text', ETOKENS)} AS BIGINT) AS tok_hits, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END AS rb, least(20000, length(text)) AS lb FROM messages),
anchors AS (SELECT session, ord AS anchor_ord, exact, tok_hits FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY exact DESC, tok_hits DESC, rb DESC, lb DESC, ts DESC, ord) AS n FROM scores WHERE exact > 0 OR tok_hits > 0) WHERE n = 1)"""


def redacted(x: str) -> str:
    for pattern, to in X.REDACTIONS:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(to.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def any_of(words) -> str:
    return "(" + " OR ".join(f"contains(low, {lit(w)})" for w in words) + ")"


def begins(words) -> str:
    return "(" + " OR ".join(f"starts_with(low, {lit(w)})" for w in words) + ")"


SLUG = "regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
PROMOTION = f"""WITH raw AS (SELECT doc_id * 100000 + i - 1 AS ord, ['We decided ', 'Rule: ', 'database is not open ', 'We must ', '- errors_seen: ', 'never ', 'ralph: new rule ', '', '', ''][doc_id % 10 + 1] || ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
rows1 AS (SELECT ord, {strip('line')} AS text, lower({strip('line')}) AS low FROM raw),
kinds AS (SELECT ord, text, CASE WHEN {any_of(sessions.INCIDENTS)} THEN 'incident' WHEN contains(low, 'new rule') OR starts_with(low, 'rule:') THEN 'rule' WHEN starts_with(low, 'decision:') OR contains(low, 'we decided') THEN 'decision'
  WHEN {any_of(sessions.DECISION_WORDS)} THEN 'decision' WHEN {any_of(sessions.RULE_WORDS)} THEN 'rule' END AS type, CASE WHEN {any_of(('agentoffice', 'ralph'))} THEN 'agentoffice' ELSE 'global' END AS scope
  FROM rows1 WHERE text <> '' AND NOT {begins((*sessions.SKIP_PREFIXES, '```', '{', '['))} AND length(text) <= 320),
once AS (SELECT type, text, min(ord) AS ord, min_by(scope, ord) AS scope FROM kinds WHERE type IS NOT NULL GROUP BY ALL)
SELECT type, scope, type || ':' || substring(CASE WHEN {SLUG} = '' THEN 'item' ELSE {SLUG} END, 1, 48) AS id, text, ord FROM once ORDER BY list_position({items(sessions.TYPE_ORDER)}, type), length(text), ord LIMIT 40"""
def packed(pieces: str, joint: int, most: int = 800) -> str:
    """pieces(id, part, i, p), i from 1, packed in order up to ``most`` characters: packs(id, part, i, no)."""
    return f"""packs AS (SELECT id, part, i, length(p) AS used, 0 AS no FROM {pieces} WHERE i = 1
UNION ALL SELECT n.id, n.part, n.i, CASE WHEN k.used + {joint} + length(n.p) <= {most} THEN k.used + {joint} + length(n.p) ELSE length(n.p) END, CASE WHEN k.used + {joint} + length(n.p) <= {most} THEN k.no ELSE k.no + 1 END FROM packs k JOIN {pieces} n ON n.id = k.id AND n.part = k.part AND n.i = k.i + 1)"""


PARAGRAPHS = f"list_filter(list_transform(string_split({strip('text')}, chr(10)), lambda p: {strip('p')}), lambda p: p <> '')"
CHUNK_COLUMNS = "n.id AS node_id, 'c' || lpad(CAST(no AS VARCHAR), CAST(greatest(3, length(CAST(no AS VARCHAR))) AS INTEGER), '0') AS chunk_id, n.scope AS project_id, n.type AS node_type, coalesce(n.source_path, 'nodes.jsonl#' || n.id) AS source_path, n.ts"
CHUNKED = f"""WITH RECURSIVE {NODES}, paras AS (SELECT id, 0 AS part, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (SELECT id, {PARAGRAPHS} AS ps FROM nodes)),
{packed('paras', 1)}, groups AS (SELECT k.id, no AS part, string_agg(p, chr(10) ORDER BY k.i) AS t FROM packs k JOIN paras USING (id, part, i) GROUP BY k.id, no),
words AS (SELECT id, part, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS p FROM (SELECT id, part, list_filter(string_split(replace(t, chr(10), ' '), ' '), lambda w: w <> '') AS ws FROM groups WHERE length(t) > 800)),
{packed('words', 1).replace('packs', 'wpacks')},
pieces AS (SELECT id, part, 0 AS sub, t FROM groups WHERE length(t) <= 800 UNION ALL SELECT k.id, k.part, k.no, string_agg(p, ' ' ORDER BY k.i) FROM wpacks k JOIN words w ON w.id = k.id AND w.part = k.part AND w.i = k.i GROUP BY k.id, k.part, k.no),
numbered AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY part, sub) - 1 AS no FROM pieces)
SELECT {CHUNK_COLUMNS}, t AS text, sha256(t) AS text_sha256 FROM numbered JOIN nodes n ON n.id = numbered.id"""
CHUNKED_CUTTING = f"""WITH RECURSIVE {NODES}, paras AS (SELECT id, 0 AS part, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (SELECT id, list_transform({PARAGRAPHS}, lambda p: substring(p, 1, 800)) AS ps FROM nodes WHERE length({strip('text')}) > 800)),
{packed('paras', 1)}, pieces AS (SELECT k.id, no, string_agg(p, chr(10) ORDER BY k.i) AS t FROM packs k JOIN paras USING (id, part, i) GROUP BY k.id, no UNION ALL SELECT id, 0, {strip('text')} FROM nodes WHERE length({strip('text')}) BETWEEN 1 AND 800)
SELECT {CHUNK_COLUMNS}, sha256(t) AS text_sha256 FROM pieces JOIN nodes n ON n.id = pieces.id"""
FITTED = f"""WITH {ANCHORS}, placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS p FROM messages),
near AS (SELECT m.session, anchor_ord, m.ord, length(m.text) AS len, {hits('m.text', ETOKENS)} > 0 AS sig, CASE WHEN m.p > c.p THEN 2 * (m.p - c.p) - 1 ELSE 2 * (c.p - m.p) END AS step FROM anchors a JOIN placed c ON c.session = a.session AND c.ord = anchor_ord JOIN placed m ON m.session = c.session AND abs(m.p - c.p) <= 4),
run AS (SELECT *, sum(len) OVER (PARTITION BY session ORDER BY step) AS total FROM near),
lim AS (SELECT session, greatest(0, coalesce(min(step) FILTER (total > 1500) - 1, 8)) AS fits, min(step) FILTER (sig) AS signal FROM run GROUP BY session),
best AS (SELECT session, CASE WHEN least(6, fits) > least(2, fits) AND signal <= least(6, fits) THEN least(8, fits) ELSE least(2, fits) END AS last FROM lim)
SELECT session, anchor_ord, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n FROM run JOIN best USING (session) WHERE step <= last GROUP BY session, anchor_ord"""
PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS p FROM messages)"
LATEST = "latest AS (SELECT node_id, text, ts, op FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ord DESC) AS n FROM wal) WHERE n = 1 AND op <> 'delete')"
HITS = f"{NODES}, hits AS (SELECT id AS node_id, type AS node_type, scope AS project_id, priority / 100.0 AS score, ts FROM nodes)"

FTS = " UNION ALL ".join(f"SELECT {i} AS query_id, {lit(q)} AS query" for i, q in enumerate(FTS_QUERIES))
ORACLES = {
    "ledger_scan_valid": "SELECT event_id AS ord, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_type(props) = 'OBJECT'",
    "node_query_structured": f"WITH {NODES} SELECT id, ts, scope, {preview('text')} AS preview FROM nodes WHERE scope = '{SCOPE}' AND type = 'decision' ORDER BY ts DESC, ord LIMIT 20",
    "node_query_tags_all": f"WITH {NODES} SELECT id, ts, array_to_string(tags, ',') AS tags FROM nodes WHERE list_contains(tags, 'en') AND list_contains(tags, 'risk') ORDER BY ts DESC, ord LIMIT 20",
    "node_query_substring": f"WITH {NODES} SELECT id, ts FROM nodes WHERE contains(lower(concat_ws(chr(10), id, type, scope, text, meta_json)), 'token') ORDER BY ts DESC, ord LIMIT 20",
    "keyword_postings": f"WITH {POSTINGS} SELECT token, node_id FROM postings",
    "keyword_document_frequency": f"WITH {POSTINGS} SELECT token, count(*) AS df FROM postings GROUP BY token",
    "node_meta_last_wins": f"WITH {NODES} SELECT node_id, type, scope, ts, text_preview, tags FROM (SELECT type || ':' || ord % 300 AS node_id, type, scope, ts, {preview('text')} AS text_preview, array_to_string(tags, ',') AS tags, row_number() OVER (PARTITION BY type || ':' || ord % 300 ORDER BY ord DESC) AS n FROM nodes) WHERE n = 1",
    "lookup_indexed": f"WITH {indexed(PROBES, None, 1)} {LOOKUP} WHERE rank <= 10 AND {preview('n.text')} <> ''",
    "lookup_scan": f"WITH {NODES} SELECT id, score, ts FROM (SELECT *, {hits('concat_ws(chr(32), id, text, array_to_string(tags, chr(32)))', QUERY_TOKENS)} AS score FROM nodes) WHERE score > 0 ORDER BY score DESC, ts DESC, ord LIMIT 10",
    "heuristic_indexed": f"WITH {indexed(PROBES, 30, 2)} SELECT query_id, rank, node_id, scope, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, first_pos, node_id) AS rank FROM (SELECT query_id, node_id, scope, ts, first_pos, scored.score + CASE WHEN {BONUS} THEN 2 ELSE 0 END AS score FROM scored JOIN nodes ON id = node_id)) WHERE rank <= 8",
    "heuristic_scan": f"WITH {SCAN} SELECT id, type, scope, score, ts FROM found WHERE score > 0 ORDER BY score DESC, ts DESC, ord LIMIT 8",
    "recall_filtered_scoped": f"WITH {SCAN} SELECT id AS node_id, type AS node_type, scope AS project_id, CAST(score AS DOUBLE) AS score, ts, source_path, 'ledger_scan' AS method FROM found WHERE score > 0 AND scope = '{SCOPE}' ORDER BY found.score DESC, ts DESC, id LIMIT 8",
    "recall_strict_provenance": f"WITH {SCAN} SELECT id AS node_id, type AS node_type, scope AS project_id, CAST(score AS DOUBLE) AS score, source_path FROM found WHERE score > 0 AND source_path IS NOT NULL ORDER BY found.score DESC, ts DESC, id LIMIT 8",
    "vector_topk_exact": vector_search(None),
    "vector_topk_scoped": vector_search("p3"),
    "hash_embed": f"SELECT doc_id, CAST(96 AS BIGINT) AS dim, round(list_sum(e), 6) + 0.0 AS total, round(list_sum(list_transform(range(1, 97), lambda i: e[i] * i)), 6) + 0.0 AS weighted FROM (SELECT doc_id, {hash_vector('text')} AS e FROM documents)",
    "hash_embed_cosine": f"SELECT item_id AS query_id, round({COSINE}, 9) AS score FROM (SELECT item_id, {hash_vector('text')} AS e, {hash_vector(lit(QUERY))} AS qe FROM benchmark)",
    "int8_quantize_error": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, 127.0::DOUBLE / CASE WHEN list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) < 1e-8 THEN 1.0 ELSE list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) END AS s FROM embeddings),
w AS (SELECT vec_id, e, s, list_transform(e, lambda x: greatest(-127, least(127, CAST(round_even(x * s, 0) AS INTEGER)))) AS qv FROM v), d AS (SELECT vec_id, e, qv, list_transform(qv, lambda x: CAST(x AS DOUBLE) / s) AS d FROM w)
SELECT vec_id, CAST(list_sum(qv) AS BIGINT) AS q_sum, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - d[i]) * (e[i] - d[i]))) / len(e), 12) AS mse, round(list_inner_product(e, d) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(d, d))), 9) AS cosine FROM d""",
    "hybrid_rerank": hybrid("p3"),
    "hybrid_rerank_global": hybrid(None),
    "hybrid_low_level": hybrid("p3", 20, 30, 10, 0.0),
    "fts_candidates": f"""WITH {NODES}, mine AS (SELECT id AS node_id, {tokens('text')} AS ts FROM nodes WHERE scope = '{SCOPE}'), terms AS (SELECT DISTINCT query_id, unnest({tokens('query')}) AS token FROM ({FTS})), asked AS (SELECT query_id, count(*) AS n_asked FROM terms GROUP BY query_id),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM mine), tf AS (SELECT node_id, dl, token, count(*) AS tf FROM (SELECT node_id, len(ts) AS dl, unnest(ts) AS token FROM mine) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT query_id, node_id, count(*) AS n_found, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM terms JOIN tf USING (token) JOIN df USING (token), stats GROUP BY query_id, node_id)
SELECT query_id, rank, node_id, score FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s JOIN asked USING (query_id) WHERE n_found = n_asked) WHERE rank <= 50""",
    "recall_cascade": f"""SELECT 'a' AS recall, node_id, round(score, 9) AS score, 'external' AS method FROM (SELECT id AS node_id, score / 100 AS score FROM (WITH {SCAN} SELECT id, score, ts, ord FROM found WHERE score > 0 ORDER BY found.score DESC, ts DESC, ord LIMIT 8))
UNION ALL SELECT 'b', node_id, round(score, 9), 'hybrid' FROM (SELECT * FROM ({hybrid('p3')}) WHERE query_id = 0 ORDER BY score DESC, node_id LIMIT 8)
UNION ALL SELECT 'c', node_id, score, 'ledger_scan' FROM (WITH {SCAN} SELECT id AS node_id, CAST(score AS DOUBLE) AS score FROM found WHERE score > 0 AND scope = '{SCOPE}' ORDER BY found.score DESC, ts DESC, id LIMIT 8)""",
    "hierarchical_summaries": f"""WITH {NODES}, hits AS (SELECT id AS node_id, type AS node_type, priority / 100.0 AS score, ts, CASE WHEN ord % 10 = 3 THEN 'mem/summaries/' || ord ELSE source_path END AS path FROM nodes), coarse AS (SELECT *, 'summary' AS stage FROM hits WHERE node_type = 'summary' OR contains(path, 'summaries') ORDER BY score DESC, node_id LIMIT 10),
refs AS (SELECT DISTINCT split_part(node_id, ':', 1) AS r FROM coarse), fine AS (SELECT *, 'chunk' AS stage FROM hits WHERE EXISTS (SELECT 1 FROM refs WHERE contains(node_id, r) OR contains(r, node_id)) ORDER BY score DESC, node_id LIMIT 16),
merged AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE stage WHEN 'summary' THEN 0 ELSE 1 END, score DESC) AS n FROM (SELECT * FROM coarse UNION ALL SELECT * FROM fine))
SELECT node_id, stage, round(s, 9) AS score FROM (SELECT node_id, stage, {decay('score')} AS s FROM merged WHERE n = 1 ORDER BY s DESC, CASE stage WHEN 'summary' THEN 0 ELSE 1 END, node_id LIMIT 8)""",
    "hierarchical_two_searches": f"""WITH {SCAN}, hits AS (SELECT id AS node_id, type AS node_type, CAST(score AS DOUBLE) AS score, ts, CASE WHEN ord % 10 = 3 THEN 'mem/summaries/' || ord ELSE source_path END AS path FROM found WHERE score > 0),
coarse AS (SELECT *, 'summary' AS stage FROM (SELECT * FROM hits ORDER BY score DESC, ts DESC, node_id LIMIT 20) WHERE contains(path, 'summaries') ORDER BY score DESC, node_id LIMIT 10), refs AS (SELECT DISTINCT split_part(node_id, ':', 1) AS r FROM (SELECT node_id FROM coarse ORDER BY score DESC, node_id LIMIT 5)),
fine AS (SELECT *, 'chunk' AS stage FROM (SELECT * FROM hits ORDER BY score DESC, ts DESC, node_id LIMIT 48) WHERE (SELECT count(*) FROM refs) = 0 OR EXISTS (SELECT 1 FROM refs WHERE contains(node_id, r) OR contains(r, node_id)) ORDER BY score DESC, node_id LIMIT 16),
merged AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE stage WHEN 'summary' THEN 0 ELSE 1 END, score DESC) AS n FROM (SELECT * FROM coarse UNION ALL SELECT * FROM fine))
SELECT node_id, stage, round(s, 9) AS score FROM (SELECT node_id, stage, {decay('score')} AS s FROM merged WHERE n = 1 ORDER BY s DESC, CASE stage WHEN 'summary' THEN 0 ELSE 1 END, node_id LIMIT 8)""",
    "bm25_topk": f"""WITH {NODES}, queries AS ({PROBES}), terms AS (SELECT DISTINCT query_id, unnest({tokens('query')}) AS token FROM queries),
docs AS (SELECT id AS node_id, {tokens('text')} AS ts FROM nodes), stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs),
tf AS (SELECT node_id, dl, token, count(*) AS tf FROM (SELECT node_id, len(ts) AS dl, unnest(ts) AS token FROM docs) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT query_id, node_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM terms JOIN tf USING (token) JOIN df USING (token), stats GROUP BY ALL)
SELECT query_id, rank, node_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s) WHERE rank <= 10""",
    "temporal_decay_rank": f"WITH {HITS} SELECT node_id, ts, round({decay('score')}, 9) AS score FROM hits ORDER BY round({decay('score')}, 9) DESC, node_id LIMIT 50",
    "hierarchical_merge": f"""WITH {HITS}, coarse AS (SELECT *, 'summary' AS stage FROM hits WHERE node_type IN ('decision', 'incident') AND project_id = 'src3' ORDER BY score DESC, node_id LIMIT 10),
refs AS (SELECT DISTINCT split_part(node_id, ':', 1) AS r FROM coarse), fine AS (SELECT *, 'chunk' AS stage FROM hits WHERE EXISTS (SELECT 1 FROM refs WHERE contains(node_id, r) OR contains(r, node_id)) ORDER BY score DESC, node_id LIMIT 16),
merged AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CASE stage WHEN 'summary' THEN 0 ELSE 1 END, score DESC) AS n FROM (SELECT * FROM coarse UNION ALL SELECT * FROM fine))
SELECT node_id, stage, round(s, 9) AS score FROM (SELECT node_id, stage, {decay('score')} AS s FROM merged WHERE n = 1 ORDER BY s DESC, CASE stage WHEN 'summary' THEN 0 ELSE 1 END, node_id LIMIT 8)""",
    "cascade_first_nonempty": f"WITH {SCAN} SELECT id AS node_id, CAST(score AS DOUBLE) AS score, 'scan' AS method FROM found WHERE score > 0 AND scope = '{SCOPE}' ORDER BY found.score DESC, ts DESC, id LIMIT 8",
    "session_context_top": f"""WITH RECURSIVE {NODES}, mine AS (SELECT * FROM nodes WHERE scope IN ('{SCOPE}', 'global')), edges AS (SELECT DISTINCT a.scope, a.id AS src, b.id AS dst FROM (SELECT scope, id, unnest(supersedes) AS t FROM mine) a JOIN mine b ON b.scope = a.scope AND b.id = a.t),
reach AS (SELECT scope, src, dst FROM edges UNION SELECT r.scope, r.src, e.dst FROM reach r JOIN edges e ON e.scope = r.scope AND e.src = r.dst), gone AS (SELECT DISTINCT scope, dst AS id FROM edges EXCEPT SELECT scope, src FROM reach WHERE src = dst)
SELECT id, type, scope, round(score, 6) AS score FROM (SELECT *, CASE type WHEN 'rule' THEN 10.0 WHEN 'decision' THEN 8.0 WHEN 'constraint' THEN 9.0 WHEN 'note' THEN CASE WHEN list_has_any(tags, {SIGNALS}) THEN 5.0 ELSE 1.0 END ELSE 1.0 END + 2 * len(list_intersect(tags, {SIGNALS})) + greatest(0.0, 5.0::DOUBLE - date_diff('day', CAST(substring(ts, 1, 10) AS DATE), DATE '2025-01-01') * 0.1::DOUBLE) AS score
FROM mine m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.scope = m.scope AND g.id = m.id) AND (type IN ('rule', 'decision', 'constraint') OR (type = 'note' AND list_has_any(tags, {SIGNALS}))) ORDER BY score DESC, ord LIMIT 5)""",
    "active_nodes_supersession": f"""WITH RECURSIVE {NODES}, edges AS (SELECT DISTINCT a.scope, a.id AS src, b.id AS dst FROM (SELECT scope, id, unnest(supersedes) AS t FROM nodes) a JOIN nodes b ON b.scope = a.scope AND b.id = a.t),
reach AS (SELECT scope, src, dst FROM edges UNION SELECT r.scope, r.src, e.dst FROM reach r JOIN edges e ON e.scope = r.scope AND e.src = r.dst), gone AS (SELECT DISTINCT scope, dst AS id FROM edges EXCEPT SELECT scope, src FROM reach WHERE src = dst)
SELECT ord, id, scope FROM nodes m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.scope = m.scope AND g.id = m.id)""",
    "policy_core_budget": f"WITH short AS ({RULES}), rules AS ({CORE_RULES}) {budget(900, HEADER, None)}",
    "triggered_rules_budget": f"""WITH short AS ({RULES}), core AS (SELECT id FROM (WITH rules AS ({CORE_RULES}) {budget(900, HEADER, None)})),
rules AS (SELECT * FROM short WHERE {strip('text')} <> '' AND list_has_any(tags, ['security']) AND id NOT IN (SELECT id FROM core)) {budget(1200, 0, 5)}""",
    "intent_gate": f"""WITH {MESSAGES} SELECT session, ord, array_to_string(list_sort({named([(i, p) for i, _, _, p in C.INTENTS], LOW)}), ',') AS intents,
array_to_string(list_sort(list_distinct(list_concat(['core'], {named([(b, p) for _, b, _, p in C.INTENTS], LOW)}))), ',') AS buckets, array_to_string({named([(n, p) for _, _, n, p in C.INTENTS if n], LOW)}, ',') AS notes FROM (SELECT *, role || ' ' || text AS t FROM messages)""",
    "bucket_classify": f"SELECT doc_id, array_to_string(list_sort(b), ',') AS buckets, array_to_string(list_filter([" + ", ".join(f"CASE WHEN list_contains(b, {lit(k)}) THEN {lit(v)} END" for k, v in C.BUCKET_TAGS.items()) + f"], lambda v: v IS NOT NULL), ',') AS tags FROM (SELECT doc_id, list_distinct(list_concat(['core'], {named(C.RULE_BUCKETS, LOW)})) AS b FROM (SELECT doc_id, text AS t FROM documents))",
    "runtime_policy_categories": f"SELECT doc_id, CASE WHEN len(p) = 0 THEN 'none' ELSE array_to_string(p[1:3], ',') END AS policies FROM (SELECT doc_id, {named(C.POLICIES, 'lower(text)')} AS p FROM documents)",
    "session_summary_counts": f"WITH {MESSAGES} SELECT session, count(*) AS lines, count(*) FILTER (role <> 'system') AS messages, count(*) FILTER (role <> 'system' AND {strip('text')} <> '') AS valid_messages, greatest(count(*) FILTER (role <> 'system' AND {strip('text')} <> '') - 3, 0) AS omitted, count(*) FILTER (role = 'system') AS tools, CAST(0 AS BIGINT) AS errors, min_by(ts, ord) AS first_ts, max_by(ts, ord) AS last_ts FROM messages GROUP BY session",
    "session_last_n": f"WITH {MESSAGES} SELECT session, ord, role, {clip('text', 80)} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord DESC) AS n FROM messages WHERE {strip('text')} <> '') WHERE n <= 3",
    "session_first_n": f"WITH {MESSAGES} SELECT session, ord, role, {clip('text', 80)} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS n FROM messages) WHERE n <= 2",
    "topic_match": f"WITH {TOPICAL} SELECT session, ord, unnest({TOPIC_LIST}) AS topic FROM topical",
    "topic_snippets_first_n": f"WITH {TOPICAL} SELECT session, topic, n, '[' || role || ' @ ' || ts || '] ' || {clip('text', 160)} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY session, topic ORDER BY ord) AS n FROM (SELECT *, unnest({TOPIC_LIST}) AS topic FROM topical)) WHERE n <= 2",
    "unknown_token_counts": f"WITH {TOPICAL}, {UNKNOWN_TOKENS} SELECT term, n FROM tokens1",
    "unknown_bigram_counts": f"WITH {TOPICAL}, {UNKNOWN_PAIRS} SELECT term, n FROM pairs",
    "auto_buckets": f"WITH {TOPICAL}, {UNKNOWN_TOKENS}, {UNKNOWN_PAIRS}, a AS (SELECT 0 AS r, term, n FROM pairs WHERE n >= 2 ORDER BY n DESC, term LIMIT 5), b AS (SELECT 1 AS r, term, n FROM tokens1 WHERE n >= 2 ORDER BY n DESC, term LIMIT 5), c AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT 'auto_' || replace(term, ' ', '_') AS bucket, term AS keyword, n AS hits FROM c WHERE r = (SELECT min(r) FROM c)",
    "excerpt_anchor": f"WITH {ANCHORS} SELECT session, anchor_ord, exact, tok_hits FROM anchors",
    "excerpt_window_fixed": f"WITH {ANCHORS}, placed AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS p FROM messages) SELECT m.session, anchor_ord, m.ord, m.role, CAST(length({redacted('m.text')}) AS BIGINT) AS n_chars FROM anchors JOIN placed c ON c.session = anchors.session AND c.ord = anchor_ord JOIN placed m ON m.session = c.session AND abs(m.p - c.p) <= 1",
    "redact_secrets": f"SELECT doc_id, text <> r AS changed, sha256(r) AS redacted_sha256 FROM (SELECT doc_id, text, {redacted('text')} AS r FROM documents)",
    "promotion_candidates": PROMOTION,
    "dedupe_on_write": f"WITH {NODES}, new AS (SELECT CASE WHEN ord % 11 = 0 THEN 'rule:0' ELSE 'new:' || ord END AS id, text FROM nodes WHERE ord % 2 = 1), old AS (SELECT id, text FROM nodes WHERE ord % 2 = 0) SELECT id, CASE WHEN id IN (SELECT id FROM old) THEN 'SKIP_DUPLICATE_ID' WHEN {strip('text')} <> '' AND {strip('text')} IN (SELECT {strip('text')} FROM old) THEN 'SKIP_DUPLICATE_FACT' ELSE 'write' END AS status FROM new",
    "jot_batch_dedupe": f"WITH b AS (SELECT doc_id AS i, text, row_number() OVER (PARTITION BY {strip('text')} ORDER BY doc_id) > 1 OR {strip('text')} IN (SELECT {strip('text')} FROM documents WHERE doc_id % 3 = 0) AS dup FROM documents WHERE doc_id % 3 <> 0) SELECT i, CASE WHEN dup THEN 'jot:alpha-dup' ELSE 'jot:alpha-' || substring(sha256('{JOT_TS}:' || i || ':' || text), 1, 8) END AS id, CASE WHEN dup THEN 'SKIP_DUPLICATE_FACT' ELSE 'write' END AS status FROM b",
    "jot_ids": f"SELECT item_id AS query_id, 'jot:alpha-' || substring(sha256('{JOT_TS}:' || text), 1, 8) AS id FROM benchmark",
    "wal_latest_state": f"WITH {WAL}, {LATEST} SELECT node_id, text, ts, op FROM latest",
    "wal_op_stats": f"WITH {WAL} SELECT count(*) FILTER (op = 'add') AS added, count(*) FILTER (op = 'delete') AS deleted, count(*) FILTER (op = 'update') AS updated, CAST(0 AS BIGINT) AS skipped FROM wal",
    "wal_streaming_merge": f"WITH {WAL}, {LATEST} SELECT node_id, text, ts, op FROM latest",
    "routing_entries": f"WITH {NODES} SELECT DISTINCT scope, 'node' AS kind, id AS value FROM nodes UNION SELECT DISTINCT scope, 'tag', unnest(tags) FROM nodes",
    "routing_index": f"WITH {NODES}, t AS (SELECT scope, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, count(DISTINCT id) AS n_nodes FROM nodes GROUP BY scope) SELECT scope, n_nodes, tags, 'projects/' || scope || '.md' AS dossier FROM t",
    "excerpt_gc_report": f"WITH {NODES}, x AS (SELECT *, ord % 3 <> 0 AND ord % 11 <> 0 AND ts < '2024-07-01T00:00:00Z' AS dead FROM nodes WHERE type = 'excerpt') SELECT count(*) FILTER (dead AND source_path IS NOT NULL) AS deleted, count(*) FILTER (NOT dead) AS kept, count(*) FILTER (dead AND source_path IS NULL) AS missing FROM x",
    "index_audit": f"WITH {NODES}, c AS (SELECT id AS node_id, CASE WHEN ord % 3 = 0 THEN 'tmp/x#' || id ELSE source_path END AS source_path, ts FROM nodes ORDER BY ts DESC, node_id LIMIT 50) SELECT node_id, source_path, CASE WHEN source_path IS NULL THEN 'no provenance' ELSE 'outside roots' END AS reason FROM c WHERE source_path IS NULL OR NOT starts_with(source_path, 'doc://')",
    "embedding_cache_split": "SELECT doc_id AS key, sha256(text) AS text_sha256, text IN (SELECT text FROM documents WHERE doc_id % 4 = 0) AS hit FROM documents",
    "render_node_markdown": f"WITH {NODES} SELECT type || '_' || ord || '.md' AS filename, concat_ws(chr(10), '---', 'id: ' || id, 'type: ' || type, 'scope: ' || scope, 'ts: ' || ts, 'tags: [' || array_to_string(tags, ', ') || ']', CASE WHEN priority <> 0 THEN 'priority: ' || priority END, 'source: ' || source_path, '---', '', '# ' || upper(type[1]) || type[2:] || ': ' || ord, '', CASE WHEN text <> '' THEN text || chr(10) END, '## Metadata', '- note: m' || ord % 13, '') AS markdown FROM nodes",
    "tag_validation": f"WITH {NODES} SELECT id, array_to_string(list_sort(list_distinct(list_filter(tags, lambda t: t NOT IN ('decision', 'risk', 'en', 'de', 'style')))), ',') AS unknown, list_has_any(tags, ['decision', 'risk']) AS has_base, list_has_any(tags, ['decision', 'risk']) AND len(list_filter(tags, lambda t: t NOT IN ('decision', 'risk', 'en', 'de', 'style'))) = 0 AS valid FROM nodes",
    "retrieval_metrics": f"""WITH {indexed('SELECT ord AS query_id, text AS query FROM nodes WHERE ord % 20 = 0', None, 1)}, h AS ({LOOKUP} WHERE rank <= 3 AND {preview('n.text')} <> ''),
r AS (SELECT q.ord, coalesce(1.0::DOUBLE / min(rank), 0.0::DOUBLE) AS rr FROM (SELECT ord, id FROM nodes WHERE ord % 20 = 0) q LEFT JOIN h ON h.query_id = q.ord AND h.node_id = q.id GROUP BY q.ord) SELECT count(*) AS queries, round(avg(rr), 9) AS mrr, round(avg(CASE WHEN rr > 0 THEN 1.0 ELSE 0.0 END), 9) AS recall FROM r""",
    "excerpt_window_adaptive": FITTED,
    "chunk_paragraphs": CHUNKED,
    "chunk_provenance": CHUNKED_CUTTING,
    "latency_percentiles": "WITH o AS (SELECT CAST(o_totalprice AS DOUBLE) AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT 'median' AS name, v AS value FROM o WHERE i = round_even((n - 1) * 0.5, 0) UNION ALL SELECT 'p95', v FROM o WHERE i = round_even((n - 1) * 0.95, 0)",
    "source_wal_lines": f"WITH {WAL} SELECT op, node_id, text, ts FROM wal",
    "source_nested_sessions": f"WITH {MESSAGES} SELECT session || '-' || ord AS id, ts, role, trim(text) AS text FROM messages WHERE ord % 5 <> 4 AND trim(text) <> ''",
    "source_flat_sessions": f"WITH {MESSAGES} SELECT ts, CASE WHEN ord % 4 = 3 THEN 'tool' ELSE 'message' END AS kind, CASE WHEN ord % 4 = 3 THEN 'tool_call' ELSE role END AS role, text FROM messages WHERE role <> 'system'",
    "source_newest_log": f"WITH {MESSAGES} SELECT ts, role, text FROM messages WHERE CAST(session AS BIGINT) = (SELECT max(conv_id) FROM conversations)",
    "source_tail": f"WITH {MESSAGES} SELECT CASE WHEN length(line) > 200 THEN substring(line, 1, 200) || '…' ELSE line END AS line FROM (SELECT CAST(session AS BIGINT) * 1000 + ord AS o, replace(text, chr(10), ' ') AS line FROM messages WHERE trim(text) <> '' ORDER BY o DESC LIMIT 10)",
    "source_markdown": "WITH l AS (SELECT o, i, CASE o % 4 WHEN 0 THEN '- Hard rule: ' WHEN 1 THEN '- (rule:x' || o || ') ' WHEN 2 THEN '  - ' ELSE '' END || line AS line FROM (SELECT doc_id AS o, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) SELECT 'hard' AS kind, value FROM (SELECT trim(substring(trim(line), 13)) AS value FROM l WHERE starts_with(lower(trim(line)), '- hard rule:') AND length(trim(line)) > 12 ORDER BY o, i LIMIT 8) UNION ALL SELECT 'bullet', value FROM (SELECT trim(line) AS value FROM l WHERE starts_with(trim(line), '-') ORDER BY o, i LIMIT 8) UNION ALL SELECT DISTINCT 'id', 'rule:x' || o FROM l WHERE o % 4 = 1",
    "wal_state_with_ledger": f"WITH {WAL}, {LATEST} SELECT node_id, coalesce(d.text, latest.text) AS text, ts, op FROM latest LEFT JOIN (SELECT 'user:' || doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN source END AS text FROM documents) d ON d.id = node_id",
    "routing_index_dossiers": f"WITH {NODES}, t AS (SELECT scope, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, count(DISTINCT id) AS n_nodes FROM nodes GROUP BY scope) SELECT scope, n_nodes, tags, CASE scope WHEN 'src1' THEN 'notes/one.md' WHEN 'src9' THEN 'notes/nine.md' ELSE 'projects/' || scope || '.md' END AS dossier FROM t",
    "excerpt_text_budget": f"WITH {ANCHORS}, {PLACED}, w AS (SELECT m.session, m.ord, {redacted('m.text')} AS t FROM anchors a JOIN placed c ON c.session = a.session AND c.ord = anchor_ord JOIN placed m ON m.session = c.session AND abs(m.p - c.p) <= 2), b AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY session ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w) SELECT session, ord, sha256(CASE WHEN length(t) > 900 - before THEN rtrim(substring(t, 1, CAST(900 - before AS BIGINT))) || {lit(sessions.CUT_MARK)} ELSE t END) AS text_sha256 FROM b WHERE before < 900",
    "session_summary_text": f"""WITH {MESSAGES}, c AS (SELECT session, count(*) AS lines, count(*) FILTER (role <> 'system') AS m, greatest(count(*) FILTER (role <> 'system' AND {strip('text')} <> '') - 3, 0) AS o, count(*) FILTER (role = 'system') AS t FROM messages GROUP BY session),
l AS (SELECT session, string_agg('- **' || role || '**: ' || {clip('text', 80)}, chr(10) ORDER BY ord) AS body FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord DESC) AS n FROM messages WHERE role <> 'system' AND {strip('text')} <> '') WHERE n <= 3 GROUP BY session)
SELECT c.session, concat('# Session Summary: ', c.session, chr(10), chr(10), '## Metadata', chr(10), '- lines: ', lines, chr(10), '- messages_seen: ', m, chr(10), '- messages_omitted: ', o, chr(10), '- tool_events_seen: ', t, chr(10), '- errors_seen: 0', chr(10), chr(10), '## Messages (most recent sample)', chr(10), coalesce(body, '- (none captured)'), chr(10)) AS text FROM c LEFT JOIN l ON l.session = c.session""",
    "ledger_markdown": f"WITH {NODES} SELECT ord, concat('## ', id, chr(10), '- type: `', type, '`', chr(10), '- scope: `', scope, '`', chr(10), '- ts: `', ts, '`', chr(10), '- tags: ', array_to_string(tags, ', '), chr(10), chr(10), {strip('text')}, chr(10), chr(10), '---', chr(10)) AS section FROM nodes",
    "chunk_upsert": f"SELECT node_id, chunk_id, CASE WHEN o % 4 = 0 THEN 'new: ' || text ELSE text END AS text FROM (SELECT *, CAST(split_part(node_id, ':', 2) AS BIGINT) AS o FROM ({CHUNKED})) WHERE o % 3 <> 0 OR o % 4 = 0",
    "chunk_counts": f"SELECT project_id, count(DISTINCT node_id) AS n_nodes, count(*) AS n_chunks FROM ({CHUNKED}) WHERE CAST(split_part(node_id, ':', 2) AS BIGINT) % 3 <> 0 GROUP BY project_id",
    "chunk_delete": f"SELECT node_id, chunk_id, text FROM (SELECT *, CAST(split_part(node_id, ':', 2) AS BIGINT) AS o FROM ({CHUNKED})) WHERE o % 3 <> 0 AND o % 4 <> 0",
    "index_full_counts": f"WITH {POSTINGS} SELECT 'postings' AS part, count(*) AS n_rows, count(DISTINCT token) AS n_keys FROM postings UNION ALL SELECT 'node_meta', count(*), count(DISTINCT type) FROM nodes UNION ALL SELECT 'routing', count(*), count(DISTINCT (kind, value)) FROM (SELECT DISTINCT scope, 'node' AS kind, id AS value FROM nodes UNION SELECT DISTINCT scope, 'tag', unnest(tags) FROM nodes)",
    "index_fast_counts": f"WITH {NODES} SELECT id AS node_id, 'c000' AS chunk_id, CASE WHEN ord % 5 <> 0 THEN 'old' WHEN ord % 3 = 0 THEN type ELSE {clip('text', 140)} END AS text FROM nodes WHERE ord % 10 <> 0",
    "filename_ids": f"WITH {NODES} SELECT ord, type || '_' || ord || '.md' AS filename, id FROM nodes",
    "front_matter_stripped": f"WITH {NODES} SELECT ord, sha256(type || chr(10) || scope) AS text_sha256 FROM nodes",
    "excerpt_nodes": f"""WITH {ANCHORS}, {PLACED}, w AS (SELECT m.session, m.ord, m.role, {redacted('m.text')} AS t FROM anchors a JOIN placed c ON c.session = a.session AND c.ord = anchor_ord JOIN placed m ON m.session = c.session AND abs(m.p - c.p) <= 1), b AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY session ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
c AS (SELECT session, ord, role, CASE WHEN length(t) > 600 - before THEN rtrim(substring(t, 1, CAST(600 - before AS BIGINT))) || {lit(sessions.CUT_MARK)} ELSE t END AS t FROM b WHERE before < 600)
SELECT 'excerpt:' || session AS id, 'excerpt' AS type, 'alpha' AS scope, sha256(string_agg('### ' || role || chr(10) || chr(10) || t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord)) AS text_sha256, '2025-01-31' AS expires_on FROM c WHERE CAST(session AS BIGINT) % 3 <> 0 GROUP BY session""",
    "topic_nodes": f"WITH {TOPICAL}, s AS (SELECT session, topic, n, '[' || role || ' @ ' || ts || '] ' || {clip('text', 160)} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY session, topic ORDER BY ord) AS n FROM (SELECT *, unnest({TOPIC_LIST}) AS topic FROM topical)) WHERE n <= 2) SELECT 'excerpt:alpha-' || topic || '-' || session || '-20250101' AS id, 'alpha' AS scope, 'session,' || topic AS tags, sha256(string_agg(snippet, chr(10) ORDER BY n)) AS text_sha256 FROM s GROUP BY session, topic",
    "merged_buckets": f"WITH {TOPICAL}, {UNKNOWN_TOKENS}, {UNKNOWN_PAIRS}, a AS (SELECT 0 AS r, term, n FROM pairs WHERE n >= 2 ORDER BY n DESC, term LIMIT 5), b AS (SELECT 1 AS r, term, n FROM tokens1 WHERE n >= 2 ORDER BY n DESC, term LIMIT 5), c AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT 'auto_' || replace(term, ' ', '_') AS bucket, term AS keyword, CASE WHEN n % 2 = 0 THEN 0 ELSE n END AS hits FROM c WHERE r = (SELECT min(r) FROM c)",
    "promotion_proposal": f"WITH found AS ({PROMOTION.replace('LIMIT 40', 'LIMIT 12')}) SELECT '# To be promoted, as of 2025-01-01T00:00:00Z' || chr(10) || chr(10) || 'From: `summary.md`' || chr(10) || chr(10) || '## Facts' || chr(10) || string_agg('- **' || type || '** `' || id || '` scope=`' || scope || '`' || chr(10) || '  - ' || text, chr(10) ORDER BY list_position({items(sessions.TYPE_ORDER)}, type), length(text), ord) || chr(10) AS text FROM found",
    "policy_document": f"WITH short AS ({RULES}), rules AS ({CORE_RULES}), kept AS ({budget(900, HEADER, None)}) SELECT {' || chr(10) || '.join(lit(x) for x in context.policy_header(900))} || chr(10) || string_agg(bullet, chr(10) ORDER BY rank) AS text FROM kept",
    "working_set_document": "WITH l AS (SELECT doc_id AS o, split_part(text, chr(10), 1) AS f FROM documents), a AS (SELECT string_agg('- ' || trim('r' || o || ' ' || f), chr(10) ORDER BY o) AS t FROM (SELECT * FROM l WHERE o % 5 = 2 ORDER BY o LIMIT 8)), b AS (SELECT string_agg(trim('- (rule:c' || o || ') ' || f), chr(10) ORDER BY o) AS t FROM (SELECT * FROM l WHERE o % 7 = 1 ORDER BY o LIMIT 8)), c AS (SELECT string_agg('- ' || CASE WHEN length(e) > 200 THEN substring(e, 1, 200) || '…' ELSE e END, chr(10) ORDER BY o) AS t FROM (SELECT o, 'event ' || o || ' ' || f AS e FROM l ORDER BY o DESC LIMIT 10)) SELECT concat('<!-- made by a job; changes are lost -->', chr(10), '# Working set', chr(10), chr(10), 'as of 2025-01-01T00:00:00Z, mode build', chr(10), chr(10), '## Hard rules', chr(10), a.t, chr(10), chr(10), '## Policy', chr(10), b.t, chr(10), chr(10), '## Blockers', chr(10), '- (ci) red', chr(10), '- plain', chr(10), chr(10), '## Last events', chr(10), c.t, chr(10)) AS text FROM a, b, c",
    "epoch_millis_iso": "SELECT event_id, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_milliseconds(event_id * 100003017), '%Y-%m-%dT%H:%M:%S') AS iso FROM events",
    "unit_vectors": "SELECT vec_id, round(list_inner_product(u, u), 9) AS norm2, round(list_sum(u), 9) AS total FROM (SELECT vec_id, list_transform(e, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings))",
    "stream_distinct": f"WITH {WAL} SELECT DISTINCT op, node_id FROM wal",
    "changed_logs": "SELECT 'log-' || doc_id AS path, length(text) AS size FROM documents WHERE length(text) % 3 = 0 OR length(text) % 5 = 0",
    "cached_embeddings": f"SELECT doc_id AS key, text IN (SELECT text FROM documents WHERE doc_id % 4 = 0) AS hit, round(list_sum({hash_vector('text')}), 6) + 0.0 AS total FROM documents",
    "external_min_score": f"""WITH {NODES}, queries AS (SELECT 0 AS query_id, {lit(QUERY)} AS query), terms AS (SELECT DISTINCT query_id, unnest({tokens('query')}) AS token FROM queries),
docs AS (SELECT id AS node_id, {tokens('text')} AS ts FROM nodes), stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs),
tf AS (SELECT node_id, dl, token, count(*) AS tf FROM (SELECT node_id, len(ts) AS dl, unnest(ts) AS token FROM docs) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
s AS (SELECT query_id, node_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM terms JOIN tf USING (token) JOIN df USING (token), stats GROUP BY ALL)
SELECT node_id, round(score / (score + 1.5), 6) AS score, substring(text, 1, 180) AS preview, 'external' AS method FROM (SELECT * FROM s ORDER BY score DESC, node_id LIMIT 16) JOIN nodes ON id = node_id WHERE round(score / (score + 1.5), 6) >= 0.45""",
    "node_previews": f"WITH {NODES} SELECT ord, {preview('text', 140)} AS short, {preview('text', 160)} AS middle FROM nodes",
    "ann_ivf_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "maintenance_report": f"WITH {NODES} SELECT 'rendered' AS part, count(DISTINCT id) AS n FROM nodes UNION ALL SELECT 'policy', 1 UNION ALL SELECT 'expired', count(*) FILTER (ord % 3 <> 0 AND ord % 11 <> 0 AND ts < '2024-07-01T00:00:00Z' AND source_path IS NOT NULL) FROM nodes WHERE type = 'excerpt' UNION ALL SELECT 'audit', count(*) FROM (SELECT * FROM nodes ORDER BY ts DESC, id LIMIT 50) WHERE source_path IS NULL",
    "working_set": f"WITH {NODES} SELECT id, ts, {preview('text', 40)} AS text FROM nodes WHERE ord % 9 = 0 ORDER BY ord DESC LIMIT 20",
}
ORACLES["lookup_stored"] = ORACLES["lookup_indexed"]
