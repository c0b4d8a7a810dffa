"""The SQL of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from tessera.functions.formulas import constants, enumerate_formulas, rpn

_UNIT = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_EVENT_OPS = """ops AS (SELECT event_id AS seq, event_type IN ('click', 'view', 'signup') AS adds,
  's' || (json_extract_string(props, '$.k')::BIGINT % 10)::VARCHAR AS name, user_id::VARCHAR AS atom FROM events)"""
_MEMBERS = f"""WITH {_EVENT_OPS}, last AS (SELECT name, atom, arg_max(adds, seq) AS adds FROM ops GROUP BY ALL)"""
_ORDERED = "SELECT DISTINCT o_custkey AS l, o_orderkey AS r FROM orders"
_HOLDS = 'SELECT DISTINCT l_orderkey AS "left", l_partkey AS "right" FROM lineitem'
_SUPPLIES = 'SELECT DISTINCT l_suppkey AS "left", l_partkey AS "right" FROM lineitem'
_DOCS = "docs AS (SELECT concat_ws('/', source, doc_id) AS path, encode(text) AS content, doc_id FROM documents)"


def _chunked(source: str) -> str:
    """Chunks of 800 bytes in steps of 700 of ``(path, content)``."""
    return f"""SELECT path, k * 700 AS "offset", least(800, octet_length(content) - k * 700) AS length, content
  FROM (SELECT path, content, unnest(range(0, CASE WHEN octet_length(content) = 0 THEN 0 WHEN octet_length(content) <= 800 THEN 1
    ELSE (octet_length(content) - 800 + 699) // 700 + 1 END)) AS k FROM {source})"""


_BEFORE_AFTER = f"""WITH {_DOCS}, before AS (SELECT path, content FROM docs WHERE doc_id % 10 <> 0),
 after AS (SELECT path, CASE WHEN doc_id % 10 = 3 THEN content || encode(' edited') ELSE content END AS content FROM docs WHERE doc_id % 10 <> 5),
 plan AS (SELECT path, CASE WHEN a.content IS NULL THEN 'deleted' WHEN b.content IS NULL THEN 'added' ELSE 'changed' END AS action
  FROM before b FULL JOIN after a USING (path) WHERE a.content IS NULL OR b.content IS NULL OR a.content <> b.content),
 first AS (SELECT row_number() OVER (ORDER BY path, "offset") - 1 AS doc_id, path, "offset", length FROM ({_chunked("before")})),
 second AS (SELECT (SELECT count(*) FROM first) + row_number() OVER (ORDER BY action = 'added', path, "offset") - 1 AS doc_id, path, "offset", length
  FROM ({_chunked("(SELECT a.path, a.content FROM after a JOIN plan p USING (path) WHERE p.action <> 'deleted')")}) JOIN plan USING (path))"""
_LINES = """lines AS (SELECT path, line_no, line FROM (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no, len(string_split(text, chr(10))) AS n FROM documents)
  WHERE line_no < n OR line <> '')"""
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOG = """log AS (SELECT event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS "offset", props AS payload FROM events),
 seg AS (SELECT *, "offset" // 1000 * 1000 AS segment_base FROM log)"""
_GROUPS = "off AS (SELECT 'g' || (user_id % 5)::VARCHAR AS \"group\", event_type AS topic, arg_max(event_id % 997, event_id) AS \"offset\" FROM events GROUP BY ALL)"
_COMMANDS = """cmds AS (SELECT event_id AS seq, user_id::VARCHAR AS key,
  CASE event_type WHEN 'click' THEN 'INCR' WHEN 'view' THEN 'DECR' WHEN 'error' THEN 'DEL' ELSE 'SET' END AS cmd,
  CASE event_type WHEN 'signup' THEN json_extract_string(props, '$.k') WHEN 'purchase' THEN 'p' || json_extract_string(props, '$.k') END AS value FROM events),
 reset AS (SELECT key, max(seq) AS at, arg_max(cmd, seq) AS cmd, arg_max(value, seq) AS start FROM cmds WHERE cmd IN ('SET', 'DEL') GROUP BY key),
 moved AS (SELECT c.key, sum(CASE c.cmd WHEN 'INCR' THEN 1 ELSE -1 END)::BIGINT AS n FROM cmds c LEFT JOIN reset r USING (key)
  WHERE c.cmd IN ('INCR', 'DECR') AND (r.at IS NULL OR c.seq > r.at) GROUP BY c.key),
 kv AS (SELECT key, CASE WHEN s THEN 'string' ELSE 'int' END AS kind,
   CASE WHEN NOT s THEN coalesce(CASE WHEN cmd = 'SET' THEN try_cast(start AS BIGINT) END, 0) + coalesce(n, 0) END AS int_value,
   CASE WHEN s THEN start END AS str_value
  FROM (SELECT coalesce(r.key, m.key) AS key, r.cmd, r.start, m.n, coalesce(r.cmd = 'SET' AND try_cast(r.start AS BIGINT) IS NULL, false) AS s
   FROM reset r FULL JOIN moved m USING (key)) WHERE cmd = 'SET' OR n IS NOT NULL)"""
_POINTS = 'points AS (SELECT l_returnflag AS "group", l_discount + 0.1 AS x, exp(l_discount + 0.1) + l_tax AS y FROM lineitem)'
_SCORES = f"""WITH {_POINTS}, p AS (SELECT "group", y, unnest([0, 1, 2, 3]) AS formula_id,
  unnest([exp(1.0) - ln(1.0), exp(x) - ln(1.0), exp(1.0) - ln(x), exp(x) - ln(x)]) AS p FROM points),
 scores AS (SELECT "group", formula_id::BIGINT AS formula_id, avg((p - y) * (p - y)) AS mse FROM p GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    "cosine_topk": f"SELECT a.vec_id AS doc_id, round({_UNIT}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {_UNIT} DESC, doc_id LIMIT 8",
    "cosine_topk_batch": f"""SELECT query_id, rank, doc_id, round(s, 6) AS score FROM (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, {_UNIT} AS s,
  row_number() OVER (PARTITION BY b.vec_id ORDER BY {_UNIT} DESC, a.vec_id)::INTEGER AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0) WHERE rank <= 10""",
    "cosine_topk_merged": f"SELECT a.vec_id AS doc_id, round({_UNIT}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id % 7 <> 0 ORDER BY {_UNIT} DESC, doc_id LIMIT 8",
    "unit_norms": """SELECT vec_id AS doc_id, round(sqrt(s), 6) AS norm, round(s, 6) AS square, round(1.0::DOUBLE, 4) AS unit_norm
  FROM (SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS s FROM embeddings)""",
    "contains_ids": "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)",
    "chunks": f"""WITH {_DOCS} SELECT row_number() OVER (ORDER BY path, "offset") - 1 AS doc_id, path, "offset", length,
  sha256(content[("offset" + 1):("offset" + length)]) AS sha256 FROM ({_chunked("docs")})""",
    "manifest_check": f"WITH {_DOCS} SELECT count(*) AS n, 0::BIGINT AS lo, count(*) - 1 AS hi, count(*) AS ids, sum(length)::BIGINT AS bytes FROM ({_chunked('docs')})",
    "file_state": f"""WITH {_DOCS}, c AS (SELECT path, row_number() OVER (ORDER BY path, "offset") - 1 AS id FROM ({_chunked("docs")}))
 SELECT path, sha256(content) AS hash, count(id) AS n_ids, min(id) AS first_id, max(id) AS last_id FROM docs LEFT JOIN c USING (path) GROUP BY ALL""",
    "refresh_plan": f"{_BEFORE_AFTER} SELECT path, action FROM plan",
    "refresh_counts": f"{_BEFORE_AFTER} SELECT action, count(*) AS n FROM plan GROUP BY action",
    "refresh_manifest": f"""{_BEFORE_AFTER} SELECT doc_id, path, "offset", length FROM first WHERE path NOT IN (SELECT path FROM plan)
 UNION ALL SELECT doc_id, path, "offset", length FROM second""",
    "refresh_superseded": f"{_BEFORE_AFTER} SELECT doc_id FROM first WHERE path IN (SELECT path FROM plan)",
    "search_docs": f"""SELECT h.doc_id, score, coalesce(concat_ws('/', source, d.doc_id), '') AS path, 0::BIGINT AS "offset",
  coalesce(left(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), 200), '') AS snippet
 FROM (SELECT a.vec_id AS doc_id, round({_UNIT}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {_UNIT} DESC, doc_id LIMIT 8) h
 LEFT JOIN documents d ON d.doc_id = h.doc_id""",
    "snippets": """SELECT doc_id, left(t, 60) AS snippet, substring(t, 11, 20) AS inner FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM documents)""",
    "set_union": "SELECT o_custkey::VARCHAR AS atom FROM orders UNION SELECT c_custkey::VARCHAR FROM customer",
    "set_intersect": "SELECT o_custkey::VARCHAR AS atom FROM orders INTERSECT SELECT c_custkey::VARCHAR FROM customer",
    "set_diff": "SELECT c_custkey::VARCHAR AS atom FROM customer EXCEPT SELECT o_custkey::VARCHAR FROM orders WHERE o_orderpriority LIKE '1%'",
    "set_subset": """WITH s AS (SELECT DISTINCT o_orderpriority AS name, o_custkey AS atom FROM orders)
 SELECT name, bool_and(atom IN (SELECT atom FROM s WHERE name LIKE '1%')) AS is_subset FROM s GROUP BY name UNION ALL SELECT 'none at all', true""",
    "set_member": f"{_MEMBERS}, n AS (SELECT DISTINCT name FROM ops WHERE adds) SELECT name, name IN (SELECT name FROM last WHERE adds AND atom = '7') AS is_member FROM n",
    "mutations": f"""{_MEMBERS} SELECT 's3' AS name, atom FROM last WHERE adds AND name = 's3' AND atom <> '7' UNION ALL SELECT 's3', 'new one' UNION ALL SELECT 'knows', 'b c'""",
    "facts_until_bad": f"""WITH {_EVENT_OPS}, last AS (SELECT name, atom, arg_max(adds, seq) AS adds FROM ops WHERE seq < 777 GROUP BY ALL)
 SELECT name AS "set", atom, 777::BIGINT AS bad FROM last WHERE adds""",
    "rel_compose": f'SELECT DISTINCT a.l AS "left", b."right" FROM ({_ORDERED}) a JOIN ({_HOLDS}) b ON a.r = b."left"',
    "rel_domain": "SELECT DISTINCT o_custkey AS atom FROM orders",
    "rel_range": "SELECT DISTINCT l_partkey AS atom FROM lineitem",
    "rel_inverse": 'SELECT DISTINCT l_partkey AS "left", l_suppkey AS "right" FROM lineitem',
    "rel_diff": f"{_HOLDS} EXCEPT {_SUPPLIES}",
    "rel_union": f"{_HOLDS} UNION {_SUPPLIES}",
    "rel_intersect": f"{_HOLDS} INTERSECT {_SUPPLIES}",
    "rel_select": "SELECT DISTINCT l_partkey AS atom FROM lineitem WHERE l_suppkey = 1",
    "transitive_closure": """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
 SELECT a.o_orderkey AS "left", b.o_orderkey AS "right" FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND (a.n - 1) // 8 = (b.n - 1) // 8 AND a.n < b.n""",
    "fold_ops": f'{_MEMBERS} SELECT name AS "set", atom FROM last WHERE adds',
    "sets_containing": f"{_MEMBERS} SELECT DISTINCT name AS \"set\" FROM last WHERE adds AND atom = '7'",
    "set_names": f"WITH {_EVENT_OPS} SELECT DISTINCT name FROM ops WHERE adds",
    "coverage_audit": """SELECT 'no urgent order' AS "check", c_custkey::VARCHAR AS atom FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')
 UNION SELECT 'nothing returned', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""",
    "grep_lines": f"WITH {_LINES} SELECT path, line_no, sha256(line) AS line_sha256 FROM lines WHERE contains(line, 'license')",
    "grep_lines_capped": f"WITH {_LINES} SELECT path, line_no, sha256(line) AS line_sha256 FROM lines WHERE contains(line, 'license') AND strlen(line) <= 8192",
    "grep_ci": f"WITH {_LINES} SELECT path, line_no, strlen(line)::BIGINT AS n_bytes FROM lines WHERE contains({_ASCII.format('line')}, 'license')",
    "grep_count": f"""WITH {_LINES} SELECT d.doc_id AS path, count(l.path) AS n FROM documents d LEFT JOIN (SELECT path FROM lines WHERE contains(line, 'the')) l
  ON l.path = d.doc_id GROUP BY d.doc_id""",
    "grep_files": "SELECT page_id AS path FROM pages WHERE contains(html, 'example.net')",
    "jsonl_field": "SELECT event_id AS path FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "jsonl_level": """SELECT event_id AS path FROM events WHERE event_type = 'error'
  AND contains(json_object('event_id', event_id, 'user_id', user_id, 'level', event_type, 'props', props)::VARCHAR, '1')""",
    "jsonl_count": "SELECT count(*) AS n FROM events WHERE event_type = 'purchase'",
    "topic_append": f"WITH {_LOG} SELECT topic, \"offset\", payload FROM log",
    "fetch": f"""WITH {_LOG} SELECT "offset", payload FROM (SELECT *, sum(strlen(payload)) OVER (ORDER BY "offset") AS s, row_number() OVER (ORDER BY "offset") AS n
  FROM log WHERE topic = 'click' AND "offset" >= 5) WHERE s <= 400 AND n <= 64""",
    "fetch_batch": f"""WITH {_LOG} SELECT "offset", payload FROM (SELECT *, sum(strlen(payload) + 8) OVER (ORDER BY "offset") AS s
  FROM seg WHERE topic = 'view' AND "offset" >= 950 AND segment_base = 0) WHERE s <= 4000""",
    "committed_offset": f'WITH {_GROUPS} SELECT "group", topic, "offset" FROM off',
    "read_from_group": f"""WITH {_LOG}, {_GROUPS} SELECT "offset", payload FROM log WHERE topic = 'purchase'
  AND "offset" >= coalesce((SELECT "offset" FROM off WHERE "group" = 'g1' AND topic = 'purchase'), 0)""",
    "committed_prefix": f'WITH {_LOG} SELECT topic, count(*) AS n, max("offset") AS last FROM seg WHERE segment_base % 5000 <> 0 GROUP BY topic',
    "fold_kv": f"WITH {_COMMANDS} SELECT key, kind, int_value, str_value FROM kv",
    "kv_errors": f"""WITH {_COMMANDS} SELECT seq, cmd, key FROM (SELECT seq, cmd, key,
  last_value(CASE WHEN cmd IN ('SET', 'DEL') THEN cmd || coalesce(value, '') END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM cmds)
  WHERE cmd IN ('INCR', 'DECR') AND p LIKE 'SETp%'""",
    "mget": f"""WITH {_COMMANDS} SELECT c_custkey::BIGINT AS position, c_custkey::VARCHAR AS key, coalesce(int_value::VARCHAR, str_value) AS value
  FROM customer LEFT JOIN kv ON kv.key = c_custkey::VARCHAR""",
    "kv_size": f"WITH {_COMMANDS} SELECT count(*) AS n FROM kv",
    "path_summary_": "SELECT count(*) AS files, count(DISTINCT source) AS dirs, sum(strlen(text))::BIGINT AS bytes FROM documents",
    "best_trade": """SELECT user_id, round(max(value - m), 6) AS best FROM (SELECT user_id, value,
  min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM events) GROUP BY user_id""",
    "max_run_sum": """WITH p AS (SELECT user_id, ts, event_id, sum(value - 100) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p FROM events)
 SELECT user_id, round(max(p - least(0, coalesce(m, 0))), 4) AS best FROM (SELECT user_id, p,
  min(p) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p) GROUP BY user_id""",
    "score_formulas": f'{_SCORES} SELECT "group", formula_id, round(mse, 6) AS mse FROM scores',
    "fit_formulas": f"""{_SCORES} SELECT "group", ['1 1 eml', 'x 1 eml', '1 x eml', 'x x eml'][arg_min(formula_id, (mse, formula_id)) + 1] AS rpn, round(min(mse), 6) AS mse
  FROM scores GROUP BY "group\"""",
    "baseline_mse": f'WITH {_POINTS} SELECT "group", round(var_pop(y), 6) AS mse FROM points GROUP BY "group"',
    "predict_formula": f"""WITH {_POINTS} SELECT "group", round(sum(CASE WHEN exp(1.0) - ln(x) > 0 THEN exp(x) - ln(exp(1.0) - ln(x)) ELSE 0 END), 3) AS total, 0::BIGINT AS bad FROM points GROUP BY "group\"""",
    "dense_document_ids": "SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS rank FROM documents",
}

ORACLE |= {
    "payload_vectors": ORACLE["cosine_topk"],
    "stream_vectors": ORACLE["cosine_topk"],
    "stream_topic": f"SELECT t.*, (SELECT count(*) FROM embeddings) AS n, 2::BIGINT AS batches FROM ({ORACLE['cosine_topk']}) t",
    "fetch_files": ORACLE["fetch"],
    "fetch_batch_files": ORACLE["fetch_batch"],
    "resume_files": ORACLE["read_from_group"],
    "vector_table": "SELECT count(*) AS n, max(len(embedding))::BIGINT AS dim, round(count(*)::DOUBLE, 2) AS norms FROM embeddings",
    "topic_segments": f"""WITH {_LOG} SELECT topic, "offset", segment_base, payload, true AS crc_ok FROM seg WHERE topic = 'click'""",
    "facts_dump_load": ORACLE["fold_ops"],
    "facts_over_files": ORACLE["facts_until_bad"].replace("777::BIGINT", "778::BIGINT"),  # events count from 0, lines from 1
    "file_lines": """SELECT row_number() OVER (ORDER BY doc_id, k) AS seq, sha256(line) AS sha256 FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)""",
    "relation_names": """SELECT 'of.' || lower(c_mktsegment) AS name, (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE count(*) END)::BIGINT AS n FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_mktsegment""",
    "stored_range": "SELECT DISTINCT c_nationkey::VARCHAR AS atom FROM customer",
    "stream_fold": ORACLE["fold_ops"],
    "stream_slice": ORACLE["jsonl_field"],
    "kv_dump_load": ORACLE["fold_kv"],
    "manifest_round_trip": f"""WITH {_DOCS} SELECT row_number() OVER (ORDER BY path, "offset") - 1 AS doc_id, path, "offset", length FROM ({_chunked("docs")})""",
    "state_round_trip": f"""WITH {_DOCS}, c AS (SELECT path, count(*) AS n FROM ({_chunked("docs")}) GROUP BY path)
 SELECT path, sha256(content) AS hash, coalesce(n, 0) AS n_ids FROM docs LEFT JOIN c USING (path) UNION ALL SELECT 'superseded', '', doc_id FROM documents WHERE doc_id % 100 = 0""",
    "index_report": f"""{_BEFORE_AFTER} SELECT "check", true AS ok, n::VARCHAR AS detail FROM (SELECT 'base vectors' AS "check", count(*) AS n FROM first
 UNION ALL SELECT 'files', count(*) FROM after UNION ALL SELECT 'superseded', count(*) FROM first WHERE path IN (SELECT path FROM plan)
 UNION ALL SELECT 'manifest', (SELECT count(*) FROM first WHERE path NOT IN (SELECT path FROM plan)) + (SELECT count(*) FROM second)
 UNION ALL SELECT 'delta vectors', count(*) FROM second UNION ALL SELECT 'merged', 0)""",
    "index_validation": """SELECT unnest(['dim', 'count', 'dense ids']) AS "check", true AS ok""",
    "merged_violations": """SELECT 'superseded' AS violation, doc_id FROM documents WHERE doc_id % 97 = 0
 UNION ALL SELECT 'no vector', doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "compacted": f"""{_BEFORE_AFTER} SELECT row_number() OVER (ORDER BY path, "offset") - 1 AS doc_id, path, "offset", length FROM ({_chunked("after")})""",
    "tagged_files": """SELECT doc_id::VARCHAR AS atom, 'files' AS "of" FROM documents WHERE lang = 'fr' UNION SELECT unnest([lang, source]), 'tags' FROM documents WHERE doc_id = 7""",
    "stored_domain": "SELECT 'customers' AS name, c_custkey::VARCHAR AS atom FROM customer UNION SELECT 'has 1', c_custkey::VARCHAR FROM customer WHERE c_nationkey = 1",
    "set_members": f"{_MEMBERS} SELECT atom FROM last WHERE adds AND name = 's3'",
    "rel_select_second": "SELECT DISTINCT l_suppkey AS atom FROM lineitem WHERE l_partkey = 5",
    "kv_exists": f"WITH {_COMMANDS} SELECT key FROM kv WHERE key IN (SELECT c_custkey::VARCHAR FROM customer)",
    "path_rollup": "SELECT source AS dir, '.' || lang AS ext, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ROLLUP (source, '.' || lang)",
}

_LETTERS = "[1.0] || list_transform(range(26), lambda i: (length({0}) - length(replace(lower({0}), chr(97 + i::INTEGER), '')))::DOUBLE)"


def _fit_sql(nodes: int) -> str:
    """The best formula of up to ``nodes`` operators. Constants are 1 here, so formulas without them, which come first on
    ties, are enough; one column each, made of columns of smaller ones."""
    forms = enumerate_formulas(nodes)
    free = [(k, f) for k, f in enumerate(forms) if not constants(f)]
    at = {"1": "1.0::DOUBLE", "x": "x", **{f: f"p{k}" for k, f in free}}
    size = lambda f: 0 if isinstance(f, str) else 1 + size(f[1]) + size(f[2])
    table = "points"
    for n in range(1, nodes + 1):
        made = [f"CASE WHEN abs(exp({at[f[1]]}) - ln(CASE WHEN {at[f[2]]} > 0 THEN {at[f[2]]} END)) <= 1e6 THEN exp({at[f[1]]}) - ln({at[f[2]]}) END AS p{k}" for k, f in free if size(f) == n]
        table = f"(SELECT *, {', '.join(made)} FROM {table})"
    errors = ", ".join(f"CASE WHEN count(p{k}) = count(*) THEN avg((p{k} - y) * (p{k} - y)) END" for k, _ in free)
    names = ", ".join(f"'{rpn(f)}'" for _, f in free)
    return f"""WITH {_POINTS}, s AS (SELECT "group", unnest([{errors}]) AS mse, unnest(range({len(free)})) AS k FROM {table} GROUP BY "group")
 SELECT "group", [{names}][arg_min(k, (mse, k)) + 1] AS rpn, round(min(mse), 6) AS mse FROM s WHERE mse IS NOT NULL GROUP BY "group\""""


_TOP = f"(SELECT list(doc_id ORDER BY s DESC, doc_id) FROM (SELECT a.vec_id AS doc_id, {_UNIT} AS s FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND {{}} ORDER BY s DESC, doc_id LIMIT 8))"
ORACLE |= {
    "same_hits": f"SELECT 'base and delta' AS \"of\", {_TOP.format('true')} = {_TOP.format('true')} AS same UNION ALL SELECT 'a third', {_TOP.format('true')} = {_TOP.format('a.vec_id % 3 = 0')}",
    "jsonl_first_match": "SELECT event_id AS path FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "embedded": f"SELECT doc_id, list_transform({_LETTERS.format('t')}, lambda x: x::BIGINT)::VARCHAR AS counts FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM documents)",
    "refresh_guards": "SELECT unnest(['the same', 'root', 'model', 'dimension', 'vectors']) AS what, unnest([false, true, true, true, true]) AS refused",
    "index_violations": """WITH m AS (SELECT count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi, count(DISTINCT doc_id) AS d FROM documents WHERE doc_id % 97 <> 5),
 v AS (SELECT count(*) AS n, min(vec_id) AS lo, max(vec_id) AS hi, count(DISTINCT vec_id) AS d, count(*) FILTER (len(embedding) <> 63) AS bad FROM embeddings)
 SELECT 'dim' AS "check", v.bad = 0 AS ok, v.bad::VARCHAR AS detail FROM v UNION ALL SELECT 'count', m.n = v.n, concat_ws(' ', m.n, v.n) FROM m, v
 UNION ALL SELECT 'dense ids', m.n = m.d AND m.lo = 0 AND m.hi = m.n - 1 AND v.n = v.d AND v.lo = 0 AND v.hi = v.n - 1, concat_ws(' ', m.lo, m.hi, m.d) FROM m, v""",
    "index_report_bad": f"""{_BEFORE_AFTER}, manifest AS (SELECT doc_id FROM first WHERE path NOT IN (SELECT path FROM plan) UNION ALL SELECT doc_id FROM second),
 bad AS (SELECT count(*) AS n FROM manifest WHERE doc_id % 50 = 7)
 SELECT "check", ok, n::VARCHAR AS detail FROM (SELECT 'base vectors' AS "check", true AS ok, count(*) AS n FROM first UNION ALL SELECT 'files', true, count(*) FROM after
 UNION ALL SELECT 'superseded', true, (SELECT count(*) FROM first WHERE path IN (SELECT path FROM plan)) + (SELECT n FROM bad)
 UNION ALL SELECT 'manifest', true, count(*) FROM manifest UNION ALL SELECT 'delta vectors', true, count(*) FROM second UNION ALL SELECT 'merged', n = 0, n FROM bad)""",
    "search_index": f"""{_BEFORE_AFTER.replace("encode(text) AS content", "encode(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')) AS content")},
 chunk AS (SELECT doc_id, f.path, f."offset", f.length, decode(b.content[("offset" + 1):("offset" + f.length)]) AS t FROM first f JOIN before b USING (path) WHERE f.path NOT IN (SELECT path FROM plan)
  UNION ALL SELECT doc_id, s.path, s."offset", s.length, decode(a.content[("offset" + 1):("offset" + s.length)]) FROM second s JOIN after a USING (path))
 SELECT doc_id, round(score, 4) AS score, path, "offset", left(t, 200) AS snippet
 FROM (SELECT *, list_cosine_similarity({_LETTERS.format("t")}, {_LETTERS.format("'the quick brown fox jumps over a lazy dog'")}) AS score FROM chunk) ORDER BY score DESC, doc_id LIMIT 8""",
    "score_many_formulas": f"""{_SCORES} SELECT "group", formula_id + 4 * k AS formula_id, round(mse, 6) AS mse FROM scores, (SELECT unnest(range(17)) AS k)""",
    "fit_formulas_default": _fit_sql(3),
    "predict_out_of_bounds": """SELECT l_returnflag AS "group", round(sum(CASE WHEN exp(l_quantity) <= 1e6 THEN exp(l_quantity) ELSE 0 END), 1) AS total, count(*) FILTER (exp(l_quantity) > 1e6) AS bad FROM lineitem GROUP BY l_returnflag""",
    "topic_bad_checksum": f"""WITH {_LOG} SELECT "offset", segment_base, "offset" <> (SELECT max("offset") FROM seg WHERE topic = 'view' AND segment_base = 0) AS crc_ok FROM seg WHERE topic = 'view'""",
    "document_files": """SELECT source || '/' || lang || '/' || doc_id || ['.md', '.txt', '.TXT', '.bin', '.py'][doc_id % 5 + 1] AS path, strlen(text)::BIGINT AS length, sha256(text) AS sha256
 FROM documents WHERE lang <> 'fr' AND doc_id % 5 IN (0, 1, 4)""",
    "payload_folder": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS auto_id, lpad(vec_id::VARCHAR, 12, '0') || '.bin' AS name, len(embedding)::BIGINT AS dim, round(embedding[1]::DOUBLE, 5) AS head FROM embeddings",
    "payload_crc32c": """WITH t AS (SELECT list(list_reduce([i] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 2197175160 ELSE 0 END)) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i))
 SELECT event_id, xor(list_reduce([4294967295] || list_transform(range(1, strlen(props) + 1), lambda i: ord(props[i])::BIGINT), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc32c FROM events, t""",
}


def _tune_sql(goal: float) -> str:
    """Coordinate descent on the nine formulas of one operator over distinct points and their counts: 8 passes of 2 places."""
    leaf = lambda kind, f: f"CASE {kind} WHEN '1' THEN 1.0::DOUBLE WHEN 'x' THEN x ELSE {f} END"
    gate = lambda v: f"CASE WHEN abs({v}) <= 1e6 THEN {v} END"
    node = "exp(a) - ln(CASE WHEN b > 0 THEN b END)"
    sse = f"CASE WHEN bool_or(p IS NULL) THEN 'inf'::DOUBLE ELSE sum(w * (p - y) * (p - y)) END"
    value = lambda f0, f1: f"(SELECT *, {gate(node)} AS p FROM (SELECT *, {gate(leaf('l', f0))} AS a, {gate(leaf('r', f1))} AS b FROM {{}}))"
    return f"""WITH RECURSIVE {_POINTS}, w AS MATERIALIZED (SELECT "group", x, y, count(*) AS w FROM points GROUP BY ALL),
forms AS (SELECT i + 3 * j AS k, ['1', 'x', 'f'][i + 1] AS l, ['1', 'x', 'f'][j + 1] AS r FROM range(3) a(i), range(3) b(j)),
probes AS (SELECT 0 AS p, 1.0::DOUBLE AS mul, 0.0::DOUBLE AS plus UNION ALL SELECT unnest(range(1, 5)), unnest([0.25::DOUBLE, 0.5, 2, 4]), 0
 UNION ALL SELECT unnest(range(5, 9)), 1, unnest([0.1::DOUBLE, -0.1, 1, -1]) UNION ALL SELECT unnest(range(9, 15)), 0, unnest([0.5::DOUBLE, 1, 2, 3, 4, 5])),
s AS (SELECT 0 AS step, g AS "group", k, l, r, 1.0::DOUBLE AS f0, 1.0::DOUBLE AS f1 FROM forms, (SELECT DISTINCT "group" AS g FROM w)
 UNION ALL SELECT step + 1, "group", k, l, r, CASE WHEN step % 2 = 0 THEN b.v ELSE f0 END, CASE WHEN step % 2 = 1 THEN b.v ELSE f1 END FROM (
  SELECT step, "group", k, l, r, f0, f1, min(struct_pack(sse := e, p := pr, v := v)) AS b FROM (
   SELECT step, "group", k, l, r, f0, f1, pr, v, {sse} AS e FROM {value("CASE WHEN step % 2 = 0 THEN v ELSE f0 END", "CASE WHEN step % 2 = 1 THEN v ELSE f1 END").format(
     '(SELECT s.*, w.x, w.y, w.w, q.p AS pr, CASE WHEN q.p = 0 THEN o ELSE greatest(o * mul + plus, 1e-6) END AS v FROM (SELECT *, CASE WHEN step % 2 = 0 THEN f0 ELSE f1 END AS o FROM s WHERE step < 16) s JOIN w USING ("group"), probes q)')}
   GROUP BY ALL) GROUP BY ALL)),
scores AS (SELECT "group", k, l, r, f0, f1, {sse} / sum(w) AS mse FROM {value("f0", "f1").format('(SELECT s.*, w.x, w.y, w.w FROM s JOIN w USING ("group") WHERE step = 16)')} GROUP BY ALL),
best AS (SELECT "group", min(struct_pack(no := NOT (mse <= {goal}), m := CASE WHEN mse <= {goal} THEN 0 ELSE mse END, k := k)) AS b FROM scores GROUP BY "group")
SELECT s."group", concat_ws(' ', l, r, 'eml') AS rpn, list_transform(list_filter([CASE WHEN l = 'f' THEN f0 END, CASE WHEN r = 'f' THEN f1 END], lambda c: c IS NOT NULL), lambda c: round(c, 6))::VARCHAR AS constants,
 round(mse, 6) AS mse FROM scores s JOIN best ON best."group" = s."group" AND s.k = b.k"""


ORACLE |= {
    "tune_formulas": _tune_sql(-1),
    "contains_ids_of_table": ORACLE["contains_ids"],
    "vector_lookup": "SELECT vec_id AS doc_id, round((embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))))::FLOAT::DOUBLE, 5) AS head FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 7 = 3)",
    "search_files": f"""WITH {_DOCS}, chunk AS (SELECT row_number() OVER (ORDER BY path, "offset") - 1 AS doc_id, path, "offset", hex(content[("offset" + 1):("offset" + least(length, 61))]) AS snippet FROM ({_chunked("docs")}))
 SELECT doc_id, score, path, "offset", snippet FROM ({ORACLE["cosine_topk"]}) JOIN chunk USING (doc_id)""",
    "tune_formulas_goal": _tune_sql(0.00238),
    "fit_formulas_goal": f"""{_SCORES} SELECT "group", ['1 1 eml', 'x 1 eml', '1 x eml', 'x x eml'][arg_min(formula_id, (NOT mse <= 0.5, CASE WHEN mse <= 0.5 THEN 0 ELSE mse END, formula_id)) + 1] AS rpn,
 round(arg_min(mse, (NOT mse <= 0.5, CASE WHEN mse <= 0.5 THEN 0 ELSE mse END, formula_id)), 6) AS mse FROM scores GROUP BY "group\"""",
}
