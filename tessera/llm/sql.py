"""The SQL, for DuckDB, of those queries that SQL can express."""

from __future__ import annotations

from tessera.llm.quality import RULES, STOP_WORDS

_HEX = "0123456789abcdef"
#: Five bits of a hexadecimal digest at a time, from two of its digits.
_BASE32 = f"""list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((((strpos('{_HEX}', substr(x, (i * 5) // 4 + 1, 1)) - 1) * 16
  + strpos('{_HEX}', substr(x, (i * 5) // 4 + 2, 1)) - 1) >> (3 - (i * 5) % 4)::INTEGER) & 31)), 1)), 'string_agg', '')"""

OP10 = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to, url FROM p"""

OP2 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id,
  (SELECT min(b) FROM reach WHERE a = vec_id) = vec_id AS kept FROM embeddings"""

#: Texts with equal sets are one class; classes that share shingles are counted against each other.
OP6 = """WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS MATERIALIZED (SELECT rep, n, unnest(s) AS t FROM c),
links AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.t = b.t AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m, s.doc_id) AS component_id, coalesce(m, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN comp ON comp.a = c.rep"""

#: The rules as in ``quality.rules()``: (bad, good) by name.
_VOTES = {
    "symbols": ("n_symbols > 0.05::DOUBLE * c", "n_symbols <= 0.01::DOUBLE * c"),
    "duplicate_lines": ("n_lines >= 3 AND n_dup_lines > 0.3::DOUBLE * n_lines", "n_lines >= 3 AND n_dup_lines <= 0.1::DOUBLE * n_lines"),
    "repetition": ("n_repeat_words > 0.25::DOUBLE * n_words", "n_words >= 50 AND n_repeat_words <= 0.05::DOUBLE * n_words"),
    "word_length": ("word_chars / w < 2.5::DOUBLE OR word_chars / w > 14", "word_chars / w >= 3.5::DOUBLE AND word_chars / w <= 10"),
    "capitals": ("c >= 40 AND n_upper > 0.4::DOUBLE * c", "c >= 40 AND n_upper <= 0.15::DOUBLE * c"),
    "exclamation": ("n_bangs > 0.2::DOUBLE * w", "n_bangs <= 0.02::DOUBLE * w"),
    "stop_words": ("n_words >= 60 AND n_stop < 2 AND n_short_again < 0.02::DOUBLE * n_words", "n_words >= 30 AND n_stop >= 3"),
}


def _op1(iterations: int = 12, threshold: float = 0.75) -> str:
    n = len(RULES)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END" for bad, good in (_VOTES[r] for r in RULES))
    post = "1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, {n} + 1), lambda i: CASE v[i] WHEN 1 THEN ln(g[i] / (1 - b[i])) WHEN 0 THEN ln((1 - g[i]) / b[i]) ELSE 0.0::DOUBLE END)))))".format(n=n)
    total = lambda what, when: f"coalesce(sum({what}) FILTER ({when}), 0)"
    good = [f"least(greatest(({total('n * p', f'v[{i}] = 1')} + 19.8::DOUBLE) / ({total('n * p', f'v[{i}] >= 0')} + 20), 0.8::DOUBLE), 0.999::DOUBLE)" for i in range(1, n + 1)]
    bad = [f"({total('n * (1 - p)', f'v[{i}] = 0')} + 5) / ({total('n * (1 - p)', f'v[{i}] >= 0')} + 20)" for i in range(1, n + 1)]
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (SELECT doc_id, pos, array_to_string(words[pos:pos + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS pos FROM d))),
r AS (SELECT doc_id, sum(least(8, coalesce(following - pos, 8)))::BIGINT AS n FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM g WHERE n > 1) GROUP BY doc_id),
f AS MATERIALIZED (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper,
  length(t) - length(replace(t, '!', '')) AS n_bangs, len(list_distinct(list_intersect(words, [{stops}]))) AS n_stop, len(short) - len(list_distinct(short)) AS n_short_again
  FROM (SELECT *, list_filter(words, lambda x: regexp_full_match(x, '\\p{{L}}{{1,5}}')) AS short FROM d) LEFT JOIN r USING (doc_id)),
x AS MATERIALIZED (SELECT *, [{votes}] AS v FROM (SELECT *, greatest(n_words, 1)::DOUBLE AS w, greatest(word_chars, 1) AS c FROM f)),
patterns AS MATERIALIZED (SELECT v, count(*) AS n FROM x GROUP BY v),
em AS (SELECT 0 AS k, 0.7::DOUBLE AS prior, {[0.99] * n}::DOUBLE[] AS g, {[0.25] * n}::DOUBLE[] AS b
  UNION ALL SELECT k, prior, g, list_transform(range(1, {n} + 1), lambda i: least(greatest(b[i], 2 * (1 - g[i])), 0.98::DOUBLE)) FROM (
   SELECT k + 1 AS k, least(greatest((sum(n * p) + 8) / (sum(n) + 10), 0.02::DOUBLE), 0.98::DOUBLE) AS prior, [{", ".join(good)}] AS g, [{", ".join(bad)}] AS b
   FROM (SELECT k, n, v, {post} AS p FROM em, patterns WHERE k < {iterations}) GROUP BY k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND p >= {threshold}::DOUBLE AS kept, round(p, 6) AS posterior
FROM (SELECT x.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed, {post} AS p FROM x, em WHERE k = {iterations})"""


OP11 = """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def _op12(k: int = 16, rounds: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x, min([d, c]) AS m FROM (SELECT v.vec_id, v.x, c.c, (v.s - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x))::BIGINT AS d FROM v, c{r} c) GROUP BY vec_id, x)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m[2] AS c, unnest(range(1, 65)) AS i, unnest(x) AS x FROM a{r}) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(f.x, o.x) AS x FROM c{r} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM s{r} GROUP BY c) f USING (c))""")
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, x, list_inner_product(x, x) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, m[2]::INTEGER AS cluster, m[1] AS distance, (sum(m[1]) OVER (PARTITION BY m[2]))::BIGINT AS cluster_inertia, (sum(m[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m[2]"""


#: CRC-32 by its table of 256 entries, over the bytes of distinct words.
OP13 = f"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
u AS MATERIALIZED (SELECT doc_id, unnest(w) AS w FROM w),
crc AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
f AS MATERIALIZED (SELECT w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: (strpos('{_HEX.upper()}', h[i]) - 1) * 16 + strpos('{_HEX.upper()}', h[i + 1]) - 1),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM (SELECT w, hex(w) AS h FROM (SELECT w FROM u UNION SELECT w FROM b)), crc),
s AS (SELECT bucket, count(*) AS n FROM u JOIN f USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM b JOIN f USING (w) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM f) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
d AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM u JOIN f USING (w) JOIN g USING (bucket) GROUP BY doc_id),
r AS MATERIALIZED (SELECT w.doc_id, len(w.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || w.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
SELECT r.*, CASE WHEN rank <= 10 * (SELECT count(*) FROM k) // 100 THEN rank END AS rank FROM r LEFT JOIN k USING (doc_id)"""

ORACLE: dict[str, str] = {"op1_quality_rules": _op1(), "op2_embedding_duplicates": OP2, "op6_minhash_duplicates": OP6, "op10_warc": OP10, "op11_top_k": OP11, "op12_centroid_clusters": _op12(), "op13_target_resampling": OP13}
