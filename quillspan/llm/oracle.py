"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

_WORD_GAP = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One chain of windows a source: the certain copies, the ranking, and the three documents that fill the room.
OP2 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s0),
s2 AS (SELECT *, [1.0, 2.0, 3.0][(k % 3 + 1)::INTEGER]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, (SELECT arg_min(level, (cap / w, k)) FROM s3 WHERE NOT level * w > cap) AS open_level FROM s3),
s AS (SELECT source, source_size, least(cap, coalesce(open_level * w, cap)) AS target FROM s4),
c0 AS (SELECT source, length(bin(size))::DOUBLE AS weight, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
c1 AS (SELECT c0.*, source_size, target, sum(words * weight) OVER (PARTITION BY c0.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shared,
  coalesce(sum(words) OVER (PARTITION BY c0.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source),
c2 AS (SELECT *, CASE WHEN shared > 0 THEN (target - 3.0::DOUBLE * before) / shared ELSE 0 END AS level FROM c1),
c3 AS (SELECT source, arg_max(level, weight) AS level FROM c2 WHERE level * weight <= 3 GROUP BY source),
c AS (SELECT c2.source, c2.weight, source_size, target, greatest(0, least(3.0::DOUBLE, coalesce(c3.level * weight, 3.0::DOUBLE))) AS expected FROM c2 LEFT JOIN c3 ON c2.source IS NOT DISTINCT FROM c3.source),
e AS (SELECT uid, doc_id, d.source, size, source_size, target, floor(expected + 1e-9::DOUBLE)::BIGINT AS certain, expected - floor(expected + 1e-9::DOUBLE) AS p,
  (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '~') || '|' || size || '|' || coalesce(d.source, '~')), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND length(bin(size)) = c.weight),
o AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS odds, size > 0 AND p > 1e-9::DOUBLE AS open FROM e),
r AS (SELECT *, least(floor(odds / (1 + odds) * {1 << 52}::DOUBLE), {(1 << 52) - 1})::BIGINT AS key FROM o WHERE open),
rest AS (SELECT source, any_value(target) - sum(certain * size)::DOUBLE AS room FROM o GROUP BY source),
t AS MATERIALIZED (SELECT r.*, rest.room, sum(size) OVER (PARTITION BY r.source ORDER BY key, uid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest.room + 1e-6::DOUBLE AS taken FROM r JOIN rest ON r.source IS NOT DISTINCT FROM rest.source),
r0 AS (SELECT rest.source, rest.room - coalesce(sum(size) FILTER (taken), 0)::DOUBLE AS room FROM rest LEFT JOIN t ON rest.source IS NOT DISTINCT FROM t.source GROUP BY rest.source, rest.room),
""" + ",\n".join(
    f"""p{k} AS MATERIALIZED (SELECT t.source, arg_max(uid, (size, -key, uid)) AS uid, max(size) AS size FROM t JOIN r{k} ON t.source IS NOT DISTINCT FROM r{k}.source
  WHERE NOT taken AND size <= r{k}.room + 1e-6::DOUBLE {" ".join(f"AND NOT EXISTS (SELECT 1 FROM p{j} WHERE p{j}.uid = t.uid)" for j in range(k))} GROUP BY t.source),
r{k + 1} AS (SELECT r{k}.source, room - coalesce(size, 0) AS room FROM r{k} LEFT JOIN p{k} ON r{k}.source IS NOT DISTINCT FROM p{k}.source)"""
    for k in range(3)
) + """,
more AS (SELECT uid FROM t WHERE taken UNION ALL SELECT uid FROM p0 UNION ALL SELECT uid FROM p1 UNION ALL SELECT uid FROM p2)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN least(certain + (more.uid IS NOT NULL)::INTEGER, 3) * size ELSE 0 END::BIGINT AS taken FROM o LEFT JOIN more USING (uid)"""

OP5 = rf"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
l0 AS (SELECT doc_id, unnest(range(len(a))) AS n, unnest(a) AS line FROM d),
l1 AS (SELECT *, len(list_filter(regexp_split_to_array(line, '{_WORD_GAP}'), lambda x: x <> '')) AS w FROM l0),
l2 AS MATERIALIZED (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s, w, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM l1 WHERE w > 0),
ahead AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM l2 a JOIN l2 b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.i) AS i, b.i AS j FROM l2 a JOIN l2 b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.i),
win AS (SELECT doc_id, i, j FROM ahead UNION SELECT doc_id, i, j FROM back),
body AS MATERIALIZED (SELECT win.doc_id, win.i, win.j, min(l2.n) AS low, max(l2.n) AS high, sha256(string_agg(s, chr(10) ORDER BY l2.i)) AS h FROM win JOIN l2 ON l2.doc_id = win.doc_id AND l2.i BETWEEN win.i AND win.j GROUP BY ALL),
ranked AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi FROM body WINDOW w AS (PARTITION BY h ORDER BY doc_id, i)),
gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS n FROM ranked WHERE fd <> doc_id OR fi <> i),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (prev IS NULL OR prev <> n - 1) AS n_runs FROM (SELECT doc_id, n, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS t FROM l0 ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(a), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, len(coalesce(t, ''))::BIGINT AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP7 = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, e FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.c),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.component_id, r.component_id = e.vec_id AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN (SELECT a, min(c) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id"""

OP8 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD_GAP}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.c)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, r.component_id FROM n JOIN (SELECT a, min(c) AS component_id FROM reach GROUP BY a) r ON r.a = n.doc_id"""

OP9 = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS p, h FROM d),
k AS (SELECT doc_id, p, md5(substr(h, (2 * p + 1)::BIGINT, 200)) AS k FROM p),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM k) WHERE n > 1),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR p > prev + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM f)),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, g),
piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM sp),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop, string_agg(substr(h, (2 * last + 1)::BIGINT, (2 * (a - last))::BIGINT), '' ORDER BY a) AS kept FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE kept || substr(h, (2 * stop + 1)::BIGINT) END)) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""


#: Places of matches: the lengths of the matches and of the pieces between them.
_OP11_RULE = """SELECT doc_id, uid, {order} AS k, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, {group} AS long, b FROM (SELECT doc_id, uid, regexp_extract_all(t, $re${pattern}$re$) AS m, {groups} AS g, regexp_split_to_array(t, $re${pattern}$re$) AS b FROM d)"""


def _op11() -> str:
    from .secret_scan import BASE_KINDS, RULES

    rules = " UNION ALL ".join(
        _OP11_RULE.format(order=k, kind=r.kind, pattern=r.pattern, groups=f"regexp_extract_all(t, $re${r.pattern}$re$, {r.group})", group="list_transform(g, lambda x: length(x))") for k, r in enumerate(RULES)
    )
    least = "[" + ", ".join(str(r.least) for r in RULES) + "]"
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    name = "kind || ':' || start || ':' || stop"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS uid, coalesce(text, '') AS t FROM documents),
r AS ({rules}),
p AS (SELECT doc_id, uid, k, kind, list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, length(m[i]) AS n FROM r WHERE long[i] >= ({least})[k + 1]),
s AS (SELECT *, start + n AS stop FROM p),
o AS (SELECT uid, {counts}, string_agg({name}, ',' ORDER BY start, k) FILTER (kind IN ({base})) AS base, string_agg({name}, ',' ORDER BY start, k) AS spans FROM s GROUP BY uid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (uid)"""


_P = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * v)::HUGEINT"
OP12 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
x AS MATERIALIZED (SELECT uid, lang, source, term, count(*) AS n FROM (SELECT uid, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM x GROUP BY ALL HAVING count(*) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, sum(x.n)::BIGINT AS n FROM x JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT a.lang, a.source, coalesce(any_value(v), 0) AS v, coalesce(any_value(l.total), 0) AS lang_total, coalesce(sum(c.n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN l USING (lang) LEFT JOIN c ON c.lang = a.lang AND c.source = a.source GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, ({_P.format(n="coalesce(c.n, 0)", total="g.total")})::BIGINT AS p, ({_P.format(n="k.n", total="g.lang_total")})::BIGINT AS q, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op5_line_dedup": OP5, "op7_embedding_near_dedup": OP7, "op8_ngram_jaccard_join": OP8, "op9_suffix_dedup": OP9, "op11_secret_scan": _op11(), "op12_source_divergence": OP12}
