"""The same queries in DuckDB SQL, over views named like the tables."""

from __future__ import annotations

from quillspan.functions.text import canonical_plain
from quillspan.plans.queries import KEYWORDS

_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_CANON = r"regexp_replace(lower({}), '[^0-9A-Za-z\x{{3400}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]+', '', 'g')"


def _norm(x: str) -> str:
    return _NORM.format(x)


def _canon(x: str) -> str:
    return _CANON.format(x)


# parts: a list of segments for each document; seg: one row a segment
_PARTS = f"""parts0 AS (SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_norm('x')}), lambda x: x <> '') AS l0 FROM documents),
parts AS (SELECT * EXCLUDE (l0), CASE WHEN len(l0) = 0 THEN [''] ELSE l0 END AS l FROM parts0)"""
_SEG = f"""{_PARTS},
seg0 AS (SELECT doc_id, unnest(range(len(l)))::INT AS ordinal, unnest(l) AS text FROM parts),
seg AS MATERIALIZED (SELECT *, {_canon('text')} AS canonical FROM seg0)"""
_WITNESS = f"""{_PARTS},
w0 AS (SELECT doc_id, l, sha256({_norm("coalesce(text, '')")}) AS doc_hash, '{{"lang":"' || lang || '","source":"' || source || '"}}' AS meta FROM parts),
w1 AS (SELECT *, sha256(doc_hash || '|' || meta) AS witness_id FROM w0),
w AS (SELECT witness_id, any_value(doc_hash) AS doc_hash, min(doc_id) AS doc_id, arg_min(l, doc_id) AS l FROM w1 GROUP BY witness_id)"""


def _grams(source: str, key: str, q: int = 3) -> str:
    """key, gram (distinct) of source(key, canonical)."""
    return f"""SELECT DISTINCT {key}, CASE WHEN len(canonical) <= {q} THEN canonical ELSE substr(canonical, p::INT, {q}) END AS gram
FROM (SELECT {key}, canonical, unnest(range(1, greatest(len(canonical) - {q} + 1, 1) + 1)) AS p FROM {source} WHERE canonical <> '')"""


def _prints(source: str, key: str, k: int = 12, w: int = 8) -> str:
    """key, f (distinct) of source(key, canonical): minima of sliding windows of k-gram hashes."""
    return f"""SELECT DISTINCT {key}, f FROM (
  SELECT {key}, p, n, min(h) OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS f FROM (
    SELECT {key}, p, n, substr(sha256(CASE WHEN n = 1 THEN canonical ELSE substr(canonical, p::INT, {k}) END), 1, 16) AS h FROM (
      SELECT {key}, canonical, greatest(len(canonical) - {k} + 1, 1) AS n, unnest(range(1, greatest(len(canonical) - {k} + 1, 1) + 1)) AS p FROM {source} WHERE canonical <> '')))
WHERE p <= greatest(n - {w - 1}, 1)"""


_LIST = ", ".join(f"('{k}', '{canonical_plain(k)}')" for k in KEYWORDS)
_TERMS = f"terms(keyword, c) AS (VALUES {_LIST})"
_TURNS = "turns AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS turn_id, text FROM conversations)"
_PHRASE = f"""WITH {_SEG}, q AS (SELECT item_id, {{needle}} AS c FROM benchmark),
hit AS (SELECT q.item_id, s.doc_id, s.ordinal, row_number() OVER (PARTITION BY q.item_id ORDER BY s.doc_id, s.ordinal) AS n
        FROM q JOIN seg s ON q.c <> '' AND contains(s.canonical, q.c))
SELECT item_id, doc_id, ordinal, 1.0::DOUBLE AS score FROM hit WHERE n <= 50"""
_EVENTS = """ev AS (SELECT 'u' || user_id::VARCHAR AS witness_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS ordinal,
  upper(event_type) AS predicate, event_type, replace(props, '": ', '":') AS payload FROM events),
log AS (SELECT *, sha256('{"actor":null,"ordinal":' || ordinal || ',"patient":null,"payload":' || payload || ',"predicate":"' || predicate ||
  '","segment_id":null,"semantic_version":"v1","state_after":{},"state_before":{},"tags":["' || event_type || '"],"witness_id":"' || witness_id || '"}') AS event_id FROM ev)"""
_PAIRS = """users AS (SELECT DISTINCT user_id FROM events),
pairs AS (SELECT 'u' || a.user_id AS "left", 'u' || b.user_id AS "right" FROM users a JOIN users b ON b.user_id = a.user_id + 1)"""
_EDGES = """edges AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer)"""
_ARCHIVE = """m AS (SELECT doc_id::VARCHAR AS source_id, source || '.txt' AS filename, CASE WHEN lang = 'en' THEN 'TEXT' ELSE 'PDF' END AS source_kind FROM documents),
r AS (SELECT doc_id::VARCHAR AS source_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'OK_PDF' ELSE 'OK_TEXT' END ELSE CASE WHEN toxic = 1 THEN '' ELSE 'DOWNLOAD_FAILED' END END AS status,
  quality::BIGINT AS size, sha256(doc_id::VARCHAR) AS sha FROM labels),
j AS (SELECT m.*, r.status, r.size, r.sha, 'OK_' || source_kind AS expected FROM m LEFT JOIN r USING (source_id)),
rec AS (SELECT *, CASE WHEN status IS NULL THEN 'FETCH_NOT_RUN_OR_RESULT_MISSING' WHEN status = expected THEN 'ACQUIRED_VERIFIED_BY_BRIDGE' WHEN status IN ('OK_PDF', 'OK_TEXT') THEN 'SOURCE_KIND_MISMATCH'
  WHEN status = '' THEN 'UNKNOWN_BRIDGE_STATUS' ELSE status END AS acquisition_status FROM j)"""
_BLOCKS = rf"""lines AS (SELECT {{key}}, n, {_norm('x')} AS x FROM (SELECT {{key}}, unnest(range(len(a))) AS n, unnest(a) AS x FROM (SELECT {{key}}, string_split({{text}}, chr(10)) AS a FROM {{source}}))),
marked AS (SELECT *, x = '' AS blank, starts_with(x, '#') AS head, sum(CASE WHEN x = '' OR starts_with(x, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY {{key}} ORDER BY n) AS g FROM lines),
grouped AS (SELECT {{key}}, min(n) AS n, string_agg(x, ' ' ORDER BY n) AS text FROM marked WHERE NOT blank GROUP BY {{key}}, g, head),
blocks AS (SELECT {{key}}, (row_number() OVER (PARTITION BY {{key}} ORDER BY n) - 1)::INT AS ordinal, text FROM grouped)"""
_TURN_BLOCKS = _BLOCKS.format(key="turn_id", text="text", source="turns")
_LABEL = r"(?i)(?:^|[\s\[【(（:_-])(FACT|LOCK|CANON|HYPOTHESIS|STRONG_INFERENCE|CONTRADICTION|TODO|OPEN|REJECTED)(?:$|[\s\]】)）:_-])"
_CANDIDATES = """qn AS (SELECT k, count(*) AS nq FROM qf GROUP BY k), sn AS (SELECT doc_id, ordinal, count(*) AS ns FROM sf GROUP BY ALL),
sh AS (SELECT qf.k, sf.doc_id, sf.ordinal, count(*) AS shared FROM qf JOIN sf USING (f) GROUP BY ALL),
c1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shared DESC, doc_id, ordinal) AS n FROM sh),
c2 AS (SELECT c1.k, c1.doc_id, c1.ordinal, shared, shared::DOUBLE / (nq + ns - shared) AS j FROM c1 JOIN qn USING (k) JOIN sn USING (doc_id, ordinal) WHERE n <= 200),
c3 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j DESC, shared DESC, doc_id, ordinal) AS n FROM c2)"""


_VERSIONS = """vc AS (SELECT 'N' || c_nationkey || '-' || c_mktsegment AS s, 'N' || c_nationkey AS p, max(c_custkey) AS k FROM customer GROUP BY ALL),
v0 AS (SELECT 'R' || r_regionkey AS s, NULL AS p, r_regionkey AS k, '' AS d FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_nationkey, 'nation' FROM nation UNION ALL SELECT s, p, k, 'segment' FROM vc),
v AS (SELECT s AS semantic_version, p AS parent_version, sha256('{"a":' || k || ',"b":"x"}') AS config_hash, d AS description FROM v0)"""
_OUTPUTS = f"""o0 AS (SELECT *, '{{"artifact_kind":"ANALYST_OUTPUT","epistemic_status":"UNVERIFIED_LEGACY_OUTPUT","lang":"' || lang || '","legacy_output_version":"legacy-output/v1","source":"' || source || '"}}' AS meta,
  CASE WHEN doc_id % 10 <> 0 THEN text END AS t FROM documents),
o1 AS (SELECT *, sha256({_norm("coalesce(t, '')")}) AS output_hash FROM o0), o2 AS (SELECT sha256(output_hash || '|' || meta) AS output_id, output_hash, t AS text FROM o1),
outputs AS (SELECT DISTINCT * FROM o2)"""

_FUZZY = f"""WITH {_SEG}, b AS (SELECT item_id, {_canon(_norm('text'))} AS canonical FROM benchmark),
qg AS MATERIALIZED ({_grams('b', 'item_id')}), sg AS MATERIALIZED ({_grams('seg', 'doc_id, ordinal')}),
qn AS (SELECT item_id, count(*) AS nq FROM qg GROUP BY 1), sn AS (SELECT doc_id, ordinal, count(*) AS ns FROM sg GROUP BY ALL),
o AS (SELECT item_id, doc_id, ordinal, count(*) AS overlap FROM qg JOIN sg USING (gram) GROUP BY ALL),
o1 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id, ordinal) AS n FROM o),
o2 AS (SELECT item_id, doc_id, ordinal, overlap::DOUBLE / (nq + ns - overlap) AS score FROM o1 JOIN qn USING (item_id) JOIN sn USING (doc_id, ordinal) WHERE n <= 200),
o3 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, ordinal) AS n FROM o2)
SELECT item_id, doc_id, ordinal, score FROM o3 WHERE n <= 20"""


def oracle_sql() -> dict[str, str]:
    norm_text = _norm("coalesce(text, '')")
    fuzzy = _FUZZY
    return {
        "normalize_canonical": f"SELECT doc_id, sha256({norm_text}) AS normalized_sha256, sha256({_canon(norm_text)}) AS canonical_sha256, len({_canon(norm_text)})::BIGINT AS canonical_chars FROM documents",
        "segments": f"WITH {_SEG} SELECT doc_id, ordinal, text, canonical FROM seg",
        "witness_ids": f"WITH {_WITNESS} SELECT witness_id, doc_hash, doc_id, len(l)::BIGINT AS n_segments FROM w",
        "segment_ids": f"""WITH {_WITNESS}, s AS (SELECT witness_id, doc_id, unnest(range(len(l)))::INT AS ordinal, sha256(unnest(l)) AS segment_hash FROM w)
SELECT doc_id, ordinal, sha256(witness_id || '|' || ordinal || '|' || segment_hash) AS segment_id, segment_hash FROM s""",
        "merkle_roots": f"""WITH RECURSIVE {_PARTS}, m(doc_id, l) AS (SELECT doc_id, list_transform(l, lambda x: sha256(x)) FROM parts
UNION ALL SELECT doc_id, list_transform(range(0, ((len(l) + 1) // 2)::BIGINT), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1]))) FROM m WHERE len(l) > 1)
SELECT doc_id, l[1] AS merkle_root FROM m WHERE len(l) = 1""",
        "qgram_postings": f"WITH {_SEG} {_grams('seg', 'doc_id, ordinal')}",
        "gram_df": f"WITH {_SEG}, g AS ({_grams('seg', 'doc_id, ordinal')}) SELECT gram, count(*) AS segments FROM g GROUP BY gram",
        "exact_segment_dups": f"WITH {_SEG} SELECT sha256(text) AS segment_hash, count(*) AS copies FROM seg GROUP BY 1 HAVING count(*) > 1",
        "exact_segment_lookup": f"WITH {_SEG}, h AS (SELECT *, sha256(text) AS segment_hash FROM seg) SELECT doc_id, ordinal, segment_hash, 1.0::DOUBLE AS score FROM h WHERE segment_hash IN (SELECT segment_hash FROM h WHERE ordinal = 0)",
        "file_scan": "SELECT 'n' || n_nationkey AS folder, sha256('# ' || n_name || chr(10) || chr(10) || 'FACT: ' || n_name) AS text_hash FROM nation WHERE n_nationkey % 3 <> 0",
        "bundle_read": "SELECT sha256(n_name || ' region ' || n_regionkey) AS doc_hash, true AS ok, 2::BIGINT AS segment_count, true AS semantic_events_included, n_nationkey::VARCHAR AS nation FROM nation",
        "manifest_read": """WITH j AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'FETCH_NOT_RUN_OR_RESULT_MISSING' WHEN c_custkey % 2 = 1 THEN 'ACQUIRED_VERIFIED_BY_BRIDGE' ELSE 'SOURCE_KIND_MISMATCH' END AS acquisition_status FROM customer)
SELECT acquisition_status, count(*) AS records, sum(CASE WHEN acquisition_status = 'ACQUIRED_VERIFIED_BY_BRIDGE' THEN c_custkey END)::BIGINT AS bytes FROM j GROUP BY 1""",
        "segments_read": "SELECT turn::INT AS ordinal, count(*) AS segments, count(text) AS intact FROM conversations GROUP BY 1",
        "unknown_edge_types": f"WITH {_EDGES} SELECT 'HAS' AS edge_type, count(*) AS edges FROM edges",
        "repeated_texts": "SELECT sha256(text) AS text_hash, count(*) AS \"rows\" FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "witness_lookup": f"WITH {_WITNESS} SELECT witness_id, w.doc_hash, lang, source FROM w JOIN documents USING (doc_id) WHERE doc_id = 0",
        "gram_index": f"WITH {_SEG}, g AS ({_grams('seg', 'doc_id, ordinal')}) SELECT gram, count(*) AS segments FROM g GROUP BY gram",
        "appended_index": _PHRASE.replace("{needle}", _canon(_norm("text"))),
        "phrase_by_index": _PHRASE.replace("{needle}", _canon(_norm("text"))),
        "fuzzy_by_index": fuzzy,
        "winnow_positions": f"""WITH b AS (SELECT item_id, {_canon(_norm("coalesce(text, '')"))} AS canonical FROM benchmark),
n AS (SELECT item_id, canonical, greatest(len(canonical) - 11, 1) AS n FROM b WHERE canonical <> ''),
h AS (SELECT item_id, n, p - 1 AS position, substr(sha256(CASE WHEN n = 1 THEN canonical ELSE substr(canonical, p::INT, 12) END), 1, 16) AS h FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM n)),
w AS (SELECT item_id, n, position AS start, min((h, -position)) OVER (PARTITION BY item_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x FROM h)
SELECT DISTINCT item_id, (-x[2])::INT AS position, x[1] AS fingerprint FROM w WHERE start <= greatest(n - 8, 0)""",
        "semantic_versions": f"WITH {_VERSIONS} SELECT semantic_version, parent_version, config_hash, description FROM v",
        "edge_upsert": """WITH c AS (SELECT 'N' || c_nationkey AS src, c_mktsegment AS dst, c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey::DOUBLE END AS confidence FROM customer),
new AS (SELECT src, dst, arg_max(coalesce(confidence, 1.0), c_custkey) AS confidence FROM c WHERE c_custkey % 2 = 0 GROUP BY src, dst), old AS (SELECT src, dst, max(confidence) AS confidence FROM c WHERE c_custkey % 2 = 1 GROUP BY src, dst)
SELECT src, dst, 'HAS' AS edge_type, confidence, '{}' AS provenance_json FROM new UNION ALL SELECT src, dst, 'HAS', confidence, 'old' FROM old ANTI JOIN new USING (src, dst)""",
        "cyclic_part": """WITH c AS (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 0)
SELECT 'C' || c_custkey AS src, 'R' || n_regionkey AS dst FROM c UNION SELECT 'N' || n_nationkey, 'C' || c_custkey FROM c UNION SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM c""",
        "graph_export": f"""WITH {_EDGES}, ends AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges), d AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)
SELECT 'node' AS kind, node AS id, '{{"node":"' || node || CASE WHEN r_name IS NULL THEN '' ELSE '","label":"' || r_name END || '","degree":' || degree || '}}' AS record FROM d LEFT JOIN region ON node = 'R' || r_regionkey
UNION ALL SELECT 'link', src || '>HAS>' || dst, '{{"src":"' || src || '","dst":"' || dst || '","edge_type":"HAS","confidence":1.0}}' FROM edges""",
        "timeline_export": "SELECT date_trunc('day', ts)::TIMESTAMP AS period, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY ALL",
        "place_export": "SELECT lang AS place, count(*) AS n, count(DISTINCT source) AS n_source, count(DISTINCT doc_id) AS n_doc_id FROM documents WHERE lang IS NOT NULL GROUP BY lang",
        "story_families": f"WITH {_WITNESS} SELECT source AS family, count(*) AS members, min(witness_id) AS first_member FROM w JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY source",
        "byte_totals": "SELECT source, count(*) AS files, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM documents GROUP BY source",
        "orphan_references": "SELECT doc_id, quality FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT page_id FROM pages)",
        "event_rows": f"WITH {_EVENTS} SELECT ordinal, predicate, event_id FROM log WHERE witness_id = 'u1'",
        "slot_types": f"""WITH {_EVENTS}, {_PAIRS}, o AS (SELECT witness_id, user_id, predicate, arg_max(payload, ordinal) AS payload FROM log GROUP BY ALL),
a AS (SELECT "left", "right", predicate FROM pairs JOIN o ON witness_id = "left"), b AS (SELECT "left", "right", predicate FROM pairs JOIN o ON witness_id = "right"),
j AS (SELECT coalesce(a."left", b."left") AS "left", coalesce(a."right", b."right") AS "right", CASE WHEN a."left" IS NULL THEN 'added' WHEN b."left" IS NULL THEN 'removed' ELSE 'retained' END AS status
  FROM a FULL JOIN b ON a."left" = b."left" AND a."right" = b."right" AND a.predicate = b.predicate)
SELECT "left", "right", status, count(*) FILTER (status = 'retained') AS changed, count(*) AS "rows" FROM j GROUP BY ALL""",
        "fixture_ingest": f"""WITH t AS (SELECT conv_id, count(*) AS n, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
s AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {_norm('x')} <> '')) AS b, len(list_filter(string_split(text, chr(10)), lambda x: {_norm('x')} <> '')) AS l FROM t)
SELECT 'f' || conv_id AS fixture_id, CASE WHEN b > 1 THEN b ELSE greatest(l, 1) END::BIGINT AS n_segments, n AS n_events, n - 1 AS n_edges FROM s""",
        "fixture_pairs": """WITH o AS (SELECT conv_id, upper(role) AS predicate, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations), c AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT a.conv_id AS left_conv, b.conv_id AS right_conv FROM c a JOIN c b ON b.conv_id = a.conv_id + 1),
a AS (SELECT left_conv, right_conv, predicate, k FROM p JOIN o ON conv_id = left_conv), b AS (SELECT left_conv, right_conv, predicate, k FROM p JOIN o ON conv_id = right_conv),
j AS (SELECT coalesce(a.left_conv, b.left_conv) AS left_conv, coalesce(a.right_conv, b.right_conv) AS right_conv, CASE WHEN a.left_conv IS NULL THEN 'added' WHEN b.left_conv IS NULL THEN 'removed' ELSE 'retained' END AS status
  FROM a FULL JOIN b ON a.left_conv = b.left_conv AND a.predicate = b.predicate AND a.k = b.k)
SELECT left_conv, right_conv, status, count(*) AS events FROM j GROUP BY ALL""",
        "legacy_records": f"""WITH {_OUTPUTS}, {_BLOCKS.format(key='output_id', text="coalesce(text, '')", source='outputs')}, {_TERMS},
t AS (SELECT output_id, ordinal, coalesce(string_agg(keyword, ',' ORDER BY keyword), '') AS terms FROM (SELECT output_id, ordinal, {_canon('text')} AS canonical FROM blocks) b LEFT JOIN terms t ON t.c <> '' AND contains(b.canonical, t.c) GROUP BY output_id, ordinal),
x AS (SELECT *, sha256(text) AS block_hash, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{_LABEL}', 1), lambda v: upper(v)))) AS v FROM blocks)
SELECT output_id, output_hash, sha256(output_id || '|' || ordinal || '|' || block_hash) AS block_id, ordinal, block_hash, CASE WHEN len(v) = 0 THEN 'IDEA_CANDIDATE' ELSE array_to_string(v, ',') END AS labels, terms
FROM x JOIN t USING (output_id, ordinal) JOIN (SELECT DISTINCT output_id, output_hash FROM outputs) USING (output_id)""",
        "legacy_index": f"""WITH {_OUTPUTS}, {_BLOCKS.format(key='output_id', text="coalesce(text, '')", source='outputs')}, n AS (SELECT output_id, count(*) AS n FROM blocks GROUP BY output_id)
SELECT DISTINCT output_id, output_hash, coalesce(n, 0)::BIGINT AS block_count, substr(output_id, 1, 16) AS bundle_path FROM outputs LEFT JOIN n USING (output_id)""",
        "legacy_counts": f"""WITH {_OUTPUTS}, {_BLOCKS.format(key='output_id', text="coalesce(text, '')", source='outputs')}
SELECT (SELECT count(DISTINCT output_id) FROM outputs) AS files, (SELECT count(*) FROM blocks) AS blocks""",
        "audited_resolutions": """WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 1 THEN 'SUPPORTED' ELSE 'UNRESOLVED' END AS verdict FROM labels)
SELECT doc_id AS block_id, coalesce(verdict, 'UNRESOLVED_NO_MATCH') AS resolution_status, CASE WHEN verdict <> 'UNRESOLVED' THEN doc_id::VARCHAR END AS evidence, CASE WHEN verdict IS NOT NULL THEN '' END AS resolution_note,
  CASE WHEN verdict IS NOT NULL THEN 'VERDICT_REQUIRES_EXPLICIT_SOURCE_SEGMENT_LINK' END AS resolution_guard FROM documents LEFT JOIN l USING (doc_id)""",
        "bundle_ingest": f"""WITH RECURSIVE {_PARTS}, m(doc_id, l) AS (SELECT doc_id, list_transform(l, lambda x: sha256(x)) FROM parts
UNION ALL SELECT doc_id, list_transform(range(0, ((len(l) + 1) // 2)::BIGINT), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1]))) FROM m WHERE len(l) > 1),
b AS (SELECT doc_id, m.l[1] AS root, sha256({_norm("coalesce(text, '')")}) AS doc_hash, '"bundle_version":"witness-bundle/v1","lang":"' || lang || '","raw_source_committed":false,"source":"' || source || '"}}' AS tail FROM documents JOIN m USING (doc_id) WHERE len(m.l) = 1),
k AS (SELECT *, sha256(doc_hash || '|{{' || tail) AS k FROM b)
SELECT DISTINCT sha256(doc_hash || '|{{"artifact_merkle_root":"' || root || '","artifact_witness_key":"' || k || '",' || tail) AS witness_id, doc_hash, 1::BIGINT AS n_segments FROM k""",
        "bundle_artifacts": f"SELECT doc_id::VARCHAR AS folder, 4::BIGINT AS files, sha256({norm_text} || chr(10)) AS normalized_file FROM documents",
        "source_stubs": f"WITH {_ARCHIVE} SELECT source_id, acquisition_status, 'test' AS collection, false AS raw_source_committed, 'ARCHIVE_SOURCE' AS source_layer FROM rec",
        "listed_targets": "SELECT page_id, url || '/' || page_id || '.PDF' AS path, len(html)::BIGINT AS size FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 0 AND page_id % 2 <> 0",
        "phrase_search": _PHRASE.replace("{needle}", _canon(_norm("text"))),
        "phrase_short": _PHRASE.replace("{needle}", f"substr({_canon(_norm('text'))}, 1, 2)"),
        "fuzzy_search": fuzzy,
        "dictionary_scan": f"""WITH {_SEG}, {_TERMS}, hit AS (SELECT keyword, doc_id, ordinal, row_number() OVER (PARTITION BY keyword ORDER BY doc_id, ordinal) AS n FROM terms JOIN seg ON c <> '' AND contains(canonical, c))
SELECT terms.keyword, doc_id, ordinal FROM terms LEFT JOIN (SELECT * FROM hit WHERE n <= 100) h ON h.keyword = terms.keyword""",
        "dictionary_positions": f"""WITH {_SEG}, {_TERMS}, hit AS (SELECT doc_id, ordinal, keyword, c, canonical FROM terms JOIN seg ON c <> '' AND contains(canonical, c)),
p AS (SELECT *, unnest(range(1, len(canonical) - len(c) + 2)) AS i FROM hit)
SELECT doc_id, ordinal, keyword, (i + len(c) - 2)::INT AS end_index FROM p WHERE substr(canonical, i::INT, len(c)::INT) = c""",
        "winnow_fingerprints": f"WITH {_SEG}, x AS ({_prints('seg', 'doc_id, ordinal')}) SELECT doc_id, ordinal, f AS fingerprint FROM x",
        "fingerprint_stats": f"WITH {_SEG}, x AS ({_prints('seg', 'doc_id, ordinal')}) SELECT (SELECT count(*) FROM seg) AS segments, (SELECT count(*) FROM x) AS fingerprints",
        "fingerprint_candidates": f"""WITH {_SEG}, {_TURNS}, qc AS (SELECT turn_id AS k, {_canon(_norm('text'))} AS canonical FROM turns),
qf AS MATERIALIZED ({_prints('qc', 'k')}), sf AS MATERIALIZED ({_prints('seg', 'doc_id, ordinal')}), {_CANDIDATES}
SELECT k AS turn_id, doc_id, ordinal, shared AS shared_fingerprints, j AS fingerprint_jaccard FROM c3 WHERE n <= 20""",
        "compare_witnesses": f"""WITH RECURSIVE {_PARTS}, m(doc_id, l) AS (SELECT doc_id, list_transform(l, lambda x: sha256(x)) FROM parts
UNION ALL SELECT doc_id, list_transform(range(0, ((len(l) + 1) // 2)::BIGINT), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1]))) FROM m WHERE len(l) > 1),
root AS (SELECT doc_id, l[1] AS r FROM m WHERE len(l) = 1),
c AS (SELECT doc_id, l, array_to_string(list_transform(l, lambda x: {_canon('x')}), '') AS canonical FROM parts), g0 AS ({_grams('c', 'doc_id')}),
g AS (SELECT doc_id, list(gram) AS g FROM g0 GROUP BY doc_id),
p AS (SELECT c.doc_id, list_distinct(l) AS h, len(l) AS n, coalesce(g, []) AS g, r FROM c LEFT JOIN g USING (doc_id) JOIN root USING (doc_id)),
j AS (SELECT a.doc_id AS "left", b.doc_id AS "right", len(list_intersect(a.h, b.h)) AS hi, len(a.h) + len(b.h) AS hs, len(list_intersect(a.g, b.g)) AS gi, len(a.g) + len(b.g) AS gs,
  a.n AS left_segments, b.n AS right_segments, a.r AS left_merkle_root, b.r AS right_merkle_root FROM p a JOIN p b ON b.doc_id = a.doc_id + 1)
SELECT "left", "right", CASE WHEN hs = hi THEN 0.0 ELSE hi::DOUBLE / (hs - hi) END AS exact_segment_jaccard, CASE WHEN gs = gi THEN 0.0 ELSE gi::DOUBLE / (gs - gi) END AS qgram_jaccard,
  left_segments::BIGINT AS left_segments, right_segments::BIGINT AS right_segments, left_merkle_root, right_merkle_root FROM j""",
        "event_log": f"WITH {_EVENTS} SELECT witness_id, ordinal, predicate, payload, event_id FROM log",
        "event_filter": f"WITH {_EVENTS} SELECT witness_id, ordinal, event_id FROM log WHERE predicate = 'PURCHASE'",
        "next_event_edges": f"""WITH {_EVENTS}, n AS (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY witness_id ORDER BY ordinal) AS dst FROM log)
SELECT src, dst, 'NEXT_EVENT' AS edge_type, 1.0::DOUBLE AS confidence FROM n WHERE dst IS NOT NULL""",
        "semantic_diff": f"""WITH {_EVENTS}, {_PAIRS}, o AS (SELECT *, (row_number() OVER (PARTITION BY witness_id, predicate ORDER BY ordinal, event_id) - 1)::INT AS occurrence FROM log),
a AS (SELECT "left", "right", predicate, occurrence, payload FROM pairs JOIN o ON witness_id = "left"), b AS (SELECT "left", "right", predicate, occurrence, payload FROM pairs JOIN o ON witness_id = "right")
SELECT coalesce(a."left", b."left") AS "left", coalesce(a."right", b."right") AS "right", coalesce(a.predicate, b.predicate) AS predicate, coalesce(a.occurrence, b.occurrence) AS occurrence,
  CASE WHEN a."left" IS NULL THEN 'added' WHEN b."left" IS NULL THEN 'removed' ELSE 'retained' END AS status, CASE WHEN a.payload <> b.payload THEN 'payload' ELSE '' END AS changed
FROM a FULL JOIN b ON a."left" = b."left" AND a."right" = b."right" AND a.predicate = b.predicate AND a.occurrence = b.occurrence""",
        "slot_mutation": f"""WITH {_EVENTS}, {_PAIRS}, o AS (SELECT witness_id, predicate, arg_max(payload, ordinal) AS payload FROM log GROUP BY ALL),
a AS (SELECT "left", "right", predicate, payload FROM pairs JOIN o ON witness_id = "left"), b AS (SELECT "left", "right", predicate, payload FROM pairs JOIN o ON witness_id = "right"),
j AS (SELECT coalesce(a."left", b."left") AS "left", coalesce(a."right", b."right") AS "right", coalesce(a.predicate, b.predicate) AS predicate,
  CASE WHEN a."left" IS NULL THEN 'added' WHEN b."left" IS NULL THEN 'removed' ELSE 'retained' END AS status, a.payload AS ap, b.payload AS bp
  FROM a FULL JOIN b ON a."left" = b."left" AND a."right" = b."right" AND a.predicate = b.predicate)
SELECT "left", "right", predicate, status, CASE WHEN status = 'retained' AND ap <> bp THEN 'k' END AS slot,
  CASE WHEN status = 'retained' AND ap <> bp THEN json_extract_string(ap, '$.k') END AS left_value, CASE WHEN status = 'retained' AND ap <> bp THEN json_extract_string(bp, '$.k') END AS right_value FROM j""",
        "bfs_depth": f"""WITH RECURSIVE {_EDGES}, walk(start, node, depth) AS (SELECT 'R' || r_regionkey, 'R' || r_regionkey, 0 FROM region
UNION SELECT start, dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 3) SELECT start, node, min(depth)::INT AS depth FROM walk GROUP BY start, node""",
        "dfs_preorder": f"""WITH RECURSIVE {_EDGES}, walk(node, path) AS (SELECT 'R0', ['R0'] UNION ALL SELECT dst, list_append(path, dst) FROM walk JOIN edges ON src = node)
SELECT (row_number() OVER (ORDER BY path) - 1)::INT AS position, node FROM walk""",
        "version_faults": f"""WITH RECURSIVE {_VERSIONS},
a AS (SELECT semantic_version AS s, CASE WHEN semantic_version LIKE '%-BUILDING' THEN 'none' WHEN semantic_version = 'N1' THEN 'N2' WHEN semantic_version = 'N2' THEN 'N1' ELSE parent_version END AS p FROM v),
up(s, p, n) AS (SELECT s, p, 1 FROM a UNION ALL SELECT up.s, a.p, n + 1 FROM up JOIN a ON a.s = up.p WHERE n < 10)
SELECT s AS semantic_version, CASE WHEN bool_or(p IS NOT NULL AND p NOT IN (SELECT s FROM a)) THEN 'MISSING_PARENT' ELSE 'CYCLE' END AS fault FROM up GROUP BY s HAVING NOT bool_or(p IS NULL)""",
        "strong_components": f"""WITH RECURSIVE {_EDGES}, back AS (SELECT 'C' || c_custkey AS src, 'R' || n_regionkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 0),
e AS (SELECT * FROM edges UNION SELECT * FROM back), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, e.dst FROM reach JOIN e ON e.src = reach.b),
mutual AS (SELECT x.a, min(x.b) AS least_node, count(*) AS nodes FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT least_node, any_value(nodes) AS nodes FROM mutual GROUP BY least_node""",
        "version_tree": f"""WITH RECURSIVE {_VERSIONS},
t(semantic_version, root, depth, path) AS (SELECT semantic_version, semantic_version, 0, semantic_version FROM v WHERE parent_version IS NULL
UNION ALL SELECT v.semantic_version, t.root, t.depth + 1, t.path || ' > ' || v.semantic_version FROM v JOIN t ON v.parent_version = t.semantic_version) SELECT * FROM t""",
        "multi_predicate": "SELECT 'u' || user_id AS witness_id FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 3",
        "earliest_attestation": "SELECT event_type, min(ts) AS first_seen, arg_min(event_id, (ts, event_id)) AS first_event_id FROM events GROUP BY event_type",
        "event_windows": "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "legacy_blocks": f"WITH {_TURNS}, {_TURN_BLOCKS} SELECT turn_id, ordinal, sha256(text) AS block_hash FROM blocks",
        "block_labels": f"""WITH src AS (SELECT doc_id, upper(lang) || ' FACT LOCK: todo ' || coalesce(text, '') AS text FROM documents), {_BLOCKS.format(key='doc_id', text='text', source='src')},
x AS (SELECT doc_id, ordinal, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{_LABEL}', 1), lambda v: upper(v)))) AS v FROM blocks)
SELECT doc_id, ordinal, CASE WHEN len(v) = 0 THEN 'IDEA_CANDIDATE' ELSE array_to_string(v, ',') END AS labels FROM x""",
        "block_terms": f"""WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_BLOCKS.format(key='doc_id', text='text', source='src')}, {_TERMS},
c AS (SELECT doc_id, ordinal, {_canon('text')} AS canonical FROM blocks)
SELECT doc_id, ordinal, coalesce(string_agg(keyword, ',' ORDER BY keyword), '') AS terms FROM c LEFT JOIN terms t ON t.c <> '' AND contains(c.canonical, t.c) GROUP BY doc_id, ordinal""",
        "review_queue": f"""WITH {_SEG}, {_TURNS}, {_TURN_BLOCKS}, b AS (SELECT turn_id || '#' || ordinal AS k, {_canon('text')} AS canonical FROM blocks),
qf AS MATERIALIZED ({_prints('b', 'k')}), sf AS MATERIALIZED ({_prints('seg', 'doc_id, ordinal')}), {_CANDIDATES},
best AS (SELECT k, count(*) AS n, arg_min(doc_id, n) AS d, arg_min(ordinal, n) AS o FROM c3 WHERE n <= 5 AND j >= 0.12 GROUP BY k)
SELECT b.k AS block_id, CASE WHEN best.k IS NULL THEN 'UNRESOLVED_NO_MATCH' ELSE 'UNRESOLVED_CANDIDATES' END AS resolution_status, coalesce(n, 0) AS n_candidates, d AS best_doc_id, o AS best_ordinal FROM b LEFT JOIN best USING (k)""",
        "archive_join": f"""WITH {_ARCHIVE} SELECT source_id, source_kind, acquisition_status, CASE WHEN status = expected THEN sha END AS source_sha256, CASE WHEN status = expected THEN size END AS source_size_bytes, status AS bridge_status,
CASE WHEN status IS NOT NULL AND filename <> 'src0.txt' THEN 'src0.txt' END AS other_filename, CASE WHEN acquisition_status = 'SOURCE_KIND_MISMATCH' THEN expected END AS expected_status FROM rec""",
        "archive_summary": f"WITH {_ARCHIVE} SELECT count(*) AS records, count(*) FILTER (acquisition_status = 'ACQUIRED_VERIFIED_BY_BRIDGE') AS verified, count(*) AS source_stubs FROM rec",
        "provenance_alerts": """WITH j AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, a.lang AS al, b.lang AS bl, a.source AS sa, b.source AS sb,
  CASE WHEN a.source IN ('src1', 'src2') THEN 'src3' ELSE a.source END AS ca, CASE WHEN b.source IN ('src1', 'src2') THEN 'src3' ELSE b.source END AS cb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
k AS (SELECT *, ca = cb AS same_collector, al = bl AS same_narrator, al <> bl AS geography_conflict, (al <> sb OR bl <> sa) AS publication_relabel FROM j),
r AS (SELECT *, (same_collector OR same_narrator) AS reuse, (geography_conflict OR publication_relabel) AS moved FROM k),
s AS (SELECT *, CASE WHEN reuse AND moved THEN 'PSEUDOREPLICATION_ALERT' WHEN moved THEN 'SAME_OCCURRENCE_CANDIDATE' WHEN reuse THEN 'TEXTUAL_DEPENDENCE_CANDIDATE' END AS alert FROM r)
SELECT left_id, right_id, same_collector, same_narrator, geography_conflict, publication_relabel,
  array_to_string(list_filter([CASE WHEN al <> bl THEN 'collection_location' END, CASE WHEN sa <> sb THEN 'publication_section_label' END, CASE WHEN sa <> sb THEN 'collector' END, CASE WHEN al <> bl THEN 'narrator' END], lambda x: x IS NOT NULL), ',') AS deltas,
  alert, CASE WHEN alert = 'PSEUDOREPLICATION_ALERT' THEN 'HIGH' WHEN alert IS NOT NULL THEN 'MEDIUM' END AS severity, (al <> sa)::BIGINT AS left_conflicts FROM s""",
        "bundle_verify": f"""WITH RECURSIVE {_PARTS}, m(doc_id, l) AS (SELECT doc_id, list_transform(l, lambda x: sha256(x)) FROM parts
UNION ALL SELECT doc_id, list_transform(range(0, ((len(l) + 1) // 2)::BIGINT), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1]))) FROM m WHERE len(l) > 1)
SELECT doc_id, lang <> 'de' AS ok, CASE WHEN lang = 'de' THEN 'doc_hash_mismatch,witness_key_mismatch' ELSE '' END AS errors, len(parts.l)::BIGINT AS segment_count, m.l[1] AS merkle_root FROM parts JOIN m USING (doc_id) WHERE len(m.l) = 1""",
    }
