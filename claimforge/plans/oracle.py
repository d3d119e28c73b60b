"""SQL that states what the registered queries must give, for an engine that is not Spark."""

from __future__ import annotations

#: Fixed values, written out again so that a wrong one in the engine shows.
_ENTITY_STOP = "ltd limited inc corp corporation co company the of and".split()
_ATTRIBUTE_STOP = "of the in for and on at to a an from by is as total".split()
_CLUSTERS = [x.split() for x in ("revenue turnover sales income topline", "ebitda", "pat profit bottomline earnings", "gdp growth output gva", "headcount employees workforce personnel", "debt borrowings liabilities leverage")]
_TYPES = [("prospectus", ["prospectus", "initial public offering"]), ("annual_report", ["annual report", "board of directors"]), ("earnings_presentation", ["earnings presentation", "investor presentation", "q4 fy"]), ("macro_report", ["economic survey", "gdp growth", "macroeconomic"]), ("imf_report", ["article iv", "international monetary fund"])]
_RATE_LIMIT = ["rate limit", "429", "otpm", "tpm", "tokens per day"]
_TIMEOUT = ["timeout", "timed out"]
_S = r"[\s\x0B\x{85}\p{Z}]"
_F = "f AS (SELECT DISTINCT * FROM facts), r AS (SELECT DISTINCT * FROM relationships), c AS (SELECT DISTINCT * FROM chunks), u AS (SELECT DISTINCT * FROM uploads)"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _number(v: str) -> str:
    bare = f"regexp_replace({_strip(f'coalesce({v}, chr(32))')}, '[₹$,€£]', '', 'g')"
    bare = rf"regexp_replace({bare}, '(?i)\b(cr|crore|crores|lakh|lakhs|mn|million|billion|%)\b', '', 'g')"
    return rf"regexp_extract({bare}, '[-+]?\d*\.?\d+', 0)"


def _decimal(v: str) -> str:
    return f"TRY_CAST(nullif({_number(v)}, '') AS DECIMAL(38,18))"


def _decimals(v: str) -> str:
    return rf"length(regexp_extract({_number(v)}, '\.(\d+)', 1))"


def _metric(x: str) -> str:
    return rf"regexp_replace(regexp_replace({_strip(f'lower(coalesce({x}, chr(32)))')}, '[^\p{{L}}\p{{N}}_\s\x0B\x{{85}}\p{{Z}}]', '', 'g'), '{_S}+', ' ', 'g')"


def _unit(x: str) -> str:
    bare = rf"regexp_replace({_strip(f'lower(coalesce({x}, chr(32)))')}, '[^\p{{L}}\p{{N}}_%]', '', 'g')"
    return f"CASE WHEN {bare} IN ('cr','crore','crores','inrcr') THEN 'inr_cr' WHEN {bare} IN ('lakh','lakhs','inrlakh') THEN 'inr_lakh' WHEN {bare} IN ('percent','pct','%') THEN '%' WHEN {bare} IN ('usd','dollar','dollars') THEN 'usd' ELSE {bare} END"


def _grounded(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    for pattern in ("[¹²³⁴⁵⁶⁷⁸⁹⁰*†‡]", r"\[\d+\]|\(\d+\)", r"[\x{200b}\x{a0}\x{ad}]", r"[^\p{L}\p{N}_\s\x0B\x{85}\p{Z}]", f"{_S}+"):
        t = f"regexp_replace({t}, '{pattern}', ' ', 'g')"
    return _strip(t)


def _kind(x: str) -> str:
    return rf"upper(regexp_replace(regexp_replace({x}, '(?i)^\s*relationtype\.', ''), '[^A-Za-z_]+', '', 'g'))"


def _hash(p: str = "") -> str:
    return f"sha256({p}document_id || '|' || " + " || '|' || ".join(_grounded(f"{p}{c}") for c in ("entity", "attribute", "period", "scope", "value")) + ")"


def _overlap(a: str, b: str, stop: list[str], clusters: list[list[str]]) -> str:
    t = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '' AND NOT list_contains({_list(stop)}, w))"
    same = f"{a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) OR list_has_any({t(a)}, {t(b)})"
    for words in clusters:
        same += f" OR (list_has_any({t(a)}, {_list(words)}) AND list_has_any({t(b)}, {_list(words)}))"
    return f"({a} <> '' AND {b} <> '' AND ({same}))"


_TRUTHY = "coalesce(CASE WHEN json_type({0}.qualifiers, '$.header_uncertain') = 'VARCHAR' THEN json_extract_string({0}.qualifiers, '$.header_uncertain') <> '' ELSE json_extract_string({0}.qualifiers, '$.header_uncertain') NOT IN ('', 'false', '0', '0.0', '[]', '{{}}', 'null') END, false)"
_NORM = f"""n AS (SELECT id, document_id, value, unit, confidence, qualifiers, {_metric('entity')} e, {_metric('attribute')} t, {_metric('period')} p, {_metric('scope')} s, {_unit('unit')} un,
  {_decimal('value')} num, {_decimals('value')} dec, {_strip("lower(coalesce(value, ''))")} txt FROM f)"""
_ALIGNED = f"""WITH {_F}, {_NORM}, al AS (SELECT r.id,
  {_overlap('a.e', 'b.e', _ENTITY_STOP, [])} entity_match, {_overlap('a.t', 'b.t', _ATTRIBUTE_STOP, _CLUSTERS)} attribute_match,
  a.p <> '' has_period_a, b.p <> '' has_period_b, (a.p <> '' AND b.p <> '' AND (a.p = b.p OR contains(a.p, b.p) OR contains(b.p, a.p))) period_match,
  a.s <> '' has_scope_a, b.s <> '' has_scope_b, a.s = b.s scope_match, a.un <> '' has_unit_a, b.un <> '' has_unit_b, NOT (a.un <> '' AND b.un <> '') OR a.un = b.un unit_match,
  (coalesce(a.txt = b.txt AND a.txt <> '', false) OR coalesce(abs(a.num - b.num) <= 1.0 OR 2 * abs(a.num::DOUBLE - b.num::DOUBLE) <= 0.005 * (abs(a.num::DOUBLE) + abs(b.num::DOUBLE)), false)) value_close,
  abs(a.num - b.num) diff, greatest(a.dec, b.dec) dec, {_TRUTHY.format('a')} OR {_TRUTHY.format('b')} OR coalesce(a.confidence < 0.7, false) OR coalesce(b.confidence < 0.7, false) uncertain, a.value value_a, b.value value_b
  FROM r JOIN n a ON a.id = r.fact_a_id JOIN n b ON b.id = r.fact_b_id)"""
_RULES = """, v AS (SELECT id, CASE WHEN NOT entity_match OR NOT attribute_match THEN 1 WHEN period_match AND scope_match AND unit_match AND value_close AND (diff IS NULL OR (diff = 0 AND dec <= 1)) THEN 2
  WHEN period_match AND scope_match AND unit_match AND value_close THEN 3 WHEN diff IS NOT NULL AND NOT (has_period_a AND has_period_b) THEN 4 WHEN diff IS NOT NULL AND NOT value_close AND NOT (has_scope_a AND has_scope_b) THEN 5
  WHEN has_unit_a AND has_unit_b AND NOT unit_match THEN 6 WHEN uncertain THEN 7 ELSE 8 END rule FROM al),
 w(rule, relation_type, decision_route, review_reason, decision_confidence) AS (VALUES (1, 'UNRELATED', 'irrelevant_pre_filter', NULL, 1.0::DOUBLE), (2, 'CORROBORATES', 'deterministic_exact', NULL, 0.98), (3, 'CORROBORATES', 'deterministic_rounding', NULL, 0.98),
  (4, 'NEEDS_REVIEW', 'ambiguity_firewall', 'missing_period', 0.95), (5, 'NEEDS_REVIEW', 'ambiguity_firewall', 'missing_scope_or_basis', 0.95), (6, 'NEEDS_REVIEW', 'ambiguity_firewall', 'unit_ambiguity', 0.95),
  (7, 'NEEDS_REVIEW', 'ambiguity_firewall', 'header_context_uncertain', 0.9), (8, 'NEEDS_REVIEW', 'ambiguity_firewall', 'adjudication_unavailable', 0.5))"""
_VERDICTS = f"{_ALIGNED}{_RULES}, d AS (SELECT v.id, relation_type, decision_route, review_reason, decision_confidence FROM v JOIN w USING (rule))"
_GROUND = f"""g0 AS (SELECT f.id, coalesce(f.confidence, 1.0) k, coalesce(evidence_quote, '') raw, {_grounded('evidence_quote')} q, coalesce(json_extract_string(f.qualifiers, '$.extraction_path') = 'vision', false) vision, coalesce(cc.t, '') t
  FROM f LEFT JOIN (SELECT id, {_grounded('raw_text')} t FROM c) cc ON cc.id = f.chunk_id),
 g1 AS (SELECT *, list_filter(string_split(q, ' '), lambda w: w <> '') ws FROM g0), g2 AS (SELECT *, len(ws) n, len(list_filter(ws, lambda w: contains(t, w))) hit FROM g1),
 g AS (SELECT id, CASE WHEN vision THEN 'vision' WHEN regexp_replace(raw, '{_S}', '', 'g') = '' THEN 'empty' WHEN contains(t, q) THEN 'exact' WHEN n <= 2 AND (hit = n OR contains(replace(t, ' ', ''), q)) THEN 'short' WHEN hit / greatest(n, 1) >= 0.7 THEN 'words' ELSE 'absent' END reason, k, hit / greatest(n, 1) share FROM g2)"""
_GROUNDED = "SELECT id, reason NOT IN ('empty', 'absent') is_valid, CASE reason WHEN 'vision' THEN round(least(k, 0.7), 2) WHEN 'empty' THEN 0.0 WHEN 'words' THEN round(greatest(0.3, k * CASE WHEN share >= 0.85 THEN 0.95 ELSE 0.9 END), 2) WHEN 'absent' THEN 0.2 ELSE k END grounded_confidence, reason FROM g"
_SURVIVORS = f"gc AS ({_GROUNDED}), hh AS (SELECT f.id, f.document_id, f.created_at, gc.grounded_confidence, {_hash('f.')} h FROM f JOIN gc USING (id) WHERE gc.is_valid), sv AS (SELECT * FROM hh QUALIFY row_number() OVER (PARTITION BY h ORDER BY created_at, id) = 1)"
_CHUNK_STATES = "cs AS (SELECT c.id, c.document_id, coalesce(k, 0) facts, CASE WHEN coalesce(k, 0) = 0 AND extraction_status IN ('rate_limited', 'extraction_failed', 'timed_out', 'cancelled') THEN extraction_status ELSE 'success' END extraction_status FROM c LEFT JOIN (SELECT chunk_id, count(*) k FROM f GROUP BY 1) x ON x.chunk_id = c.id)"
_FIRST = "SELECT h content_key, arg_min(id, (created_at, id)) id, count(*) copies FROM {0} GROUP BY h"
_HOLDS = lambda marks, m="lower(text)": " OR ".join(f"contains({m}, '{x}')" for x in marks)
_PACKED = f"""WITH RECURSIVE {_F}, o AS (SELECT document_id, page_number, raw_text, row_number() OVER (PARTITION BY document_id, page_number ORDER BY id) k FROM c),
 p AS (SELECT document_id, page_number, k, 0 chunk_no, 1 n_fragments, raw_text t FROM o WHERE k = 1 UNION ALL
  SELECT o.document_id, o.page_number, o.k, CASE WHEN length(p.t) + 2 + length(o.raw_text) <= 2400 THEN chunk_no ELSE chunk_no + 1 END, CASE WHEN length(p.t) + 2 + length(o.raw_text) <= 2400 THEN n_fragments + 1 ELSE 1 END,
   CASE WHEN length(p.t) + 2 + length(o.raw_text) <= 2400 THEN p.t || chr(10) || chr(10) || o.raw_text ELSE o.raw_text END FROM p JOIN o ON o.document_id = p.document_id AND o.page_number = p.page_number AND o.k = p.k + 1),
 z AS (SELECT document_id, page_number, chunk_no, max(n_fragments) n_fragments, arg_max(t, k) t FROM p GROUP BY ALL)"""
_COSINE = "round(list_dot_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[]))), 6)"
_TOPK = "SELECT * FROM (SELECT query_id, cand_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM (SELECT q.vec_id query_id, x.vec_id cand_id, {0} score FROM embeddings q, embeddings x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id {1}) WHERE score >= {2}) WHERE rank <= 4"
_HYDRATED = "LEFT JOIN f {0} ON {0}.id = r.fact_{0}_id LEFT JOIN c c{0} ON c{0}.id = {0}.chunk_id LEFT JOIN u u{0} ON u{0}.id = {0}.document_id"

SQL: dict[str, str] = {
    "normalize_text_quotes": f"WITH {_F} SELECT id, {_grounded('evidence_quote')} AS quote FROM f",
    "normalize_metric_names": f"WITH {_F} SELECT id, {_metric('entity')} AS entity, {_metric('attribute')} AS attribute FROM f",
    "normalize_units": f"WITH {_F} SELECT {_unit('unit')} AS unit_key, count(*) AS facts, count(DISTINCT unit) AS spellings FROM f GROUP BY 1",
    "extract_numeric_values": f"WITH {_F} SELECT id, {_decimal('value')}::DOUBLE AS number, {_decimals('value')} AS decimals FROM f",
    "numeric_tolerance_pairs": f"{_ALIGNED} SELECT id, diff::DOUBLE AS diff, value_close AS is_close FROM al",
    "content_hash_dedup": f"WITH {_F}, h AS (SELECT *, {_hash()} h FROM f) {_FIRST.format('h')}",
    "document_sha256_dedup": "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "canonical_statements": f"""WITH {_F}, b AS (SELECT id, canonical_statement, trim(coalesce(entity, '')) || CASE WHEN trim(coalesce(attribute, '')) <> '' THEN ' ' || trim(attribute) ELSE '' END || CASE WHEN coalesce(period, '') <> '' THEN ' (' || trim(period) || ')' ELSE '' END
 || CASE WHEN coalesce(scope, '') <> '' THEN ' [' || trim(scope) || ']' ELSE '' END || ': ' || trim(coalesce(value, '')) || CASE WHEN coalesce(unit, '') <> '' THEN ' ' || trim(unit) ELSE '' END s FROM f) SELECT id, s AS statement, coalesce(s = canonical_statement, false) AS as_stored FROM b""",
    "doc_type_guess": "SELECT doc_id, CASE " + " ".join(f"WHEN {_HOLDS(marks)} THEN '{name}'" for name, marks in _TYPES) + " ELSE 'general_document' END AS doc_type FROM documents",
    "boilerplate_filter": f"WITH {_F} SELECT id, contains(lower(raw_text), 'forward-looking statements') AND contains(lower(raw_text), 'safe harbor') AND length(raw_text) < 600 AS is_boilerplate FROM c",
    "paragraph_offsets": f"""WITH {_F}, s AS (SELECT id, unnest(string_split(raw_text, chr(10) || chr(10))) p, generate_subscripts(string_split(raw_text, chr(10) || chr(10)), 1) k FROM c), t AS (SELECT id, k, {_strip('p')} p FROM s), t2 AS (SELECT * FROM t WHERE p <> '')
 SELECT id, row_number() OVER w - 1 AS ordinal, p AS paragraph, coalesce(sum(length(p) + 2) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS char_start FROM t2 WINDOW w AS (PARTITION BY id ORDER BY k)""",
    "table_markdown": f"""WITH {_F}, s AS (SELECT id, page_number, list_transform(string_split(raw_text, chr(10)), lambda x: array_to_string(list_transform(string_split(x, ' | '), lambda y: trim(y)), ' | ')) l FROM c WHERE is_table)
 SELECT id, CASE WHEN len(l) >= 2 THEN '[Table on Page ' || page_number || ']' || chr(10) || array_to_string(list_concat([l[1], array_to_string(list_transform(string_split(l[1], ' | '), lambda y: '---'), ' | ')], list_filter(l[2:], lambda x: trim(x) <> '')), chr(10)) END AS markdown FROM s""",
    "chunk_coalesce": f"{_PACKED} SELECT document_id, page_number, chunk_no, n_fragments, length(t) AS n_chars, md5(t) AS chunk_hash FROM z",
    "chunk_loss_check": f"{_PACKED} SELECT document_id, x.fragments, x.chars_before, y.packed, y.chars_after FROM (SELECT document_id, count(*) fragments, sum(length(raw_text)) chars_before FROM c GROUP BY 1) x JOIN (SELECT document_id, count(*) packed, sum(length(t) - 2 * (n_fragments - 1)) chars_after FROM z GROUP BY 1) y USING (document_id)",
    "low_text_pages": f"""WITH {_F}, s AS (SELECT id, document_id, page_number, list_min(list_transform(string_split(raw_text, chr(10)), lambda l: {{'n': length(l), 'l': l}})).l l FROM c WHERE image_ref IS NOT NULL)
 SELECT id, document_id, page_number, CASE WHEN trim(l) = '' THEN '[Visual / Chart Page ' || page_number || ']' ELSE l END AS shown FROM s WHERE length(l) < 80""",
    "quote_grounding": f"WITH {_F}, {_GROUND} {_GROUNDED}",
    "grounding_filter_dedup": f"WITH {_F}, {_GROUND}, h AS (SELECT f.*, {_hash('f.')} h FROM f JOIN g USING (id) WHERE reason NOT IN ('empty', 'absent')) {_FIRST.format('h')}",
    "overlap_pairs": f"{_ALIGNED} SELECT id, entity_match, attribute_match FROM al",
    "pair_alignment": f"{_ALIGNED} SELECT id, entity_match, attribute_match, has_period_a, has_period_b, period_match, has_scope_a, has_scope_b, scope_match, has_unit_a, has_unit_b, unit_match, value_close FROM al",
    "reconcile_cascade": f"{_VERDICTS} SELECT * FROM d",
    "reconcile_route_histogram": f"{_VERDICTS} SELECT relation_type, decision_route, review_reason, count(*) AS pairs FROM d GROUP BY ALL",
    "comparison_snapshot": f"{_ALIGNED} SELECT id, value_a, value_b, unit_match, CASE WHEN has_period_a AND has_period_b THEN '' WHEN has_period_a THEN 'Fact B' WHEN has_period_b THEN 'Fact A' ELSE 'Fact A and Fact B' END AS period_missing, 0.005::DOUBLE AS relative FROM al",
    "alignment_labels": f"""{_ALIGNED}, m AS (SELECT id, 'entity' dimension, CASE WHEN entity_match THEN 'PASS' ELSE 'MISMATCH' END status, NULL reason, NULL::DOUBLE difference FROM al UNION ALL SELECT id, 'attribute', CASE WHEN attribute_match THEN 'PASS' ELSE 'MISMATCH' END, NULL, NULL FROM al
 UNION ALL SELECT id, 'period', CASE WHEN NOT (has_period_a AND has_period_b) THEN 'BLOCKED' WHEN period_match THEN 'PASS' ELSE 'DIFFERENT PERIODS' END, CASE WHEN NOT (has_period_a AND has_period_b) THEN 'period missing' END, NULL FROM al
 UNION ALL SELECT id, 'scope', CASE WHEN NOT (has_scope_a AND has_scope_b) THEN 'BLOCKED' WHEN scope_match THEN 'PASS' ELSE 'DIFFERENT SCOPES' END, CASE WHEN NOT (has_scope_a AND has_scope_b) THEN 'scope unstated' END, NULL FROM al
 UNION ALL SELECT id, 'unit', CASE WHEN unit_match THEN 'PASS' ELSE 'BLOCKED' END, CASE WHEN NOT unit_match THEN 'units incompatible' END, NULL FROM al UNION ALL SELECT id, 'value', CASE WHEN value_close THEN 'PASS' ELSE 'MATERIAL DIFFERENCE' END, NULL, diff::DOUBLE FROM al) SELECT * FROM m""",
    "deterministic_pairs": f"{_ALIGNED} SELECT id, 'CORROBORATES' AS relation_type, CASE WHEN diff IS NULL OR (diff = 0 AND dec <= 1) THEN 'deterministic_exact' ELSE 'deterministic_rounding' END AS decision_route, 0.98::DOUBLE AS decision_confidence FROM al WHERE entity_match AND attribute_match AND period_match AND scope_match AND value_close",
    "stored_verdicts": f"{_VERDICTS} SELECT r.fact_a_id, r.fact_b_id, d.relation_type, d.decision_route, d.review_reason, d.decision_confidence AS confidence, a.value AS value_a, a.confidence AS extraction_confidence_a, b.confidence AS extraction_confidence_b FROM d JOIN r USING (id) JOIN f a ON a.id = r.fact_a_id JOIN f b ON b.id = r.fact_b_id WHERE d.relation_type <> 'UNRELATED'",
    "replay_changes": f"{_VERDICTS} SELECT {_kind('r.relation_type')} AS recorded, d.relation_type, count(*) AS pairs FROM d JOIN r USING (id) JOIN f a ON a.id = r.fact_a_id WHERE a.entity ILIKE '%cement%' GROUP BY ALL",
    "chunk_packing": f"""WITH RECURSIVE {_F}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY id) k, count(*) OVER (PARTITION BY document_id, page_number) page_n FROM c),
 p AS (SELECT document_id, page_number, k, 0 chunk_no, length(raw_text) n FROM o WHERE k = 1 UNION ALL SELECT o.document_id, o.page_number, o.k, CASE WHEN p.n + 2 + length(o.raw_text) <= 2400 THEN chunk_no ELSE chunk_no + 1 END, CASE WHEN p.n + 2 + length(o.raw_text) <= 2400 THEN p.n + 2 + length(o.raw_text) ELSE length(o.raw_text) END FROM p JOIN o ON o.document_id = p.document_id AND o.page_number = p.page_number AND o.k = p.k + 1),
 g AS (SELECT document_id, page_number, chunk_no, count(*) n_fragments, string_agg(raw_text, chr(10) || chr(10) ORDER BY k) t, bool_or(is_table) is_table, bool_or(image_ref IS NOT NULL AND length(raw_text) < 400) needs_vision, arg_min(image_ref, k) FILTER (image_ref <> '') image_ref, min(page_n) page_n, min(char_start) s, min(char_end) e FROM o JOIN p USING (document_id, page_number, k) GROUP BY ALL)
 SELECT document_id, page_number, chunk_no, n_fragments, is_table, needs_vision, image_ref, md5(t) AS chunk_hash, CASE WHEN page_n = 1 THEN coalesce(s, 0) ELSE 0 END AS char_start, CASE WHEN page_n = 1 THEN coalesce(e, length(t)) ELSE length(t) END AS char_end FROM g""",
    "doc_type_first_pages": f"""WITH {_F}, t AS (SELECT document_id, coalesce(string_agg(raw_text, chr(10) ORDER BY page_number, id) FILTER (page_number <= 3 AND trim(raw_text) <> ''), '') t FROM c GROUP BY 1)
 SELECT document_id, length(t) AS chars, CASE """ + " ".join(f"WHEN {_HOLDS(marks, 'lower(t)')} THEN '{name}'" for name, marks in _TYPES) + """ ELSE 'general_document' END AS doc_type FROM t""",
    "adjudication_residue": f"{_ALIGNED}{_RULES} SELECT id FROM v WHERE rule = 8",
    "vector_topk": _TOPK.format(_COSINE, "", 0.30),
    "vector_topk_incremental": _TOPK.format(_COSINE, "AND x.label <= q.label", 0.20),
    "vector_topk_apart": _TOPK.format(_COSINE, "AND x.label <> q.label", 0.20),
    "pair_explanations": f"""{_ALIGNED}{_RULES}, t AS (SELECT v.id, w.decision_route, rule, has_period_a pa, has_period_b pb, has_scope_a sa, has_scope_b sb, a.attribute aa, a.entity ae, b.attribute ba, b.entity be, coalesce(nullif(a.scope, ''), 'standard') sc,
  concat_ws(' ', a.value, nullif(coalesce(a.unit, ''), '')) va, concat_ws(' ', b.value, nullif(coalesce(b.unit, ''), '')) vb FROM v JOIN w USING (rule) JOIN al USING (id) JOIN r USING (id) JOIN f a ON a.id = r.fact_a_id JOIN f b ON b.id = r.fact_b_id)
 SELECT id, decision_route, CASE rule WHEN 1 THEN 'Different subjects: ' || coalesce(aa, '') || ' of ' || coalesce(ae, '') || ' and ' || coalesce(ba, '') || ' of ' || coalesce(be, '') WHEN 2 THEN 'Both state ' || coalesce(aa, '') || ' of ' || coalesce(ae, '') || ' (' || sc || ') as ' || va
  WHEN 3 THEN 'Both state ' || coalesce(aa, '') || ' of ' || coalesce(ae, '') || ' (' || sc || ') as ' || va || ', within rounding of ' || vb WHEN 4 THEN 'No period on ' || CASE WHEN pa THEN 'Fact B' WHEN pb THEN 'Fact A' ELSE 'Fact A and Fact B' END
  WHEN 5 THEN va || ' against ' || vb || ': no scope on ' || CASE WHEN sa THEN 'Fact B' WHEN sb THEN 'Fact A' ELSE 'Fact A and Fact B' END WHEN 6 THEN 'Units differ: ' || va || ' and ' || vb WHEN 7 THEN 'The header or the extraction is uncertain' ELSE 'No rule applies' END AS explanation FROM t""",
    "adjudicated_pairs": f"""{_ALIGNED}{_RULES}, j AS (SELECT v.id, rule, coalesce(trim(a.scope) <> '' AND trim(b.scope) <> '' AND lower(trim(a.scope)) <> lower(trim(b.scope)), false) OR coalesce(trim(a.period) <> '' AND trim(b.period) <> '' AND lower(trim(a.period)) <> lower(trim(b.period)), false) differ
  FROM v JOIN r USING (id) JOIN f a ON a.id = r.fact_a_id JOIN f b ON b.id = r.fact_b_id)
 SELECT id AS pair_id, CASE WHEN rule < 8 THEN relation_type WHEN differ THEN 'RECONCILED' ELSE 'CONTRADICTS' END AS relation_type, CASE WHEN rule < 8 THEN decision_route ELSE 'llm_adjudication' END AS decision_route, CASE WHEN rule < 8 THEN review_reason END AS review_reason, CASE WHEN rule < 8 THEN decision_confidence ELSE 0.6 END AS decision_confidence FROM j JOIN w USING (rule)""",
    "extracted_amounts": rf"""WITH {_F}, s AS (SELECT id, trim(unnest(string_split_regex(regexp_replace(raw_text, '([.!?])\s+', E'\\1\n', 'g'), '\n+'))) q, generate_subscripts(string_split_regex(regexp_replace(raw_text, '([.!?])\s+', E'\\1\n', 'g'), '\n+'), 1) k FROM c WHERE NOT (contains(lower(raw_text), 'forward-looking statements') AND contains(lower(raw_text), 'safe harbor') AND length(raw_text) < 600)),
 m AS (SELECT id, k, q, regexp_extract_all(q, '(?i)(?:(?:US\$|[₹$]|INR|USD|Rs\.?)\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:crore|cr|lakh|million|mn|bn|billion|per cent|percent|%|bps|tonnes|km|MW|units))?|\d[\d,]*(?:\.\d+)?\s?(?:crore|cr|lakh|million|mn|bn|billion|per cent|percent|%|bps|tonnes|km|MW|units))') v FROM s), x AS (SELECT id, k, q, unnest(v) v, generate_subscripts(v, 1) j FROM m)
 SELECT id AS chunk_id, row_number() OVER (PARTITION BY id ORDER BY k, j) - 1 AS ordinal, trim(v) AS value, q AS evidence_quote FROM x""",
    "unordered_pair_dedup": f"WITH {_F}, k AS (SELECT least(fact_a_id, fact_b_id) low, greatest(fact_a_id, fact_b_id) high, {_kind('relation_type')} t FROM r WHERE fact_a_id <> fact_b_id) SELECT DISTINCT low, high FROM k WHERE t <> 'CORROBORATES' EXCEPT SELECT low, high FROM k WHERE t = 'CORROBORATES'",
    "list_facts_filtered": f"WITH {_F}, t AS (SELECT * FROM f WHERE entity ILIKE '%insurance%' AND attribute ILIKE '%debt%' ORDER BY created_at DESC, id LIMIT 100) SELECT t.id, entity, attribute, value, unit, coalesce(qualifiers, '{{}}') AS qualifiers, c.page_number, u.filename FROM t LEFT JOIN c ON c.id = t.chunk_id LEFT JOIN u ON u.id = t.document_id",
    "document_facts": f"WITH {_F} SELECT f.id, entity, value, c.page_number, u.filename FROM (SELECT * FROM f WHERE document_id = (SELECT min(id) FROM u) ORDER BY created_at DESC, id LIMIT 500) f LEFT JOIN c ON c.id = f.chunk_id LEFT JOIN u ON u.id = f.document_id",
    "fact_by_id": f"WITH {_F} SELECT id, entity, attribute, value, unit, period, scope, document_id FROM f WHERE id = (SELECT min(id) FROM f)",
    "relationship_by_id": f"WITH {_F} SELECT r.id, r.relation_type, a.entity AS entity_a, b.entity AS entity_b, ca.page_number AS page_number_a, ub.filename AS filename_b FROM r {_HYDRATED.format('a')} {_HYDRATED.format('b')} WHERE r.id = (SELECT min(id) FROM r)",
    "document_status": f"WITH {_F}, o AS (SELECT * FROM f WHERE document_id = (SELECT min(id) FROM u)) SELECT u.id AS document_id, filename, upper(status) AS status, page_count, doc_type_guess, error_message, (SELECT count(*) FROM o) AS facts, (SELECT count(*) FROM r WHERE fact_a_id IN (SELECT id FROM o) OR fact_b_id IN (SELECT id FROM o)) AS relationships FROM u WHERE u.id = (SELECT min(id) FROM u)",
    "relationship_nested": f"WITH {_F} SELECT r.id, " + ", ".join(f"{s}.{x} AS {x}_{s}" for s in "ab" for x in ("entity", "value", "unit", "confidence")) + ", a.id IS NULL AS a_is_missing FROM r LEFT JOIN f a ON a.id = r.fact_a_id LEFT JOIN f b ON b.id = r.fact_b_id",
    "vector_payloads": f"WITH {_F} SELECT id AS fact_id, document_id, coalesce(entity, '') AS entity, coalesce(attribute, '') AS attribute, coalesce(canonical_statement, '') AS canonical_statement FROM f",
    "vectors_upserted": "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS seq, CASE WHEN vec_id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE AS first FROM embeddings",
    "ingest_facts": f"WITH {_F}, {_GROUND}, {_SURVIVORS} SELECT id, grounded_confidence AS confidence, h AS content_hash FROM sv",
    "ingest_chunks": f"WITH {_F}, {_CHUNK_STATES} SELECT id, facts, extraction_status FROM cs",
    "ingest_documents": f"""WITH {_F}, {_GROUND}, {_SURVIVORS}, {_CHUNK_STATES}, k AS (SELECT document_id, count(*) chunks, count(*) FILTER (extraction_status <> 'success') failed FROM cs GROUP BY 1), n AS (SELECT document_id, count(*) facts FROM sv GROUP BY 1),
 z AS (SELECT u.id document_id, coalesce(chunks, 0) chunks, coalesce(failed, 0) failed, coalesce(facts, 0) facts FROM u LEFT JOIN k ON k.document_id = u.id LEFT JOIN n ON n.document_id = u.id)
 SELECT document_id, CASE WHEN facts > 0 THEN 'DONE' WHEN failed > 0 THEN 'FAILED' ELSE 'DONE_EMPTY' END AS status, facts, failed AS failed_chunks,
 CASE WHEN facts > 0 AND failed > 0 THEN failed || ' of ' || chunks || ' chunks failed; ' || facts || ' facts' WHEN facts > 0 THEN NULL WHEN failed > 0 THEN 'no facts, ' || failed || ' of ' || chunks || ' chunks failed' ELSE 'no facts in ' || chunks || ' chunks' END AS error_message FROM z""",
    "ingest_relationships": f"""{_ALIGNED.replace('FROM r JOIN n a', 'FROM lp r JOIN n a').replace('FROM f)', 'FROM fv)', 1).replace(f'WITH {_F}, ', f'WITH {_F}, {_GROUND}, {_SURVIVORS}, fv AS (SELECT f.* REPLACE (sv.grounded_confidence AS confidence) FROM f JOIN sv USING (id)), lp AS (SELECT a || b id, a fact_a_id, b fact_b_id FROM (SELECT DISTINCT least(fact_a_id, fact_b_id) a, greatest(fact_a_id, fact_b_id) b FROM r WHERE fact_a_id <> fact_b_id) JOIN fv x ON x.id = a JOIN fv y ON y.id = b WHERE x.document_id <> y.document_id), ', 1)}{_RULES}
 SELECT lp.fact_a_id, lp.fact_b_id, relation_type, decision_route, review_reason FROM v JOIN w USING (rule) JOIN lp USING (id) WHERE relation_type <> 'UNRELATED'""",
    "document_states": f"""WITH {_F}, l AS (SELECT id document_id, 0 step, 'QUEUED' s FROM u UNION SELECT document_id, 1, 'CHUNKING' FROM c UNION SELECT document_id, 2, 'EXTRACTING' FROM c WHERE extraction_status <> 'pending'
 UNION SELECT document_id, 3, 'RECONCILING' FROM f WHERE id IN (SELECT fact_a_id FROM r) OR id IN (SELECT fact_b_id FROM r) UNION SELECT id, 4, upper(trim(status)) FROM u WHERE upper(trim(status)) IN ('DONE', 'DONE_EMPTY', 'FAILED')) SELECT document_id, arg_max(s, step) AS status, count(*) AS steps FROM l GROUP BY 1""",
    "eval_details": f"""{_VERDICTS}, e AS (SELECT d.id, {_kind('r.relation_type')} x, d.relation_type a, r.decision_route xr, d.decision_route ar, r.review_reason xw, d.review_reason aw FROM d JOIN r USING (id)) SELECT id, x AS expected_relation, a AS actual_relation, xr AS expected_route, ar AS actual_route, xw AS expected_reason, aw AS actual_reason,
 coalesce(a = x, x IS NULL) AS relation_met, coalesce(ar = xr, xr IS NULL) AS route_met, coalesce(aw = xw, xw IS NULL) AS reason_met, x = 'UNRELATED' AND a = 'CORROBORATES' AS safety_violation FROM e""",
    "relationship_hydrated": f"WITH {_F} SELECT r.id, a.entity AS entity_a, b.entity AS entity_b, a.value AS value_a, b.value AS value_b, ca.page_number AS page_number_a, cb.page_number AS page_number_b, ua.filename AS filename_a, ub.filename AS filename_b FROM r {_HYDRATED.format('a')} {_HYDRATED.format('b')}",
    "relationships_by_filter": f"""WITH {_F}, hit AS (SELECT id FROM f WHERE entity ILIKE '%cement%' OR attribute ILIKE '%cement%'), t AS (SELECT * REPLACE ({_kind('relation_type')} AS relation_type) FROM r WHERE decision_route IN ('deterministic_exact', 'deterministic_rounding') AND {_kind('relation_type')} = 'CORROBORATES'
 AND (fact_a_id IN (SELECT id FROM hit) OR fact_b_id IN (SELECT id FROM hit)) ORDER BY created_at DESC, id LIMIT 200) SELECT t.id, t.relation_type, t.decision_route, a.entity AS entity_a, b.entity AS entity_b, ua.filename AS filename_a FROM t LEFT JOIN f a ON a.id = t.fact_a_id LEFT JOIN f b ON b.id = t.fact_b_id LEFT JOIN u ua ON ua.id = a.document_id""",
    "document_list_status": f"WITH {_F}, e AS (SELECT r.id, unnest([fact_a_id, fact_b_id]) x FROM r), n AS (SELECT document_id, count(DISTINCT e.id) k FROM e JOIN f ON f.id = e.x GROUP BY 1), m AS (SELECT document_id, count(*) k FROM f GROUP BY 1) SELECT u.id, filename, upper(status) AS status, upload_ts, coalesce(m.k, 0) AS facts, coalesce(n.k, 0) AS relationships FROM u LEFT JOIN m ON m.document_id = u.id LEFT JOIN n ON n.document_id = u.id",
    "top3_per_type": f"WITH {_F} SELECT * FROM (SELECT relation_type, row_number() OVER (PARTITION BY relation_type ORDER BY created_at DESC, id) AS rank, id FROM (SELECT * REPLACE ({_kind('relation_type')} AS relation_type) FROM r)) WHERE rank <= 3",
    "ledger_kpis": f"WITH {_F} SELECT (SELECT count(*) FROM u) AS documents, (SELECT count(*) FROM f) AS facts, count(*) AS pairs, count(*) FILTER (decision_route IN ('deterministic_exact', 'deterministic_rounding', 'irrelevant_pre_filter', 'ambiguity_firewall')) AS avoided, count(*) FILTER ({_kind('relation_type')} = 'NEEDS_REVIEW') AS in_review, round(count(*) FILTER (decision_route IN ('deterministic_exact', 'deterministic_rounding', 'irrelevant_pre_filter', 'ambiguity_firewall')) / greatest(count(*), 1) * 100, 4) AS avoided_percent FROM r",
    "chunk_status_histogram": f"""WITH {_F}, s AS (SELECT document_id, coalesce(nullif(extraction_status, ''), 'unknown') status, count(*) n FROM c GROUP BY ALL), h AS (SELECT document_id, string_agg(status || ': ' || n, ', ' ORDER BY status) histogram, coalesce(sum(n) FILTER (status IN ('rate_limited', 'extraction_failed', 'timed_out', 'cancelled')), 0) failed FROM s GROUP BY 1),
 m AS (SELECT document_id, count(*) k FROM f GROUP BY 1) SELECT h.document_id, histogram, failed, coalesce(k, 0) AS facts, CASE WHEN coalesce(k, 0) > 0 THEN 'DONE' WHEN failed > 0 THEN 'FAILED' ELSE 'DONE_EMPTY' END AS verdict FROM h LEFT JOIN m USING (document_id)""",
    "upload_decision_table": f"WITH {_F}, k AS (SELECT content_hash, arg_min(id, (upload_ts, id)) id, upper(arg_min(status, (upload_ts, id))) s FROM u WHERE content_hash IS NOT NULL AND upload_ts < TIMESTAMPTZ '2025-07-01 00:00:00+00' GROUP BY 1) SELECT u.id AS upload_id, CASE WHEN s IS NULL THEN 'new' WHEN s IN ('DONE', 'DONE_EMPTY') THEN 'known' WHEN s = 'FAILED' THEN 'again' ELSE 'in_work' END AS decision, k.id AS document_id FROM u LEFT JOIN k USING (content_hash)",
    "purge_failed": f"WITH {_F}, g AS (SELECT id FROM u WHERE upper(status) = 'FAILED'), gf AS (SELECT id FROM f WHERE document_id IN (SELECT id FROM g)) SELECT 'fact' AS kind, id FROM gf UNION ALL SELECT 'chunk', id FROM c WHERE document_id IN (SELECT id FROM g) UNION ALL SELECT 'relationship', id FROM r WHERE fact_a_id IN (SELECT id FROM gf) OR fact_b_id IN (SELECT id FROM gf)",
    "upsert_latest": "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) k FROM events) WHERE k = 1",
    "eval_metrics": f"""{_VERDICTS}, e AS (SELECT d.relation_type a, d.decision_route ar, {_kind('r.relation_type')} x, r.decision_route xr FROM d JOIN r USING (id)) SELECT count(*) AS cases, round(count(*) FILTER (a = x) / count(*), 4) AS relationship_accuracy, count(*) FILTER (xr IS NULL OR xr = ar) AS routes_met, round(count(*) FILTER (ar <> 'llm_adjudication') / count(*), 4) AS llm_avoidance_rate,
 count(*) FILTER (x = 'NEEDS_REVIEW') AS unsafe_cases, round(count(*) FILTER (x = 'NEEDS_REVIEW' AND a = x) / count(*) FILTER (x = 'NEEDS_REVIEW'), 4) AS review_recall, round(count(*) FILTER (x = 'NEEDS_REVIEW' AND a <> x) / count(*) FILTER (x = 'NEEDS_REVIEW'), 4) AS unsafe_auto_decision_rate, count(*) FILTER ((x = 'NEEDS_REVIEW' AND a IN ('CORROBORATES', 'CONTRADICTS')) OR (x = 'UNRELATED' AND a = 'CORROBORATES')) AS safety_violations FROM e""",
    "json_qualifier_truthiness": f"WITH {_F} SELECT id, {_TRUTHY.format('f')} AS header_uncertain, coalesce(json_extract_string(qualifiers, '$.extraction_path') = 'vision', false) AS from_vision FROM f",
    "error_class_backoff": rf"""WITH {_F}, k AS (SELECT id, CASE WHEN error_message = '' THEN NULL WHEN {_HOLDS(_RATE_LIMIT, 'lower(error_message)')} THEN 'rate_limit' WHEN {_HOLDS(_TIMEOUT, 'lower(error_message)')} THEN 'timeout' ELSE 'other' END kind, TRY_CAST(nullif(regexp_extract(lower(error_message), 'try again in ([\d.]+)s', 1), '') AS DOUBLE) w, unnest([1, 2, 3]) attempt FROM u WHERE error_message IS NOT NULL)
 SELECT id, kind, attempt, CASE kind WHEN 'rate_limit' THEN least(coalesce(w + 0.5, 2.0 * 2.0 ** (attempt - 1)), 20.0) WHEN 'timeout' THEN least(1.5 * 2.0 ** (attempt - 1), 20.0) END AS seconds FROM k""",
    "status_lookup": f"WITH {_F} SELECT upper(trim(status)) AS status, count(*) AS uploads, count(*) FILTER (upper(trim(status)) NOT IN ('QUEUED', 'CHUNKING', 'EXTRACTING', 'RECONCILING', 'DONE', 'DONE_EMPTY', 'FAILED')) AS unknown FROM u GROUP BY 1",
    "stream_fact_counts": f"WITH {_F} SELECT document_id, count(*) AS facts FROM f GROUP BY 1",
    "stream_new_uploads": f"WITH {_F} SELECT content_hash, arg_min(id, (upload_ts, id)) AS id FROM u WHERE content_hash IS NOT NULL GROUP BY 1",
    "stream_job_states": f"""WITH {_F}, s AS (SELECT document_id, count(*) chunks, count(*) FILTER (coalesce(extraction_status, '') IN ('', 'pending')) open, count(*) FILTER (extraction_status IN ('rate_limited', 'extraction_failed', 'timed_out', 'cancelled')) failed FROM c GROUP BY 1)
 SELECT document_id, CASE WHEN open > 0 THEN 'EXTRACTING' WHEN failed = chunks THEN 'FAILED' ELSE 'RECONCILING' END AS status, chunks, failed FROM s""",
    "stream_event_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
