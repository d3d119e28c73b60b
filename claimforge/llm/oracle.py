"""SQL that states what queries of the subpackage must give, where SQL can."""

#: Marks for a removed thousands separator, a decimal point and a minus, from the private use area.
_GONE, _POINT, _MINUS = "\ue000", "\ue001", "\ue002"


def _words(c: str, signs: bool = False) -> str:
    """A text's words in order (with its signs): SQL's expressions look at no neighbours, so these are marked step by step."""
    x = f"lower(coalesce({c}, ''))"
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\d),(\\d{{3}})(\\D|$)', '\\1{_GONE}\\2\\3', 'g')"
    for _ in range(4):
        x = f"regexp_replace({x}, '(\\d),(\\d\\d){_GONE}', '\\1{_GONE}\\2{_GONE}', 'g')"
    x = f"replace({x}, '{_GONE}', '')"
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\d)\\.(\\d)', '\\1{_POINT}\\2', 'g')"
    if signs:
        x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}])[-−](\\d)', '\\1{_MINUS}\\2', 'g')"
    sign = f"[₹$%{_MINUS}]|" if signs else ""
    return f"regexp_extract_all({x}, '{sign}[\\p{{L}}\\p{{N}}{_POINT}]+')"


_COPIES = f"k AS (SELECT DISTINCT id, {_words('entity')} e, {_words('attribute')} t, list_sort({_words('canonical_statement', True)}) s FROM facts WHERE id IS NOT NULL), g AS (SELECT id, min(id) OVER (PARTITION BY e, t, s) m, count(*) OVER (PARTITION BY e, t, s) n FROM k)"

SQL: dict[str, str] = {
    "p3_found": f"WITH {_COPIES} SELECT m AS first_id, id AS copy_id FROM g WHERE id <> m",
    "p3_collapsed": f"WITH {_COPIES} SELECT id AS first_id, n AS copies FROM g WHERE id = m",
    "p6_found": """WITH RECURSIVE f AS (SELECT DISTINCT id FROM facts), l AS (SELECT fact_a_id a, fact_b_id b FROM relationships
 WHERE upper(regexp_replace(regexp_replace(relation_type, '(?i)^\\s*relationtype\\.', ''), '[^A-Za-z]+', '', 'g')) IN ('CORROBORATES', 'RECONCILED') AND fact_a_id <> fact_b_id AND fact_a_id IN (SELECT id FROM f) AND fact_b_id IN (SELECT id FROM f)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), g AS (SELECT DISTINCT a v, a w FROM e UNION SELECT g.v, e.b FROM g JOIN e ON e.a = g.w), m AS (SELECT v, min(w) k FROM g GROUP BY v)
 SELECT k AS group_id, v AS fact_id FROM m WHERE k <> v""",
    "p4_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(raw_text) > 2400",
}
