"""Functions over claim fields as Column expressions: they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"(?U)\s"
NUMERIC = "decimal(38,18)"
#: Words that say nothing about which entity or attribute is meant.
ENTITY_STOP_WORDS = "ltd limited inc corp corporation co company the of and".split()
ATTRIBUTE_STOP_WORDS = "of the in for and on at to a an from by is as total".split()
#: Words for the same attribute; wordings of several words never meet single tokens and are left out.
SYNONYM_CLUSTERS = [
    ["revenue", "turnover", "sales", "income", "topline"],
    ["ebitda"],
    ["pat", "profit", "bottomline", "earnings"],
    ["gdp", "growth", "output", "gva"],
    ["headcount", "employees", "workforce", "personnel"],
    ["debt", "borrowings", "liabilities", "leverage"],
]
#: Phrases that tell the type of a document, in order of precedence.
DOCUMENT_TYPES = [
    ("prospectus", ["prospectus", "initial public offering"]),
    ("annual_report", ["annual report", "board of directors"]),
    ("earnings_presentation", ["earnings presentation", "investor presentation", "q4 fy"]),
    ("macro_report", ["economic survey", "gdp growth", "macroeconomic"]),
    ("imf_report", ["article iv", "international monetary fund"]),
]
#: What error messages of a rate limit and of a timeout hold.
RATE_LIMIT_MARKS = ["rate limit", "429", "otpm", "tpm", "tokens per day"]
TIMEOUT_MARKS = ["timeout", "timed out"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^(?:{_WS})+|(?:{_WS})+$", "")


def numeric_text(value: Column) -> Column:
    """The first number of a value as text, without currency signs and separators; '' if there is none."""
    bare = F.regexp_replace(_strip(_text(value)), "[₹$,€£]", "")
    bare = F.regexp_replace(bare, r"(?i)\b(cr|crore|crores|lakh|lakhs|mn|million|billion|%)\b", "")
    return F.regexp_extract(bare, r"[-+]?\d*\.?\d+", 0)


def numeric(value: Column) -> Column:
    """The number of a value, unscaled: '5 million' is 5."""
    return F.nullif(numeric_text(value), F.lit("")).try_cast(NUMERIC)


def decimals(value: Column) -> Column:
    """Figures behind the decimal point of the value's number."""
    return F.length(F.regexp_extract(numeric_text(value), r"\.(\d+)", 1))


def numeric_diff(a: Column, b: Column) -> Column:
    return F.abs(numeric(a) - numeric(b))


def bare_text(value: Column) -> Column:
    """A value as it is compared as text: trimmed, in lower case."""
    return F.lower(_strip(_text(value)))


def numbers_close(x: Column, y: Column, text_x: Column, text_y: Column, relative: str = "0.005", absolute: str = "1.0") -> Column:
    """Equal texts, or numbers within the absolute or the relative tolerance (of their mean size)."""
    same = (text_x == text_y) & (text_x != "")
    near = (F.abs(x - y) <= F.lit(absolute).cast(NUMERIC)) | (F.abs(x - y).cast("decimal(38,10)") * 2 <= F.lit(relative).cast("decimal(6,4)") * (F.abs(x) + F.abs(y)).cast("decimal(30,10)"))
    return F.coalesce(same, F.lit(False)) | F.coalesce(near, F.lit(False))


def values_close(a: Column, b: Column) -> Column:
    """``numbers_close`` of two values as they stand."""
    return numbers_close(numeric(a), numeric(b), bare_text(a), bare_text(b))


def normalize_metric(text: Column) -> Column:
    """Lower case, trimmed, without punctuation, runs of space as one; what punctuation leaves at the ends stays."""
    return F.regexp_replace(F.regexp_replace(_strip(F.lower(_text(text))), rf"(?U)[^\p{{L}}\p{{N}}_\s]", ""), f"(?:{_WS})+", " ")


def normalize_unit(unit: Column) -> Column:
    bare = F.regexp_replace(_strip(F.lower(_text(unit))), r"[^\p{L}\p{N}_%]", "")
    return (
        F.when(bare.isin("cr", "crore", "crores", "inrcr"), "inr_cr")
        .when(bare.isin("lakh", "lakhs", "inrlakh"), "inr_lakh")
        .when(bare.isin("percent", "pct", "%"), "%")
        .when(bare.isin("usd", "dollar", "dollars"), "usd")
        .otherwise(bare)
    )


def normalize_text(text: Column) -> Column:
    """For grounding: lower case, without footnote marks, references, invisible characters and punctuation."""
    t = F.lower(_text(text))
    for pattern in ("[¹²³⁴⁵⁶⁷⁸⁹⁰*†‡]", r"\[\d+\]|\(\d+\)", "[\u200b\u00a0\u00ad]", r"(?U)[^\p{L}\p{N}_\s]", f"(?:{_WS})+"):
        t = F.regexp_replace(t, pattern, " ")
    return _strip(t)


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def content_hash(document: Column, entity: Column, attribute: Column, period: Column, scope: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", document, *(normalize_text(c) for c in (entity, attribute, period, scope, value))), 256)


def canonical_statement(entity: Column, attribute: Column, period: Column, scope: Column, value: Column, unit: Column) -> Column:
    """entity attribute (period) [scope]: value unit, with absent parts left out."""
    optional = lambda c, shown: F.when(_text(c) != "", shown)
    head = F.array(F.trim(_text(entity)), F.when(F.trim(_text(attribute)) != "", F.trim(attribute)), optional(period, F.concat(F.lit("("), F.trim(period), F.lit(")"))), optional(scope, F.concat(F.lit("["), F.trim(scope), F.lit("]"))))
    tail = F.coalesce(optional(unit, F.concat(F.lit(" "), F.trim(unit))), F.lit(""))
    return F.concat(F.array_join(F.filter(head, lambda x: x.isNotNull()), " "), F.lit(": "), F.trim(_text(value)), tail)


def truthy(qualifiers: Column, field: str) -> Column:
    """Whether a field of a JSON text is neither absent, null, false, zero, blank nor empty; a text 'false' is true."""
    v = F.get_json_object(qualifiers, f"$.{field}")
    text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(qualifiers), f"$.{field}", "variant")) == "STRING"
    return F.coalesce(F.when(F.coalesce(text, F.lit(False)), v != "").otherwise(~v.isin("", "false", "0", "0.0", "[]", "{}", "null")), F.lit(False))


def overlap(a: Column, b: Column, stop_words: list[str], clusters: list[list[str]] | None = None) -> Column:
    """Whether normalized names share a word that counts, contain one another or fall in one cluster of synonyms."""
    stop = F.array(*map(F.lit, stop_words))
    ta, tb = F.array_except(tokens(a), stop), F.array_except(tokens(b), stop)
    same = (a == b) | F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(ta, tb)
    for cluster in clusters or []:
        words = F.array(*map(F.lit, cluster))
        same = same | (F.arrays_overlap(ta, words) & F.arrays_overlap(tb, words))
    return (a != "") & (b != "") & same


def _holds(text: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | text.contains(mark)
    return found


def document_type(text: Column) -> Column:
    t, kind = F.lower(_text(text)), F.lit("general_document")
    for name, phrases in reversed(DOCUMENT_TYPES):
        kind = F.when(_holds(t, phrases), name).otherwise(kind)
    return kind


def boilerplate(text: Column) -> Column:
    t = F.lower(_text(text))
    return t.contains("forward-looking statements") & t.contains("safe harbor") & (F.length(_text(text)) < 600)


def error_class(message: Column) -> Column:
    m = F.lower(_text(message))
    return F.when(m == "", F.lit(None).cast("string")).when(_holds(m, RATE_LIMIT_MARKS), "rate_limit").when(_holds(m, TIMEOUT_MARKS), "timeout").otherwise("other")


def backoff_seconds(kind: Column, attempt: Column, retry_after: Column, cap: float = 20.0) -> Column:
    """Seconds to wait: after a rate limit what it asks for and a half, else doubling from 2; after a timeout from 1.5."""
    double = F.pow(F.lit(2.0), attempt - 1)
    return F.when(kind == "rate_limit", F.least(F.coalesce(retry_after + 0.5, 2.0 * double), F.lit(cap))).when(kind == "timeout", F.least(1.5 * double, F.lit(cap)))
