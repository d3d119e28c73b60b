"""Pairwise reconciliation of claims: alignment, an ordered cascade of rules and an audit record.

All of it is one projection over a joined pair; pairs that no rule decides are left to an adjudicator in a separate
branch of the plan, so that no model is called for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions import claims as C

FIELDS = ["id", "document_id", "entity", "attribute", "value", "unit", "period", "scope", "qualifiers", "confidence"]


def prepared(facts: DataFrame) -> DataFrame:
    """(id, claim, said): the claim, and what alignment compares of it, worked out once for each fact."""
    said = F.struct(
        *(C.normalize_metric(F.col(f)).alias(f) for f in ("entity", "attribute", "period", "scope")),
        C.normalize_unit(F.col("unit")).alias("unit"),
        C.numeric(F.col("value")).alias("number"),
        C.decimals(F.col("value")).alias("decimals"),
        C.bare_text(F.col("value")).alias("text"),
        (C.truthy(F.col("qualifiers"), "header_uncertain") | F.coalesce(F.col("confidence") < 0.70, F.lit(False))).alias("uncertain"),
    )
    return facts.select("id", F.struct(*FIELDS).alias("claim"), said.alias("said"))


def pair_claims(pairs: DataFrame, facts: DataFrame, a: str = "fact_a_id", b: str = "fact_b_id") -> DataFrame:
    """Pairs with the claims of both ends as ``a`` and ``b``, ``said_a`` and ``said_b``; pairs with an end that does not exist are left out."""
    held, out = prepared(facts), pairs
    for end, side in ((a, "a"), (b, "b")):
        out = out.join(held.select(F.col("id").alias(end), F.col("claim").alias(side), F.col("said").alias(f"said_{side}")), end)
    return out


def alignment(pairs: DataFrame) -> DataFrame:
    """Pairs with the findings on which the cascade decides."""
    x, y = (lambda f: F.col(f"said_a.{f}")), (lambda f: F.col(f"said_b.{f}"))
    both = lambda f: (x(f) != "") & (y(f) != "")
    diff = F.abs(x("number") - y("number"))
    out = pairs.withColumns(
        {
            "entity_match": C.overlap(x("entity"), y("entity"), C.ENTITY_STOP_WORDS),
            "attribute_match": C.overlap(x("attribute"), y("attribute"), C.ATTRIBUTE_STOP_WORDS, C.SYNONYM_CLUSTERS),
            "has_period_a": x("period") != "",
            "has_period_b": y("period") != "",
            "period_match": both("period") & ((x("period") == y("period")) | F.contains(x("period"), y("period")) | F.contains(y("period"), x("period"))),
            "has_scope_a": x("scope") != "",
            "has_scope_b": y("scope") != "",
            "scope_match": x("scope") == y("scope"),
            "has_unit_a": x("unit") != "",
            "has_unit_b": y("unit") != "",
            "unit_match": ~both("unit") | (x("unit") == y("unit")),
            "value_close": C.numbers_close(x("number"), y("number"), x("text"), y("text")),
            "value_diff": diff,
            "both_numeric": diff.isNotNull(),
            "diff_decimals": F.greatest(x("decimals"), y("decimals")),
            "uncertain": x("uncertain") | y("uncertain"),
        }
    )
    return out.drop("said_a", "said_b")


def _verdict(relation: str, route: str, reason: str | None, confidence: float) -> Column:
    return F.struct(F.lit(relation).alias("relation_type"), F.lit(route).alias("decision_route"), F.lit(reason).cast("string").alias("review_reason"), F.lit(confidence).alias("confidence"))


def cascade(aligned: DataFrame) -> DataFrame:
    """Aligned pairs with ``relation_type, decision_route, review_reason, decision_confidence``; all null where no rule decides.

    Equal numbers whose difference is written with two decimals or more count as rounding: that is how the difference
    would read.
    """
    c = F.col
    exact = (~c("both_numeric")) | ((c("value_diff") == 0) & (c("diff_decimals") <= 1))
    rules = [
        (~c("entity_match") | ~c("attribute_match"), _verdict("UNRELATED", "irrelevant_pre_filter", None, 1.0)),
        (c("period_match") & c("scope_match") & c("unit_match") & c("value_close") & exact, _verdict("CORROBORATES", "deterministic_exact", None, 0.98)),
        (c("period_match") & c("scope_match") & c("unit_match") & c("value_close"), _verdict("CORROBORATES", "deterministic_rounding", None, 0.98)),
        (c("both_numeric") & ~(c("has_period_a") & c("has_period_b")), _verdict("NEEDS_REVIEW", "ambiguity_firewall", "missing_period", 0.95)),
        (c("both_numeric") & ~c("value_close") & ~(c("has_scope_a") & c("has_scope_b")), _verdict("NEEDS_REVIEW", "ambiguity_firewall", "missing_scope_or_basis", 0.95)),
        (c("has_unit_a") & c("has_unit_b") & ~c("unit_match"), _verdict("NEEDS_REVIEW", "ambiguity_firewall", "unit_ambiguity", 0.95)),
        (c("uncertain"), _verdict("NEEDS_REVIEW", "ambiguity_firewall", "header_context_uncertain", 0.90)),
    ]
    case = F.when(*rules[0])
    for condition, verdict in rules[1:]:
        case = case.when(condition, verdict)
    decided = aligned.withColumn("_v", case)
    return decided.withColumns({"relation_type": c("_v.relation_type"), "decision_route": c("_v.decision_route"), "review_reason": c("_v.review_reason"), "decision_confidence": c("_v.confidence")}).drop("_v")


def with_fallback(decided: DataFrame) -> DataFrame:
    """Where no rule decided and no adjudicator is at hand, the pair goes to review."""
    open_ = F.col("relation_type").isNull()
    return decided.withColumns(
        {
            "decision_route": F.when(open_, "ambiguity_firewall").otherwise(F.col("decision_route")),
            "review_reason": F.when(open_, "adjudication_unavailable").otherwise(F.col("review_reason")),
            "decision_confidence": F.when(open_, 0.5).otherwise(F.col("decision_confidence")),
            "relation_type": F.when(open_, "NEEDS_REVIEW").otherwise(F.col("relation_type")),
        }
    )


def missing_sides(a: Column, b: Column) -> Column:
    """'Fact A', 'Fact B' or 'Fact A and Fact B': the sides on which something is missing."""
    return F.array_join(F.filter(F.array(F.when(~a, "Fact A"), F.when(~b, "Fact B")), lambda x: x.isNotNull()), " and ")


def snapshot(aligned: DataFrame) -> DataFrame:
    """Aligned pairs with ``snapshot``: both claims, the findings and the tolerances, for the audit trail."""
    found = F.struct("entity_match", "attribute_match", "has_period_a", "has_period_b", "period_match", "has_scope_a", "has_scope_b", "scope_match", "has_unit_a", "has_unit_b", "unit_match", "value_close", F.col("value_diff").cast("string").alias("value_diff"))
    tolerance = F.struct(F.lit(0.005).alias("relative"), F.lit(1.0).alias("absolute"))
    return aligned.withColumn("snapshot", F.struct(F.col("a").alias("fact_a"), F.col("b").alias("fact_b"), found.alias("alignment"), tolerance.alias("tolerance")))


def explanation(decided: DataFrame) -> Column:
    """A sentence on why a pair was decided as it was."""
    c = F.col
    said = lambda side: F.concat_ws(" ", c(f"{side}.value"), F.nullif(F.coalesce(c(f"{side}.unit"), F.lit("")), F.lit("")))
    about = F.concat(F.coalesce(c("a.attribute"), F.lit("")), F.lit(" of "), F.coalesce(c("a.entity"), F.lit("")))
    return (
        F.when(c("decision_route") == "irrelevant_pre_filter", F.concat(F.lit("Different subjects: "), about, F.lit(" and "), F.coalesce(c("b.attribute"), F.lit("")), F.lit(" of "), F.coalesce(c("b.entity"), F.lit(""))))
        .when(c("relation_type") == "CORROBORATES", F.concat(F.lit("Both state "), about, F.lit(" ("), F.coalesce(F.nullif(c("a.scope"), F.lit("")), F.lit("standard")), F.lit(") as "), said("a"), F.when(c("decision_route") == "deterministic_exact", "").otherwise(F.concat(F.lit(", within rounding of "), said("b")))))
        .when(c("review_reason") == "missing_period", F.concat(F.lit("No period on "), missing_sides(c("has_period_a"), c("has_period_b"))))
        .when(c("review_reason") == "missing_scope_or_basis", F.concat(said("a"), F.lit(" against "), said("b"), F.lit(": no scope on "), missing_sides(c("has_scope_a"), c("has_scope_b"))))
        .when(c("review_reason") == "unit_ambiguity", F.concat(F.lit("Units differ: "), said("a"), F.lit(" and "), said("b")))
        .when(c("review_reason") == "header_context_uncertain", F.lit("The header or the extraction is uncertain"))
        .otherwise(F.lit("No rule applies"))
    )


def alignment_matrix(aligned: DataFrame, key: str) -> DataFrame:
    """(key, dimension, status, reason, difference): one row for each of the six dimensions on which a pair is compared.

    ``reason`` says what blocks a comparison; ``difference`` is that of the values where both are numbers.
    """
    c, none = F.col, F.lit(None).cast("string")
    passed = lambda ok, other: (F.when(ok, "PASS").otherwise(other), none)

    def sided(f: str, other: str, reason: str) -> tuple[Column, Column]:
        blocked = ~(c(f"has_{f}_a") & c(f"has_{f}_b"))
        return F.when(blocked, "BLOCKED").when(c(f"{f}_match"), "PASS").otherwise(other), F.when(blocked, reason)

    found = {
        "entity": passed(c("entity_match"), "MISMATCH"),
        "attribute": passed(c("attribute_match"), "MISMATCH"),
        "period": sided("period", "DIFFERENT PERIODS", "period missing"),
        "scope": sided("scope", "DIFFERENT SCOPES", "scope unstated"),
        "unit": (F.when(c("unit_match"), "PASS").otherwise("BLOCKED"), F.when(~c("unit_match"), "units incompatible")),
        "value": passed(c("value_close"), "MATERIAL DIFFERENCE"),
    }
    rows = (F.struct(F.lit(k).alias("dimension"), status.alias("status"), reason.alias("reason"), (c("value_diff").cast("double") if k == "value" else F.lit(None).cast("double")).alias("difference")) for k, (status, reason) in found.items())
    return aligned.select(key, F.explode(F.array(*rows)).alias("_m")).select(key, "_m.*")


def deterministic_check(aligned: DataFrame) -> DataFrame:
    """Aligned pairs that the rules corroborate without looking at units, with their route."""
    c = F.col
    kept = aligned.where(c("entity_match") & c("attribute_match") & c("period_match") & c("scope_match") & c("value_close"))
    exact = ~c("both_numeric") | ((c("value_diff") == 0) & (c("diff_decimals") <= 1))
    return kept.withColumns({"relation_type": F.lit("CORROBORATES"), "decision_route": F.when(exact, "deterministic_exact").otherwise("deterministic_rounding"), "decision_confidence": F.lit(0.98)})


def stored(decided: DataFrame) -> DataFrame:
    """Verdicts as they are written: all but UNRELATED, with the explanation, the snapshot as JSON and both confidences."""
    kept = decided.where("relation_type <> 'UNRELATED'")
    shown = snapshot(kept).withColumn("explanation", explanation(kept))
    return shown.select("fact_a_id", "fact_b_id", "relation_type", "explanation", F.col("decision_confidence").alias("confidence"), "decision_route", "review_reason", F.to_json("snapshot").alias("comparison_snapshot"), F.col("a.confidence").alias("extraction_confidence_a"), F.col("b.confidence").alias("extraction_confidence_b"))
