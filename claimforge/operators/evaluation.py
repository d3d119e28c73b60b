"""How verdicts compare with expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(cases: DataFrame) -> DataFrame:
    """One row of metrics of (expected_relation, expected_route, actual_relation, actual_route, must_not_be).

    Accuracy and rates are 0 for no cases, review recall is 1 and unsafe decisions 0 if nothing needs review; a null
    expected route counts as met. Case by case: equality, and whether a relation is one that must not be.
    """
    n = F.count(F.lit(1))
    right = F.count_if(F.col("actual_relation") == F.col("expected_relation"))
    unsafe = F.col("expected_relation") == "NEEDS_REVIEW"
    blocked = F.count_if(unsafe & (F.col("actual_relation") == "NEEDS_REVIEW"))
    ratio = lambda x, y, none: F.round(F.when(y == 0, none).otherwise(x / y), 4)
    return cases.agg(
        n.alias("cases"),
        ratio(right, n, 0.0).alias("relationship_accuracy"),
        F.count_if(F.col("expected_route").isNull() | (F.col("actual_route") == F.col("expected_route"))).alias("routes_met"),
        ratio(F.count_if(F.col("actual_route") != "llm_adjudication"), n, 0.0).alias("llm_avoidance_rate"),
        F.count_if(unsafe).alias("unsafe_cases"),
        ratio(blocked, F.count_if(unsafe), 1.0).alias("review_recall"),
        ratio(F.count_if(unsafe & (F.col("actual_relation") != "NEEDS_REVIEW")), F.count_if(unsafe), 0.0).alias("unsafe_auto_decision_rate"),
        F.count_if(F.array_contains("must_not_be", F.col("actual_relation"))).alias("safety_violations"),
    )


def details(cases: DataFrame) -> DataFrame:
    """One row for each case of ``metrics`` (with ``id``, ``expected_reason`` and ``actual_reason``): what is right and what must not be.

    A null expected route or reason counts as met.
    """
    met = lambda f: F.coalesce(F.col(f"actual_{f}") == F.col(f"expected_{f}"), F.col(f"expected_{f}").isNull())
    return cases.select(
        "id",
        *(f"{side}_{f}" for f in ("relation", "route", "reason") for side in ("expected", "actual")),
        met("relation").alias("relation_met"),
        met("route").alias("route_met"),
        met("reason").alias("reason_met"),
        F.array_contains("must_not_be", F.col("actual_relation")).alias("safety_violation"),
    )
