"""Whether a claim's quotation stands in its chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions import claims as C


def ground(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, is_valid, grounded_confidence, reason) of each fact, by its own chunk; without one the chunk is empty.

    Texts are normalized on each side before the join, so each chunk is normalized once.
    """
    held = chunks.select(F.col("id").alias("chunk_id"), C.normalize_text(F.col("raw_text")).alias("_c"))
    asked = facts.select("id", "chunk_id", F.coalesce("confidence", F.lit(1.0)).alias("_k"), F.coalesce(F.col("evidence_quote"), F.lit("")).alias("_raw"), C.normalize_text(F.col("evidence_quote")).alias("_q"), (F.get_json_object("qualifiers", "$.extraction_path") == "vision").alias("_vision"))
    both = asked.join(held, "chunk_id", "left").withColumn("_c", F.coalesce("_c", F.lit("")))
    words = C.tokens(F.col("_q"))
    n = F.size(words)
    hit = F.size(F.filter(words, lambda w: F.contains(F.col("_c"), w)))
    share = hit / F.greatest(n, F.lit(1))
    c = F.col
    verdict = lambda ok, confidence, reason: F.struct(F.lit(ok).alias("v"), confidence.alias("k"), F.lit(reason).alias("r"))
    lowered = F.round(F.greatest(F.lit(0.3), c("_k") * F.when(share >= 0.85, 0.95).otherwise(0.90)), 2)
    case = (
        F.when(F.coalesce(c("_vision"), F.lit(False)), verdict(True, F.round(F.least(c("_k"), F.lit(0.7)), 2), "vision"))
        .when(F.regexp_replace(c("_raw"), r"(?U)\s", "") == "", verdict(False, F.lit(0.0), "empty"))
        .when(F.contains(c("_c"), c("_q")), verdict(True, c("_k"), "exact"))
        .when((n <= 2) & ((hit == n) | F.contains(F.replace(c("_c"), F.lit(" "), F.lit("")), c("_q"))), verdict(True, c("_k"), "short"))
        .when(share >= 0.70, verdict(True, lowered, "words"))
        .otherwise(verdict(False, F.lit(0.2), "absent"))
    )
    return both.select("id", case.alias("_v")).select("id", F.col("_v.v").alias("is_valid"), F.col("_v.k").alias("grounded_confidence"), F.col("_v.r").alias("reason"))


def first_by_hash(facts: DataFrame, hashed: Column) -> DataFrame:
    """(content_key, id, copies): the first fact of each content hash (by creation, then id), and how many share it."""
    keyed = facts.withColumn("content_key", hashed)
    return keyed.groupBy("content_key").agg(F.min(F.struct("created_at", "id")).alias("_f"), F.count(F.lit(1)).alias("copies")).select("content_key", F.col("_f.id").alias("id"), "copies")
