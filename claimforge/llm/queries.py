"""Queries of the subpackage over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.llm.canonical import map_to_canonical
from claimforge.llm.formatting import formatting_copies, formatting_groups
from claimforge.llm.groups import connected_groups
from claimforge.llm.leaks import find_leaks
from claimforge.llm.lookalikes import to_plain_text
from claimforge.llm.mixing import mix_documents, mix_shares
from claimforge.llm.names import link_names, name_pairs
from claimforge.llm.quality import score_quality
from claimforge.llm.splitting import split_oversized
from claimforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def free_values(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "facts", "id", "period", "scope")
    return facts.select(F.col("id").alias("fact_id"), F.explode(F.array(F.struct(F.lit("period").alias("field"), F.col("period").alias("value")), F.struct(F.lit("scope").alias("field"), F.col("scope").alias("value")))).alias("v")).select("fact_id", "v.field", "v.value")


def mapped(spark: SparkSession, d: str) -> DataFrame:
    """Free-entered values that are no term as they stand; a redelivered fact counts once."""
    terms = table(spark, d, "ref_terms")
    typed = free_values(spark, d).join(F.broadcast(terms.select("field", F.col("term").alias("value"))), ["field", "value"], "left_anti")
    return map_to_canonical(typed, terms, ["fact_id"]).dropDuplicates(["fact_id", "field"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).select("fact_id", "field", "term_id")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that no entry fits, with the number of facts that have them."""
    return mapped(spark, d).where("term_id = 0").groupBy("field", "value").agg(F.count(F.lit(1)).alias("facts"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    return link_names(table(spark, d, "facts", "entity"), "entity")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(p2_entities(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_copies(table(spark, d, "facts", "id", "entity", "attribute", "canonical_statement"), "id", ["entity", "attribute"], ["canonical_statement"])


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatting_groups(table(spark, d, "facts", "id", "entity", "attribute", "canonical_statement"), "id", ["entity", "attribute"], ["canonical_statement"])


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks", "id", "raw_text", "is_table"), "id", "raw_text", "is_table")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(table(spark, d, "chunks", "id", "raw_text", "is_table"), "id", "raw_text", "is_table", with_text=False)
    return pieces.where("piece_no = 1").select(F.col("id").alias("chunk_id"))


def both_texts(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "facts", "id", "evidence_quote").select(F.lit("facts").alias("src"), F.col("id").alias("row_id"), F.col("evidence_quote").alias("text"))
    return quotes.unionByName(table(spark, d, "chunks", "id", "raw_text").select(F.lit("chunks").alias("src"), F.col("id").alias("row_id"), F.col("raw_text").alias("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return to_plain_text(both_texts(spark, d), "text", ["src", "row_id"], changed_only=True).select("src", "row_id").distinct()


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    """Each text in its consistent form; rows delivered twice come out twice."""
    return to_plain_text(both_texts(spark, d), "text", ["src", "row_id"])


def links(spark: SparkSession, d: str) -> DataFrame:
    """Relationships of a linking type, however spelled, between two different facts that exist."""
    kind = F.upper(F.regexp_replace("relation_type", r"^\s*(?i:RelationType\.)?|[^A-Za-z]+", ""))
    found = table(spark, d, "relationships", "fact_a_id", "fact_b_id", "relation_type").where(kind.isin("CORROBORATES", "RECONCILED") & (F.col("fact_a_id") != F.col("fact_b_id")))
    found = found.select(F.least("fact_a_id", "fact_b_id").alias("fact_a_id"), F.greatest("fact_a_id", "fact_b_id").alias("fact_b_id")).distinct()
    facts = table(spark, d, "facts", "id")
    return found.join(facts, found.fact_a_id == facts.id, "left_semi").join(facts, found.fact_b_id == facts.id, "left_semi")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_groups(links(spark, d), "fact_a_id", "fact_b_id").where("member <> group_id").select("group_id", F.col("member").alias("fact_id"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and the largest share."""
    return p8_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("share").alias("largest_share"))


def _tokenizer(spark: SparkSession) -> str:
    """The vocabulary file of a public tokenizer that the session names."""
    return spark.conf.get("spark.claimforge.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"), _tokenizer(spark))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_shares(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"), _tokenizer(spark))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return score_quality(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "doc_labels", "doc_id", "label"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    from claimforge.llm.oracle import SQL

    return SQL
