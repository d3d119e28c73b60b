"""Queries over the ledger: filtered listings, hydrated pairs, counts and summaries.

Optional filters join the plan only if given, limits are applied before rows are hydrated, and joins on either end of
a relationship explode the two ends instead of joining on a disjunction. Redelivered rows are equal, so rows are
filtered first, where the scan can do it, and only what is left is reduced to one row of an id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimforge.session import Scratch
from claimforge.sources.tables import once


def _all(conditions: list[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def _limited(n: int, most: int = 500) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"the limit must lie between 1 and {most}")
    return n


def relation_kind(c: Column) -> Column:
    """The type of a relationship, however it is spelled."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*relationtype\.", ""), "[^A-Za-z_]+", ""))


def _page(rows: DataFrame, limit: int) -> DataFrame:
    """The newest rows, at most some hundred, written once so that what is joined to them can be narrowed to them first."""
    return Scratch(rows.sparkSession, "page").write(once(rows).orderBy(F.desc("created_at"), "id").limit(_limited(limit)), "rows")


def _only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of a table with the few ids of a page, each id once."""
    ids = ids.toDF("_id").where("_id is not null").distinct()
    return once(df.join(F.broadcast(ids), F.col(key) == F.col("_id"), "left_semi"), key)


def list_facts(facts: DataFrame, chunks: DataFrame, uploads: DataFrame, document_id: str | None = None, entity: str | None = None, attribute: str | None = None, limit: int = 100) -> DataFrame:
    """Facts by optional filters (texts as case-insensitive substrings with live wildcards), with page and file name.

    The tables may hold redelivered rows.
    """
    kept = facts.where(_all([F.col("document_id") == document_id if document_id else None, F.col("entity").ilike(f"%{entity}%") if entity else None, F.col("attribute").ilike(f"%{attribute}%") if attribute else None]))
    top = _page(kept, limit)
    pages = _only(chunks.select("id", "page_number", "image_ref"), "id", top.select("chunk_id")).withColumnRenamed("id", "chunk_id")
    files = _only(uploads.select("id", "filename"), "id", top.select("document_id")).withColumnRenamed("id", "document_id")
    return top.join(F.broadcast(pages), "chunk_id", "left").join(F.broadcast(files), "document_id", "left").withColumn("qualifiers", F.coalesce("qualifiers", F.lit("{}")))


def hydrate(relationships: DataFrame, facts: DataFrame, chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """Relationships with fact, page and file name of both ends; ends that do not exist are null."""
    pages = chunks.select(F.col("id").alias("chunk_id"), "page_number")
    files = uploads.select(F.col("id").alias("document_id"), "filename")
    held = facts.select("id", "entity", "attribute", "value", "unit", "period", "scope", "chunk_id", "document_id").join(pages, "chunk_id", "left").join(files, "document_id", "left").drop("chunk_id")
    out = relationships
    for side in "ab":
        own = held.select([F.col(c).alias(f"{c}_{side}" if c != "id" else f"fact_{side}_id") for c in held.columns])
        out = out.join(own, f"fact_{side}_id", "left")
    return out


def hydrate_page(top: DataFrame, facts: DataFrame, chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """``hydrate`` for a page of relationships: the tables, redelivered rows and all, are narrowed to its ends first."""
    ends = top.select(F.explode(F.array("fact_a_id", "fact_b_id")))
    scratch = Scratch(top.sparkSession, "page")
    held = scratch.write(_only(facts, "id", ends), "facts")
    pages = _only(chunks.select("id", "page_number"), "id", held.select("chunk_id"))
    files = _only(uploads.select("id", "filename"), "id", held.select("document_id"))
    return hydrate(top, held, pages, files)


def nested(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Relationships with the facts of both ends as structs ``fact_a`` and ``fact_b``, null where an end does not exist."""
    out = relationships
    for side in "ab":
        out = out.join(facts.select(F.col("id").alias(f"fact_{side}_id"), F.struct(*facts.columns).alias(f"fact_{side}")), f"fact_{side}_id", "left")
    return out


def by_id(rows: DataFrame, key: str) -> DataFrame:
    """The row with an id, or an error where there is none; the scan gets the filter."""
    found = Scratch(rows.sparkSession, "lookup").write(once(rows.where(F.col("id") == key)), "row")
    if not found.take(1):
        raise LookupError(f"no row has the id {key}")
    return found


def document_status(uploads: DataFrame, facts: DataFrame, relationships: DataFrame, document_id: str) -> DataFrame:
    """State and counts of one document: only its facts are read, and relationships that touch them."""
    document, own = by_id(uploads, document_id), Scratch(facts.sparkSession, "lookup").write(once(facts.where(F.col("document_id") == document_id)).select("id"), "facts")
    # The facts of one document number some hundred; Spark checks their size before it broadcasts them.
    ends = relationships.select(F.col("id").alias("rel"), F.explode(F.array("fact_a_id", "fact_b_id")).alias("end")).join(own.select(F.col("id").alias("end")), "end", "left_semi")
    counts = [rows.agg(n).withColumn("_k", F.lit(1)) for rows, n in ((own, F.count(F.lit(1)).alias("facts")), (ends, F.count_distinct("rel").alias("relationships")))]
    shown = document.select(F.col("id").alias("document_id"), "filename", F.upper("status").alias("status"), "page_count", "doc_type_guess", "error_message", F.lit(1).alias("_k"))
    return shown.join(counts[0], "_k").join(counts[1], "_k").drop("_k")


def list_relationships(relationships: DataFrame, facts: DataFrame, chunks: DataFrame, uploads: DataFrame, kind: str = "ALL", routes: list[str] | None = None, reason: str | None = None, search: str | None = None, document_id: str | None = None, limit: int = 100) -> DataFrame:
    """Newest relationships by optional filters, hydrated after the limit. 'ALL' is no filter.

    The tables may hold redelivered rows.
    """
    kept = relationships.where(_all([F.col("decision_route").isin(routes) if routes else None, F.col("review_reason") == reason if reason else None]))
    kept = kept.withColumn("relation_type", relation_kind(F.col("relation_type"))).where(_all([F.col("relation_type") == kind if kind != "ALL" else None]))
    if search or document_id:
        hit = facts.where(_all([F.col("entity").ilike(f"%{search}%") | F.col("attribute").ilike(f"%{search}%") if search else None, F.col("document_id") == document_id if document_id else None])).select(F.col("id").alias("end"))
        ends = kept.select("id", F.explode(F.array("fact_a_id", "fact_b_id")).alias("end")).join(hit, "end", "left_semi").select("id").distinct()
        kept = kept.join(ends, "id", "left_semi")
    return hydrate_page(_page(kept, limit), facts, chunks, uploads)


def document_counts(uploads: DataFrame, facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """Each upload with its facts and the different relationships that touch it."""
    n_facts = facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"))
    ends = relationships.select(F.col("id").alias("rel"), F.explode(F.array_distinct(F.array("fact_a_id", "fact_b_id"))).alias("fact"))
    pairs = ends.join(facts.select(F.col("id").alias("fact"), "document_id"), "fact").select("document_id", "rel").distinct()
    n_rels = pairs.groupBy("document_id").agg(F.count(F.lit(1)).alias("relationships"))
    out = uploads.join(n_facts, uploads.id == n_facts.document_id, "left").drop("document_id").join(n_rels, uploads.id == n_rels.document_id, "left")
    return out.select("id", "filename", F.upper("status").alias("status"), "upload_ts", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("relationships", F.lit(0)).alias("relationships"))


def newest_per_type(relationships: DataFrame, n: int = 3) -> DataFrame:
    kind = relationships.withColumn("relation_type", relation_kind(F.col("relation_type")))
    rank = F.row_number().over(Window.partitionBy("relation_type").orderBy(F.desc("created_at"), "id"))
    return kind.withColumn("rank", rank).where(F.col("rank") <= n).select("relation_type", "rank", "id")


def summary(uploads: DataFrame, facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: documents, facts, stored pairs, pairs decided without a model, their share, and pairs held for review."""
    pairs = relationships.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("decision_route").isin("deterministic_exact", "deterministic_rounding", "irrelevant_pre_filter", "ambiguity_firewall")).alias("avoided"),
        F.count_if(relation_kind(F.col("relation_type")) == "NEEDS_REVIEW").alias("in_review"),
    )
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    rows = one(uploads, "documents").withColumn("k", F.lit(1)).join(one(facts, "facts").withColumn("k", F.lit(1)), "k").join(pairs.withColumn("k", F.lit(1)), "k").drop("k")
    return rows.withColumn("avoided_percent", F.round(F.col("avoided") / F.greatest("pairs", F.lit(1)) * 100, 4))


def chunk_outcomes(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """For each document the histogram of extraction outcomes as text, failed chunks, facts and the verdict they lead to."""
    status = F.when(F.coalesce("extraction_status", F.lit("")) == "", "unknown").otherwise(F.col("extraction_status"))
    by = chunks.groupBy("document_id", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    failed = F.coalesce(F.sum(F.when(F.col("status").isin("rate_limited", "extraction_failed", "timed_out", "cancelled"), F.col("n"))), F.lit(0))
    outcomes = by.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda s: F.concat(s["status"], F.lit(": "), s["n"].cast("string"))), ", ").alias("histogram"), failed.alias("failed"))
    n = facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"))
    out = outcomes.join(n, "document_id", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))
    return out.withColumn("verdict", F.when(F.col("facts") > 0, "DONE").when(F.col("failed") > 0, "FAILED").otherwise("DONE_EMPTY"))


def new_pairs(pairs: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs of different ends, each once, that are not among the known ones in either order."""
    key = lambda df, x, y: df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("low"), F.greatest(x, y).alias("high"))
    return key(pairs, a, b).distinct().join(key(known, "fact_a_id", "fact_b_id"), ["low", "high"], "left_anti")


def upload_decisions(arrivals: DataFrame, uploads: DataFrame) -> DataFrame:
    """(upload_id, decision, document_id): whether the content of an arrival is new, known, in work or to be taken again.

    The oldest known document of equal content decides; DONE_EMPTY counts as done. An arrival without a hash is new.
    """
    known = uploads.where("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct("upload_ts", "id", F.upper("status").alias("status"))).alias("_d"))
    status = F.col("_d.status")
    decision = F.when(status.isNull(), "new").when(status.isin("DONE", "DONE_EMPTY"), "known").when(status == "FAILED", "again").otherwise("in_work")
    return arrivals.join(known, "content_hash", "left").select("upload_id", decision.alias("decision"), F.col("_d.id").alias("document_id"))


def purge(documents: DataFrame, facts: DataFrame, chunks: DataFrame, relationships: DataFrame) -> DataFrame:
    """(kind, id): what goes with the documents: their chunks and facts, and relationships with such a fact at either end."""
    gone_facts = facts.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id")
    gone_chunks = chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id")
    ends = relationships.select("id", F.explode(F.array("fact_a_id", "fact_b_id")).alias("end"))
    gone_pairs = ends.join(gone_facts.select(F.col("id").alias("end")), "end", "left_semi").select("id").distinct()
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    return named(gone_facts, "fact").unionByName(named(gone_chunks, "chunk")).unionByName(named(gone_pairs, "relationship"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each key: an upsert without a table format; the order must not leave ties."""
    value = F.struct(*order, *(c for c in rows.columns if c not in order and c != key))
    return rows.groupBy(key).agg(F.max(value).alias("_v")).select(key, *(F.col(f"_v.{c}").alias(c) for c in rows.columns if c != key))
