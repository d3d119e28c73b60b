"""Documents to facts and relationships: the steps of an ingest in their order, each a table.

Every step is a plan over whole tables of documents, not a loop over them; what several steps use is written once to
the shared folder, so a lost executor costs one step. Extraction is passed in: a function from chunks to claims. It
is handed the type of each chunk's document and gives claims and, for chunks, how the call ended.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions import claims as C
from claimforge.operators import chunking, grounding, ledger, reconcile
from claimforge.session import Scratch

#: Ends of a call for a chunk that count as failed.
FAILED = ("rate_limited", "extraction_failed", "timed_out", "cancelled")
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
Pairing = Callable[[DataFrame], DataFrame]


class Ingested(NamedTuple):
    """What an ingest gives, to be appended to the ledger's tables."""

    chunks: DataFrame
    facts: DataFrame
    documents: DataFrame
    relationships: DataFrame


def parsed_chunks(fragments: DataFrame) -> DataFrame:
    """Chunks of page fragments (document_id, page_number, id, raw_text, is_table, image_ref), packed, with state 'pending'.

    A chunk's id is made of its document, page and place, so that a run that is repeated makes the same ones.
    """
    seen = fragments.withColumn("needs_vision", chunking.needs_vision(F.col("raw_text"), F.col("image_ref").isNotNull().cast("int")))
    packed = chunking.pack_fragments(seen, ["document_id", "page_number"], ["id"], "raw_text", any_of=["is_table", "needs_vision"], first_of=["image_ref"])
    own = F.sha2(F.concat_ws("|", "document_id", F.col("page_number").cast("string"), F.col("chunk_no").cast("string")), 256)
    return packed.withColumnRenamed("chunk_text", "raw_text").withColumns({"id": own, "extraction_status": F.lit("pending")})


def typed_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with ``doc_type``, the type of their document by its first three pages."""
    types = chunking.first_pages_text(chunks, "document_id", "page_number", "id", "raw_text").select("document_id", C.document_type(F.col("first_text")).alias("doc_type"))
    return chunks.join(types, "document_id")


def chunk_status(facts: Column, call: Column) -> Column:
    """How the extraction of a chunk ended: failed only if the call failed and gave no facts."""
    return F.when((F.coalesce(facts, F.lit(0)) == 0) & call.isin(*FAILED), call).otherwise("success")


def chunk_states(chunks: DataFrame, claims: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, document_id, facts, extraction_status) of each chunk, from its claims and the end of its call."""
    n = claims.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("facts"))
    seen = chunks.select("id", "document_id").join(n.withColumnRenamed("chunk_id", "id"), "id", "left").join(calls.select(F.col("chunk_id").alias("id"), "call"), "id", "left")
    return seen.select("id", "document_id", F.coalesce("facts", F.lit(0)).alias("facts"), chunk_status(F.col("facts"), F.col("call")).alias("extraction_status"))


def verified_facts(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims whose quotation stands in their chunk, the first of each content hash, with the lowered confidence."""
    hashed = C.content_hash(*(F.col(c) for c in ("document_id", "entity", "attribute", "period", "scope", "value")))
    valid = grounding.ground(claims, chunks).where("is_valid").select("id", "grounded_confidence")
    held = claims.join(valid, "id")
    first = grounding.first_by_hash(held, hashed).select("id", F.col("content_key").alias("content_hash"))
    return held.drop("content_hash").join(first, "id").withColumn("confidence", F.col("grounded_confidence")).drop("grounded_confidence")


def document_states(documents: DataFrame, states: DataFrame, facts: DataFrame) -> DataFrame:
    """(document_id, status, error_message, facts, failed_chunks) of each document after its ingest.

    DONE with facts (with a warning if chunks failed), FAILED without facts if chunks failed, else DONE_EMPTY.
    """
    failed = states.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("extraction_status").isin(*FAILED)).alias("failed_chunks"))
    n = facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    seen = documents.select(F.col("id").alias("document_id")).join(failed, "document_id", "left").join(n, "document_id", "left").select("document_id", zero("facts").alias("facts"), zero("chunks").alias("chunks"), zero("failed_chunks").alias("failed_chunks"))
    said = lambda *parts: F.concat(*(F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts))
    some = F.col("failed_chunks") > 0
    return seen.select(
        "document_id",
        F.when(F.col("facts") > 0, "DONE").when(some, "FAILED").otherwise("DONE_EMPTY").alias("status"),
        F.when((F.col("facts") > 0) & some, said("$failed_chunks", " of ", "$chunks", " chunks failed; ", "$facts", " facts"))
        .when(F.col("facts") > 0, F.lit(None).cast("string"))
        .when(some, said("no facts, ", "$failed_chunks", " of ", "$chunks", " chunks failed"))
        .otherwise(said("no facts in ", "$chunks", " chunks"))
        .alias("error_message"),
        "facts",
        "failed_chunks",
    )


def new_relationships(pairs: DataFrame, facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Verdicts on candidate pairs (fact_a_id, fact_b_id) as they are written: each unordered pair once, no fact with itself,
    none of one document, none that is known already, none that is unrelated.
    """
    fresh = ledger.new_pairs(pairs, known if known is not None else pairs.limit(0), "fact_a_id", "fact_b_id")
    aligned = reconcile.alignment(reconcile.pair_claims(fresh.select(F.col("low").alias("fact_a_id"), F.col("high").alias("fact_b_id")), facts))
    apart = aligned.where(F.col("a.document_id") != F.col("b.document_id"))
    return reconcile.stored(reconcile.with_fallback(reconcile.cascade(apart)))


def ingest(documents: DataFrame, chunks: DataFrame, extract: Extractor, pair: Pairing, known: DataFrame | None = None, earlier: DataFrame | None = None) -> Ingested:
    """All steps: types, extraction, grounding, first by hash, states, candidates, cascade.

    ``documents`` (id) and ``chunks`` (id, document_id, page_number, raw_text) are the new ones; ``extract`` gives claims
    (the columns of facts) and calls (chunk_id, call); ``pair`` gives candidate pairs of the verified facts, which may
    reach into ``earlier`` ones; ``known`` are pairs judged before. Documents without chunks end as DONE_EMPTY. Running an
    ingest again gives the same tables.
    """
    scratch = Scratch(documents.sparkSession, "ingest")
    claims, calls = extract(typed_chunks(chunks))
    claims = scratch.write(claims, "claims")
    facts = scratch.write(verified_facts(claims, chunks), "facts")
    states = scratch.write(chunk_states(chunks, claims, calls), "states")
    within = facts if earlier is None else facts.unionByName(earlier, allowMissingColumns=True)
    return Ingested(states, facts, document_states(documents, states, facts), new_relationships(pair(facts), within, known))


def write_ingested(done: Ingested, folder: str) -> None:
    """The tables appended under a folder, one write each; documents come last, so a document that is there is whole."""
    for name in ("chunks", "facts", "relationships", "documents"):
        getattr(done, name).write.mode("append").parquet(f"{folder}/{name}")


def status_log(documents: DataFrame, chunks: DataFrame, facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """(document_id, step, status): the states that a document has gone through, as its rows in the ledger show."""
    ends = relationships.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("id")).distinct()
    reached = [
        (documents.select(F.col("id").alias("document_id")), 0, "QUEUED"),
        (chunks.select("document_id").distinct(), 1, "CHUNKING"),
        (chunks.where("extraction_status is not null and extraction_status <> 'pending'").select("document_id").distinct(), 2, "EXTRACTING"),
        (facts.join(ends, "id", "left_semi").select("document_id").distinct(), 3, "RECONCILING"),
    ]
    log = None
    for rows, step, status in reached:
        rows = rows.select("document_id", F.lit(step).alias("step"), F.lit(status).alias("status"))
        log = rows if log is None else log.unionByName(rows)
    final = F.upper(F.trim("status"))
    return log.unionByName(documents.where(final.isin("DONE", "DONE_EMPTY", "FAILED")).select(F.col("id").alias("document_id"), F.lit(4).alias("step"), final.alias("status")))


def last_status(log: DataFrame) -> DataFrame:
    """(document_id, status, steps): the last state of each document, and how many it has gone through."""
    return log.groupBy("document_id").agg(F.max_by("status", "step").alias("status"), F.count(F.lit(1)).alias("steps"))
