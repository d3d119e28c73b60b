"""Registered core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.functions import claims as C
from claimforge.operators import adjudicate, chunking, embedding, evaluation, grounding, ingest, ledger, reconcile, similarity
from claimforge.operators.quantities import same_quantities, to_base_units
from claimforge.plans.oracle import SQL
from claimforge.sources.tables import once, table
from claimforge.streaming import ingest as streams

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}
_ROUTES = ["deterministic_exact", "deterministic_rounding"]


def query(f: Query) -> Query:
    _REGISTERED[f.__name__] = f
    return f


def facts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(spark, d, "facts", *(("id", *columns) if columns else ())))


def relationships(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(spark, d, "relationships", *(("id", *columns) if columns else ())))


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(spark, d, "chunks", *(("id", *columns) if columns else ())))


def uploads(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once(table(spark, d, "uploads", *(("id", *columns) if columns else ())))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    held = facts(spark, d, "document_id", "entity", "attribute", "value", "unit", "period", "scope", "qualifiers", "confidence")
    return reconcile.alignment(reconcile.pair_claims(relationships(spark, d, "fact_a_id", "fact_b_id"), held))


def _hash() -> Column:
    return C.content_hash(*(F.col(c) for c in ("document_id", "entity", "attribute", "period", "scope", "value")))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "facts", "id", "entity", "attribute", "period", "scope", "value", "unit", "evidence_quote")
    pairs = same_quantities(held, table(spark, d, "ref_units"), "id", ["entity", "attribute", "period", "scope"])
    return pairs.select(pairs.a.alias("fact_a_id"), pairs.b.alias("fact_b_id"))


@query
def p7_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Each fact's quantity in the base unit of its dimension; a redelivered fact counts once."""
    return once(to_base_units(table(spark, d, "facts", "id", "value", "unit", "evidence_quote"), table(spark, d, "ref_units"), ["id"]))


@query
def normalize_text_quotes(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "evidence_quote").select("id", C.normalize_text(F.col("evidence_quote")).alias("quote"))


@query
def normalize_metric_names(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "entity", "attribute").select("id", *(C.normalize_metric(F.col(c)).alias(c) for c in ("entity", "attribute")))


@query
def normalize_units(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "unit").groupBy(C.normalize_unit(F.col("unit")).alias("unit_key")).agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("unit").alias("spellings"))


@query
def extract_numeric_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return facts(spark, d, "value").select("id", C.numeric(v).cast("double").alias("number"), C.decimals(v).alias("decimals"))


@query
def numeric_tolerance_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a.value"), F.col("b.value")
    pairs = reconcile.pair_claims(relationships(spark, d, "fact_a_id", "fact_b_id"), facts(spark, d, *reconcile.FIELDS[1:]))
    return pairs.select("id", C.numeric_diff(a, b).cast("double").alias("diff"), C.values_close(a, b).alias("is_close"))


@query
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return grounding.first_by_hash(facts(spark, d, "document_id", "entity", "attribute", "period", "scope", "value", "created_at"), _hash())


@query
def document_sha256_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query
def canonical_statements(spark: SparkSession, d: str) -> DataFrame:
    held = facts(spark, d, "entity", "attribute", "period", "scope", "value", "unit", "canonical_statement")
    built = C.canonical_statement(*(F.col(c) for c in ("entity", "attribute", "period", "scope", "value", "unit")))
    return held.select("id", built.alias("statement"), F.coalesce(built == F.col("canonical_statement"), F.lit(False)).alias("as_stored"))


@query
def doc_type_guess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", C.document_type(F.col("text")).alias("doc_type"))


@query
def boilerplate_filter(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "raw_text").select("id", C.boilerplate(F.col("raw_text")).alias("is_boilerplate"))


@query
def paragraph_offsets(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraphs(chunks(spark, d, "raw_text"), "id", "raw_text")


@query
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.split("raw_text", "\n"), lambda r: F.split(r, r" \| "))
    return chunks(spark, d, "page_number", "raw_text", "is_table").where("is_table").select("id", chunking.table_markdown(rows, F.col("page_number")).alias("markdown"))


@query
def chunk_coalesce(spark: SparkSession, d: str) -> DataFrame:
    packed = chunking.pack_fragments(chunks(spark, d, "document_id", "page_number", "raw_text"), ["document_id", "page_number"], ["id"], "raw_text")
    return packed.select("document_id", "page_number", "chunk_no", "n_fragments", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("chunk_hash"))


@query
def chunk_loss_check(spark: SparkSession, d: str) -> DataFrame:
    held = chunks(spark, d, "document_id", "page_number", "raw_text")
    packed = chunking.pack_fragments(held, ["document_id", "page_number"], ["id"], "raw_text")
    before = held.groupBy("document_id").agg(F.count(F.lit(1)).alias("fragments"), F.sum(F.length("raw_text")).alias("chars_before"))
    after = packed.groupBy("document_id").agg(F.count(F.lit(1)).alias("packed"), F.sum(F.length("chunk_text") - 2 * (F.col("n_fragments") - 1)).alias("chars_after"))
    return before.join(after, "document_id")


@query
def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    """Packed chunks with offsets, flags and the first picture; a fragment needs vision if it has a picture and little text."""
    held = chunks(spark, d, "document_id", "page_number", "char_start", "char_end", "raw_text", "is_table", "image_ref")
    held = held.withColumn("needs_vision", chunking.needs_vision(F.col("raw_text"), F.col("image_ref").isNotNull().cast("int"), 400))
    packed = chunking.pack_fragments(held, ["document_id", "page_number"], ["id"], "raw_text", any_of=["is_table", "needs_vision"], first_of=["image_ref"])
    return packed.withColumn("chunk_hash", F.md5("chunk_text")).drop("chunk_text")


@query
def low_text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with a picture whose shortest line has under 80 characters: no given page has as little text as a visual one."""
    held = chunks(spark, d, "document_id", "page_number", "raw_text", "image_ref").where("image_ref is not null")
    shortest = F.array_min(F.transform(F.split("raw_text", "\n"), lambda line: F.struct(F.length(line).alias("n"), line.alias("line"))))["line"]
    seen = chunking.visual_pages(held.withColumn("line", shortest).withColumn("images", F.lit(1)), "line", "images")
    return seen.select("id", "document_id", "page_number", "shown")


@query
def doc_type_first_pages(spark: SparkSession, d: str) -> DataFrame:
    """The type of each upload by the text of its first three pages that are not blank."""
    held = chunks(spark, d, "document_id", "page_number", "raw_text")
    first = chunking.first_pages_text(held, "document_id", "page_number", "id", "raw_text")
    return first.select("document_id", F.length("first_text").alias("chars"), C.document_type(F.col("first_text")).alias("doc_type"))


@query
def quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    return grounding.ground(facts(spark, d, "chunk_id", "confidence", "evidence_quote", "qualifiers"), chunks(spark, d, "raw_text"))


@query
def grounding_filter_dedup(spark: SparkSession, d: str) -> DataFrame:
    held = facts(spark, d, "chunk_id", "confidence", "evidence_quote", "qualifiers", "document_id", "entity", "attribute", "period", "scope", "value", "created_at")
    valid = grounding.ground(held, chunks(spark, d, "raw_text")).where("is_valid").select("id")
    return grounding.first_by_hash(held.join(valid, "id", "left_semi"), _hash())


@query
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("id", "entity_match", "attribute_match")


@query
def pair_alignment(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("id", "entity_match", "attribute_match", "has_period_a", "has_period_b", "period_match", "has_scope_a", "has_scope_b", "scope_match", "has_unit_a", "has_unit_b", "unit_match", "value_close")


@query
def reconcile_cascade(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.with_fallback(reconcile.cascade(aligned(spark, d))).select("id", "relation_type", "decision_route", "review_reason", "decision_confidence")


@query
def reconcile_route_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reconcile_cascade(spark, d).groupBy("relation_type", "decision_route", "review_reason").agg(F.count(F.lit(1)).alias("pairs"))


@query
def comparison_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = reconcile.snapshot(aligned(spark, d))
    missing = reconcile.missing_sides(F.col("snapshot.alignment.has_period_a"), F.col("snapshot.alignment.has_period_b"))
    return s.select("id", F.col("snapshot.fact_a.value").alias("value_a"), F.col("snapshot.fact_b.value").alias("value_b"), F.col("snapshot.alignment.unit_match").alias("unit_match"), missing.alias("period_missing"), F.col("snapshot.tolerance.relative").alias("relative"))


@query
def alignment_labels(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.alignment_matrix(aligned(spark, d), "id")


@query
def pair_explanations(spark: SparkSession, d: str) -> DataFrame:
    decided = reconcile.with_fallback(reconcile.cascade(aligned(spark, d)))
    return decided.select("id", "decision_route", reconcile.explanation(decided).alias("explanation"))


@query
def deterministic_pairs(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.deterministic_check(aligned(spark, d)).select("id", "relation_type", "decision_route", "decision_confidence")


@query
def stored_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What is written of the verdicts: none that is unrelated."""
    decided = reconcile.with_fallback(reconcile.cascade(aligned(spark, d)))
    out = reconcile.stored(decided)
    return out.select("fact_a_id", "fact_b_id", "relation_type", "decision_route", "review_reason", "confidence", F.get_json_object("comparison_snapshot", "$.fact_a.value").alias("value_a"), "extraction_confidence_a", "extraction_confidence_b")


@query
def replay_changes(spark: SparkSession, d: str) -> DataFrame:
    """Reconciliation run again on stored pairs whose first fact is on cement: recorded and new verdicts."""
    about = once(table(spark, d, "facts", "id", "document_id", "entity", "attribute", "value", "unit", "period", "scope", "qualifiers", "confidence").where("entity ilike '%cement%'"))
    pairs = relationships(spark, d, "fact_a_id", "fact_b_id", "relation_type").withColumnRenamed("relation_type", "recorded")
    asked = pairs.join(about.select(F.col("id").alias("fact_a_id")), "fact_a_id", "left_semi")
    held = facts(spark, d, "document_id", "entity", "attribute", "value", "unit", "period", "scope", "qualifiers", "confidence")
    again = reconcile.with_fallback(reconcile.cascade(reconcile.alignment(reconcile.pair_claims(asked, held))))
    return again.groupBy(ledger.relation_kind(F.col("recorded")).alias("recorded"), "relation_type").agg(F.count(F.lit(1)).alias("pairs"))


@query
def adjudication_residue(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.cascade(aligned(spark, d)).where("relation_type is null").select("id")


@query
def adjudicated_pairs(spark: SparkSession, d: str) -> DataFrame:
    return adjudicate.adjudicate(reconcile.cascade(aligned(spark, d)), adjudicate.scope_judge)


@query
def extracted_amounts(spark: SparkSession, d: str) -> DataFrame:
    return adjudicate.extract_amounts(chunks(spark, d, "raw_text"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("seq"), "embedding")


@query
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return similarity.top_k(rows.where("id % 100 = 0"), rows, threshold=0.30)


@query
def vector_topk_incremental(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    return similarity.top_k(rows.where("id % 100 = 0"), rows, threshold=0.20, visible=True)


@query
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact neighbours of the query set that the index finds; the given vectors hardly cluster, so most lists are asked."""
    rows = _vectors(spark, d)
    asked = rows.where("id % 100 = 0")
    exact = similarity.top_k(asked, rows, threshold=-1.0).select("query_id", "cand_id")
    got = similarity.indexed_top_k(asked, rows, lists=16, probes=12).select("query_id", "cand_id", F.lit(1).alias("hit"))
    return exact.join(got, ["query_id", "cand_id"], "left").agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))


def _statement_vectors(texts: DataFrame) -> DataFrame:
    return embedding.embed(texts, "id", "text", embedding.hashing_model())


@query
def fact_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of all facts by their statements' vectors, through the index.

    The best four are taken before facts of the same document are left out.
    """
    held = facts(spark, d, "document_id", "canonical_statement")
    near = similarity.candidates_by_text(held, "id", "canonical_statement", _statement_vectors)
    of = held.select("id", "document_id")
    both = near.join(of.select(F.col("id").alias("query_id"), F.col("document_id").alias("a")), "query_id").join(of.select(F.col("id").alias("cand_id"), F.col("document_id").alias("b")), "cand_id")
    return both.where("a <> b").select("query_id", "cand_id", "score")


@query
def fact_candidates_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact neighbours that the index finds, for a hundredth of the different statements against all of them."""
    known = similarity.classes(facts(spark, d, "canonical_statement"), "id", "canonical_statement")
    rows = _statement_vectors(known.select(F.col("class_id").alias("id"), "text")).withColumn("seq", F.lit(0))
    asked = rows.where("pmod(xxhash64(id), 100) = 0")
    exact = similarity.top_k(asked, rows).select("query_id", "cand_id")
    got = similarity.indexed_top_k(asked, rows, threshold=0.76).select("query_id", "cand_id", F.lit(1).alias("hit"))
    return exact.join(got, ["query_id", "cand_id"], "left").agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))


@query
def vector_topk_apart(spark: SparkSession, d: str) -> DataFrame:
    """As ``vector_topk``, without rows of the query's own label."""
    rows = _vectors(spark, d)
    return similarity.top_k(rows.where("id % 100 = 0"), rows, threshold=0.20, without="seq")


@query
def unordered_pair_dedup(spark: SparkSession, d: str) -> DataFrame:
    rel = relationships(spark, d, "fact_a_id", "fact_b_id", "relation_type")
    known = ledger.relation_kind(F.col("relation_type")) == "CORROBORATES"
    return ledger.new_pairs(rel.where(~known), rel.where(known), "fact_a_id", "fact_b_id")


@query
def list_facts_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = ledger.list_facts(table(spark, d, "facts"), table(spark, d, "chunks"), table(spark, d, "uploads"), entity="insurance", attribute="debt")
    return found.select("id", "entity", "attribute", "value", "unit", "qualifiers", "page_number", "filename")


@query
def document_facts(spark: SparkSession, d: str) -> DataFrame:
    """The newest facts of the oldest upload, as a filter on its id."""
    found = ledger.list_facts(table(spark, d, "facts"), table(spark, d, "chunks"), table(spark, d, "uploads"), document_id=_least(spark, d, "uploads"), limit=500)
    return found.select("id", "entity", "value", "page_number", "filename")


def _least(spark: SparkSession, d: str, name: str) -> str:
    return table(spark, d, name, "id").agg(F.min("id")).first()[0]


@query
def fact_by_id(spark: SparkSession, d: str) -> DataFrame:
    return ledger.by_id(table(spark, d, "facts", "id", "entity", "attribute", "value", "unit", "period", "scope", "document_id"), _least(spark, d, "facts"))


@query
def relationship_by_id(spark: SparkSession, d: str) -> DataFrame:
    """One relationship, hydrated."""
    row = ledger.by_id(table(spark, d, "relationships", "id", "fact_a_id", "fact_b_id", "relation_type"), _least(spark, d, "relationships"))
    out = ledger.hydrate_page(row, table(spark, d, "facts"), table(spark, d, "chunks"), table(spark, d, "uploads"))
    return out.select("id", "relation_type", "entity_a", "entity_b", "page_number_a", "filename_b")


@query
def document_status(spark: SparkSession, d: str) -> DataFrame:
    return ledger.document_status(table(spark, d, "uploads"), table(spark, d, "facts", "id", "document_id"), table(spark, d, "relationships", "id", "fact_a_id", "fact_b_id"), _least(spark, d, "uploads"))


@query
def relationship_nested(spark: SparkSession, d: str) -> DataFrame:
    """Relationships with the facts of both ends as structs, a part of each shown."""
    out = ledger.nested(relationships(spark, d, "fact_a_id", "fact_b_id"), facts(spark, d, "entity", "value", "unit", "confidence"))
    return out.select("id", *(F.col(f"fact_{side}.{f}").alias(f"{f}_{side}") for side in "ab" for f in ("entity", "value", "unit", "confidence")), F.col("fact_a").isNull().alias("a_is_missing"))


@query
def vector_payloads(spark: SparkSession, d: str) -> DataFrame:
    """What is kept beside the vector of a fact."""
    return embedding.payloads(facts(spark, d, "document_id", "entity", "attribute", "canonical_statement"))


@query
def vectors_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written twice under one id: the later one counts."""
    first = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("seq"), F.element_at("embedding", 1).cast("double").alias("first"))
    again = first.where("id % 3 = 0").select("id", F.lit(1).alias("seq"), (-F.col("first")).alias("first"))
    return ledger.latest(first.unionByName(again), "id", ["seq"])


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, what an extractor gave for them, and how its calls ended, as the ledger has them."""
    held = chunks(spark, d, "document_id", "page_number", "raw_text", "extraction_status")
    return held.select("id", "document_id", "page_number", "raw_text"), facts(spark, d), held.select(F.col("id").alias("chunk_id"), F.col("extraction_status").alias("call"))


def ingested(spark: SparkSession, d: str) -> ingest.Ingested:
    """The ingest run again over all uploads, with the stored claims for an extractor and the stored pairs as candidates."""
    held, claims, calls = _claims(spark, d)
    pairs = relationships(spark, d, "fact_a_id", "fact_b_id")
    return ingest.ingest(uploads(spark, d, "status").select("id"), held, lambda chunks: (claims, calls), lambda facts: pairs)


@query
def ingest_facts(spark: SparkSession, d: str) -> DataFrame:
    held, claims, _ = _claims(spark, d)
    return ingest.verified_facts(claims, held).select("id", "confidence", "content_hash")


@query
def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunk_states(*_claims(spark, d)).select("id", "facts", "extraction_status")


@query
def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    return ingested(spark, d).documents


@query
def ingest_relationships(spark: SparkSession, d: str) -> DataFrame:
    return ingested(spark, d).relationships.select("fact_a_id", "fact_b_id", "relation_type", "decision_route", "review_reason")


@query
def document_states(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each upload from the log of its states."""
    log = ingest.status_log(uploads(spark, d, "status"), chunks(spark, d, "document_id", "extraction_status"), facts(spark, d, "document_id"), relationships(spark, d, "fact_a_id", "fact_b_id"))
    return ingest.last_status(log)


@query
def relationship_hydrated(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.hydrate(relationships(spark, d, "fact_a_id", "fact_b_id"), facts(spark, d), chunks(spark, d, "page_number"), uploads(spark, d))
    return out.select("id", *(f"{c}_{s}" for c in ("entity", "value", "page_number", "filename") for s in "ab"))


@query
def relationships_by_filter(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "relationships", "id", "fact_a_id", "fact_b_id", "relation_type", "decision_route", "review_reason", "created_at")
    out = ledger.list_relationships(rel, table(spark, d, "facts"), table(spark, d, "chunks"), table(spark, d, "uploads"), kind="CORROBORATES", routes=_ROUTES, search="cement", limit=200)
    return out.select("id", "relation_type", "decision_route", "entity_a", "entity_b", "filename_a")


@query
def document_list_status(spark: SparkSession, d: str) -> DataFrame:
    return ledger.document_counts(uploads(spark, d), facts(spark, d, "document_id"), relationships(spark, d, "fact_a_id", "fact_b_id"))


@query
def top3_per_type(spark: SparkSession, d: str) -> DataFrame:
    return ledger.newest_per_type(relationships(spark, d, "relation_type", "created_at"))


@query
def ledger_kpis(spark: SparkSession, d: str) -> DataFrame:
    return ledger.summary(uploads(spark, d), facts(spark, d, "document_id"), relationships(spark, d, "relation_type", "decision_route"))


@query
def chunk_status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ledger.chunk_outcomes(chunks(spark, d, "document_id", "extraction_status"), facts(spark, d, "document_id"))


@query
def upload_decision_table(spark: SparkSession, d: str) -> DataFrame:
    held = uploads(spark, d)
    arrivals = table(spark, d, "uploads").groupBy("id").agg(F.min("content_hash").alias("content_hash")).select(F.col("id").alias("upload_id"), "content_hash")
    return ledger.upload_decisions(arrivals, held.where("upload_ts < timestamp'2025-07-01'"))


@query
def purge_failed(spark: SparkSession, d: str) -> DataFrame:
    gone = once(table(spark, d, "uploads", "id", "status").where("upper(status) = 'FAILED'"))
    return ledger.purge(gone, facts(spark, d, "document_id"), chunks(spark, d, "document_id"), relationships(spark, d, "fact_a_id", "fact_b_id"))


@query
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value"), "user_id", ["ts", "event_id"])


@query
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The cascade's verdicts against the recorded ones."""
    recorded = relationships(spark, d, "relation_type", "decision_route").select("id", ledger.relation_kind(F.col("relation_type")).alias("expected_relation"), F.col("decision_route").alias("expected_route"))
    never = F.when(F.col("expected_relation") == "NEEDS_REVIEW", F.array(F.lit("CORROBORATES"), F.lit("CONTRADICTS"))).when(F.col("expected_relation") == "UNRELATED", F.array(F.lit("CORROBORATES"))).otherwise(F.expr("cast(array() as array<string>)"))
    got = reconcile_cascade(spark, d).select("id", F.col("relation_type").alias("actual_relation"), F.col("decision_route").alias("actual_route"))
    return evaluation.metrics(recorded.withColumn("must_not_be", never).join(got, "id"))


@query
def eval_details(spark: SparkSession, d: str) -> DataFrame:
    """The cascade's verdicts beside the recorded ones, case by case."""
    recorded = relationships(spark, d, "relation_type", "decision_route", "review_reason").select("id", ledger.relation_kind(F.col("relation_type")).alias("expected_relation"), F.col("decision_route").alias("expected_route"), F.col("review_reason").alias("expected_reason"))
    never = F.when(F.col("expected_relation") == "UNRELATED", F.array(F.lit("CORROBORATES"))).otherwise(F.expr("cast(array() as array<string>)"))
    got = reconcile_cascade(spark, d).select("id", F.col("relation_type").alias("actual_relation"), F.col("decision_route").alias("actual_route"), F.col("review_reason").alias("actual_reason"))
    return evaluation.details(recorded.withColumn("must_not_be", never).join(got, "id"))


@query
def json_qualifier_truthiness(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("qualifiers")
    vision = F.coalesce(F.get_json_object(q, "$.extraction_path") == "vision", F.lit(False))
    return facts(spark, d, "qualifiers").select("id", C.truthy(q, "header_uncertain").alias("header_uncertain"), vision.alias("from_vision"))


@query
def error_class_backoff(spark: SparkSession, d: str) -> DataFrame:
    kind = C.error_class(F.col("error_message"))
    wait = F.try_to_number(F.nullif(F.regexp_extract(F.lower("error_message"), r"try again in ([\d.]+)s", 1), F.lit("")), F.lit("9999.99")).cast("double")
    rows = once(table(spark, d, "uploads", "id", "error_message").where("error_message is not null")).select("id", kind.alias("kind"), wait.alias("wait"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("attempt"))
    return rows.select("id", "kind", "attempt", C.backoff_seconds(F.col("kind"), F.col("attempt"), F.col("wait")).alias("seconds"))


@query
def status_lookup(spark: SparkSession, d: str) -> DataFrame:
    status = F.upper(F.trim("status"))
    known = ["QUEUED", "CHUNKING", "EXTRACTING", "RECONCILING", "DONE", "DONE_EMPTY", "FAILED"]
    return uploads(spark, d).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("uploads"), F.count_if(~status.isin(known)).alias("unknown"))


@query
def stream_fact_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream_fact_counts(spark, f"{d}/facts.parquet")


@query
def stream_fact_candidates(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream_candidates(spark, f"{d}/facts.parquet", embedding.hashing_model())


@query
def stream_new_uploads(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream_new_uploads(spark, f"{d}/uploads.parquet")


@query
def stream_job_states(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream_job_states(spark, f"{d}/chunks.parquet")


@query
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream_windows(spark, f"{d}/events.parquet", "ts", "event_type")


def queries() -> dict[str, Query]:
    return dict(_REGISTERED)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _REGISTERED}
