import json
import math
import re
import unicodedata
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimforge.functions import claims as C
from claimforge.operators import adjudicate, chunking, embedding, grounding, ingest, ledger, reconcile, similarity


def column(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(("value", "want"), [("₹1,234.5", 1234.5), ("5 million", 5), ("(102)", 102), ("Q4 FY24", 4), ("10-20", 10), ("1e5", 1), ("5.", 5), ("-3", -3), (None, None), ("", None), ("none", None), (".5", 0.5)])
def test_numeric(spark, value, want):
    got = column(spark, [value], C.numeric)[0]
    assert got is None if want is None else float(got) == want


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x17F), st.characters(categories=("L", "N", "P", "Zs", "Sc"), max_codepoint=0xFFFF), st.sampled_from(" .-$_%")), max_size=30), min_size=150, max_size=150))
def test_normalizers_against_python(spark, texts):
    """Letters, figures and spaces are Unicode's; capitals with more than one small form are left to each engine."""
    texts = [t for t in texts if all(len(c.lower()) == 1 and unicodedata.category(c) not in ("Cn", "Lm", "Mn", "Mc", "Nl", "No", "Pc") or c == "_" for c in t) and not re.search("[\x00\x1c-\x1f\u03a3]", t)]
    metric = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower().strip()))
    assert column(spark, texts, C.normalize_metric) == [metric(t) for t in texts]


def test_tolerance(spark):
    df = spark.createDataFrame([("100", "100.4"), ("1000", "1004.9"), ("1000", "1006"), ("abc", " ABC "), ("abc", "abd"), (None, None), ("6.5%", "7.4%"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(C.values_close(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, False, False, True, False]


CLAIM = dict(document_id="d", entity="Acme Ltd", attribute="Revenue", value="100", unit="₹ Cr", period="FY24", scope="consolidated", qualifiers="{}", confidence=0.95)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ({}, {}, ("CORROBORATES", "deterministic_exact", None)),
        ({}, {"value": "100.3"}, ("CORROBORATES", "deterministic_rounding", None)),
        ({"value": "123.45"}, {"value": "123.45"}, ("CORROBORATES", "deterministic_rounding", None)),
        ({"value": "listed"}, {"value": "Listed"}, ("CORROBORATES", "deterministic_exact", None)),
        ({"period": None}, {}, ("NEEDS_REVIEW", "ambiguity_firewall", "missing_period")),
        ({"scope": ""}, {"value": "150"}, ("NEEDS_REVIEW", "ambiguity_firewall", "missing_scope_or_basis")),
        ({"unit": "USD"}, {"value": "150"}, ("NEEDS_REVIEW", "ambiguity_firewall", "unit_ambiguity")),
        ({"confidence": 0.6}, {"value": "150"}, ("NEEDS_REVIEW", "ambiguity_firewall", "header_context_uncertain")),
        ({"confidence": 0.7}, {"value": "150"}, (None, None, None)),
        ({"qualifiers": '{"header_uncertain": "false"}'}, {"value": "150"}, ("NEEDS_REVIEW", "ambiguity_firewall", "header_context_uncertain")),
        ({"qualifiers": '{"header_uncertain": false}'}, {"value": "150"}, (None, None, None)),
        ({"entity": "Zorn"}, {}, ("UNRELATED", "irrelevant_pre_filter", None)),
        ({"attribute": "Headcount"}, {}, ("UNRELATED", "irrelevant_pre_filter", None)),
        ({"attribute": "Turnover"}, {}, ("CORROBORATES", "deterministic_exact", None)),
        ({"period": "Q4 FY24"}, {}, ("CORROBORATES", "deterministic_exact", None)),
        ({"scope": "standalone"}, {"value": "150"}, (None, None, None)),
        ({"value": None}, {}, (None, None, None)),
    ],
)
def test_cascade(spark, a, b, want):
    rows = [{"id": "1", **CLAIM, **a}, {"id": "2", **CLAIM, **b}]
    fields = "id string, document_id string, entity string, attribute string, value string, unit string, period string, scope string, qualifiers string, confidence double"
    facts = spark.createDataFrame([[r[f.split()[0]] for f in fields.split(", ")] for r in rows], fields)
    pairs = spark.createDataFrame([("p", "1", "2"), ("q", "1", "missing")], "id string, fact_a_id string, fact_b_id string")
    decided = reconcile.cascade(reconcile.alignment(reconcile.pair_claims(pairs, facts)))
    got = decided.select("relation_type", "decision_route", "review_reason").collect()
    assert [tuple(r) for r in got] == [want]
    if want[0] is None:
        answer = lambda judge: adjudicate.adjudicate(decided, judge).first().asDict()
        assert answer(lambda a, b: {"relation_type": "CONTRADICTS"})["decision_route"] == "llm_adjudication"
        assert answer(lambda a, b: {"relation_type": "MAYBE"})["review_reason"] == "adjudication_unavailable"
        assert answer(lambda a, b: 1 / 0)["decision_confidence"] == 0.5
        assert reconcile.with_fallback(decided).first().review_reason == "adjudication_unavailable"


def test_packing(spark):
    texts = ["a" * 40, "b" * 40, "c" * 16, "d" * 200, "e" * 5, "f" * 93, "g"]
    fragments = spark.createDataFrame([("d", 1, k, t) for k, t in enumerate(texts)] + [("d", 2, 0, "only")], "doc string, page int, k int, t string")
    got = chunking.pack_fragments(fragments, ["doc", "page"], ["k"], "t", limit=100).orderBy("page", "chunk_no").collect()
    assert [(r.page, r.n_fragments, len(r.chunk_text)) for r in got] == [(1, 3, 100), (1, 1, 200), (1, 2, 100), (1, 1, 1), (2, 1, 4)]
    assert chunking.pack_fragments(fragments.limit(0), ["doc", "page"], ["k"], "t").count() == 0


def test_grounding(spark):
    chunk = "Revenue from operations rose to ₹8,142 crore* in FY24, the company said"
    facts = spark.createDataFrame(
        [("a", "c", 0.9, "rose to ₹8,142 crore", "{}"), ("b", "c", 0.9, "profits fell sharply in Mexico last autumn", "{}"), ("c", "c", 0.9, "  ", "{}"), ("d", "c", 0.9, "***", "{}"), ("e", "c", 0.9, "x", '{"extraction_path": "vision"}'), ("f", "c", 0.95, "revenue operations rose FY24 company said Monday", None), ("g", "none", 0.9, "rose", "{}"), ("h", None, None, None, None)],
        "id string, chunk_id string, confidence double, evidence_quote string, qualifiers string",
    )
    chunks = spark.createDataFrame([("c", chunk)], "id string, raw_text string")
    got = {r.id: (r.is_valid, r.grounded_confidence, r.reason) for r in grounding.ground(facts, chunks).collect()}
    assert got == {"a": (True, 0.9, "exact"), "b": (False, 0.2, "absent"), "c": (False, 0.0, "empty"), "d": (True, 0.9, "exact"), "e": (True, 0.7, "vision"), "f": (True, pytest.approx(0.9, abs=0.01), "words"), "g": (False, 0.2, "absent"), "h": (False, 0.0, "empty")}


def test_table_markdown(spark):
    rows = spark.createDataFrame([(1, [["a", " b\nc "], ["", None], ["1", "2"]]), (2, [["x"]])], "page int, rows array<array<string>>")
    got = [r[0] for r in rows.orderBy("page").select(chunking.table_markdown(F.col("rows"), F.col("page"))).collect()]
    assert got == ["[Table on Page 1]\na | b c\n--- | ---\n | \n1 | 2", None]


def test_json_from_text():
    assert adjudicate.json_from_text('<think>hm {"a": 0}</think>```json\n{"a": 1}\n``` trailing') == {"a": 1}
    assert adjudicate.json_from_text('[{"a": 1}]') == {"facts": [{"a": 1}]}
    assert adjudicate.json_from_text("<think>never closed {") is None
    assert adjudicate.json_from_text(None) is None


def test_backoff(spark):
    df = spark.createDataFrame([("rate_limit", 1, 3.0), ("rate_limit", 3, None), ("rate_limit", 9, None), ("timeout", 2, None), ("other", 1, None)], "k string, n int, w double")
    assert [r[0] for r in df.select(C.backoff_seconds(F.col("k"), F.col("n"), F.col("w"))).collect()] == [3.5, 8.0, 20.0, 3.0, None]


def test_upload_decisions(spark):
    uploads = spark.createDataFrame([("a", "h1", "done", 1), ("b", "h2", "FAILED", 2), ("c", "h3", "QUEUED", 3), ("d", "h4", "DONE_EMPTY", 4), ("e", "h1", "FAILED", 5)], "id string, content_hash string, status string, t int").withColumn("upload_ts", F.timestamp_seconds("t"))
    arrivals = spark.createDataFrame([("1", "h1"), ("2", "h2"), ("3", "h3"), ("4", "h4"), ("5", "h5"), ("6", None)], "upload_id string, content_hash string")
    got = {r.upload_id: (r.decision, r.document_id) for r in ledger.upload_decisions(arrivals, uploads).collect()}
    assert got == {"1": ("known", "a"), "2": ("again", "b"), "3": ("in_work", "c"), "4": ("known", "d"), "5": ("new", None), "6": ("new", None)}


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    rows = spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(x)] + [(99, 0, None)], "id bigint, seq int, embedding array<double>")
    for visible in (False, True):
        got = {(r.query_id, r.cand_id) for r in similarity.top_k(rows.where("id < 20"), rows, k=3, threshold=0.1, visible=visible, block=7).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = set()
        for q in range(20):
            near = sorted((-round(float(u[q] @ u[c]), 6), c) for c in range(60) if c != q and (not visible or c % 5 <= q % 5) and round(float(u[q] @ u[c]), 6) >= 0.1)
            want |= {(q, c) for _, c in near[:3]}
        assert got == want
    assert similarity.top_k(rows.limit(0), rows).count() == 0


FIELDS = "id string, document_id string, page_number int, raw_text string, is_table boolean, image_ref string, char_start int, char_end int"


def test_packing_keeps_what_it_merges(spark):
    rows = [("1", "d", 1, "a" * 40, False, None, 0, 40), ("2", "d", 1, "| t |", True, "", 42, 47), ("3", "d", 1, "b" * 90, False, "/p.png", 49, 139), ("4", "d", 2, "only", None, "/q.png", 7, 11), ("5", "d", 3, None, None, None, None, None)]
    got = {(r.page_number, r.chunk_no): r for r in chunking.pack_fragments(spark.createDataFrame(rows, FIELDS), ["document_id", "page_number"], ["id"], "raw_text", 100, ["is_table"], ["image_ref"]).collect()}
    assert (got[1, 0].is_table, got[1, 0].image_ref, got[1, 0].char_start, got[1, 0].char_end) == (True, None, 0, 47)
    assert (got[1, 1].is_table, got[1, 1].image_ref, got[1, 1].char_end) == (False, "/p.png", 90)
    assert (got[2, 0].is_table, got[2, 0].image_ref, got[2, 0].char_start, got[2, 0].char_end) == (False, "/q.png", 7, 11)
    assert got[3, 0].chunk_text == "" and got[3, 0].char_end == 0
    visual = chunking.visual_pages(spark.createDataFrame([(4, " ", 2), (5, "few words", 1), (6, "few words", 0), (7, "x" * 80, 1)], "page_number int, t string, n int"), "t", "n")
    assert {(r.page_number, r.shown) for r in visual.collect()} == {(4, "[Visual / Chart Page 4]"), (5, "few words")}


def test_deterministic_check_ignores_units(spark):
    rows = [{"id": "1", **CLAIM}, {"id": "2", **CLAIM, "unit": "USD"}, {"id": "3", **CLAIM, "value": "180"}]
    kinds = "id string, document_id string, entity string, attribute string, value string, unit string, period string, scope string, qualifiers string, confidence double"
    facts = spark.createDataFrame([[r[f.split()[0]] for f in kinds.split(", ")] for r in rows], kinds)
    pairs = spark.createDataFrame([("p", "1", "2"), ("q", "1", "3")], "id string, fact_a_id string, fact_b_id string")
    got = reconcile.deterministic_check(reconcile.alignment(reconcile.pair_claims(pairs, facts))).collect()
    assert [(r.id, r.decision_route) for r in got] == [("p", "deterministic_exact")]


def test_structured_calls(spark):
    """Retries, the next model, answers of another form, and errors as rows."""

    def connect():
        tries = {}

        def client(prompt, model):
            tries[prompt, model] = tries.get((prompt, model), 0) + 1
            if prompt == "busy" and tries[prompt, model] < 3:
                raise RuntimeError("429 rate limit, try again in 1.5s")
            if prompt == "down" and model == "big":
                raise RuntimeError("connection timed out")
            if prompt == "never":
                raise RuntimeError("429")
            return {"text": "no object here", "form": '{"n": "x"}'}.get(prompt, '<think>so</think>```json\n{"n": 7}\n``` done')

        return client

    prompts = spark.createDataFrame([(p, p) for p in ("plain", "busy", "down", "never", "text", "form")] + [("none", None)], "k string, p string")
    got = {r.k: r for r in adjudicate.structured_calls(prompts, "k", "p", connect, "n int", ["big", "small"], pause=lambda s: None).collect()}
    seen = {k: (r.call, r.model, r.attempts, r.answer.n if r.answer else None) for k, r in got.items()}
    assert seen["plain"] == ("success", "big", 1, 7) and seen["busy"] == ("success", "big", 3, 7) and seen["down"] == ("success", "small", 4, 7)
    assert seen["never"] == ("rate_limited", "small", 6, None) and seen["text"][0] == seen["form"][0] == "extraction_failed" and seen["none"][0] == "success"
    assert got["text"].error == "no JSON in the answer" and [adjudicate.wait_before("rate_limited", 1, "try again in 1.5s"), adjudicate.wait_before("timed_out", 2, ""), adjudicate.wait_before("rate_limited", 9, "")] == [2.0, 3.0, 20.0]


def _answers():
    """A client whose answer depends on the text of the chunk."""

    def client(prompt, model):
        claim = {"entity": "Acme Ltd", "attribute": "Revenue", "value": "100", "unit": "INR Cr", "period": "FY24", "scope": "consolidated", "evidence_quote": "Revenue was 100", "confidence": 0.9}
        if "ANNUAL" in prompt:
            return json.dumps([claim, claim | {"value": ""}, claim | {"evidence_quote": "profits fell in Mexico last autumn"}])
        if "SECOND" in prompt:
            return json.dumps({"facts": [claim | {"value": "180", "evidence_quote": "Revenue was 180"}]})
        if "BROKEN" in prompt:
            raise RuntimeError("429 rate limit")
        return '{"facts": []}' if "EMPTY" in prompt else json.dumps([claim | {"confidence": 4}])

    return client


def test_ingest(spark, tmp_path):
    chunks = [("c1", "d1", 1, "ANNUAL annual report Revenue was 100"), ("c2", "d1", 2, "BROKEN"), ("c3", "d2", 1, "SECOND Revenue was 180"), ("c4", "d3", 1, "BROKEN"), ("c5", "d4", 1, "EMPTY"), ("c6", "d5", 1, "REFUSED")]
    chunks = spark.createDataFrame(chunks, "id string, document_id string, page_number int, raw_text string")
    documents = spark.createDataFrame([(f"d{k}",) for k in range(1, 7)], "id string")
    typed = {r.document_id: r.doc_type for r in ingest.typed_chunks(chunks).collect()}
    assert typed["d1"] == "annual_report" and typed["d2"] == "general_document"
    client = _answers()
    extract = lambda c: adjudicate.extract_facts(c, lambda: client, ["m"], pause=lambda s: None)
    every = lambda facts: facts.alias("x").join(facts.alias("y"), F.col("x.entity") == F.col("y.entity")).select(F.col("x.id").alias("fact_a_id"), F.col("y.id").alias("fact_b_id"))
    done = ingest.ingest(documents, chunks, extract, every)
    assert {r.id: (r.facts, r.extraction_status) for r in done.chunks.collect()} == {"c1": (2, "success"), "c2": (0, "rate_limited"), "c3": (1, "success"), "c4": (0, "rate_limited"), "c5": (0, "success"), "c6": (0, "extraction_failed")}
    assert {r.document_id: (r.status, r.facts, r.failed_chunks) for r in done.documents.collect()} == {"d1": ("DONE", 1, 1), "d2": ("DONE", 1, 0), "d3": ("FAILED", 0, 1), "d4": ("DONE_EMPTY", 0, 0), "d5": ("FAILED", 0, 1), "d6": ("DONE_EMPTY", 0, 0)}
    assert {r.value for r in done.facts.collect()} == {"100", "180"}
    assert [r.relation_type for r in done.relationships.collect()] == ["NEEDS_REVIEW"]
    ingest.write_ingested(done, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "relationships")).count() == 1
    known = done.relationships.select("fact_a_id", "fact_b_id")
    assert ingest.new_relationships(every(done.facts), done.facts, known).count() == 0
    empty = ingest.ingest(documents.limit(0), chunks.limit(0), extract, every)
    assert empty.documents.count() == empty.facts.count() == empty.relationships.count() == 0


def test_vision(spark):
    images = spark.createDataFrame([("file:/p/1.png", bytearray(b"abc"))], "path string, content binary")
    chunks = spark.createDataFrame([("c1", "d1", 1, "", "/p/1.png", "x"), ("c2", "d1", 2, "", "/p/2.png", "x")], "id string, document_id string, page_number int, raw_text string, image_ref string, doc_type string")
    seen = adjudicate.image_prompts(chunks, images)
    assert {r.id: r.data_url for r in seen.collect()} == {"c1": "data:image/png;base64,YWJj", "c2": ""}
    facts, calls = adjudicate.extract_facts(seen, lambda: lambda p, m: '[{"entity": "A", "attribute": "B", "value": "1", "confidence": 0.9}]' if p.startswith("data:") else "[]", ["m"], prompt=F.col("data_url"), vision=True)
    assert [(r.chunk_id, r.confidence, json.loads(r.qualifiers)) for r in facts.collect()] == [("c1", 0.7, {"extraction_path": "vision"})]
    assert {r.chunk_id: r.call for r in calls.collect()} == {"c1": "success", "c2": "success"}


def test_lookups(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, n int")
    assert ledger.by_id(rows, "a").collect() == [("a", 1)]
    with pytest.raises(LookupError):
        ledger.by_id(rows, "c")


def test_index_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [])], "id bigint, embedding array<float>")
    exact = similarity.top_k(rows.withColumn("seq", F.lit(0)), rows.withColumn("seq", F.lit(0)), 4, -1.0).select("query_id", "cand_id")
    pairs = lambda df: {tuple(r) for r in df.collect()}
    got = pairs(similarity.indexed_top_k(rows, rows, 4, lists=12, probes=4, block=50).select("query_id", "cand_id"))
    want = pairs(exact)
    assert len(got & want) >= 0.95 * len(want)
    assert pairs(similarity.indexed_top_k(rows, rows, 4, lists=12, probes=12, block=64).select("query_id", "cand_id")) == want
    assert similarity.indexed_top_k(rows, rows.limit(0)).count() == 0


def test_candidates_by_text(spark):
    texts = ["acme net sales"] * 7 + ["acme net sales up", "board plan", None, None]
    rows = spark.createDataFrame([(f"{k:02}", t) for k, t in enumerate(texts)], "id string, t string")
    model = embedding.hashing_model(64)
    got = similarity.candidates_by_text(rows, "id", "t", lambda df: embedding.embed(df, "id", "text", model), k=3, threshold=0.7, probes=99)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, set()).add(r.cand_id)
    assert by["00"] == {"01", "02", "03"} and by["02"] == {"00", "01", "03"} and by["06"] == {"00", "01", "02"}
    assert by["07"] == {"00", "01", "02"} and "08" not in by


def test_limits():
    with pytest.raises(ValueError):
        ledger._limited(501)
    assert math.isclose(float(Decimal("0.5")), 0.5)
