"""Where a model may be plugged in: structured calls with retries, extraction of claims, and adjudication of open pairs.

A model is a function from a prompt to text, called inside tasks, one client a task; it is only ever given the rows that
need it. Python makes the calls and cuts the JSON out of the answers; what is in it Spark parses and checks. A call that
fails gives a row that says so.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.claims import RATE_LIMIT_MARKS, TIMEOUT_MARKS, boilerplate

RELATIONS = ("CORROBORATES", "CONTRADICTS", "RECONCILED", "UNRELATED", "NEEDS_REVIEW")
Client = Callable[[str, str], str]
CLAIMS = "facts array<struct<entity:string,attribute:string,value:string,unit:string,period:string,scope:string,qualifiers:map<string,string>,evidence_quote:string,confidence:double>>"
_RETRY = re.compile(r"try again in ([\d.]+)s")


def json_from_text(raw: str | None) -> dict | None:
    """The JSON object in a model's answer: reasoning and code fences cut away, what trails ignored, a bare list as facts."""
    text = re.sub(r"(?is)<think>.*?(</think>|$)", "", raw or "")
    text = re.sub(r"```(?:json)?", "", text).strip()
    starts = [k for k in (text.find("{"), text.find("[")) if k >= 0]
    if not starts:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(text[min(starts) :])
    except ValueError:
        end = max(text.rfind("}"), text.rfind("]"))
        try:
            found = json.loads(text[min(starts) : end + 1])
        except ValueError:
            return None
    return {"facts": found} if isinstance(found, list) else found if isinstance(found, dict) else None


def failure(message: str) -> str:
    """What kind of error a message tells of."""
    low = message.lower()
    return "rate_limited" if any(m in low for m in RATE_LIMIT_MARKS) else "timed_out" if any(m in low for m in TIMEOUT_MARKS) else "extraction_failed"


def wait_before(kind: str, attempt: int, message: str, cap: float = 20.0) -> float:
    """Seconds before the next attempt: after a rate limit what it asks for and a half, else doubling from 2; after a timeout from 1.5; else none."""
    if kind == "rate_limited":
        asked = _RETRY.search(message.lower())
        return min(cap, float(asked[1]) + 0.5 if asked else 2.0 * 2 ** (attempt - 1))
    return min(cap, 1.5 * 2 ** (attempt - 1)) if kind == "timed_out" else 0.0


def structured_calls(rows: DataFrame, key: str, prompt: str, connect: Callable[[], Client], schema: str, models: list[str], attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, call, model, attempts, answer, error): an answer of the ``schema`` for each prompt, or how the call ended.

    ``connect`` makes a task's client, a function of prompt and model. Each model is tried up to ``attempts`` times with
    waits between, then the next one; an answer without JSON or with JSON of another form counts as failed. ``call`` is
    'success', 'rate_limited', 'timed_out' or 'extraction_failed'. Null prompts are empty.
    """
    kind = dict(rows.dtypes)[key]
    asked = rows.select(key, F.coalesce(prompt, F.lit("")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = connect()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                tries, end = 0, ("extraction_failed", None, 0, None, "no model")
                for model in models:
                    for attempt in range(1, attempts + 1):
                        tries += 1
                        try:
                            found = json_from_text(client(text, model))
                            if found is None:
                                raise ValueError("no JSON in the answer")
                            end = ("success", model, tries, json.dumps(found), None)
                            break
                        except Exception as error:  # a client may raise anything; the row says what
                            ended = failure(str(error))
                            end = (ended, model, tries, None, str(error))
                            if attempt < attempts:
                                pause(wait_before(ended, attempt, str(error)))
                    if end[0] == "success":
                        break
                out.append(end)
            columns = list(zip(*out)) or [[]] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[key, "call", "model", "attempts", "json", "error"])

    called = asked.mapInArrow(run, f"{key} {kind}, call string, model string, attempts int, json string, error string")
    read = called.withColumn("answer", F.from_json("json", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = (F.col("call") == "success") & (F.col("answer").isNull() | F.col("answer._corrupt").isNotNull())
    return read.select(key, F.when(bad, "extraction_failed").otherwise(F.col("call")).alias("call"), "model", "attempts", F.when(~bad, F.col("answer").dropFields("_corrupt")).alias("answer"), F.when(bad, "an answer of another form").otherwise(F.col("error")).alias("error"))


def image_prompts(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Chunks with ``data_url``, the picture at their image_ref as a data URL; '' where there is none.

    ``images`` (path, content) are binary files; paths match by their ends, as readers put a scheme before them.
    """
    held = images.select(F.regexp_replace("path", r"^[a-z0-9+]+:/*", "/").alias("image_ref"), F.concat(F.lit("data:image/png;base64,"), F.base64("content")).alias("data_url"))
    return chunks.join(held.dropDuplicates(["image_ref"]), "image_ref", "left").withColumn("data_url", F.coalesce("data_url", F.lit("")))


def valid_claim(claim: Column) -> Column:
    """Whether a claim has what a fact needs: an entity, an attribute, a value, and a confidence within 0 and 1 if any."""
    filled = lambda f: F.trim(F.coalesce(claim[f], F.lit(""))) != ""
    return filled("entity") & filled("attribute") & filled("value") & F.coalesce(claim["confidence"].between(0, 1), F.lit(True))


def extract_facts(chunks: DataFrame, connect: Callable[[], Client], models: list[str], prompt: Column | None = None, vision: bool = False, attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """Claims of chunks (id, document_id, page_number, raw_text, doc_type) by a model, and how its calls ended.

    Boilerplate is not asked about. Claims have the columns of facts; one without entity, attribute or value, or with a
    confidence beyond 0 and 1, is left out and its call counts as failed if none is left. An absent confidence is 0.95. With ``vision`` claims are
    marked so and their confidence is 0.7 at most. Ids are made of the chunk and the claim's place.
    """
    text = prompt if prompt is not None else F.concat_ws("\n", F.concat(F.lit("Document type: "), F.col("doc_type")), F.concat(F.lit("Page: "), F.col("page_number").cast("string")), F.col("raw_text"))
    asked = chunks.where(~boilerplate(F.col("raw_text"))).select(F.col("id").alias("chunk_id"), "document_id", text.alias("prompt"))
    called = structured_calls(asked, "chunk_id", "prompt", connect, CLAIMS, models, attempts, pause)
    good = F.filter(F.col("answer.facts"), valid_claim)
    refused = (F.col("call") == "success") & (F.size("answer.facts") > 0) & (F.size(good) == 0)
    calls = called.select("chunk_id", F.when(F.coalesce(refused, F.lit(False)), "extraction_failed").otherwise(F.col("call")).alias("call"), "attempts", "error")
    claims = called.select("chunk_id", F.posexplode(good).alias("place", "c")).join(asked.select("chunk_id", "document_id"), "chunk_id")
    marks = F.coalesce("c.qualifiers", F.create_map().cast("map<string,string>"))
    if vision:
        marks = F.map_concat(F.map_filter(marks, lambda k, v: k != "extraction_path"), F.create_map(F.lit("extraction_path"), F.lit("vision")))
    confidence = F.coalesce("c.confidence", F.lit(0.95))
    own = F.sha2(F.concat_ws("|", "chunk_id", F.col("place").cast("string")), 256)
    fields = (F.col(f"c.{f}").alias(f) for f in ("entity", "attribute", "value", "unit", "period", "scope"))
    facts = claims.select(own.alias("id"), "chunk_id", "document_id", *fields, F.to_json(marks).alias("qualifiers"), F.coalesce("c.evidence_quote", F.lit("")).alias("evidence_quote"), (F.least(confidence, F.lit(0.7)) if vision else confidence).alias("confidence"), F.current_timestamp().alias("created_at"))
    return facts, calls


def adjudicate(decided: DataFrame, judge: Callable[[dict, dict], dict]) -> DataFrame:
    """(pair_id, relation_type, decision_route, review_reason, decision_confidence) of all pairs.

    Only pairs that no rule decided reach ``judge``, with both claims as dicts; an answer that is malformed, names no
    known relation, or an exception sends the pair to review.
    """
    columns = ["relation_type", "decision_route", "review_reason", "decision_confidence"]
    schema = "pair_id string, relation_type string, decision_route string, review_reason string, decision_confidence double"
    open_ = decided.where("relation_type is null").select(F.col("id").alias("pair_id"), F.to_json("a").alias("a"), F.to_json("b").alias("b"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pair, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    answer = judge(json.loads(a), json.loads(b))
                    confidence = float(answer.get("confidence", 0.9))
                    if answer["relation_type"] not in RELATIONS or not 0 <= confidence <= 1:
                        raise ValueError(answer)
                    out.append((pair, answer["relation_type"], "llm_adjudication", answer.get("review_reason"), confidence))
                except Exception:
                    out.append((pair, "NEEDS_REVIEW", "ambiguity_firewall", "adjudication_unavailable", 0.5))
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, types)], names=["pair_id", *columns])

    return decided.where("relation_type is not null").select(F.col("id").alias("pair_id"), *columns).unionByName(open_.mapInArrow(ask, schema))


def scope_judge(a: dict, b: dict) -> dict:
    """An offline stand-in for a model: different scopes or periods reconcile, aligned different values contradict."""
    differ = lambda f: bool((a.get(f) or "").strip() and (b.get(f) or "").strip() and a[f].strip().lower() != b[f].strip().lower())
    return {"relation_type": "RECONCILED" if differ("scope") or differ("period") else "CONTRADICTS", "confidence": 0.6}


#: Signs and units of amounts.
_SIGN, _SCALE = r"(?:US\$|[₹$]|INR|USD|Rs\.?)", r"(?:crore|cr|lakh|million|mn|bn|billion|per cent|percent|%|bps|tonnes|km|MW|units)"
AMOUNT = rf"(?i)(?:{_SIGN}\s?\d[\d,]*(?:\.\d+)?(?:\s?{_SCALE})?|\d[\d,]*(?:\.\d+)?\s?{_SCALE})"


def extract_amounts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, ordinal, value, evidence_quote): each amount with a sign or a unit, and the sentence it stands in, without a model.

    Boilerplate is left out; sentences end at a full stop, a question or exclamation mark before a space, or at a line break.
    """
    kept = chunks.where(~boilerplate(F.col("raw_text")))
    sentences = F.transform(F.split(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"([.!?])\s+", "$1\n"), "\n+"), lambda x: F.trim(x))
    found = F.flatten(F.transform(sentences, lambda x: F.transform(F.regexp_extract_all(x, F.lit(AMOUNT), F.lit(0)), lambda v: F.struct(F.trim(v).alias("value"), x.alias("evidence_quote")))))
    return kept.select(F.col("id").alias("chunk_id"), F.posexplode(found).alias("ordinal", "f")).select("chunk_id", "ordinal", "f.*")
