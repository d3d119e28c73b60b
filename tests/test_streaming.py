import threading
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimforge.operators import similarity
from claimforge.operators.embedding import hashing_model
from claimforge.session import Scratch
from claimforge.streaming.ingest import Batches, job_states, job_status, stream_candidates, stream_fact_counts, stream_job_states, stream_new_uploads, stream_table


def write(spark, path, rows, schema="id string, document_id string, canonical_statement string"):
    df = spark.createDataFrame(rows, schema)
    df.selectExpr("*", "timestamp'2025-01-01' as created_at").coalesce(1).write.mode("append").parquet(path)


def test_facts_in_batches(spark, tmp_path):
    path = str(tmp_path / "facts")
    write(spark, path, [("a", "d1", "Acme net sales 5"), ("b", "d1", "board plan")])
    write(spark, path, [("c", "d2", "Acme net sales 5"), ("a", "d1", "Acme net sales 5")])
    counts = {r.document_id: r.facts for r in stream_fact_counts(spark, path).collect()}
    assert counts == {"d1": 2, "d2": 1}
    found = {(r.query_id, r.cand_id) for r in stream_candidates(spark, path, hashing_model(64)).collect()}
    # Files of one second come in either order; the later of a and c sees the earlier one.
    assert found & {("a", "c"), ("c", "a")} and not any("b" in pair for pair in found)


def test_packed_vectors():
    x = similarity.scaled(np.array([[0, 3, 0, 4], [0, 0, 0, 0], [1, 2, 3, 4]]))
    packed = similarity.pack(x)
    assert (similarity.unpack(packed) == x).all() and (similarity.unpack(packed.slice(1)) == x[1:]).all()
    assert (similarity.unpack(packed.cast(pa.large_binary())) == x).all()


def test_candidates_meet_what_arrived_and_the_index_is_fitted_seldom(spark, tmp_path, monkeypatch):
    path, fits, fit = str(tmp_path / "facts"), [], similarity._centroids
    monkeypatch.setattr(similarity, "_centroids", lambda *a: fits.append(1) or fit(*a))
    model, seen, want = hashing_model(64), [], set()
    words = "net sales of acme rose by five".split()
    rng = np.random.default_rng(5)
    for n in range(8):
        rows = [(f"{n:02}-{m}", "d", " ".join(rng.choice(words, 4))) for m in range(8)] + [(f"{n:02}-s", "d", "same words here"), (f"{n:02}-n", "d", None)]
        write(spark, path, [*rows, *seen[-2:]])
        seen += rows
    order = [r.id for r in spark.read.parquet(path).selectExpr("id", "_metadata.file_modification_time t").groupBy("id").agg(F.min("t").alias("t")).orderBy("t").collect()]
    texts = {r[0]: r[2] or "" for r in seen}
    x = similarity.scaled(model([texts[i] for i in order]))
    score = np.round((x @ x.T).astype(float), 6)
    batch = [i.split("-")[0] for i in order]
    for a, q in enumerate(order):
        others = sorted((-score[a, b], c) for b, c in enumerate(order) if c != q and batch[b] <= batch[a] and score[a, b] >= 0.76)
        want |= {(q, c) for _, c in others[:4]}
    # Of sixteen lists all are asked, so the index leaves nothing out.
    monkeypatch.setattr("claimforge.streaming.ingest.Index.__init__.__defaults__", (16,))
    got = [(r.query_id, r.cand_id) for r in stream_candidates(spark, path, model).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    assert len(fits) <= 4


def test_blocks_of_one_list_and_ties(spark):
    """A list of many equal rows is cut into blocks; the best of all are the smallest ids."""
    x = similarity.scaled(np.ones((300, 8)))
    rows = spark.createDataFrame([(f"{k:03}", bytes(v)) for k, v in enumerate(v.as_py() for v in similarity.pack(x))], "id string, v binary")
    placed = similarity.in_lists(rows, spark.sparkContext.broadcast(similarity.fit_lists(rows, 300)), 16)
    got = {}
    for r in similarity.ask_lists(placed, placed.drop("asks"), 3, block=64, stretch=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.cand_id, r.score))
    assert len(got) == 300 and sorted(got["001"]) == [(1, "000", 1.0), (2, "002", 1.0), (3, "003", 1.0)]
    assert all([c for _, c, _ in sorted(v)] == ["000", "001", "002"] for k, v in got.items() if k > "002")


def test_uploads_of_one_content(spark, tmp_path):
    path = str(tmp_path / "uploads")
    for rows in ([("a", "h1"), ("b", "h1"), ("c", None)], [("d", "h2"), ("a", "h1")]):
        spark.createDataFrame([(i, h) for i, h in rows], "id string, content_hash string").withColumn("upload_ts", F.lit("2025-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    assert {tuple(r) for r in stream_new_uploads(spark, path).collect()} == {("h1", "a"), ("h2", "d")}


def test_batches_are_idempotent_and_compacted(spark):
    table = Batches(Scratch(spark, "test"), "t", "n bigint", compact=3)
    for number in range(9):
        for _ in range(2):  # a batch that is run again
            table.write(spark.range(number, number + 1).toDF("n"), number)
        assert len(table.parts) <= 4
    assert sorted(r.n for r in table.all().collect()) == list(range(9))
    assert sorted(r.n for r in table.before(8).collect()) == list(range(8))


def test_job_status():
    assert job_status(["success", ""]) == "EXTRACTING" and job_status(["success", "timed_out"]) == "RECONCILING" and job_status(["cancelled", "rate_limited"]) == "FAILED"


def test_jobs(spark, tmp_path):
    path = str(tmp_path / "chunks")
    schema = "id string, document_id string, extraction_status string"
    write(spark, path, [("1", "a", "success"), ("2", "a", "timed_out"), ("3", "b", "pending"), ("1", "a", "success"), ("4", "c", "cancelled")], schema)
    assert {tuple(r) for r in stream_job_states(spark, path).collect()} == {("a", "RECONCILING", 2, 1), ("b", "EXTRACTING", 1, 0), ("c", "FAILED", 1, 1)}


def test_jobs_end_at_their_deadline(spark, tmp_path):
    path, got, done = str(tmp_path / "chunks"), [], threading.Event()
    write(spark, path, [("1", "a", "pending"), ("2", "a", "timed_out")], "id string, document_id string, extraction_status string")
    rows = stream_table(spark, path).select("document_id", "id", F.coalesce("extraction_status", F.lit("")).alias("outcome"))

    def each(batch, number):
        got.extend(tuple(r) for r in batch.collect())
        if len(got) > 1:
            done.set()

    query = job_states(rows, deadline_ms=500).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="300 milliseconds").start()
    began = time.time()
    done.wait(60)
    query.stop()
    assert got[:2] == [("a", "EXTRACTING", 2, 1), ("a", "FAILED", 2, 2)] and time.time() - began < 60
