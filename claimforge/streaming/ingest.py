"""Incremental ingest with Structured Streaming: each batch is deduplicated and matched against what is there.

What has been seen lives in tables of the shared folder, not in the state of a stream: a batch writes under its own
number, so one that is run again replaces what it wrote and each row counts once, and every so many batches the small
tables become one. State is kept only where it ends: windows until the watermark, jobs until their deadline.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimforge.operators.embedding import embed_packed
from claimforge.operators.similarity import ask_lists, fit_lists, in_lists
from claimforge.session import Scratch


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream of its files; further files of the folder follow."""
    schema = spark.read.parquet(path).schema
    # A pattern serves folders and single files alike.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


class Batches:
    """A table that grows by one part a batch; every ``compact`` parts become one."""

    def __init__(self, scratch: Scratch, name: str, schema: str, compact: int = 16):
        self.scratch, self.name, self.schema, self.compact = scratch, name, schema, compact
        self.parts: list[tuple[int, str]] = []
        self.merges = 0

    def before(self, number: int) -> DataFrame:
        paths = [f"{self.scratch.base}/{part}" for n, part in self.parts if n < number]
        reader = self.scratch.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.scratch.spark.createDataFrame([], self.schema)

    def all(self) -> DataFrame:
        return self.before(1 << 62)

    def write(self, rows: DataFrame, number: int) -> DataFrame:
        part = f"{self.name}/{number}"
        written = self.scratch.write(rows, part)
        self.parts = [p for p in self.parts if p[0] != number] + [(number, part)]
        if len(self.parts) > self.compact:
            # The last part stays by itself, as its batch may be run again.
            self.rewrite(self.before(number), number)
        return written

    def rewrite(self, rows: DataFrame, number: int) -> None:
        """These rows as one part in place of those before a batch."""
        older = [p for p in self.parts if p[0] < number]
        self.merges += 1
        merged = f"{self.name}/upto{older[-1][0]}-{self.merges}"
        self.scratch.write(rows, merged)
        self.parts = [(older[-1][0], merged), *(p for p in self.parts if p[0] >= number)]
        for _, path in older:
            self.scratch.drop(path)


def _run(rows: DataFrame, scratch: Scratch, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    writer = rows.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{scratch.base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


def _once(batch: DataFrame, seen: Batches, number: int, key: str) -> DataFrame:
    return batch.dropDuplicates([key]).join(seen.before(number).select(key), key, "left_anti")


def stream_fact_counts(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, facts): facts per document from a stream in which facts may be delivered again, however late.

    A batch adds its new ids and its counts; neither the stream nor a batch holds more than that.
    """
    scratch = Scratch(spark, "stream")
    ids, counts = Batches(scratch, "ids", "id string"), Batches(scratch, "counts", "document_id string, facts bigint")

    def each(batch: DataFrame, number: int) -> None:
        fresh = scratch.write(_once(batch, ids, number, "id"), f"fresh/{number}")
        ids.write(fresh.select("id"), number)
        counts.write(fresh.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts")), number)
        scratch.drop(f"fresh/{number}")

    _run(stream_table(spark, path).select("id", "document_id"), scratch, each)
    return counts.all().groupBy("document_id").agg(F.sum("facts").alias("facts"))


def stream_new_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(content_hash, id): the upload that first brought each content; later ones of the same content are known.

    Within a batch the oldest upload is first, then the smaller id. Uploads without a hash are left out.
    """
    scratch = Scratch(spark, "stream")
    known = Batches(scratch, "known", "content_hash string, id string")

    def each(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("content_hash").agg(F.min(F.struct("upload_ts", "id")).alias("f")).select("content_hash", F.col("f.id").alias("id"))
        known.write(first.join(known.before(number).select("content_hash"), "content_hash", "left_anti"), number)

    _run(stream_table(spark, path).where("content_hash is not null").select("content_hash", "id", "upload_ts"), scratch, each)
    return known.all()


def stream_windows(spark: SparkSession, path: str, time: str, kind: str, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """(window_start, kind, n): events per window and kind, as of the end of the stream.

    A batch puts out the windows that it changed; windows older than the watermark leave the state, and events for them are dropped.
    """
    scratch = Scratch(spark, "stream")
    counted = stream_table(spark, path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    changed = Batches(scratch, "windows", f"window_start timestamp, {kind} string, n bigint, batch bigint")

    def each(batch: DataFrame, number: int) -> None:
        changed.write(batch.select(F.col("w.start").alias("window_start"), kind, "n", F.lit(number).cast("bigint").alias("batch")), number)

    _run(counted, scratch, each, "update")
    return changed.all().groupBy("window_start", kind).agg(F.max_by("n", "batch").alias("n"))


#: Outcomes of a chunk that leave its job open, and that count as failed.
OPEN = ("", "pending")
FAILED = ("rate_limited", "extraction_failed", "timed_out", "cancelled")


def job_status(outcomes: list[str]) -> str:
    """EXTRACTING while a chunk is open, FAILED if all have failed, else RECONCILING."""
    if any(o in OPEN for o in outcomes):
        return "EXTRACTING"
    return "FAILED" if all(o in FAILED for o in outcomes) else "RECONCILING"


_JOBS = "document_id string, status string, chunks bigint, failed bigint"


def job_states(outcomes: DataFrame, deadline_ms: int | None = None) -> DataFrame:
    """(document_id, status, chunks, failed): the job of each document by the outcomes of its chunks as they come in.

    ``outcomes`` is a stream of (document_id, id, outcome). The state of a job is the last outcome of each of its chunks,
    so a chunk delivered again counts once. With ``deadline_ms`` a job with open chunks of which nothing is heard for so
    long ends: its open chunks count as timed out. Such a stream needs a trigger that goes on, as time passes without data.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            held = {k: "timed_out" if v in OPEN else v for k, v in held.items()}
        else:
            for frame in frames:
                held.update(zip(frame["id"], frame["outcome"]))
        ended = list(held.values())
        status = job_status(ended)
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((json.dumps(held),))
            if deadline_ms is not None and status == "EXTRACTING":
                state.setTimeoutDuration(deadline_ms)
        yield pd.DataFrame({"document_id": [key[0]], "status": [status], "chunks": [len(ended)], "failed": [sum(o in FAILED for o in ended)]})

    timeout = GroupStateTimeout.NoTimeout if deadline_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return outcomes.groupBy("document_id").applyInPandasWithState(advance, _JOBS, "held string", "update", timeout)


def stream_job_states(spark: SparkSession, path: str) -> DataFrame:
    """``job_states`` of a table of chunks, as of the end of the stream."""
    scratch = Scratch(spark, "stream")
    changed = Batches(scratch, "jobs", f"{_JOBS}, batch bigint")

    def each(batch: DataFrame, number: int) -> None:
        changed.write(batch.withColumn("batch", F.lit(number).cast("bigint")), number)

    rows = stream_table(spark, path).select("document_id", "id", F.coalesce("extraction_status", F.lit("")).alias("outcome"))
    _run(job_states(rows), scratch, each, "update")
    last = changed.all().groupBy("document_id").agg(F.max_by(F.struct("status", "chunks", "failed"), "batch").alias("s"))
    return last.select("document_id", "s.*")


class Index:
    """An inverted-file index that grows by batches.

    A batch places its own rows only. Centroids are fitted anew, and all rows placed again, when there are more than
    twice the rows they were last fitted for; so a row is placed a few times, however many batches follow.
    """

    def __init__(self, scratch: Scratch, probes: int = 8):
        self.scratch, self.probes, self.fitted, self.centres = scratch, probes, 0, None
        self.rows = Batches(scratch, "index", "id string, cell int, v binary")
        self.sizes: dict[int, int] = {}

    def add(self, vectors: DataFrame, number: int) -> DataFrame | None:
        """(id, cell, asks, v) of a batch's packed vectors, which are then in the index; None while there are no rows at all."""
        before = self.rows.before(number)
        self.sizes[number] = vectors.count()
        n = sum(size for at, size in self.sizes.items() if at <= number)
        if n > 2 * self.fitted:
            centres = self.scratch.spark.sparkContext.broadcast(fit_lists(before.select("id", "v").unionByName(vectors), n))
            if any(p[0] < number for p in self.rows.parts):
                self.rows.rewrite(in_lists(before, centres, 1).drop("asks"), number)
            self.fitted, self.centres = n, centres
        return self.rows.write(in_lists(vectors, self.centres, self.probes), number) if self.centres else None

    def until(self, number: int) -> DataFrame:
        return self.rows.before(number + 1)


def stream_candidates(spark: SparkSession, path: str, model: Callable[[list[str]], np.ndarray], k: int = 4, threshold: float = 0.76) -> DataFrame:
    """(query_id, cand_id, score): facts as they arrive, matched against all that has arrived by then.

    Each batch adds its new facts to the index and then looks all of them up, so a fact sees earlier ones and its own batch.
    """
    scratch = Scratch(spark, "stream")
    index = Index(scratch)
    found = Batches(scratch, "found", "query_id string, cand_id string, score double")

    def each(batch: DataFrame, number: int) -> None:
        # The batch is the side that is held in memory; the index, which is larger, only streams past it.
        again = index.rows.before(number).select("id").join(batch.select("id").hint("shuffle_hash"), "id", "left_semi")
        fresh = batch.dropDuplicates(["id"]).join(again, "id", "left_anti")
        vectors = scratch.write(embed_packed(fresh, "id", "canonical_statement", model), f"fresh/{number}")
        if (added := index.add(vectors, number)) is not None:
            found.write(ask_lists(added, index.until(number), k, threshold).select("query_id", "cand_id", "score"), number)
        scratch.drop(f"fresh/{number}")

    _run(stream_table(spark, path, 1).select("id", "canonical_statement"), scratch, each)
    return found.all()
