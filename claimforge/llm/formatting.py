"""Duplicates hidden by formatting differences.

Method: each record gets a full key free of formatting; the records are range-partitioned and sorted by
(key, id), which Spark does externally with spill, and a scan over adjacent records compares full keys. Since the
id is part of the range key, copies of one record spread over as many partitions as they need, however many
there are. A run that crosses a partition's border is joined up from the first and last runs of the partitions,
two rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.functions.text import words, words_and_signs
from claimforge.session import Scratch

_SCHEMA = pa.schema([("part", pa.int32()), ("opening", pa.bool_()), ("first_id", pa.string()), ("copy_id", pa.string()), ("n", pa.int64()), ("key", pa.string())])
_DDL = "part int, opening boolean, first_id string, copy_id string, n bigint, key string"


def record_key(ordered: list[Column], bag: list[Column]) -> Column:
    """Texts whose words must agree in order, and texts whose words, numbers and signs must agree in any order."""
    parts = [F.array_join(words(c), " ") for c in ordered] + [F.array_join(F.sort_array(words_and_signs(c)), " ") for c in bag]
    return F.concat_ws("\u0001", *parts)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows per run (n records) and per copy of a run; the last two rows name the opening and the closing run."""
    part = TaskContext.get().partitionId()
    key = last_id = first = head = head_key = None
    opening = True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0), batch.column(1)
        n = len(keys)
        new = np.ones(n, bool)
        new[0] = keys[0].as_py() != key
        if n > 1:
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        again = np.zeros(n, bool)
        again[0] = not new[0] and ids[0].as_py() == last_id
        if n > 1:
            again[1:] = ~new[1:] & pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        if head is None:
            head, head_key = ids[0].as_py(), keys[0].as_py()
            later = np.cumsum(new) > 1
        elif opening:
            later = np.cumsum(new) > 0
        else:
            later = np.ones(n, bool)
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        starts = pc.take(ids, pa.array(np.maximum(at, 0)))
        if at[0] < 0:
            starts = pc.if_else(pa.array(at < 0), pa.scalar(first, pa.string()), starts)
        keep = np.flatnonzero(~again)
        copies = keep[~new[keep]]
        runs, counts = np.unique(at[keep], return_counts=True)
        run_first = pc.take(starts, pa.array(np.maximum(runs, 0)))
        run_later = later[np.maximum(runs, 0)]
        yield pa.record_batch([
            pa.array(np.full(len(runs) + len(copies), part, np.int32)),
            pa.array(~np.concatenate([run_later, later[copies]])),
            pa.concat_arrays([run_first, pc.take(starts, pa.array(copies))]),
            pa.concat_arrays([pa.nulls(len(runs), pa.string()), pc.take(ids, pa.array(copies))]),
            pa.array(np.concatenate([counts, np.zeros(len(copies), np.int64)]).astype(np.int64)),
            pa.nulls(len(runs) + len(copies), pa.string()),
        ], schema=_SCHEMA)
        opening = opening and not later[-1]
        key, last_id, first = keys[n - 1].as_py(), ids[n - 1].as_py(), starts[n - 1].as_py()
    if head is not None:
        yield pa.record_batch([pa.array([part, part], pa.int32()), pa.array([True, opening]), pa.array([head, first]), pa.nulls(2, pa.string()), pa.array([0, 0], pa.int64()), pa.array([head_key, key])], schema=_SCHEMA)


def _scanned(records: DataFrame, id_col: str, ordered: list[str], bag: list[str], partitions: int | None) -> DataFrame:
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = records.select(record_key([F.col(c) for c in ordered], [F.col(c) for c in bag]).alias("key"), F.col(id_col).cast("string").alias("id")).where("id is not null")
    runs = Scratch(spark, "formatting").write(keyed.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(_scan, _DDL), "runs")
    # At most two rows a partition, so the broadcast is bounded by the number of partitions.
    ends = runs.where("key is not null")
    whole = ends.groupBy("key").agg(F.min("first_id").alias("whole_id"))
    carried = ends.where("opening").join(whole, "key").groupBy("part").agg(F.min("whole_id").alias("whole_id"), F.lit(True).alias("opening"))
    return runs.where("key is null").join(F.broadcast(carried), ["part", "opening"], "left").withColumn("whole_id", F.coalesce("whole_id", "first_id"))


def formatting_copies(records: DataFrame, id_col: str, ordered: list[str], bag: list[str], partitions: int | None = None) -> DataFrame:
    """(first_id, copy_id): for records that are equal but for formatting, the smallest id and each other id.

    Null texts are empty texts; records whose texts are all empty are copies of each other. Rows without an id are
    left out, rows that repeat an id with the same texts count once. Other columns are ignored.
    """
    runs = _scanned(records, id_col, ordered, bag, partitions)
    return runs.select(F.col("whole_id").alias("first_id"), F.coalesce("copy_id", F.when(F.col("opening"), F.col("first_id"))).alias("copy_id")).where("copy_id <> first_id").distinct()


def formatting_groups(records: DataFrame, id_col: str, ordered: list[str], bag: list[str], partitions: int | None = None) -> DataFrame:
    """(first_id, copies): one row per different record, with the number of ids that carry it (1 if it has no copy)."""
    runs = _scanned(records, id_col, ordered, bag, partitions)
    return runs.groupBy(F.col("whole_id").alias("first_id")).agg(F.sum("n").alias("copies"))
