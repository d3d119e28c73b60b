"""Top-k similarity of vectors: exact for a stated query set, and an inverted-file index for all rows.

Exact: queries travel in blocks of bounded size to where the rows are; each task keeps the best k of its rows for
each query, and only these are shuffled. Approximate: centroids are fitted on a bounded sample, their number grows with
the root of the rows, every row goes to its nearest centroid, and a query meets the rows of the nearest few. Large lists
are cut into blocks; a task holds one block and the queries stream past it, so neither rows nor queries are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimforge.session import Scratch


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 4, threshold: float = 0.76, visible: bool = False, block: int = 2000, without: str | None = None) -> DataFrame:
    """(query_id, cand_id, score, rank): for each query the k most similar other rows of at least the threshold.

    Both tables have (id, seq, embedding); ids are numbers or texts. With ``visible`` a query meets only rows of a seq
    not beyond its own; with ``without`` none with the same value of that column, null aside. Scores
    are rounded to six decimals, ties go to the smaller id. Null and empty vectors match nothing; vectors must be of
    one length.
    """
    spark, found, held = rows.sparkSession, None, []
    kind = dict(rows.dtypes)["id"]
    schema = f"query_id {kind}, cand_id {kind}, score double"
    other = F.col(without).alias("_apart") if without else F.lit(None).cast("string").alias("_apart")

    def search(part: list[tuple]) -> DataFrame:
        ids, seqs, apart = np.array([p[0] for p in part]), np.array([p[1] for p in part]), np.array([p[3] for p in part], object)
        shared = spark.sparkContext.broadcast((ids, seqs, _unit([p[2] for p in part]), apart))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qseq, q, qapart = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                rid, rseq = np.array(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist())
                score = np.round(q @ _unit(batch.column(2).to_pylist()).T, 6)
                score[qid[:, None] == rid[None, :]] = -2
                if visible:
                    score[rseq[None, :] > qseq[:, None]] = -2
                if without:
                    rapart = np.array(batch.column(3).to_pylist(), object)
                    score[(qapart[:, None] == rapart[None, :]) & (rapart != None)[None, :]] = -2  # noqa: E711
                score[score < threshold] = -2
                order = np.lexsort((np.broadcast_to(rid, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, 1)
                i, j = np.nonzero(best > -2)
                yield pa.record_batch([pa.array(qid[i]), pa.array(rid[order[i, j]]), pa.array(best[i, j])], names=["query_id", "cand_id", "score"])

        return rows.select("id", "seq", "embedding", other).where("size(embedding) > 0").mapInArrow(compare, schema)

    for r in queries.select("id", "seq", "embedding", other).where("size(embedding) > 0").toLocalIterator():
        held.append(tuple(r))
        if len(held) == block:
            found, held = search(held) if found is None else found.unionByName(search(held)), []
    if held:
        found = search(held) if found is None else found.unionByName(search(held))
    if found is None:
        found = spark.createDataFrame([], schema)
    return _best(found, k)


def _centroids(sample: np.ndarray, n: int, steps: int = 12) -> np.ndarray:
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)].copy()
    for _ in range(steps):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as float32, of unit length."""
    x = x.astype(np.float32, copy=False)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a batch as rows of unit length."""
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def list_count(rows: int, least: int = 16, most: int = 4096) -> int:
    """Lists of an index: the root of its rows, so that a list and the table of lists grow alike."""
    return int(min(most, max(least, rows**0.5)))


def indexed_top_k(queries: DataFrame, rows: DataFrame, k: int = 4, threshold: float = -1.0, lists: int | None = None, probes: int = 8, sample_rows: int = 20_000, block: int = 4096) -> DataFrame:
    """(query_id, cand_id, score, rank) by an inverted-file index: each row is in one list, a query asks ``probes`` of them.

    Both tables have (id, embedding). The index holds every row; only its centroids are fitted on the ``sample_rows`` of
    least hash. Scores are rounded to six decimals, ties go to the smaller id. Null and empty vectors match nothing.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    vectors = lambda df: df.select("id", F.col("embedding").cast("array<float>").alias("v")).where("size(v) > 0")
    held, asked = vectors(rows), vectors(queries)
    n = held.count()
    sample = held.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()["v"].combine_chunks() if n else None
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, cand_id {kind}, score double, rank int")
    shared = spark.sparkContext.broadcast(_centroids(_matrix(sample), lists or list_count(n)).astype(np.float32))

    def assign(probe: int):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1))
                score = x @ shared.value.T
                few = min(probe, score.shape[1])
                near = np.argpartition(-score, few - 1, axis=1)[:, :few]
                at = pa.array(np.repeat(np.arange(len(x)), few))
                v = pa.FixedSizeListArray.from_arrays(pa.array(x[at.to_numpy()].ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(near.ravel().astype(np.int32)), v], names=["id", "cell", "v"])

        return place

    placed = f"id {kind}, cell int, v array<float>"
    in_lists, asking = held.mapInArrow(assign(1), placed), asked.mapInArrow(assign(probes), placed)
    # As many blocks as the list has rows for; the table has one row a list, at most some thousand.
    blocks = F.broadcast(in_lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    own = in_lists.join(blocks, "cell").select("id", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("held"), "v")
    others = asking.join(blocks, "cell").select("id", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("held"), "v")
    both = own.unionByName(others).repartition("cell", "block").sortWithinPartitions("cell", "block", F.desc("held"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, parts, matrix = None, [], [], None
        for batch in batches:
            places = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            flags = batch.column(3).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(places, axis=0) != 0).any(axis=1) | (np.diff(flags.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if hi <= lo:
                    continue
                here = tuple(places[lo])
                if here != place:
                    place, ids, parts, matrix = here, [], [], None
                stretch = batch.slice(lo, hi - lo)
                if flags[lo]:
                    ids.append(np.array(stretch.column(0).to_pylist()))
                    parts.append(_matrix(stretch.column(4)))
                    matrix = None
                    continue
                if not parts:
                    continue
                if matrix is None:
                    matrix, ids, parts = np.concatenate(parts), [np.concatenate(ids)], [np.concatenate(parts)]
                asker = np.array(stretch.column(0).to_pylist())
                score = np.round((_matrix(stretch.column(4)) @ matrix.T).astype(np.float64), 6)
                score[asker[:, None] == ids[0][None, :]] = -2
                score[score < threshold] = -2
                order = np.lexsort((np.broadcast_to(ids[0], score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, 1)
                i, j = np.nonzero(best > -2)
                yield pa.record_batch([pa.array(asker[i]), pa.array(ids[0][order[i, j]]), pa.array(best[i, j])], names=["query_id", "cand_id", "score"])

    return _best(both.mapInArrow(compare, f"query_id {kind}, cand_id {kind}, score double").distinct(), k)


_PAIR = np.dtype([("at", "<u2"), ("x", "<f4")])


def pack(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as bytes: coordinates other than zero, and always the last one, which tells how many there are."""
    if not 0 < x.shape[1] <= 1 << 16:
        raise ValueError("vectors have 1 to 65,536 coordinates")
    keep = x != 0
    keep[:, -1] = True
    i, j = np.nonzero(keep)
    pairs = np.empty(len(i), _PAIR)
    pairs["at"], pairs["x"] = j, x[i, j]
    ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]) * _PAIR.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(pairs.tobytes())])


def unpack(column: pa.Array) -> np.ndarray:
    """The matrix of packed rows."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    pairs = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(_PAIR)
    x = np.zeros((len(column), int(pairs["at"][-1]) + 1), np.float32)
    x[np.repeat(np.arange(len(x)), np.diff(ends) // _PAIR.itemsize), pairs["at"]] = pairs["x"]
    return x


def fit_lists(rows: DataFrame, n: int, sample_rows: int = 20_000) -> np.ndarray:
    """Centroids of an index over n packed rows (id, v), fitted on the ``sample_rows`` of least hash."""
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    return _centroids(unpack(sample), list_count(n)).astype(np.float32)


def in_lists(rows: DataFrame, centres: Broadcast, probes: int) -> DataFrame:
    """(id, cell, asks, v): packed rows (id, v) with their list and the ``probes`` nearest ones, which a query asks."""
    kind = dict(rows.dtypes)["id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = unpack(batch.column(1)) @ centres.value.T
            few = min(probes, score.shape[1])
            near = np.argpartition(-score, few - 1, axis=1)[:, :few].astype(np.int32)
            cell = np.take_along_axis(near, np.take_along_axis(score, near, 1).argmax(axis=1)[:, None], 1).ravel()
            asks = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), few).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), asks, batch.column(1)], names=["id", "cell", "asks", "v"])

    return rows.select("id", "v").mapInArrow(place, f"id {kind}, cell int, asks array<int>, v binary")


def _first(i: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k of each query i, ties by rank."""
    order = np.lexsort((rank, -score, i))
    by = i[order]
    begins = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
    return order[np.arange(len(by)) - np.repeat(begins, np.diff(np.append(begins, len(by)))) < k]


def ask_lists(asking: DataFrame, held: DataFrame, k: int = 4, threshold: float = 0.76, block: int = 4096, stretch: int = 256) -> DataFrame:
    """(query_id, cand_id, score, rank): for each of (id, asks, v) the best k of (id, cell, v), packed rows as ``in_lists`` gives them.

    As in ``indexed_top_k`` large lists are cut into blocks, and queries stream past the one that a task holds; scores
    are rounded to six decimals and ties go to the smaller id. Only scores of the threshold or more are looked at singly.
    """
    spark, kind = held.sparkSession, dict(held.dtypes)["id"]
    # As many blocks as the list has rows for; the table has one row a list, at most some thousand.
    blocks = F.broadcast(held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    slot = lambda at, asks: (F.shiftleft(F.col("cell").cast("bigint"), 32) + at.cast("bigint") * 2 + asks).alias("slot")
    own = held.join(blocks, "cell").select(slot(F.pmod(F.xxhash64("id"), F.col("blocks")), 0), "id", "v")
    others = asking.select("id", F.explode("asks").alias("cell"), "v").join(blocks, "cell")
    others = others.select("id", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "v").select(slot(F.col("at"), 1), "id", "v")
    # A set number of partitions: by their bytes they would become few, but their work is in the products.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = own.unionByName(others).repartition(parts, F.shiftright("slot", 1)).sortWithinPartitions("slot")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, matrix, rank = -1, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            slots, names, x, found = batch.column(0).to_numpy(), batch.column(1), unpack(batch.column(2)), []
            edges = (np.flatnonzero(np.diff(slots)) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, len(slots)]):
                here, asks = divmod(int(slots[lo]), 2)
                if here != place:
                    place, ids, matrix, rank = here, [], [], None
                if not asks:
                    ids.append(names.slice(lo, hi - lo))
                    matrix.append(x[lo:hi].copy())
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, matrix = [pa.concat_arrays(ids)], [np.concatenate(matrix)]
                for at in range(lo, hi, stretch):
                    score = x[at : min(at + stretch, hi)] @ matrix[0].T
                    # Rounding may lift a score to the threshold.
                    i, j = np.divmod(np.flatnonzero(score.ravel() >= threshold - 1e-6), score.shape[1])
                    if not len(i):
                        continue
                    s = np.round(score[i, j].astype(np.float64), 6)
                    other = pc.not_equal(names.take(pa.array(i + at)), ids[0].take(pa.array(j))).to_numpy(zero_copy_only=False) & (s >= threshold)
                    i, j, s = i[other], j[other], s[other]
                    if len(i) and np.bincount(i).max() > k:
                        if rank is None:
                            rank = np.empty(len(ids[0]), np.int64)
                            rank[pc.sort_indices(ids[0]).to_numpy()] = np.arange(len(rank))
                        best = _first(i, s, rank[j], k)
                        i, j, s = i[best], j[best], s[best]
                    found.append(pa.RecordBatch.from_arrays([names.take(pa.array(i + at)), ids[0].take(pa.array(j)), pa.array(s)], names=["query_id", "cand_id", "score"]))
            yield from found

    return _best(both.mapInArrow(compare, f"query_id {kind}, cand_id {kind}, score double"), k)


def classes(rows: DataFrame, key: str, text: str, members: int = 5, salts: int = 64) -> DataFrame:
    """(class_id, text, members): rows of equal text as one, with the ``members`` smallest ids; class_id is the smallest.

    A text that a third of all rows have is reduced in as many parts first. Null texts are empty.
    """
    held = rows.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    part = Window.partitionBy("text", F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy("id")
    few = held.withColumn("n", F.row_number().over(part)).where(F.col("n") <= members)
    by = few.groupBy("text").agg(F.slice(F.array_sort(F.collect_list("id")), 1, members).alias("members"))
    return by.select(F.col("members")[0].alias("class_id"), "text", "members")


def candidates_by_text(rows: DataFrame, key: str, text: str, embed: Callable[[DataFrame], DataFrame], k: int = 4, threshold: float = 0.76, probes: int = 8) -> DataFrame:
    """(query_id, cand_id, score): for every row the k most similar others by the vectors of their texts, through the index.

    ``embed`` gives (id, embedding) of (id, text). Equal texts are embedded and looked up once; a row meets the others of
    its class and those of the nearest classes, of each the smallest ids, which is all that the best k can hold.
    """
    held = rows.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scratch = Scratch(rows.sparkSession, "candidates")
    known = scratch.write(classes(rows, key, text, k + 1), "classes")
    vectors = scratch.write(embed(known.select(F.col("class_id").alias("id"), "text")).select("id", F.col("embedding").cast("array<float>").alias("embedding")), "vectors")
    near = indexed_top_k(vectors, vectors, k, threshold, probes=probes).select("query_id", "cand_id", "score")
    near = near.unionByName(known.select(F.col("class_id").alias("query_id"), F.col("class_id").alias("cand_id"), F.lit(1.0).alias("score")))
    found = near.join(known.select(F.col("class_id").alias("cand_id"), "members"), "cand_id").select("query_id", F.explode("members").alias("cand_id"), "score")
    # The best k + 1 of a class serve each of its rows, which leaves itself out.
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")
    best = found.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k + 1).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "cand_id", "score"))).alias("best"))
    own = held.join(known.select("text", F.col("class_id").alias("query_id")), "text").join(best, "query_id").select("id", F.filter("best", lambda b: b["cand_id"] != F.col("id")).alias("best"))
    return own.select(F.col("id").alias("query_id"), F.explode(F.slice("best", 1, k)).alias("b")).select("query_id", "b.cand_id", "b.score")
