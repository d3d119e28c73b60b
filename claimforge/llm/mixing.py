"""Mixing sources to target weights.

Method: tokens are counted with a public tokenizer; for each mix, capped water-filling gives each source its share of
the budget, clamps sources at their maximum of repetitions and hands what they cannot give to the others in
proportion to their weights, until nothing changes. A source that owes 2.3 times its size has all its documents
twice and those of least seeded hash, up to 0.3 of its size, once more.

The hash up to which documents are taken is found from token sums of hash buckets and then within one bucket, so
no window runs over a whole source. Texts are read once more at the end and never shuffled: whether a document is
taken, and how often, follows from its source and its hash alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimforge.functions.worker import kept
from claimforge.session import Scratch


def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, columns: list[str], tokenizer: str, text: str = "text") -> DataFrame:
    """The columns and ``tokens``: the number of tokens of each text; null and empty texts have none."""
    kept_columns = documents.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = kept(("tokenizer", tokenizer), lambda: _encoding(tokenizer))
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*columns, "tokens"])

    schema = documents.select(*columns).schema
    return kept_columns.mapInArrow(count, schema.add("tokens", T.LongType()))


def fill(targets: dict[str, float], capacity: dict[str, float], budget: float) -> dict[str, float]:
    """Capped water-filling: what each source gives, in tokens."""
    given, free = {}, {s: w for s, w in targets.items() if w > 0}
    while free:
        left, weight = budget - sum(given.values()), sum(free.values())
        full = [s for s, w in free.items() if left * w / weight >= capacity.get(s, 0)]
        if not full:
            return given | {s: left * w / weight for s, w in free.items()}
        for s in full:
            given[s] = capacity.get(s, 0)
            del free[s]
    return given


def plan_mixes(documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int = 17, buckets: int = 4096, most_targets: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """One row per mix and named source: what it owes and which documents give it; and the counted documents.

    (mix_id, source, target_share, source_tokens, owed_tokens, whole, cut_hash, cut_id): each document of the source is
    taken ``whole`` times, and once more if (hash, doc_id) does not exceed (cut_hash, cut_id). The table has as many
    rows as ``targets``, of which more than ``most_targets`` are refused. Rows of documents without id or source are in no mix, yet count for the budget; each row of a
    repeated document counts. A source named twice in a mix has the sum of its shares and the smaller cap; null or
    non-positive shares count as 0; sources that are absent or empty give nothing.
    """
    spark = documents.sparkSession
    counted = count_tokens(documents.select("doc_id", "source", "text"), ["doc_id", "source"], tokenizer)
    sizes = Scratch(spark, "mixing").write(counted.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")), "tokens")
    named = sizes.where("source is not null and doc_id is not null and tokens > 0").withColumn("bucket", F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * buckets).cast("int"))
    held = named.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    per_source = {r.source: r.tokens for r in held.join(targets.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    mixes: dict[int, dict[str, tuple]] = {}
    wanted = targets.where("mix_id is not null and source is not null").limit(most_targets + 1).collect()
    if len(wanted) > most_targets:
        raise ValueError(f"more than {most_targets} targets")
    for r in wanted:
        old = mixes.setdefault(r.mix_id, {}).get(r.source, (0.0, r.max_repeats or 0, 0.0))
        mixes[r.mix_id][r.source] = (old[0] + max(0.0, r.target_share or 0.0), min(old[1], r.max_repeats or 0), max(old[2], r.budget_ratio or 0.0))
    rows = []
    for mix, by in sorted(mixes.items()):
        owed = fill({s: w for s, (w, _, _) in by.items()}, {s: per_source.get(s, 0) * cap for s, (_, cap, _) in by.items()}, total * max(b for _, _, b in by.values()))
        for source, (share, cap, _) in sorted(by.items()):
            size, due = per_source.get(source, 0), owed.get(source, 0.0)
            whole = min(cap, int(due / size + 1e-12)) if size else 0
            rows.append((mix, source, share, size, float(due), whole, max(0.0, due - whole * size)))
    owes = spark.createDataFrame(rows, "mix_id int, source string, target_share double, source_tokens bigint, owed_tokens double, whole int, rest double")
    before = Window.partitionBy("mix_id", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    split = held.join(F.broadcast(owes.where("rest >= 1")), "source").withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).where("before < rest and before + tokens >= rest").select("mix_id", "source", "bucket", "before", "rest")
    inner = Window.partitionBy("mix_id", "source").orderBy("h", "doc_id")
    last = named.join(F.broadcast(split), ["source", "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    # The document that crosses the line is taken where that comes nearer to what is owed.
    cut = last.where("upto - tokens < rest and 2 * upto - tokens <= 2 * rest or upto <= rest").groupBy("mix_id", "source").agg(F.max(F.struct("h", "doc_id")).alias("cut"))
    # With nothing taken from the bucket, the cut lies before its first document.
    cut = F.broadcast(split).join(cut, ["mix_id", "source"], "left").withColumn("floor", (F.col("bucket") / F.lit(float(buckets)) * 2.0**64 - 2.0**63).cast("bigint") - 1)
    cut = cut.select("mix_id", "source", F.coalesce("cut.h", "floor").alias("cut_hash"), F.col("cut.doc_id").alias("cut_id"))
    return owes.join(cut, ["mix_id", "source"], "left").drop("rest"), sizes


def _taken(documents: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    hashed = documents.where("source is not null and doc_id is not null").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    more = (F.col("_h") < F.col("cut_hash")) | ((F.col("_h") == F.col("cut_hash")) & (F.col("doc_id") <= F.col("cut_id")))
    return hashed.join(F.broadcast(plan), "source").withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0)).where("copies > 0")


def mix_documents(documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int = 17, as_rows: bool = False) -> DataFrame:
    """(mix_id, doc_id, source, copies, text): the documents of each mix, with how often each is used.

    With ``as_rows`` a document comes out once for each use, ``copies`` being 1.
    """
    plan, _ = plan_mixes(documents, targets, tokenizer, seed)
    taken = _taken(documents, plan.select("mix_id", "source", "whole", "cut_hash", "cut_id"), seed).select("mix_id", "doc_id", "source", "copies", "text")
    return taken.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))) if as_rows else taken


def mix_shares(documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int = 17) -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, documents, epochs): what each source of a mix came to."""
    plan, sizes = plan_mixes(documents, targets, tokenizer, seed)
    plan = Scratch(documents.sparkSession, "mixing").write(plan, "plan")
    got = _taken(sizes, plan.select("mix_id", "source", "whole", "cut_hash", "cut_id"), seed).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    every = plan.join(got, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return every.select("mix_id", "source", "target_share", (F.col("tokens") / F.greatest(whole, F.lit(1))).alias("actual_share"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), (F.col("tokens") / F.greatest("source_tokens", F.lit(1))).alias("epochs"))
