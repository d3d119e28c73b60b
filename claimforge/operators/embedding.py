"""Vectors of statements: an offline embedder by feature hashing, and a place for another."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.operators.similarity import pack, scaled


def embed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(key, embedding) by a model that takes a batch of texts and gives a matrix; null is an empty text."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = model(batch.column(1).to_pylist()) if batch.num_rows else np.zeros((0, 1))
            yield pa.record_batch([batch.column(0), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], names=[key, "embedding"])

    return rows.select(key, F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def embed_packed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(id, v): as ``embed``, vectors of unit length as packed bytes."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pack(scaled(model(batch.column(1).to_pylist())))], names=["id", "v"])

    return rows.select(key, F.coalesce(text, F.lit("")).alias("t")).mapInArrow(run, f"id {kind}, v binary")


def hashing_model(size: int = 256) -> Callable[[list[str]], np.ndarray]:
    """Feature hashing: words by hash with a sign, so that collisions cancel out on average, vectors of unit length."""

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % size] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return model


def payloads(facts: DataFrame) -> DataFrame:
    """What is kept beside a fact's vector; null texts are empty."""
    return facts.select(F.col("id").alias("fact_id"), "document_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("entity", "attribute", "canonical_statement")))
