"""Evaluation texts leaking into training text.

Method: SimHash fingerprints of all windows of ``window`` words of the items are kept in a multi-index: the 64 bits
are cut into ``radius + 1`` blocks, and two fingerprints within the radius agree in one block at least, so looking
up each block finds all of them. All windows of each document are looked up; (document, item) pairs so found are
verified exactly by weighted shingles: a shingle of three words weighs what its words weigh, a word the more the fewer
items have it. Shingles that item and document share at about the same distance make up a passage; it counts, with
the words changed in it, if they weigh enough of all shingles of its stretch of the item.

The window is the stretch that a passage of half an item leaves whole between changed words, not the whole item:
a fingerprint of the whole item lies far outside any radius when half of it is quoted.

Items are held in blocks of at most ``block_items``, each broadcast by itself, so the index has a fixed bound
whatever the number of items; documents are read and compared where they are, without a shuffle.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.functions.worker import kept

_WORD = re.compile(r"[^\W_]+")
_BITS = 64


def _bits(word: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(xxhash.xxh64_digest(word), np.uint8)).astype(np.int8) * 2 - 1


def _fingerprints(ids: np.ndarray, signs: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each window of words; ids are rows of signs."""
    rows = signs[ids]
    total = rows[: len(ids) - window + 1].astype(np.int8)
    for k in range(1, window):
        total += rows[k : len(ids) - window + 1 + k]
    return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


class LeakIndex:
    """The fingerprints of a block of items, and their words for verification."""

    def __init__(self, items: list[tuple[int, str]], window: int, radius: int, shingle: int = 3, least_similarity: float = 0.35, least_words: int = 10, most_changed: int = 5):
        self.window, self.radius = window, radius
        self.shingle, self.least_similarity, self.least_words, self.most_changed = shingle, least_similarity, least_words, most_changed
        self.items = [(key, _WORD.findall(text.lower())) for key, text in items]
        self.items = [(key, words) for key, words in self.items if words]
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in self.items for w in words))}
        signs = np.array([_bits(w) for w in vocabulary]) if vocabulary else np.zeros((0, _BITS), np.int8)
        prints, owners = [], []
        for k, (_, words) in enumerate(self.items):
            if len(words) < window:  # an item shorter than the window is one window of its own words
                words = (words * window)[:window]
            prints.append(_fingerprints(np.array([vocabulary[w] for w in words]), signs, window))
            owners.append(np.full(len(prints[-1]), k, np.int32))
        pairs = np.unique(np.rec.fromarrays([np.concatenate(prints), np.concatenate(owners)], names="f,o")) if prints else np.rec.fromarrays([np.zeros(0, np.uint64), np.zeros(0, np.int32)], names="f,o")
        self.prints, self.owners = np.ascontiguousarray(pairs["f"]), np.ascontiguousarray(pairs["o"])
        edges = np.linspace(0, _BITS, radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            shift, mask = np.uint64(lo), np.uint64((1 << int(hi - lo)) - 1)
            part = ((self.prints >> shift) & mask).astype(np.int64)
            order = np.argsort(part, kind="stable")
            starts = np.searchsorted(part[order], np.arange((1 << int(hi - lo)) + 1))
            self.blocks.append((shift, mask, order, starts))
        self.shingles: dict[int, tuple[dict[tuple, list[int]], np.ndarray]] = {}
        rarity = Counter(w for _, words in self.items for w in set(words))
        self.weights = {w: math.log(1 + len(self.items) / n) for w, n in rarity.items()}

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints lie within the radius."""
        at, who = [], []
        for shift, mask, order, starts in self.blocks:
            part = ((prints >> shift) & mask).astype(np.int64)
            lo, n = starts[part], starts[part + 1] - starts[part]
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            n = n[hit]
            k = np.repeat(hit, n)
            j = order[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            near = np.bitwise_count(prints[k] ^ self.prints[j]) <= self.radius
            at.append(k[near])
            who.append(self.owners[j[near]])
        return (np.concatenate(at), np.concatenate(who)) if at else (np.zeros(0, int), np.zeros(0, int))

    def share(self, item: int, words: list[str]) -> float:
        """The share of the item's words that the document reproduces as running text."""
        own = self.items[item][1]
        n = min(self.shingle, len(own))
        if item not in self.shingles:
            at = defaultdict(list)
            for k in range(len(own) - n + 1):
                at[tuple(own[k : k + n])].append(k)
            single = np.array([self.weights[w] for w in own])
            self.shingles[item] = dict(at), np.concatenate([[0.0], np.cumsum(np.convolve(single, np.ones(n), "valid"))])
        at, weight = self.shingles[item]
        seen = np.zeros(len(own), bool)
        for first, last, shared in _passages(at, words, n, self.most_changed):
            stretch = weight[last + 1] - weight[first]
            if last + n - first >= min(self.least_words, len(own)) and sum(weight[k + 1] - weight[k] for k in shared) >= self.least_similarity * stretch:
                seen[first : last + n] = True
        return float(seen.mean())


def _passages(at: dict[tuple, list[int]], words: list[str], n: int, most_changed: int, most_shift: int = 3) -> Iterator[tuple[int, int, set[int]]]:
    """(first, last, shared): passages of a document by the item's shingles in them, from the first to the last one's place.

    A shingle continues the passage that runs on the same diagonal (document place less item place) or the nearest
    of those up to ``most_shift`` away, words having been added or left out, if at most ``most_changed`` words lie between.
    """
    running: dict[int, list] = {}
    for d in range(len(words) - n + 1):
        for k in at.get(tuple(words[d : d + n]), ()):
            near = None
            for shift in sorted(range(-most_shift, most_shift + 1), key=abs):
                p = running.get(d - k + shift)
                if p is not None and p[1] <= k <= p[1] + n + most_changed and p[3] < d <= p[3] + n + most_changed:
                    near = p
                    break
            if near is None:
                near = [k, k, set(), d]
            elif near[4] != d - k:
                running.pop(near[4], None)
            near[1:] = [k, near[2], d, d - k]
            near[2].add(k)
            previous = running.get(d - k)
            if previous is not None and previous is not near:
                yield previous[0], previous[1], previous[2]
            running[d - k] = near
    for p in running.values():
        yield p[0], p[1], p[2]


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    radius: int = 3,
    least_share: float = 0.5,
    shingle: int = 3,
    least_similarity: float = 0.35,
    least_words: int = 10,
    block_items: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, share): documents that reproduce at least ``least_share`` of an item's words as running text.

    A passage needs ``least_words`` words (an item shorter than that all of its own) and a weighted-shingle similarity
    of ``least_similarity`` with its stretch of the item, which every fifth word changed still has; words changed
    within it count as reproduced. Weights are those of the item's block. Letter case,
    punctuation and line breaks do not matter. Null and empty texts match nothing; texts shorter than the window are
    compared as one window; a document that occurs twice gives equal rows once. Other columns are ignored.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    held = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    spark, kind = documents.sparkSession, dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id {dict(held.dtypes)['item_id']}, share double"
    types = [pa.int64() if t == "bigint" else pa.int32() if t == "int" else pa.string() for t in (kind, dict(held.dtypes)["item_id"])]
    found, block = None, []

    def search(rows: list[tuple]) -> DataFrame:
        shared, mark = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = kept(("leaks", mark), lambda: LeakIndex(shared.value, window, radius, shingle, least_similarity, least_words))
            known: dict[str, int] = {}
            signs = np.zeros((1 << 16, _BITS), np.int8)
            for batch in batches:
                for part in range(0, batch.num_rows, 256):
                    keys, texts = (c.slice(part, 256).to_pylist() for c in batch.columns)
                    words = [_WORD.findall(t.lower()) for t in texts]
                    flat = [w for own in words for w in (own if len(own) >= window else (own * window)[:window])]
                    if not flat:
                        continue
                    if len(known) > 1 << 20:
                        known = {}
                    fresh = [w for w in dict.fromkeys(flat) if w not in known]
                    if len(known) + len(fresh) > len(signs):
                        signs = np.concatenate([signs, np.zeros((max(len(signs), len(fresh)), _BITS), np.int8)])
                    for w in fresh:
                        signs[len(known)] = _bits(w)
                        known[w] = len(known)
                    ids = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
                    owner = np.repeat(np.arange(len(words)), [len(o) if len(o) >= window or not o else window for o in words])
                    step = 1 << 18  # long texts in stretches, to bound memory
                    prints = np.concatenate([_fingerprints(ids[k : k + step + window - 1], signs, window) for k in range(0, len(ids) - window + 1, step)])
                    same = owner[: len(prints)] == owner[window - 1 :]
                    at, who = index.candidates(prints[same])
                    pairs = set(zip(owner[: len(prints)][same][at].tolist(), who.tolist()))
                    out = [(keys[d], index.items[k][0], s) for d, k in sorted(pairs) if (s := index.share(k, words[d])) >= least_share]
                    if out:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (*types, pa.float64()))], names=["doc_id", "item_id", "share"])

        return docs.mapInArrow(compare, schema)

    for row in held.toLocalIterator():
        block.append(tuple(row))
        if len(block) == block_items:
            found = search(block) if found is None else found.unionByName(search(block))
            block = []
    if block or found is None:
        found = search(block) if found is None else found.unionByName(search(block))
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
