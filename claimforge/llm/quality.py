"""Per-document text quality statistics.

Method: each document gets a vector of statistics; the mean and covariance of natural prose are fitted for each
language on a bounded number of documents labelled as prose (``fit_rows``, those of least hash), robustly, by
re-estimating on the three quarters that lie nearest, since some labels are wrong. Every document then gets its
Mahalanobis distance from the prose of its language, and each statistic's contribution to it. The distance decides
what is no prose, and the statistics that contribute most decide of which kind it is. How lines look (rows of cells,
items, odd tokens, repeats, markup) enters as shares of characters, statistics like the others; by themselves they
decide nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for on with as by at from was were be are it its this which or an has have had not but we our all after over into than although while because".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis unter während wegen ohne".split(),
    "fr": "le la les de des du un une et en à au aux que qui dans pour par sur pas plus ne se ce cette il elle est sont son sa ses avec ou mais nous vous après malgré selon été être comme hors dont l d".split(),
    "es": "el la los las de del y en un una que por con para se su sus al es son lo como más pero o no ha han este esta entre sobre tras sin desde hasta según fue ser año".split(),
}
STATISTICS = ("log_words", "mean_word_length", "symbol_share", "digit_share", "closed_line_share", "common_word_share", "log_line_length", "item_share", "cell_share", "odd_token_share", "repeated_share", "markup_share")
#: Least standard deviation of each statistic, so that one that hardly varies in prose still has a scale.
_FLOORS = np.array([0.5, 0.4, 0.03, 0.03, 0.25, 0.05, 0.6, 0.1, 0.1, 0.1, 0.1, 0.1])
#: The statistics whose contributions speak for each kind.
KINDS = {"list": ("item_share",), "table": ("cell_share",), "junk": ("odd_token_share", "repeated_share", "markup_share")}

_COMMON = {k: frozenset(v) for k, v in COMMON_WORDS.items()}
_ANY_COMMON = frozenset().union(*_COMMON.values())
#: Function words that also stand within names and items.
_LINKING = frozenset(("and", "for", "of"))
_LANGUAGES = tuple(COMMON_WORDS)
_LANGUAGES_OF = {w: tuple(k for k, v in enumerate(_COMMON.values()) if w in v) for w in _ANY_COMMON}
_SPLIT_WORDS = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\W*(?:\d[\d,.]*|n\.?[am]\.?|nil|(?:FY|CY|Q[1-4]|H[12])\W*\d*)?\W*$", re.I)
_CELLS = re.compile(r"\||\t+| {2,}")
_CSV = re.compile(r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
_MARK = re.compile(r"\s*(?:[-–—*•‣◦▪·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
_LEADER = re.compile(r"(?:\.{4,}|(?:\s\.){4,})\s*\d{1,4}\s*$")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&#?\w+;")
_CLEAN = re.compile(r"[\[(\"'“‘«¿¡*•-]*(?:[^\W\d_]+(?:[-–’'&/][^\W\d_]+)*(?:['’]s?)?|[₹$€£+-]?\d+(?:[.,:/-]\d+)*(?:%|[a-zA-Z]{0,3}|er|ème)|[₹$€£%&–—|-]|\.+|[A-Z]{1,4}\d{2,4}|(?:[^\W\d_]\.)+)[\])\"'”’».,;:!?%…*-]*$")
_CLOSING = "\"'”’»)]"
_ENDS = frozenset(".!?:;…。")
_LONGEST_WORD = 40
_ODD: dict[str, int] = {}


def _learn(token: str) -> int:
    if len(_ODD) >= 200_000:
        _ODD.clear()
    n = _ODD[token] = 0 if len(token) <= _LONGEST_WORD and _CLEAN.match(token) else len(token)
    return n


def _odd_length(tokens: list[str]) -> int:
    """Characters in tokens that are no words, numbers or signs as prose has them; what was once decided is kept."""
    try:
        return sum(map(_ODD.__getitem__, tokens))
    except KeyError:
        return sum(_ODD[token] if token in _ODD else _learn(token) for token in tokens)


def row_length(line: str) -> int:
    """Characters of a line in a row of cells of which most behind the first are numbers, periods or empty; 0 if it is none.

    What stands in a cell of ten words or more is running text that the row is joined to.
    """
    cells = _CELLS.split(line.strip(" |\t")) if "|" in line or "\t" in line or "  " in line else ()
    if len(cells) > 1:
        if not any(map(str.isalnum, line)):
            return 0 if line.strip(" |:+-\t") else len(line) + 1
        if sum(bool(_NUMBER.match(c)) for c in cells[1:]) < 0.6 * (len(cells) - 1):
            return 0
    else:
        if "," not in line or ", " in line:
            return 0
        cells = _CSV.split(line) if '"' in line else line.split(",")
        if not all(map(_NUMBER.match, cells[1:])):
            return 0
    running = sum(len(c) for c in cells if c.count(" ") >= 9)
    return len(line) + 1 - running


def _items(line: str) -> int:
    """Characters of a line in items: marked lines, and short pieces without function words or a full stop."""
    if ("...." in line or " . . " in line) and (leader := _LEADER.search(line)):
        return len(line) - (line.rfind(". ", 0, leader.start()) + 1)
    if mark := _MARK.match(line):
        # A mark before running text (a dash before a speaker's words, a numbered paragraph) makes no item of it.
        words = _SPLIT_WORDS.findall(line.lower(), mark.end() - 1)
        if sum(w in _ANY_COMMON and w not in _LINKING for w in words) < 0.12 * len(words):
            return len(line) + 1
    n = 0
    for piece in line.replace("; ", ", ").replace(" • ", ", ").split(", "):
        if not 0 < len(piece.split()) <= 8 or piece.endswith((".", "!", "?")):
            continue
        words = _SPLIT_WORDS.findall(piece.lower())
        if words and not any(w in _ANY_COMMON and w not in _LINKING for w in words):
            n += len(piece) + 2
    return min(n, len(line) + 1)


def text_statistics(text: str) -> tuple[str, int, list[float]]:
    """(language, words, statistics) of a text; an empty text has zeros."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    lower = _SPLIT_WORDS.findall(text.lower())
    counts = dict.fromkeys(range(len(_LANGUAGES)), 0)
    for word, times in Counter(filter(_ANY_COMMON.__contains__, lower)).items():
        for k in _LANGUAGES_OF[word]:
            counts[k] += times
    language = max(counts, key=counts.get)
    n, words, letters = max(1, len(text)), len(lower), sum(map(len, lower))
    digits, written = sum(map(text.count, "0123456789")), sum(map(len, text.split()))
    closed = items = cells = odd = 0
    pieces: Counter = Counter()
    for line in lines:
        closed += line.rstrip().rstrip(_CLOSING)[-1:] in _ENDS
        if own := row_length(line):
            cells += own
            continue
        unclean = _odd_length(line.split())
        odd += unclean
        if unclean <= 0.3 * len(line):
            items += _items(line)
        pieces.update(p for p in line.strip().split(". ") if len(p) > 15)
    repeated = sum(len(p) * (k - 1) for p, k in pieces.items() if k > 1)
    markup = sum(map(len, _TAG.findall(text))) if "<" in text or "&" in text else 0
    return _LANGUAGES[language], words, [
        float(np.log1p(words)),
        min(20.0, letters / words) if words else 0.0,
        max(0, written - letters - digits) / n,
        digits / n,
        closed / len(lines) if lines else 0.0,
        counts[language] / words if words else 0.0,
        float(np.log1p(len(text) / max(1, len(lines)))),
        *(min(1.0, share / n) for share in (items, cells, odd, repeated, markup)),
    ]


_DDL = "doc_id {}, language string, words int, statistics array<double>"


def document_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, words, statistics): the STATISTICS of each document, in their order; null is an empty text."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.record_batch([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.float64()))], names=["doc_id", "language", "words", "statistics"])

    return docs.mapInArrow(measure, _DDL.format(docs.schema["doc_id"].dataType.simpleString()))


def _robust(x: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    mean, scale = np.median(x, axis=0), np.maximum(_FLOORS, 1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0))
    inverse = np.diag(1 / scale**2)
    keep = max(2, int(0.75 * len(x)))
    for _ in range(steps):
        z = x - mean
        near = x[np.argsort(np.einsum("ij,jk,ik->i", z, inverse, z), kind="stable")[:keep]]
        mean = near.mean(axis=0)
        inverse = np.linalg.inv(np.cov(near, rowvar=False) + np.diag(_FLOORS**2))
    return mean, inverse


def fit_prose(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, fit_rows: int = 2000, least_rows: int = 20) -> dict[str, tuple]:
    """Mean and inverse covariance of labelled prose for each language, and of all of it under ''.

    The ``fit_rows`` labelled ids of least hash are taken first, so that only their texts are measured.
    """
    prose = labels.where("label = 'prose' and doc_id is not null").select(F.col("doc_id").alias(doc_id)).distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(fit_rows)
    texts = documents.select(doc_id, text).join(F.broadcast(prose), doc_id, "left_semi")
    rows = document_statistics(texts, doc_id, text).limit(fit_rows).select("language", "statistics").collect()
    by: dict[str, list] = {"": [r.statistics for r in rows]}
    for r in rows:
        by.setdefault(r.language, []).append(r.statistics)
    return {k: _robust(np.array(v)) for k, v in by.items() if len(v) >= (least_rows if k else 2)}


def score_quality(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = 2000, cut: float = 40.0) -> DataFrame:
    """(doc_id, language, words, <statistics>, distance, outlier, contributions, kind) for each document.

    ``contributions`` maps each statistic to its part of the squared distance; they sum up to it. ``outlier`` is true
    for squared distances over ``cut``; ``kind`` of an outlier is the one whose statistics contribute most, 'prose' if
    none of them contributes and for all others. The cut lies well beyond what a short list or table in prose gives:
    with the least deviations above, half the characters in items or cells alone give 25, and what goes with them
    (function words missing, short lines left open) as much again. Empty and null texts have zeros for statistics. A
    language with few labelled documents takes the figures of all; without any label at all there is nothing to
    measure from: distances are null, no row is an outlier and all are 'prose'. Repeated rows come out repeated.
    """
    every = document_statistics(documents, doc_id, text)
    model = fit_prose(documents, labels, doc_id, text, fit_rows)
    size = len(STATISTICS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column(1).to_pylist(), object)
            x = np.array(batch.column(3).to_pylist(), float).reshape(-1, size)
            parts = np.full(x.shape, np.nan)
            for language in set(languages.tolist()):
                rows = languages == language
                fitted = model.get(language) or model.get("")
                if fitted:
                    z = x[rows] - fitted[0]
                    parts[rows] = z * (z @ fitted[1])
            squared = parts.sum(axis=1)
            known = ~np.isnan(squared)
            yield pa.record_batch([*batch.columns, pa.array(np.sqrt(np.maximum(squared, 0)), mask=~known), pa.array(parts.tolist(), pa.list_(pa.float64())), pa.array(known & (squared > cut))], names=["doc_id", "language", "words", "statistics", "distance", "parts", "outlier"])

    key = every.schema["doc_id"].dataType.simpleString()
    judged = every.mapInArrow(judge, _DDL.format(key) + ", distance double, parts array<double>, outlier boolean")
    votes = F.array(*(F.struct(sum((F.element_at("parts", STATISTICS.index(s) + 1) for s in own), F.lit(0.0)).alias("part"), F.lit(name).alias("kind")) for name, own in KINDS.items()))
    most = F.array_max(votes)
    kind = F.when(F.col("outlier") & (most["part"] > 0), most["kind"]).otherwise("prose")
    return judged.select("doc_id", "language", "words", *(F.element_at("statistics", k + 1).alias(s) for k, s in enumerate(STATISTICS)), "distance", "outlier", F.map_from_arrays(F.array(*map(F.lit, STATISTICS)), "parts").alias("contributions"), kind.alias("kind"))
