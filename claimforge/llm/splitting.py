"""Splitting oversized texts at natural boundaries.

Method: recursive bisection. A text over the limit is cut at the strongest boundary near its midpoint, halves that
still exceed the limit less the overlap are cut again, and then each piece but the first is extended to the left
by the overlap. Rows under the limit never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words before whose full stop no sentence ends.
_ABBREVIATIONS = frozenset("rs ltd pvt inc corp co cr mr mrs ms dr no nos vs approx fig st sr jr fy etc eg ie cal fin qtr".split())
#: Boundaries from the strongest to the weakest; a cut lies behind the match.
_BOUNDARIES = [re.compile(p) for p in (r"\n[^\S\n]*\n\s*", r"\r?\n[^\S\n]*", r"(?<=[.!?。।…])[\"'”’)\]]*\s+", r"(?<=[;:])\s+", r"(?<=,)\s+", r"\s+")]
_ROWS, _SENTENCE = 1, 2
_JOINERS = "\u200C\u200D\uFE0E\uFE0F"


def _places(text: str) -> list[list[int]]:
    found = []
    for k, pattern in enumerate(_BOUNDARIES):
        at = []
        for m in pattern.finditer(text):
            if k == _SENTENCE:
                before = re.search(r"(\w+)\.$", text[max(0, m.start() - 12) : m.start()])
                if before and (before[1].lower() in _ABBREVIATIONS or len(before[1]) == 1 and before[1].isalpha()):
                    continue
            at.append(m.end())
        found.append(at)
    return found


def _inside(text: str, at: int) -> bool:
    """Whether a cut here would part a character from its marks or joiners."""
    return 0 < at < len(text) and (unicodedata.category(text[at])[0] == "M" or text[at] in _JOINERS or text[at - 1] == "\u200D" or text[at - 1 : at + 1] == "\r\n")


def _nearest(at: list[int], lo: int, hi: int, mid: int) -> int | None:
    """The place in (lo, hi) that is nearest to mid."""
    k = bisect_left(at, mid)
    near = [p for p in at[max(0, k - 1) : k + 1] if lo < p < hi]
    return min(near, key=lambda p: (abs(p - mid), p)) if near else None


def split_text(text: str, limit: int, overlap: int, rows: bool = False) -> list[tuple[int, int]]:
    """Offsets of the pieces of a text: at most ``limit`` characters, consecutive ones sharing ``overlap``."""
    if len(text) <= limit:
        return [(0, len(text))]
    room, places, cuts, todo = limit - overlap, _places(text), [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= room:
            cuts.append(hi)
            continue
        mid, slack = (lo + hi) // 2, max(1, (hi - lo) // 4)
        at = _nearest(places[_ROWS], lo, hi, mid) if rows else None
        for kind in places:
            if at is not None:
                break
            at = _nearest(kind, mid - slack, mid + slack, mid)
        if at is None:
            at = mid
            while at > lo + 1 and _inside(text, at):
                at -= 1
        todo += [(at, hi), (lo, at)]
    pieces, start = [], 0
    for end in cuts:
        head = max(pieces[-1][0], start - overlap) if pieces else 0
        while head < start and _inside(text, head):
            head += 1
        pieces.append((head, end))
        start = end
    return pieces


def split_oversized(chunks: DataFrame, id_col: str, text_col: str, table_col: str | None = None, limit: int = 2400, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """(id, piece_no, char_start, char_end[, piece_text]) for texts of more than ``limit`` code points.

    Pieces cover the whole text, hold at most ``limit`` characters and repeat the last ``overlap`` characters of
    the piece before, less where that would part a character from its marks. Cuts lie behind blank lines, line
    ends, sentences, clauses or words, in this order, within the middle half of what is cut; texts for which
    ``table_col`` is true are cut between rows wherever they have any. Null and empty texts and texts up to the
    limit give no rows; a repeated id counts once; rows without an id are left out.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, rows in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(key, k, a, b, text[a:b] if with_text else None) for k, (a, b) in enumerate(split_text(text, limit, overlap, bool(rows)))]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["id", "piece_no", "char_start", "char_end", "piece_text"])

    large = chunks.where((F.length(text_col) > limit) & F.col(id_col).isNotNull())
    large = large.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), (F.col(table_col) if table_col else F.lit(False)).alias("rows"))
    done = large.mapInArrow(pieces, "id string, piece_no int, char_start int, char_end int, piece_text string").dropDuplicates(["id", "piece_no"])
    return done if with_text else done.drop("piece_text")
