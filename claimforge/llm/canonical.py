"""Mapping free-entered values to a canonical list.

Method: every entry of the list has aliases, made by rule from what it means (the dates of a period) or how it is
spelled (initials, words run together, negation); more may be given. An Aho-Corasick automaton over all names and
aliases finds the mentions in a value; the longest ones that do not overlap win, and they decide if they name one
entry and leave nothing but filler words. In what remains, words that no alias knows stand for the known words that
they may be (a slip, an abbreviation that keeps the order of the letters, words run together or torn apart); mentions
are looked for along all these readings at once, and at last the sets of words are compared, with equal numbers required.

The list is small by its nature (its size is checked) and is shipped to every task; values are mapped where they are
read and equal values once per task, so hot values cost nothing and nothing is shuffled but the results.
"""

from __future__ import annotations

import datetime
import itertools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimforge.functions.worker import kept

#: Words that add nothing to a value.
FILLERS = frozenset("a an the of on in at as by for from to is basis figures figure figs fig nos no numbers number only entity growth level estimate estimates value values items terms results result data period results group wise".split())
_MONTHS = "january february march april may june july august september october november december".split()
_ORDINALS = {1: ("first", "1 st", "i"), 2: ("second", "2 nd", "ii"), 3: ("third", "3 rd", "iii"), 4: ("fourth", "4 th", "iv")}
_NUMBER_WORDS = {3: "three", 6: "six", 9: "nine", 12: "twelve"}
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_ZERO = re.compile(r"(?<=\d)o(?=\d|\b)")
_APOSTROPHE = re.compile(r"(?<=[^\W\d_])['\u2019](?=[^\W\d_])")


def tokens(value: str) -> list[str]:
    """Runs of letters and runs of digits, in lower case; a letter o within a number is a zero, an apostrophe joins."""
    return _TOKEN.findall(_ZERO.sub("0", _APOSTROPHE.sub("", value.lower())))


def _month(d: datetime.date) -> list[str]:
    name = _MONTHS[d.month - 1]
    return list(dict.fromkeys([name, name[:3], *(["sept"] if d.month == 9 else [])]))


def _dates(d: datetime.date) -> list[str]:
    """Ways to write a day."""
    th = "st" if d.day in (1, 21, 31) else "nd" if d.day in (2, 22) else "rd" if d.day in (3, 23) else "th"
    y, yy, days = d.year, f"{d.year % 100:02}", (f"{d.day}", f"{d.day} {th}")
    named = [f"{a} {m} {x}" for m in _month(d) for a in days for x in (y, yy)] + [f"{m} {a} {y}" for m in _month(d) for a in days]
    numeric = [f"{d.day:02} {d.month:02} {y}", f"{d.day:02} {d.month:02} {yy}", f"{y} {d.month:02} {d.day:02}", f"{d.day} {d.month} {y}", f"{d.month:02} {d.day:02} {y}"]
    return [*named, *numeric]


def _fiscal(year: int) -> list[str]:
    """Ways to write the fiscal year that ends in ``year``."""
    yy, p, pp = f"{year % 100:02}", year - 1, f"{(year - 1) % 100:02}"
    spans = [f"{p} {yy}", f"{p} {year}"]
    heads = ["fy", "f y", "fiscal", "fiscal year", "fin year", "fin yr", "financial year", "finl year"]
    return [f"{h} {x}" for h in heads for x in (yy, str(year), *spans, f"{pp} {yy}")] + spans


def period_aliases(start: datetime.date, end: datetime.date) -> list[str]:
    """Aliases of the period from start to end, by rule; fiscal years run from April to March."""
    months = (end.year - start.year) * 12 + end.month - start.month + 1
    if start == end:
        days = _dates(end)
        ends = [f"{a} {m} {y}" for a in ("end", "end of", "month end") for m in _month(end) for y in (end.year, f"{end.year % 100:02}")] + [f"{m} end {end.year}" for m in _month(end)]
        return [f"{a}{d}" for a in ("", "as of ", "as at ", "as on ", "at ", "on ") for d in (*days, *ends)]
    fiscal = _fiscal(end.year + (end.month > 3))
    out = []
    until = [d for d in _dates(end) if d.endswith(str(end.year))] + [f"{m} {end.year}" for m in _month(end)]
    for word in (_NUMBER_WORDS.get(months, str(months)), str(months)):
        out += [f"{word} {m} {a} {d}" for m in ("months", "month", "mths", "mth", "m") for a in ("to", "ended", "ending", "till") for d in until]
    for a, b in itertools.product(_month(start), _month(end)):
        out += [f"{a} {j}{b} {end.year}" for j in ("", "to ")] if start.year == end.year else []
        out += [f"{a} {start.year} {j}{b} {end.year}" for j in ("", "to ")]
    heads: list[str] = []
    if months == 3:
        n = (start.month - 4) % 12 // 3 + 1
        heads = [f"q {n}", f"{n} q", f"qtr {n}", f"quarter {n}", *(f"{o} {q}{of}" for o in _ORDINALS[n] for q in ("quarter", "qtr") for of in ("", " of", " of the"))]
        out += [f"{q} {a} {d}" for q in ("quarter", "qtr") for a in ("ended", "ending", "to") for d in until]
    elif months == 6:
        n = 1 if start.month == 4 else 2
        heads = [f"h {n}", f"{n} h", f"half {n}", f"hy {n}", *(f"{o} {h}{of}" for o in _ORDINALS[n] for h in ("half", "half year") for of in ("", " of", " of the"))]
        out += [f"{h} {a} {d}" for h in ("half year", "half", "hy") for a in ("ended", "ending", "to") for d in until]
    elif months == 9:
        heads = [f"{n} {m}{of}" for n in ("9", "nine") for m in ("m", "months", "mths", "month") for of in ("", " of", " of the")]
    elif start.month == 4:
        out += [*fiscal, *(f"{h}{a} {d}" for h in ("year ", "fiscal year ", "financial year ", "fy ", "full year ") for a in ("ended", "ending", "to") for d in until), *(f"full year {f}" for f in fiscal)]
    elif months == 12:
        yy = f"{end.year % 100:02}"
        out += [f"{h} {y}" for h in ("cy", "c y", "calendar", "calendar year", "cal year", "cal yr", "cal") for y in (str(end.year), yy)]
        out += [f"{h}{a} {d}" for h in ("year ", "calendar year ") for a in ("ended", "ending", "to") for d in until]
    return [*out, *(f"{h} {f}" for h in heads for f in fiscal), *(f"{f} {h}" for h in heads for f in fiscal if not h.endswith(" of") and not h.endswith("the"))]


def spelled_aliases(term: str) -> list[str]:
    """Aliases of a name by its spelling: initials of several words, all words in one, and 'not x' for 'unx'."""
    own = tokens(term)
    out = ["".join(own)]
    if len(own) > 1:
        out += ["".join(w[0] for w in own), " ".join(w[0] for w in own)]
    elif own and own[0].startswith("un") and len(own[0]) > 5:
        out += [f"{no} {own[0][2:]}" for no in ("not", "non", "un")]
    return out


def default_aliases(field: str, term: str, start: datetime.date | None, end: datetime.date | None) -> list[str]:
    """Aliases of a row of the reference list."""
    own = " ".join(tokens(term))
    return [own, *(period_aliases(start, end) if start and end else spelled_aliases(term))]


def _distance(a: str, b: str, limit: int) -> int:
    """Edit distance with neighbouring letters exchanged as one edit, or limit + 1."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            new.append(cost)
        if min(new) > limit:
            return limit + 1
        older, old = old, new
    return old[-1]


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def abbreviates(short: str, word: str) -> bool:
    """Whether a word is short for another: it begins alike and keeps the order of letters, one slip from five letters on.

    Two letters must be the first two; a word with an ending of up to three letters more stands for the word as well.
    """
    if short[0] != word[0] or short == word:
        return False
    if len(short) >= len(word):
        return len(word) >= 5 and len(short) <= len(word) + 3 and _common(short, word) >= len(word) - 1
    return word.startswith(short) if len(short) == 2 else len(short) > 2 and _common(short, word) >= len(short) - (len(short) >= 5)


class Matcher:
    """The entries of one field."""

    def __init__(self, entries: list[tuple[int, list[str]]], least: float):
        self.least, self.automaton, self.ids = least, ahocorasick.Automaton(), {}
        owners: dict[str, set[int]] = {}
        for key, aliases in entries:
            for alias in aliases:
                owners.setdefault(alias, set()).add(key)
        # An alias of two entries names neither.
        self.ids = {alias: next(iter(keys)) for alias, keys in owners.items() if len(keys) == 1}
        for alias, key in self.ids.items():
            self.automaton.add_word(f" {alias} ", (len(alias), key))
        if self.ids:
            self.automaton.make_automaton()
        self.words = {t for alias in self.ids for t in alias.split() if not t.isdigit()}
        self.known = self.words | FILLERS
        self.by_length: dict[int, list[str]] = {}
        for word in sorted(self.known):
            self.by_length.setdefault(len(word), []).append(word)
        self.by_letter: dict[str, list[str]] = {}
        # Words run together are not abbreviated.
        for word in sorted(self.words - {alias.replace(" ", "") for alias in self.ids if " " in alias}):
            self.by_letter.setdefault(word[0], []).append(word)
        self.trie: dict = {}
        for alias, key in self.ids.items():
            node = self.trie
            for word in alias.split():
                node = node.setdefault(word, {})
            node[""] = key
        self.near: dict[str, list[str]] = {}

    def _plain(self, words: list[str]) -> int:
        """The entry that the longest mentions name, if it is one and leaves only fillers."""
        text = f" {' '.join(words)} "
        spans = sorted((-n, end - n - 1, key) for end, (n, key) in self.automaton.iter(text)) if self.ids else []
        taken, keys = bytearray(len(text)), set()
        for n, start, key in spans:
            # Longer ones are placed already, so one that overlaps them has an end within.
            if not taken[start + 1] and not taken[start - n]:
                taken[start + 1 : start - n + 1] = b"\1" * -n
                keys.add(key)
        if len(keys) != 1:
            return 0
        at = 1
        for word in words:
            if not taken[at] and word not in FILLERS:
                return 0
            at += len(word) + 1
        return keys.pop()

    def _readings(self, word: str) -> list[str]:
        """What a word may be: itself if it is known, else known words and pairs of known words run together."""
        if word in self.known or word.isdigit() or len(word) < 2:
            return [word]
        if word not in self.near:
            if len(self.near) > 100_000:
                self.near.clear()
            parted = [f"{word[:k]} {word[k:]}" for k in range(1, len(word)) if word[:k] in self.known and word[k:] in self.known]
            letters = set(word)
            limit = 1 if len(word) < 8 else 2
            found = [(d / max(len(word), len(k)), k) for n in range(len(word) - limit, len(word) + limit + 1) for k in self.by_length.get(n, ()) if len(letters.symmetric_difference(k)) <= 2 * limit and (d := _distance(word, k, limit)) <= limit and max(len(word), len(k)) > 2 * d]
            best = min((d for d, _ in found), default=0)
            short = [k for k in self.by_letter.get(word[0], ()) if abbreviates(word, k)]
            self.near[word] = list(dict.fromkeys([*(k for d, k in sorted(found) if d <= best + 1e-9), *short, *parted])) or [word]
        return self.near[word]

    def match(self, value: str) -> int:
        """The entry that the value means, or 0."""
        words = tokens(value)
        if not words or not self.ids:
            return 0
        if found := self._plain(words):
            return found
        readings = list(map(self._readings, words))
        return self._read(words, readings) or self._similar(readings) or self._joined("".join(words))

    def _read(self, words: list[str], readings: list[list[str]]) -> int:
        """As ``_plain``, along all readings of the words at once."""
        n, spans = len(words), []
        # Steps from each place: a known word and the place behind it; places within a word lie between numbers.
        steps: dict[float, list[tuple[str, float]]] = {k: [] for k in range(n + 1)}
        for k, own in enumerate(readings):
            for j, reading in enumerate(own):
                first, _, second = reading.partition(" ")
                if second:
                    steps[k].append((first, k + (j + 1) / (len(own) + 2)))
                    steps[k + (j + 1) / (len(own) + 2)] = [(second, k + 1)]
                else:
                    steps[k].append((first, k + 1))
            if k + 1 < n and words[k] + words[k + 1] in self.words:
                steps[k].append((words[k] + words[k + 1], k + 2))
        for k in range(n):
            open_ = [(k, self.trie, 0)]
            while open_:
                place, node, size = open_.pop()
                if "" in node and place == int(place):
                    spans.append((k - int(place), -size, k, node[""]))
                open_ += [(to, node[word], size + len(word)) for word, to in steps[place] if word in node]
        taken, keys = bytearray(n), set()
        for length, size, k, key in sorted(spans):
            end = k - length
            same = {other for a, b, c, other in spans if (a, c) == (length, k)} if not taken[k] else set()
            if not taken[k] and not taken[end - 1]:
                taken[k:end] = b"\1" * (end - k)
                keys |= same
        return keys.pop() if len(keys) == 1 and all(taken[k] or not FILLERS.isdisjoint(own) for k, own in enumerate(readings)) else 0

    def _joined(self, text: str) -> int:
        """Spaces typed in the wrong place: an alias without numbers at one edit, spaces aside."""
        if len(text) < 6 or any(map(str.isdigit, text)):
            return 0
        if not hasattr(self, "closed"):
            self.closed = {alias.replace(" ", ""): key for alias, key in self.ids.items() if not any(map(str.isdigit, alias))}
        found = {key for alias, key in self.closed.items() if abs(len(alias) - len(text)) <= 1 and len(set(text).symmetric_difference(alias)) <= 2 and _distance(text, alias, 1) <= 1}
        return found.pop() if len(found) == 1 else 0

    def _similar(self, readings: list[list[str]]) -> int:
        """The entry with the alias whose set of words is most similar: words shared in some reading, of all words."""
        asked = [frozenset(w for r in own for w in r.split()) for own in readings]
        asked = list(dict.fromkeys(own for own in asked if not own <= FILLERS))
        numbers = {w for own in asked for w in own if w.isdigit()}
        asked = [own for own in asked if not any(map(str.isdigit, own))]
        best: dict[int, float] = {}
        for alias, key in dict.fromkeys(e for own in asked for w in own for e in self._holding(w)):
            if {w for w in alias if w.isdigit()} == numbers:
                named = [w for w in alias if not w.isdigit()]
                shared = min(sum(not own.isdisjoint(named) for own in asked), len(named))
                score = (shared + len(numbers)) / (len(asked) + len(named) - shared + len(numbers))
                if score >= self.least:
                    best[key] = max(best.get(key, 0), score)
        top = [k for k, v in best.items() if v == max(best.values())]
        return top[0] if len(top) == 1 else 0

    def _holding(self, word: str) -> list[tuple[frozenset, int]]:
        if not hasattr(self, "inverted"):
            self.inverted: dict[str, list] = {}
            for alias, key in self.ids.items():
                own = frozenset(w for w in alias.split() if w not in FILLERS)
                for w in own:
                    if not w.isdigit():
                        self.inverted.setdefault(w, []).append((own, key))
        return self.inverted.get(word, [])


def map_to_canonical(
    values: DataFrame,
    terms: DataFrame,
    keys: list[str],
    aliases: Callable[[str, str, datetime.date | None, datetime.date | None], list[str]] = default_aliases,
    least: float = 0.65,
    most_terms: int = 10_000,
) -> DataFrame:
    """(keys..., field, value, term_id) for each row of ``values`` (keys..., field, value) with a value that is not blank.

    ``terms`` has (term_id, field, term, start_date, end_date). term_id is 0 where no entry fits, also where two fit
    equally, where the value names two entries, and for fields without entries. A value that is a term character for
    character comes out as that term. Null and blank values give no row; repeated rows come out repeated; other
    columns are ignored.
    """
    rows = [tuple(r) for r in terms.where("term_id is not null and term is not null").select("field", "term_id", "term", "start_date", "end_date").limit(most_terms + 1).collect()]
    if len(rows) > most_terms:
        raise ValueError(f"the canonical list has more than {most_terms} entries")
    exact = {(f, t): k for f, k, t, _, _ in rows}
    names = [*keys, "field", "value"]
    asked = values.select(*names).where(F.col("value").rlike(r"(?U)\S"))

    def make() -> dict[str, Matcher]:
        by: dict[str, list] = {}
        for field, key, term, start, end in rows:
            by.setdefault(field, []).append((key, aliases(field, term, start, end)))
        return {field: Matcher(entries, least) for field, entries in by.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = kept(("matchers", hash(tuple(rows)), least), make)
        known: dict[tuple, int] = kept(("mapped", hash(tuple(rows)), least), lambda: dict(exact))
        for batch in batches:
            pairs = list(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()))
            for pair in dict.fromkeys(pairs):
                if pair not in known:
                    known[pair] = matchers[pair[0]].match(pair[1]) if pair[0] in matchers else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([known[p] for p in pairs], pa.int64())], names=[*names, "term_id"])
            if len(known) > 500_000:
                known.clear()
                known.update(exact)

    return asked.mapInArrow(find, T.StructType([*asked.schema.fields, T.StructField("term_id", T.LongType())]))
