"""Visually identical text with different characters.

Method: within each run of letters the resolved script set is the intersection of the script sets of its letters
(with script extensions, and with the sets of scripts that are written together). Where it is empty the word mixes
scripts, and it is spelled in the script in which every letter has itself or a look-alike. Where it holds one other
script but every letter has a Latin look-alike, the word is a whole-script look-alike, and it is spelled in Latin
unless a neighbouring word is genuinely of that script. Latin letters that look like plain ones become these in
words that are plain otherwise. The remaining forms are normalized: full-width and compatibility letters, figures and
signs, kept-apart accents, invisible characters and spaces that are not the plain one.

Kept as they are: line breaks, composed letters, words of other scripts with the joiners they need, typographic
quotes, dashes and ellipses, superscripts, currency and mathematical signs.

Which letters look alike is Unicode's confusables data as ICU, which Spark brings along, has it; script sets are
Unicode's script extensions. Rows without any character that could change are recognised by a regular expression in
the JVM and never reach Python.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimforge.functions.worker import kept

#: Letters that are no confusables but look Latin beside Latin letters.
BESIDE_LATIN = dict(zip("ανιρυκχγτвкмнтгпЗҮԜհհԼ", "avipukxytbkmhtrnZYWhhL", strict=True))
#: Scripts that are written together, and what a set of them is called.
TOGETHER = {"Hani": ("Hanb", "Jpan", "Kore"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}
#: What no text is changed for: everything but these characters is looked at.
_HARMLESS = r"\x00-\x7F\u00A1-\u00AC\u00AE-\u0130\u2010-\u2027\u2030-\u205E\u20A0-\u20BF\u2200-\u22FF"
_FORM = re.compile("[\u2102\u210A-\u2113\u2115\u2119-\u211D\u2124\u212A-\u212D\u212F-\u2131\u2133-\u2139\u2145-\u2149\u2160-\u217F\uFB00-\uFB06\uFE50-\uFE52\uFE54-\uFE57\uFE59-\uFE66\uFE68-\uFE6B\uFF01-\uFF5E\uFFE0\uFFE1\uFFE5\uFFE6\u037E\U0001D400-\U0001D7FF]")
_INVISIBLE = regex.compile(r"(?:(?![\U000E0000-\U000E0FFF])\p{Default_Ignorable_Code_Point})|(?<![\U0001F3F4\U000E0020-\U000E007F\u2E80-\u9FFF\uF900-\uFAFF])[\U000E0000-\U000E0FFF]+")
_SPACE = re.compile("[\u00A0\u1680\u2000-\u200A\u202F\u205F\u2800\u3000]")
_APART = re.compile("[^\\W\\d_][\u0300-\u036F]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Scripts whose words may need joiners, fillers and marks of direction.
_JOINING = re.compile("[\u0590-\u0DFF\u1000-\u109F\u1100-\u11FF\u1780-\u17FF\u1800-\u18AF\u3130-\u318F\uA960-\uA97F\uAC00-\uD7FF\U0001F300-\U0001FAFF\u2600-\u27BF\uFE0F]")
_JOINERS = frozenset("\u200C\u200D\u200E\u200F\u061C\uFE0E\uFE0F\u115F\u1160\u17B4\u17B5\u180B\u180C\u180D\u180F")
_WIDE = re.compile("[\u2E80-\u2FFF\u3001-\u30FF\u3100-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF\uFF66-\uFF9F]")
_LAST_LETTER = 0x20000


class Plain:
    """One character for each look. ``prototypes`` gives letters the look they share, ``scripts`` names Unicode's scripts."""

    def __init__(self, prototypes: dict[str, str], scripts: tuple[str, ...]):
        self.prototypes, self.names = prototypes, scripts
        self.classes: dict[str, list[str]] = {}
        for c, look in prototypes.items():
            self.classes.setdefault(look, []).append(c)
        # What is known of letters; both are bounded by Unicode.
        self.found: dict[str, frozenset | None] = {}
        self.likes: dict[tuple[str, str], str | None] = {}

    def scripts(self, c: str) -> frozenset | None:
        """The script set of a letter; None stands for all scripts."""
        if c in self.found:
            return self.found[c]
        known = kept(("scripts", self.names), lambda: {n: regex.compile(rf"\p{{scx={n}}}") for n in self.names})
        own = {n for n, p in known.items() if p.match(c)}
        self.found[c] = frozenset(own.union(*(TOGETHER.get(n, ()) for n in own))) or None
        return self.found[c]

    def resolved(self, word: str) -> frozenset | None:
        """The scripts that all letters of a word can be of; None for all, empty for a word of mixed scripts."""
        out = None
        for c in word:
            own = self.scripts(c)
            if own is not None:
                out = own if out is None else out & own
        return out

    def like(self, c: str, script: str) -> str | None:
        """The letter of a script that looks like ``c``, of the same case where there is one."""
        if (c, script) not in self.likes:
            self.likes[c, script] = self._like(c, script)
        return self.likes[c, script]

    def _like(self, c: str, script: str) -> str | None:
        own = self.scripts(c)
        if own is None or script in own and (script != "Latn" or c.isascii()):
            return c
        look = self.prototypes.get(c)
        others = [o for o in self.classes.get(look, ()) if o != c and script in (self.scripts(o) or ()) and (script != "Latn" or o.isascii())]
        others.sort(key=lambda o: (o.isupper() != c.isupper(), o))
        return others[0] if others else c if script in own else None

    def spelled(self, word: str, script: str, loosely: bool = False) -> str | None:
        """The word in letters of one script, if each letter has one."""
        out = []
        for c in word:
            new = self.like(c, script)
            if new is None and loosely and script == "Latn":
                new = BESIDE_LATIN.get(c)
            if new is None:
                return None
            out.append(new)
        return "".join(out)

    def mixed(self, word: str) -> str:
        """A word of mixed scripts in the one script that it can be spelled in."""
        sets = [s for s in map(self.scripts, word) if s is not None]
        best = None
        for script in sorted(frozenset().union(*sets)):
            own = sum(script in s for s in sets)
            if script == "Latn":
                new, sure = self.spelled(word, script, True), True
            else:
                # Another script is meant where it has most letters and one of them looks like no Latin one.
                new = self.spelled(word, script)
                sure = 2 * own > len(sets) and any(script in s and self.like(c, "Latn") is None for c, s in zip(word, map(self.scripts, word)) if s)
            if new is not None and (best is None or (sure, own * (script != "Latn")) > best[:2]):
                best = (sure, own * (script != "Latn"), new)
        return best[2] if best else word

    def _genuine(self, word: str, scripts: frozenset) -> bool:
        """Whether a word is of one of the scripts, with a letter that no Latin one looks like."""
        own = self.resolved(word)
        return own is not None and bool(own & scripts) and self.spelled(word, "Latn") is None

    def spell(self, text: str) -> str:
        words = list(_WORD.finditer(text))
        out, at = [], 0
        for k, m in enumerate(words):
            word = m[0]
            if word.isascii():
                continue
            scripts, new = self.resolved(word), word
            if scripts is None:
                continue
            if not scripts:
                new = self.mixed(word)
            elif "Latn" in scripts:
                plain = self.spelled(word, "Latn")
                # A word with other letters of its own (phonetic, Turkish) keeps all of them.
                if all(c.isascii() or unicodedata.decomposition(c) for c in plain) and (plain.isascii() or "\u0131" not in word):
                    new = plain
            elif plain := self.spelled(word, "Latn"):
                near = [w[0] for w in words[max(0, k - 2) : k] + words[k + 1 : k + 3]]
                latin = any("Latn" in (self.resolved(w) or ()) for w in near)
                # A small Greek letter by itself is a symbol.
                symbol = len(word) == 1 and "Grek" in scripts and word.islower() and word != "\u03BF"
                if not symbol and not any(self._genuine(w, scripts) for w in near) and (len(word) > 1 or not near or latin):
                    new = plain
            if new != word:
                out += [text[at : m.start()], new]
                at = m.end()
        return "".join([*out, text[at:]]) if out else text

    def text(self, text: str) -> str:
        """The text with one character for each look."""
        if text.isascii():
            return text

        def form(m: re.Match) -> str:
            c, a, b = m[0], m.start(), m.end()
            if "\uFF01" <= c <= "\uFF5E" and not unicodedata.normalize("NFKC", c).isalnum() and (_WIDE.match(text[a - 1 : a]) or _WIDE.match(text[b : b + 1])):
                return c  # wide punctuation within wide text
            return unicodedata.normalize("NFKC", c)

        def invisible(m: re.Match) -> str:
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            needed = m[0] in _JOINERS and (_JOINING.match(before) or m[0] in "\u115F\u1160" and _JOINING.match(after))
            return m[0] if needed and (not after or not after.isascii() or not after.isalnum()) else ""

        def space(m: re.Match) -> str:
            wide = m[0] == "\u3000" and _WIDE.match(text[m.start() - 1 : m.start()]) and _WIDE.match(text[m.end() : m.end() + 1])
            return m[0] if wide else " "

        text = _FORM.sub(form, text)
        text = _INVISIBLE.sub(invisible, text)
        text = _SPACE.sub(space, text)
        text = _APART.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)
        return text if self.prototypes.keys().isdisjoint(text) else self.spell(text)


@functools.cache
def _unicode_tables(gateway: object) -> tuple[dict[str, str], tuple[str, ...]]:
    """Prototypes of letters, and the names of scripts, from ICU: one call for all letters, some hundred for scripts."""
    letters = [chr(k) for k in range(0x41, _LAST_LETTER) if unicodedata.category(chr(k))[0] == "L" and not (0x3400 <= k <= 0x9FFF or 0xAC00 <= k <= 0xD7A3 or 0xF900 <= k <= 0xFAFF or 0x17000 <= k <= 0x18CFF)]
    checker = gateway.com.ibm.icu.text.SpoofChecker.Builder().build()
    looks = dict(zip(letters, checker.getSkeleton("\x01".join(letters)).split("\x01"), strict=True))
    shared: dict[str, int] = {}
    for look in looks.values():
        shared[look] = shared.get(look, 0) + 1
    scripts = gateway.com.ibm.icu.lang.UScript
    names = []
    for k in range(2, int(scripts.CODE_LIMIT)):
        name = scripts.getShortName(k)
        try:
            regex.compile(rf"\p{{scx={name}}}")
        except regex.error:
            continue
        names.append(name)
    # Letters with compatibility forms and invisible letters are normalized before; accents are part of the look.
    return {c: look for c, look in looks.items() if look and shared[look] > 1}, tuple(sorted(set(names) - {"Zyyy", "Zinh", "Zzzz"}))


def look_alikes(spark: SparkSession) -> Plain:
    """The tables of the session's ICU; their size is Unicode's (some thousand letters), whatever the data."""
    return Plain(*_unicode_tables(spark.sparkContext._jvm))


def suspicious(text: Column) -> Column:
    """Whether a text holds any character for which it could change."""
    return text.rlike(f"[^{_HARMLESS}]")


def to_plain_text(texts: DataFrame, text: str, columns: list[str], changed_only: bool = False, plain: Plain | None = None) -> DataFrame:
    """(columns..., text, changed): each text in its one consistent form, and whether that differs.

    Null texts stay null and empty ones empty, unchanged. Repeated rows come out repeated. With ``changed_only`` only
    texts that change come out. Other columns are ignored. ``plain`` brings other tables than the session's.
    """
    rows = texts.select(*columns, F.col(text).alias("text"))
    size = len(columns)
    tables = plain or look_alikes(texts.sparkSession)
    made = (tables.prototypes, tables.names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("plain", made[1], hash(frozenset(made[0].items()))), lambda: Plain(*made))
        for batch in batches:
            old = batch.column(size).to_pylist()
            new = [own.text(t) for t in old]
            changed = [a != b for a, b in zip(old, new)]
            done = pa.RecordBatch.from_arrays([*batch.columns[:size], pa.array(new, pa.string()), pa.array(changed, pa.bool_())], names=[*columns, "text", "changed"])
            yield done.filter(done.column(size + 1)) if changed_only else done

    schema = rows.schema.add("changed", T.BooleanType())
    suspects = rows.where(suspicious(F.col("text"))).mapInArrow(clean, schema)
    if changed_only:
        return suspects
    return suspects.unionByName(rows.where(~F.coalesce(suspicious(F.col("text")), F.lit(False))).withColumn("changed", F.lit(False)))
