"""Quantities recorded in different units.

Method: a grammar reads a number and a unit expression. A unit expression is a product of scales and atoms; each
atom has a factor, an offset and a vector of exponents over the base dimensions, and the vectors add up, so that a
megawatt-hour or a square foot needs no entry of its own. A quantity is converted by factor and offset to the base
unit of the dimension with the same vector.

Pairs of equal quantities are found by equality of a logarithmic bucket, never by comparing a group with itself: a
fact looks up only buckets within the tolerance, and there only units of larger size, so copies in one unit do
not meet.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimforge.functions.letters import readable
from claimforge.functions.text import plain_key

AXES = ("mass", "length", "time", "temperature", "inr", "usd", "eur", "gbp", "count", "share")


def _vector(**exponents: int) -> tuple[int, ...]:
    return tuple(exponents.get(a, 0) for a in AXES)


_NONE, _LENGTH, _TIME, _MASS = _vector(), _vector(length=1), _vector(time=1), _vector(mass=1)
_POWER, _ENERGY, _AREA = _vector(mass=1, length=2, time=-3), _vector(mass=1, length=2, time=-2), _vector(length=2)
#: Words for powers of ten.
SCALES = {
    "hundred": 100, "k": 1000, "'000": 1000, "000s": 1000, "thousand": 1000, "thousands": 1000, "thou": 1000,
    "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "million": 1_000_000, "millions": 1_000_000, "mn": 1_000_000, "mln": 1_000_000, "mio": 1_000_000, "mm": 1_000_000,
    "crore": 10_000_000, "crores": 10_000_000, "cr": 10_000_000, "crs": 10_000_000, "billion": 10**9, "billions": 10**9, "bn": 10**9, "trillion": 10**12, "tn": 10**12,
}
#: Names, factor to the coherent unit, vector, and offset where zero lies elsewhere.
_TABLE = [
    ("inr rs re rupee rupees ₹ rs.", 1, _vector(inr=1)), ("usd us$ $ dollar dollars", 1, _vector(usd=1)), ("eur euro euros €", 1, _vector(eur=1)), ("gbp £", 1, _vector(gbp=1)),
    ("percent pct % percentage", 0.01, _vector(share=1)), ("bps bp basispoints", 0.0001, _vector(share=1)), ("fraction", 1, _vector(share=1)),
    ("unit units no nos number numbers item items piece pieces pcs", 1, _vector(count=1)), ("dozen", 12, _vector(count=1)),
    ("kg kgs kilogram kilograms kilogramme kilogrammes kilo kilos", 1, _MASS), ("g gm gms gram grams", 0.001, _MASS), ("t tonne tonnes ton tons mt metrictons metricton", 1000, _MASS), ("kt kilotonne kilotonnes", 1_000_000, _MASS),
    ("quintal quintals qtl qtls", 100, _MASS), ("lb lbs pound pounds", 0.45359237, _MASS), ("oz ounce ounces", 0.028349523125, _MASS),
    ("m metre metres meter meters mtr mtrs", 1, _LENGTH), ("km kms kilometre kilometres kilometer kilometers", 1000, _LENGTH), ("cm", 0.01, _LENGTH), ("mi mile miles", 1609.344, _LENGTH), ("ft foot feet", 0.3048, _LENGTH), ("yd yards", 0.9144, _LENGTH),
    ("ha hectare hectares", 10_000, _AREA), ("ac acre acres", 4046.8564224, _AREA), ("sqft sft", 0.09290304, _AREA), ("msf", 92903.04, _AREA), ("sqm", 1, _AREA), ("sqkm", 1_000_000, _AREA),
    ("w watt watts", 1, _POWER), ("kw kilowatt kilowatts", 1000, _POWER), ("mw megawatt megawatts", 1e6, _POWER), ("gw gigawatt gigawatts", 1e9, _POWER), ("hp horsepower", 745.6998715822702, _POWER),
    ("wh", 3600, _ENERGY), ("kwh kwhs", 3.6e6, _ENERGY), ("mwh", 3.6e9, _ENERGY), ("gwh", 3.6e12, _ENERGY), ("twh", 3.6e15, _ENERGY),
    ("j joule joules", 1, _ENERGY), ("kj", 1e3, _ENERGY), ("mj megajoule megajoules", 1e6, _ENERGY), ("gj gigajoule gigajoules", 1e9, _ENERGY), ("tj terajoule terajoules", 1e12, _ENERGY),
    ("s sec secs second seconds", 1, _TIME), ("min mins minute minutes", 60, _TIME), ("h hr hrs hour hours", 3600, _TIME), ("d day days", 86_400, _TIME), ("week weeks wk wks", 604_800, _TIME),
    ("kelvin", 1, _vector(temperature=1)), ("celsius °c degc", 1, _vector(temperature=1), 273.15), ("fahrenheit °f degf", 5 / 9, _vector(temperature=1), 459.67 * 5 / 9),
]
ATOMS = {name: (row[1], row[2], row[3] if len(row) > 3 else 0.0) for row in _TABLE for name in row[0].split()}
#: Wordings of one unit in several words.
_PHRASES = [(re.compile(p), r) for p, r in ((r"\bper\s*cent(?:age)?\b", "percent"), (r"\bbasis\s+points?\b", "bps"), (r"\b(?:as\s+)?a\s+fraction(?:\s+of)?\b|\bratio\s*\(0-1\)|\bratio\s+of\b", "fraction"), (r"\bmetric\s+(tons?|tonnes?)\b", "tonne"), (r"\bsingle\s+items?\b", "unit"), (r"\bus\s*\$|\bu\.s\.\s*\$", "us$"), (r"\bin\s+(?=thousand|lakh|crore|million|billion|lac)", ""), (r"['’`]\s*000s?\b", "'000"))]
_TOKEN = re.compile(r"\s*(us\$|'000|°[cf]|[₹$€£%]|[a-z]+|\^?[23](?!\d)|[-./*·×])")
_NUMBER = r"\d+(?:,\d+)+(?:\.\d+)?|\d+(?:\.\d+)?(?:e[-+]?\d+)?|\.\d+"
_MONEY = re.compile(r"[₹$€£]|\b(?:rs|inr|usd|eur|gbp|rupees?|dollars?)\b")
_VALUE = re.compile(rf"^\s*(?P<open>\()?\s*(?:approx\.?|about|around|circa|c\.|~|≈)?\s*(?P<sign>[-+])?\s*(?P<before>[^\d.,(+-]*?)\s*(?P<sign2>[-+])?\s*(?P<number>{_NUMBER})\s*(?P<after>.*?)\s*$")
_ANY_NUMBER = re.compile(rf"(?<![\w.,])(?P<sign>-\s?)?(?P<number>{_NUMBER})(?![\d])|(?<=[₹$€£])(?P<number2>{_NUMBER})")
_BEFORE = re.compile(r"(us\$|[₹$€£]|\b(?:inr|usd|eur|gbp|rs\.?|rupees|dollars)|fraction)\s*-?\s*(?=[\d.])")


class Unit(NamedTuple):
    """A unit expression: its scale words, the factor and offset of its atoms, and their vector."""

    scale: float
    factor: float
    vector: tuple[int, ...]
    offset: float = 0.0


def parse_unit(text: str, whole: bool = True, money: bool = False) -> tuple[Unit | None, int]:
    """The unit at the start of a text and where it ends; with ``whole`` it must be all of the text.

    An m by itself is a metre, with ``money`` or beside a currency or another unit a million.
    """
    return _read_unit(_phrased(text), 0, whole, money)


def _phrased(text: str) -> str:
    """A text in lower case, spaces as one, with wordings of several words as one."""
    text = " ".join(text.lower().split())
    for pattern, instead in _PHRASES:
        text = pattern.sub(instead, text)
    return text


def _read_unit(text: str, start: int, whole: bool, money: bool) -> tuple[Unit | None, int]:
    """The unit that a phrased text has at a place; it is read to the end of the unit expression, however far that is."""
    scale, factor, vector, offset, power, last, divide, end = 1.0, 1.0, _NONE, 0.0, 1, None, False, start
    at, atoms, scales = start, 0, 0
    while m := _TOKEN.match(text, at):
        token = m[1]
        currency = money or any(vector[4:8])
        if token in "-./*·×":
            divide = token == "/"
            at = m.end()
            continue
        if token.lstrip("^") in ("2", "3") and last:
            k = int(token.lstrip("^")) - 1
            factor, vector = factor * last[0] ** k, tuple(a + k * b for a, b in zip(vector, last[1]))
            last, at = None, m.end()
            end = at
            continue
        following = _TOKEN.match(text, m.end())
        if token == "m" and not divide and power == 1 and (currency or following and (following[1] in ATOMS or following[1] in ("sq", "square", "us$"))):
            token = "mn"
        if token in ("sq", "square", "cubic", "cu"):
            power, at = 3 if token[0] == "c" else 2, m.end()
            continue
        if token in SCALES and not divide:
            if scales:
                break
            scale, scales = scale * SCALES[token], scales + 1
        elif token in ATOMS:
            f, v, o = ATOMS[token]
            if v == _vector(count=1) and atoms and whole is False:
                break
            sign = -power if divide else power
            factor, vector, offset, last = factor * f**sign, tuple(a + sign * b for a, b in zip(vector, v)), o if not atoms else 0.0, (f, v)
            power, atoms, divide = 1, atoms + 1, False
        elif token == "of" and atoms:
            at = m.end()
            continue
        else:
            break
        at = end = m.end()
    if not (atoms or scales) or whole and text[end:].strip(" .,;:()"):
        return None, 0
    return Unit(scale, factor, vector, offset), end


_UNITS: dict[tuple[str, bool, bool], Unit | None] = {}


def _unit(text: str | None, whole: bool = True, money: bool = False) -> Unit | None:
    if not text or text.isspace():
        return None
    key = (text, whole, money)
    if len(text) > 200:
        return parse_unit(*key)[0]  # read alike, but not kept
    if key not in _UNITS:
        if len(_UNITS) > 100_000:
            _UNITS.clear()
        _UNITS[key] = parse_unit(*key)[0]
    return _UNITS[key]


def _joined(parts: list[Unit | None]) -> Unit | None:
    """One unit from what stands before, behind and beside a number; earlier parts win where they say the same."""
    known = [p for p in parts if p]
    if not known:
        return None
    atoms = next((p for p in known if p.vector != _NONE and (p.vector != ATOMS["unit"][1] or all(q.vector in (_NONE, p.vector) for q in known))), None)
    scale = next((p.scale for p in known if p.scale != 1), 1.0)
    return Unit(scale, atoms.factor, atoms.vector, atoms.offset) if atoms else Unit(scale, 1.0, _NONE)


def _decimal(number: str) -> Decimal | None:
    try:
        return Decimal(number.replace(",", ""))
    except InvalidOperation:
        return None


def _in_quote(number: Decimal, quote: str) -> Unit | None:
    """The unit that a quotation has at the number."""
    text = _phrased(readable(quote))
    before = {m.end(): m[1] for m in _BEFORE.finditer(text)}
    for m in _ANY_NUMBER.finditer(text):
        found = _decimal(m["number"] or m["number2"])
        if found is not None and found == abs(number):
            lead = _unit(before.get(m.start("number") if m["number"] else m.start("number2")), False)
            behind = None if text[m.end() : m.end() + 2].lstrip()[:1] in ("", "(", "|", ",", ";") else _read_unit(text, m.end(), False, bool(lead and any(lead.vector[4:8])))[0]
            if unit := _joined([lead, behind]):
                return unit
    return None


def parse_quantity(value: str | None, unit: str | None, quote: str | None) -> tuple[Decimal, Unit] | None:
    """The number of a fact and its unit, from the value, the unit column and, where they leave it open, the quote."""
    if not value:
        return None
    m = _VALUE.match(_phrased(readable(value)))
    number = _decimal(m["number"]) if m else None
    if number is None:
        return None
    before, after = m["before"].strip(), m["after"].strip()
    closed = m["open"] and after.startswith(")")
    after = after.lstrip(")").strip()
    if m["sign"] == "-" or m["sign2"] == "-" or closed:
        number = -number
    lead = _unit(before) if before else None
    if before and lead is None:
        return None
    behind = _unit(after, True, bool(lead and any(lead.vector[4:8]) or unit and _MONEY.search(unit.lower())))
    if after and behind is None:
        return None
    column = _unit(readable(unit)) if unit else None
    found = _joined([lead, behind, column])
    if found is None or found.vector == _NONE:
        quoted = _in_quote(number, quote) if quote else None
        if found is None:
            found = quoted
        elif quoted and quoted.vector != _NONE and quoted.scale in (1.0, found.scale):
            found = Unit(found.scale, quoted.factor, quoted.vector, quoted.offset)
    if found is None:
        return None
    # A scale by itself counts single items.
    return number, found if found.vector != _NONE else Unit(found.scale, 1.0, _vector(count=1))


def to_base_units(facts: DataFrame, units: DataFrame, keys: list[str], most_units: int = 1000) -> DataFrame:
    """(keys..., dimension, base_unit, base_value, unit_size) of each fact that states a quantity.

    ``facts`` has the columns value, unit and evidence_quote; ``units`` (dimension, base_unit) is a small table whose
    size is checked. unit_size is the written unit in base units. Facts without a number, with a unit that the grammar
    cannot read, with no unit stated anywhere, of a dimension without a base unit or beyond what a double holds give no
    row. Repeated rows come out repeated; other columns are ignored. Texts of any length are read whole.
    """
    rows = [tuple(r) for r in units.select("dimension", "base_unit").where("dimension is not null and base_unit is not null").limit(most_units + 1).collect()]
    if len(rows) > most_units:
        raise ValueError(f"more than {most_units} base units")
    asked = facts.select(*keys, "value", "unit", "evidence_quote").where(F.col("value").rlike(r"[0-9０-９\x{1D7CE}-\x{1D7FF}]"))
    n = len(keys)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = {}
        for dimension, base in rows:
            unit = parse_unit(base)[0]
            if unit:
                bases[unit.vector] = (dimension, base, unit.scale * unit.factor, unit.offset)
        for batch in batches:
            at, out = [], []
            for k, (value, unit, quote) in enumerate(zip(*(c.to_pylist() for c in batch.columns[n:]))):
                found = parse_quantity(value, unit, quote)
                base = bases.get(found[1].vector) if found else None
                if base:
                    number, u = found
                    size = u.scale * u.factor / base[2]
                    amount = float(number) * size + (u.offset - base[3]) / base[2]
                    if math.isfinite(amount):
                        at.append(k)
                        out.append((base[0], base[1], amount, size))
            kept = pa.array(at, pa.int32())
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(c.take(kept) for c in batch.columns[:n]), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())], names=[*keys, "dimension", "base_unit", "base_value", "unit_size"])

    schema = T.StructType([*asked.select(*keys).schema.fields, *(T.StructField(c, t) for c, t in (("dimension", T.StringType()), ("base_unit", T.StringType()), ("base_value", T.DoubleType()), ("unit_size", T.DoubleType())))])
    return asked.mapInArrow(convert, schema)


def same_quantities(facts: DataFrame, units: DataFrame, id_col: str, same: list[str], tolerance: float = 0.001) -> DataFrame:
    """(a, b), a < b: facts whose ``same`` columns have equal plain keys and that state the same quantity in units of different size.

    Base values may lie apart by ``tolerance`` of the larger one. Null texts are empty; facts without id or quantity
    are left out, a repeated id counts once.
    """
    keyed = facts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.concat_ws("\u0001", *(plain_key(F.col(c)) for c in same)).alias("same"), "value", "unit", "evidence_quote")
    found = to_base_units(keyed, units, ["id", "same"]).dropDuplicates(["id"])
    # Values within the tolerance lie in the same or in neighbouring buckets; sizes are compared by their digits.
    width = -2.02 * F.log(F.lit(1 - tolerance)) / 2
    bucket = F.when(F.col("base_value") == 0, F.lit(-(2**62))).otherwise(F.floor(F.log(F.abs("base_value")) / width)).cast("bigint")
    found = found.select("id", "base_value", F.xxhash64("same", "dimension", F.signum("base_value")).alias("h"), F.concat_ws("\u0001", "same", "dimension").alias("group"), bucket.alias("bucket"), F.round(F.log("unit_size"), 6).alias("size"))
    sizes = found.groupBy("h", "bucket").agg(F.collect_set("size").alias("sizes"))
    asked = found.select("id", "base_value", "h", "group", "size", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    asked = asked.join(sizes, ["h", "bucket"]).withColumn("larger", F.explode(F.filter("sizes", lambda s: s > F.col("size")))).drop("sizes")
    other = found.select(F.col("id").alias("id_b"), F.col("base_value").alias("value_b"), "h", F.col("group").alias("group_b"), "bucket", F.col("size").alias("larger"))
    near = F.abs(F.col("base_value") - F.col("value_b")) <= tolerance * F.greatest(F.abs("base_value"), F.abs("value_b")) * (1 + 1e-9)
    pairs = asked.join(other, ["h", "bucket", "larger"]).where((F.col("group") == F.col("group_b")) & near)
    return pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))
