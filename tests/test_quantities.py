import itertools
import re

import pytest
from pyspark.sql import functions as F

from claimforge.operators.quantities import parse_quantity, parse_unit, same_quantities, to_base_units

FACTS = "id string, entity string, attribute string, period string, scope string, value string, unit string, evidence_quote string"
UNITS = [("money_inr", "INR"), ("money_usd", "USD"), ("share", "percent"), ("mass", "kg"), ("distance", "km"), ("area", "square metre"), ("power", "kW"), ("energy", "kWh"), ("quantity", "single item"), ("duration", "hour")]


@pytest.fixture
def units(spark):
    return spark.createDataFrame(UNITS, "dimension string, base_unit string")


@pytest.mark.parametrize(
    ("value", "unit", "quote", "dimension", "base"),
    [
        ("1,234.5", "₹ Cr", None, "money_inr", 12_345_000_000),
        ("₹1,272.32mn", None, None, "money_inr", 1_272_320_000),
        ("2,614.02 billion", "$", None, "money_usd", 2_614_020_000_000),
        ("161.3 crore rupees", "INR", None, "money_inr", 1_613_000_000),
        ("5.5", "US$ m", None, "money_usd", 5_500_000),
        ("4576.1", None, "₹4,576.1 crore was the balance", "money_inr", 45_761_000_000),
        ("4576.1", None, "the balance was 4,576.1 (Q1)", None, None),
        ("16.64%", "pct", None, "share", 16.64),
        ("-0.7376", "fraction", None, "share", -73.76),
        ("a fraction of 4.31", "as a fraction", None, "share", 431),
        ("12.1", "bps", None, "share", 0.121),
        ("5459.69", "megawatt-hours", None, "energy", 5_459_690),
        ("1", "terajoules", None, "energy", 277_777.777778),
        ("2", "mn kWh", None, "energy", 2_000_000),
        ("774.9", "metres", None, "distance", 0.7749),
        ("3", "mi", None, "distance", 4.828032),
        ("10", "sq ft", None, "area", 0.9290304),
        ("2", "m²", None, "area", 2),
        ("1", "msf", None, "area", 92_903.04),
        ("7", "qtl", None, "mass", 700),
        ("3.5", "mn tonnes", None, "mass", 3_500_000_000),
        ("90", "minutes", None, "duration", 1.5),
        ("2", "weeks", None, "duration", 336),
        ("4.2 lakh", None, None, "quantity", 420_000),
        ("8", "lakh nos", None, "quantity", 800_000),
        ("(12.5)", "kg", None, "mass", -12.5),
        ("resigned", None, None, None, None),
        ("", "kg", None, None, None),
        ("5", "parsnips", None, None, None),
        ("７.5", "ｋｇ", None, "mass", 7.5),
    ],
)
def test_conversion(spark, units, value, unit, quote, dimension, base):
    rows = to_base_units(spark.createDataFrame([("a", value, unit, quote)], "id string, value string, unit string, evidence_quote string"), units, ["id"]).collect()
    if dimension is None:
        assert rows == []
    else:
        assert rows[0].dimension == dimension
        assert rows[0].base_value == pytest.approx(base, rel=1e-9)


def test_exponents_make_products():
    assert parse_unit("kW h")[0].vector == parse_unit("kWh")[0].vector == parse_unit("megawatt-hours")[0].vector
    assert parse_unit("square feet")[0].vector == parse_unit("acres")[0].vector
    assert parse_unit("km/h")[0].factor == pytest.approx(1000 / 3600)
    assert parse_unit("celsius")[0].offset == 273.15


def test_pairs_of_units(spark, units):
    row = lambda i, v, u, e="Acme Ltd.", p=None: (i, e, "Revenue", p, "", v, u, None)
    facts = spark.createDataFrame(
        [row("a", "1.5", "₹ crore"), row("b", "15", "₹ million", "ACME, ltd"), row("c", "1.5", "₹ Cr"), row("d", "15.01", "INR million"), row("e", "15.1", "INR million"), row("f", "150", "lakh"), row("b", "15", "₹ million", "ACME, ltd"), row(None, "15", "₹ million"), row("z", "15", "₹ million", None), row("y", "0", "₹ million"), row("x", "0", "₹ crore")],
        FACTS,
    ).withColumn("size", F.lit("clash"))
    got = {tuple(r) for r in same_quantities(facts, units, "id", ["entity", "attribute", "period", "scope"]).collect()}
    assert got == {("a", "b"), ("b", "c"), ("a", "d"), ("c", "d"), ("x", "y")}


def test_pairs_against_brute_force(spark, small):
    facts = spark.read.parquet(f"{small}/facts.parquet").dropDuplicates(["id"])
    units = spark.read.parquet(f"{small}/ref_units.parquet")
    got = {tuple(r) for r in same_quantities(facts, units, "id", ["entity", "attribute", "period", "scope"]).collect()}
    bases = {parse_unit(b)[0].vector: parse_unit(b)[0] for _, b in UNITS}
    key = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    groups = {}
    for r in facts.collect():
        if (q := parse_quantity(r.value, r.unit, r.evidence_quote)) and q[1].vector in bases:
            size = q[1].scale * q[1].factor
            groups.setdefault((key(r.entity), key(r.attribute), key(r.period), key(r.scope), q[1].vector), []).append((r.id, float(q[0]) * size, size))
    want = {tuple(sorted((x[0], y[0]))) for g in groups.values() for x, y in itertools.combinations(g, 2) if abs(x[1] - y[1]) <= 0.001 * max(abs(x[1]), abs(y[1])) and abs(x[2] / y[2] - 1) > 1e-6}
    assert got == want and got


def test_empty(spark, units):
    empty = spark.createDataFrame([], FACTS)
    assert same_quantities(empty, units, "id", ["entity"]).count() == 0
    assert to_base_units(empty, units.limit(0), ["id"]).count() == 0


def test_long_values_are_read_whole():
    found = lambda *fact: (lambda q: q and (float(q[0]), q[1].scale))(parse_quantity(*fact))
    assert found("about" + " " * 220 + "12 crore", "INR", None) == (12.0, 1e7)
    assert found("12" + " " * 500 + "crore", "INR", None) == (12.0, 1e7)
    assert found("12", None, "word " * 20_000 + "of " + "INR" + " " * 90 + "12" + " " * 90 + "crore of debt") == (12.0, 1e7)
    assert found("12", None, "12 pages " * 5_000 + "then 12 crore rupees") == (12.0, 1e7)
    assert found("12 crore " + "and so on " * 500, "INR", None) is None


def test_numbers_beyond_a_double(spark, units):
    assert to_base_units(spark.createDataFrame([("a", "9" * 100_000, "kg", "x" * 100_000), ("b", "1e999999", "kg", None)], "id string, value string, unit string, evidence_quote string"), units, ["id"]).count() == 0
