"""Operators for training data against brute force, and on nulls, blanks, long texts, ties, repeats and empty tables."""

import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimforge.llm import groups
from claimforge.llm.canonical import Matcher, map_to_canonical
from claimforge.llm.formatting import formatting_copies, formatting_groups
from claimforge.llm.groups import connected_groups
from claimforge.llm.leaks import LeakIndex, find_leaks
from claimforge.llm.lookalikes import _HARMLESS, look_alikes, to_plain_text
from claimforge.llm.mixing import fill, mix_documents, mix_shares, plan_mixes
from claimforge.llm.names import common_words, link_names, name_pairs, short_for, trie_join, within_one
from claimforge.llm.quality import KINDS, STATISTICS, document_statistics, score_quality, text_statistics
from claimforge.llm.splitting import split_oversized, split_text

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return {tuple(r) for r in df.collect()}


# 1 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("field", "value", "term"),
    [
        ("period", "first quartrr of FY25", "Q1 FY25"),
        ("period", "2QFY24", "Q2 FY24"),
        ("period", "FY2O21", "FY21"),
        ("period", "Apr 2016 - Mar 2017", "FY17"),
        ("period", "year ended 31 December 2019", "CY2019"),
        ("period", "half year ended 31 March 2024,", "H2 FY24"),
        ("period", "30-Jun-15", "as of 30 June 2015"),
        ("period", "Spetember 30th 2023", "as of 30 September 2023"),
        ("period", "nine months to Dec 2024", "9M FY25"),
        ("period", "III QTR FY25", "Q3 FY25"),
        ("period", "Q5 FY22", None),
        ("period", "FY 2041", None),
        ("period", "monsoon season", None),
        ("scope", "likefor-like", "like-for-like"),
        ("scope", "SEASONALLY-ADJUSTED", "seasonally adjusted"),
        ("scope", "un-audited,", "unaudited"),
        ("scope", "pro froma (unadj)", "pro forma"),
        ("scope", "on a consoldated basis", "consolidated"),
        ("scope", "half of fleet", None),
        ("scope", "Cons.", "consolidated"),
        ("scope", "rep'd", "reported"),
        ("scope", "provsnl", "provisional"),
        ("scope", "cst ccy", "constant currency"),
        ("scope", "disc ops", "discontinued operations"),
        ("scope", "L.F.L. growth", "like-for-like"),
        ("scope", "segmental", "segment"),
        ("scope", "not audited", "unaudited"),
        ("scope", "on the basis of the group figures as of the results " * 9 + "consolidated", "consolidated"),
        ("period", "the figures of the period in the results for the items of the data on the values " * 4 + "Q1 FY25", "Q1 FY25"),
        ("scope", "?!", None),
        ("unheard", "FY21", None),
    ],
)
def test_canonical(spark, field, value, term):
    terms = spark.read.parquet(f"{SMALL}/ref_terms.parquet")
    names = {r.term_id: r.term for r in terms.collect()} | {0: None}
    got = map_to_canonical(spark.createDataFrame([("k", field, value, "x")], "id string, field string, value string, term string"), terms, ["id"]).collect()
    assert [names[r.term_id] for r in got] == [term]


def test_canonical_edges(spark):
    terms = spark.read.parquet(f"{SMALL}/ref_terms.parquet")
    values = spark.createDataFrame([("a", "scope", None), ("b", "scope", "  "), ("c", "scope", "audited"), ("c", "scope", "audited"), ("d", "scope", "adjusted restated"), ("e", "period", "FY21 " * 5000), ("f", "period", "w1x " * 20_000 + "FY21")], "id string, field string, value string")
    got = sorted((r.id, r.term_id) for r in map_to_canonical(values, terms, ["id"]).collect())
    assert got[:3] == [("c", 180), ("c", 180), ("d", 0)] and got[3][1] > 0 and got[4][1] == 0
    assert map_to_canonical(values.limit(0), terms, ["id"]).count() == 0
    assert [r.term_id for r in map_to_canonical(values.where("id = 'd'"), terms.limit(0), ["id"]).collect()] == [0]
    with pytest.raises(ValueError):
        map_to_canonical(values, terms, ["id"], most_terms=10)


def test_readings_against_brute_force():
    """All ways to read a value, one by one, against the search along all of them at once."""
    matcher = Matcher([(1, ["alpha beta"]), (2, ["alpha"]), (3, ["beta gamma delta"]), (4, ["gamma"]), (5, ["delta x"])], 0.65)
    rng = random.Random(7)
    words = ["alpha", "alhpa", "beta", "btea", "gamma", "gmma", "delta", "dleta", "x", "betagamma", "of", "zzz"]
    for _ in range(400):
        own = [rng.choice(words) for _ in range(rng.randint(1, 5))]
        readings = list(map(matcher._readings, own))
        plain = {matcher._plain(" ".join(way).split()) for way in itertools.product(*readings)}
        if len(plain) == 1:
            assert matcher._read(own, readings) in plain | {0} if 0 in plain else matcher._read(own, readings) in plain


# 2 ---------------------------------------------------------------------------------------------------------------


def test_trie_join_against_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(220)}
    df = spark.createDataFrame([("s", w) for w in words] + [("t", w) for w in list(words)[:40]], "space string, core string")
    want = {(a, b) for a in words for b in words if a < b and within_one(a, b)}
    for most in (20_000, 5):
        got = rows(trie_join(df, most_in_shard=most).where("space = 's'").select("a", "b"))
        assert got == want


@pytest.mark.parametrize("limit", [2, 3])
def test_trie_join_for_more_edits(spark, limit):
    rng = random.Random(9)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 11))) for _ in range(130)}
    words |= {w[: len(w) // 2] + rng.choice("xyz") + w[len(w) // 2 :] for w in list(words)[:40]}
    words |= {w[: len(w) // 2] + w[len(w) // 2 + 1 : len(w) // 2 + 2] + w[len(w) // 2 : len(w) // 2 + 1] + w[len(w) // 2 + 2 :] for w in list(words)[:40]}
    df = spark.createDataFrame([("s", w) for w in words] + [("s", None), (None, "a")], "space string, core string")

    def distance(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a, 1):
            rows.append([i])
            for j, y in enumerate(b, 1):
                cost = min(rows[-2][j] + 1, rows[-1][-1] + 1, rows[-2][j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    cost = min(cost, rows[-3][j - 2] + 1)
                rows[-1].append(cost)
        return rows[-1][-1]

    assert rows(trie_join(df, limit, 50).select("a", "b")) == {(a, b) for a in words for b in words if a < b and distance(a, b) <= limit}


def test_words_of_trade_are_learned(spark):
    names = [f"n{k:02}ox {trade}{legal}" for k in range(40) for trade, legal in (("cement", " limited"), ("engineering", " ltd"), ("engg" if k % 2 else "shipping lines", " inc"))]
    names += ["hotname " + "x" * k for k in range(30)] + ["solo word", ""]
    trade, shorts = common_words(spark.createDataFrame([(n,) for n in names if n], "key string"))
    assert set(trade) == {"cement", "engineering", "shipping", "lines"} and dict(shorts) == {"engg": "engineering"}


@pytest.mark.parametrize(("short", "word"), [("engg", "engineering"), ("mfg", "manufacturing"), ("pharma", "pharmaceuticals"), ("infrastr", "infrastructure"), ("logst", "logistics"), ("cements", "cement"), ("intl", "international"), ("inal", None), ("tramvus", None), ("x", None)])
def test_short_for(short, word):
    assert short_for(short, ["engineering", "manufacturing", "pharmaceuticals", "infrastructure", "logistics", "cement", "international"]) == word


def test_names_of_many_words_in_other_orders(spark):
    df = spark.createDataFrame([("Juan Carlos Perez Gomez Diaz",), ("Perez Gomez Diaz Juan Carlos",), ("Carlos Diaz Gomez Juan Perez",), ("Alba Bern Cole Dorn Limited",), ("Cole Dorn Alba Bern Ltd",)], "name string")
    assert sorted(r["count"] for r in link_names(df, "name").groupBy("entity").count().collect()) == [2, 3]


TRADES = ["cement", "financial", "insurance", "networks", "railways", "national", "services"]
SHORTS = {"ins": "insurance", "rlys": "railways", "natl": "national"}


def test_names(spark):
    alike = [
        ["Vumstomjin National Railways Limited", "VUMSTOJMIN National Railways Ltd.", "National Railways Vumstomjin Limited", "Vums tomjin Nat'l Rlys Limited", "The Vumstomjin National Railways", "Vumstomjin Railways Ltd"],
        ["Mertelnil Vemkilzer Insurance Holdings Limited", "M. Vemkilzer Insurance Holdings Limited", "Vemkilzer Mertelnil Ins. Hldgs Ltd", "Mertelnil VemkilzerInsurance Holdings Limited"],
        ["Mertelnil Vemkilzer Cement Private Limited", "M/s Mertelnil Vemkilzer Cement Pvt Ltd"],
        ["Katherine R. Lorbrolsil", "Lorbrolsil, K.", "Mr/Ms Kate Lorbrolsil", "K. R. Lorbrolsil"],
        ["Victoria S. Lorbrolsil", "Vicky Lorbrolsil", "Lorbrolsil, Victoria S."],
        ["Edward R. Damnalgul"],
        ["Edward T. Damnalgul"],
    ]
    typed = [n for g in alike for n in g] * 2 + [None, "", " - "]
    df = spark.createDataFrame([(n, "x") for n in typed], "name string, entity string")
    key = lambda n: re.sub(r"[\W_]+", " ", n.lower()).strip()
    linked = link_names(df, "name", TRADES, SHORTS)
    got = defaultdict(set)
    for r in linked.collect():
        got[r.entity].add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(sorted({key(n) for n in g}) for g in alike)
    assert all(min(v) == k for k, v in got.items())
    assert name_pairs(linked).count() == sum(len({key(n) for n in g}) * (len({key(n) for n in g}) - 1) // 2 for g in alike)
    assert link_names(df.limit(0), "name").count() == 0


def test_a_word_left_out_is_no_slip(spark):
    df = spark.createDataFrame([("Gartaldal Namkelkur Networks Limited",), ("Namkelkur Networks Limited",), ("Namkolkur Networks Limited",), ("Namkolkurr Networks Ltd",)], "name string")
    got = defaultdict(set)
    for r in link_names(df, "name", TRADES).collect():
        got[r.entity].add(r.name.split(" networks")[0])
    assert sorted(map(sorted, got.values())) == [["gartaldal namkelkur", "namkelkur"], ["namkolkur", "namkolkurr"]]


def test_ambiguous_short_forms_stay_alone(spark):
    df = spark.createDataFrame([("Alan B. Dorn",), ("Adam C. Dorn",), ("Dorn, A.",), ("x" * 20_000,)], "name string")
    assert link_names(df, "name").select("entity").distinct().count() == 4


# 3 ---------------------------------------------------------------------------------------------------------------


def test_formatting(spark):
    facts = spark.createDataFrame(
        [("d", "ACME, Ltd", "Net  sales", "Acme Ltd Net sales (FY21): 24,82,700 ₹"), ("b", "acme ltd", "net-sales", "₹2482700 | FY21 | net SALES | acme (ltd)"), ("c", "acme ltd", "net sales", "Acme Ltd Net sales FY21: -2482700 ₹"), ("a", "ltd acme", "net sales", "x"), ("d", "ACME, Ltd", "Net  sales", "Acme Ltd Net sales (FY21): 24,82,700 ₹"), (None, "x", "x", "x"), ("e", None, None, None), ("f", "", " ", "--")],
        "id string, entity string, attribute string, canonical_statement string",
    ).withColumn("key", F.lit("clash"))
    for n in (1, 4):
        assert rows(formatting_copies(facts, "id", ["entity", "attribute"], ["canonical_statement"], n)) == {("b", "d"), ("e", "f")}
        assert rows(formatting_groups(facts, "id", ["entity", "attribute"], ["canonical_statement"], n)) == {("b", 2), ("c", 1), ("a", 1), ("e", 2)}
    assert formatting_copies(facts.limit(0), "id", ["entity"], []).count() == 0


def test_formatting_runs_over_borders(spark):
    many = spark.range(3000).select(F.format_string("%05d", "id").alias("id"), F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("t"))
    many = many.unionByName(many.where("id < '00100'"))
    want = defaultdict(set)
    for r in many.collect():
        want[r.t.lower()].add(r.id)
    assert rows(formatting_copies(many, "id", ["t"], [], 9)) == {(min(v), x) for v in want.values() for x in v - {min(v)}}
    assert rows(formatting_groups(many, "id", ["t"], [], 9)) == {(min(v), len(v)) for v in want.values()}


# 4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "rows"), [("word " * 3000, False), ("x" * 9000, False), ("a | b | c\n" * 900, True), ("Sentence one is here. " * 400 + "\n\n" + "y" * 3000, False), ("é" * 4000, False), ("क्‍ष" * 1500, False), ("\r\n" * 2000, False), ("", False), ("short", True)])
def test_split_text(text, rows):
    pieces = split_text(text, 2400, 200, rows)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert b - a <= 2400 and d - c <= 2400 and c <= b and 195 <= b - c <= 200 and d > b
        if rows:
            assert text[b - 1] == "\n"
        if b < len(text):
            assert unicodedata.category(text[b])[0] != "M"
    if len(text) <= 2400:
        assert len(pieces) == 1


def test_split_oversized(spark):
    chunks = spark.createDataFrame([("a", "w " * 2000, False), ("a", "w " * 2000, False), ("b", "w " * 1200, None), ("c", None, True), (None, "w " * 2000, True), ("d", "", False)], "id string, raw_text string, is_table boolean").withColumn("piece_no", F.lit("clash"))
    got = split_oversized(chunks, "id", "raw_text", "is_table").collect()
    assert {r.id for r in got} == {"a"} and len(got) == len({r.piece_no for r in got})
    assert all(r.piece_text == ("w " * 2000)[r.char_start : r.char_end] for r in got)
    assert split_oversized(chunks.limit(0), "id", "raw_text").count() == 0
    with pytest.raises(ValueError):
        split_oversized(chunks, "id", "raw_text", overlap=2400)


# 5 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("Ｔｏｔａｌ　１２，５％", "Total 12,5%"),
        ("сosт of thе оrdеr", "cost of the order"),
        ("draft Β at noon", "draft B at noon"),
        ("Calérie", "Calérie"),
        ("th­e​ first week﻿", "the first week"),
        ("oﬃce K Ⅳ", "office K IV"),
        ("Отчёт опубликован в срок, и о том", None),
        ("Η έκθεση εγκρίθηκε.", None),
        ("क्‍षेत्र में", None),
        ("年次報告書を公表した。（注）", None),
        ("2σ and Δ 0.4 ≈ 3² – “x” … it’s €5", None),
        ("Zürich, Ñandú\nÜber\r\n", None),
        ("", None),
        ("x" * 50_000, None),
    ],
)
def test_plain_text(spark, text, plain):
    tables = look_alikes(spark)
    assert tables.text(text) == (text if plain is None else plain)
    assert tables.text(tables.text(text)) == tables.text(text)


@pytest.mark.parametrize(
    ("points", "plain"),
    [((0x61, 0x3164, 0x62), "ab"), ((0x63, 0x115F, 0x64), "cd"), ((0x65, 0x2800, 0x66), "e f"), ((0x67, 0xE0041, 0xE007F), "g"), ((0x261, 0x6F), "go"), ((0x251, 0x74), "at"), ((0x66, 0x131, 0x6E), "fin"), ((0xA4F0, 0x6E, 0x64), "End"), ((0x2C9F, 0x66), "of"), ((0x3F2, 0x61, 0x73, 0x68), "cash"), ((0x440, 0x44B, 0x431, 0x61), "\u0440\u044b\u0431\u0430")],
)
def test_more_look_alikes(spark, points, plain):
    assert look_alikes(spark).text("".join(map(chr, points))) == plain


def test_script_sets_are_intersected(spark):
    tables = look_alikes(spark)
    assert tables.resolved("a1") == {"Latn"} and tables.resolved("\u0430\u0431") == {"Cyrl"} and tables.resolved("a\u0430") == frozenset()
    assert "Jpan" in tables.resolved("\u30cb\u4e8c") and tables.resolved("123") is None


def test_no_text_changes_unseen(spark):
    tables, seen = look_alikes(spark), re.compile(f"[^{_HARMLESS}]")
    points = [chr(k) for k in range(0x80, 0x20000) if not 0xD800 <= k < 0xE000]
    assert not [t for c in points for t in (c, f"ab{c}cd", f"x {c} y") if not seen.search(t) and tables.text(t) != t]


def test_to_plain_text(spark):
    texts = spark.createDataFrame([("a", "ｘ", 1), ("a", "ｘ", 1), ("b", None, 1), ("c", "", 1), ("d", "Отчёт", 1)], "id string, body string, text int")
    got = sorted((tuple(r) for r in to_plain_text(texts, "body", ["id"]).collect()), key=repr)
    assert got == [("a", "x", True), ("a", "x", True), ("b", None, False), ("c", "", False), ("d", "Отчёт", False)]
    assert rows(to_plain_text(texts, "body", ["id"], changed_only=True)) == {("a", "x", True)}
    assert to_plain_text(texts.limit(0), "body", ["id"]).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------


def components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in parent}


def test_groups_against_brute_force(spark):
    rng = random.Random(11)
    links = [(f"c{k:03}", f"c{k + 1:03}") for k in range(150)] + [(f"s{0:03}", f"s{k:03}") for k in range(1, 60)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    links += [(f"k{a}", f"k{b}") for a in range(9) for b in range(a)] + [(f"x{rng.randrange(90):02}", f"x{rng.randrange(90):02}") for _ in range(80)]
    links += [(b, a) for a, b in links[::3]] + [("self", "self"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(links, "a string, b string").withColumn("v", F.lit("clash"))
    assert rows(connected_groups(df, "a", "b").select("member", "group_id")) == components(links)


def test_long_paths_are_ranked_not_hooked(spark, monkeypatch):
    monkeypatch.setattr(groups, "_hook", lambda *a: pytest.fail("a path has no core"))
    n = 4_000
    path = spark.range(n).select(F.format_string("v%06d", "id").alias("a"), F.format_string("v%06d", F.col("id") + 1).alias("b"))
    ring = spark.range(700).select(F.format_string("r%03d", "id").alias("a"), F.format_string("r%03d", (F.col("id") + 1) % 700).alias("b"))
    got = connected_groups(path.unionByName(ring), "a", "b").groupBy("group_id").count()
    assert rows(got) == {("v000000", n + 1), ("r000", 700)}


def test_trees_need_no_core(spark, monkeypatch):
    monkeypatch.setattr(groups, "_hook", lambda *a: pytest.fail("a tree has no core"))
    rng = random.Random(3)
    links = [(f"t{rng.randrange(max(1, k)):04}", f"t{k:04}") for k in range(1, 1500)] + [(f"b{k // 2:03}", f"b{k:03}") for k in range(2, 250)]
    assert rows(connected_groups(spark.createDataFrame(links, "a string, b string"), "a", "b").select("member", "group_id")) == components(links)


def test_cores(spark):
    links = [(f"s{k:03}", f"s{k + d:03}") for k in range(200) for d in (1, 2)] + [(f"g{r}{c}", f"g{x}{y}") for r in range(6) for c in range(6) for x, y in ((r + 1, c), (r, c + 1)) if x < 6 and y < 6]
    assert rows(connected_groups(spark.createDataFrame(links, "a string, b string"), "a", "b").select("member", "group_id")) == components(links)


def test_no_links(spark):
    assert connected_groups(spark.createDataFrame([("a", "a")], "a string, b string"), "a", "b").count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item, noise = [word() for _ in range(60)], lambda n: [word() for _ in range(n)]
    changed = item[:40]
    changed[7], changed[21], changed[33] = "other", "words", "here"
    docs = {
        1: noise(50) + item + noise(50),
        2: noise(30) + changed + noise(20),
        3: noise(30) + item[:17] + noise(40) + item[40:58] + noise(9),
        4: noise(30) + item[:20] + noise(80),
        5: noise(200),
        6: [w for pair in zip(item, noise(60)) for w in pair],
        7: noise(5),
        8: item,
    }
    texts = [(k, "\n".join(" ".join(v[i : i + 9]) + "," for i in range(0, len(v), 9)).upper()) for k, v in docs.items()] + [(9, None), (10, ""), (None, " ".join(item)), (8, " ".join(item))]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("share", F.lit("clash"))
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(noise(40))), (3, None), (4, ""), (5, "only three words")], "item_id bigint, text string")
    for block in (20_000, 2):
        assert rows(find_leaks(documents, items, block_items=block).select("doc_id", "item_id")) == {(1, 1), (2, 1), (3, 1), (8, 1)}
    assert find_leaks(documents, items.limit(0)).count() == 0
    assert find_leaks(documents.limit(0), items).count() == 0


@pytest.mark.parametrize(("every", "least", "most"), [(5, 0.95, 1), (6, 0.95, 1), (10, 0.95, 1), (2, 0, 0)])
def test_changed_words_within_passages(every, least, most):
    item = [f"w{k}" for k in range(60)]
    index = LeakIndex([(1, " ".join(item)), (2, "some other item of words")], 10, 3)
    changed = [f"x{k}" if k % every == every - 1 else w for k, w in enumerate(item)]
    assert least <= index.share(0, ["q"] * 30 + changed + ["z"] * 30) <= most


def test_passages_in_pieces_count_together():
    item = [f"w{k}" for k in range(60)]
    index = LeakIndex([(1, " ".join(item))], 10, 3)
    pieces = [w for k in range(0, 60, 24) for w in (*item[k : k + 12], *(f"y{k}{j}" for j in range(50)))]
    assert index.share(0, pieces) == pytest.approx(0.6)
    assert index.share(0, item[20:30] + ["added", "words"] + item[30:40] + item[45:60]) == pytest.approx(35 / 60)
    assert index.share(0, item[:9] + ["n"] * 20 + item[20:29]) == 0
    assert index.share(0, (item[:12] + ["n"] * 9) * 200 + item[30:52]) == pytest.approx(34 / 60)


def test_all_fingerprints_within_the_radius_are_found():
    import numpy as np

    rng = np.random.default_rng(4)
    index = LeakIndex([(k, " ".join(f"w{x}" for x in rng.integers(0, 500, 40))) for k in range(30)], 10, 3)
    asked = np.concatenate([index.prints[::7] ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, replace=False)] or [np.uint64(0)]) for n in (0, 1, 2, 3, 4)])
    at, who = index.candidates(asked)
    want = {(i, int(o)) for i, p in enumerate(asked) for o in index.owners[np.bitwise_count(index.prints ^ p) <= 3]}
    assert set(zip(at.tolist(), who.tolist())) == want


# 9 ---------------------------------------------------------------------------------------------------------------


def test_water_filling():
    assert fill({"a": 0.5, "b": 0.5}, {"a": 1000, "b": 1000}, 100) == {"a": 50, "b": 50}
    assert fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100) == pytest.approx({"a": 10, "b": 54, "c": 36})
    assert fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}, 100) == {"a": 10, "b": 20}
    assert fill({"a": 0.0}, {"a": 10}, 100) == {}


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_mix(spark):
    documents = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 30 == 0, "small").when(F.col("id") % 5 == 0, None).otherwise("mid").alias("source"), F.repeat(F.lit("word "), (F.col("id") % 17 + 1).cast("int")).alias("text"))
    documents = documents.unionByName(spark.createDataFrame([(-1, "big", None), (-2, "big", ""), (None, "big", "x")], "doc_id bigint, source string, text string"))
    targets = spark.createDataFrame([(1, "big", 0.5, 1, 0.4), (1, "small", 0.3, 2, 0.4), (1, "mid", 0.2, 3, 0.4), (2, "big", 0.5, 1, 5.0), (2, "absent", 0.5, 9, 5.0)], "mix_id int, source string, target_share double, max_repeats int, budget_ratio double")
    shares = {(r.mix_id, r.source): r for r in mix_shares(documents, targets, TOKENIZER).collect()}
    total = mix_documents(documents, targets.where("mix_id = 1"), TOKENIZER).agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert total > 0
    assert shares[1, "small"].epochs == pytest.approx(2.0)
    assert shares[1, "big"].tokens / shares[1, "mid"].tokens == pytest.approx(2.5, rel=0.01)
    assert shares[2, "big"].epochs == pytest.approx(1.0) and shares[2, "absent"].tokens == 0
    copies = mix_documents(documents, targets, TOKENIZER)
    assert copies.join(targets, ["mix_id", "source"]).where("copies > max_repeats").count() == 0
    assert copies.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
    assert rows(copies.select("mix_id", "doc_id", "copies")) == rows(mix_documents(documents, targets, TOKENIZER).select("mix_id", "doc_id", "copies"))
    assert mix_documents(documents, targets, TOKENIZER, as_rows=True).count() == copies.agg(F.sum("copies")).first()[0]
    assert mix_documents(documents.limit(0), targets, TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        plan_mixes(documents, targets, TOKENIZER, most_targets=2)
    assert mix_documents(documents, targets.limit(0), TOKENIZER).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------


PROSE = "The board approved the plan in May, and sales of the group rose by 4.2 per cent over the year. It was the best result that we have had since the merger."


@pytest.mark.parametrize(
    ("text", "share"),
    [
        ("- net sales;\n- cash\n12. Cash balance", "item_share"),
        ("Overseas tariff income\nSegment debt", "item_share"),
        ("Cash balance ........ 7\nDebt . . . . . . 12", "item_share"),
        ("net sales, cash balance, order book, capital for ports", "item_share"),
        ("Cash\t5.6\t7\n| Loss | 5 | n.m. |\n|---|---|", "cell_share"),
        ('Debt,5,"5,210.9"\nRevenue      66.6    9,154.0', "cell_share"),
        (", ".join(["long row"] * 9) + "\t" + "\t".join(["7"] * 400), "cell_share"),
        ("xJ7k+/q9ZbbV2mW0sR4t8yTqLp3nKd5fGh6jCv1xBz=Aa\n" * 4, "odd_token_share"),
        (". ".join(["the same sentence stands here again"] * 9), "repeated_share"),
        ("<td class='c5'><span id='x'>ta</span></td><br/>", "markup_share"),
    ],
)
def test_shares_of_lines(text, share):
    values = dict(zip(STATISTICS, text_statistics(text)[2]))
    assert values[share] > 0.6 and all(0 <= v <= 1 for k, v in values.items() if k.endswith("_share"))


@pytest.mark.parametrize("text", [PROSE, PROSE.upper(), "- " + PROSE, "Results of the year\n" + PROSE, PROSE.replace(" the ", "\nthe "), "(a) " + PROSE + "\n(b) " + PROSE.replace("May", "June")])
def test_prose_has_hardly_any_shape(text):
    values = dict(zip(STATISTICS, text_statistics(text)[2]))
    assert all(values[s] < 0.5 for own in KINDS.values() for s in own) and values["common_word_share"] > 0.3


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/doc_labels.parquet")
    scored = score_quality(documents, labels)
    counts = Counter((r.label, r.kind) for r in scored.join(labels, "doc_id").select("label", "kind").collect())
    assert sum(n for (a, b), n in counts.items() if a == b) >= 0.9 * sum(counts.values())
    # The distance decides: with the cut out of reach nothing is an outlier, whatever its lines look like.
    assert score_quality(documents, labels, cut=1e9).where("kind <> 'prose' or outlier").count() == 0
    assert scored.where("(kind = 'prose') <> (not outlier)").count() == 0
    parts = scored.select(F.abs(F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, b: a + b) - F.col("distance") ** 2).alias("off"), F.col("distance") ** 2 + 1).collect()
    assert all(p[0] < 1e-6 * p[1] for p in parts)


def test_quality_edges(spark):
    documents = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 200_000), (3, "- x\n" * 50), (4, " \n ")], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id bigint, label string")
    got = score_quality(documents, labels).collect()
    assert len(got) == 5 and all(r.kind == "prose" and r.distance is None and not r.outlier for r in got)
    assert document_statistics(documents.limit(0)).count() == 0
    assert score_quality(documents, spark.createDataFrame([(1, "prose"), (2, "prose"), (9, "prose")], "doc_id bigint, label string")).count() == 5
