"""Registered queries of the subpackage on the smallest tables."""

import re
from collections import defaultdict

import pytest

from claimforge.llm import queries as Q
from support import same, views

SMALL = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": ["fact_id", "field", "term_id"], "p2_found": ["name_a", "name_b"], "p3_found": ["first_id", "copy_id"], "p4_found": ["chunk_id"], "p5_found": ["src", "row_id"], "p6_found": ["group_id", "fact_id"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind"]}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_runs(spark, name):
    df = Q.queries()[name](spark, SMALL)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
    assert df.count() >= (name not in ("p8_found", "p8_leaks", "p8_items"))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(Q.queries()[name](spark, SMALL), views(SMALL), Q.oracle_sql()[name])


def test_copies_against_brute_force(spark):
    word = re.compile(r"[^\W_]+(?:(?<=\d)\.(?=\d)[^\W_]+)*")
    signed = re.compile(r"[₹$%]|(?<![^\W_])-(?=\d)|" + word.pattern)
    bare = lambda s: re.sub(r"(?<=\d),(?=(?:\d{2,3},)*\d{3}(?!\d))", "", (s or "").lower())
    groups = defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/facts.parquet").collect():
        groups[tuple(word.findall(bare(r.entity))), tuple(word.findall(bare(r.attribute))), tuple(sorted(signed.findall(bare(r.canonical_statement))))].add(r.id)
    assert {tuple(r) for r in Q.p3_found(spark, SMALL).collect()} == {(min(g), x) for g in groups.values() for x in g - {min(g)}}


def test_groups_against_brute_force(spark):
    facts = {r.id for r in spark.read.parquet(f"{SMALL}/facts.parquet").select("id").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in spark.read.parquet(f"{SMALL}/relationships.parquet").collect():
        kind = re.sub("[^a-z]", "", r.relation_type.lower().replace("relationtype.", ""))
        if kind in ("corroborates", "reconciled") and r.fact_a_id != r.fact_b_id and {r.fact_a_id, r.fact_b_id} <= facts:
            a, b = find(r.fact_a_id), find(r.fact_b_id)
            parent[max(a, b)] = min(a, b)
    assert {tuple(r) for r in Q.p6_found(spark, SMALL).collect()} == {(find(x), x) for x in parent if find(x) != x}
