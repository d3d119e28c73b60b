"""Every registered core query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from claimforge.plans import catalog
from support import same, views

WITHOUT_SQL = {"fact_candidates", "fact_candidates_recall", "stream_fact_candidates", "p7_found", "p7_quantities", "vector_index_recall"}


@pytest.fixture(scope="module")
def con(small):
    return views(small)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, small, con, name):
    same(catalog.queries()[name](spark, small), con, catalog.oracle_sql()[name])


def test_all_queries_have_sql_but_the_named():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_gives_rows(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_index_recall(spark, folder):
    for name in ("vector_index_recall", "fact_candidates_recall"):
        row = catalog.queries()[name](spark, folder).first()
        assert row.neighbours > 0 and row.found >= 0.9 * row.neighbours


def test_filters_reach_the_scan(spark, small, capsys):
    catalog.once(catalog.table(spark, small, "facts", "id", "document_id", "value").where("document_id = 'x'")).explain()
    assert "EqualTo(document_id,x)" in capsys.readouterr().out


def test_claims_are_normalized_before_they_are_paired(spark, small, capsys):
    catalog.queries()["reconcile_cascade"](spark, small).explain(extended=True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    joins = [depth(line) for line in plan.splitlines() if "Join" in line]
    assert all(depth(line) > min(joins) for line in plan.splitlines() if "regexp_replace" in line)
