"""The shape of plans: what is pushed down, and how often the kernel runs."""

from __future__ import annotations

import pytest

from quillseek import Collection
from quillseek.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def part(spark):
    return catalogue.docs(spark, SF, "part")


def test_kernel_runs_once(part):
    for query, options in (("smal rng", {}), ("^small rng", {"use_extended_search": True}), ("smal rng", {"use_token_search": True}), ({"$and": ["smal", {"p_type": "promo"}]}, {})):
        text = plan(Collection.of(part, keys=["p_name", "p_type"], include_score=True, include_matches=True, **options).search(query, 10))
        assert text.count("ArrowEvalPython") == 1


def test_native_queries_run_no_python(part):
    text = plan(Collection.of(part, keys=["p_name", "p_type"], use_extended_search=True, include_score=True, include_matches=True).search("'wid !^x", 5))
    assert "Python" not in text and "TakeOrderedAndProject" in text and "Exchange" not in text


def test_case_sensitive_operators_reach_the_scan(part):
    text = plan(Collection.of(part, keys=["p_brand"], use_extended_search=True, is_case_sensitive=True).matches("^Brand#1 'nd#1 !ZZ"))
    assert "StringStartsWith(p_brand,Brand#1)" in text and "StringContains(p_brand,nd#1)" in text


def test_logical_queries_reach_the_scan(part):
    one = Collection.of(part, keys=["p_name", "p_type"], is_case_sensitive=True)
    text = plan(one.matches({"$and": [{"p_type": {"$eq": "PROMO"}}, {"$or": [{"p_name": {"$startsWith": "old"}}, {"p_name": {"$contains": "ring"}}]}]}))
    assert "EqualTo(p_type,PROMO)" in text and "Or(StringStartsWith(p_name,old),StringContains(p_name," in text
    text = plan(one.matches({"$and": [{"p_type": {"$eq": "PROMO"}}, {"p_name": "rng"}]}))
    assert "EqualTo(p_type,PROMO)" in text and "PushedFilters" in text


def test_only_searched_columns_are_read(part):
    text = plan(Collection.of(part, keys=["p_name"], include_score=True).matches("smal rng").select("ref_index", "score"))
    schema = text.partition("ReadSchema: ")[2].partition("\n")[0]
    assert "p_brand" not in schema and "p_name" in schema


def test_no_shuffle_between_scan_and_top_k(part):
    text = plan(Collection.of(part, keys=["p_name", "p_type"], include_score=True).search("smal rng", 10))
    assert "TakeOrderedAndProject" in text and "hashpartitioning" not in text and "rangepartitioning" not in text
