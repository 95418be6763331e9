from __future__ import annotations

import pytest

from quillseek import SearchError, match, parse_query
from quillseek.operators import extended, logical, objects, tokens
from quillseek.options import Options

DEFAULT = Options()


def terms(pattern):
    return [[(t.kind, t.value) for t in g] for g in extended.parse(pattern, DEFAULT)]


def test_operator_syntax():
    assert terms("^data py$ | rs$ | go$ ab$") == [[("prefix", "data"), ("suffix", "py")], [("suffix", "rs")], [("suffix", "go"), ("suffix", "ab")]]
    assert terms('="plain text"') == [[("exact", "plain text")]]
    assert terms('"od day"$') == [[("suffix", "od day")]]
    assert terms("'^good morning") == [[("include", "^good"), ("fuzzy", "morning")]]
    assert terms("!^foo$") == [[("not_prefix", "foo$")]]
    assert terms("!foo$ !bar") == [[("not_suffix", "foo"), ("not_include", "bar")]]
    assert terms(r"a\|b") == [[("fuzzy", "a|b")]]
    assert terms("a || b") == [[("fuzzy", "a")], [], [("fuzzy", "b")]]
    assert terms("=") == [[("fuzzy", "=")]] and terms("!") == [[("fuzzy", "!")]] and terms("'") == [[("fuzzy", "'")]]
    assert terms('="ask "why""') == [[("exact", 'ask "why"')]]
    assert terms('="a "b" c') == [[("exact", 'a "b'), ("fuzzy", "c")]]
    assert terms("ABC") == [[("fuzzy", "abc")]]
    assert terms("a\nb") == [[]]
    assert terms("a\tb") == [[("fuzzy", "a\tb")]]


def test_one_off_match_with_operators():
    assert match("^he wor$", "hello wor", use_extended_search=True)["is_match"]
    assert match("!x 'l", "hello", use_extended_search=True, include_matches=True) == {"is_match": True, "score": 0.0, "has_inverse": True, "indices": [(0, 4)]}
    assert match("a | b", "zzz", use_extended_search=True) == {"is_match": False, "score": 1.0}
    with pytest.raises(SearchError):
        match("a", "b", use_token_search=True)


def compiled(query):
    return [[(t.kind, t.value) for t in g] for g in objects.compile_field_query(query, "title", DEFAULT)]


def test_object_queries():
    assert compiled({"$contains": "A", "$not": {"$startsWith": "b"}}) == [[("include", "a"), ("not_prefix", "b")]]
    assert compiled({"$and": [{"$eq": "a"}, {"$endsWith": "b"}]}) == [[("exact", "a"), ("suffix", "b")]]
    assert compiled({"$or": [{"$fuzzy": "a"}, {"$and": [{"$eq": "b"}, {"$not": {"$endsWith": "c"}}]}]}) == [[("fuzzy", "a")], [("exact", "b"), ("not_suffix", "c")]]


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("x", "field query must be an object"),
        ({}, "empty query"),
        ({"$and": []}, "$and must be a non-empty array"),
        ({"$or": "a"}, "$or must be a non-empty array"),
        ({"$and": [{"$eq": "a"}], "$eq": "b"}, "operators cannot be mixed with $and/$or"),
        ({"$and": [{"$or": []}]}, "$or cannot be nested"),
        ({"$or": [{"$and": [{"$eq": "a"}], "$eq": "b"}]}, "$and cannot have siblings"),
        ({"$or": ["a"]}, "each clause must be an operator object"),
        ({"$not": "a"}, "$not must wrap an operator object"),
        ({"$not": {"$eq": "a", "$contains": "b"}}, "$not must wrap exactly one operator"),
        ({"$not": {"$not": {"$eq": "a"}}}, "$not cannot be nested"),
        ({"$not": {"$and": []}}, "$and cannot be used inside $not"),
        ({"$not": {"$eq": "a"}}, "'$eq' cannot be negated"),
        ({"$not": {"$what": "a"}}, "Unknown query operator '$what'"),
        ({"$what": "a"}, "Unknown query operator '$what'"),
        ({"$eq": 1}, "value for '$eq' must be a string"),
        ({"$eq": ""}, "Empty value for operator '$eq' on key 'title'"),
    ],
)
def test_wrong_object_queries(query, message):
    with pytest.raises(SearchError) as raised:
        objects.compile_field_query(query, "title", DEFAULT)
    assert message in str(raised.value)


def test_value_that_folds_to_nothing():
    with pytest.raises(SearchError, match="Empty value"):
        objects.compile_field_query({"$contains": "́"}, "title", Options(ignore_diacritics=True))


def test_logical_trees():
    assert parse_query({"title": "a"}) == {"operator": "$and", "children": [{"keyId": "title", "pattern": "a"}]}
    assert parse_query({"$or": ["x", {"a.b": "y", "c": {"$eq": "z"}}]}) == {
        "operator": "$or",
        "children": [{"keyId": None, "pattern": "x"}, {"operator": "$and", "children": [{"keyId": "a.b", "pattern": "y"}, {"keyId": "c", "fieldQuery": {"$eq": "z"}}]}],
    }
    nested = parse_query({"$and": [{"$path": ["a", "b.c"], "$val": "x"}]})
    assert nested["children"] == [{"keyId": "a.b.c", "pattern": "x"}]
    assert parse_query({"$and": []}) == {"operator": "$and", "children": []}
    both = logical.parse({"$or": [{"a": "x"}], "$and": [{"b": "y"}]})
    assert both.operator == "$or" and len(both.children) == 2


def test_wrong_logical_queries():
    for query in ({"a": 1}, {"$path": ["a"], "$val": "x"}, {"$and": [{"a": ["x"]}]}):
        with pytest.raises(SearchError, match="Invalid value for key"):
            parse_query(query)
    assert parse_query({"$and": [{"a": {"$what": "x"}}]}, auto=False)["children"][0]["fieldQuery"] == {"$what": "x"}
    with pytest.raises(SearchError, match="Unknown query operator"):
        parse_query({"$and": [{"a": {"$what": "x"}}]})
    with pytest.raises(SearchError):
        parse_query({"a": "x"}, use_token_search=True)


def test_tokens_of_queries():
    assert tokens.tokenize("Vue.js F# नमस्ते naïve", DEFAULT) == ["vue", "js", "f", "नमस्ते", "naïve"]
    assert tokens.tokenize("Vue.js F#", Options(tokenize=r"[\w.#]+")) == ["vue.js", "f#"]
    assert tokens.tokenize("a-b", Options(tokenize=lambda t: t.split("-"))) == ["a", "b"]
    with pytest.raises(TypeError):
        tokens.tokenize("a", Options(tokenize=lambda t: [1]))


def test_unknown_options():
    with pytest.raises(TypeError):
        match("a", "b", nonsense=1)
    with pytest.raises(ValueError):
        Options(token_match="some")
