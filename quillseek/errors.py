"""Errors of the public interface."""

from __future__ import annotations


class SearchError(ValueError):
    """Base of all errors that a wrong call or query raises."""


#: The messages of the error surface.
INCORRECT_INDEX_TYPE = "Incorrect 'index' type"
INVALID_DOC_INDEX = "Invalid doc index: must be a non-negative integer within the bounds of the docs array"
MATCH_TOKEN_SEARCH = "match() does not support token search: it needs statistics of a whole collection"
LOGICAL_TOKEN_SEARCH = "text leaves of a logical query can't use token search: it needs statistics of a whole collection"


def invalid_value_for_key(key) -> SearchError:
    return SearchError(f"Invalid value for key {key}")


def unknown_operator(op: str) -> SearchError:
    return SearchError(f"Unknown query operator '{op}'")


def empty_value(op: str, key: str) -> SearchError:
    return SearchError(f"Empty value for operator '{op}' on key '{key}'")


def invalid_field_query(key: str, reason: str) -> SearchError:
    return SearchError(f"Invalid field query for key '{key}': {reason}")


def missing_key_property(name: str) -> SearchError:
    return SearchError(f"Missing {name} property in key")


def invalid_weight(key: str) -> SearchError:
    return SearchError(f"Property 'weight' in key '{key}' must be a positive integer")


def missing_getter(key: str) -> SearchError:
    return SearchError(f"Key '{key}' was computed when its index was made; give its column or function again to add rows")
