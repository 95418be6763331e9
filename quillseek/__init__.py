"""Approximate text search and relevance ranking on Spark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"

#: Where the public names are; they are loaded when they are first used, so that tasks load only what they run.
_HOMES = {
    "Collection": "plans.search",
    "Index": "sources.index",
    "Key": "sources.keys",
    "Options": "options",
    "SearchError": "errors",
    "Searcher": "plans.matching",
    "ShardedCollection": "plans.sharded",
    "Verdict": "plans.matching",
    "fuzzy_match": "plans.search",
    "match": "plans.search",
    "parse_query": "plans.search",
    "use": "plans.matching",
    "with_ordinals": "sources.index",
}

__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOMES[name]}"), name)
