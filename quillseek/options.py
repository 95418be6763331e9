"""All options of a search, with their defaults."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Options:
    """What to search and how.

    keys: columns or paths to search (see `Key`); none for a single column of strings.
    sort: columns to order results by, with the ordinal as the last resort; None orders by score.
    tokenize: a regular expression for tokens, or a function from a string to a list of strings.
    """

    is_case_sensitive: bool = False
    ignore_diacritics: bool = False
    include_score: bool = False
    include_matches: bool = False
    keys: Sequence[Any] = field(default_factory=tuple)
    should_sort: bool = True
    sort: Sequence[Any] | None = None
    find_all_matches: bool = False
    min_match_char_length: int = 1
    location: int = 0
    threshold: float = 0.6
    distance: int = 100
    use_extended_search: bool = False
    use_token_search: bool = False
    tokenize: str | Callable[[str], list[str]] | None = None
    token_match: str = "any"
    get: Callable[[Any, list[str]], Any] | None = None
    ignore_location: bool = False
    ignore_field_norm: bool = False
    field_norm_weight: float = 1.0

    def __post_init__(self):
        if self.token_match not in ("any", "all"):
            raise ValueError("token_match must be 'any' or 'all'")

    def with_(self, **changes) -> Options:
        return replace(self, **changes)


def options_of(given: Options | None, changes: dict[str, Any]) -> Options:
    known = {f.name for f in fields(Options)}
    if wrong := set(changes) - known:
        raise TypeError(f"unknown options: {', '.join(sorted(wrong))}")
    return (given or Options()).with_(**changes)
