"""The operator syntax: terms with prefixes and suffixes, separated by spaces (all must hold) and by | (some group must)."""

from __future__ import annotations

import re

from quillseek.functions.text import TRIMMED, fold, trim
from quillseek.operators.terms import Term
from quillseek.options import Options

#: Kind, prefix and suffix of each operator, in order of precedence.
SYNTAX = (
    ("exact", "=", ""),
    ("include", "'", ""),
    ("prefix", "^", ""),
    ("not_prefix", "!^", ""),
    ("not_suffix", "!", "$"),
    ("suffix", "", "$"),
    ("not_include", "!", ""),
    ("fuzzy", "", ""),
)

#: A token with a quoted part ends at a quote, or at a quote and $, before a space or the end.
_TOKEN = re.compile(r'[^ "]*"(?:.*?"\$?(?= |\Z)|.*)|[^ ]+', re.DOTALL)
_OR = re.compile(r"(?<!\\)\|")
_LINE_END = re.compile("[\n\r\u2028\u2029]")


def _body(token: str, prefix: str, suffix: str, quoted: bool) -> str:
    """What an operator's prefix and suffix enclose; empty if they don't."""
    if quoted:
        prefix, suffix = prefix + '"', '"' + suffix
    if len(token) < len(prefix) + len(suffix) or not (token.startswith(prefix) and token.endswith(suffix)):
        return ""
    body = token[len(prefix) : len(token) - len(suffix)]
    return "" if _LINE_END.search(body) else body


def parse_term(token: str) -> Term | None:
    """The first operator that encloses something, quoted forms first; None if there is none."""
    for quoted in (True, False):
        for kind, prefix, suffix in SYNTAX:
            if body := _body(token, prefix, suffix, quoted):
                return Term(kind, body)
    return None


def parse_folded(pattern: str) -> list[list[Term]]:
    """Groups of terms; a text matches if it satisfies all terms of a group that has any."""
    groups = []
    for group in _OR.split(pattern):
        tokens = _TOKEN.findall(trim(group.replace(r"\|", "|")))
        terms = [parse_term(t) for t in tokens if re.search(f"[^{TRIMMED}]", t)]
        groups.append([t for t in terms if t is not None])
    return groups


def parse(pattern: str, options: Options) -> list[list[Term]]:
    return parse_folded(fold(pattern, options.is_case_sensitive, options.ignore_diacritics))
