"""Object queries: what one key must satisfy, as nested dicts."""

from __future__ import annotations

from quillseek import errors
from quillseek.functions.text import fold
from quillseek.operators.terms import Term
from quillseek.options import Options

#: Fixed values, here and in the messages below: the names of operators and the reasons given for wrong queries.
AND, OR, NOT = "$and", "$or", "$not"
KINDS = {"$fuzzy": "fuzzy", "$eq": "exact", "$contains": "include", "$startsWith": "prefix", "$endsWith": "suffix"}
NEGATED = {"$contains": "not_include", "$startsWith": "not_prefix", "$endsWith": "not_suffix"}


class _Compiler:
    def __init__(self, key: str, options: Options):
        self.key, self.options = key, options

    def wrong(self, reason: str) -> errors.SearchError:
        return errors.invalid_field_query(self.key, reason)

    def _negated(self, wrapped) -> tuple[str, str, object]:
        if not isinstance(wrapped, dict):
            raise self.wrong("$not must wrap an operator object")
        if len(wrapped) != 1:
            raise self.wrong("$not must wrap exactly one operator")
        ((op, value),) = wrapped.items()
        if op == NOT:
            raise self.wrong("$not cannot be nested")
        if op in (AND, OR):
            raise self.wrong(f"{op} cannot be used inside $not")
        if op not in KINDS:
            raise errors.unknown_operator(op)
        if op not in NEGATED:
            raise self.wrong(f"'{op}' cannot be negated")
        return NEGATED[op], op, value

    def clause(self, given) -> list[Term]:
        """An object of operators, all of which must hold."""
        if not isinstance(given, dict):
            raise self.wrong("each clause must be an operator object")
        if not given:
            raise self.wrong("empty query")
        terms = []
        for op, value in given.items():
            if op in (AND, OR):
                raise self.wrong(f"{op} cannot be nested")
            if op == NOT:
                kind, op, value = self._negated(value)
            elif op in KINDS:
                kind = KINDS[op]
            else:
                raise errors.unknown_operator(op)
            if not isinstance(value, str):
                raise self.wrong(f"value for '{op}' must be a string")
            value = fold(value, self.options.is_case_sensitive, self.options.ignore_diacritics)
            if not value:
                raise errors.empty_value(op, self.key)
            terms.append(Term(kind, value))
        return terms

    def _members(self, given, op: str) -> list:
        if not isinstance(given, (list, tuple)) or not given:
            raise self.wrong(f"{op} must be a non-empty array")
        return list(given)

    def all_of(self, given) -> list[Term]:
        return [t for member in self._members(given, AND) for t in self.clause(member)]

    def some_of(self, given) -> list[list[Term]]:
        groups = []
        for member in self._members(given, OR):
            if isinstance(member, dict) and AND in member:
                if len(member) > 1:
                    raise self.wrong("$and cannot have siblings")
                groups.append(self.all_of(member[AND]))
            else:
                groups.append(self.clause(member))
        return groups

    def query(self, given) -> list[list[Term]]:
        if not isinstance(given, dict):
            raise self.wrong("field query must be an object")
        if not given:
            raise self.wrong("empty query")
        if AND not in given and OR not in given:
            return [self.clause(given)]
        if len(given) > 1:
            raise self.wrong("operators cannot be mixed with $and/$or")
        return [self.all_of(given[AND])] if AND in given else self.some_of(given[OR])


def compile_field_query(given, key: str, options: Options) -> list[list[Term]]:
    return _Compiler(key, options).query(given)
