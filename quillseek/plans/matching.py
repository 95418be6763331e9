"""Compiling a pattern to what it asks of each text, and running the kernel for all texts of a row at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillseek import errors
from quillseek.functions import text as tx
from quillseek.functions.kernel import FLOOR, Fuzzy, match_folded
from quillseek.operators import extended, tokens
from quillseek.operators.terms import RANGES, Term, fuzzy_of, merged
from quillseek.options import Options

#: What the kernel says about a text: matched, score, ranges.
HIT = f"struct<m: boolean, s: double, r: {RANGES}>"
_HIT = pa.struct([("m", pa.bool_()), ("s", pa.float64()), ("r", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


@dataclass
class Verdict:
    """Columns about one text.  inverse: whether the match came from a group with an inverse term.  terms: matched query words."""

    matched: Column
    score: Column
    inverse: Column | None = None
    terms: Column | None = None
    ranges: Column | None = None


class Searcher:
    """What a pattern asks of a text.

    `fuzzy` lists the patterns that the kernel has to match; `verdict` is given the folded text and the kernel's
    hits in that order.  `holds` is a condition on a folded text that every match satisfies, or None.
    """

    fuzzy: list[Fuzzy]
    n_terms: int | None = None
    has_inverse = False

    def verdict(self, folded: Column, hits: Sequence[Column]) -> Verdict:
        raise NotImplementedError

    def holds(self, folded: Column) -> Column | None:
        return None


def has_piece(spec: Fuzzy, folded: Column) -> Column | None:
    """Whether a folded text has a piece of the pattern, as every text that matches has; None if that can't be said."""
    pieces = spec.pieces()
    if pieces is None:
        return None
    some = F.lit(False)
    for p in pieces:
        some = some | F.contains(folded, F.lit(p))
    return some


class FuzzySearcher(Searcher):
    def __init__(self, pattern: str, options: Options):
        self.options = options
        self.fuzzy = [fuzzy_of(tx.fold(pattern, options.is_case_sensitive, options.ignore_diacritics), options)]

    def verdict(self, folded: Column, hits: Sequence[Column]) -> Verdict:
        (hit,) = hits
        return Verdict(hit["m"], hit["s"], ranges=hit["r"])

    def holds(self, folded: Column) -> Column | None:
        return has_piece(self.fuzzy[0], folded)


class GridSearcher(Searcher):
    """Groups of terms: the first group of which all hold decides."""

    def __init__(self, groups: list[list[Term]], options: Options):
        self.groups, self.options = [g for g in groups if g], options
        self.fuzzy = [t.fuzzy(options) for g in self.groups for t in g if not t.native]
        self.has_inverse = any(t.inverse for g in self.groups for t in g)

    def verdict(self, folded: Column, hits: Sequence[Column]) -> Verdict:
        left = list(hits)
        matched, score, inverse, ranges = F.lit(False), F.lit(1.0), F.lit(False), F.expr(f"cast(array() AS {RANGES})")
        found = []
        for group in self.groups:
            own = [(t, None if t.native else left.pop(0)) for t in group]
            holds = [t.holds(folded) if hit is None else hit["m"] for t, hit in own]
            whole = holds[0]
            for h in holds[1:]:
                whole = whole & h
            total = F.lit(0.0)
            for _, hit in own:
                total = total if hit is None else total + hit["s"]
            parts = [t.ranges(folded) if hit is None else hit["r"] for t, hit in own] if self.options.include_matches else []
            found.append((whole, total / float(len(group)), any(t.inverse for t in group), parts))
        for whole, mean, inverted, parts in reversed(found):
            matched = whole | matched
            score = F.when(whole, mean).otherwise(score)
            inverse = F.when(whole, F.lit(inverted)).otherwise(inverse)
            if parts:
                ranges = F.when(whole, merged(F.concat(*parts))).otherwise(ranges)
        return Verdict(matched, score, inverse if self.has_inverse else None, None, ranges)

    def holds(self, folded: Column) -> Column | None:
        some = None
        for group in self.groups:
            each = [t.holds(folded) if t.native else has_piece(t.fuzzy(self.options), folded) for t in group]
            known = [c for c in each if c is not None]
            if not known:
                return None
            whole = known[0]
            for c in known[1:]:
                whole = whole & c
            some = whole if some is None else some | whole
        return F.lit(False) if some is None else some


class TokenSearcher(Searcher):
    """Each word of the query, weighted by its rarity; a text's score is one less the share of weight that it matches."""

    def __init__(self, words: list[str], weights: list[float], options: Options):
        self.options, self.weights = options, weights
        self.fuzzy = [fuzzy_of(tx.fold(w, options.is_case_sensitive, options.ignore_diacritics), options, ignore_location=True) for w in words]
        self.n_terms = len(words)

    def verdict(self, folded: Column, hits: Sequence[Column]) -> Verdict:
        if not hits:
            return Verdict(F.lit(False), F.lit(1.0), terms=F.expr("cast(array() AS array<int>)"))
        # Summed term by term, in the order of the query.
        weighted, total = F.lit(0.0), 0.0
        for hit, weight in zip(hits, self.weights, strict=True):
            weighted = weighted + F.when(hit["m"], F.lit(weight) * (1 - hit["s"])).otherwise(0.0)
            total += weight
        matched = hits[0]["m"]
        for hit in hits[1:]:
            matched = matched | hit["m"]
        score = F.greatest(F.lit(FLOOR), 1 - weighted / total) if total > 0 else F.lit(FLOOR)
        terms = F.filter(F.array(*[F.when(hit["m"], F.lit(i)) for i, hit in enumerate(hits)]), lambda x: x.isNotNull())
        ranges = merged(F.concat(*[F.when(hit["m"], hit["r"]).otherwise(F.expr(f"cast(array() AS {RANGES})")) for hit in hits])) if self.options.include_matches else None
        return Verdict(matched, score, None, terms, ranges)

    def holds(self, folded: Column) -> Column | None:
        each = [has_piece(spec, folded) for spec in self.fuzzy]
        if any(c is None for c in each):
            return None
        some = F.lit(False)
        for c in each:
            some = some | c
        return some


_plugins: list[tuple[Callable[[str, Options], bool], Callable[[str, Options], Searcher]]] = []


def use(condition: Callable[[str, Options], bool], searcher: Callable[[str, Options], Searcher]) -> None:
    """Register a searcher of one's own for patterns and options that satisfy `condition`; earlier ones come first."""
    _plugins.append((condition, searcher))


def searcher_for(pattern: str, options: Options, statistics: Callable[[list[str]], tuple[int, dict[str, int]]] | None = None) -> Searcher:
    """The operator syntax comes before token search, both before what is registered, and fuzzy search is last.

    statistics: gives the number of texts and the frequencies of words, for token search.
    """
    if options.use_extended_search:
        return GridSearcher(extended.parse(pattern, options), options)
    if options.use_token_search:
        if statistics is None:
            raise errors.SearchError(errors.LOGICAL_TOKEN_SEARCH)
        words = tokens.tokenize(pattern, options)
        count, df = statistics(words) if words else (0, {})
        return TokenSearcher(words, [tokens.idf(count, df.get(w, 0)) for w in words], options)
    for condition, make in _plugins:
        if condition(pattern, options):
            return make(pattern, options)
    return FuzzySearcher(pattern, options)


def _hits(texts: list[str], spec: Fuzzy) -> pa.Array:
    matched, scores, ranges = match_folded(texts, spec)
    if not spec.include_matches:
        none = pa.array([None], pa.list_(_HIT.field("r").type.value_type)).take(pa.array(np.zeros(len(texts), np.int32)))
        return pa.StructArray.from_arrays([pa.array(matched), pa.array(scores), none], ["m", "s", "r"])
    starts = [a for r in ranges for a, _ in r]
    ends = [b for r in ranges for _, b in r]
    offsets = np.cumsum([0, *map(len, ranges)])
    pairs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
    return pa.StructArray.from_arrays([pa.array(matched), pa.array(scores), lists], ["m", "s", "r"])


def kernel(specs: Sequence[Sequence[Fuzzy]]) -> Callable[..., Column]:
    """A function of columns array<string>, each with the patterns to match there: a struct of arrays of hits, `c0t0` for the first
    column and its first pattern, and so on.

    Equal texts of a column's batch are matched once.  It is declared non-deterministic so that the optimizer doesn't
    evaluate it once for a filter and once more for the result.
    """
    names = [f"c{c}t{t}" for c, own in enumerate(specs) for t in range(len(own))]
    kind = "struct<" + ", ".join(f"{n}: array<{HIT}>" for n in names) + ">"

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for column, own in zip(columns, specs, strict=True):
            encoded = column.flatten().dictionary_encode()
            texts = encoded.dictionary.to_pylist()
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            out += [pa.ListArray.from_arrays(offsets, _hits(texts, spec).take(encoded.indices)) for spec in own]
        return pa.StructArray.from_arrays(out, names)

    return run.asNondeterministic()


@F.arrow_udf(T.ArrayType(T.StringType()))
def _strip_all(texts: pa.Array) -> pa.Array:
    """Distinct texts are stripped once, and only if they aren't ASCII."""
    encoded = texts.flatten().dictionary_encode()
    words = encoded.dictionary
    odd = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
    if not len(odd):
        return texts
    plain = words.to_pylist()
    for i in odd:
        plain[i] = tx.strip_diacritics(plain[i])
    lengths = texts.value_lengths()
    offsets = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))])
    missing = None if not texts.null_count else pa.array(texts.is_null().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(plain, pa.string()).take(encoded.indices), mask=missing)


def folded_texts(texts: Column, options: Options) -> Column:
    """The texts of a key (array of v, i, n) as they are compared."""
    plain = F.transform(texts, lambda x: x["v"] if options.is_case_sensitive else F.lower(x["v"]))
    return _strip_all(plain) if options.ignore_diacritics else plain


def reach_of(specs: Sequence[Fuzzy]) -> int | None:
    reaches = [s.reach() for s in specs]
    return None if None in reaches or not reaches else max(reaches)
