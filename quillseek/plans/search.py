"""Collections that can be searched.

A search is one pass over the records: texts are folded and, where the query is approximate, matched by the kernel;
what matched is an array in the record's own row; scores are products over that array; the best records are taken by
a sort with a limit.  Nothing is shuffled but the result's order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cmp_to_key, reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillseek import errors
from quillseek.functions import text as tx
from quillseek.functions.kernel import match_folded
from quillseek.operators import extended, logical, objects, tokens
from quillseek.operators.terms import RANGES
from quillseek.options import Options, options_of
from quillseek.plans.matching import (
    FuzzySearcher,
    GridSearcher,
    Searcher,
    folded_texts,
    kernel,
    reach_of,
    searcher_for,
)
from quillseek.sources.index import ORDINAL, Index, scratch_path
from quillseek.sources.keys import Key, normalised, parse_keys

#: The base of an exact match's score where a key has a weight.
EPSILON = 2.0**-52
#: Bytes, by the optimizer's estimate, up to which a table is dealt out to all cores before the kernel.
SMALL_TABLE = 128 << 20
MATCH = f"array<struct<indices: {RANGES}, key: string, ref_index: int, value: string>>"


@dataclass(frozen=True)
class _Part:
    """A searcher, the key it is asked about (None: all), the number of that scope, and where its patterns' hits are in it."""

    searcher: Searcher
    key: int | None = None
    scope: int = 0
    first_hit: int = 0


@dataclass(frozen=True)
class Collection:
    """Documents with a `ref_index`, the options of their search, and their index.

    Collections don't change: `add`, `remove`, `remove_at` and `set_collection` return new ones.
    """

    index: Index
    options: Options

    @classmethod
    def of(cls, docs: DataFrame, options: Options | None = None, index: Index | None = None, **changes) -> Collection:
        chosen = options_of(options, changes)
        if index is not None and not isinstance(index, Index):
            raise errors.SearchError(errors.INCORRECT_INDEX_TYPE)
        return cls(index or Index.create(chosen.keys, docs, chosen.get, chosen.field_norm_weight), chosen)

    # -- the collection ---------------------------------------------------------------------------------------

    def get_index(self) -> Index:
        return self.index

    def set_collection(self, docs: DataFrame, index: Index | None = None) -> Collection:
        return Collection.of(docs, self.options, index)

    def add(self, docs: DataFrame | None) -> Collection:
        if docs is None:
            return self
        more = self.index.added(docs)
        return self._counted(self.index.with_all(more), more.frame, 1)

    def remove(self, predicate: Column | Callable[[dict, int], bool] | None = None) -> tuple[Collection, DataFrame]:
        """The collection without the records for which predicate holds, and those records.

        predicate: a column on `item` and `ref_index`, or a function of a record, as a dict, and its ordinal.
        """
        if predicate is None:
            return self, self.index.frame.limit(0).select("item.*")
        kept, gone = self.index.remove_where(predicate)
        return self._counted(kept, self.index.removed(predicate)[1], -1), gone

    def remove_at(self, ordinal: int) -> tuple[Collection, DataFrame]:
        self.index.check_ordinal(ordinal)
        gone = self.index.frame.where(F.col(ORDINAL) == ordinal)
        return self._counted(self.index.remove_at(ordinal), gone, -1), gone.select("item.*")

    def with_statistics(self) -> Collection:
        """The same with the frequencies of words stored in its index, so that token searches don't count them each time.

        `add`, `remove` and `remove_at` then count only the records that come or go.
        """
        key = tokens.signature(self.options)
        if key is None:
            raise ValueError("frequencies can't be stored for a tokenize function")
        words = _stored(tokens.word_table(self.folded_fields(), self.options), "words")
        return replace(self, index=replace(self.index, words=words, words_of=key))

    def _counted(self, index: Index, changed: DataFrame, sign: int) -> Collection:
        """A collection with this index and, where frequencies are stored, those of the changed records added or taken away."""
        known = self.index.words_of
        if known is None or known != tokens.signature(self.options):
            return replace(self, index=index)
        part = tokens.word_table(replace(self, index=replace(index, frame=changed)).folded_fields(), self.options)
        words = _stored(tokens.combined(self.index.words, part, sign), "words")
        return replace(self, index=replace(index, words=words, words_of=known))

    # -- searching --------------------------------------------------------------------------------------------

    def search(self, query: str | dict, limit: int = -1) -> DataFrame:
        """item, ref_index and, if the options say so, score and matches, best first."""
        if isinstance(query, str) and tx.is_blank(query):
            every = self.index.frame.select("item", ORDINAL).orderBy(ORDINAL)
            return every.limit(limit) if limit > -1 else every
        found = self.matches(query)
        columns = ["item", ORDINAL]
        if self.options.include_score:
            columns.append("score")
        if self.options.include_matches:
            columns.append("matches")
        if not self.options.should_sort:
            found = found.orderBy(ORDINAL)
        elif self.options.sort is not None:
            found = found.orderBy(*self.options.sort, ORDINAL)
        else:
            found = found.orderBy("score", ORDINAL)
        return (found.limit(limit) if limit > -1 else found).select(*columns)

    def search_sorted(self, query: str | dict, compare: Callable[[Row, Row], float], limit: int = -1) -> list[Row]:
        """The results in the order of a comparison of two of them, ties by ordinal.  All results come to the driver; where they can be
        ordered by columns, `sort` keeps them where they are."""
        both = self.options.with_(include_score=True, should_sort=False)
        found = sorted(replace(self, options=both).search(query).collect(), key=cmp_to_key(lambda a, b: compare(a, b) or 0))
        return found[:limit] if limit > -1 else found

    def search_all(self, queries: Sequence[str], limit: int = -1) -> DataFrame:
        """Several text queries in one pass over the records: query (its place), item, ref_index, score and, if wanted, matches; with a limit
        the best so many of each query."""
        asked = [(n, q) for n, q in enumerate(queries) if not tx.is_blank(q)]
        searchers = [searcher_for(q, self.options, self.statistics) for _, q in asked]
        parts, before = [], 0
        for searcher in searchers:
            parts.append(_Part(searcher, first_hit=before))
            before += len(searcher.fuzzy)
        if not parts:
            raise ValueError("no query has a text to search for")

        def can_match(scopes: dict[int, Sequence[int]]) -> Column | None:
            return _any_of([self._some_text(p.searcher, scopes[0]) for p in parts])

        rows = self._with_hits(self.index, parts, can_match)
        conditions = [self._conditions(s) for s in searchers]
        # Each query's matches are filtered by its own conditions, in an array of one element.
        each = [f"transform(filter(array(q{i}), f -> {' AND '.join(['size(f) > 0', *c])}), f -> struct({n} AS query, f AS found))" for i, ((n, _), c) in enumerate(zip(asked, conditions, strict=True))]
        arrays = rows.select("item", ORDINAL, *[self._comparable(p).alias(f"q{i}") for i, p in enumerate(parts)])
        found = arrays.select("item", ORDINAL, F.expr(f"explode(concat({', '.join(each)}))").alias("hit")).select("item", ORDINAL, "hit.query", "hit.found")
        scored = self._with_scores(found, "query")
        if limit > -1:
            best = Window.partitionBy("query").orderBy("score", ORDINAL)
            scored = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).drop("place")
        return scored

    def _comparable(self, part: _Part) -> Column:
        """What a searcher finds, with the same fields for all searchers."""
        found = self._found(part)
        if part.searcher.n_terms is not None:
            return found
        return F.transform(found, lambda x: x.withField("terms", F.expr("cast(array() AS array<int>)")))

    def matches(self, query: str | dict, statistics: Collection | None = None) -> DataFrame:
        """All records that match, in no order: item, ref_index, score and, if wanted, matches.

        statistics: a collection to take the frequencies of words from, instead of this one.
        """
        if isinstance(query, str):
            return self._text_query(query, statistics or self)
        return self._logical_query(query)

    def statistics(self, words: Sequence[str]) -> tuple[int, dict[str, int]]:
        """How many texts have tokens, and in how many each word is."""
        if self.index.words_of is not None and self.index.words_of == tokens.signature(self.options):
            return tokens.looked_up(self.index.words, list(words))
        return tokens.statistics(self.folded_fields(), list(words), self.options)

    def folded_fields(self) -> DataFrame:
        """f: every text of every record as it is compared."""
        arrays = [folded_texts(F.col(f"k{i}"), self.options).alias(f"g{i}") for i in range(self.index.width)]
        texts = _spread(self.index.frame.select(*[f"k{i}" for i in range(self.index.width)]))
        return texts.select(*arrays).select(F.explode(F.concat(*[f"g{i}" for i in range(self.index.width)])).alias("f"))

    def document_frequency(self) -> DataFrame:
        return tokens.document_frequency(self.folded_fields(), self.options)

    def field_count(self) -> DataFrame:
        return tokens.field_count(self.folded_fields(), self.options)

    def _keys(self) -> list[Key | None]:
        """The index's keys with the options' weights; a key that the options lack keeps its own."""
        if self.index.strings:
            return [None]
        own = {k.id: k for k in normalised(parse_keys(self.options.keys))} if self.options.keys else {}
        return [replace(k, weight=own[k.id].weight) if k.id in own else k for k in self.index.keys]

    def _text_query(self, query: str, corpus: Collection) -> DataFrame:
        searcher = searcher_for(query, self.options, corpus.statistics)
        index = self._narrowed(lambda columns: _any_of([self._condition(searcher, c) for c in columns]))
        part = _Part(searcher)
        rows = self._with_hits(index, [part], lambda scopes: self._some_text(searcher, scopes[0]))
        rows = rows.select("item", ORDINAL, self._found(part).alias("found"))
        return self._scored(rows, self._conditions(searcher))

    def _conditions(self, searcher: Searcher) -> list[str]:
        """What a record's matches (f) must satisfy beyond being there."""
        conditions = []
        if searcher.has_inverse and not self.index.strings:
            # An inverse term asks something of all keys; the first match of a key says whether it has one.
            inverse = "exists(transform(f, (x, i) -> x.inverse AND (i = 0 OR f[i - 1].key != x.key)), y -> y)"
            conditions.append(f"(NOT {inverse} OR size(array_distinct(transform(f, x -> x.key))) = {len(self.index.keys)})")
        if searcher.n_terms is not None and self.options.token_match == "all":
            conditions.append(f"size(array_distinct(flatten(transform(f, x -> x.terms)))) = {searcher.n_terms}")
        return conditions

    def _logical_query(self, query: dict) -> DataFrame:
        tree = logical.parse(query)
        leaves = logical.leaves(tree)
        searchers = [self._leaf_searcher(leaf) for leaf in leaves]
        if self.index.strings or not leaves:
            nothing = self.index.frame.select("item", ORDINAL, F.lit(0.0).alias("score"), F.expr(f"cast(array() AS {MATCH})").alias("matches")).limit(0)
            return nothing if self.options.include_matches else nothing.drop("matches")
        place = {k.id: i for i, k in enumerate(self.index.keys)}
        conditions, parts = iter(zip(leaves, searchers, strict=True)), []
        for leaf, searcher in zip(leaves, searchers, strict=True):
            key = None if leaf.key is None else place.get(leaf.key, -1)
            before = [p for p in parts if p.key == key]
            scope = before[0].scope if before else len({p.scope for p in parts})
            parts.append(_Part(searcher, key, scope, sum(len(p.searcher.fuzzy) for p in before)))

        parts_left = iter(parts)

        def can_match(scopes: dict[int, Sequence[int]]) -> Column | None:
            def one(_: logical.Leaf) -> Column | None:
                part = next(parts_left)
                return self._some_text(part.searcher, scopes[part.scope])

            return logical.fold_tree(tree, one, _all_of, _any_of)

        def narrow(plain: list[Column | None]) -> Column | None:
            def one(_: logical.Leaf) -> Column | None:
                leaf, searcher = next(conditions)
                if leaf.key is None:
                    return _any_of([self._condition(searcher, c) for c in plain])
                return self._condition(searcher, plain[place[leaf.key]]) if leaf.key in place else F.lit(False)

            return logical.fold_tree(tree, one, _all_of, _any_of)

        rows = self._with_hits(self._narrowed(narrow), parts, can_match)
        rows = rows.select("item", ORDINAL, *[self._found(part).alias(f"l{n}") for n, part in enumerate(parts)])
        names = iter([f"l{n}" for n in range(len(leaves))])
        empty = "filter(l0, x -> false)"

        def all_of(children: list[str]) -> str:
            if not children:
                return empty
            whole = " AND ".join(f"size({c}) > 0" for c in children)
            return f"CASE WHEN {whole} THEN concat({', '.join(children)}) ELSE {empty} END"

        pooled = logical.fold_tree(tree, lambda _: next(names), all_of, lambda children: f"concat({', '.join(children)})" if children else empty)
        return self._scored(rows.select("item", ORDINAL, F.expr(pooled).alias("found")))

    def _leaf_searcher(self, leaf: logical.Leaf) -> Searcher:
        if isinstance(leaf.query, str):
            return searcher_for(leaf.query, self.options)
        return GridSearcher(objects.compile_field_query(leaf.query, leaf.key, self.options), self.options)

    def _condition(self, searcher: Searcher, column: Column | None) -> Column | None:
        """What a plain column's text must satisfy for the searcher to match it; None if that can't be said."""
        if column is None or self.options.ignore_diacritics:
            return None
        return searcher.holds(column if self.options.is_case_sensitive else F.lower(column))

    def _narrowed(self, condition_of: Callable[[list[Column | None]], Column | None]) -> Index:
        """The index without rows of which the source's columns say that they can't match."""
        plain = self.index.plain_columns()
        condition = condition_of(plain) if any(c is not None for c in plain) else None
        return self.index if condition is None else self.index.where(condition)

    def _some_text(self, searcher: Searcher, keys: Sequence[int]) -> Column | None:
        """Whether one of the keys has a text that the searcher may match; None if that can't be said."""
        if searcher.holds(F.lit("")) is None:
            return None
        folded = (lambda x: x["v"]) if self.options.is_case_sensitive else (lambda x: F.lower(x["v"]))
        return _any_of([F.exists(f"k{i}", lambda x: F.coalesce(searcher.holds(folded(x)), F.lit(False))) for i in keys])

    def _with_hits(self, index: Index, parts: Sequence[_Part], can_match: Callable[[dict[int, Sequence[int]]], Column | None] | None = None) -> DataFrame:
        """The records, of those of which `can_match` says so from the keys of each scope, with the texts of each scope (t0, t1, ...: v, i, n and the key's number), the same as they are compared (g0, ...)
        and the kernel's hits (h)."""
        scopes = {p.scope: p.key for p in parts}
        texts, keys_of = [], {}
        for scope, key in scopes.items():
            own = keys_of[scope] = range(index.width) if key is None else [key] if key >= 0 else []
            each = [f"transform(k{i}, x -> struct(x.v AS v, x.i AS i, x.n AS n, {i} AS key))" for i in own]
            all_texts = f"concat({', '.join(each)})" if each else "cast(array() AS array<struct<v: string, i: int, n: double, key: int>>)"
            texts.append(F.expr(all_texts).alias(f"t{scope}"))
        records, specs = index.records(), {c: [spec for p in parts if p.scope == c for spec in p.searcher.fuzzy] for c in scopes}
        if can_match is not None and any(specs.values()) and not self.options.ignore_diacritics:  # folding would run in Python twice
            condition = can_match(keys_of)
            records = records if condition is None else records.where(condition)
        rows = records.select("item", ORDINAL, *texts)
        rows = rows.select("*", *[folded_texts(F.col(f"t{c}"), self.options).alias(f"g{c}") for c in scopes])
        if not any(specs.values()):
            return rows
        reach = {c: reach_of(own) for c, own in specs.items()}
        shown = [F.col(f"g{c}") if r is None else F.expr(f"transform(g{c}, x -> substring(x, 1, {r}))") for c, r in reach.items()]
        return _spread(rows).withColumn("h", kernel(list(specs.values()))(*shown))

    def _found(self, part: _Part) -> Column:
        """What a searcher finds in the texts of its scope: an array of matches with what their scores and reports need."""
        options, searcher, keys = self.options, part.searcher, self._keys()
        keyed = not self.index.strings
        weights = F.expr(f"array({', '.join(f'{k.weight!r}D' for k in keys)})") if keyed and keys else None
        ids = F.array(*[F.lit(k.id) for k in keys]) if keyed and keys else F.array(F.lit(None).cast("string"))
        hits_of = [F.col("h")[f"c{part.scope}t{part.first_hit + t}"] for t in range(len(searcher.fuzzy))]

        def one(x: Column, i: Column) -> Column:
            v = searcher.verdict(F.get(F.col(f"g{part.scope}"), i), [F.get(h, i) for h in hits_of])
            exponent = F.lit(1.0) if options.ignore_field_norm else x["n"]
            if weights is not None:
                exponent = F.get(weights, x["key"]) * exponent
            base = F.when(v.score == 0, F.lit(EPSILON)).otherwise(v.score) if keyed else v.score
            fields = [v.matched.alias("matched"), F.pow(base, exponent).alias("factor"), x["key"].alias("key")]
            fields.append((F.lit(False) if v.inverse is None else v.inverse).alias("inverse"))
            if searcher.n_terms is not None:
                fields.append(v.terms.alias("terms"))
            if options.include_matches:
                report = F.struct(v.ranges.alias("indices"), F.get(ids, x["key"]).alias("key"), x["i"].alias("ref_index"), x["v"].alias("value"))
                fields.append(report.alias("report"))
            return F.struct(*fields)

        return F.filter(F.transform(f"t{part.scope}", one), lambda x: F.coalesce(x["matched"], F.lit(False)))

    def _scored(self, rows: DataFrame, conditions: Sequence[str] = ()) -> DataFrame:
        """Scores, as products in the order of keys and array elements, of the records with matches that satisfy conditions on them (f).

        The conditions are part of a generator, so that the matches are computed once and not once for each mention.
        """
        kept = " AND ".join(["size(f) > 0", *conditions])
        rows = rows.select("item", ORDINAL, F.expr(f"explode(filter(array(found), f -> {kept}))").alias("found"))
        return self._with_scores(rows)

    def _with_scores(self, rows: DataFrame, *more: str) -> DataFrame:
        score = F.expr("aggregate(found, 1D, (acc, x) -> acc * x.factor)").alias("score")
        if not self.options.include_matches:
            return rows.select(*more, "item", ORDINAL, score)
        reports = F.expr("filter(transform(found, x -> x.report), r -> size(r.indices) > 0)")
        return rows.select(*more, "item", ORDINAL, score, reports.alias("matches"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """df, written below the shared folder and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _any_of(conditions: list[Column | None]) -> Column | None:
    """A disjunction; unknown if one of the conditions is."""
    if any(c is None for c in conditions):
        return None
    return reduce(lambda a, b: a | b, conditions, F.lit(False)) if conditions else F.lit(False)


def _all_of(conditions: list[Column | None]) -> Column | None:
    """A conjunction of those conditions that are known; false if there are none at all."""
    known = [c for c in conditions if c is not None]
    if not conditions:
        return F.lit(False)
    return reduce(lambda a, b: a & b, known) if known else None


def _spread(rows: DataFrame) -> DataFrame:
    """A small table is often one partition, which would keep the kernel on one core; larger ones stay as they are read.

    Both the number of partitions, where the plan knows it (0: it doesn't), and the size are the optimizer's; nothing runs.
    """
    if rows.isStreaming:
        return rows
    query, cores = rows._jdf.queryExecution(), rows.sparkSession.sparkContext.defaultParallelism
    known = query.executedPlan().outputPartitioning().numPartitions()
    if known * 2 > cores or int(str(query.optimizedPlan().stats().sizeInBytes())) > SMALL_TABLE:
        return rows
    return rows.repartition(cores)


def fuzzy_match(column: Column, pattern: str, options: Options | None = None, **changes) -> Column:
    """struct of m (matched), s (score) and r (ranges) for one column and one pattern, without keys, norms and weights."""
    chosen = options_of(options, changes)
    if chosen.use_token_search and not chosen.use_extended_search:
        raise errors.SearchError(errors.MATCH_TOKEN_SEARCH)

    searcher = GridSearcher(extended.parse(pattern, chosen), chosen) if chosen.use_extended_search else FuzzySearcher(pattern, chosen)
    folded = folded_texts(F.array(F.struct(column.alias("v"))), chosen)
    names = [f"c0t{t}" for t in range(len(searcher.fuzzy))]
    hits = kernel([searcher.fuzzy])(folded) if names else F.lit(0)

    def judged(known: Column) -> Column:
        text = F.get(known["folded"], F.lit(0))
        v = searcher.verdict(text, [F.get(known["hits"][n], F.lit(0)) for n in names])
        return F.when(text.isNotNull(), F.struct(v.matched.alias("m"), v.score.cast("double").alias("s"), v.ranges.alias("r")))

    # The kernel's result is an element that a function is applied to, so that it is computed once.
    return F.get(F.transform(F.array(F.struct(folded.alias("folded"), hits.alias("hits"))), judged), F.lit(0))


def match(pattern: str, text: str, options: Options | None = None, **changes) -> dict:
    """One pattern against one text: is_match, score and, if wanted, indices."""
    chosen = options_of(options, changes)
    if chosen.use_token_search and not chosen.use_extended_search:
        raise errors.SearchError(errors.MATCH_TOKEN_SEARCH)
    folded = tx.fold(text, chosen.is_case_sensitive, chosen.ignore_diacritics)
    if chosen.use_extended_search:
        return _match_grid(extended.parse(pattern, chosen), folded, chosen)
    (spec,) = FuzzySearcher(pattern, chosen).fuzzy
    matched, scores, ranges = match_folded([folded], spec)
    out = {"is_match": bool(matched[0]), "score": float(scores[0])}
    if chosen.include_matches and matched[0]:
        out["indices"] = ranges[0]
    return out


def _match_grid(groups, folded: str, options: Options) -> dict:
    from quillseek.functions.kernel import merge_ranges, units

    text = units(folded)
    for group in groups:
        total, found, ok = 0.0, [], bool(group)
        for term in group:
            value, kind = units(term.value), term.kind.removeprefix("not_")
            if kind == "fuzzy":
                matched, scores, ranges = match_folded([folded], term.fuzzy(options))
                ok, total = ok and bool(matched[0]), total + float(scores[0])
                found += ranges[0]
            else:
                test = {"exact": text == value, "include": value in text, "prefix": text.startswith(value), "suffix": text.endswith(value)}[kind]
                ok = ok and test != term.inverse
                if term.inverse:
                    found.append((0, len(text) - 1))
                elif kind == "include":
                    at = text.find(value)
                    while at >= 0:
                        found.append((at, at + len(value) - 1))
                        at = text.find(value, at + len(value))
                else:
                    start = len(text) - len(value) if kind == "suffix" else 0
                    found.append((start, start + len(value) - 1))
            if not ok:
                break
        if ok:
            out = {"is_match": True, "score": total / len(group)}
            if any(t.inverse for t in group):
                out["has_inverse"] = True
            if options.include_matches:
                out["indices"] = merge_ranges(found)
            return out
    return {"is_match": False, "score": 1.0}


def parse_query(query: dict, options: Options | None = None, auto: bool = True, **changes) -> dict:
    """The tree of a logical query; with `auto` its leaves are compiled too, so that wrong ones raise."""
    chosen = options_of(options, changes)
    tree = logical.parse(query)
    if auto:
        for leaf in logical.leaves(tree):
            if isinstance(leaf.query, str):
                searcher_for(leaf.query, chosen)
            else:
                objects.compile_field_query(leaf.query, leaf.key, chosen)
    return tree.to_dict()
