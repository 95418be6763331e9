"""Queries over the driver's tables, one or more for each operator, with SQL that computes the same."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.plans import oracle as sql
from quillseek.plans.search import Collection, fuzzy_match, parse_query
from quillseek.sources.index import ORDINAL, Index, with_ordinals

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEYS = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "documents": "doc_id", "orders": "o_orderkey", "benchmark": "item_id", "pages": "page_id", "events": "event_id"}


def docs(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table with its primary key as ordinal."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumn(ORDINAL, F.col(KEYS[table]).cast("long"))


def flat(found: DataFrame, table: str, log: bool = True) -> DataFrame:
    """The primary key and the rounded score, or its logarithm where exact matches make it tiny."""
    score = F.round(F.log("score") if log else F.col("score"), 6)
    return found.select(F.col(f"item.{KEYS[table]}").cast("long").alias(KEYS[table]), score.alias("score"))


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLE[name] = oracle


def search(name: str, table: str, keys: list | Callable[[], list], query, oracle: str | None, log: bool = True, limit: int | None = None, prepare=None, **options) -> None:
    """A query that searches some keys of a table; keys, and columns to sort by, may be functions, as columns need a session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir, table)
        rows = prepare(rows) if prepare else rows
        chosen = options | ({"sort": options["sort"]()} if "sort" in options else {})
        collection = Collection.of(rows, keys=keys() if callable(keys) else keys, include_score=True, **chosen)
        found = collection.matches(query) if limit is None else collection.search(query, limit)
        return flat(found, table, log)

    add(name, run, oracle)


def _one_key(table: str, text: str, raw: str, **more) -> str:
    """SQL for a search of one key; raw refers to the folded text as f."""
    log, extra, source = more.pop("log", True), more.pop("extra", ""), more.pop("source", table)
    inner = f"(SELECT *, lower({text}) AS f FROM {source})"
    return sql.records(inner, KEYS[table], {"x": sql.key_factor(raw, text, **more)}, log=log, extra=extra)


NAME, TYPE, BRAND = "p_name", "p_type", "p_brand"


def _fuzzy() -> None:
    search("fuzzy_ignore_location", "part", [NAME], "smal rng", _one_key("part", NAME, sql.fuzzy("smal rng", "f")), ignore_location=True)
    search("fuzzy_low_threshold", "part", [NAME], "rd widgt", _one_key("part", NAME, sql.fuzzy("rd widgt", "f", 0.3)), ignore_location=True, threshold=0.3)
    search("fuzzy_no_norm", "part", [NAME], "larg gear", _one_key("part", NAME, sql.fuzzy("larg gear", "f"), normed=False), ignore_location=True, ignore_field_norm=True)
    search("fuzzy_norm_weight", "part", [NAME], "larg gear", _one_key("part", NAME, sql.fuzzy("larg gear", "f"), norm_weight=2.0), ignore_location=True, field_norm_weight=2.0)
    case = sql.records("customer", "c_custkey", {"x": sql.key_factor(sql.fuzzy("FURNITUR", "c_mktsegment"), "c_mktsegment")})
    search("fuzzy_case_sensitive", "customer", ["c_mktsegment"], "FURNITUR", case, ignore_location=True, is_case_sensitive=True)
    # With threshold 0 a text matches only where the pattern stands at the location.
    at = "(CASE WHEN f = 'bolt' THEN 0.0::DOUBLE WHEN substr(f, 5, 4) = 'bolt' THEN 0.001::DOUBLE END)"
    search("fuzzy_location_zero_threshold", "part", [NAME], "bolt", _one_key("part", NAME, at), location=4, threshold=0.0)

    def placed(name: str, pattern: str, **options) -> None:
        known = {k: v for k, v in options.items() if k in ("threshold", "location", "distance")}
        source = f"(SELECT *, {sql.located(pattern, 'lower(p_name)', find_all='find_all_matches' in options, **known)} AS raw FROM part)"
        search(name, "part", [NAME], pattern, _one_key("part", NAME, "raw", source=source), **options)

    placed("fuzzy_default", "smal rng")
    placed("fuzzy_default_short", "rig")
    placed("fuzzy_location", "widget", location=4, distance=20, threshold=0.4)
    placed("fuzzy_location_inside", "ing", location=5, distance=10, threshold=0.7)
    placed("fuzzy_find_all", "gizmo", find_all_matches=True)
    longest = f"(SELECT *, {sql.marked('old anvil', 'lower(p_name)', 3)} AS raw FROM part)"
    search("fuzzy_min_match_length", "part", [NAME], "old anvil", _one_key("part", NAME, "raw", source=longest), min_match_char_length=3, ignore_location=True)
    # Long patterns: with threshold 0 each part of 32 units is there or not; the score is the mean of 0.001 and 1.
    long = "eaea ndorea as erthndly edst threeain for heed"
    parts = [long[:32], long[-32:]]
    there = [f"contains(f, {sql.quoted(p)})" for p in parts]
    mean = f"(CASE WHEN {' OR '.join(there)} THEN ({' + '.join(f'CASE WHEN {t} THEN 0.001 ELSE 1.0 END' for t in there)})::DOUBLE / {len(parts)} END)"
    search("fuzzy_long_pattern", "documents", ["text"], long, _one_key("documents", "text", mean), ignore_location=True, threshold=0.0)
    accents = "(SELECT *, replace(strip_accents(lower(text)), 'ß', 'ss') AS f FROM documents)"
    found = sql.records(accents, "doc_id", {"x": sql.key_factor(sql.holds("contains(f, 'reoi')"), "text")})
    search("fuzzy_diacritics", "documents", ["text"], "'réoi", found, use_extended_search=True, ignore_diacritics=True)
    whole = f"(SELECT *, {sql.whole_text('therin blees', 'lower(text)', 0.3)} AS raw FROM documents)"
    search("fuzzy_whole_documents", "documents", ["text"], "therin blees", _one_key("documents", "text", "raw", source=whole), ignore_location=True, threshold=0.3)


def _keys() -> None:
    weights = {NAME: 0.5, TYPE: 0.3, BRAND: 0.2}
    named = [{"name": NAME, "weight": 5}, {"name": TYPE, "weight": 3}, {"name": BRAND, "weight": 2}]
    inner = "(SELECT *, lower(p_name) AS f0, lower(p_type) AS f1, lower(p_brand) AS f2 FROM part)"
    factors = {f"x{i}": sql.key_factor(sql.fuzzy("small", f"f{i}"), k, w) for i, (k, w) in enumerate(weights.items())}
    search("multi_key_weighted", "part", named, "small", sql.records(inner, "p_partkey", factors), ignore_location=True)

    def as_array(rows: DataFrame) -> DataFrame:
        return rows.withColumn("tags", F.array(NAME, F.lit(None).cast("string"), TYPE))

    tags = {f"x{i}": sql.key_factor(sql.fuzzy("econom", f"lower({k})"), k) for i, k in enumerate((NAME, TYPE))}
    search("array_key", "part", ["tags"], "econom", sql.records("part", "p_partkey", tags), ignore_location=True, prepare=as_array)

    def nested(rows: DataFrame) -> DataFrame:
        return rows.select("p_partkey", ORDINAL, F.array(F.struct(F.struct(F.col(NAME).alias("a.b")).alias("inner"))).alias("outer"))

    path = _one_key("part", NAME, sql.holds("contains(f, 'anvil')"))
    search("nested_path", "part", [["outer", "inner", "a.b"]], "'anvil", path, use_extended_search=True, prepare=nested)
    number = sql.records("part", "p_partkey", {"x": sql.key_factor(sql.holds("p_size::VARCHAR = '11'"), "p_size::VARCHAR")})
    search("number_coercion", "part", ["p_size"], "=11", number, use_extended_search=True)
    price = sql.records("part", "p_partkey", {"x": sql.key_factor(sql.holds("p_retailprice = 900.0"), "'900'")})
    search("double_coercion", "part", ["p_retailprice"], "=900", price, use_extended_search=True)
    truth = sql.records("(SELECT *, (p_size > 25)::VARCHAR AS b FROM part)", "p_partkey", {"x": sql.key_factor(sql.holds("b = 'true'"), "b")})
    search("bool_coercion", "part", ["big"], "=true", truth, use_extended_search=True, prepare=lambda d: d.withColumn("big", F.col("p_size") > 25))
    computed = sql.records("(SELECT *, lower(p_brand || ' ' || p_type) AS f FROM part)", "p_partkey", {"x": sql.key_factor(sql.holds("ends_with(f, 'promo')"), "f")})
    search("key_expression", "part", lambda: [{"name": "label", "expr": F.concat_ws(" ", BRAND, TYPE)}], "promo$", computed, use_extended_search=True)


def _extended() -> None:
    def native(name: str, query: str, condition: str, table: str = "part", text: str = NAME) -> None:
        search(name, table, [text], query, _one_key(table, text, sql.holds(condition)), use_extended_search=True)

    native("ext_exact", '="small ring"', "f = 'small ring'")
    native("ext_include", "'wid", "contains(f, 'wid')")
    native("ext_prefix", "^old", "starts_with(f, 'old')")
    native("ext_suffix", "gear$", "ends_with(f, 'gear')")
    native("ext_not_include", "!ring", "NOT contains(f, 'ring')")
    native("ext_not_prefix", "!^small", "NOT starts_with(f, 'small')")
    native("ext_not_suffix", "!bolt$", "NOT ends_with(f, 'bolt')")
    native("ext_and", "^hot 'o !bolt$", "starts_with(f, 'hot') AND contains(f, 'o') AND NOT ends_with(f, 'bolt')")
    native("ext_or", "^hot rod$ | ^cold 'ing", "(starts_with(f, 'hot') AND ends_with(f, 'rod')) OR (starts_with(f, 'cold') AND contains(f, 'ing'))")
    native("ext_quoted", "^\"old gi\" | \"red anvil\"$", "starts_with(f, 'old gi') OR ends_with(f, 'red anvil')")
    native("ext_escaped_pipe", r"'\| 'thewh", "contains(f, '|') AND contains(f, 'thewh')", "documents", "text")
    mixed = f"(CASE WHEN starts_with(f, 'blue') AND {sql.fuzzy('wdget', 'f')} IS NOT NULL THEN (0.0 + {sql.fuzzy('wdget', 'f')}) / 2 END)"
    search("ext_fuzzy_term", "part", [NAME], "^blue wdget", _one_key("part", NAME, mixed), use_extended_search=True, ignore_location=True)
    both = {"x0": sql.key_factor(sql.holds("NOT contains(lower(p_name), 'gear')"), NAME, 0.5), "x1": sql.key_factor(sql.holds("NOT contains(lower(p_type), 'gear')"), TYPE, 0.5)}
    search("ext_inverse_all_keys", "part", [NAME, TYPE], "!gear", sql.records("part", "p_partkey", both, "x0 IS NOT NULL AND x1 IS NOT NULL"), use_extended_search=True)
    exact = sql.records("part", "p_partkey", {"x": sql.key_factor(sql.holds("starts_with(p_brand, 'Brand#1')"), BRAND)})
    search("ext_case_sensitive_pushdown", "part", [BRAND], "^Brand#1", exact, use_extended_search=True, is_case_sensitive=True)


def _objects() -> None:
    def native(name: str, query: dict, condition: str) -> None:
        search(name, "part", [NAME, TYPE], {NAME: query}, _one_key("part", NAME, sql.holds(condition), weight=0.5))

    native("obj_eq", {"$eq": "Hot Rod"}, "f = 'hot rod'")
    native("obj_contains", {"$contains": "nvi"}, "contains(f, 'nvi')")
    native("obj_starts_with", {"$startsWith": "large"}, "starts_with(f, 'large')")
    native("obj_ends_with", {"$endsWith": "plate"}, "ends_with(f, 'plate')")
    native("obj_not", {"$not": {"$contains": "e"}}, "NOT contains(f, 'e')")
    native("obj_and", {"$and": [{"$startsWith": "new"}, {"$not": {"$endsWith": "ring"}}]}, "starts_with(f, 'new') AND NOT ends_with(f, 'ring')")
    native("obj_or", {"$or": [{"$and": [{"$startsWith": "red"}, {"$contains": "gi"}]}, {"$eq": "blue rod"}]}, "(starts_with(f, 'red') AND contains(f, 'gi')) OR f = 'blue rod'")
    search("obj_fuzzy", "part", [NAME, TYPE], {NAME: {"$fuzzy": "cold wdget"}}, _one_key("part", NAME, sql.fuzzy("cold wdget", "f"), weight=0.5), ignore_location=True)


def _logical() -> None:
    name, kind = "lower(p_name)", "lower(p_type)"
    raws = {"x0": sql.key_factor(sql.fuzzy("small", name), NAME, 0.5), "x1": sql.key_factor(sql.fuzzy("promo", kind), TYPE, 0.5)}
    both, query = "x0 IS NOT NULL AND x1 IS NOT NULL", [{NAME: "small"}, {TYPE: "promo"}]
    search("logical_and", "part", [NAME, TYPE], {"$and": query}, sql.records("part", "p_partkey", raws, both), ignore_location=True)
    search("logical_implicit_and", "part", [NAME, TYPE], {NAME: "small", TYPE: "promo"}, sql.records("part", "p_partkey", raws, both), ignore_location=True)
    search("logical_or", "part", [NAME, TYPE], {"$or": query}, sql.records("part", "p_partkey", raws), ignore_location=True)
    tree = {
        "y0": sql.key_factor(sql.holds(f"starts_with({name}, 'old')"), NAME, 0.5),
        "y1": sql.key_factor(sql.holds(f"{kind} = 'large'"), TYPE, 0.5),
        "y2": sql.key_factor(sql.holds(f"ends_with({name}, 'gear')"), NAME, 0.5),
    }
    # A branch of $or counts only as a whole.
    whole = {"z0": "y0", "z1": "CASE WHEN y1 IS NOT NULL AND y2 IS NOT NULL THEN y1 * y2 END"}
    inner = f"(SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in tree.items())} FROM part)"
    nested = {"$or": [{NAME: {"$startsWith": "old"}}, {"$and": [{TYPE: {"$eq": "large"}}, {NAME: {"$endsWith": "gear"}}]}]}
    search("logical_nested", "part", [NAME, TYPE], nested, sql.records(inner, "p_partkey", whole))
    keyless = {f"x{i}": sql.key_factor(sql.fuzzy("small", f), k, 0.5) for i, (f, k) in enumerate(((name, NAME), (kind, TYPE)))}
    keyless["x2"] = sql.key_factor(sql.fuzzy("ring", name), NAME, 0.5)
    search("logical_keyless", "part", [NAME, TYPE], {"$and": ["small", {NAME: "ring"}]}, sql.records("part", "p_partkey", keyless, "(x0 IS NOT NULL OR x1 IS NOT NULL) AND x2 IS NOT NULL"), ignore_location=True)

    def with_struct(rows: DataFrame) -> DataFrame:
        return rows.select("o_orderkey", ORDINAL, F.struct(F.col("o_orderpriority").alias("prio.text"), F.col("o_orderstatus").alias("status")).alias("o"))

    path = sql.records("orders", "o_orderkey", {"x": sql.key_factor(sql.holds("starts_with(lower(o_orderpriority), '1-')"), "o_orderpriority", 0.5)})
    leaf = {"$and": [{"$path": ["o", "prio.text"], "$val": {"$startsWith": "1-"}}]}
    search("logical_path", "orders", [["o", "prio.text"], "o.status"], leaf, path, prepare=with_struct)
    search("logical_unknown_key", "part", [NAME], {"$or": [{"nothing": "x"}, {NAME: {"$eq": "hot rod"}}]}, _one_key("part", NAME, sql.holds("f = 'hot rod'")))


def _tokens() -> None:
    def frequencies(token: str | None):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            collection = Collection.of(docs(spark, sf_dir, "documents"), keys=["text"], use_token_search=True, tokenize=token)
            return collection.document_frequency()

        return run

    words = "SELECT unnest(list_distinct(regexp_extract_all(lower(text), {}))) AS term FROM documents WHERE text IS NOT NULL"
    for name, token in (("token_df", None), ("token_custom_regex", r"[a-z]+\p{M}*|\p{N}+")):
        add(name, frequencies(token), f"SELECT term, count(*) AS df FROM ({words.format(sql.quoted(token or sql.DEFAULT_TOKEN))}) GROUP BY term")

    def count(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Collection.of(docs(spark, sf_dir, "documents"), keys=["text", "source"], use_token_search=True).field_count()

    texts = " UNION ALL ".join(f"SELECT lower({c}) AS t FROM documents" for c in ("text", "source"))
    add("token_field_count", count, f"SELECT count(*) AS field_count FROM ({texts}) WHERE len(regexp_extract_all(t, {sql.quoted(sql.DEFAULT_TOKEN)})) > 0")

    def token(name: str, keys: list[str], query: str, match: str) -> None:
        words = query.split()
        weight = 1 / len(keys)
        raws = {k: [sql.fuzzy(w, f"lower({k})") for w in words] for k in keys}
        terms = ", ".join(f"{raw} AS {k}_r{i}" for k in keys for i, raw in enumerate(raws[k]))
        inner = f"(SELECT *, {terms} FROM part, {sql.token_statistics('part', [f'lower({k})' for k in keys], words)})"
        factors = {f"x{n}": sql.key_factor(sql.token_raw([f"{k}_r{i}" for i in range(len(words))]), k, weight) for n, k in enumerate(keys)}
        covered = " AND ".join("(" + " OR ".join(f"{k}_r{i} IS NOT NULL" for k in keys) + ")" for i in range(len(words)))
        if match == "all":
            inner = f"(SELECT * FROM {inner} WHERE {covered})"
        search(name, "part", keys, query, sql.records(inner, "p_partkey", factors), use_token_search=True, token_match=match)

    token("token_any", [NAME], "smal gizmo", "any")
    token("token_all", [NAME], "blu widget", "all")
    token("token_all_cross_field", [NAME, TYPE], "rd promo", "all")


def _order() -> None:
    def ranked(name: str, query, limit: int, oracle: str | None, **options) -> None:
        search(name, "part", [NAME], query, oracle, limit=limit, **options)

    base = _one_key("part", NAME, sql.fuzzy("smal rng", "f"))
    ranked("topk_tie_break", "smal rng", 25, f"SELECT * FROM ({base}) ORDER BY score, p_partkey LIMIT 25", ignore_location=True)
    ranked("limit_zero", "smal rng", 0, f"SELECT * FROM ({base}) LIMIT 0", ignore_location=True)
    ranked("unsorted_limit", "smal rng", 40, f"SELECT * FROM ({base}) ORDER BY p_partkey LIMIT 40", ignore_location=True, should_sort=False)
    ranked("custom_sort", "smal rng", 15, f"SELECT * FROM ({base}) ORDER BY p_partkey DESC LIMIT 15", ignore_location=True, sort=lambda: [F.col("item.p_partkey").desc()])

    def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Collection.of(docs(spark, sf_dir, "nation"), keys=["n_name"]).search("  ", 7).select(F.col(ORDINAL).alias("n_nationkey"), "item.n_name")

    add("empty_query_limit", everything, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")

    def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir, "part").select(ORDINAL, NAME)
        found = Collection.of(rows, ignore_location=True).matches("cold rod")
        return found.select(F.col(ORDINAL).alias("p_partkey"), F.round("score", 6).alias("score"))

    raw = sql.fuzzy("cold rod", "f")
    add("string_list", strings, sql.records("(SELECT *, lower(p_name) AS f FROM part)", "p_partkey", {"x": sql.factor(raw, sql.norm(NAME), keyed=False)}, log=False))

    def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Collection.of(docs(spark, sf_dir, "part"), keys=[NAME], include_matches=True, use_extended_search=True).matches("'l")
        each = found.select(ORDINAL, F.explode("matches").alias("m")).select(ORDINAL, F.explode("m.indices").alias("r"), "m.value")
        return each.select(F.col(ORDINAL).alias("p_partkey"), F.col("r.start").cast("long").alias("start"), F.col("r.end").cast("long").alias("end"), "value")

    letters = "SELECT p_partkey, value, unnest(range(1, len(value) + 1)) AS i FROM (SELECT p_partkey::BIGINT AS p_partkey, p_name AS value FROM part)"
    hits = f"SELECT *, i - row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS g FROM ({letters}) WHERE lower(substr(value, i, 1)) = 'l'"
    add("matches_ranges", ranges, f'SELECT p_partkey, min(i) - 1 AS start, max(i) - 1 AS "end", value FROM ({hits}) GROUP BY p_partkey, value, g')


def _index() -> None:
    def collection(spark: SparkSession, sf_dir: str) -> Collection:
        return Collection.of(docs(spark, sf_dir, "nation"), keys=["n_name"], use_extended_search=True)

    def listed(found: DataFrame) -> DataFrame:
        return found.select(ORDINAL, "item.n_name")

    def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Index.create([NAME, {"name": TYPE, "weight": 2}], docs(spark, sf_dir, "part")).fields()
        return rows.select(ORDINAL, "key_idx", "key_id", "weight", "v", "n")

    long = " UNION ALL ".join(f"SELECT p_partkey::BIGINT AS ref_index, {i} AS key_idx, '{k}' AS key_id, {w}.0::DOUBLE AS weight, {k} AS v, {sql.norm(k)} AS n FROM part" for i, (k, w) in enumerate(((NAME, 1), (TYPE, 2))))
    add("index_fields", fields, long)

    def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillseek.sources.index import scratch_path

        path = scratch_path(spark)
        Index.create([NAME], docs(spark, sf_dir, "part")).save(path)
        loaded = Collection.of(None, index=Index.load(spark, path), keys=[NAME], use_extended_search=True)
        return flat(loaded.matches("^cold"), "part")

    add("index_roundtrip", round_trip, _one_key("part", NAME, sql.holds("starts_with(f, 'cold')")))

    def added(spark: SparkSession, sf_dir: str) -> DataFrame:
        more = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"), F.col("r_regionkey").cast("long").alias(ORDINAL))
        return listed(collection(spark, sf_dir).add(more).matches("'a"))

    grown = "SELECT n_nationkey::BIGINT AS ref_index, n_name FROM nation UNION ALL SELECT r_regionkey + (SELECT max(n_nationkey) + 1 FROM nation), r_name FROM region"
    add("add_docs", added, f"SELECT ref_index, n_name FROM ({grown}) WHERE contains(lower(n_name), 'a')")

    def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept, _ = collection(spark, sf_dir).remove(F.col("item.n_regionkey") == 2)
        return listed(kept.search(""))

    add("remove_where", removed, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ref_index, n_name FROM nation WHERE n_regionkey <> 2")

    def removed_at(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listed(collection(spark, sf_dir).remove_at(3)[0].search(""))

    add("remove_at", removed_at, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ref_index, n_name FROM nation WHERE n_nationkey <> 3")

    def removed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = collection(spark, sf_dir).get_index().remove_all([1, 4, 99])
        return listed(Collection.of(None, index=index, keys=["n_name"]).search(""))

    add("remove_all", removed_all, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ref_index, n_name FROM nation WHERE n_nationkey NOT IN (1, 4)")

    def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_ordinals(spark.read.parquet(f"{sf_dir}/part.parquet"), [NAME, "p_partkey"]).select(ORDINAL, "p_partkey")

    add("ordinals", numbered, "SELECT row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS ref_index, p_partkey FROM part")

    def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillseek.plans.sharded import ShardedCollection

        shards = ShardedCollection(docs(spark, sf_dir, "part"), keys=[NAME], num_workers=4, ignore_location=True, include_score=True)
        return flat(shards.search("smal rng", 25), "part")

    add("sharded_topk", sharded, ORACLE["topk_tie_break"])

    def one_off(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/part.parquet")
        hit = rows.select("p_partkey", fuzzy_match(F.col(NAME), "hot gizmo", ignore_location=True).alias("hit"))
        return hit.where("hit.m").select("p_partkey", F.round("hit.s", 6).alias("score"))

    raw = sql.fuzzy("hot gizmo", "lower(p_name)")
    add("column_match", one_off, f"SELECT p_partkey, round({raw}, 6) AS score FROM part WHERE {raw} IS NOT NULL")


def _collections() -> None:
    def nations(spark: SparkSession, sf_dir: str, **options) -> Collection:
        return Collection.of(docs(spark, sf_dir, "nation"), keys=["n_name"], **options)

    def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/region.parquet")
        return rows.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"), F.col("r_regionkey").cast("long").alias(ORDINAL))

    def named(found: DataFrame) -> DataFrame:
        return found.select(ORDINAL, "item.n_name")

    def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
        return named(nations(spark, sf_dir, use_extended_search=True).set_collection(regions(spark, sf_dir)).matches("'a"))

    add("set_collection", replaced, "SELECT r_regionkey::BIGINT AS ref_index, r_name AS n_name FROM region WHERE contains(lower(r_name), 'a')")

    def accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = nations(spark, sf_dir).get_index()
        (text,) = index.value_at(3, "n_name")
        return spark.createDataFrame([(index.size(), index.keys[0].id, text["v"], text["n"], index.value_at(3, "x") is None)], "size long, key string, v string, n double, unknown boolean")

    add("index_accessors", accessors, f"SELECT (SELECT count(*) FROM nation) AS size, 'n_name' AS key, n_name AS v, {sql.norm('n_name')} AS n, true AS unknown FROM nation WHERE n_nationkey = 3")

    def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillseek.plans.sharded import ShardedCollection

        shards = ShardedCollection(docs(spark, sf_dir, "nation"), keys=["n_name"], num_workers=3, use_extended_search=True)
        shards.add(regions(spark, sf_dir))
        return named(shards.search("'a"))

    add("sharded_add", dealt, ORACLE["add_docs"])

    def by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept, _ = nations(spark, sf_dir).remove(lambda item, place: item["n_name"].endswith("1") or place == 2)
        return named(kept.search(""))

    add("remove_function", by_function, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ref_index, n_name FROM nation WHERE NOT ends_with(n_name, '1') AND n_nationkey <> 2")

    def many(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = Index.create([NAME], docs(spark, sf_dir, "part"))
        left = index.remove_all(range(0, 1000, 3))
        return left.frame.select(ORDINAL, F.col("item.p_name").alias("p_name"))

    add("remove_many", many, "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ref_index, p_name FROM part WHERE p_partkey % 3 <> 0 OR p_partkey >= 1000")

    def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = nations(spark, sf_dir, use_extended_search=True).search_sorted("'a", lambda a, b: (a["item"]["n_name"] < b["item"]["n_name"]) - (a["item"]["n_name"] > b["item"]["n_name"]), 6)
        return spark.createDataFrame([(i, r["item"]["n_name"]) for i, r in enumerate(found)], "place long, n_name string")

    add("sort_function", compared, "SELECT row_number() OVER (ORDER BY n_name DESC) - 1 AS place, n_name FROM nation WHERE contains(lower(n_name), 'a') ORDER BY n_name DESC LIMIT 6")

    def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Collection.of(docs(spark, sf_dir, "part"), keys=[NAME], ignore_location=True).search_all(["smal rng", " ", "hot rod", "larg gear"], 20)
        return found.select("query", F.col("item.p_partkey").cast("long").alias("p_partkey"), F.round(F.log("score"), 6).alias("score"))

    ranked = [f"(SELECT {n} AS query, * FROM ({_one_key('part', NAME, sql.fuzzy(q, 'f'))}) ORDER BY score, p_partkey LIMIT 20)" for n, q in ((0, "smal rng"), (2, "hot rod"), (3, "larg gear"))]
    add("query_set", query_set, " UNION ALL ".join(f"SELECT * FROM {r}" for r in ranked))

    def operators(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/part.parquet")
        hit = rows.select("p_partkey", fuzzy_match(F.col(NAME), "^hot !rod | wdget", ignore_location=True, use_extended_search=True).alias("hit"))
        return hit.where("hit.m").select("p_partkey", F.round("hit.s", 6).alias("score"))

    first, second = "starts_with(lower(p_name), 'hot') AND NOT contains(lower(p_name), 'rod')", sql.fuzzy("wdget", "lower(p_name)")
    add("column_match_operators", operators, f"SELECT p_partkey, CASE WHEN {first} THEN 0.0::DOUBLE ELSE round({second}, 6) END AS score FROM part WHERE ({first}) OR {second} IS NOT NULL")


def _getters() -> None:
    labelled = sql.records("(SELECT *, lower('x ' || p_name) AS f, 'x ' || p_name AS t FROM part)", "p_partkey", {"x": sql.key_factor(sql.holds("starts_with(f, 'x hot')"), "t")})

    def column_of(df: DataFrame, parts: list[str]) -> Column:
        return F.concat(F.lit("x "), F.col(parts[0]))

    search("global_getter", "part", [NAME], '^"x hot"', labelled, use_extended_search=True, get=column_of)
    search("row_getter", "part", lambda: [{"name": "any", "expr": lambda row: "x " + row[NAME]}], '^"x hot"', labelled, use_extended_search=True)

    def added_after_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillseek.sources.index import scratch_path

        path, rows = scratch_path(spark), docs(spark, sf_dir, "nation")
        key = {"name": "label", "expr": F.concat(F.lit("a "), "n_name")}
        Index.create([key], rows.where("n_nationkey < 20")).save(path)
        loaded = Collection.of(None, index=Index.load(spark, path, keys=[key]), keys=[key], use_extended_search=True)
        return loaded.add(rows.where("n_nationkey >= 20").withColumn(ORDINAL, F.col(ORDINAL) - 20)).matches("'a !^\"a i\"").select(ORDINAL, "item.n_name")

    add("loaded_getter", added_after_loading, "SELECT n_nationkey::BIGINT AS ref_index, n_name FROM nation WHERE NOT starts_with(lower('a ' || n_name), 'a i')")

    def reweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = Index.create([NAME, TYPE], docs(spark, sf_dir, "part"))
        return flat(Collection.of(None, index=index, keys=[{"name": NAME, "weight": 4}, {"name": TYPE, "weight": 1}], ignore_location=True).matches("small"), "part")

    factors = {f"x{i}": sql.key_factor(sql.fuzzy("small", f"lower({k})"), k, w) for i, (k, w) in enumerate(((NAME, 0.8), (TYPE, 0.2)))}
    add("reweighted_index", reweighted, sql.records("part", "p_partkey", factors))

    def plugged(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillseek.plans import matching

        class Pattern(matching.Searcher):
            def __init__(self, pattern: str):
                self.pattern, self.fuzzy = pattern.removeprefix("re:"), []

            def verdict(self, folded, hits):
                return matching.Verdict(folded.rlike(self.pattern), F.lit(0.5))

        mine = (lambda pattern, _: pattern.startswith("re:"), lambda pattern, _: Pattern(pattern))
        matching.use(*mine)
        try:
            return flat(Collection.of(docs(spark, sf_dir, "part"), keys=[NAME]).matches("re:^(hot|cold) r"), "part")
        finally:
            matching._plugins.remove(mine)

    half = "(CASE WHEN regexp_matches(f, '^(hot|cold) r') THEN 0.5::DOUBLE END)"
    add("plugin_searcher", plugged, _one_key("part", NAME, half))


def _words() -> None:
    def shrunk(spark: SparkSession, sf_dir: str) -> Collection:
        rows = docs(spark, sf_dir, "part")
        collection = Collection.of(rows.where("p_partkey % 2 = 0"), keys=[NAME], use_token_search=True).with_statistics()
        grown = collection.add(rows.where("p_partkey % 2 = 1").withColumn(ORDINAL, F.col("p_partkey").cast("long")))
        return grown.remove(F.col("item.p_size") > 30)[0]

    def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shrunk(spark, sf_dir).get_index().words.where("term IS NOT NULL")

    words = "SELECT unnest(list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{M}\\p{N}_]+'))) AS term FROM part WHERE p_size <= 30"
    add("token_df_decrement", frequencies, f"SELECT term, count(*) AS df FROM ({words}) GROUP BY term")

    def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(shrunk(spark, sf_dir).matches("smal gizmo"), "part")

    raws = [sql.fuzzy(w, "lower(p_name)") for w in ("smal", "gizmo")]
    kept = "(SELECT * FROM part WHERE p_size <= 30)"
    inner = f"(SELECT *, {raws[0]} AS r0, {raws[1]} AS r1 FROM {kept}, {sql.token_statistics(kept, ['lower(p_name)'], ['smal', 'gizmo'])})"
    add("token_stored_statistics", searched, sql.records(inner, "p_partkey", {"x": sql.key_factor(sql.token_raw(["r0", "r1"]), NAME)}))


def _streams() -> None:
    def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillseek.sources.index import scratch_path
        from quillseek.streaming.standing import standing_search

        path, rows = scratch_path(spark, "stream"), spark.read.parquet(f"{sf_dir}/part.parquet")
        stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/part.parquet*")
        found = standing_search(stream, "smal rng", keys=[NAME], include_score=True, ignore_location=True)
        writer = found.select("item", "score").writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress")
        writer.trigger(availableNow=True).start().awaitTermination()
        return flat(spark.read.parquet(f"{path}/rows"), "part")

    add("standing_search", standing, ORACLE["fuzzy_ignore_location"])

    def growing(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quillseek.sources.index import scratch_path
        from quillseek.streaming.standing import growing_index

        path, rows = scratch_path(spark, "growing"), spark.read.parquet(f"{sf_dir}/nation.parquet")
        first = Index.create(["n_name"], rows.limit(0).withColumn(ORDINAL, F.lit(0).cast("long")))
        stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/nation.parquet*")
        growing_index(stream, path, first).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
        return Collection.of(None, index=Index.load(spark, path), keys=["n_name"], use_extended_search=True).matches("'n_1").select(ORDINAL, "item.n_name")

    add("growing_index", growing, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ref_index, n_name FROM nation QUALIFY contains(lower(n_name), 'n_1')")


def _errors() -> None:
    def table(cases: Callable[[SparkSession, str], list[tuple[str, Callable]]]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = []
            for case, call in cases(spark, sf_dir):
                try:
                    call()
                    rows.append((case, "nothing"))
                except (ValueError, TypeError) as e:
                    rows.append((case, f"{type(e).__name__}: {e}"))
            return spark.createDataFrame(rows, "case string, message string")

        return run

    def cases(spark: SparkSession, sf_dir: str) -> list[tuple[str, Callable]]:
        rows = docs(spark, sf_dir, "nation")
        one = Collection.of(rows, keys=["n_name"])
        words = Collection.of(rows, keys=["n_name"], use_token_search=True)
        return [
            ("index of another kind", lambda: Collection.of(rows, index={"keys": []})),
            ("negative ordinal", lambda: one.remove_at(-1)),
            ("ordinal beyond the last", lambda: one.remove_at(10**9)),
            ("number as a leaf", lambda: one.matches({"n_name": 5})),
            ("unknown operator", lambda: one.matches({"n_name": {"$like": "x"}})),
            ("empty operand", lambda: one.matches({"n_name": {"$eq": ""}})),
            ("nested negation", lambda: one.matches({"n_name": {"$not": {"$not": {"$eq": "x"}}}})),
            ("key without a name", lambda: Collection.of(rows, keys=[{"weight": 1}])),
            ("weight of nought", lambda: Collection.of(rows, keys=[{"name": "n_name", "weight": 0}])),
            ("one match by words", lambda: fuzzy_match(F.col("n_name"), "x", use_token_search=True)),
            ("words in a logical query", lambda: words.matches({"$and": ["x"]})),
            ("tokens that aren't a list", lambda: words.statistics([]) and Collection.of(rows, keys=["n_name"], use_token_search=True, tokenize=lambda t: t).matches("x")),
        ]

    message = {
        "index of another kind": "SearchError: Incorrect ''index'' type",
        "negative ordinal": "SearchError: Invalid doc index: must be a non-negative integer within the bounds of the docs array",
        "ordinal beyond the last": "SearchError: Invalid doc index: must be a non-negative integer within the bounds of the docs array",
        "number as a leaf": "SearchError: Invalid value for key n_name",
        "unknown operator": "SearchError: Unknown query operator ''$like''",
        "empty operand": "SearchError: Empty value for operator ''$eq'' on key ''n_name''",
        "nested negation": "SearchError: Invalid field query for key ''n_name'': $not cannot be nested",
        "key without a name": "SearchError: Missing name property in key",
        "weight of nought": "SearchError: Property ''weight'' in key ''n_name'' must be a positive integer",
        "one match by words": "SearchError: match() does not support token search: it needs statistics of a whole collection",
        "words in a logical query": "SearchError: text leaves of a logical query can''t use token search: it needs statistics of a whole collection",
        "tokens that aren't a list": "TypeError: a tokenize function must return a list of strings",
    }
    values = ", ".join(f"({sql.quoted(case)}, '{text}')" for case, text in message.items())
    add("errors", table(cases), f'SELECT * FROM (VALUES {values}) AS t("case", message)')

    def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = parse_query({"$and": [{"n_name": "x", "other": "!w"}, {"$or": [{"n_name": "!y"}, {"$path": ["a", "b"], "$val": "^z"}]}]})
        return spark.createDataFrame([(json.dumps(parsed, sort_keys=True),)], "tree string")

    both = '{"children": [{"keyId": "n_name", "pattern": "x"}, {"keyId": "other", "pattern": "!w"}], "operator": "$and"}'
    either = '{"children": [{"keyId": "n_name", "pattern": "!y"}, {"keyId": "a.b", "pattern": "^z"}], "operator": "$or"}'
    add("parse_query", tree, f"""SELECT '{{"children": [{both}, {either}], "operator": "$and"}}' AS tree""")

    def nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = docs(spark, sf_dir, "nation").select(ORDINAL, "n_name")
        return Collection.of(rows).matches({"$or": ["a"]}).select(ORDINAL)

    add("logical_strings", nothing, "SELECT n_nationkey::BIGINT AS ref_index FROM nation WHERE false")


for _group in (_fuzzy, _keys, _extended, _objects, _logical, _tokens, _order, _index, _collections, _getters, _words, _streams, _errors):
    _group()
