from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillseek import Collection, Index, Key, SearchError, Searcher, ShardedCollection, Verdict, fuzzy_match, use, with_ordinals
from quillseek.plans import matching
from quillseek.sources.keys import keys_to_json

BOOKS = [
    (0, "Old Mill's Tax", ("Anna", "Brenner"), ["river", "tax"], 1990, 2.5, True),
    (1, "The Mask Painter", ("Marek", "Olsen"), ["crime", None, "masks"], 2010, 1.0, False),
    (2, "XML7 for Beginners", ("B.K", "Lindt"), [], 2012, 1e21, None),
    (3, "Quite So Dorset", ("P.D", "Fairweather"), None, None, None, True),
    (4, "Good Day Dorset", ("P.D", "Fairweather"), ["comedy"], 1934, -0.0, False),
    (5, "", ("", ""), ["  "], 0, 0.1, False),
]
SCHEMA = "ref_index long, title string, author struct<firstName: string, lastName: string>, tags array<string>, year int, price double, sold boolean"


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(BOOKS, SCHEMA).cache()


def ids(found):
    return [r["ref_index"] for r in found.collect()]


def test_fruit(strings):
    fruit = Collection.of(strings(["Apple", "Orange", "Banana"]), include_score=True, include_matches=True)
    assert ids(fruit.search("ran")) == [1, 2]
    assert ids(fruit.search("nan")) == [2, 1]
    first = fruit.search("ran").first()
    assert first["item"]["value"] == "Orange" and [(r["start"], r["end"]) for r in first["matches"][0]["indices"]] == [(1, 3)]
    assert first["matches"][0]["key"] is None and first["matches"][0]["ref_index"] is None and first["matches"][0]["value"] == "Orange"
    assert fruit.search("ran", 1).columns == ["item", "ref_index", "score", "matches"]


def test_exact_matches_score(strings, books):
    texts = Collection.of(strings(["word", "a word here now"]), include_score=True)
    assert texts.search("word").first()["score"] == 0.0
    keyed = Collection.of(books, keys=["author.lastName"], include_score=True, use_extended_search=True)
    assert [r["score"] for r in keyed.search("=fairweather").collect()] == [2.0**-52] * 2
    title = Collection.of(books, keys=["title"], include_score=True, use_extended_search=True)
    scores = [r["score"] for r in title.search("'dorset").collect()]
    assert scores == pytest.approx([2.0 ** (-52 * 0.577)] * 2, rel=1e-12)


def test_weights(books):
    def scores(*keys):
        return {r["ref_index"]: r["score"] for r in Collection.of(books, keys=list(keys), include_score=True).matches("tax").collect()}

    assert scores({"name": "title", "weight": 1}, {"name": "tags", "weight": 3}) == scores({"name": "title", "weight": 10}, Key("tags", 30))
    assert scores("title", "tags") != scores({"name": "title", "weight": 9}, "tags")
    for wrong in ({"weight": 2}, {"name": "title", "weight": 0}, {"name": "title", "weight": -1}):
        with pytest.raises(SearchError):
            Collection.of(books, keys=[wrong])


def test_keys_of_many_kinds(books):
    def find(key, query, **options):
        return ids(Collection.of(books, keys=[key], use_extended_search=True, **options).search(query))

    assert find("year", "=2010") == [1] and find("year", "=0") == [5]
    assert find("price", "=1") == [1] and find("price", "=1e+21") == [2] and find("price", "=-0") == [4] and find("price", "=0.1") == [5]
    assert find("sold", "=true") == [0, 3]
    assert find("tags", "=masks") == [1] and find("author", "'anna") == [] and find("nothing", "'x") == []
    assert find(["author", "lastName"], "^fair") == [3, 4]
    assert find({"name": "both", "expr": F.concat_ws(" ", "author.firstName", "title")}, "^p.d") == [3, 4]
    assert find("title", "^the", get=lambda df, path: F.reverse(path[0])) == []
    assert find("title", "^tesrod", get=lambda df, path: F.reverse(path[0])) == [3, 4]


def test_array_places_and_nested_arrays(spark, books):
    match = Collection.of(books, keys=["tags"], include_matches=True).search("masks").first()["matches"][0]
    assert (match["ref_index"], match["key"], match["value"]) == (2, "tags", "masks")
    blocks = spark.createDataFrame([(0, [[("a",), ("bee",)], [("sea",)]]), (1, [])], "ref_index long, blocks array<array<struct<text: string>>>")
    rows = blocks.select("ref_index", F.transform("blocks", lambda b: F.struct(b.alias("content"))).alias("blocks"))
    found = Collection.of(rows, keys=["blocks.content.text"], include_matches=True, use_extended_search=True).search("=bee").first()
    assert found["ref_index"] == 0 and found["matches"][0]["ref_index"] == 1
    doubles = spark.createDataFrame([(0, [1.0, 2.5]), (1, [3.0])], "ref_index long, xs array<double>")
    assert ids(Collection.of(doubles, keys=["xs"], use_extended_search=True).search("=2.5")) == [0]
    maps = spark.createDataFrame([(0, {"a": "Overgrow"}), (1, {"b": "Torrent"})], "ref_index long, m map<string, string>")
    assert ids(Collection.of(maps, keys=["m.a"], use_extended_search=True).search("^over")) == [0]
    big = spark.sql("SELECT 0L AS ref_index, 123456789012345678901234567890BD AS n")
    assert ids(Collection.of(big, keys=["n"], use_extended_search=True).search("=123456789012345678901234567890")) == [0]


def test_inverse_terms_ask_all_keys(books):
    found = Collection.of(books.where("ref_index < 3"), keys=["title", "author.firstName"], use_extended_search=True)
    assert ids(found.search("!anna")) == [1, 2]
    assert ids(found.search("!mask")) == [0, 2]
    assert ids(Collection.of(books, keys=["title", "author.firstName"], use_extended_search=True).search("!anna")) == [1, 2, 3, 4]


def test_logical_queries(books):
    def find(query, **options):
        return ids(Collection.of(books, keys=["title", "author.lastName", "tags"], **options).search(query))

    assert find({"$and": [{"title": {"$contains": "dorset"}}, {"author.lastName": {"$startsWith": "fair"}}]}) == [3, 4]
    assert find({"title": {"$contains": "dorset"}, "tags": {"$eq": "comedy"}}) == [4]
    assert sorted(find({"$or": [{"title": {"$startsWith": "old"}}, {"tags": {"$eq": "crime"}}]})) == [0, 1]
    assert find({"$and": ["dorset", {"tags": "comedy"}]}, threshold=0.2) == [4]
    assert find({"$and": []}) == [] and find({"nothing": "x"}) == []
    assert find({"$and": [{"$or": [{"title": {"$eq": "x"}}]}, {"title": {"$contains": "dorset"}}]}) == []
    for spec in ({"$eq": "old mill's tax"}, {"$contains": "mill"}, {"$startsWith": "old"}, {"$endsWith": "tax"}):
        text = {"$eq": '="{}"', "$contains": "'{}", "$startsWith": "^{}", "$endsWith": "{}$"}
        ((op, value),) = spec.items()
        one = Collection.of(books, keys=["title"], include_score=True, include_matches=True).search({"title": spec}).collect()
        other = Collection.of(books, keys=["title"], include_score=True, include_matches=True, use_extended_search=True).search(text[op].format(value)).collect()
        assert one == other and one


def test_or_pools_all_matching_branches(books):
    one = Collection.of(books, keys=["title"], include_score=True, ignore_field_norm=True)
    single = one.matches({"$or": [{"title": {"$contains": "dorset"}}]}).first()["score"]
    double = one.matches({"$or": [{"title": {"$contains": "dorset"}}, {"title": {"$contains": "orse"}}]}).first()["score"]
    assert double == pytest.approx(single**2)


def test_logical_query_on_strings_finds_nothing(strings):
    assert ids(Collection.of(strings(["a", "b"])).search({"$and": ["a"]})) == []


def test_token_search(spark):
    rows = spark.createDataFrame([(0, "express server guide", "routing"), (1, "router basics", "express"), (2, "unrelated", "notes")], "ref_index long, title string, body string")
    some = Collection.of(rows, keys=["title", "body"], use_token_search=True, include_score=True, threshold=0.3)
    assert sorted(ids(some.search("express routing"))) == [0, 1]
    assert ids(some.search("...")) == []
    every = Collection.of(rows, keys=["title", "body"], use_token_search=True, token_match="all", threshold=0.3)
    assert ids(every.search("express routing")) == [0]
    count, df = some.statistics(["express", "nothing"])
    assert (count, df) == (6, {"express": 2, "nothing": 0})
    one = Collection.of(rows, keys=["title"], use_token_search=True, include_score=True, ignore_field_norm=True).matches("guide").first()["score"]
    assert one == pytest.approx(0.001)
    idf = {w: math.log(1 + (3 - d + 0.5) / (d + 0.5)) for w, d in (("express", 1), ("basics", 1))}
    half = Collection.of(rows, keys=["title"], use_token_search=True, threshold=0.0, ignore_field_norm=True).matches("express basics")
    got = {r["ref_index"]: r["score"] for r in half.collect()}
    assert got[0] == pytest.approx(1 - idf["express"] * 0.999 / sum(idf.values()))


def test_token_search_with_many_words(strings):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(40)]
    texts = strings([" ".join(words), " ".join(words[:-1]), " ".join(words[1:])])
    for n in (31, 32, 40):
        found = Collection.of(texts, use_token_search=True, token_match="all", threshold=0.0).search(" ".join(words[-n:]))
        assert sorted(ids(found)) == ([0] if n == 40 else [0, 2])


def test_custom_tokenizers(spark, strings):
    texts = strings(["a.b", "a b"])
    found = Collection.of(texts, use_token_search=True, tokenize=r"[^ ]+", threshold=0.0)
    assert found.statistics(["a.b"])[1] == {"a.b": 1}
    function = Collection.of(texts, use_token_search=True, tokenize=lambda t: t.split("."), threshold=0.0)
    assert function.statistics(["a", "b", "a b"])[1] == {"a": 1, "b": 1, "a b": 1}


def test_orders_and_limits(books, strings):
    same = strings(["aa", "aa", "ab", "aa"])
    c = Collection.of(same)
    assert ids(c.search("aa")) == [0, 1, 3, 2]
    assert ids(c.search("aa", 2)) == [0, 1] and ids(c.search("aa", 0)) == []
    assert ids(Collection.of(same, should_sort=False).search("aa", 3)) == [0, 1, 2]
    assert ids(Collection.of(same, sort=[F.col("score").desc()]).search("aa")) == [2, 0, 1, 3]
    assert ids(c.search("   ", 2)) == [0, 1] and ids(c.search("")) == [0, 1, 2, 3]
    everything = ids(Collection.of(books, keys=["title"]).search("dorset"))
    for n in range(len(everything) + 1):
        assert ids(Collection.of(books, keys=["title"]).search("dorset", n)) == everything[:n]


def test_blank_strings_keep_their_ordinals(strings):
    c = Collection.of(strings(["", "apple", "banana", " "]))
    assert ids(c.search("banana")) == [2] and c.get_index().size() == 2
    assert ids(c.search("")) == [0, 1, 2, 3]


def test_diacritics_and_case(strings):
    texts = strings(["Éclair", "eclair", "straße"])
    assert ids(Collection.of(texts, ignore_diacritics=True, threshold=0.0).search("eclair")) == [0, 1]
    assert ids(Collection.of(texts, ignore_diacritics=True, threshold=0.0).search("strasse")) == [2]
    assert ids(Collection.of(texts, is_case_sensitive=True, threshold=0.0).search("Éclair")) == [0]


def test_mutations(spark, books):
    c = Collection.of(books, keys=["title"], use_extended_search=True)
    more = spark.createDataFrame([("New Dorset", ("A", "B"), None, 1, 1.0, True)], SCHEMA.removeprefix("ref_index long, "))
    grown = c.add(more)
    assert sorted(ids(grown.search("'dorset"))) == [3, 4, 6] and c.add(None) is c
    kept, gone = grown.remove(F.col("item.title").contains("Dorset"))
    assert [r["title"] for r in gone.collect()] == ["Quite So Dorset", "Good Day Dorset", "New Dorset"]
    assert ids(kept.search("")) == [0, 1, 2, 3] and ids(kept.search("'dorset")) == []
    assert kept.remove()[0] is kept
    one, removed = c.remove_at(0)
    assert removed.first()["title"] == "Old Mill's Tax" and ids(one.search("'dorset")) == [2, 3]
    for wrong in (-1, 99, 1.5, True, None):
        with pytest.raises(SearchError):
            c.remove_at(wrong)
    assert ids(Collection.of(None, index=c.get_index().remove_all([3, 77, 0]), keys=["title"], use_extended_search=True).search("'dorset")) == [2]
    again = c.set_collection(books.where("ref_index = 3").withColumn("ref_index", F.lit(0).cast("long")))
    assert ids(again.search("'dorset")) == [0]


def test_index_round_trip(spark, books, tmp_path):
    index = Index.create(["title", {"name": "tags", "weight": 3}], books)
    index.save(str(tmp_path / "i"))
    loaded = Index.load(spark, str(tmp_path / "i"))
    assert loaded.to_json() == index.to_json() and loaded.size() == 6
    for options in ({"keys": ["title", "tags"]}, {"keys": ["title"]}, {}):
        a = Collection.of(None, index=loaded, include_score=True, **options).search("tax")
        b = Collection.of(None, index=index, include_score=True, **options).search("tax")
        assert a.collect() == b.collect()
    assert [r["v"] for r in loaded.value_at(1, "tags")] == ["crime", "masks"] and loaded.value_at(1, "x") is None
    with pytest.raises(SearchError):
        Collection.of(books, index="no index", keys=["title"])
    with pytest.raises(ValueError):
        Index.create(["title"], books.drop("ref_index"))
    assert '"weight": 3' in keys_to_json(index.keys)
    rows = index.fields().where("key_id = 'tags'").orderBy("ref_index", "arr_idx").collect()
    assert [(r["ref_index"], r["arr_idx"], r["v"], r["n"]) for r in rows][:3] == [(0, 0, "river", 1.0), (0, 1, "tax", 1.0), (1, 0, "crime", 1.0)]


def test_ordinals_follow_the_order(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.lit(5000) - F.col("id")).alias("x"))
    got = with_ordinals(rows, ["x"]).orderBy("x").collect()
    assert [r["ref_index"] for r in got] == list(range(1000))


def test_plugins(strings):
    class Shout(Searcher):
        fuzzy = []

        def __init__(self, pattern, options):
            self.value = pattern.removeprefix("shout:")

        def verdict(self, folded, hits):
            return Verdict(F.contains(folded, F.lit(self.value + "!")), F.lit(0.5))

    use(lambda pattern, options: pattern.startswith("shout:"), Shout)
    try:
        assert ids(Collection.of(strings(["hey", "hey!", "ho!"])).search("shout:hey")) == [1]
    finally:
        matching._plugins.clear()


def test_sharded(books):
    one = Collection.of(books, keys=["title"], include_score=True)
    shards = ShardedCollection(books, keys=["title"], include_score=True, num_workers=3)
    for query in ("dorset", "tax", {"title": "mask"}, ""):
        assert shards.search(query).collect() == one.search(query).collect()
    shards.add(books.where("ref_index = 0").drop("ref_index"))
    assert shards.search("old mill's tax").collect()[1]["ref_index"] == 6
    shards.set_collection(books.where("ref_index < 2"))
    assert shards.index.size() == 2
    shards.terminate()
    with pytest.raises(RuntimeError):
        shards.search("x")


def test_column_function(strings):
    rows = strings(["abxc", "zzz", None])
    got = rows.select(fuzzy_match(F.col("value"), "abc", include_matches=True).alias("m")).collect()
    assert got[0]["m"]["m"] and [(r["start"], r["end"]) for r in got[0]["m"]["r"]] == [(0, 1), (3, 3)] and not got[1]["m"]["m"]
    ops = rows.select(fuzzy_match(F.col("value"), "^ab !q", use_extended_search=True).alias("m")).collect()
    assert ops[0]["m"]["m"] and not ops[1]["m"]["m"] and ops[2]["m"] is None


def test_null_and_empty_tables(spark, strings):
    nothing = strings([]) if False else spark.createDataFrame([], "ref_index long, value string")
    assert ids(Collection.of(nothing).search("a")) == []
    assert ids(Collection.of(strings([None, "a"])).search("a")) == [1]
    assert Collection.of(nothing, use_token_search=True).statistics(["a"]) == (0, {"a": 0})
    assert ids(Collection.of(nothing, keys=["value"]).search({"value": "a"})) == []


def test_ranges_of_operators(strings):
    texts = Collection.of(strings(["a😀abab", "xabx"]), use_extended_search=True, include_matches=True)
    found = {r["ref_index"]: [(x["start"], x["end"]) for x in r["matches"][0]["indices"]] for r in texts.search("'ab").collect()}
    assert found == {0: [(3, 6)], 1: [(1, 2)]}
    suffix = {r["ref_index"]: [(x["start"], x["end"]) for x in r["matches"][0]["indices"]] for r in texts.search("ab$").collect()}
    assert suffix == {0: [(5, 6)]}


def test_shards_release_what_they_replace(spark, books):
    cached = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = cached()
    shards = ShardedCollection(books, keys=["title"], num_workers=3, use_extended_search=True)
    assert ids(shards.search("'dorset")) == [3, 4] and cached() == before + 1
    shards.add(books.where("ref_index = 4"))
    assert ids(shards.search("'dorset")) == [3, 4, 10] and cached() == before + 1
    assert shards.index.frame.rdd.getNumPartitions() == 3
    shards.set_collection(books.where("ref_index < 4"))
    assert ids(shards.search("'dorset")) == [3] and cached() == before + 1
    shards.terminate()
    assert cached() == before
    with pytest.raises(RuntimeError):
        shards.search("x")


def test_loaded_keys_that_were_computed(spark, books, tmp_path):
    key = {"name": "label", "expr": F.concat(F.lit("my "), "title")}
    Index.create([key], books).save(str(tmp_path / "i"))
    more = books.where("ref_index = 0").withColumn("ref_index", F.lit(0).cast("long"))
    with pytest.raises(SearchError, match="label"):
        Index.load(spark, str(tmp_path / "i")).add(more)
    index = Index.load(spark, str(tmp_path / "i"), keys=[key]).add(more)
    assert [r["v"] for r in index.value_at(6, "label")] == ["my Old Mill's Tax"]
    Index.create(["title"], books, get=lambda df, parts: F.upper(parts[0])).save(str(tmp_path / "g"))
    index = Index.load(spark, str(tmp_path / "g"), get=lambda df, parts: F.upper(parts[0])).add(more)
    assert [r["v"] for r in index.value_at(6, "title")] == ["OLD MILL'S TAX"]


def test_functions_of_rows(books):
    key = Key("names", expr=lambda row: [row["title"], row["author"]["lastName"]])
    assert ids(Collection.of(books, keys=[key], use_extended_search=True).search("=olsen")) == [1]
    kept, gone = Collection.of(books, keys=["title"]).remove(lambda item, place: item["year"] is None or place == 0)
    assert [r["title"] for r in gone.collect()] == ["Old Mill's Tax", "Quite So Dorset"] and kept.index.size() == 4


def test_stored_statistics_follow_changes(spark, books, tmp_path):
    options = {"keys": ["title", "tags"], "use_token_search": True, "include_score": True}
    plain, stored = Collection.of(books, **options), Collection.of(books, **options).with_statistics()
    assert stored.statistics(["dorset", "tax", "x"]) == plain.statistics(["dorset", "tax", "x"])
    assert stored.search("dorset tax").collect() == plain.search("dorset tax").collect()
    for change in (lambda c: c.add(books.where("ref_index = 3")), lambda c: c.remove(F.col("item.year") == 1934)[0], lambda c: c.remove_at(0)[0]):
        plain, stored = change(plain), change(stored)
        assert stored.index.words is not None and stored.statistics(["dorset", "tax", "good"]) == plain.statistics(["dorset", "tax", "good"])
        assert sorted(map(tuple, stored.index.words.where("term IS NOT NULL").collect())) == sorted(map(tuple, plain.document_frequency().collect()))
    stored.index.save(str(tmp_path / "w"))
    loaded = Collection.of(None, index=Index.load(spark, str(tmp_path / "w")), **options)
    assert loaded.index.words is not None and loaded.statistics(["dorset"]) == plain.statistics(["dorset"])
    other = Collection.of(None, index=loaded.index, is_case_sensitive=True, **options)
    assert other.statistics(["dorset"])[1] == {"dorset": 0}


def test_a_set_of_queries_in_one_pass(books):
    queries = ["dorset", "  ", "tax", "mask pantr"]
    for options in ({}, {"use_extended_search": True}, {"use_token_search": True, "token_match": "all"}, {"include_matches": True}):
        collection = Collection.of(books, keys=["title", "tags"], include_score=True, **options)
        found = collection.search_all(queries, 3)
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2
        rows = found.collect()
        for n, q in enumerate(queries):
            own = sorted([r for r in rows if r["query"] == n], key=lambda r: (r["score"], r["ref_index"]))
            expected = collection.search(q, 3).collect() if q.strip() else []
            assert [(r["ref_index"], r["score"]) for r in own] == [(r["ref_index"], r["score"]) for r in expected]
    with pytest.raises(ValueError):
        collection.search_all([" "])


def test_tokenizers_must_give_lists_of_strings(books):
    wrong = Collection.of(books, keys=["title"], use_token_search=True, tokenize=lambda t: t.split() if t == "x" else (t,))
    with pytest.raises(Exception, match="list of strings"):
        wrong.search("x").collect()


def test_columns_with_odd_names(spark):
    rows = spark.createDataFrame([("b", 1, 2, 3), ("a", 4, 5, 6)], "v string, __part int, __start int, old int")
    numbered = with_ordinals(rows, ["v"])
    assert [tuple(r) for r in numbered.orderBy("ref_index").select("v", "__part", "__start", "old", "ref_index").collect()] == [("a", 4, 5, 6, 0), ("b", 1, 2, 3, 1)]
