from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillseek.llm import _ngrams, chat, licences, mixing, quality, queries, url_filter

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def normal(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    assert normal(tuple(r) for r in found.select(*columns).collect()) == normal(expected.select(*[f'"{c}"' for c in columns]).fetchall())


# -- mixing -------------------------------------------------------------------------------------------------


def test_targets(spark):
    def targets(sizes, weights):
        frame = spark.createDataFrame(list(zip(range(len(sizes)), sizes, map(float, weights), strict=True)), "i int, n long, w double")
        return [r["target"] for r in mixing._targets(frame, mixing.BUDGET, mixing.MOST).orderBy("i").collect()]

    assert targets([100, 100], [1, 1]) == [150.0, 150.0]
    assert targets([10, 1000], [3, 1]) == [20.0, 1495.0]
    assert targets([], []) == [] and targets([0, 10], [3, 1]) == [0.0, 15.0]
    sizes, weights = [5, 50, 500, 5000, 50], [3, 1, 2, 3, 1]
    got = targets(sizes, weights)
    assert math.isclose(sum(got), 1.5 * sum(sizes)) and all(t <= 2 * n for t, n in zip(got, sizes, strict=True))


def mix_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, s string, taken string")


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 4 else "s0", "x", "y", "z") for i in range(900)]
    rows += [(1000, None, "s1", "x", "y", "z"), (1001, "", None, "x", "y", "z"), (1002, "a b", None, "x", "y", "z"), (None, "a b c", "s0", "x", "y", "z"), (None, "d e", "s0", "x", "y", "z"), (5, "w " * 6, "s2", "x", "y", "z")]
    docs = mix_docs(spark, rows)
    found = mixing.plan(docs).taken().collect()
    assert len(found) == len(rows)
    by_target = {}
    for r in found:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by_target.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= 4 or size <= 2
    again = mixing.plan(docs.repartition(5)).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    applied = mixing.apply(docs)
    assert applied.columns == docs.columns
    sizes = {str((r["doc_id"], r["size"])): r["taken"] for r in found if r["doc_id"] is not None}
    counts = {str((r["doc_id"], r["n"])): r["rows"] * r["n"] for r in applied.withColumn("n", mixing.size_of(F.col("text"))).groupBy("doc_id", "n").count().withColumnRenamed("count", "rows").collect() if r["doc_id"] is not None}
    repeated = str((5, 6))
    assert all(counts.get(k, 0) == v for k, v in sizes.items() if k != repeated)
    assert mixing.plan(docs.limit(0)).taken().count() == 0 and mixing.apply(docs.limit(0)).count() == 0


def test_mix_nests(spark):
    rows = [(i, "w " * 3, "s", "x", "y", "z") for i in range(500)]
    takes = []
    for budget in (0.2, 0.5, 0.8, 1.3):
        found = mixing.plan(mix_docs(spark, rows), (1,), budget).taken().collect()
        takes.append({r["doc_id"]: r["taken"] for r in found})
        assert abs(sum(takes[-1].values()) - budget * 1500) <= 3
    for small, large in zip(takes, takes[1:], strict=False):
        assert all(large[k] >= v for k, v in small.items())


# -- quality ------------------------------------------------------------------------------------------------


def test_ngrams_against_words():
    texts = ["Ab c  ab", "", "  ", "x", "ab C abé x y\n", "日本 語"]
    hashes, counts = _ngrams.words(texts)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert counts.tolist() == [len(t.encode().split()) for t in texts] and len(hashes) == len(words)
    seen = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    buckets, n = _ngrams.features(texts, 10)
    assert n.tolist() == [max(0, 2 * c - 1) for c in counts.tolist()] and len(buckets) == n.sum() and buckets.max() < 1024
    assert _ngrams.features([], 10)[0].tolist() == []


def quality_rows():
    rng = np.random.default_rng(1)
    good = [f"g{i}" for i in range(200)] + ["and", "the"]
    bad = [f"b{i}" for i in range(200)] + ["$$$", "the"]
    rows, labels = [], []
    for i in range(600):
        is_good = i % 5 > 0
        rows.append((i, " ".join(rng.choice(good if is_good else bad, 60)), "en", "s", 0))
        if i % 2:
            labels.append((i, int(is_good), 0))
    return rows, labels


def test_classifier_on_held_out_labels(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows + [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (None, rows[1][1], "en", "s", 0)], "doc_id long, text string, lang string, kept string, weight int")
    frame = spark.createDataFrame(labels + [(3, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.classify(docs, frame).collect()}
    unlabelled = [i for i in range(600) if i % 2 == 0]
    right = sum(found[i]["kept"] == (i % 5 > 0) for i in unlabelled)
    assert right >= 0.97 * len(unlabelled) and found[9000]["kept"] and found[9000]["weight"] == 0
    stays = quality.keep_good(docs, frame)
    assert stays.columns == docs.columns and {r["doc_id"] for r in stays.collect()} == {i for i, r in found.items() if r["kept"]}
    assert quality.keep_good(docs, frame.limit(0)).count() == docs.count() and quality.keep_good(docs.limit(0), frame).count() == 0


def test_weights_against_brute_force(spark):
    rows, labels = quality_rows()
    rows = rows[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = {r["doc_id"]: r for r in quality.labelled(frame).collect()}
    buckets = {i: _ngrams.features([t], quality.BITS)[0] for i, t, *_ in rows}
    raw, target = np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS)
    for i, b in buckets.items():
        np.add.at(raw, b, 1)
        if i in sample and sample[i]["good"] and sample[i]["fit"]:
            np.add.at(target, b, 1)
    ratio = np.log((target + quality.SMOOTHING) / (raw * target.sum() / raw.sum() + quality.SMOOTHING))
    weights = {i: ratio[b].sum() / (len(b) + quality.NEUTRAL) for i, b in buckets.items()}
    # The lowest weight at which few enough held-out good documents are lost and the fewest bad ones pass.
    held = [(weights[i], r["good"]) for i, r in sample.items() if i in weights and not r["fit"]]
    good, bad = [w for w, g in held if g], [w for w, g in held if not g]
    costs = [(sum(w < at for w in good) / len(good) + sum(w >= at for w in bad) / len(bad), at) for at in sorted(good) if sum(w < at for w in good) <= (1 - quality.KEEP_GOOD) * len(good)]
    k = sum(w >= min(costs)[1] - 1e-12 for w in weights.values())
    noises = {r["doc_id"]: r["noise"] for r in docs.select("doc_id", quality.noise(F.col("doc_id")).alias("noise")).collect()}
    keys = {i: w / quality.TEMPERATURE + noises[i] for i, w in weights.items()}
    drawn = set(sorted(keys, key=keys.get, reverse=True)[:k])
    assert 0 < k < len(rows)
    for r in quality.classify(docs, frame).collect():
        i = r["doc_id"]
        assert r["n_features"] == len(buckets[i]) and math.isclose(r["weight"], weights[i], rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r["key"], keys[i], rel_tol=1e-9) and r["kept"] == (i in drawn)
    assert {r["doc_id"] for r in quality.keep_good(docs, frame).collect()} == drawn


def test_weights_do_not_depend_on_the_batch(spark):
    rows = [(i, "word " * n, "x" * 50_000 if i == 3 else "y") for i, n in enumerate([0, 1, 700, 40_000, 3, 9])]
    ratios = np.random.default_rng(2).standard_normal(1 << quality.BITS)
    texts = [t for _, t, _ in rows] + [f"w{i} w{i * 7 % 31}" for i in range(600)]
    together = quality._weights(texts, ratios, quality.BITS)[0]
    assert [quality._weights([t], ratios, quality.BITS)[0][0] for t in texts] == together.tolist()
    found = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", quality.weight_of(spark, ratios)(F.col("text")).alias("w")).orderBy("i")
    assert [r["w"] for r in found.collect()] == together.tolist()


def test_sample_of_labels_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert 700 < quality.labelled(labels, 1000).count() < 1300 and quality.labelled(labels, 5000).count() == 5000


def test_top_k(spark):
    rng = np.random.default_rng(3)
    keys = np.round(rng.standard_normal(2000) * 50, 1).tolist()
    scored = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 2, 700, 1999, 2000):
        assert quality.top_k(scored, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.top_k(spark.createDataFrame([(1.5,)] * 10, "key double"), 4) == 1.5


def test_noise_is_gumbel(spark):
    values = [r[0] for r in spark.range(20000).select(quality.noise(F.col("id"))).collect()]
    assert abs(np.mean(values) - 0.5772) < 0.05 and abs(np.std(values) - math.pi / math.sqrt(6)) < 0.05


# -- licences -----------------------------------------------------------------------------------------------


def brute_licence(text):
    units = (text or "").split("\n")
    blocks = __import__("re").split(licences.BLANK_LINE, text or "")
    units += [b for b in blocks if "\n" in b] + ([text] if len(blocks) > 1 else [])
    best, n = (0.0, None), 0
    for unit in units:
        a = set(licences.bigrams(unit))
        scores = [(2 * len(a & set(g)) / (len(a) + len(g)), name) for name, g in licences.template_grams() if a or g]
        scores = [s for s in scores if s[0] >= licences.THRESHOLD]
        n += bool(scores)
        best = max([best, *scores], key=lambda s: (s[0], s[1] or ""))
    return best[1], best[0], n


def test_licences_against_brute_force(spark):
    mit = dict((n, t) for n, t in licences.TEMPLATES if len(t) > 300)["MIT"]
    texts = [
        None, "", "x", "Released under the MIT License.", "released UNDER the mit licence", "intro\nLicensed under CC BY-NC 4.0.\nend",
        mit, "Copyright me\n\n" + mit.replace(", ", ",\n") + "\n\nTHE SOFTWARE IS PROVIDED AS IS", "word " * 30_000, mit[:100], "License License License", "a\n\nb\n \nc",
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, texts[3])], "doc_id long, text string").withColumn("licence", F.lit("clash"))
    found = licences.scan(docs).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        text = texts[r["doc_id"] if r["doc_id"] is not None else 3]
        name, dice, n = brute_licence(text)
        assert (r["licence"], r["n_matches"]) == (name, n) and math.isclose(r["dice"], dice)
    assert licences.scan(docs.limit(0)).count() == 0
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    whole = {r["doc_id"]: (r["licence"], r["n_matches"]) for r in queries.op6_licence_scan(spark, SF).collect()}
    assert whole == {d["doc_id"]: brute_licence(d["text"])[::2] for d in table}


def test_licences_within_lines(spark):
    long = dict((n, t) for n, t in licences.TEMPLATES if len(t) > 200)
    cc = "This work is licensed under a Creative Commons Attribution 4.0 International License."
    prose = " ".join(f"word{i}" for i in range(60))
    texts = [
        ("Foo bar baz. Released under the MIT License.", "MIT", 1.0, 1),
        (f"Hello there everyone. {cc} Bye for now.", "CC-BY-4.0", 0.8, 1),  # the line itself, just
        (f"Hello there, everyone here. {cc} Bye for now.", "CC-BY-4.0", 1.0, 1),
        (f"{prose} released under the MIT license {prose}", "MIT", 1.0, 1),
        (f"{prose} {long['GPL-3.0']} {prose}\n{prose} {long['BSD-2-Clause'].replace(' source ', ' Source') } {prose}", "GPL-3.0", 1.0, 2),
        (f"{prose}\n{prose} {long['MIT'].replace(', ', chr(10))} {prose}", "MIT", 1.0, 1),
        (f"{prose} {long['ISC'].replace('hereby', 'hereby and gladly')} {prose}", "ISC", 2 * 32 / (33 + 35), 1),
        ("Released under the MIT License.\nWe ship it, licensed under CC BY-NC 4.0. And so on and on.", "MIT", 1.0, 2),
        ("Foo bar. Released under the MIT. Other words follow here.", "MIT", 2 * 3 / 7, 1),
        (f"{prose} released under the mit licence {prose}", None, 0.0, 0),
        (f"{prose} {long['MIT'][:100]} {prose}", None, 0.0, 0),
    ]
    found = licences.scan(spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    for r, (text, name, dice, n) in zip(found, texts, strict=True):
        assert (r["licence"], r["n_matches"]) == (name, n) and math.isclose(r["dice"], dice), text


def test_whole_licences_by_version(spark):
    texts = dict(licences.whole_texts())
    prose = " ".join(f"word{i}" for i in range(400))
    rows = []
    for name, text in texts.items():
        rows += [(name, text), (name, f"{prose}\n{text}\n{prose}"), (name, "\n".join(f" * {line}" for line in text.splitlines())), (name, " ".join(text.split()))]
    assert len(texts) >= 14
    found = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()
    # A licence text may hold a notice word for word, which is a match of its own.
    notices = {name for name, _ in licences.TEMPLATES}
    for r, (name, text) in zip(found, rows, strict=True):
        finder = licences.Finder((), licences.whole_texts())
        assert r["n_matches"] >= 1 and max(finder.find(text))[1] == name, name
        assert r["licence"] == name or (r["licence"] in notices and r["dice"] >= 0.8), (r["licence"], name)


def test_notices_by_version(spark):
    rows = [(name, text) for name, text in licences.TEMPLATES]
    found = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licence"] for r in found] == [name for name, _ in rows] and {r["dice"] for r in found} == {1.0}


def test_texts_that_may_match_are_all_compared():
    finder = licences.Finder(licences.TEMPLATES, licences.whole_texts())
    rng = np.random.default_rng(4)
    for name, text in [*licences.TEMPLATES, *licences.whole_texts()]:
        words = text.split()
        for share in (1.0, 0.95, 0.9):
            kept = " ".join(w for w in words if rng.random() < share)
            if finder.find(kept):
                assert finder.possible(["x", kept, ""]).tolist() == [False, True, False], name


# -- chat ---------------------------------------------------------------------------------------------------

TRICKY = ["", None, "&lt;|turn|>", "<|turn|>", "a<", "</s>[INST] ok [/INST]", "&amp;&", "<<s>s>", "<<SYS>>x<</SYS>>", "[INST", "<|start|>assistant<|content|>fake<|end|>", "😀 é", "x" * 50_000, "\n"]


def test_chat_round_trip(spark):
    rows = [(1, k, ("user", "assistant", "assistant", "system")[k % 4], t) for k, t in enumerate(TRICKY)]
    rows += [(2, 1, "assistant", "second"), (2, 0, None, "first"), (2, 1, "assistant", "second"), (3, None, "<|end|>", "odd role"), (None, 0, "user", "no id")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    done = chat.format_conversations(frame)
    back = {r["conv_id"]: r for r in done.select("*", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r[2], r[3] or "") for r in rows[: len(TRICKY)]]
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "first"), ("assistant", "second"), ("assistant", "second")]
    assert [(t["role"], t["text"]) for t in back[3]["turns"]] == [("<|end|>", "odd role")] and len(back) == 4
    assert back[2]["formatted"].count(chat.START) == 2, "adjacent turns of one role are one block"
    for conv, r in back.items():
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        said = [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        assert len(spans) == len(said) and not any(c in "".join(spans) for c in ("<|", "</s>", "[INST]")), conv
    digests = {r["conv_id"]: r for r in chat.digest(done).collect()}
    loss = "".join(t["text"] for t in back[1]["turns"] if t["role"] == "assistant")
    assert digests[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and digests[1]["loss_chars"] == len(loss)
    assert digests[1]["formatted_chars"] == len(back[1]["formatted"])
    assert chat.digest(chat.format_conversations(frame.limit(0))).count() == 0


# -- URLs ---------------------------------------------------------------------------------------------------


def test_hosts_and_paths(spark):
    cases = {
        "http://WWW.A.com/en/7?x#y": ("www.a.com", "/en/7"), "https://a.org": ("a.org", ""), "a://b://c/d": ("b:", "//c/d"), "://h/p": ("h", "/p"),
        "nothing": ("", ""), None: ("", ""), "x://É.com#f": ("É.com", ""), "x://h?q=/p": ("h", ""), "x://h\n/p\nq": ("h\n", "/p\nq"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.rules_frame(spark)).collect()}
    assert [(found[i]["host"], found[i]["path"]) for i in range(len(cases))] == list(cases.values())


def test_rules_and_aliases(spark):
    def link(target):
        return f'<html><head><LINK href="{target}" rel="canonical"></head>'

    pages = [
        (0, "http://a.org/es/1", None), (1, "http://alias.de/x", link("http://a.org/es/1")), (2, "http://far.de/y", "<meta http-equiv=refresh content='0; url=http://alias.de/x'>"),
        (3, "http://example.com/en/7", link("http://a.org/es/1")), (4, "http://q.example.com/en/8", ""), (5, "http://x.net/de/8", ""), (6, "http://example.net/de/8", ""),
        (7, "http://notexample.net/de/8", ""), (8, "http://plain.de/", link("/other")), (9, "http://rel.de/a/b", link("c?d=1&amp;e=2")), (10, None, None), (11, "http://ALIAS.de/x#frag", ""), (0, "http://a.org/es/1", None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    rows = url_filter.judge(frame, url_filter.rules_frame(spark)).collect()
    found = {r["page_id"]: r for r in rows}
    assert len(rows) == len(pages)
    assert [(found[i]["rule"], found[i]["verdict"]) for i in range(12)] == [
        ("org/es/", "block"), (None, "block"), (None, "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"),
        ("net/de/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"),
    ]
    assert found[1]["component"] == found[2]["component"] == found[0]["component"]
    edges = {(r["a"], r["b"]) for r in url_filter.edges_of(frame).collect()}
    assert ("http://plain.de/", "http://plain.de/other") in edges and ("http://rel.de/a/b", "http://rel.de/a/c?d=1&e=2") in edges
    assert url_filter.judge(frame.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_aliases_against_brute_force(spark):
    """Canonical links, refreshes, relative and chained targets, over random pages."""
    from urllib.parse import urljoin

    rng = np.random.default_rng(12)
    hosts = ["a.com", "www.example.com", "b.net", "example.net", "c.org", "d.de", "e.de", "f.fr"]
    paths = ["/", "/en/1", "/en/7", "/de/8", "/es/2", "/x/y", "/x/z"]
    pick = lambda values: values[rng.integers(len(values))]
    rows, links = [], []
    for i in range(300):
        url = f"http://{pick(hosts)}{pick(paths)}?k={rng.integers(6)}"
        kind, target = rng.integers(6), pick([f"http://{pick(hosts)}{pick(paths)}?k={rng.integers(6)}", pick(paths), "y?a=1&amp;b=2", f"//{pick(hosts)}/es/2"])
        html = None
        if kind == 0:
            html = f"<html><head><link rel='canonical' href='{target}'></head>"
        elif kind == 1:
            html = f'<META content="5; URL={target}" HTTP-EQUIV="refresh">'
        elif kind == 2:
            html = f"<link rel=stylesheet href={target}><p>canonical</p>"
        if kind < 2:
            links.append((url, urljoin(url, target.replace("&amp;", "&"))))
        rows.append((i, url, html))

    def rule_of(url):
        host, _, rest = url.partition("://")[2].partition("/")
        path = ("/" + rest).split("?")[0]
        fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    groups = {u: {u} for pair in links for u in pair}
    for a, b in links:
        whole = groups[a] | groups[b]
        for u in whole:
            groups[u] = whole
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), url_filter.rules_frame(spark)).collect()
    assert len(found) == len(rows)
    by_alias = 0
    for r in found:
        url = rows[r["page_id"]][1]
        rule, verdict = rule_of(url)
        blocked = any(rule_of(u)[1] == "block" for u in groups.get(url, ()))
        assert (r["rule"], r["verdict"]) == (rule, verdict or ("block" if blocked else "allow")), url
        by_alias += verdict is None and blocked
    assert by_alias > 10
