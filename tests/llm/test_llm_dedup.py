from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from quillseek.llm import _graph, exact_dedup, neighbours, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, component_id string, kept string"


def docs_of(spark, rows):
    """Documents with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, "c", "no") for i, t in rows], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("last", [0, 30, 200_000])
@pytest.mark.parametrize("shape", ["chain", "star", "cycle", "random", "one", "none"])
def test_components(spark, monkeypatch, shape, last):
    monkeypatch.setattr(_graph, "LAST_EDGES", last)
    random.seed(3)
    pairs = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(30, i) for i in range(60) if i != 30],
        "cycle": [(i, (i + 1) % 40) for i in range(40)] + [(50, 51)],
        "random": [(random.randrange(200), random.randrange(200)) for _ in range(150)],
        "one": [(5, 2), (2, 5), (3, 3)],
        "none": [],
    }[shape]
    found = _graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(4))
    got = {r["node"]: r["component"] for r in found.collect()} if pairs else {}
    expected = union_find(200, pairs)
    for node, component in got.items():
        assert component == expected[node]
    for node in {x for p in pairs if p[0] != p[1] for x in p}:
        assert got.get(node, node) == expected[node]
    assert found.count() == len(got)


ROWS = [(1, "Same Text"), (9, "same text"), (4, "SAME TEXT"), (2, "other"), (3, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 200_000), (10, "X" * 200_000), (2, "other"), (2, "different"), (None, "same text"), (None, "alone")]


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return sorted((str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("bits", [64, 6, 2])
def test_exact_groups(spark, bits):
    found = exact_dedup.build(docs_of(spark, ROWS), bits=bits, bucket_keys=2).result().collect()
    assert sorted((str(r["_id"]), str(r["keep_id"]), r["group_size"], bytes(r["sha"]).hex()) for r in found) == expected_groups(ROWS)


def test_exact_kept(spark):
    rows = exact_dedup.groups(docs_of(spark, ROWS)).collect()
    assert sum(r["kept"] for r in rows) == len({lower(t) for _, t in ROWS})
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows if r["doc_id"] not in (2, None))
    docs = docs_of(spark, ROWS)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), lower(r["text"])) for r in kept.collect()) == sorted((str(i), t) for i, t in {(9, "same text"), (2, "other"), (2, "different"), (5, ""), (6, "É"), (7, "é"), (10, "x" * 200_000), (None, "alone")})
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0 and exact_dedup.groups(docs.limit(0)).count() == 0


def keys_frame(spark, leading):
    """Distinct keys with the given three leading bits, numbered in the next eight."""
    rows = [(lead << 61) + (i << 53) for lead, n in leading.items() for i in range(n)]
    return spark.createDataFrame([(k - (1 << 64) if k >> 63 else k, 1) for k in rows], "key long, n long")


def test_directory_doubles_while_a_slot_is_overfull(spark):
    leading = {0: 30, 1: 1, 4: 5, 7: 5}
    found = {n: exact_dedup.directory(keys_frame(spark, leading), bucket_keys=n) for n in (10, 30, 100)}
    assert {n: depth for n, (depth, _) in found.items()} == {10: 8, 30: 3, 100: 0}
    assert sorted(map(tuple, found[30][1].collect())) == [(0, 0, 30), (1, 1, 1), (4, 4, 10), (7, 4, 10)]
    assert list(map(tuple, found[100][1].collect())) == [(0, 0, 41)]
    buckets = {r["bucket"]: r["n"] for r in found[10][1].collect()}
    assert sum(buckets.values()) == 41 and max(buckets.values()) == 10 and sorted(buckets.values())[-4:] == [8, 8, 8, 10]
    assert exact_dedup.directory(keys_frame(spark, {}))[1].count() == 0


def test_directory_has_no_limit_of_twelve_doublings(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 40_000, dtype=np.int64))
    frame = spark.createDataFrame([(int(k), 1) for k in keys], "key long, n long")
    depth, slots = exact_dedup.directory(frame, bucket_keys=2)
    rows = slots.collect()
    assert depth > 12 and max(r["n"] for r in rows) <= 2
    unsigned = np.sort(keys.view(np.uint64))
    held = {int(r["bucket"]): r["n"] for r in rows}
    bucket = {r["slot"]: r["bucket"] for r in rows}
    counts: dict = {}
    for k in unsigned.tolist():
        counts[bucket[k >> (64 - depth)]] = counts.get(bucket[k >> (64 - depth)], 0) + 1
    assert counts == held


def test_lookups_go_through_the_directory(spark):
    rows = [(i, f"text {i % 50}") for i in range(200)]
    index = exact_dedup.build(docs_of(spark, rows), bucket_keys=5)
    assert index.depth >= 3 and {r["group_size"] for r in index.result().collect()} == {4}
    index.slots = index.slots.withColumn("bucket", index.slots["bucket"] + 1)
    assert {r["group_size"] for r in index.result().collect()} == {1}, "another bucket has no entry"


def test_index_chains_texts_that_share_a_key(spark):
    index = exact_dedup.build(docs_of(spark, ROWS), bits=2, bucket_keys=2)
    entries = index.entries.collect()
    chains: dict = {}
    for r in entries:
        chains.setdefault((r["bucket"], r["key"]), []).append((r["chain"], bytes(r["sha"])))
    assert all(len({c for c, _ in v}) == len({s for _, s in v}) == len(v) for v in chains.values()) and len(entries) > len(chains)


def test_equal_digests_of_different_texts_are_an_error(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest_of", lambda norm: F.unhex(F.sha2(F.substring(norm, 1, 4), 256)))
    monkeypatch.setattr(exact_dedup, "key_of", lambda norm, bits=64: F.xxhash64(F.substring(norm, 1, 4)))
    with pytest.raises(Exception, match="share a key"):
        exact_dedup.build(docs_of(spark, [(1, "same one"), (2, "same two")])).result().collect()


def test_a_text_with_very_many_copies(spark):
    rows = [(i, "hot") for i in range(3000)] + [(2999, "hot"), (2999, "HOT")] + [(5000 + i, f"t{i // 2}") for i in range(60)]
    docs = docs_of(spark, rows)
    kept = exact_dedup.drop_copies(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [2999, *range(5001, 5060, 2)]


def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        words = random.choices(vocabulary, k=400)
        for copy in range(6):
            changed = list(words)
            for _ in range(copy):
                changed[random.randrange(400)] = random.choice(vocabulary)
            rows.append((base * 10 + copy + 1, " ".join(changed)))
    return rows + [(500, ""), (501, None), (502, " \t"), (503, "one"), (504, "ONE"), (505, "two words"), (506, "a b c"), (507, "x " * 50_000), (508, "x " * 50_000)]


def test_simhash_against_brute_force(spark):
    rows = near_rows()
    prints = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = union_find(len(rows), pairs)
    expected = {rows[i][0]: (f"{prints[i]:016x}", min(rows[k][0] for k in range(len(rows)) if roots[k] == roots[i])) for i in range(len(rows))}
    found = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == expected and len(found) == len(rows)
    docs = docs_of(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in expected.values()})


def test_simhash_edge_cases(spark):
    assert simhash.near_duplicates(docs_of(spark, [(1, "a")]).limit(0)).count() == 0
    repeated = docs_of(spark, [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "q r s t u")])
    kept = sorted(str(r["doc_id"]) for r in simhash.keep_one(repeated).collect())
    assert kept == ["1", "None", "None"]


@pytest.mark.parametrize("small_cell", [64, 2])
def test_links_find_every_pair_of_dense_clusters(spark, monkeypatch, small_cell):
    monkeypatch.setattr(simhash, "SMALL_CELL", small_cell)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(40):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frames = list(simhash._links(iter([_cells_frame(signed)]), 3))
    at = {s: i for i, s in enumerate(signed)}
    got = [(at[a], at[b]) for f in frames for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True)]
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in got)
    assert union_find(len(prints), got) == union_find(len(prints), pairs)


def _cells_frame(signed):
    import pandas as pd

    rows = []
    for s in signed:
        x = s & ((1 << 64) - 1)
        for half in range(2):
            h = x >> (32 * half) & 0xFFFFFFFF
            cell = (h - (h >> 1 & 0x55555555)) + (half << 32)
            rows.append((cell, True, s))
            rows += [(cell + (1 << 2 * i), False, s) for i in range(16) if cell >> 2 * i & 3 < 2]
    return pd.DataFrame(rows, columns=["cell", "own", "fp"]).sort_values(["cell", "own"], ascending=[True, False], ignore_index=True)


def vectors():
    rng = np.random.default_rng(8)
    rows = []
    for size, spread in ((40, 0.02), (30, 0.05), (2, 0.03), (3, 0.03), (25, 0.2)):
        centre = rng.standard_normal(32)
        rows += [(centre + spread * rng.standard_normal(32)).astype(np.float32).tolist() for _ in range(size)]
    rows += [rng.standard_normal(32).astype(np.float32).tolist() for _ in range(300)]
    rows += [rows[0]] * 20 + [rows[200]] * 2
    return rows


def test_nn_descent_against_brute_force(spark):
    rows = vectors()
    x = np.array(rows, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    roots = union_find(len(rows), np.argwhere(near).tolist())
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] * 32), (1004, [None] * 32), (1005, [float("inf")] * 32), (1006, rows[0][:5]), (None, rows[0][:6])]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)] + odd, "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r for r in neighbours.near_duplicates(table).collect()}
    assert len(found) == len(rows) + len(odd)
    links = sum(found[i]["n_links"] for i in range(len(rows)))
    assert links >= 0.995 * near.sum() and all(found[i]["n_links"] <= near[i].sum() for i in range(len(rows)))
    assert [found[i]["component_id"] for i in range(len(rows))] == roots
    assert all(found[i]["kept"] == (roots[i] == i) for i in range(len(rows)))
    for i, _ in odd:
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, i, True)
    assert neighbours.near_duplicates(table.limit(0)).count() == 0


def test_long_lists_are_enlarged(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 8)
    monkeypatch.setattr(neighbours, "TABLES", 2)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(24)
    rows = [(i, (centre + 0.02 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(120)]
    found = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["n_links"] for r in found} == {119} and {r["component_id"] for r in found} == {0}


def test_a_cluster_beyond_every_limit_is_whole(spark, monkeypatch):
    for name, value in (("LIST", 4), ("TABLES", 2), ("BLOCK", 16), ("BUCKET", 8)):
        monkeypatch.setattr(neighbours, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rng = np.random.default_rng(9)
        centre = rng.standard_normal(24)
        rows = [(centre + 0.22 * rng.standard_normal(24)).tolist() for _ in range(300)] + [rng.standard_normal(24).tolist() for _ in range(50)]
        x = np.array(rows)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
        table = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(5)
        found = {r["vec_id"]: r for r in neighbours.near_duplicates(table).collect()}
        assert 0 < near.sum() < 299 * 300
        assert [found[i]["n_links"] for i in range(len(rows))] == near.sum(axis=1).tolist()
        assert [found[i]["component_id"] for i in range(len(rows))] == union_find(len(rows), np.argwhere(near).tolist())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dense_groups_give_no_more_rows_than_vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16) + 0.01 * rng.standard_normal((500, 16))
    group = (np.arange(500), np.ones(500, np.int64), x / np.linalg.norm(x, axis=1, keepdims=True))
    import pandas as pd

    found = pd.concat(neighbours._lists(0.8, 0.95, 10)(group, group))
    assert (~found["link"]).sum() == 5000 and found["link"].sum() == 499
    half = tuple(v[:200] for v in group), tuple(v[200:] for v in group)
    found = pd.concat(neighbours._lists(0.8, 0.95, 10)(*half))
    assert found["link"].sum() == 499 and (~found["link"]).sum() == 5000
    counted = pd.concat([*neighbours._degrees(0.95)(*half), *neighbours._degrees(0.95)(half[0], half[0]), *neighbours._degrees(0.95)(half[1], half[1])])
    assert (counted.groupby("nid")["links"].sum() == 499).all()


@pytest.mark.parametrize("count", [100, 80_000, 1_000_000, 10_000_000, 1_000_000_000])
def test_pairs_at_the_threshold_are_seeded_at_any_size(count):
    bits = neighbours.bits_for(count)
    same = 1 - np.arccos(neighbours.THRESHOLD) / np.pi
    assert 1 - (1 - same**bits) ** neighbours.tables_for(bits) >= 0.999


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    rows = [centre + 0.01 * rng.standard_normal(64) for _ in range(200)]
    for _ in range(20):
        a = rng.standard_normal(64)
        rows += [a, a + 0.01 * rng.standard_normal(64)]
    nodes = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(rows)], "nid long, n long, embedding array<double>")
    group = [(a, 199) for a in range(200)]
    pairs = [(a, 1) for a in range(200, 240)]
    assert neighbours._audit(nodes, spark.createDataFrame(group, "nid long, links long"), 0.95, 2048) == pytest.approx(200 / 240)
    assert neighbours._audit(nodes, spark.createDataFrame(group + pairs, "nid long, links long"), 0.95, 2048) == 1


def dense_group(spark, size):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(24)
    rows = [(i, 1, (centre + 0.02 * rng.standard_normal(24)).tolist()) for i in range(size)]
    return spark.createDataFrame(rows, "nid long, n long, embedding array<double>").repartition(4)


def test_all_blocks_of_a_large_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "LIST", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        nodes = dense_group(spark, 150)
        seeded = neighbours._seed(nodes, range(3), 1, 4).select("a", "b").distinct()
        by_side = [neighbours._bucket_partition(range(t, t + 1), 1) for t in range(3)]
        frame = nodes.toPandas()
        expected = set()
        for side in by_side:
            for cells in side(iter([frame])):
                for _, cell in cells.groupby("cell"):
                    ids = sorted(cell["nid"])
                    expected.update((a, b) for b in ids for a in ids if a != b)
        assert {(r["a"], r["b"]) for r in seeded.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_links_are_whole_when_audits_fail(spark, monkeypatch):
    """Nothing is seeded, so nothing is refined: the audit sees it and all blocks are compared."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "_seed", lambda nodes, *_: nodes.sparkSession.createDataFrame([], neighbours.LISTED))
    comp, links, recall = neighbours.graph(dense_group(spark, 120))
    assert recall == 1 and {(r["nid"], r["links"]) for r in links.collect()} == {(i, 119) for i in range(120)}
    assert {(r["node"], r["component"]) for r in comp.collect()} == {(i, 0) for i in range(1, 120)}


def test_saturated_lists_have_twice_the_room_in_the_next_round(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 4)
    longest, trimmed = [], neighbours._trimmed
    monkeypatch.setattr(neighbours, "_trimmed", lambda entries, most: longest.append(most) or trimmed(entries, most))
    neighbours.graph(dense_group(spark, 100))
    assert {4, 8, 16} <= set(longest)


def test_queries_run(spark):
    for query in (queries.op2_embedding_near_dedup, queries.op5_exact_dedup, queries.op10_simhash_near_dedup):
        assert query(spark, "/root/testdata/sf0.001").count() > 0


def test_simhash_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    prints = {d["doc_id"]: fingerprint(d["text"]) for d in docs}
    found = queries.op10_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in found} == prints
    order = sorted(prints)
    pairs = [(i, j) for i in range(len(order)) for j in range(i) if (prints[order[i]] ^ prints[order[j]]).bit_count() <= 3]
    roots = union_find(len(order), pairs)
    assert {r["doc_id"]: r["component_id"] for r in found} == {order[i]: order[roots[i]] for i in range(len(order))}


def shingles(text, width=5):
    words = lower(text).split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def similar_roots(texts):
    sets = [shingles(t) for t in texts]
    return union_find(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9])


def edited_rows():
    rng = random.Random(21)
    vocabulary = [f"word{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = []
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.choice([60, 150, 400]))
        for copy in range(5):
            changed = list(words)
            for _ in range(copy * len(words) // 150):
                changed[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((base * 10 + copy + 1, " ".join(changed)))
    return rows + [(500, ""), (501, None), (502, " \t"), (503, "one"), (504, "ONE  "), (505, "two words"), (506, "x " * 50_000), (507, "x " * 40_000), (508, "É é"), (509, "é é")]


def test_similar_texts_against_brute_force(spark):
    rows = edited_rows()
    roots = similar_roots([t for _, t in rows])
    expected = {rows[i][0]: rows[r][0] for i, r in enumerate(roots)}
    docs = docs_of(spark, rows)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert len(set(expected.values())) < len(rows) - 60 and found == expected
    kept = simhash.keep_dissimilar(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))
    assert simhash.keep_dissimilar(docs.limit(0)).count() == 0


def test_large_groups_of_similar_texts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMPARED", 8)
    monkeypatch.setattr(simhash, "SMALL_CELL", 8)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(90):
        changed = list(words)
        changed[rng.randrange(300)] = f"v{i}"
        rows.append((i, " ".join(changed)))
    found = simhash.similar(docs_of(spark, rows + [(900, "something else")])).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {**dict.fromkeys(range(90), 0), 900: 900}


def test_word_fingerprints_do_not_depend_on_other_texts():
    texts = [t or "" for _, t in edited_rows()[:40]] + ["", "a"]
    together = simhash.word_fingerprints(texts, 3)
    assert all((simhash.word_fingerprints([t], 3)[0] == p).all() for t, p in zip(texts, together, strict=True))


def test_the_filter_of_cells_comes_as_few_rows(spark, monkeypatch):
    """The driver gets at most one row of a partition, not one of each word that is set."""
    rng = np.random.default_rng(3)
    prints = rng.integers(-(1 << 63), (1 << 63) - 1, (3000, 2))
    nodes = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(prints)], "nid long, p0 long, p1 long")
    got = []
    for name in ("collect", "toPandas"):
        plain = getattr(type(nodes), name)

        def counted(self, plain=plain):
            out = plain(self)
            got.append(len(out))
            return out

        monkeypatch.setattr(type(nodes), name, counted)
    pairs = simhash.candidates(nodes, 2)
    assert sum(got) <= 4
    assert simhash.candidates(nodes.limit(0), 2).count() == 0

    occupied = simhash._occupied(nodes, 2)
    expected = np.zeros_like(occupied)
    for p in prints.astype(np.int64).view(np.uint64):
        for table, x in enumerate(p.tolist()):
            for half in range(2):
                y = x >> 32 * half & 0xFFFFFFFF
                cell = y - (y >> 1 & 0x55555555) + (2 * table + half << 32)
                word, bit = simhash._place_in_filter(np.array([cell], np.uint64))
                expected[word] |= bit
    assert (occupied == expected).all()
    near = nodes.unionByName(nodes.limit(50).selectExpr("nid + 10000 AS nid", "p0 ^ 7 AS p0", "p1"))
    assert {(r["a"], r["b"]) for r in simhash.candidates(near, 2).collect()} == {(i, i + 10000) for i in range(50)} | {(r["a"], r["b"]) for r in pairs.collect()}
