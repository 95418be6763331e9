from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillseek.llm import packing, queries, token_store
from quillseek.llm._tokens import Encoder, batches

VOCABULARY = queries.vocabulary_path()
TEXTS = ["", None, "one", "two words", "x" * 9000, "the quick brown fox " * 2500, "a\n\n b\t c   d", "日本語 テスト", "<|endoftext|> first", "two words", "last <|endoftext|>", "a<|endoftext|><|endoftext|> b", "in<|endoftext|>side <|endoftex|>", "<|endoftext|>"]
DOCS = [(i, t, "en", "src", 0) for i, t in enumerate(TEXTS)] + [(3, "two words", "en", "src", 0), (None, "no id", "en", None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ["bin", "place", "open", "task", "piece", "start", "length", "sequence_id", "offset", "ids_crc32", "_tie", "n_tokens"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(plain):
    random.seed(5)
    odd = ["".join(random.choice(" \n\t ab'1.é 　$") for _ in range(random.randint(0, 40))) for _ in range(3000)]
    odd += ["", " ", "end  ", "x  y  z", "it's  can't 'sx ' s", "\x1c \x1cb", "a" * 5000, "😀 😀"]
    got = Encoder(VOCABULARY).encode(odd)
    assert all(np.frombuffer(g, "<u4").tolist() == plain(t) for g, t in zip(got, odd, strict=True))
    assert list(batches(["ab", "c", "d" * 10, "e"], 10)) == [(0, 3), (3, 4)] and list(batches([])) == []


def test_added_tokens(plain):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "plain", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "<|endoftext|> y " * 500, ""]
    ids = [np.frombuffer(g, "<u4").tolist() for g in Encoder(VOCABULARY).encode(texts)]
    assert ids == [plain(t) for t in texts] and ids[0] == [64, 220, 50256, 275]
    ordinary = Tokenizer.from_file(VOCABULARY)
    ordinary.encode_special_tokens = True
    as_text = Encoder(VOCABULARY, added_as_text=True).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in as_text] == [ordinary.encode(t, add_special_tokens=False).ids for t in texts]


def test_bins_of_all_tasks_and_rounds_have_their_own_ids():
    serials = 1 << packing.SERIAL_BITS
    tasks = [0, 1, 15, 16, 262_143, 262_144, 750_000, (1 << packing.TASK_BITS) - 1]
    firsts = sorted(packing.first_id(level, task) for level in range(16) for task in tasks)
    assert all(b - a >= serials for a, b in zip(firsts, firsts[1:], strict=False)) and firsts[0] >= 0 and firsts[-1] + serials <= 1 << 63
    with pytest.raises(ValueError):
        packing.first_id(0, 1 << packing.TASK_BITS)


def test_tasks_are_read_back_from_ids(spark):
    pairs = [(0, 262_144), (6, 262_143), (1, 0), (15, (1 << packing.TASK_BITS) - 1)]
    rows = spark.createDataFrame([(packing.first_id(*p) + 12_345, p[1]) for p in pairs], "bin long, task long")
    assert rows.where(packing.task_of(rows["bin"]) != rows["task"]).count() == 0


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_best_fit_keeps_to_its_bound_and_fits_best():
    fit = packing.BestFit(10, 2, 0)
    assert [fit.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)] and fit.n_open == 0
    assert [fit.put(n) for n in (9, 8, 8, 1)] == [(2, 0), (3, 0), (4, 0), (4, 8)], "the fullest bin closes"
    random.seed(1)
    fit = packing.BestFit(1024, 64, 0)
    used: dict[int, int] = {}
    for _ in range(5000):
        n = random.randint(1, 1024)
        b, place = fit.put(n)
        assert used.get(b, 0) == place
        used[b] = place + n
        assert used[b] <= 1024 and fit.n_open <= 64


def check_packing(rows, docs, plain, capacity=1024):
    """Every piece of every document once, gapless sequences."""
    expected = {}
    for doc_id, text, *_ in docs:
        ids = plain(text) + [2]
        for n, (start, length) in enumerate(packing.cut(len(ids), capacity)):
            key = (doc_id, n, start, length, crc(ids[start : start + length]))
            expected[key] = expected.get(key, 0) + 1
    got, places = {}, {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == expected
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark, plain):
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    rows = packing.pack(docs, VOCABULARY).collect()
    n = check_packing(rows, DOCS, plain)
    total = sum(r["length"] for r in rows)
    assert n == -(-total // 1024)
    small = packing.pack(docs, VOCABULARY, capacity=16, open_bins=2).collect()
    check_packing(small, DOCS, plain, 16)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
    clashing = docs
    for name in CLASHES:
        clashing = clashing.withColumn(name, F.lit("clash"))
    check_packing(packing.pack(clashing, VOCABULARY).collect(), DOCS, plain)


def test_packing_merges_the_bins_of_many_tasks(spark, plain):
    docs = [(i, "word " * (i % 90), "en", "s", 0) for i in range(600)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(40)
    rows = packing.pack(frame, VOCABULARY).collect()
    n = check_packing(rows, docs, plain)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1


def test_packing_of_a_whole_table(spark, plain):
    found = queries.op1_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    n = check_packing(found, docs, plain)
    lengths = sorted((r["length"] for r in found), reverse=True)
    bins: list[int] = []
    for length in lengths:
        fitting = [b for b in range(len(bins)) if bins[b] >= length]
        if fitting:
            bins[min(fitting, key=bins.__getitem__)] -= length
        else:
            bins.append(1024 - length)
    assert n <= 1.02 * len(bins) + 1


def expected_store(docs, plain):
    keyed = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    out, start = [], 0
    for doc_id, text, *_ in keyed:
        ids = plain(text) + [0]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def as_tuples(rows):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[1])


def test_token_store(spark, plain):
    docs = spark.createDataFrame(DOCS, SCHEMA).withColumn("start", F.lit("clash"))
    assert as_tuples(token_store.round_trip(docs, VOCABULARY).collect()) == expected_store(DOCS, plain)
    assert token_store.round_trip(docs.limit(0), VOCABULARY).count() == 0


def test_token_store_of_a_whole_table(spark, plain):
    found = queries.op8_token_store(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert as_tuples(found) == expected_store([tuple(d) for d in docs], plain)


def test_shards_are_small_and_keyed(spark, plain, tmp_path):
    docs = [(7 * i, f"text number {i} " * (i % 5), "en", "s", 0) for i in range(300)]
    shards = token_store.write(spark.createDataFrame(docs, SCHEMA), VOCABULARY, str(tmp_path), 0, shard_tokens=200, partitions=3).collect()
    assert len(shards) > 3 and sum(s["n_docs"] for s in shards) == 300
    by_id = {d[0]: d[1] for d in docs}
    for s in shards:
        shard = token_store.Shard(s["path"])
        keys = shard.keys()
        for key in keys.tolist():
            (ids,) = shard.get(key)
            assert ids.tolist() == plain(by_id[key]) + [0]
        absent = np.setdiff1d(np.arange(-2000, 4000), keys)
        assert shard.find(absent)[1].sum() == 0
    assert not [p for p in tmp_path.iterdir() if p.name.count(".")]


def test_store_opens_only_the_shard_of_a_key(spark, plain, tmp_path, monkeypatch):
    docs = [(7 * i, f"text number {i} " * (i % 5), "en", "s", 0) for i in range(100)] + [(350, f"again {k} " * 20, "en", "s", 0) for k in range(30)] + [(None, "none", "en", "s", 0)]
    shards = token_store.write(spark.createDataFrame(docs, SCHEMA), VOCABULARY, str(tmp_path), 0, shard_tokens=200, partitions=3)
    store = token_store.Store.of(shards)
    opened, shard = [], token_store.Shard
    monkeypatch.setattr(token_store, "Shard", lambda path: opened.append(path) or shard(path))
    assert [ids.tolist() for ids in store.get(21)] == [plain(docs[3][1]) + [0]] and len(opened) == 1
    assert store.get(22) == [] and store.get(-5) == [] and store.get(10**9) == [] and len(opened) <= 2
    many = store.get(350)
    assert sorted(ids.tolist() for ids in many) == sorted(plain(t) + [0] for i, t, *_ in docs if i == 350) and len(many) == 31
    monkeypatch.setattr(token_store, "OPEN_SHARDS", 2)
    assert all(store.get(d[0]) for d in docs if d[0] is not None) and len(store._open) <= 2


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 63, 1000, 20_000):
        keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
        slots = token_store.PerfectHash.build(keys).slots(keys)
        assert sorted(slots.tolist()) == list(range(n))
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([5, 5], np.uint64))
