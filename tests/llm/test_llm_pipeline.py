from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from quillseek.llm._shared import materialise

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, materialise(stage(spark, out[-1][1], SF), "stage")))
    return out


def test_stages(stages):
    names = [n for n, _ in stages[1:]]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    columns = stages[0][1].columns
    assert all(df.columns == columns for _, df in stages[:-1])
    counts = [df.count() for _, df in stages]
    assert counts[0] > counts[1] > 0 and counts[1] >= counts[2] >= counts[3] > 0


def test_each_stage_keeps_what_brute_force_keeps(stages):
    rows = [[(r["doc_id"], r["text"], r["source"]) for r in df.collect()] for _, df in stages[:-1]]

    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    last = {}
    for i, t, _ in rows[1]:
        last[lower(t)] = max(i, last.get(lower(t), i))
    assert sorted(i for i, *_ in rows[2]) == sorted(last.values())

    from test_llm_dedup import similar_roots

    docs = sorted(rows[2])
    assert sorted(i for i, *_ in rows[3]) == sorted(docs[r][0] for r in set(similar_roots([t for _, t, _ in docs])))

    words = {}
    for _, t, s in rows[3]:
        words[s] = words.get(s, 0) + len((t or "").split())
    mixed = {}
    for _, t, s in rows[4]:
        mixed[s] = mixed.get(s, 0) + len((t or "").split())
    assert abs(sum(mixed.values()) - 1.5 * sum(words.values())) < 0.1 * sum(words.values())
    packed = stages[-1][1].collect()
    assert {r["doc_id"] for r in packed} == {i for i, *_ in rows[4]}


def test_run_gives_what_the_stages_give(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, stages[-1][1].select(*columns).collect()))


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the other queries are still there."""
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quillseek.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "names = list(e.queries())\n"
        "assert 'fuzzy_default' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)\n"
        "assert set(e.oracle_sql()) <= set(names)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
