"""The fingerprint index between calls: batches against brute force, replay, failure, compaction, plans."""

import json

import numpy as np
import pytest

from lodestar.llm.blocks import Block
from lodestar.llm.fingerprint_index import FingerprintIndex, compactable
from lodestar.llm.substring_dedup import Windows

from .test_dedup import brute_substring

SCHEMA = "doc_id long, text string, block long"


def batches_of(texts, n):
    """Documents in n batches, ids in descending batches, so that order is by batch and not by id."""
    return [texts[k::n] for k in range(n)][::-1]


def expected(batches, width):
    """Each batch after all earlier ones; a marker row that can't match divides them."""
    pairs = [p for b in batches for p in b]
    return brute_substring(pairs, width)


def ordered(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batches_match_brute_force(spark, texts, tmp_path):
    batches = batches_of(texts, 4)
    got = []
    for k, b in enumerate(batches):
        index = FingerprintIndex(spark, f"file://{tmp_path}/i", width=5, buckets=3)  # opened anew each time
        df = spark.createDataFrame([(i, t.decode(), 1) for i, t in b], SCHEMA).repartition(2)
        got += ordered(index.dedup(df, f"b{k}", block_tokens=3000, bucket_keys=5000))
    assert sorted(got, key=repr) == expected(batches, 5)
    sizes = [r["rows"] for r in index.state["runs"]]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    words = [t.split() for _, t in texts]
    assert sum(sizes) == len({tuple(w[s : s + 5]) for w in words for s in range(len(w) - 4)})


def test_replay_failure_and_edges(spark, edge, empty, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    index = FingerprintIndex(spark, path, width=4, buckets=2)
    assert index.dedup(empty, "none").count() == 0 and index.state["runs"] == []
    monkeypatch.setattr(index, "_commit", lambda state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.dedup(edge, "a")
    again = FingerprintIndex(spark, path, width=4)
    assert "a" not in again.state["batches"] and again.state["buckets"] == 2
    first = ordered(again.dedup(edge, "a"))
    pairs = sorted(((r.doc_id, (r.text or "").encode()) for r in edge.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert first == brute_substring(pairs, 4)
    version = again.state["version"]
    assert ordered(FingerprintIndex(spark, path, width=4).dedup(edge, "a")) == first and FingerprintIndex(spark, path, width=4).state["version"] == version
    for row in again.dedup(edge, "b").collect():  # the same texts later: every window is known
        assert row.n_removed == (row.n_words if row.n_words >= 4 else 0)
    assert [len(x) for x in (again.state["runs"], again.state["batches"])] == [1, 3]
    with pytest.raises(ValueError, match="windows of 4"):
        FingerprintIndex(spark, path, width=5)
    json.dumps(again.state)


def test_runs_are_not_shuffled(spark, tmp_path):
    index = FingerprintIndex(spark, f"file://{tmp_path}/it's", width=2, buckets=4)
    for k in range(2):
        df = spark.createDataFrame([(i, f"a{i} b{k} c{i}", 1) for i in range(100 if k == 0 else 10)], SCHEMA)
        index.dedup(df, str(k))
    tables, runs = zip(*(index._open(r["name"]) for r in index.state["runs"]), strict=True)
    plan = index.marked(spark.range(9).selectExpr("id AS h1", "id AS h2"), list(runs))._jdf.queryExecution().executedPlan().toString()
    index._close(*tables)
    assert len(runs) == 2 and plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_compactable():
    assert [compactable(s) for s in ([], [5], [100, 10], [100, 51], [100, 40, 30], [400, 100, 40, 30], [1000, 10, 1])] == [1, 1, 1, 2, 3, 3, 1]


def test_pairs_of_one_first_hash():
    w = Windows(Block({"block": 0, "doc_id": [1], "n": [0], "vocab": b"", "toks": b"", "tokens": 0}), 2)
    w.h1, w.h2 = np.array([7, 7, 9, 1], np.uint64), np.array([1, 3, 2, 2], np.uint64)
    pairs = np.array([7, 7, 9], np.uint64), np.array([3, 2, 2], np.uint64)
    assert w.among(*pairs).tolist() == [False, True, True, False]
