"""Operators 3, 7 and 8 against brute force."""

import hashlib
import random
import re
import tracemalloc
from array import array
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as cp
from lodestar.llm import substring_dedup as sub
from lodestar.llm.common import Workspace
from lodestar.llm.components import components
from lodestar.llm import exact_dedup as exact
from lodestar.llm.exact_dedup import Group, OpenTable, exact_dedup, grace, normalise, without_copies
from lodestar.llm.simhash import STRANGE, Grid, fingerprint, links, majority, shingles, simhash_dedup, star


def brute_exact(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [48 << 20, 3000])
def test_exact(spark, docs, edge, size):
    for df in (docs, edge):
        want = brute_exact([(r.doc_id, r.text) for r in df.collect()])
        assert sorted((tuple(r) for r in exact_dedup(spark, df, table_bytes=size).collect()), key=repr) == want


def test_exact_empty(spark, empty):
    assert exact_dedup(spark, empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.binary(max_size=6)), max_size=60), st.integers(1, 400))
def test_grace_compares_contents(items, limit):
    """Hashes that collide (four values only) never join different contents."""
    got = {}
    for g in grace((Group(h << 62, c, (0, k, k), 1, array("q", [k])) for k, (h, c) in enumerate(items)), limit):
        assert (g.hash, g.content) not in got
        got[g.hash, g.content] = (g.best, g.rows, sorted(g.reps))
    for h, c in set(items):
        same = [j for j, x in enumerate(items) if x == (h, c)]
        assert got.pop((h << 62, c)) == ((0, same[0], same[0]), len(same), same)
    assert not got


def test_grace_holds_a_content_once():
    """A thousand copies of 1 MB, and twenty contents of one hash, with a table of 3 MB."""
    body = bytes(1 << 20)
    for groups, n in (((Group(5, body[:], (0, k, k), 1, array("q", [k])) for k in range(1000)), 1), ((Group(5, bytes([k]) * (1 << 20), (0, k, k), 1, array("q", [k])) for k in range(20)), 20)):
        tracemalloc.start()
        assert sum(1 for _ in grace(groups, 3 << 20)) == n
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20 << 20


def test_copies_in_many_parts(spark, monkeypatch):
    """A content that many local tables hold is merged in two steps."""
    monkeypatch.setattr(exact, "MANY", 3)
    rows = [(k, f"text {k % 3} {'x' * 50}" if k % 2 else f"own {k}") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in exact_dedup(spark, df, table_bytes=600).collect()), key=repr) == brute_exact(rows)
    assert sorted(r.doc_id for r in without_copies(spark, df, table_bytes=600).collect()) == sorted({x[1] for x in brute_exact(rows)})


@pytest.mark.parametrize("size", [48 << 20, 3000])
def test_without_copies(spark, docs, edge, empty, size):
    for df in (docs, edge):
        got = without_copies(spark, df, table_bytes=size)
        assert got.columns == df.columns and got.schema.simpleString() == df.schema.simpleString()
        want = {(x[1], x[4]) for x in brute_exact([(r.doc_id, r.text) for r in df.collect()])}
        found = [(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in got.collect()]
        assert sorted(found, key=repr) == sorted(want, key=repr)
    assert without_copies(spark, empty).count() == 0


def test_open_table_and_normalise():
    t = OpenTable()
    places = [t.place(7, str(k % 700).encode()) for k in range(1400)]
    assert [p[0] for p in places] == [k % 700 for k in range(1400)] and sum(p[1] for p in places) == 700
    assert normalise(b" a\t\n b\x0b\x0cc  ") == b" a b c " and normalise(None) == b""


def brute_substring(pairs, width):
    seen, out = set(), {}
    for k, (i, body) in enumerate(pairs):
        w = body.split()
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[k] = (i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("width", [1, 3, 20])
def test_substring(spark, docs, texts, width):
    got = sub.substring_dedup(spark, docs, width=width, block_tokens=3000, bucket_keys=5000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_substring(texts, width)


def test_substring_edges(spark, edge, empty):
    assert sub.substring_dedup(spark, empty).count() == 0
    pairs = sorted(((r.doc_id, (r.text or "").encode()) for r in edge.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    got = sub.substring_dedup(spark, edge, width=4, block_tokens=50_000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_substring(pairs, 4)


def test_run_index():
    r = np.random.default_rng(1)
    index, seen = sub.RunIndex(), set()
    for _ in range(40):
        batch = np.unique(r.integers(0, 3000, 100).astype(np.uint64))
        assert set(index.add(batch).tolist()) == seen & set(batch.tolist())
        seen |= set(batch.tolist())
    assert len(index.runs) < 12 and sum(map(len, index.runs)) == len(seen)


def _block(*texts):
    vocab = sorted({w for t in texts for w in t})
    toks = np.array([vocab.index(w) for t in texts for w in t], np.uint64)
    return sub.Block({"block": 0, "doc_id": list(range(len(texts))), "n": [len(t) for t in texts], "vocab": b"\n".join(vocab), "toks": sub.pack(toks), "tokens": len(toks)})


def test_windows_of_one_hash_are_compared_by_words():
    """If all hashes were equal, only windows with equal words would go."""
    b = _block([b"a", b"b", b"c", b"d"], [b"a", b"b", b"x", b"d"], [b"a", b"b"])
    w = sub.Windows(b, 2)
    assert w.repeats(2).tolist() == [4, 8]
    w.h1[:], w.h2[:] = 7, 9
    w.again[:], w.first = True, np.array([0])
    w.again[0] = False
    assert w.repeats(2).tolist() == [4, 8]  # compared with the one first window, "a b"
    p = sub.Passages(np.array([1, 0, 5]), np.array([11, 10, 40]), 3)
    assert p.windows.tolist() == [2, 1] and p.words.tolist() == [4, 3]
    toks = np.arange(10)
    assert p.confirmed(toks, np.array([0, 1, 2, 3, 5, 6, 7]), 3).tolist() == [0, 1, 5]
    assert p.confirmed(toks, np.array([9, 1, 2, 3, 5, 6, 9]), 3).tolist() == [1]


def test_rolling_hash():
    x = np.random.default_rng(2).integers(0, 1 << 63, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 20):
        got = sub.rolling(x, width, 1099511628211)
        want = [sum(int(v) * pow(1099511628211, width - 1 - i, 1 << 64) for i, v in enumerate(x[s : s + width])) % (1 << 64) for s in range(50 - width + 1)]
        assert got.tolist() == want


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if linked(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, texts):
    fps = {i: fingerprint(t) for i, t in texts}
    want = brute_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(spark, docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize(("distance", "parts", "segments"), [(2, 1, 8), (2, 1, 16), (2, 2, 16), (7, 4, 8), (5, 3, 11), (3, 2, 8)])
def test_simhash_links(spark, distance, parts, segments):
    """All pairs of near fingerprints, planted at distances 0 to 9, whatever the grid."""
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 1 << 63, 20)]
    fps = {b ^ sum(1 << int(k) for k in r.choice(64, n, replace=False)) for b in base for n in range(10) for _ in range(2)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    points = spark.createDataFrame([(f, f, f) for f in signed], "node long, fp long, root long")
    found = links(points, Grid(distance, parts, segments), distance)
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % (1 << 64)).bit_count() <= distance}
    assert {tuple(x) for x in found.collect()} == want and found.count() == len(want)
    assert {tuple(x) for x in star(points.drop("root"), Grid(distance, parts, segments), distance).collect()} <= want


def test_simhash_of_a_large_group(spark):
    """Three thousand points within two bits of one another: no list of their pairs is made."""
    fps = [(1 << a) | (1 << b) for a in range(64) for b in range(a)]
    points = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) * 2 for f in fps], "node long, fp long")
    assert star(points, Grid(2, 2, 16), 2).count() < 2 * len(fps)


def test_grids_that_do_not_fit():
    assert len(Grid(2, 1, 8).offsets()) == 73 and len(Grid(2, 2, 16).offsets()) == 17
    for bad in ((2, 1, 32), (2, 4, 17)):
        with pytest.raises(ValueError):
            Grid(*bad)


def test_simhash_edges(spark, edge, empty):
    assert simhash_dedup(spark, empty).count() == 0
    got = simhash_dedup(spark, edge).collect()
    assert len(got) == edge.count()
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16} and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}


def test_near_copies(spark, texts, edge, empty):
    """The pipeline's stage keeps what brute force keeps over all pairs near by both fingerprints, with edits planted around similarity 0.8."""
    r = np.random.default_rng(4)
    base = [[f"b{k}w{j}" for j in range(60)] for k in range(4)]
    pairs = [*texts, *((10_000 + i, " ".join(w if r.random() > 0.006 * (i % 9) else f"x{i}" for w in base[i % 4]).encode()) for i in range(120))]
    pairs += [(20_000 + i, f"the same few words in front of all {i} {'z' * i} {i * i} q{i}".encode()) for i in range(40)]
    lower = {i: t.lower().split() for i, t in pairs}
    sets = {i: {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))} for i, ws in lower.items()}
    one = {i: fingerprint(t, 1, True) for i, t in pairs}
    two = {i: majority(shingles(t, 5, True)) for i, t in pairs}

    def alike(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    want = brute_components(sets, lambda a, b: alike(a, b) and (sets[a] == sets[b] or ((one[a] ^ one[b]).bit_count() <= 7 and (two[a] ^ two[b]).bit_count() <= STRANGE)))
    rows = spark.createDataFrame([(i, t.decode()) for i, t in pairs], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in simhash_dedup(spark, rows, **cp.NEAR).collect()} == want
    assert {x.doc_id for x in cp.drop_near_copies(spark, rows, "").collect()} == {i for i in want if want[i] == i}
    exactly = brute_components(sets, alike)
    assert sum(want[i] != i for i in want) >= 0.9 * sum(exactly[i] != i for i in exactly)
    assert simhash_dedup(spark, empty, **cp.NEAR).count() == 0 and simhash_dedup(spark, edge, **cp.NEAR).count() == edge.count()


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(1000, 1200)] + [(1, 100)]
    got = {r.node: r.root for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 1 for k in (1, *range(100, 161))} | {k: 5 for k in (5, *range(1000, 1200))}


def test_few_links_meet_in_one_task_and_more_go_by_rounds(spark):
    rnd = random.Random(8)
    edges = [(k, k + 1) for k in range(-50, 400, 2)] + [(rnd.randrange(-50, 900), rnd.randrange(900, 2000)) for _ in range(700)] + [(7, 8)] * 3
    df = spark.createDataFrame(edges, "u long, v long")
    ws = Workspace(spark, "t")
    few = {r.node: r.root for r in components(ws, df).collect()}
    assert not ws.rounds  # each written round costs the driver memory
    assert few == {r.node: r.root for r in components(ws, df, few=0).collect()} and ws.rounds
    assert set(few) == {x for e in edges for x in e} and all(few[u] == few[v] <= min(u, v) for u, v in edges)
    assert components(ws, df.limit(0)).count() == 0 == components(ws, df.limit(0), few=-1).count()


def test_the_stage_writes_few_tables_without_marks(spark, docs, monkeypatch):
    names, write = [], Workspace.write

    def told(self, df, name, *a):
        out = write(self, df, name, *a)
        names.append(name)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        assert not any(f.getPath().getName() == "_SUCCESS" for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))
        return out

    monkeypatch.setattr(Workspace, "write", told)
    assert cp.drop_near_copies(spark, docs, "").count() > 0
    assert len(names) == len(set(names)) <= 14  # with rounds of components it was over 20
