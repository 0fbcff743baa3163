"""Operators 5 and 10 and the pipeline."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestar.llm import decontaminate as dec
from lodestar.llm import language_id as lid
from lodestar.llm.simhash import fingerprint
from tests.llm.test_dedup import brute_components, brute_exact


def brute_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dec.MATCH if a[i - 1] == b[j - 1] else dec.MISMATCH), h[i - 1, j] + dec.GAP, h[i, j - 1] + dec.GAP)
    return h.max()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=15))
def test_alignment(a, b):
    assert dec.smith_waterman(np.array(a, int), np.array(b, int)) == brute_alignment(a, b)


def planted(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    clean = [f"a plain text number {k} about nothing in particular with words of its own like w{k} and v{k}" for k in range(30)]
    docs, want = [(k, t) for k, t in enumerate(clean)], set()
    for n, (i, t) in enumerate(items.items()):
        ws = t.split()
        edited = [w if j % 6 else "changed" for j, w in enumerate(ws)]
        moved = ws[: len(ws) // 2] + ["inserted", "here"] + ws[len(ws) // 2 :]
        for j, v in enumerate((ws, edited, moved)):
            docs.append((1000 + 3 * n + j, " ".join(["before", "it", *v, "after", "it"]).upper() if j == 0 else " ".join(v)))
            want.add((1000 + 3 * n + j, i))
    return docs, bench, want


def test_contaminated(spark, sf, edge, empty):
    docs, bench, want = planted(spark, sf)
    for size in (1 << 20, 2000):
        got = {(r.doc_id, r.item_id) for r in dec.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=size).collect()}
        assert want <= got and all(d >= 1000 for d, _ in got)
    assert dec.contaminated(spark, empty, bench).count() == 0 and dec.contaminated(spark, edge, bench).count() == 0
    none = bench.limit(0)
    assert dec.contaminated(spark, edge, none).count() == 0 and dec.drop_contaminated(edge, none).count() == edge.count()
    nulls = spark.createDataFrame([(1, None), (None, "one"), (2, "")], "item_id long, text string")
    assert {r.doc_id for r in dec.contaminated(spark, edge, nulls).collect()} == {8}
    assert dec.drop_contaminated(edge, nulls).count() == edge.count() - 1


def test_contaminated_rows(spark, sf):
    """Every row, score and count of seeds against whole-document alignments."""
    docs, bench, _ = planted(spark, sf)
    items = {r.item_id: dec.words(r.text.encode()) for r in bench.collect() if r.item_id < 8}
    docs = [d for d in docs if d[0] < 10 or d[0] < 1045]
    want = {}
    for d, text in docs:
        ws = dec.words(text.encode())
        for i, item in items.items():
            seeds = sum(tuple(ws[p : p + 3]) == tuple(item[q : q + 3]) for p in range(len(ws) - 2) for q in range(len(item) - 2))
            vocab = {w: k for k, w in enumerate(dict.fromkeys([*ws, *item]))}
            if seeds and (best := brute_alignment([vocab[w] for w in item], [vocab[w] for w in ws])) >= len(item):
                want[d, i] = (best / (2 * len(item)), seeds)
    some = bench.filter("item_id < 8")
    got = {(r.doc_id, r.item_id): (r.score, r.n_seeds) for r in dec.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), some).collect()}
    assert got == want and len(want) >= 20


def edited(words, every):
    return " ".join(w if (j + 1) % every else f"changed{j}" for j, w in enumerate(words))


def test_contaminated_copies_of_one_edit(spark):
    """One edited copy in 33 or 1,000 documents, and two edits of an item of unlike counts, against the alignment of all."""
    items = {k: [f"i{k}w{j}" for j in range(size)] for k, size in enumerate((39, 45, 40, 30))}
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id long, text string")
    texts = [edited(items[k], every) for k, every in enumerate((6, 5, 4))]
    wide = " ".join(items[3][:2] + [f"x{j}" for j in range(20)] + items[3][2:])
    for copies in (1, 33, 1000):
        docs = [t for t in texts for _ in range(copies)] + [edited(items[0], 4)] * 40 + [wide] * copies + ["nothing of them"]
        vocab = {}
        want = {}
        for t in set(docs):
            ids = [np.array([vocab.setdefault(w, len(vocab)) for w in ws]) for ws in (t.split(), *items.values())]
            want[t] = {k: s for k in items if (s := dec.smith_waterman(ids[k + 1], ids[0]) / (dec.MATCH * len(items[k]))) >= 0.5}
        rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        got = {(r.doc_id, r.item_id): r.score for r in dec.contaminated(spark, rows, bench).collect()}
        assert got == {(i, k): s for i, t in enumerate(docs) for k, s in want[t].items()}
        assert {r.text for r in dec.drop_contaminated(rows, bench).collect()} == {t for t in docs if not want[t]}
        assert all(want[t] for t in (*texts, wide))


def test_gradients():
    net = lid.BiGru(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    x, label = r.integers(97, 105, (6, 5)), np.array([0, 1, 2, 1, 0])
    g, _ = net.gradients(x, label)
    for k in net.p:
        for at in list(zip(*np.nonzero(np.abs(g[k]) > 1e-4), strict=True))[:6]:
            old, eps = net.p[k][at], 1e-3
            net.p[k][at] = old + eps
            up = net.gradients(x, label)[1]
            net.p[k][at] = old - eps
            down = net.gradients(x, label)[1]
            net.p[k][at] = old
            assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3 + 0.1 * abs(g[k][at])


def test_language(spark, docs, edge, empty):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = lid.identify(spark, docs).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert lid.identify(spark, empty).count() == 0
    rows = lid.identify(spark, edge).collect()
    assert len(rows) == edge.count() and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 9)} == {"und"}


def test_forward_pass():
    """Label probabilities of every byte against a plain loop over steps."""
    net, r = lid.BiGru(3, 4), np.random.default_rng(5)
    x = r.integers(0, 256, (9, 2))
    for n in range(2):
        both = {}
        for d, steps in (("f", range(9)), ("b", range(8, -1, -1))):
            state = np.zeros(4)
            for t in steps:
                a, u = net.p["e" + d][:, x[t, n]], net.p["u" + d] @ state
                z, reset = (np.clip(0.5 + 0.25 * (a[k : k + 4] + u[k : k + 4]), 0, 1) for k in (0, 4))
                new = np.clip(a[8:] + reset * u[8:], -1, 1)
                state = z * state + (1 - z) * new
                both[d, t] = state
        for t in range(9):
            s = np.exp(net.p["w"] @ np.concatenate([both["f", t], both["b", t]]) + net.p["c"][:, 0])
            assert np.allclose(net.probabilities(x)[t, :, n], s / s.sum(), atol=1e-5)


def test_pool_does_not_depend_on_neighbours():
    net = lid.BiGru(3)
    texts = [b"a", b"", b"some words " * 30, b"x" * 64, b"y" * 65]
    together = lid.classify(net, texts)
    for i, t in enumerate(texts):
        assert np.allclose(lid.classify(net, [t])[0], together[i], atol=1e-5)


def test_pipeline(spark, sf):
    got = cp.run(spark, sf)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    kept = {r[0] for r in brute_exact(docs) if r[3]}
    docs = [(i, t) for i, t in docs if i in kept]
    sets = {i: {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))} for i, ws in ((i, t.lower().split()) for i, t in docs)}
    root = brute_components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = [(i, t) for i, t in docs if root[i] == i]
    items = [dec.words(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(t):
        ws = dec.words(t.encode())
        vocab = {w: k for k, w in enumerate(dict.fromkeys(w for x in [ws, *items] for w in x))}
        grams = {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)}
        return any(grams & {tuple(x[k : k + 3]) for k in range(len(x) - 2)} and dec.smith_waterman(np.array([vocab[w] for w in x]), np.array([vocab[w] for w in ws])) >= len(x) for x in items)

    assert {r.doc_id for r in got.collect()} == {i for i, t in docs if not leaks(t)}


def test_stages_keep_columns_and_take_odd_rows(spark, sf, edge, empty):
    for df in (edge, empty):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns, name
            out.count()
        assert "sequence_id" in cp.STAGES[-1][1](spark, df, sf).columns
    kept = cp.drop_copies(spark, edge, sf).collect()
    assert sorted((r.doc_id for r in kept), key=lambda i: (i is None, i)) == [1, 3, 4, 6, 8, 9, 10]
    assert {r.doc_id for r in cp.identify_language(spark, edge, sf).collect()} == {4, 5, None, 6, 7, 8, 10}


def test_language_stage_without_labels(spark, sf, edge, empty):
    """Where no row teaches a language, texts with a letter stay."""
    rows = edge.withColumn("lang", F.lit(None).cast("string"))
    out = cp.identify_language(spark, rows, sf)
    assert out.columns == rows.columns and {r.doc_id for r in out.collect()} == {4, 5, None, 6, 7, 8, 10}
    assert cp.identify_language(spark, empty, sf).count() == 0
