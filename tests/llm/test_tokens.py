"""Operators 1, 2, 4, 6 and 9 against brute force and exact round trips."""

import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import katz, packing, rans, sharding, token_counts
from lodestar.llm.common import crc_mod, pack, pack_sorted, unpack, unpack_sorted
from lodestar.llm.encode import WordEncoder

WORDS = P.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)))
def test_messages(values):
    a = np.array(values, np.uint64)
    assert unpack(pack(a, a.astype(float)))[0].tolist() == values
    assert unpack_sorted(pack_sorted(np.sort(a))).tolist() == sorted(values)


def test_encoder(texts):
    e, t = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    odd = ["", " ", "Don't. <|ENDOFTEXT|>, <|endoftext|>. x<|endoftext|>y", "É́á. ́x ,", "“q”. a.. ,,", "İstanbul. ΣΑΣ. ß. ÷×", "12.3, x1. 中文. 中, a\x1cb\x1f.", "'s 's. don's, I'LL. a_b #x9!"]
    cases = [x.decode() for _, x in texts] + odd
    for text, ids in zip(cases, e.encode_batch([c.encode() for c in cases]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def brute_katz(pairs):
    """Scores by dictionaries, and the distributions of all contexts."""
    seqs = [(i, [*t.encode().lower().split(), "END"]) for i, t in pairs]
    train = [s for i, s in seqs if crc_mod(i, 7) != 2]
    c1, c2, ctx = Counter(w for s in train for w in s), Counter(), Counter()
    for s in train:
        for v, w in zip(["BEGIN", *s], s, strict=False):
            c2[v, w] += 1
            ctx[v] += 1
    n, size = sum(c1.values()), len(c1)
    d1 = katz.discounts([sum(c == r for c in c1.values()) for r in range(1, 7)])
    d2 = katz.discounts([sum(c == r for c in c2.values()) for r in range(1, 7)])
    disc = lambda d, c: d[min(c, 6)] * c
    seen = sum(disc(d1, c) for c in c1.values())
    total = n if n - seen > 1e-9 * max(n, 1) else n + 1
    p1 = lambda w: disc(d1, c1[w]) / total if c1[w] else (total - seen) / total
    follow = defaultdict(list)
    for (v, w), c in c2.items():
        follow[v].append((w, c))

    def p(v, w):
        if not ctx[v]:
            return p1(w)
        mass = sum(disc(d2, c) for _, c in follow[v])
        den = ctx[v] if ctx[v] - mass > 1e-9 * ctx[v] else ctx[v] + 1
        if c2[v, w]:
            return disc(d2, c2[v, w]) / den
        return (1 - mass / den) / (1 - sum(p1(x) for x, _ in follow[v])) * p1(w)

    rows = [(i, crc_mod(i, 7) == 2, len(s), sum(c1[w] > 0 for w in s), n, sum(log10((c1[w] + 1) / (n + size + 1)) for w in s), sum(log10(p(v, w)) for v, w in zip(["BEGIN", *s], s, strict=False))) for i, s in seqs]
    return rows, p, list(c1), ["BEGIN", *list(c1)[:40]]


def test_katz(spark, docs, tmp_path):
    some = docs.filter("doc_id < 60").withColumn("text", F.substring("text", 1, 600))
    rows, p, vocab, contexts = brute_katz([(r.doc_id, r.text) for r in some.collect()])
    for v in contexts:
        assert sum(p(v, w) for w in vocab) + p(v, "no such word") == pytest.approx(1)
    got = {r.doc_id: tuple(r) for r in katz.katz_scores(spark, some, model_dir=str(tmp_path)).collect()}
    for want in rows:
        assert got[want[0]][:5] == want[:5] and got[want[0]][5:] == pytest.approx(want[5:], rel=1e-9)
    assert {x.name for x in tmp_path.iterdir()} == {"words", "ngrams", "backoff"}


def test_katz_split_contexts(spark, docs, monkeypatch):
    """A context over several partitions gives the same scores."""
    some = docs.filter("doc_id < 60")
    want = sorted(map(tuple, katz.katz_scores(spark, some).collect()))
    monkeypatch.setattr(katz, "HOT", 7)
    got = sorted(map(tuple, katz.katz_scores(spark, some).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_katz_edges(spark, edge, empty):
    assert katz.katz_scores(spark, empty).count() == 0
    got = katz.katz_scores(spark, edge).collect()
    assert len(got) == edge.count() and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)


def test_best_cuts():
    r = np.random.default_rng(5)
    for _ in range(50):
        points = np.cumsum(r.integers(1, 9, 30)).tolist()
        cost = r.integers(0, 6, 30).tolist()
        best = [0] + [10**9] * 30
        p = [0, *points]
        for j in range(1, 31):
            best[j] = min(best[i] + 12 - (p[j] - p[i]) + cost[j - 1] for i in range(j) if p[j] - p[i] <= 12)
        cuts = packing.best_cuts(points, cost, 12)
        assert cuts[-1] == points[-1]
        assert sum(12 - (b - a) + cost[points.index(b)] for a, b in zip([0, *cuts], cuts, strict=False)) == best[30]


def tiles(rows, encoded, end, capacity):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    return by_doc


def test_packing(spark, docs, texts, edge, empty):
    t = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(docs, WORDS, chunk_tokens=9000, capacity=512).collect()
    by_doc = tiles(rows, None, 2, 512)
    for i, body in texts:
        ids = np.array([*t.encode(body.decode(), add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for start, n, crc in sorted(by_doc[i, len(ids)]):
            assert start == at and crc == zlib.crc32(ids[at : at + n].tobytes())
            at += n
        assert at == len(ids)
    used = sum(r.length for r in rows)
    assert used / (512 * len({r.sequence_id for r in rows})) > 0.9
    assert packing.pack_documents(empty, WORDS).count() == 0
    tiles(got := packing.pack_documents(edge, WORDS).collect(), None, 2, 4096)
    assert {r.doc_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.doc_id for r in got} == {None, *range(1, 11)}


def test_token_files(spark, docs, texts, edge, empty, tmp_path):
    t = Tokenizer.from_file(WORDS)
    rans.write_tokens(docs, f"{tmp_path}/t", WORDS, segment=20_000)
    got = sorted((r.doc_id, r.start, r.ids) for r in rans.read_tokens(spark, f"{tmp_path}/t").collect())
    at = 0
    for (i, body), (doc_id, start, ids) in zip(texts, got, strict=True):
        assert (doc_id, start) == (i, at) and ids == [*t.encode(body.decode(), add_special_tokens=False).ids, 1]
        at += len(ids)
    digest = {r.doc_id: r.ids_crc32 for r in rans.read_tokens(spark, f"{tmp_path}/t", digest=True).collect()}
    assert digest == {i: zlib.crc32(np.array(ids, "<u4").tobytes()) for i, _, ids in got}
    assert rans.token_files(spark, empty, WORDS).count() == 0
    rows = rans.token_files(spark, edge, WORDS).collect()
    assert len(rows) == edge.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=80), min_size=1, max_size=8), st.integers(1, 9), st.integers(1, 60))
def test_segment_round_trip(docs, lanes, block):
    docs = [*docs, [5]]
    raw = [np.array(d, "<u4").tobytes() for d in docs]
    body = rans.encode_segment(list(range(len(docs))), raw, lanes, block)
    assert [(i, x) for i, _, x in rans.Segment(body).documents()] == list(enumerate(raw))
    s = rans.Segment(body)
    assert b"".join(s.block(k) for k in reversed(range(s.blocks)))[: block * 4 if s.blocks == 1 else None]
    with pytest.raises(ValueError):
        b = bytearray(body)
        b[-1] ^= 255
        list(rans.Segment(bytes(b)).documents())


def test_token_counts(spark, docs, edge, empty):
    ranks = P.path("byte_bpe_50k.tiktoken")
    tokens = token_counts.ByteTokens(ranks, P.PATTERN)
    rows = defaultdict(list)
    for r in token_counts.token_counts(docs, ranks, P.PATTERN).collect():
        rows[r.doc_id].append(r)
    for d in docs.collect():
        got = sorted(rows[d.doc_id], key=lambda r: r.section)
        assert sum(r.n_tokens for r in got) == len(tokens.encode(d.text))
        assert "".join(d.text[r.start_char : r.end_char] for r in got) == d.text
        assert all(d.text[r.start_char : r.end_char].count("\n") <= 1 for r in got)
        body, at, want = d.text.encode(), 0, Counter()  # the line in which each token's first byte lies
        for t in tokens.encode(d.text):
            want[body[:at].count(b"\n")] += 1
            at += int(tokens.lengths[t])
        assert len(body) > 20_000 or {r.section: r.n_tokens for r in got if r.n_tokens} == dict(want)
    assert token_counts.token_counts(empty, ranks, P.PATTERN).count() == 0
    got = token_counts.token_counts(edge, ranks, P.PATTERN).collect()
    assert [(r.section, r.n_tokens) for r in got if r.doc_id == 1] == [(0, 0)] and {r.doc_id for r in got} == {None, *range(1, 11)}


def test_boundary_rules(spark):
    lengths = np.array([3, 4, 2, 6])  # tokens at bytes 0-3, 3-7, 7-9, 9-15
    first, last = np.array([0, 5, 11]), np.array([5, 11, 15])
    got = {r: token_counts.attribute(lengths, first, last, r).tolist() for r in token_counts.RULES}
    assert got["start"] == [2, 2, 0] and got["end"] == [1, 2, 1] and got["middle"] == [2, 1, 1]
    assert got["split"] == pytest.approx([1.5, 0.5 + 1 + 2 / 6, 4 / 6])
    df = spark.createDataFrame([(1, "héllo wörld", [(0, 5), (3, 8), (5, 99)])], "doc_id long, text string, f array<struct<start:int,end:int>>")
    rows = token_counts.token_counts(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, spans_col="f").collect()
    assert [(r.start_char, r.end_char) for r in rows] == [(0, 5), (3, 8), (5, 11)]


def brute_capacity(sizes, k):
    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n <= k

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("k", [1, 5, 40])
def test_sharding(spark, docs, texts, k):
    got = sharding.minimax_shards(spark, docs, k).collect()
    by_shard, of_text, body = defaultdict(list), defaultdict(set), dict(texts)
    for r in got:
        assert r.size == len(body[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(body[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r)
        of_text[body[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values()) and set(by_shard) <= set(range(k))
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    size, first = Counter(), {}
    for i, t in texts:
        size[t] += len(t) + 16
        first.setdefault(t, i)
    left, own = sum(size.values()), set()
    for t, s in sorted(size.items(), key=lambda x: -x[1]):
        if len(own) + 1 < k and s * (k - len(own)) > left:
            own.add(t)
            left -= s
    want = brute_capacity([size[t] for t in sorted(first, key=first.get) if t not in own], k - len(own))
    assert max(sum(r.size for r in rs) for s, rs in by_shard.items() if s >= len(own)) == want


def test_sharding_edges(spark, edge, empty):
    assert sharding.minimax_shards(spark, empty).count() == 0
    got = sharding.minimax_shards(spark, edge, 3).collect()
    assert len(got) == edge.count() and len({r.shard for r in got if r.doc_id in (6, 7)}) == 1
    assert {r.size for r in got if r.doc_id in (1, 2)} == {16}


@pytest.mark.parametrize("part_rows", [7, 1 << 17])
def test_sharding_of_any_ids(spark, part_rows):
    """Ids from end to end of a long, one far from the others, and a hot text: one shard law for all, slots in the order of ids."""
    ids = [-(1 << 63), *range(-20, 20), 5, 5, None, None, 6 * 10**18, (1 << 63) - 1]
    rows = [(i, "hot" if k % 3 == 0 else f"text {k}") for k, i in enumerate(ids)]
    got = sharding.minimax_shards(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, part_rows=part_rows).collect()
    assert sorted((r.doc_id for r in got), key=lambda i: (i is not None, i)) == sorted(ids, key=lambda i: (i is not None, i))
    hot = [r for r in got if r.text_crc32 == zlib.crc32(b"hot")]
    assert len({r.shard for r in hot}) == 1
    for shard in {r.shard for r in got}:
        rs = sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in rs] == list(range(len(rs)))
    order = [r.doc_id for r in sorted(hot, key=lambda r: r.slot)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    singles = sorted((r for r in got if r not in hot), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [r.shard for r in singles] == sorted(r.shard for r in singles)
