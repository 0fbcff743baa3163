"""Operator 1: Katz backoff language-model scoring.

Bigrams back off to unigrams and those to one class of unknown words. Counts up to five are
Good-Turing discounted; the weight of a context is what its discounts leave over what the unigram
model gives to words not seen after it, so that every context sums to one.

The model lies in partitioned tables: words with counts by the hash of the word, bigram counts and
backoff weights by context. Token blocks (see ``blocks``) ask the tables once for each distinct key.
A context with more than ``HOT`` tokens is spread over several partitions by its next word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.blocks import Block, Codes, buckets_for, by_bucket, messages, reduce_buckets, token_blocks, with_answers
from lodestar.llm.common import Workspace, crc_mod, join_two, pack, split_two, unpack

K = 5
HOT = 1 << 20
#: The end of a text and the context before its first word; no word holds white space.
END, BEGIN = b" ", b"\t"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Rows of the count tables that are no answer to a block.
STAT, TABLE, CONTEXT = -1, -2, -3


def discounts(counts: list[int]) -> np.ndarray:
    """d[r] for counts r = 0..K+1 (the last: all above) from n_1..n_(K+1).

    The cut-off falls below K where a count of counts is zero or the formula leaves (0, 1); with
    none that works there is no discount.
    """
    d, n = np.ones(K + 2), [0, *counts]
    for k in range(K, 0, -1):
        if min(n[1 : k + 2]) <= 0:
            continue
        cut = (k + 1) * n[k + 1] / n[1]
        got = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if cut != 1 else 0 for r in range(1, k + 1)]
        if all(0 < x < 1 for x in got):
            d[1 : k + 1] = got
            break
    return d


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, K + 1).astype(np.int64)] * c


class Unigrams:
    """Total tokens, words and the discounted unigram distribution."""

    def __init__(self, stat: list[int]):
        self.n, self.v = stat[0], stat[1]
        small = stat[2 : 2 + K + 1]
        self.d = discounts(small)
        seen = sum(self.d[r] * r * small[r - 1] for r in range(1, K + 1)) + self.n - sum(r * small[r - 1] for r in range(1, K + 1))
        self.total = self.n if self.n - seen > 1e-9 * max(self.n, 1) else self.n + 1
        self.unknown = (self.total - seen) / self.total

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(self.d, c) / self.total, self.unknown)


class Tokens:
    """A block's tokens with the end of each text, and the context of each token."""

    def __init__(self, b: Block, fold: int, held: int):
        self.words = [*b.vocab, END, BEGIN]
        end, docs = len(b.vocab), len(b.doc_id)
        self.doc = np.repeat(np.arange(docs), b.n + 1)
        self.seq = np.full(len(self.doc), end)
        self.seq[np.arange(len(b.toks)) + np.repeat(np.arange(docs), b.n)] = b.toks
        self.prev = np.concatenate([[end + 1], self.seq[:-1]])[: len(self.seq)]
        self.prev[np.cumsum(b.n + 1)[:-1]] = end + 1
        self.held = np.array([crc_mod(i, fold) == held for i in b.doc_id], bool)
        self.learn = ~self.held[self.doc]

    def counts(self) -> np.ndarray:
        c = np.bincount(self.seq[self.learn], minlength=len(self.words))
        c[-1] = (~self.held).sum()
        return c

    def lookup(self, got: dict[int, bytes], n: int, shift: int = 0) -> tuple[np.ndarray, ...]:
        """Answers of the word table's partitions, by word of the block."""
        cols: list[np.ndarray] = []
        for bucket, at in by_bucket(word_buckets(self.words, n)):
            arrays = unpack(got[bucket + shift])
            cols = cols or [np.zeros(len(self.words), a.dtype) for a in arrays]
            for c, a in zip(cols, arrays, strict=True):
                c[at] = a
        return tuple(cols)

    def ids(self, got: dict[int, bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Corpus-wide id and training count of each word of the block."""
        gid = np.zeros(len(self.words), np.uint64)
        count = np.zeros(len(self.words), np.int64)
        for bucket, at in by_bucket(word_buckets(self.words, n)):
            idx, c = unpack(got[bucket])
            gid[at], count[at] = idx * np.uint64(n) + np.uint64(bucket), c
        return gid, count

    def pairs(self, gid: np.ndarray, count: np.ndarray, n: int):
        """Distinct known (context, word) pairs ordered by id, their partitions, and each token's pair (-1: none)."""
        order = np.argsort(gid, kind="stable")
        rank = np.empty(len(gid), np.int64)
        rank[order] = np.arange(len(gid))
        known = (count[self.prev] > 0) & (count[self.seq] > 0)
        keys, inverse = np.unique(rank[self.prev[known]] * len(gid) + rank[self.seq[known]], return_inverse=True)
        v, w = order[keys // len(gid)], order[keys % len(gid)]
        of = np.full(len(self.seq), -1)
        of[known] = inverse
        parts = np.maximum(-(-count[v] // HOT), 1).astype(np.uint64)
        bucket = (gid[v] + (gid[w] // np.uint64(n)) % parts * np.uint64(7919)) % np.uint64(n)
        return v, w, bucket.astype(np.int64), of


def word_buckets(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % n


def _small(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2].tolist()


def _total(table: DataFrame, n: int) -> list[int]:
    row = table.filter(F.col("block") == STAT).agg(*[F.sum(F.col("stat")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [x or 0 for x in row]


def katz_scores(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2, model_dir: str | None = None) -> DataFrame:
    """Score every whole text of ``docs`` with a Katz bigram model of the texts whose crc32(id) mod ``fold`` is not ``held``.

    Columns OUT. Null or empty text: one token, the end. Null id: kept, in training. Repeated rows
    count and score as often as they occur. Empty table: no rows. Columns other than the two named
    are not read. ``model_dir``: where to keep the model's tables (``words``: word -> count by word
    hash; ``ngrams``: bigram counts by context; ``backoff``: weights), each partitioned by bucket.
    """
    with Workspace(spark, "katz") as ws:
        return _scores(ws, docs, id_col, text_col, fold, held, model_dir)


def _scores(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, fold: int, held: int, model_dir: str | None) -> DataFrame:
    blocks = ws.write(token_blocks(docs, id_col, text_col, lower=True), "blocks")
    n = buckets_for(blocks.agg(F.sum("tokens")).first()[0] or 0)
    kept = model_dir is not None

    def count_words(b: Block):
        t = Tokens(b, fold, held)
        c = t.counts()
        for bucket, at in by_bucket(word_buckets(t.words, n)):
            yield bucket, join_two(pack(c[at]), b"\n".join(t.words[i] for i in at))

    def sum_words(bucket: int, sent: list[int], bodies: list[bytes]):
        codes, got = Codes(), []
        for body in bodies:
            counts, words = split_two(body)
            words = words.split(b"\n")
            got.append((np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), unpack(counts)[0]))
        total = np.bincount(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), len(codes)).astype(np.int64)
        for block, (idx, _) in zip(sent, got, strict=True):
            yield bucket, block, pack(idx, total[idx]), []
        if kept:
            yield bucket, TABLE, join_two(pack(total), b"\n".join(codes)), []
        if BEGIN in codes:
            total[codes[BEGIN]] = 0
        yield bucket, STAT, b"", [int(total.sum()), int((total > 0).sum()), *_small(total)]

    words = ws.write(reduce_buckets(messages(blocks, count_words), sum_words), "words")
    uni = Unigrams(_total(words, 2 + K + 1))
    answers = words.filter(F.col("block") >= 0).select("bucket", "block", "body")

    def count_pairs(b: Block, got: dict[int, bytes]) -> pa.Table:
        t = Tokens(b, fold, held)
        gid, c1 = t.ids(got, n)
        v, w, bucket, of = t.pairs(gid, c1, n)
        c2 = np.bincount(of[t.learn & (of >= 0)], minlength=len(v))
        out: list[list] = [[], [], []]
        for k, at in by_bucket(bucket):
            ids = gid[v[at]]
            out[0].append(k)
            out[1].append(b.block)
            out[2].append(pack(np.diff(ids, prepend=np.uint64(0)), gid[w[at]], c2[at], c1[w[at]]))
        return pa.table({"bucket": pa.array(out[0], pa.int64()), "block": pa.array(out[1], pa.int64()), "body": pa.array(out[2], pa.binary())})

    def sum_pairs(bucket: int, sent: list[int], bodies: list[bytes]):
        got = [unpack(x) for x in bodies]
        v, w, c, cw = (np.concatenate([g[i] for g in got]) for i in range(4))
        v = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
        ids, vi = np.unique(v, return_inverse=True)
        keys, inverse = np.unique((vi.astype(np.uint64) << np.uint64(40)) | w, return_inverse=True)
        total = np.bincount(inverse, c, len(keys)).astype(np.int64)
        at = 0
        for block, g in zip(sent, got, strict=True):
            yield bucket, block, pack(total[inverse[at : at + len(g[0])]]), []
            at += len(g[0])
        first = np.zeros(len(keys), np.int64)
        first[inverse] = cw
        of, seen = (keys >> np.uint64(40)).astype(np.int64), total > 0
        sums = [np.bincount(of, total == r, len(ids)) for r in range(1, K + 1)] + [np.bincount(of, total * (total > K), len(ids))]
        lower = np.bincount(of, uni.p(first) * seen, len(ids))
        home = (ids % np.uint64(n)).astype(np.int64)
        for k, x in by_bucket(home):
            yield k, CONTEXT, pack(ids[x] // np.uint64(n), *(s[x].astype(np.int64) for s in sums), lower[x]), []
        if kept:
            yield bucket, TABLE, pack(np.diff(ids, prepend=np.uint64(0)), of[seen], keys[seen] & np.uint64((1 << 40) - 1), total[seen]), []
        yield bucket, STAT, b"", _small(total)

    sent = with_answers(blocks, answers, count_pairs, "bucket long, block long, body binary")
    ngrams = ws.write(reduce_buckets(sent, sum_pairs), "ngrams")
    d2 = discounts(_total(ngrams, K + 1))

    def weigh(bucket: int, sent: list[int], bodies: list[bytes]):
        asked = [(b, *unpack(x)) for b, x in zip(sent, bodies, strict=True) if b >= 0]
        size = max(int(a[1].max()) + 1 for a in asked)
        c, mass, lower = np.zeros(size), np.zeros(size), np.zeros(size)
        for _, idx, count in asked:
            c[idx.astype(np.int64)] = count
        for b, x in zip(sent, bodies, strict=True):
            if b == CONTEXT:
                idx, *sums, low = unpack(x)
                idx = idx.astype(np.int64)
                mass[idx] += sum(d2[r] * r * s for r, s in enumerate(sums[:-1], 1)) + sums[-1]
                lower[idx] += low
        full = (c > 0) & (c - mass <= 1e-9 * c)
        c = c + full
        alpha = np.where(c > 0, (1 - mass / np.maximum(c, 1)) / (1 - lower), 1.0)
        alpha = np.where(full, -alpha, alpha)
        for block, idx, _ in asked:
            yield bucket, block, pack(alpha[idx.astype(np.int64)]), []
        if kept:
            yield bucket, TABLE, pack(alpha), []

    asks = answers.unionByName(ngrams.filter(F.col("block") == CONTEXT).select("bucket", "block", "body"))
    backoff = ws.write(reduce_buckets(asks, weigh), "backoff")
    if kept:
        for name, table in (("words", words), ("ngrams", ngrams), ("backoff", backoff)):
            table.filter(F.col("block") == TABLE).select("bucket", "body").write.mode("overwrite").parquet(f"{model_dir}/{name}")

    def score(b: Block, got: dict[int, bytes]) -> pa.Table:
        t = Tokens(b, fold, held)
        gid, c1 = t.ids(got, n)
        v, _, bucket, of = t.pairs(gid, c1, n)
        c2 = np.zeros(len(v) + 1, np.int64)
        for k, at in by_bucket(bucket):
            c2[at] = unpack(got[n + k])[0]
        (alpha,) = t.lookup(got, n, 2 * n) if b.doc_id else (np.zeros(len(t.words)),)
        c, context, a = c2[of], c1[t.prev], alpha[t.prev]
        p1 = uni.p(c1[t.seq])
        p = np.where(c > 0, discounted(d2, c) / np.maximum(context + (a < 0), 1), np.where(context > 0, np.abs(a), 1.0) * p1)
        docs = len(b.doc_id)
        known = np.bincount(t.doc, c1[t.seq] > 0, docs).astype(np.int64)
        base = np.bincount(t.doc, np.log10((c1[t.seq] + 1) / (uni.n + uni.v + 1)), docs)
        return pa.table({"doc_id": pa.array(b.doc_id, pa.int64()), "held_out": pa.array(t.held), "n_tokens": pa.array(b.n + 1), "n_known": pa.array(known), "train_tokens": pa.array(np.full(docs, uni.n)), "base_score": pa.array(base, pa.float64()), "score": pa.array(np.bincount(t.doc, np.log10(p), docs), pa.float64())})

    got = answers.unionByName(ngrams.filter(F.col("block") >= 0).select((F.col("bucket") + n).alias("bucket"), "block", "body"))
    got = got.unionByName(backoff.filter(F.col("block") >= 0).select((F.col("bucket") + 2 * n).alias("bucket"), "block", "body"))
    out = ws.write(with_answers(blocks, got, score, OUT), "scores")
    ws.drop("blocks", "words", "ngrams", "backoff")
    return out
