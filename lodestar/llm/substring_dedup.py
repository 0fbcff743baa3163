"""Operator 3: substring deduplication with a log-structured fingerprint index.

A window is ``width`` consecutive words of one document. A word goes if a window that covers it also
starts earlier (smaller document id, or the same document and an earlier start).

Each token block is a batch. Its window hashes are cut into ranges, and each range has an index of
sorted immutable runs: a batch is merge-joined with every run, added as a run, and runs of like size
are compacted into one. That yields the hashes that more than one batch holds. Only those are asked
about again, with two hashes (96 bits together) and their places: of like windows the first by
(document id, start) stays, and the others learn where it lies. They are verified there: the block
that has the first window sends its words, and a window goes only if all its words are equal to them.
Windows that repeat within a block are compared in place.
:mod:`lodestar.llm.fingerprint_index` keeps such an index in a folder between calls.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.blocks import BLOCK_TOKENS, BUCKET_KEYS, Block, buckets_for, by_bucket, messages, reduce_buckets, token_blocks, with_answers
from lodestar.llm.common import Workspace, join_two, mix, pack, pack_sorted, split_two, unpack, unpack_sorted

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Low bits of a hash that the index leaves out; verification has them all.
SHORT = 16
NO_ID = np.iinfo(np.int64).max
#: The range whose answers name a block's windows that an index of earlier calls has.
EARLIER = -1


class RunIndex:
    """Sorted immutable runs of hashes, compacted when the last two are of like size."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def add(self, batch: np.ndarray) -> np.ndarray:
        """The hashes of a sorted batch that earlier batches have; then the batch becomes a run."""
        seen = np.zeros(len(batch), bool)
        for run in self.runs:
            at = np.minimum(np.searchsorted(run, batch), len(run) - 1)
            seen |= run[at] == batch
        fresh = batch[~seen]
        if len(fresh):
            self.runs.append(fresh)
        while len(self.runs) > 1 and len(self.runs[-1]) * 2 > len(self.runs[-2]):
            both = np.concatenate([self.runs.pop(), self.runs.pop()])
            both.sort(kind="stable")
            self.runs.append(both)
        return batch[seen]


def rolling(x: np.ndarray, width: int, k: int) -> np.ndarray:
    """Polynomial hashes of all windows, from hashes of windows of half the length, and so on."""
    if width == 1:
        return x
    half = width // 2
    low = rolling(x, half, k)
    out = low[: len(low) - half] * np.uint64(pow(k, half, 1 << 64)) + low[half:]
    if width % 2:
        out = out[:-1] * np.uint64(k) + x[width - 1 :]
    return out


class Windows:
    """A block's windows in (document, start) order: two hashes of each, and which repeat an earlier one of the block.

    ``first``: the places of first windows, by ascending hash.
    """

    def __init__(self, b: Block, width: int):
        words = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, b.vocab)), ">u8").astype(np.uint64).reshape(-1, 2)
        self.doc = np.repeat(np.arange(len(b.n)), b.n)
        count = max(len(b.toks) - width + 1, 0)
        self.at = np.flatnonzero(self.doc[:count] == self.doc[width - 1 :]) if count else np.empty(0, np.int64)
        none = np.empty(0, np.uint64)
        self.h1, self.h2 = (rolling(words[:, i][b.toks], width, k)[self.at] if count else none for i, k in ((0, 0x9E3779B97F4A7C15), (1, 0xD6E8FEB86659FD93)))
        self.h1 = mix(self.h1)
        self.b = b
        self.again = np.zeros(len(self.at), bool)
        self.first = order = np.argsort(self.h1)
        sorted1 = self.h1[order]
        same = sorted1[1:] == sorted1[:-1]
        if same.any():
            if (self.h2[order[1:]] != self.h2[order[:-1]])[same].any():  # two windows of one first hash
                order = np.lexsort((self.h2, self.h1))
                sorted1 = self.h1[order]
                same = (sorted1[1:] == sorted1[:-1]) & (self.h2[order[1:]] == self.h2[order[:-1]])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            self.first = np.minimum.reduceat(order, starts)
            self.again[:] = True
            self.again[self.first] = False
            sorted1 = sorted1[starts]
        self.short_of_first = sorted1 >> np.uint64(SHORT)
        fresh = np.concatenate([[True], self.short_of_first[1:] != self.short_of_first[:-1]])[: len(sorted1)]
        self.short, self.number = self.short_of_first[fresh], np.cumsum(fresh) - 1

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document ids (null: the largest) and starts of windows."""
        ids = np.array([NO_ID if i is None else i for i in self.b.doc_id], np.int64)
        doc = self.doc[self.at[at]]
        return ids[doc], self.at[at] - self.b.starts[doc]

    def repeats(self, width: int) -> np.ndarray:
        """Where windows start whose words, compared one by one, an earlier window of the block has."""
        at = np.flatnonzero(self.again)
        if not len(at):
            return at
        sorted1 = self.h1[self.first]
        k = np.searchsorted(sorted1, self.h1[at])
        toks, here = self.b.toks, self.at[at]
        same = np.zeros(len(at), bool)
        left = np.arange(len(at))
        while len(left):  # windows of one first hash lie side by side
            there = self.at[self.first[k[left]]]
            equal = np.ones(len(left), bool)
            for i in range(width):
                equal &= toks[here[left] + i] == toks[there + i]
            same[left[equal]] = True
            left = left[~equal]
            k[left] += 1
            left = left[k[left] < len(sorted1)]
            left = left[sorted1[k[left]] == self.h1[at[left]]]
        return here[same]

    def among(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which windows have both hashes of one of the given pairs."""
        order = np.lexsort((h2, h1))
        h1, h2, found = h1[order], h2[order], np.zeros(len(self.h1), bool)
        at, left = np.searchsorted(h1, self.h1), np.arange(len(self.h1))
        while len(left := left[at[left] < len(h1)]) and len(left := left[h1[at[left]] == self.h1[left]]):
            same = h2[at[left]] == self.h2[left]
            found[left[same]] = True
            left = left[~same]
            at[left] += 1
        return found


def ranges(short: np.ndarray, n: int):
    """(range, slice) of sorted short hashes for each of n equal ranges that has any."""
    bounds = np.searchsorted(short, np.array([((1 << (64 - SHORT)) * i) // n for i in range(n + 1)], np.uint64))
    return [(i, slice(bounds[i], bounds[i + 1])) for i in range(n) if bounds[i] < bounds[i + 1]]


def _flags(bits: np.ndarray) -> bytes:
    return pack(np.packbits(bits), np.array([len(bits)]))


def _unflags(body: bytes) -> np.ndarray:
    bits, n = unpack(body)
    return np.unpackbits(bits.astype(np.uint8))[: int(n[0])].astype(bool)


def substring_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Columns OUT, one row per row of ``docs``: words, words removed, SHA-256 of the kept words joined by one space.

    Null, empty and short texts have no windows and lose nothing. A null id ranks after all others.
    Of rows with one id and equal windows at one start, one keeps them. A text longer than a block is
    a block of its own, which one task holds (four bytes a word). Other columns are not read, whatever
    their names. Empty table: no rows. The last pass runs when the result is read.
    """
    with Workspace(spark, "substring") as ws:
        blocks = ws.write(token_blocks(docs, id_col, text_col, lower=False, block_tokens=block_tokens), "blocks")
        return kept_words(ws, blocks, width, bucket_keys)


class Passages:
    """Places of windows in one block and of equal ones in another, as stretches of neighbours at one distance."""

    def __init__(self, here: np.ndarray, there: np.ndarray, width: int):
        order = np.argsort(here)
        self.here, self.there = here[order].astype(np.int64), there[order].astype(np.int64)
        cut = np.flatnonzero((np.diff(self.here) != 1) | (np.diff(self.there) != 1)) + 1
        self.first = np.concatenate([[0], cut])
        self.windows = np.diff(self.first, append=len(here))
        self.words = self.windows + width - 1

    def spread(self, starts: np.ndarray) -> np.ndarray:
        """Positions of all words of the stretches, which begin at ``starts``."""
        before = np.cumsum(self.words) - self.words
        return np.repeat(starts - before, self.words) + np.arange(int(self.words.sum()))

    def confirmed(self, toks: np.ndarray, others: np.ndarray, width: int) -> np.ndarray:
        """The places here whose ``width`` words equal those there; ``others``: the words there, stretch by stretch."""
        wrong = np.concatenate([[0], np.cumsum(toks[self.spread(self.here[self.first])] != others)])
        at = np.repeat(np.cumsum(self.words) - self.words - self.first, self.windows) + np.arange(len(self.here))
        return self.here[wrong[at + width] == wrong[at]]


def _matches(got: dict[int, bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places here and there, by the block there, from what :func:`kept_words` learned for a block."""
    parts = [unpack(body) for bucket, body in got.items() if bucket >= 0]
    if not parts:
        return {}
    here = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    block, distance = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    return {k: (here[at], here[at] + distance[at]) for k, at in by_bucket(block.astype(np.int64))}


def kept_words(ws: Workspace, blocks: DataFrame, width: int, bucket_keys: int, earlier: DataFrame | None = None) -> DataFrame:
    """Columns OUT for written token blocks. ``earlier``: (bucket = EARLIER, block, body) of hash pairs whose windows all go."""
    n = buckets_for(blocks.agg(F.sum("tokens")).first()[0] or 0, bucket_keys)

    def send(b: Block):
        short = Windows(b, width).short
        for k, at in ranges(short, n):
            yield k, pack_sorted(short[at])

    def match(bucket: int, sent: list[int], bodies: list[bytes]):
        index, hits = RunIndex(), []
        for body in bodies:
            hits.append(index.add(unpack_sorted(body)))
        shared = np.unique(np.concatenate(hits))
        del index, hits
        for block, body in zip(sent, bodies, strict=True):
            run = unpack_sorted(body)
            at = np.minimum(np.searchsorted(shared, run), max(len(shared) - 1, 0))
            yield bucket, block, _flags(shared[at] == run if len(shared) else np.zeros(len(run), bool)), []

    def ask(b: Block, got: dict[int, bytes]) -> pa.Table:
        w = Windows(b, width)
        shared = np.zeros(len(w.short), bool)
        for k, at in ranges(w.short, n):
            shared[at] = _unflags(got[k])
        hit = shared[w.number]
        rows, out = w.first[hit], []
        for k, span in ranges(w.short_of_first[hit], n):
            at = rows[span]
            ids, start = w.place(at)
            out.append((k, pack(np.diff(w.h1[at], prepend=np.uint64(0)), w.h2[at] >> np.uint64(32), ids.view(np.uint64), start, w.at[at])))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([b.block] * len(out), pa.int64()), "body": pa.array([x[1] for x in out], pa.binary())})

    def find_first(bucket: int, sent: list[int], bodies: list[bytes]):
        h1, h2, ids, start, at = [], [], [], [], []
        for body in bodies:
            for x, y in zip((h1, h2, ids, start, at), unpack(body), strict=True):
                x.append(y.astype(np.uint32) if x is h2 or x is at else y)
            h1[-1] = np.cumsum(h1[-1], dtype=np.uint64)
        sizes = [len(x) for x in at]
        h1, h2, ids, start, at = (np.concatenate(x) for x in (h1, h2, ids, start, at))
        order = np.lexsort((start, ids.view(np.int64), h2, h1))
        del ids, start
        new = np.concatenate([[True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)])
        del h1, h2
        first = np.empty(len(order), np.int64)
        first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        del order, new
        source = np.repeat(np.arange(len(sent)), sizes)
        blocks_, end = np.array(sent, np.int64), 0
        for block, size in zip(sent, sizes, strict=True):
            mine = np.arange(end, end := end + size)
            mine = mine[first[mine] != mine]
            mine = mine[np.argsort(at[mine])]
            there = first[mine]
            here = at[mine].astype(np.uint64)
            yield bucket, block, pack(np.diff(here, prepend=np.uint64(0)), blocks_[source[there]].view(np.uint64), at[there].astype(np.uint64) - here), []

    def request(b: Block, got: dict[int, bytes]) -> pa.Table:
        out = [(k, Passages(*x, width)) for k, x in _matches(got).items()]
        return pa.table({"bucket": pa.array([k for k, _ in out], pa.int64()), "block": pa.array([b.block] * len(out), pa.int64()), "body": pa.array([pack(p.there[p.first], p.windows) for _, p in out], pa.binary())})

    def reply(b: Block, got: dict[int, bytes]) -> pa.Table:
        out, words = [], np.array([*b.vocab, b""], object)
        for asker, body in got.items():
            there, windows = (x.astype(np.int64) for x in unpack(body))
            n_words = windows + width - 1
            at = np.repeat(there - (np.cumsum(n_words) - n_words), n_words) + np.arange(int(n_words.sum()))
            codes, short = np.unique(b.toks[at], return_inverse=True)
            out.append((-2 - b.block, asker, join_two(pack(short), zstandard.ZstdCompressor(level=1).compress(b"\n".join(words[codes].tolist())))))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.int64()), "body": pa.array([x[2] for x in out], pa.binary())})

    def remove(b: Block, got: dict[int, bytes]) -> pa.Table:
        w = Windows(b, width)
        gone = [w.repeats(width)]
        if EARLIER in got:
            gone.append(w.at[w.among(*unpack(got[EARLIER]))])
        del w
        code = {x: i for i, x in enumerate(b.vocab)}
        for k, places in _matches(got).items():
            short, theirs = split_two(got[-2 - k])
            theirs = np.array([code.get(x, -1) for x in zstandard.ZstdDecompressor().decompress(theirs).split(b"\n")], np.int64)
            gone.append(Passages(*places, width).confirmed(b.toks, theirs[unpack(short)[0].astype(np.int64)], width))
        del code
        at = np.unique(np.concatenate(gone))
        edge = np.zeros(len(b.toks) + 1, np.int64)
        edge[at] += 1
        edge[at + width] -= 1
        keep = np.cumsum(edge)[:-1] == 0
        words = np.array([*b.vocab, b""], object)
        sha, lost = [], []
        for i, j in zip(b.starts[:-1], b.starts[1:], strict=True):
            kept = b.toks[i:j][keep[i:j]]
            lost.append(int(j - i - len(kept)))
            sha.append(hashlib.sha256(b" ".join(words[kept].tolist()) if len(kept) else b"").hexdigest())
        return pa.table({"doc_id": pa.array(b.doc_id, pa.int64()), "n_words": pa.array(b.n, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    message = "bucket long, block long, body binary"
    shared = reduce_buckets(messages(blocks, send), match).drop("stat")
    firsts = ws.write(reduce_buckets(with_answers(blocks, shared, ask, message), find_first).drop("stat"), "firsts")
    requests = with_answers(blocks, firsts, request, message)
    replies = with_answers(blocks, requests.select(F.col("bucket").alias("block"), F.col("block").alias("bucket"), "body"), reply, message)
    got = firsts.unionByName(replies)
    if earlier is not None:
        got = got.unionByName(earlier)
    return with_answers(blocks, got, remove, OUT)


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
