"""Operator 4: token ids in files, coded by a static range asymmetric numeral system.

A file is a table of segments in ascending order of document ids. A segment has one shared frequency
table, the ids and lengths of its documents, and independent blocks. A block interleaves ``LANES``
coders: symbol i belongs to lane i modulo LANES. Its checkpoint (first symbol, place of its words,
lane states, checksum of its ids and its coded bytes) lets any block be decoded alone, in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Workspace, pack, slim, unpack
from lodestar.llm.encode import encoder

MAGIC = b"LRN1"
LANES, BLOCK, SEGMENT = 1024, 1 << 18, 1 << 22
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_HEAD = struct.Struct("<4sBIIIIII")  # magic, scale, lanes, documents, blocks, bytes of table, bytes of directory, crc of both


def quantise(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of at least one that sum to two to the scale, for positive counts."""
    scale = max(12, int(len(counts) - 1).bit_length() + 4)
    size, total = 1 << scale, int(counts.sum())
    f = np.maximum(counts.astype(np.float64) * size / total, 1).astype(np.int64)
    over = int(f.sum()) - size
    while over:
        order = np.argsort(-f, kind="stable")
        if over < 0:
            f[order[0]] -= over
            break
        room = f[order] // 2
        give = np.minimum(room, np.maximum(over - np.concatenate([[0], np.cumsum(room)[:-1]]), 0))
        f[order] -= give
        over -= int(give.sum())
    return f, scale


def encode_block(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(lane states, 32-bit words) of symbol numbers; the last symbols go first, so that decoding runs forward."""
    x, words, shift = np.full(lanes, _LOW), [], np.uint64(scale)
    top = np.uint64(63 - scale)
    for at in range((len(symbols) - 1) // lanes * lanes, -1, -lanes):
        s = symbols[at : at + lanes]
        f, y = freq[s], x[: len(s)]
        full = y >= (f << top)
        if full.any():
            words.append(y[full].astype(np.uint32))
            y = np.where(full, y >> _32, y)
        q = y // f
        x[: len(s)] = (q << shift) + (y - q * f) + start[s]
    return x, np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)


def decode_block(n: int, x: np.ndarray, words: np.ndarray, slots: np.ndarray, freq: np.ndarray, start: np.ndarray, scale: int) -> np.ndarray:
    x, out, lanes, at = x.copy(), np.empty(n, np.int64), len(x), 0
    mask, shift = np.uint64((1 << scale) - 1), np.uint64(scale)
    words = words.astype(np.uint64)
    for i in range(0, n, lanes):
        y = x[: min(lanes, n - i)]
        low = y & mask
        s = slots[low.astype(np.int64)]
        out[i : i + len(y)] = s
        y = freq[s] * (y >> shift) + low - start[s]
        short = np.flatnonzero(y < _LOW)
        if len(short):
            y[short] = (y[short] << _32) | words[at : at + len(short)]
            at += len(short)
        x[: len(y)] = y
    return out


def encode_segment(doc_ids: list[int | None], ids: list[bytes], lanes: int = LANES, block: int = BLOCK) -> bytes:
    """A segment of the format from documents' little-endian 32-bit ids (at least one id in all)."""
    raw = b"".join(ids)
    tokens = np.frombuffer(raw, "<u4")
    if int(tokens.max()) < 1 << 22:  # count by id; sorting is for vocabularies beyond that
        counts = np.bincount(tokens)
        symbols = np.flatnonzero(counts)
        counts, number = counts[symbols], np.zeros(len(counts), np.int64)
        number[symbols] = np.arange(len(symbols))
        inverse = number[tokens]
    else:
        symbols, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    freq, scale = quantise(counts)
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    f = freq.astype(np.uint64)
    table = pack(symbols, freq)
    lengths = np.array([len(x) // 4 for x in ids])
    nulls = np.array([i is None for i in doc_ids])
    directory = pack(np.array([i or 0 for i in doc_ids], np.int64).view(np.uint64), nulls.astype(np.uint8), lengths)
    blocks = []
    for at in range(0, len(tokens), block):
        x, words = encode_block(inverse[at : at + block], f, start, scale, lanes)
        n = min(block, len(tokens) - at)
        coded = x.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        blocks.append(struct.pack("<IIII", at, n, len(words), zlib.crc32(coded, zlib.crc32(raw[4 * at : 4 * (at + n)]))) + coded)
    index = np.cumsum([0] + [len(b) for b in blocks])[:-1].astype("<u8").tobytes()
    head = _HEAD.pack(MAGIC, scale, lanes, len(ids), len(blocks), len(table), len(directory), zlib.crc32(table + directory))
    return head + table + directory + index + b"".join(blocks)


class Segment:
    """A segment's table and checkpoints; ``block(k)`` decodes one block on its own."""

    def __init__(self, body: bytes):
        magic, self.scale, self.lanes, docs, self.blocks, t, d, crc = _HEAD.unpack_from(body)
        at = _HEAD.size
        if magic != MAGIC or zlib.crc32(body[at : at + t + d]) != crc:
            raise ValueError("not a segment, or its table or directory is damaged")
        self.symbols, freq = unpack(body[at : at + t])
        self.freq, self.start = freq, np.cumsum(freq) - freq
        self.slots = np.repeat(np.arange(len(freq)), freq.astype(np.int64))
        ids, nulls, self.lengths = unpack(body[at + t : at + t + d])
        self.doc_ids = [None if z else int(i) for i, z in zip(ids.view(np.int64), nulls, strict=True)]
        at += t + d
        self.index = np.frombuffer(body, "<u8", self.blocks, at)
        self.body, self.base = body, at + 8 * self.blocks

    def block(self, k: int) -> bytes:
        at = self.base + int(self.index[k])
        _, n, words, crc = struct.unpack_from("<IIII", self.body, at)
        x = np.frombuffer(self.body, "<u8", self.lanes, at + 16)
        w = np.frombuffer(self.body, "<u4", words, at + 16 + 8 * self.lanes)
        raw = self.symbols[decode_block(n, x, w, self.slots, self.freq, self.start, self.scale)].astype("<u4").tobytes()
        if zlib.crc32(self.body[at + 16 : at + 16 + 8 * self.lanes + 4 * words], zlib.crc32(raw)) != crc:
            raise ValueError(f"block {k} is damaged")
        return raw

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, first token in the segment, little-endian ids) of each document."""
        raw, at = b"".join(map(self.block, range(self.blocks))), 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            yield doc_id, at, raw[4 * at : 4 * (at + n)]
            at += n


FILE = "part long, segment long, tokens long, body binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, segment: int = SEGMENT) -> None:
    """Encode every whole text, append ``end_id``, and write segments in ascending order of ids to ``path``.

    Null ids come first, null and empty texts are ``end_id`` alone, repeated ids follow one another. A
    text longer than a segment makes a segment of its own. Only the two named columns are read, so
    names of others can't clash. Empty table: no segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end, part, seq = encoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        bodies: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([tokens], pa.int64()), pa.array([encode_segment(ids, bodies)], pa.binary())], names=["part", "segment", "tokens", "body"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 256):
                for doc_id, x in zip(keys[at : at + 256], e.encode_batch([b.as_py() or b"" for b in texts[at : at + 256]]), strict=True):
                    ids.append(doc_id)
                    bodies.append(x + end)
                    tokens += len(x) // 4 + 1
                    if tokens >= segment:
                        yield flush()
                        seq, tokens = seq + 1, 0
                        ids.clear()
                        bodies.clear()
        if ids:
            yield flush()

    slim(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body").mapInArrow(run, FILE).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (array) or, for ``digest``, their ids_crc32."""
    table = spark.read.schema(FILE).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seg, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                docs = list(Segment(body.as_py()).documents())
                step = len(docs) if digest else 256
                for i in range(0, len(docs), step):
                    some = docs[i : i + step]
                    last = pa.array([zlib.crc32(d[2]) for d in some], pa.int64()) if digest else pa.array([np.frombuffer(d[2], "<u4").astype(np.int32) for d in some], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int64()), pa.array([seg] * len(some), pa.int64()), pa.array([d[0] for d in some], pa.int64()), pa.array([d[1] for d in some], pa.int64()), pa.array([len(d[2]) // 4 for d in some], pa.int64()), last], names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32" if digest else "ids"])

    out = "ids_crc32 long" if digest else "ids array<int>"
    docs = table.mapInArrow(run, f"part long, segment long, doc_id long, at long, n_tokens long, {out}")
    sizes = table.select("part", "segment", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("t"))
    parts = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    inside = Window.partitionBy("part").orderBy("segment")
    sizes = sizes.join(parts, "part").select("part", "segment", (F.col("before") + F.sum("tokens").over(inside) - F.col("tokens")).alias("before"))
    return docs.join(sizes, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", out.split()[0])


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, **columns: str) -> DataFrame:
    """Write ``docs`` to a file in the shared folder and digest what is read back: doc_id, start, n_tokens, ids_crc32."""
    ws = Workspace(spark, "rans")
    write_tokens(docs, f"{ws.root}/tokens", tokenizer, **columns)
    return read_tokens(spark, f"{ws.root}/tokens", digest=True)
