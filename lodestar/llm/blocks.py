"""Token blocks: documents as arrays of words, in chunks that one task can hold.

Corpus-wide questions about words or windows (how often, seen before?) are asked once per block and
distinct key, in compressed messages, and answered in the order of the keys. What is shuffled is a
few bytes per distinct key of a block in place of a row for every word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestar.llm.common import pack, slim, unpack

BLOCK_TOKENS = 1 << 20
#: Keys that one reducer holds; with BLOCK_TOKENS it bounds memory, and both grow with executors.
BUCKET_KEYS = 1 << 21
SCHEMA = "block long, doc_id array<long>, n array<int>, vocab binary, toks binary, tokens long"


class Codes(dict):
    """word -> code, a new code for each new word."""

    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def token_blocks(docs: DataFrame, id_col: str, text_col: str, lower: bool, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of SCHEMA: whole documents, ordered by id in a block, split at ``[\\x20\\x09-\\x0D]+``.

    ``lower`` lower-cases A-Z. A null text has no words; a null id stays null and sorts last. A text
    longer than a block makes a block of its own.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        codes, held = Codes(), 0

        def flush():
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
            toks = np.concatenate([r[1] for r in rows]) if rows else np.empty(0, np.int64)
            out = {"block": [(part << 24) | seq], "doc_id": [[r[0] for r in rows]], "n": [[len(r[1]) for r in rows]], "vocab": [b"\n".join(codes)], "toks": [pack(toks)], "tokens": [len(toks)]}
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("vocab", pa.binary()), ("toks", pa.binary()), ("tokens", pa.int64())]))

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py() or b""
                words = (body.lower() if lower else body).split()
                rows.append((doc_id, np.fromiter(map(codes.__getitem__, words), np.int32, len(words))))
                held += len(words) + 1
                if held >= block_tokens:
                    yield flush()
                    seq, codes, held = seq + 1, Codes(), 0
                    rows.clear()
        if rows:
            yield flush()

    return slim(docs, id_col, text_col).mapInArrow(build, SCHEMA)


class Block:
    """One row of SCHEMA, opened."""

    def __init__(self, row: dict):
        self.block, self.doc_id, self.n = row["block"], row["doc_id"], np.array(row["n"], np.int64)
        self.vocab = row["vocab"].split(b"\n") if row["vocab"] else []
        self.toks = unpack(row["toks"])[0].astype(np.int64) if row["tokens"] else np.empty(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n)])


def messages(blocks: DataFrame, fn: Callable[[Block], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """(bucket, block, body) for every (bucket, body) that ``fn`` gives for a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch.slice(i, 1).to_pylist()[0])
                got = list(fn(b))
                yield _message_batch([g[0] for g in got], [b.block] * len(got), [g[1] for g in got])

    return blocks.mapInArrow(run, "bucket long, block long, body binary")


def _message_batch(bucket: list, block: list, body: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(body, pa.binary())], names=["bucket", "block", "body"])


def reduce_buckets(sent: DataFrame, fn: Callable[[int, list[int], list[bytes]], Iterable[tuple[int, int, bytes, list[int]]]]) -> DataFrame:
    """(bucket, block, body, stat) of what ``fn(bucket, blocks, bodies)`` gives for each bucket's messages, in block order.

    ``stat`` holds counts that are summed over all buckets; other rows have an empty one.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        got = list(fn(key[0].as_py(), table["block"].to_pylist(), table["body"].to_pylist()))
        out = pa.Table.from_batches([_message_batch([g[0] for g in got], [g[1] for g in got], [g[2] for g in got])])
        return out.append_column("stat", pa.array([g[3] for g in got], pa.list_(pa.int64())))

    return sent.groupBy("bucket").applyInArrow(run, "bucket long, block long, body binary, stat array<long>")


def with_answers(blocks: DataFrame, answers: DataFrame, fn: Callable[[Block, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """``fn(block, {bucket: body})`` for every block with the answers sent to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right["bucket"].to_pylist(), right["body"].to_pylist(), strict=True))
        out = [fn(Block(row), got) for row in left.to_pylist()]
        return pa.concat_tables(out) if out else fn(Block({"block": -1, "doc_id": [], "n": [], "vocab": b"", "toks": b"", "tokens": 0}), {})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def buckets_for(tokens: int, bucket_keys: int = BUCKET_KEYS) -> int:
    return max(8, -(-tokens // bucket_keys))


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in their order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts) if order.size else []:
        yield int(bucket[at[0]]), at
