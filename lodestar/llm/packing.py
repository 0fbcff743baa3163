"""Operator 2: order-preserving packing into fixed-length sequences by dynamic programming.

Documents in id order form one stream of token ids. Cuts may fall at the end of a document, at the
end of a sentence (for a penalty) or, inside a stretch longer than a sequence, anywhere on a coarse
raster (for a larger one). ``f(j) = min f(i) + padding(p_j - p_i) + penalty(j)`` over cuts i within
one sequence of j; as padding is linear in p_i, the minimum slides along a monotone queue and each
cut enters and leaves it once.

The stream is cut into ranges of ids, one for each task; a task runs the programme over chunks and
hands the last, unfinished sequence of a chunk on to the next.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestar.llm.common import slim
from lodestar.llm.encode import encoder

CAPACITY = 4096
#: Tokens of padding that a cut at a sentence, and one inside a sentence, are worth.
SENTENCE_PENALTY, FORCED_PENALTY = 16, 256
CHUNK_TOKENS = 1 << 20
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def best_cuts(points: list[int], penalties: list[int], capacity: int) -> list[int]:
    """The cheapest of ``points`` (ascending, at most ``capacity`` apart, last one kept) to cut at; 0 is before them."""
    p, best, back = [0, *points], [0] * (len(points) + 1), [0] * (len(points) + 1)
    key = [0] * len(p)
    queue: deque[int] = deque([0])
    for j in range(1, len(p)):
        at = p[j]
        while at - p[queue[0]] > capacity:
            queue.popleft()
        i = queue[0]
        back[j], best[j] = i, key[i] - at + capacity + penalties[j - 1]
        k = best[j] + at
        while queue and key[queue[-1]] >= k:
            queue.pop()
        key[j] = k
        queue.append(j)
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: list[int], marks: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Places to cut, no two further apart than ``capacity``, and their penalties."""
    points = np.union1d(np.flatnonzero(np.isin(ids, marks)) + 1, ends).astype(np.int64)
    cost = np.where(np.isin(points, ends), 0, SENTENCE_PENALTY)
    gaps = np.diff(points, prepend=0)
    extra = [np.arange(points[i] - gaps[i], points[i], max(capacity // 16, 1))[1:] for i in np.flatnonzero(gaps > capacity)]
    if extra:
        more = np.concatenate(extra)
        points, cost = np.concatenate([points, more]), np.concatenate([cost, np.full(len(more), FORCED_PENALTY)])
        order = np.argsort(points, kind="stable")
        points, cost = points[order], cost[order]
    return points.tolist(), cost.tolist()


class Stream:
    """Ids of documents in order, of which finished sequences are taken off the front."""

    def __init__(self, marks: list[int], capacity: int, first_sequence: int):
        self.marks, self.capacity, self.sequence = marks, capacity, first_sequence
        self.parts: list[bytes] = []
        self.docs: list[list] = []  # id, tokens in all, tokens gone already, tokens here
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.parts.append(ids)
        self.docs.append([doc_id, n, 0, n])
        self.tokens += n

    def take(self, last: bool) -> list[tuple]:
        """Pieces of the sequences that are finished; ``last``: all are."""
        if not self.tokens:
            return []
        raw = b"".join(self.parts)
        ids = np.frombuffer(raw, "<u4")
        ends = np.cumsum([d[3] for d in self.docs]).tolist()
        cuts = best_cuts(*candidates(ids, ends, self.marks, self.capacity), self.capacity)
        if not last:
            cuts.pop()
        out, at, k = [], 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc = self.docs[k]
                n = min(cut - at, doc[3])
                out.append((doc[0], doc[2], n, zlib.crc32(raw[4 * at : 4 * (at + n)]), doc[1], self.sequence, offset))
                doc[2], doc[3], offset, at = doc[2] + n, doc[3] - n, offset + n, at + n
                k += doc[3] == 0
            self.sequence += 1
        self.docs, self.parts, self.tokens = self.docs[k:], [raw[4 * at :]], self.tokens - at
        return out


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids: columns OUT.

    ``tokenizer``: path of a vocabulary file of the tokenizers library, on every machine. Every
    document ends in ``end_id``; a null or empty text is that id alone. ``sequence_id`` counts up
    within a range of ids and is unique over all. Null ids come first, repeated ids are documents of
    their own. A text of any length is packed whole, in as many sequences as it needs. Only the two
    named columns are read, so names of others can't clash. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        marks = [i for m in ".!?" if (i := e.tokenizer.token_to_id(m + "</w>")) is not None]
        stream = Stream(marks, capacity, TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                for doc_id, x in zip(ids[at : at + 256], e.encode_batch([b.as_py() or b"" for b in bodies[at : at + 256]]), strict=True):
                    stream.add(doc_id, x + end)
                    if stream.tokens >= chunk_tokens:
                        yield rows(stream.take(False))
        yield rows(stream.take(True))

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = zip(*pieces, strict=True) if pieces else [[]] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=pa.schema(_FIELDS))

    return slim(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body").mapInArrow(run, OUT)
