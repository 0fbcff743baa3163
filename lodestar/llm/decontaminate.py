"""Operator 5: benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

The test items are a stated query set: they are taken in blocks of bounded size, and each block goes
once over all documents. Every n-gram of an item is a seed, however many documents hold it, so what is
found in a document does not depend on the others. A document that holds a seed is aligned with the item
around it, unless the two share too few words there to reach the threshold in any order; the score is
the best local alignment over that of a perfect copy.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import slim

#: Bytes of item texts in a block, about.
BLOCK_BYTES = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
OUT = "doc_id long, item_id long, score double, n_seeds long"


def words(body: bytes | None) -> list[bytes]:
    """Lower case; ASCII letters, digits and all characters beyond ASCII make words."""
    body = body or b""
    return (body if body.isascii() else body.decode("utf-8", "replace").lower().encode()).translate(_WORDS).split()


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """The best local alignment score of two sequences of word ids, with linear gaps."""
    n = len(b)
    ramp = np.arange(n + 1, dtype=np.int32) * -GAP
    row, best = np.zeros(n + 1, np.int32), 0
    for x in a:
        diagonal = row[:-1] + np.where(b == x, MATCH, MISMATCH)
        cell = np.zeros(n + 1, np.int32)
        np.maximum(np.maximum(diagonal, row[1:] + GAP), 0, out=cell[1:])
        row = np.maximum.accumulate(cell + ramp) - ramp
        best = max(best, int(row.max()))
    return best


class Items:
    """A block of test items as word ids, and the n-grams they are found by (shorter items: all their words)."""

    def __init__(self, rows: list[tuple[int, bytes]], n: int):
        self.n, self.ids, self.vocab, self.texts = n, [], {}, []
        for item_id, body in rows:
            if ws := words(body):
                self.ids.append(item_id)
                self.texts.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64))
        self.words = [np.unique(t, return_counts=True) for t in self.texts]
        self.base = len(self.vocab) + 1
        places = defaultdict(list)
        for k, t in enumerate(self.texts):
            size = min(n, len(t))
            for at, code in enumerate(self.codes(t, size)):
                places[size, int(code)].append((k, at))
        self.grams = sorted(places)
        self.places = [places[g] for g in self.grams]
        self.by_size = {s: (np.array([c for z, c in self.grams if z == s], np.int64), next(i for i, g in enumerate(self.grams) if g[0] == s)) for s in {g[0] for g in self.grams}}

    def codes(self, t: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(max(len(t) - size + 1, 0), np.int64)
        for i in range(size):
            out = out * self.base + t[i : i + len(out)]
        return out

    def read(self, body: bytes | None) -> np.ndarray:
        ws = words(body)
        get = self.vocab.get
        return np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))

    def hits(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the n-gram, place) for each place of ``t`` where an n-gram of the block starts."""
        grams, places = [], []
        for size, (codes, first) in self.by_size.items():
            runs = np.convolve(t > 0, np.ones(size, int), "valid") == size if len(t) >= size else np.empty(0, bool)
            at = np.flatnonzero(runs)
            if len(at):
                code = np.zeros(len(at), np.int64)
                for i in range(size):
                    code = code * self.base + t[at + i]
                k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                ok = codes[k] == code
                grams.append(k[ok] + first)
                places.append(at[ok])
        return (np.concatenate(grams), np.concatenate(places)) if grams else (np.empty(0, np.int64),) * 2

    def common(self, k: int, t: np.ndarray) -> int:
        """How many words item ``k`` shares with ``t``, in any order: no alignment matches more."""
        own, counts = self.words[k]
        at = np.minimum(np.searchsorted(own, t), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == t], minlength=len(own)), counts).sum())

    def scores(self, t: np.ndarray, threshold: float) -> Iterator[tuple[int, float, int]]:
        """(item id, best score, n-grams found) of each item at or above ``threshold`` that has an n-gram in ``t``.

        An alignment that reaches the threshold has room for so many insertions only: a window that
        wide around an n-gram holds all of it.
        """
        starts = defaultdict(list)
        for g, p in zip(*(x.tolist() for x in self.hits(t)), strict=True):
            for k, at in self.places[g]:
                starts[k].append(p - at)
        for k, found in starts.items():
            item = self.texts[k]
            m, best = len(item), 0
            enough = threshold * MATCH * m
            slack = max(int(MATCH * m - enough), 0) // -GAP + 1
            found.sort()
            cuts = [0, *(i for i in range(1, len(found)) if found[i] - found[i - 1] > m), len(found)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                window = t[max(found[i] - slack, 0) : found[j - 1] + m + slack]
                if MATCH * self.common(k, window) >= enough:
                    best = max(best, smith_waterman(item, window))
            if best / (MATCH * m) >= threshold:
                yield self.ids[k], best / (MATCH * m), len(found)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 3, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold a test item or an edited copy: columns OUT, a row for each document row and item at or above ``threshold``.

    Found are copies that keep ``n`` words of the item in a row; n_seeds counts the n-grams found.

    Null and empty texts and items match nothing. A null document id is returned as such; repeated
    rows are all reported. Texts of any length are read whole. Only the named columns are read, so
    names of others can't clash. Empty tables give no rows.
    """
    texts = slim(docs, id_col, text_col)
    out = [_report(texts, block, threshold) for block in item_blocks(benchmark, item_col, item_text, n, block_bytes)]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], OUT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 3, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item at or above ``threshold``. Null and empty texts stay."""
    names, at = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # a name may hold a dot
    for block in item_blocks(benchmark, item_col, item_text, n, block_bytes):
        docs = docs.mapInArrow(_keeper(block, threshold, at), docs.schema)
    return docs.toDF(*names)


def item_blocks(benchmark: DataFrame, item_col: str, item_text: str, n: int, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of some ``block_bytes`` each, one after the other on the driver."""
    items = slim(benchmark, item_col, item_text)
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // block_bytes))
    for part in range(parts):
        block = Items([(r.doc_id, bytes(r.body or b"")) for r in items.filter(F.pmod(F.xxhash64("doc_id", "body"), F.lit(parts)) == part).collect()], n)
        if block.texts:
            yield block


def _keeper(items: Items, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [next(items.scores(items.read((x.as_py() or "").encode()), threshold), None) is None for x in b.column(at)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return run


def _report(texts: DataFrame, items: Items, threshold: float) -> DataFrame:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(doc_id, *s) for doc_id, body in zip(b.column(0).to_pylist(), b.column(1), strict=True) for s in items.scores(items.read(body.as_py()), threshold)]
            columns = zip(*got, strict=True) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "n_seeds"])

    return texts.mapInArrow(align, OUT)
