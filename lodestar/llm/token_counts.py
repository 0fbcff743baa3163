"""Operator 6: token counts of fields or sections by offset-mapped attribution.

A document is encoded once as a whole. The tokens of a byte-level vocabulary tile the text, so the
running sum of their byte lengths gives every token's span. Fields are intervals of characters; a
binary search of their ends in the ordered spans joins the two. A token that crosses a boundary goes
by the rule:

- ``start``: to the field that holds its first byte;
- ``end``: to the one that holds its last byte;
- ``middle``: to the one that holds its middle byte (the earlier of two);
- ``split``: to each field in proportion to the bytes that it holds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "middle", "split")


class ByteTokens:
    """A tiktoken encoding of a rank file, and the byte length of each of its tokens."""

    _open: dict[tuple[str, str], "ByteTokens"] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    @classmethod
    def of(cls, path: str, pattern: str) -> "ByteTokens":
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]


def attribute(lengths: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each interval [first, last) of bytes, for tokens of the given byte lengths in order."""
    ends = np.cumsum(lengths)
    if rule == "split":
        edges, n = np.concatenate([[0], ends]), np.arange(len(ends) + 1)
        return np.interp(last, edges, n) - np.interp(first, edges, n)
    at = {"start": ends - lengths, "end": ends - 1, "middle": ends - lengths + (lengths - 1) // 2}[rule]
    return np.searchsorted(at, last) - np.searchsorted(at, first)


def token_counts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None, rule: str = "start") -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens (double for ``split``): one row per field.

    ``spans_col``: a column array<struct<start, end>> of fields in characters, in any order and free
    to overlap; beyond the text's end they are cut. By default the fields are the lines of the text,
    each with its line end, so their counts add up to the whole document's. A null or empty text has
    one empty section without tokens. Repeated rows and null ids are returned as they come. A text of
    any length is encoded whole. Only the named columns are read, so names of others can't clash.
    Empty table: no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    number = pa.float64() if rule == "split" else pa.int64()
    spans = F.transform(F.col(spans_col), lambda s: F.struct(s["start"].cast("long").alias("a"), s["end"].cast("long").alias("b"))) if spans_col else F.lit(None).cast("array<struct<a:long,b:long>>")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"), spans.alias("spans"))

    def one(tokens: ByteTokens, text: str, given: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(text.encode(), np.uint8)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
        if given is None:
            after = np.flatnonzero(raw == 10) + 1
            edges = np.unique(np.concatenate([[0], after, [len(raw)]]))
            first, last = (edges[:-1], edges[1:]) if len(edges) > 1 else (np.array([0]), np.array([0]))
            a, b = np.searchsorted(heads, first), np.searchsorted(heads, last)
        else:
            a, b = (np.clip(np.array([s[k] or 0 for s in given if s], np.int64), 0, len(heads)) for k in "ab")
            bytes_at = np.concatenate([heads, [len(raw)]])
            first, last = bytes_at[a], bytes_at[np.maximum(a, b)]
        return a, b, attribute(tokens.lengths[np.array(tokens.encode(text), np.int64)], first, last, rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens.of(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = some.column(0).to_pylist()
                got = [one(tokens, x or "", s) for x, s in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
                sizes = np.array([len(g[0]) for g in got])
                doc = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
                section = np.concatenate([np.arange(n) for n in sizes])
                yield pa.RecordBatch.from_arrays([doc, pa.array(section, pa.int64()), *(pa.array(np.concatenate([g[i] for g in got]), t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, number)))], names=["doc_id", "section", "start_char", "end_char", "n_tokens"])

    return texts.mapInArrow(run, f"doc_id long, section long, start_char long, end_char long, n_tokens {'double' if rule == 'split' else 'long'}")
