"""Operator 8: exact deduplication by a Grace hash join of the table with itself.

Texts are normalised and first compared within their input partition, so that a group of copies of
any size sends one text for each partition. Those representatives are dealt out by hash; those of a
hash that many partitions hold are merged in two steps, by parts of them first. A task merges what it
reads into an open-addressing table that holds each distinct content once; if the contents outgrow it,
they are partitioned to spill files by further bits of the hash, again and again, until each bucket
fits. Equal means that the complete normalised contents are equal; the hash only finds the slot.
Spill files live in the task's temporary folder and go with the task, which Spark can run anew anywhere.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import ExitStack
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.llm.common import Workspace, slim

#: Bytes of distinct content that one table holds.
TABLE_BYTES = 48 << 20
FANOUT_BITS = 4
#: Representatives of one hash beyond which they are merged in two steps.
MANY = 64
_SPACES = bytes(32 if 9 <= i <= 13 else i for i in range(256))


def normalise(body: bytes | None) -> bytes:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty."""
    body = (body or b"").translate(_SPACES)
    while b"  " in body:
        body = body.replace(b"  ", b" ")
    return body


class OpenTable:
    """Open addressing with linear probing; entries are compared by complete content."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents, self.bytes = [-1] * 1024, [], [], 0

    def place(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of a content, and if it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            at = (at + 1) & mask
        self.slots[at] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


class Group:
    """Rows known to have one content: its best row (1 for a null id, id, representative), how many they are, and their representatives."""

    __slots__ = ("hash", "content", "best", "rows", "reps")

    def __init__(self, h: int, content: bytes, best: tuple[int, int, int], rows: int, reps: array):
        self.hash, self.content, self.best, self.rows, self.reps = h, content, best, rows, reps


_HEAD = struct.Struct("<QBqqqIQ")  # hash, best row, rows, representatives, bytes of content


def _write(f: BinaryIO, g: Group) -> None:
    f.write(_HEAD.pack(g.hash, *g.best, g.rows, len(g.reps), len(g.content)))
    g.reps.tofile(f)
    f.write(g.content)


def _read(path: Path) -> Iterator[Group]:
    with path.open("rb") as f:
        while head := f.read(_HEAD.size):
            h, null, key, rep, rows, n, size = _HEAD.unpack(head)
            reps = array("q")
            reps.fromfile(f, n)
            yield Group(h, f.read(size), (null, key, rep), rows, reps)


def _bucket(g: Group, level: int) -> int:
    """The bits of a level; when those of the hash are used up, those of others of the content."""
    turn, place = divmod(level, 64 // FANOUT_BITS)
    h = g.hash if not turn else xxhash.xxh3_64_intdigest(g.content, seed=turn)
    return h >> (64 - FANOUT_BITS * (place + 1)) & ((1 << FANOUT_BITS) - 1)


def grace(groups: Iterable[Group], limit: int, level: int = 0, folder: Path | None = None) -> Iterator[Group]:
    """One group for each distinct content; the contents in memory, each once, exceed ``limit`` bytes by one at most."""
    groups = iter(groups)
    merged, whole = _merged(groups, limit)
    if whole:
        yield from merged
        return
    with tempfile.TemporaryDirectory(dir=folder) as own:
        paths = [Path(own, str(i)) for i in range(1 << FANOUT_BITS)]
        _spill(merged, groups, level, paths)
        for p in paths:
            if p.stat().st_size:
                yield from grace(_read(p), limit, level + 1, Path(own))
            p.unlink()


def _merged(groups: Iterator[Group], limit: int) -> tuple[list[Group], bool]:
    """Groups of equal content as one, as far as they fit, and whether that is all of them."""
    table, merged = OpenTable(), []
    for g in groups:
        e, new = table.place(g.hash, g.content)
        if new:
            merged.append(g)
        else:
            m = merged[e]
            m.best, m.rows = min(m.best, g.best), m.rows + g.rows
            m.reps.extend(g.reps)
        table.bytes += 8 * len(g.reps)
        if table.bytes > limit and len(merged) > 1:
            return merged, False
    return merged, True


def _spill(merged: list[Group], groups: Iterator[Group], level: int, paths: list[Path]) -> None:
    with ExitStack() as stack:
        files = [stack.enter_context(p.open("wb")) for p in paths]
        while merged:
            g = merged.pop()
            _write(files[_bucket(g, level)], g)
        for g in groups:
            _write(files[_bucket(g, level)], g)


_LOCAL = pa.schema([("rep", pa.int64()), ("doc_id", pa.int64()), ("first", pa.bool_()), ("sha", pa.string()), ("hash", pa.int64()), ("rows", pa.int64()), ("body", pa.binary())])
_CLASS = pa.schema([("rep", pa.int64()), ("keep_rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_GROUP = pa.schema([("hash", pa.int64()), ("body", pa.binary()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("rows", pa.int64()), ("reps", pa.list_(pa.int64()))])
GROUP = "hash long, body binary, doc_id long, rep long, rows long, reps array<long>"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda r: 0) -> Iterator[pa.RecordBatch]:
    """Batches of 20,000 rows or 8 MB at most, but for a larger row."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if len(held) >= 20_000 or total > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    for b in batches:
        for h, key, rep, rows, reps, content in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), b.column(1), strict=True):
            yield Group(h % (1 << 64), content.as_py(), (int(key is None), key or 0, rep), rows, array("q", reps))


def _merge(table_bytes: int, classes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups of equal content as one, or (``classes``) the class of each of their representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = grace(_groups(batches), table_bytes)
        if classes:
            yield from _batches(((rep, g.best[2], None if g.best[0] else g.best[1], g.rows) for g in merged for rep in g.reps), _CLASS)
        else:
            yield from _batches(((_signed(g.hash), g.content, None if g.best[0] else g.best[1], g.best[2], g.rows, g.reps) for g in merged), _GROUP, lambda r: len(r[1]))

    return run


def classes(ws: Workspace, reps: DataFrame, table_bytes: int) -> DataFrame:
    """(rep, keep_rep, keep_id, group_size) for ``reps``: hash, rep, doc_id, rows, body."""
    reps = reps.select("hash", "body", "doc_id", "rep", "rows", F.array("rep").alias("reps"))
    size = reps.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(8, -(-size // table_bytes))
    many = ws.write(reps.groupBy("hash").agg(F.count("*").alias("copies")).filter(F.col("copies") > MANY), "many")
    if not many.isEmpty():
        share = F.pmod("rep", F.ceil(F.sqrt("copies")))
        some = reps.join(many, "hash").select(*reps.columns, share.alias("share")).repartition(parts, "hash", "share").drop("share")
        reps = reps.join(many, "hash", "left_anti").unionByName(some.mapInArrow(_merge(table_bytes, False), GROUP))
    found = reps.repartition(parts, "hash").mapInArrow(_merge(table_bytes, True), "rep long, keep_rep long, keep_id long, group_size long")
    return ws.write(found, "classes")


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text) for every row of ``docs``.

    Null text counts as empty. The smallest id of equal texts stays, a null id only if all are null;
    of rows that repeat it exactly one is ``kept``. A text larger than ``table_bytes`` is compared
    whole, in a table of its own. Only the two named columns are read, so names of others can't
    clash. Empty table: no rows.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        table, members = OpenTable(), []

        def rows() -> Iterator[tuple]:
            nonlocal seq
            for e, ids in enumerate(members):
                rep, content = (part << 32) | seq, table.contents[e]
                seq += 1
                ids.sort(key=lambda i: (i is None, i or 0))
                sha, h = hashlib.sha256(content).hexdigest(), _signed(table.hashes[e])
                for k, i in enumerate(ids):
                    yield rep, i, k == 0, sha, h, len(ids), None if k else content

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = normalise(body.as_py())
                e, new = table.place(xxhash.xxh3_64_intdigest(content), content)
                if new:
                    members.append([])
                members[e].append(doc_id)
                table.bytes += 40
                if table.bytes > table_bytes:
                    yield from _batches(rows(), _LOCAL, lambda r: len(r[6] or b""))
                    table, members = OpenTable(), []
        yield from _batches(rows(), _LOCAL, lambda r: len(r[6] or b""))

    with Workspace(spark, "exact") as ws:
        rows = ws.write(slim(docs, id_col, text_col).mapInArrow(local, "rep long, doc_id long, first boolean, sha string, hash long, rows long, body binary"), "rows")
        found = classes(ws, rows.filter("first"), table_bytes)
        out = rows.select("rep", "doc_id", "first", "sha").join(found, "rep").select("doc_id", "keep_id", "group_size", (F.col("first") & (F.col("rep") == F.col("keep_rep"))).alias("kept"), F.col("sha").alias("text_sha256"))
        out = ws.write(out, "out")
        ws.drop("rows", "many", "classes")
    return out


def without_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that :func:`exact_dedup` keeps.

    The rows travel with their representatives, so that what stays is told by the representatives that
    go. Columns are renamed on the way: any name does.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = names.index(id_col), names.index(text_col)
    extra = "rep long, doc_id long, hash long, rows long, body binary"
    schema = StructType([*plain.schema.fields, *StructType.fromDDL(extra).fields])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        table, best, rows, where, taken, size = OpenTable(), [], [], [], [], 0

        def flush(pending: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            nonlocal seq, table, best, rows, where, taken, size
            if pending is not None:
                taken.append(pending)
            held = pa.Table.from_batches(taken) if taken else None
            step = max(1, len(best) * (8 << 20) // max(table.bytes, 1))
            for i in range(0, len(best), step):
                n = len(best[i : i + step])
                reps = pa.array([(part << 32) | (seq + k) for k in range(n)], pa.int64())
                seq += n
                more = [reps, pa.array([b[1] for b in best[i : i + step]], pa.int64()), pa.array([_signed(h) for h in table.hashes[i : i + step]], pa.int64()), pa.array(rows[i : i + step], pa.int64()), pa.array(table.contents[i : i + step], pa.binary())]
                some = held.take(pa.array(where[i : i + step])).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in some.columns), *more], names=[*held.column_names, "rep", "doc_id", "hash", "rows", "body"])
            table, best, rows, where, taken, size = OpenTable(), [], [], [], [], 0

        for batch in batches:
            wanted: list[int] = []
            texts = batch.column(at_text).cast(pa.string()).cast(pa.binary())
            for i, (doc_id, body) in enumerate(zip(batch.column(at_id).cast(pa.int64()).to_pylist(), texts, strict=True)):
                content = normalise(body.as_py())
                e, new = table.place(xxhash.xxh3_64_intdigest(content), content)
                key = (doc_id is None, doc_id)
                if new:
                    best.append(key)
                    rows.append(0)
                    where.append(0)
                rows[e] += 1
                if new or (not key[0] and (best[e][0] or doc_id < best[e][1])):
                    best[e], where[e] = key, size + len(wanted)
                    wanted.append(i)
                    table.bytes += 64
                if table.bytes > table_bytes:
                    yield from flush(batch.take(pa.array(wanted)))
                    wanted = []
            if wanted:
                taken.append(batch.take(pa.array(wanted)))
                size += len(wanted)
        yield from flush(None)

    with Workspace(spark, "copies") as ws:
        rows = ws.write(plain.mapInArrow(local, schema), "rows")
        found = classes(ws, rows.select("hash", "rep", "doc_id", "rows", "body"), table_bytes)
        gone = found.filter("rep <> keep_rep").select("rep")
        return rows.join(gone, "rep", "left_anti").select(*plain.columns).toDF(*names)


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
