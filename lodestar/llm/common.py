"""Helpers shared by the training-data operators.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which every executor and the
driver can see, and are read back from there: a lost executor costs a re-read and no lineage.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
import zlib
from functools import reduce
from operator import and_
from types import TracebackType

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lodestar-")
    return "file://" + _LOCAL[app]


class _Cleanup:
    """Shuffle files go with the write that made them, while at least one write of a session runs."""

    _lock, _running = threading.Lock(), {}

    def __init__(self, spark: SparkSession):
        self.spark, self.key = spark, id(spark._jsparkSession)

    def __enter__(self) -> None:
        with self._lock:
            n, before = self._running.get(self.key, (0, None))
            if not n:
                before = self.spark.conf.get(_CLEANUP, "false")
                self.spark.conf.set(_CLEANUP, "true")
            self._running[self.key] = n + 1, before

    def __exit__(self, *_: object) -> None:
        with self._lock:
            n, before = self._running.pop(self.key)
            if n > 1:
                self._running[self.key] = n - 1, before
            else:
                self.spark.conf.set(_CLEANUP, before)


class Workspace:
    """A folder of written intermediate tables of one operator call.

    As a context it goes if the call fails; tables that a result still reads stay until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        self.rounds: list[str] = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if kind:
            self.drop()

    def write(self, df: DataFrame, name: str, row_group_mb: int = 16) -> DataFrame:
        """Write ``df`` as Parquet and read it back. Shuffle files of the write are removed.

        No mark of success is written, as a failed write raises: where Hadoop lacks its native library, the
        driver starts a process for each file's mode, which shares the JVM's memory until it runs its program.
        """
        path = f"{self.root}/{name}"
        with _Cleanup(self.spark):
            df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").option("compression", "zstd").option("parquet.block.size", row_group_mb << 20).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def round(self, name: str) -> str:
        """A new name for a table of an iteration, kept in ``rounds``."""
        self.rounds.append(f"{name}{len(self.rounds)}")
        return self.rounds[-1]

    def drop(self, *names: str) -> None:
        """Delete tables that are no longer needed (all: no name)."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in [f"{self.root}/{n}" for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(hadoop).delete(path, True)


#: Keys whose rows are joined by broadcast, at most.
HOT_KEYS = 50_000


def join_hot(left: DataFrame, right: DataFrame, key: str, *on: Column, size: str) -> DataFrame:
    """``left`` (a) joined with ``right`` (b), which has one row for each ``key``; rows of hot keys stay where they are.

    A key is hot if it has more than a share of 1 / HOT_KEYS of all rows of ``left``, so that there are
    HOT_KEYS at most: only their rows of ``right`` are broadcast. ``size``: the column of ``right`` with
    the number of the key's rows in ``left``. Null keys join nothing.
    """
    least = max((right.agg(F.sum(size)).first()[0] or 0) // HOT_KEYS, 1000)
    hot = F.col(size) > least
    hot_keys = F.broadcast(right.filter(hot))
    met = left.alias("a").join(hot_keys.alias("b"), reduce(and_, on))
    cold = left.join(F.broadcast(right.filter(hot).select(F.col(key).alias("__hot"))), F.col(key) == F.col("__hot"), "left_anti")
    rest = cold.alias("a").join(right.filter(~hot).alias("b"), reduce(and_, on))
    return _union_joined(met, rest, left.columns, right.columns)


def _union_joined(one: DataFrame, two: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """The union of two joins of the aliases a and b, again with those aliases as structs."""

    def packed(df: DataFrame) -> DataFrame:
        return df.select(F.struct(*[F.col(f"a.`{c}`") for c in left]).alias("a"), F.struct(*[F.col(f"b.`{c}`") for c in right]).alias("b"))

    return packed(one).unionByName(packed(two))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, body binary): UTF-8 bytes of the whole text; every other column goes, clashing names with it."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body"))


def crc_mod(doc_id: int | None, k: int) -> int:
    """crc32 of the id as decimal text, modulo k; null ids give -1, which no fold has."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % k


_SIZES = (np.uint8, np.uint16, np.uint32, np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message: unsigned integers in their smallest width, floats as float64."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind == "f":
            a, code = a.astype(np.float64), 9
        else:
            top = int(a.max()) if a.size else 0
            code = next(i for i, t in enumerate(_SIZES) if top <= np.iinfo(t).max)
            a = a.astype(_SIZES[code])
        parts += [bytes([code]), a.size.to_bytes(8, "little"), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`; integers come back as uint64."""
    raw, at, out = memoryview(zstandard.ZstdDecompressor().decompress(blob)), 0, []
    while at < len(raw):
        kind = np.float64 if raw[at] == 9 else _SIZES[raw[at]]
        n = int.from_bytes(raw[at + 1 : at + 9], "little")
        end = at + 9 + n * np.dtype(kind).itemsize
        a = np.frombuffer(raw[at + 9 : end], kind)
        out.append(a if kind is np.float64 else a.astype(np.uint64))
        at = end
    return out


def join_two(a: bytes, b: bytes) -> bytes:
    """Two byte strings as one."""
    return len(a).to_bytes(8, "little") + a + b


def split_two(x: bytes) -> tuple[bytes, bytes]:
    cut = 8 + int.from_bytes(x[:8], "little")
    return x[8:cut], x[cut:]


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted uint64 values as differences, byte plane by byte plane, so that the high planes vanish."""
    d = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    h = h.astype(np.uint64)
    for shift, k in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(k)
    return h ^ (h >> np.uint64(33))
