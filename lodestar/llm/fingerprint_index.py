"""Operator 3 between calls: a log-structured index of the window hashes of all earlier batches.

The index is a folder that every executor sees. Its sorted immutable runs are Parquet files bucketed
and sorted by both hashes of a window (128 bits together). A batch is hashed once, dealt to the same
buckets and merge-joined with each run in turn, so that no run is ever shuffled; its windows that no
run has become a new run, and runs of like size at the end of the log are compacted into one.

A manifest names the live runs and the batches they hold. It is written after everything else, so a
job that fails leaves the index as it was, and a batch that is in already gives its stored result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.blocks import BLOCK_TOKENS, BUCKET_KEYS, Block, token_blocks
from lodestar.llm.common import Workspace, pack
from lodestar.llm.substring_dedup import EARLIER, OUT, Windows, kept_words

_KEYS = ["h1", "h2"]


def compactable(sizes: list[int]) -> int:
    """How many runs at the end to merge into one, such that each run is at least twice the next."""
    n, total = 1, sizes[-1] if sizes else 0
    while n < len(sizes) and total * 2 > sizes[-n - 1]:
        total += sizes[-n - 1]
        n += 1
    return n


def window_hashes(blocks: DataFrame, width: int) -> DataFrame:
    """(block, h1, h2) of every distinct window of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = Windows(Block(row), width)
                h1, h2 = (pa.array(h[w.first].view("i8")) for h in (w.h1, w.h2))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(h1), pa.int64()), h1, h2], names=["block", "h1", "h2"])

    return blocks.mapInArrow(run, "block long, h1 long, h2 long")


def _bodies(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    body = pack(*(table[c].to_numpy().view("u8") for c in _KEYS))
    return pa.table({"bucket": pa.array([EARLIER], pa.int64()), "block": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([body], pa.binary())})


class FingerprintIndex:
    """The index in folder ``path``; ``width`` and ``buckets`` are fixed when the first batch goes in.

    ``buckets`` should grow with the corpus that the index will hold: a task of the merge-join reads
    one bucket of one run. One writer at a time; a second one fails when it writes its manifest.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = 20, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.state = self._read() or {"version": 0, "width": width, "buckets": buckets, "runs": [], "batches": {}}
        if self.state["width"] != width:
            raise ValueError(f"the index has windows of {self.state['width']} words, not {width}")

    def _versions(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in found)

    def _read(self) -> dict | None:
        seen = self._versions()
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{seen[-1]:09d}", wholetext=True).first()[0]) if seen else None

    def _commit(self, state: dict) -> None:
        text = self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1)
        text.write.mode("errorifexists").text(f"{self.path}/manifest-{state['version']:09d}")
        gone = {r["name"] for r in self.state["runs"]} - {r["name"] for r in state["runs"]}
        for name in [*gone, *(f"manifest-{v:09d}" for v in self._versions() if v < state["version"])]:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        self.state = state

    def _open(self, name: str) -> tuple[str, DataFrame]:
        """A catalog name for a run's files, and the run; the name goes with :meth:`_close`, the files stay."""
        table = f"lodestar_{uuid.uuid4().hex}"
        n, place = self.state["buckets"], f"{self.path}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {table} (h1 BIGINT, h2 BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {n} BUCKETS LOCATION '{place}'")
        return table, self.spark.table(table)

    def _close(self, *tables: str) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")

    def _write_run(self, df: DataFrame) -> str:
        name, table, n = f"run-{uuid.uuid4().hex[:12]}", f"lodestar_{uuid.uuid4().hex}", self.state["buckets"]
        df.select(*_KEYS).repartition(n, *_KEYS).write.format("parquet").bucketBy(n, *_KEYS).sortBy(*_KEYS).option("path", f"{self.path}/{name}").saveAsTable(table)
        self._close(table)
        return name

    def marked(self, hashes: DataFrame, runs: list[DataFrame]) -> DataFrame:
        """(h1, h2, old): the distinct pairs, and whether a run has them. Runs are disjoint, so no pair is doubled."""
        out = hashes.select(*_KEYS).repartition(self.state["buckets"], *_KEYS).distinct().withColumn("old", F.lit(False))
        for run in runs:
            out = out.join(run.withColumn("__in", F.lit(True)).hint("merge"), _KEYS, "left")
            out = out.select(*_KEYS, (F.col("old") | F.coalesce("__in", F.lit(False))).alias("old"))
        return out

    def dedup(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
        """Columns of :func:`substring_dedup` for a new batch; every earlier batch comes before all its documents.

        ``batch`` names it: a name that the index has gives the stored result and changes nothing.
        Nulls, empty, short and repeated texts are as there; an empty batch adds no run.
        """
        if batch in self.state["batches"]:
            return self.spark.read.schema(OUT).parquet(f"{self.path}/{self.state['batches'][batch]}")
        ws = Workspace(self.spark, "index")
        blocks = ws.write(token_blocks(docs, id_col, text_col, lower=False, block_tokens=block_tokens), "blocks")
        width, runs = self.state["width"], self.state["runs"]
        hashes = ws.write(window_hashes(blocks, width), "hashes")
        tables, live = zip(*(self._open(r["name"]) for r in runs), strict=True) if runs else ((), ())
        try:
            marked = ws.write(self.marked(hashes, list(live)), "marked")
            old = hashes.join(marked.filter("old").select(*_KEYS), _KEYS)
            earlier = old.groupBy("block").applyInArrow(_bodies, "bucket long, block long, body binary")
            out = kept_words(ws, blocks, width, bucket_keys, earlier)
            name = f"result-{uuid.uuid4().hex[:12]}"
            out.write.parquet(f"{self.path}/{name}")
            state = self.state | {"version": self.state["version"] + 1, "batches": self.state["batches"] | {batch: name}}
            fresh = marked.filter("not old")
            if size := fresh.count():
                n = compactable([r["rows"] for r in runs] + [size])
                for run in live[len(live) - n + 1 :]:
                    fresh = fresh.select(*_KEYS).unionByName(run)
                merged = runs[len(runs) - n + 1 :]
                state["runs"] = runs[: len(runs) - n + 1] + [{"name": self._write_run(fresh), "rows": size + sum(r["rows"] for r in merged)}]
            self._commit(state)
        finally:
            self._close(*tables)
        ws.drop()
        return self.spark.read.schema(OUT).parquet(f"{self.path}/{name}")
