"""Operator 9: minimax contiguous partition of atomic groups into shards, in DataFrame operations only.

Rows of equal text form a group that is never divided. Groups stand in the order of their smallest
id. The smallest capacity for which a greedy pass needs no more than the given number of shards is
found by binary search, and the cuts of that pass are the shards.

A greedy pass only asks for the last group boundary at or before a byte position. The driver holds
the last boundary of each cell of a raster, from which a pass with pessimistic and one with
optimistic answers bracket the capacity and each cut; the raster is then refined inside those
brackets only, until the answers agree. A raster has some 1,000 cells for each shard at most,
whatever the size of the table.

A group larger than an equal share of what is left takes a shard of its own before, so the remaining
shards stay near equal.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Workspace

OVERHEAD = 16
#: Cells of the raster per shard, and rows of a part into which the order of ids is divided.
CELLS, PART_ROWS = 1000, 1 << 17


class Boundaries:
    """The last group boundary of each cell of a raster, where passes of interest look."""

    def __init__(self, ends: list[int], width: int, total: int):
        self.ends, self.width, self.total = sorted({*ends, total}), width, total

    def before(self, x: int, hopeful: bool) -> int:
        """The last boundary at or before x: exact, or if x's cell has later ones a bound from below or above."""
        if x >= self.total:
            return self.total
        i = bisect_right(self.ends, x)
        if hopeful and (self.ends[i] - 1) // self.width == (x - 1) // self.width:
            return x
        return self.ends[i - 1] if i else 0


def greedy(b: Boundaries, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
    """Ends of the shards that a greedy pass fills, None if ``shards`` don't hold all."""
    at, cuts = 0, []
    while at < b.total:
        if len(cuts) == shards or (end := b.before(at + capacity, hopeful)) <= at:
            return None
        cuts.append(at := end)
    return cuts


def least_capacity(b: Boundaries, shards: int, low: int, high: int, hopeful: bool) -> int:
    """The smallest capacity in [low, high] that a pass needs; high is known to do."""
    while low < high:
        mid = (low + high) // 2
        if greedy(b, mid, shards, hopeful) is None:
            low = mid + 1
        else:
            high = mid
    return low


def brackets(b: Boundaries, low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """Disjoint stretches that hold every cut of any pass with a capacity from low to high."""
    out: list[tuple[int, int]] = []
    x = y = 0
    for _ in range(shards):
        x, y = max(x, b.before(x + low, False)), b.before(y + high, True)
        first, last = max(x - b.width, 0), y + b.width
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """End positions of at most ``shards`` shards of the smallest possible capacity.

    ``groups`` has ``byte_end``, the position after each group in order.
    """
    low, high = max(-(-total // shards), largest), total
    width, spans = max(total // (shards * CELLS), 1), [(0, total)]
    while True:
        inside = reduce(or_, [(F.col("byte_end") > x) & (F.col("byte_end") <= y) for x, y in spans])
        cells = groups.filter(inside).groupBy(F.expr(f"(byte_end - 1) div {width}").alias("cell"))
        b = Boundaries([r.e for r in cells.agg(F.max("byte_end").alias("e")).collect()], width, total)
        low, high = least_capacity(b, shards, low, high, True), least_capacity(b, shards, low, high, False)
        if width == 1:
            return greedy(b, high, shards, False) or []
        spans, width = brackets(b, low, high, shards), max(width // 32, 1)


def minimax_shards(spark: SparkSession, docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null) for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 16, however long; a null text has no bytes and goes with the
    empty ones. Slots count from 0 in a shard, by group and then id. A null id comes before all others,
    and so does a group that has one; repeated rows come in any order. Ids may be any long values.
    Only the two named columns are read, so names of others can't clash. Empty table: no rows.
    """
    with Workspace(spark, "shards") as ws:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g"), F.monotonically_increasing_id().alias("pos"))
        # Parts of the order of ids with about equally many rows, by the sampled bounds of a range exchange.
        rows = ws.write(rows, "unsorted")
        parts = max(8, -(-rows.count() // part_rows))
        rows = ws.write(rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.asc("pos")).withColumn("part", F.spark_partition_id()), "rows")
        pieces = ws.write(rows.groupBy("g", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.struct("doc_id", "pos")).alias("least")), "pieces")
        groups = ws.write(pieces.groupBy("g").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.min("part").alias("part")), "groups")

        left, own = groups.agg(F.sum("bytes")).first()[0] or 0, []
        big = groups.orderBy(F.desc("bytes"), "g").limit(shards).select("g", "bytes").collect()
        for r in big:
            if len(own) + 1 < shards and r.bytes * (shards - len(own)) > left:
                own.append(bytes(r.g))
                left -= r.bytes
        alone = F.lit(None).cast("int")
        for k, g in enumerate(own):
            alone = F.when(F.col("g") == F.lit(g), k).otherwise(alone)
        groups = groups.withColumn("alone", alone)

        # Positions in bytes and rows: sums by part of the order, then within a part.
        shared = groups.filter(F.col("alone").isNull())
        sums = shared.groupBy("part").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"))
        over = Window.orderBy("part")
        sums = sums.select("part", (F.sum("b").over(over) - F.col("b")).alias("b0"), (F.sum("r").over(over) - F.col("r")).alias("r0"))
        within = Window.partitionBy("part").orderBy("least", "g")
        placed = shared.join(sums, "part").select("g", (F.col("b0") + F.sum("bytes").over(within)).alias("byte_end"), (F.col("r0") + F.sum("n").over(within) - F.col("n")).alias("row_start"), "bytes")
        placed = ws.write(placed, "placed")
        largest = placed.agg(F.max("bytes")).first()[0] or 0
        cuts = minimax_cuts(placed, left, largest, shards - len(own)) if largest else []

        below = F.lit(len(own))
        for c in cuts[:-1]:
            below = below + (F.col("byte_end") > c).cast("int")
        placed = placed.select("g", below.alias("shard"), "row_start")
        firsts = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("row_start").alias("first")).collect()}
        first = F.lit(0).cast("long")
        for k, v in firsts.items():
            first = F.when(F.col("shard") == k, F.lit(v)).otherwise(first)
        placed = placed.select("g", "shard", (F.col("row_start") - first).alias("base"))
        placed = placed.unionByName(groups.filter(F.col("alone").isNotNull()).select("g", F.col("alone").alias("shard"), F.lit(0).cast("long").alias("base")))

        # Rank within a group: rows in earlier parts, then the rank within the part.
        ahead = F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")
        bases = pieces.select("g", "part", ahead.alias("ahead")).join(placed, "g").select("g", "part", "shard", (F.col("base") + F.col("ahead")).alias("base"))
        rank = F.row_number().over(Window.partitionBy("g", "part").orderBy(F.asc_nulls_first("doc_id"), "pos")) - 1
        out = rows.withColumn("rank", rank).join(bases, ["g", "part"])
        out = out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
        out = ws.write(out, "out")
        ws.drop("unsorted", "rows", "pieces", "groups", "placed")
    return out
