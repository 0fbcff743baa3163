"""The best name on the right for each name on the left, by difflib's similarity, without making all pairs.

Equal names of a block stand for all their rows. The names of a block are cut into chunks, and two chunks meet
in one row. Within it, difflib only runs for a pair whose bound can still win: matching blocks are a common
subsequence, so twice the longest common subsequence over the sum of the lengths is never less than the ratio;
of the variants that compare common words with all words, the common words are all that can match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.tables import top_n

#: Names of a chunk on the left and on the right.
CHUNK_LEFT, CHUNK_RIGHT = 256, 1024
#: Longest name whose common subsequences are counted in the bits of a word; longer ones are bounded by their length.
BITS = 63

#: Stands for a null id, which comes after all others.
NO_ID = np.iinfo(np.int64).max

Ratio = Callable[[str, str], float]


class Names:
    """The names of a right chunk: letters by place, and where each word occurs."""

    def __init__(self, names: Sequence[str], ids: Sequence[int | None]):
        self.names = list(names)
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.lengths = np.array([len(x) for x in self.names], np.int64)
        self.letters = np.zeros((max(int(self.lengths.max()), 1), len(self.names)), np.uint32)
        for k, x in enumerate(self.names):
            self.letters[: len(x), k] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        words = [set(x.split()) for x in self.names]
        #: of the distinct words, sorted and joined by blanks
        self.joined = np.array([sum(map(len, w)) + max(len(w) - 1, 0) for w in words], np.int64)
        self.distinct = np.array([len(w) for w in words], np.int64)
        at: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            for x in w:
                at.setdefault(x, []).append(k)
        self.at = {x: np.array(v) for x, v in at.items()}

    def common(self, a: str) -> np.ndarray:
        """The length of the longest common subsequence with each name, or a bound of it."""
        if len(a) > BITS:
            return np.minimum(self.lengths, len(a))
        full = np.uint64((1 << len(a)) - 1)
        masks: dict[int, int] = {}
        for i, x in enumerate(a):
            masks[ord(x)] = masks.get(ord(x), 0) | 1 << i
        keys = np.array(sorted(masks), np.uint32)
        bits = np.array([masks[int(k)] for k in keys], np.uint64)
        v = np.full(len(self.names), full)
        for row in self.letters:
            place = np.minimum(np.searchsorted(keys, row), len(keys) - 1)
            u = v & np.where(keys[place] == row, bits[place], np.uint64(0))
            v = ((v + u) | (v - u)) & full
        return len(a) - np.bitwise_count(v).astype(np.int64)

    def bounds(self, a: str) -> np.ndarray:
        """No less than the similarity of ``a`` with each name; 1 only where the words of one are all in the other."""
        words = set(a.split())
        length, shared = np.zeros(len(self.names), np.int64), np.zeros(len(self.names), np.int64)
        for w in words:
            if w in self.at:
                length[self.at[w]] += len(w) + 1
                shared[self.at[w]] += 1
        length = np.maximum(length - 1, 0)
        joined = sum(map(len, words)) + max(len(words) - 1, 0)
        best = 2.0 * self.common(a) / np.maximum(self.lengths + len(a), 1)
        some = shared > 0
        for other in (self.joined, joined):
            best = np.where(some, np.maximum(best, 2.0 * length / np.maximum(length + other, 1)), best)
        total = np.maximum(np.maximum(self.lengths + len(a), self.joined + joined), 1)
        whole = some & (shared == np.minimum(self.distinct, len(words)))
        return np.where(self.lengths == 0, 0.0, np.where(whole, 1.0, np.minimum(best, 1.0 - 1.0 / (2.0 * total))))


def search(a: str, right: Names, ratio: Ratio, weight: float, extra: Sequence[float], digits: int) -> tuple[float, int | None] | None:
    """The largest score of ``a`` and the smallest id that has it; None if no score is over zero."""

    def score(x: np.ndarray | float):
        out = weight * x
        for e in extra:
            out = out + e
        return np.rint(out * 10.0**digits) / 10.0**digits

    most = score(right.bounds(a) if a else np.zeros(len(right.names)))
    best: tuple[float, int] | None = None
    for k in np.lexsort((right.ids, -most)):
        if most[k] <= 0 or best and (most[k] < best[0] or (most[k] == best[0] and right.ids[k] > best[1])):
            break  # what follows has a lower bound, or the same and larger ids
        s = float(score(ratio(a, right.names[k])))
        if s > 0 and (best is None or s > best[0] or (s == best[0] and right.ids[k] < best[1])):
            best = s, int(right.ids[k])
    return best and (best[0], None if best[1] == NO_ID else best[1])


def _chunks(df: DataFrame, keys: Sequence[str], size: int, out: str) -> DataFrame:
    """(keys, out): arrays of about ``size`` structs (name, id) of a key; how they are dealt doesn't matter."""
    n = df.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("__n"))
    dealt = df.join(n, list(keys)).withColumn("__c", F.pmod(F.xxhash64("name"), F.col("__n")))
    return dealt.groupBy(*keys, "__c").agg(F.collect_list(F.struct("name", "id")).alias(out)).drop("__c")


def best_names(left: DataFrame, right: DataFrame, block: Sequence[str], left_keys: Sequence[str], right_keys: Sequence[str], ratio: Ratio, weight: float = 1.0, extra: Sequence[Column] = (), digits: int = 6) -> DataFrame:
    """(id, other, score): the best right id of each left id, of those whose ``block`` columns are equal; ties to the smaller id, scores of zero never.

    Both have id (long) and name, the block columns and those of their ``keys``, all but the ids without nulls. The
    score is the rounded sum of the weighted similarity and of the ``extra`` columns over both keys, in that order.
    """
    of_left = [*block, *left_keys]
    a = _chunks(left.select(*of_left, "name").distinct().withColumn("id", F.lit(0)), of_left, CHUNK_LEFT, "__a")
    b = _chunks(right.groupBy(*block, *right_keys, "name").agg(F.min("id").alias("id")), [*block, *right_keys], CHUNK_RIGHT, "__b")
    met = a.join(b, list(block)).select(F.struct(*of_left).alias("k"), F.col("__a.name").alias("a"), F.col("__b.name").alias("b"), F.col("__b.id").alias("ids"), F.array(F.lit(0.0), *[x.cast("double") for x in extra]).alias("x"))
    # Few bytes are much work, so that the number of tasks is given; chunks of a large block go to many of them.
    met = met.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("k", F.col("a")[0], F.col("b")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, (a, b, ids, x) in enumerate(zip(*(batch.column(i) for i in range(1, 5)), strict=True)):
                names = Names(b.as_py(), ids.as_py())
                some = [(name, *got) for name in a.as_py() if (got := search(name, names, ratio, weight, x.as_py()[1:], digits))]
                rows += [row] * len(some)
                found += some
            name, score, other = (pa.array([f[i] for f in found], t) for i, t in ((0, pa.string()), (1, pa.float64()), (2, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), name, other, score], names=["k", "name", "other", "score"])

    kind = met.select("k").schema.simpleString().removeprefix("struct<k:").removesuffix(">")
    found = met.mapInArrow(run, f"k {kind}, name string, other long, score double").select("k.*", "name", "other", "score")
    found = top_n(found, [*of_left, "name"], [F.desc("score"), F.asc_nulls_last("other")], 1, "__r").drop("__r")
    return left.join(found, [*of_left, "name"]).select("id", "other", "score")
