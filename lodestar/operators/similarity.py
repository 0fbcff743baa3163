"""Nearest neighbours by cosine of unit vectors, votes over them, and acceptance levels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import values as V
from lodestar.functions.features import rounded
from lodestar.operators.tables import top_n

#: Reference vectors of a block, which goes to every task; larger sets take several passes.
BLOCK_ROWS = 50_000
RANK_DIGITS = 12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, references: DataFrame, k: int, floor: float | None = None, digits: int = 6, ties_last: bool = False) -> DataFrame:
    """(query, ref, sim, rank): the k most similar references of each query.

    ``queries`` and ``references`` have (id long, v array). The references are a stated set that is
    taken in blocks of BLOCK_ROWS; each block meets all queries once and leaves k rows a query.
    Ranks go by the similarity to RANK_DIGITS digits, as far as sums in another order agree; ties go to
    the smaller id, or with ``ties_last`` to the larger. ``sim`` is rounded to ``digits``.
    """
    n = max(1, -(-references.count() // BLOCK_ROWS))
    found = []
    for part in range(n):
        rows = references.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == part).select("id", "v").orderBy("id").collect()
        if rows:
            found.append(_block(queries, np.array([r.id for r in rows]), np.array([r.v for r in rows], np.float64), k, floor, ties_last))
    if not found:
        return queries.select(F.col("id").alias("query"), F.lit(None).cast("long").alias("ref"), F.lit(None).cast("double").alias("sim")).limit(0).withColumn("rank", F.lit(0))
    tie = F.desc("ref") if ties_last else F.asc("ref")
    return top_n(reduce(DataFrame.unionByName, found), ["query"], [F.desc("sim"), tie], k).withColumn("sim", rounded(F.col("sim"), digits))


def _block(queries: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, floor: float | None, ties_last: bool) -> DataFrame:
    def best(sim: np.ndarray) -> np.ndarray:
        """Places of the first k of a row; only what reaches the k-th value is sorted."""
        some = np.flatnonzero(sim >= np.partition(sim, len(sim) - k)[len(sim) - k]) if k < len(sim) else np.arange(len(sim))
        return some[np.lexsort((-ids[some] if ties_last else ids[some], -sim[some]))][:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.slice(at, 64)
                x = np.array(some.column(1).to_pylist(), np.float64).reshape(some.num_rows, -1)
                sims = np.round(x @ vectors.T, RANK_DIGITS)
                q, ref, out = [], [], []
                for key, sim in zip(some.column(0).to_pylist(), sims, strict=True):
                    places = best(sim)
                    places = places if floor is None else places[sim[places] >= floor]
                    q += [key] * len(places)
                    ref.append(ids[places])
                    out.append(sim[places])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(ref), pa.int64()), pa.array(np.concatenate(out))], names=["query", "ref", "sim"])

    return queries.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "query long, ref long, sim double")


def embedding_method(sim: Column) -> Column:
    s = rounded(sim, 3)
    return F.when(s >= V.EMBED_ACCEPT, "embedding_similarity").when(s >= V.EMBED_REVIEW, "embedding_similarity_low_confidence")


def weighted_vote(neighbours: DataFrame, label: str, least: float) -> DataFrame:
    """(query, label, votes, top_sim): the label with the largest sum of similarities, the nearer first at ties."""
    kept = neighbours.filter(F.col("sim") >= least)
    votes = kept.groupBy("query", label).agg(rounded(F.sum("sim"), 6).alias("votes"), F.min("rank").alias("first"))
    top = kept.groupBy("query").agg(F.max("sim").alias("top_sim"))
    return top_n(votes, ["query"], [F.desc("votes"), F.asc("first")], 1, "__r").drop("__r", "first").join(top, "query")


def vote_summary(neighbours: DataFrame, label: str, source: str) -> DataFrame:
    """(query, context, votes): the first three neighbours, and the labels with their sums of similarities, the largest first."""
    three = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", label, "sim", source))), 1, 3), lambda x: F.concat_ws(":", x[label], x["sim"].cast("string"), x[source]))
    context = neighbours.groupBy("query").agg(F.array_join(three, " | ").alias("context"))
    sums = neighbours.groupBy("query", label).agg(rounded(F.sum("sim"), 3).alias("s"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), F.col(label).cast("string").alias("l"), F.col("s")))), lambda x: F.concat(x["l"], F.lit("="), x["s"].cast("string")))
    return context.join(sums.groupBy("query").agg(F.array_join(shown, ", ").alias("votes")), "query")


def rag_result(top_sim: Column) -> Column:
    """struct(method, needs_review) of a vote by its most similar neighbour; below the lower threshold the method is NULL."""
    method = F.when(top_sim >= V.RAG_HIGH, "rag_similarity").when(top_sim >= V.RAG_MEDIUM, "rag_similarity_low_confidence")
    return F.struct(method.alias("method"), (top_sim < V.RAG_HIGH).alias("needs_review"))


def low_similarity(best: DataFrame, least: float = V.EMBED_REVIEW) -> DataFrame:
    """Rows whose nearest neighbour is too far for a result, for a side output."""
    return best.filter(F.col("sim") < least)
