"""Relational steps with total tie-breaks: ranking, percentiles, upserts, carry-forward, paging, masking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.features import rounded


#: Values that more than one row in so many has are joined by broadcast; there can't be more of them.
HOT_VALUES = 10_000


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; ``order`` must be total. Spark prunes groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def percentile(df: DataFrame, col: str, out: str, digits: int = 1) -> DataFrame:
    """Average-tie percent rank times 100; a missing value or NaN ranks as 0.

    Ranks come from counts of distinct values in two steps: sums by range of values, whose bounds are
    sampled so that each holds about as many, and then within a range; no task orders the whole
    table. The ranks are joined back by value: values that very many rows share are broadcast, a
    bounded number of them.
    """
    value = F.coalesce(F.when(~F.isnan(F.col(col).cast("double")), F.col(col).cast("double")), F.lit(0.0))
    df = df.withColumn("__v", value)
    counts = df.groupBy("__v").agg(F.count("*").alias("__n")).repartitionByRange(F.col("__v")).withColumn("__part", F.spark_partition_id())
    parts = counts.groupBy("__part").agg(F.sum("__n").alias("__t"))
    parts = parts.select(F.col("__part").alias("__p"), (F.sum("__t").over(Window.orderBy("__part")) - F.col("__t")).alias("__before"), F.sum("__t").over(Window.partitionBy()).alias("__all"))
    within = F.sum("__n").over(Window.partitionBy("__part").orderBy("__v")) - F.col("__n")
    ranks = counts.join(F.broadcast(parts), F.col("__part") == F.col("__p")).select(F.col("__v").alias("__w"), "__n", "__all", rounded((F.col("__before") + within + (F.col("__n") + 1) / 2.0) / F.col("__all") * 100.0, digits).alias(out))
    often = F.col("__n") * HOT_VALUES > F.col("__all")
    hot = F.broadcast(ranks.filter(often).select("__w", out))
    found = df.join(hot, F.col("__v") == F.col("__w"), "left")
    done = found.filter(F.col("__w").isNotNull()).drop("__w")
    rest = found.filter(F.col("__w").isNull()).drop("__w", out).join(ranks.select("__w", out), F.col("__v") == F.col("__w")).drop("__w")
    return done.unionByName(rest).drop("__v")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``: the state after upserts."""
    return top_n(df, keys, order, 1, "__rank").drop("__rank")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write wins by ``version``; at equal versions the incoming row does."""
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc(version), F.desc("__new")]).drop("__new")


def insert_if_absent(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet; also the resume step of journals and audits."""
    return incoming.join(current.select(key), key, "left_anti")


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(col, ignorenulls=True).over(w))


def look_around(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, before: int, after: int, out: str) -> DataFrame:
    """The values of the rows around each row, in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn(out, F.collect_list(col).over(w))


def search(df: DataFrame, cols: Sequence[str], query: str) -> DataFrame:
    """Rows in which a column holds the literal text, whatever the case."""
    q = query.lower()
    return df.filter(reduce(or_, [F.lower(F.col(c)).contains(q) for c in cols]))


def search_pattern(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Rows in which a column matches a regular expression somewhere, whatever the case; NULL matches nothing."""
    return df.filter(F.coalesce(F.col(col).rlike(f"(?i){pattern}"), F.lit(False)))


def known(df: DataFrame, cols: Sequence[str], sentinels: Sequence[str] = ("unknown", "other")) -> DataFrame:
    """Rows whose columns hold a value that is none of the sentinels, whatever the case."""
    return df.na.drop(subset=list(cols)).filter(reduce(and_, [~F.lower(F.col(c)).isin(*sentinels) for c in cols]))


def vague(df: DataFrame, category: str = "category", review: str = "needs_review") -> DataFrame:
    """Rows without a clear category, or for review."""
    return df.filter((F.col(category) == "others") | F.coalesce(F.col(review), F.lit(False)))


def join_first(left: DataFrame, right: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``left`` with the first row of each key of ``right``."""
    return left.join(latest(right, [key], order), key, "left")


def top_ascending(df: DataFrame, measure: str, n: int, tie: str) -> DataFrame:
    """The n largest rows, shown with the smallest first."""
    return df.orderBy(F.desc(measure), F.asc(tie)).limit(n).orderBy(F.asc(measure), F.desc(tie))


def look_ahead(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, rows: int, stop: Column, out: str) -> DataFrame:
    """The values of up to ``rows`` rows after each row, before the first for which ``stop`` (of a value) holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, rows)
    ends = F.collect_list(F.struct(F.coalesce(stop, F.lit(False)).alias("s"), F.col(col).alias("v"))).over(w)
    first = F.array_position(F.transform("__w", lambda x: x["s"]), True)
    kept = F.when(first > 0, F.slice("__w", F.lit(1), (first - 1).cast("int"))).otherwise(F.col("__w"))
    return df.withColumn("__w", ends).withColumn(out, F.filter(F.transform(kept, lambda x: x["v"]), lambda v: v.isNotNull())).drop("__w")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1; smaller numbers give the first."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def except_value(c: Column, value: object) -> Column:
    """Not equal, where NULL counts as different."""
    return ~c.eqNullSafe(F.lit(value))


def shares(df: DataFrame, level: Sequence[str], item: str, min_support: int = 1) -> DataFrame:
    """Count of each item in its group and its share of the group, for groups of some support."""
    n = df.groupBy(*level, item).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*level)) if level else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return n.withColumn("total", total).filter(F.col("total") >= min_support).withColumn("share", rounded(F.col("n") / F.col("total"), 4))


def masked(df: DataFrame, roles: DataFrame, permission: str, columns: Sequence[str], role: str = "role") -> DataFrame:
    """``columns`` only where the row's role has the permission; ``roles`` has (role, permission)."""
    allowed = roles.filter(F.col("permission") == permission).select(F.col("role").alias("__role")).distinct()
    out = df.join(allowed, F.col(role) == F.col("__role"), "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__role").isNotNull(), F.col(c)))
    return out.drop("__role")
