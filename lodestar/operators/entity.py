"""Entity resolution between a register and listings: blocking, scoring, decision and the master table."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import values as V
from lodestar.functions.features import rounded
from lodestar.operators.best_names import best_names
from lodestar.operators.tables import top_n


def _ratio(a: str, b: str) -> float:
    """The best of the texts as they are and of the common words against each text's words, all sorted."""
    if not (a and b):
        return 0.0
    x, y = set(a.split()), set(b.split())
    pairs = [(a, b)]
    if x & y:
        pairs += [(" ".join(sorted(x & y)), " ".join(sorted(s))) for s in (x, y)]
    return max(SequenceMatcher(None, *p).ratio() for p in pairs)


def token_similarity(a: Column, b: Column) -> Column:
    """Order-independent similarity of two normalised names, for pairs that passed the block."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length, on the JVM."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")


def overlap(a: Column, b: Column) -> Column:
    """One text is in the other; blanks overlap with nothing."""
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def locality(*pairs: tuple[Column, Column]) -> Column:
    """Half a point for each pair of place names of which one holds the other, whatever the case."""
    return F.least(sum((F.when(overlap(F.lower(x), F.lower(y)), 0.5).otherwise(0.0) for x, y in pairs), F.lit(0.0)), F.lit(1.0))


def pair_score(name: Column, local: Column, phone_a: Column, phone_b: Column) -> Column:
    """The weighted score of a pair: names, places, and equal known phone numbers."""
    w = V.MATCH_WEIGHTS
    phone = F.when((phone_a != "") & (phone_a == phone_b), 1.0).otherwise(0.0)
    return w[0] * name + w[1] * local + w[2] * phone


def best_matches(left: DataFrame, right: DataFrame, score: Column, left_id: str, right_id: str, block: str = "block") -> DataFrame:
    """(left_id, right_id, score): the best right row of each left row in its block; ties to the smaller right id, scores of zero never."""
    pairs = left.filter(F.col(block) != "").join(right.filter(F.col(block) != ""), block).select(left_id, right_id, score.alias("score"))
    return top_n(pairs.filter("score > 0"), [left_id], [F.desc("score"), F.asc(right_id)], 1, "__r").drop("__r")


def best_by_name(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: str, right_name: str, digits: int = 6, block: str = "block") -> DataFrame:
    """As :func:`best_matches` for the rounded token similarity, without making all pairs of a block."""
    sides = (df.filter(F.col(block) != "").select(F.col(i).cast("long").alias("id"), F.coalesce(F.col(n), F.lit("")).alias("name"), F.col(block).alias("block")) for df, i, n in ((left, left_id, left_name), (right, right_id, right_name)))
    return _best_ids(best_names(*sides, ["block"], [], [], _ratio, digits=digits), left_id, right_id)


def best_by_profile(left: DataFrame, right: DataFrame, left_id: str, right_id: str, digits: int = 3) -> DataFrame:
    """As :func:`best_matches` for the rounded :func:`pair_score` of name, place and phone, without making all pairs of a block.

    Both sides have an id, block, name, place and phone. A pair with equal phones scores more than it would
    without, so that it does no harm to see it as one without as well.
    """
    w = V.MATCH_WEIGHTS
    a, b = (df.filter("block <> ''").select(F.col(i).cast("long").alias("id"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (("name", "name"), ("block", "block"), ("phone", "phone"), ("place", p))]) for df, i, p in ((left, left_id, "left_place"), (right, right_id, "right_place")))
    local = w[1] * locality((F.col("left_place"), F.col("right_place")))
    found = [best_names(x, y, block, ["left_place"], ["right_place"], _ratio, w[0], [local, F.lit(w[2] * phone)], digits) for x, y, block, phone in ((a, b, ["block"], 0.0), (a.filter("phone <> ''"), b.filter("phone <> ''"), ["block", "phone"], 1.0))]
    return _best_ids(found[0].unionByName(found[1]), left_id, right_id)


def _best_ids(found: DataFrame, left_id: str, right_id: str) -> DataFrame:
    one = top_n(found, ["id"], [F.desc("score"), F.asc_nulls_last("other")], 1, "__r")
    return one.select(F.col("id").alias(left_id), F.col("other").alias(right_id), "score")


def decide(score: Column) -> Column:
    return F.when(score >= V.ACCEPT, "match").when(score >= V.REVIEW, "review").otherwise("unmatched")


def master(register: DataFrame, listings: DataFrame, best: DataFrame, register_id: str, listing_id: str, review: str = "drop") -> DataFrame:
    """Matched rows, register rows without a match and listings without one, with match_source and match_confidence.

    ``review``: what becomes of listings in the review band, ``drop`` or ``keep`` as unmatched.
    """
    kind = best.withColumn("decision", decide(F.col("score")))
    hit = kind.filter("decision = 'match'").select(listing_id, register_id, rounded(F.col("score"), 3).alias("match_confidence"))
    matched = register.join(hit, register_id).join(listings, listing_id).withColumn("match_source", F.lit("both"))
    left = register.join(hit.select(register_id).distinct(), register_id, "left_anti").withColumn("match_source", F.lit("register_only"))
    gone = kind.filter("decision = 'match'" if review == "keep" else "decision <> 'unmatched'").select(listing_id)
    right = listings.join(gone, listing_id, "left_anti").withColumn("match_source", F.lit("listing_only"))
    return matched.unionByName(left, allowMissingColumns=True).unionByName(right, allowMissingColumns=True)
