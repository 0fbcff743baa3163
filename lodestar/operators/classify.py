"""Sector classification: taxonomy keywords, exact and partial examples, and the first-confident cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.features import rounded
from lodestar.functions.text import matched
from lodestar.functions.values import RISKY_METHODS

#: (sector, include keywords, exclude keywords), by priority
Taxonomy = Sequence[tuple[str, Sequence[str], Sequence[str]]]


def load_taxonomy(path: str) -> list[tuple[str, list[str], list[str]]]:
    """Sectors in order of priority from a YAML file with ``sectors: {name: {priority, include, exclude}}``; raises if a key is missing."""
    import yaml

    with open(path, encoding="utf-8") as f:
        sectors = yaml.safe_load(f)["sectors"]
    for name, s in sectors.items():
        for key in ("include", "exclude"):
            if not isinstance(s.get(key), list):
                raise ValueError(f"sector {name}: {key} must be a list")
    return [(n, s["include"], s["exclude"]) for n, s in sorted(sectors.items(), key=lambda x: x[1].get("priority", 0))]


def taxonomy(c: Column, sectors: Taxonomy) -> Column:
    """struct(category, confidence, method, matched, needs_review) of a cleaned text."""

    def out(category: str, confidence: Column, method: str, words: Column, review: bool) -> Column:
        return F.struct(F.lit(category).alias("category"), confidence.alias("confidence"), F.lit(method).alias("method"), words.alias("matched"), F.lit(review).alias("needs_review"))

    none = F.array().cast("array<string>")
    hits = [(s, matched(c, inc) if inc else none, matched(c, exc) if exc else none) for s, inc, exc in sectors]
    result = out("others", F.lit(0.5), "no_rule_match", none, True)
    for s, inc, exc in reversed(hits):
        result = F.when((F.size(inc) > 0) & (F.size(exc) > 0), out(s, F.lit(0.6), "taxonomy_conflict", inc, True)).otherwise(result)
    for s, inc, exc in reversed(hits):
        sure = rounded(F.least(0.90 + 0.02 * F.size(inc), F.lit(0.98)), 3)
        result = F.when((F.size(inc) > 0) & (F.size(exc) == 0), out(s, sure, "taxonomy_rule", inc, False)).otherwise(result)
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", out("others", F.lit(0.0), "empty_activity", none, True)).otherwise(result)


def exact_examples(df: DataFrame, key: str, examples: DataFrame) -> DataFrame:
    """``df`` with example_category of an equal key; ``examples`` (key, category, ord), the last of a key wins."""
    last = examples.groupBy("key").agg(F.max_by("category", "ord").alias("example_category"))
    return df.join(last, F.col(key) == F.col("key"), "left").drop("key")


def partial_example(c: Column, examples: Sequence[tuple[str, str]], least: int = 5) -> Column:
    """Category of the first example of ``least`` letters that occurs as whole words."""
    import re

    out = F.lit(None).cast("string")
    for key, category in reversed([e for e in examples if len(e[0]) >= least]):
        out = F.when(c.rlike(r"(?U)\b" + re.escape(key) + r"\b"), category).otherwise(out)
    return out


def cascade(layers: Sequence[tuple[Column, Column]], fallback: Sequence[Column]) -> Column:
    """The first (accepted, result) whose condition holds, else the first non-null of ``fallback``."""
    out = F.coalesce(*fallback)
    for ok, result in reversed(layers):
        out = F.when(F.coalesce(ok, F.lit(False)), result).otherwise(out)
    return out


def is_risky(category: Column, confidence: Column, method: Column, review: Column) -> Column:
    """Rows that an audit should see."""
    low = F.coalesce(confidence.cast("string").try_cast("double"), F.lit(0.0)) < 0.80
    return (method != "empty_activity") & ((category == "others") | low | F.coalesce(review, F.lit(False)) | method.isin(*RISKY_METHODS))
