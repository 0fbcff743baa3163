"""Lines and cells of mixed texts, label-value fields, and page carry-forward."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.tables import carry_forward, top_n


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, raw_line)"""
    parts = df.select(key, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("p", "raw_line"))
    return parts.select(key, (F.col("p") + 1).cast("long").alias("line_no"), "raw_line")


def cells(df: DataFrame, key: str) -> DataFrame:
    """Pages and non-empty cells of each line; noise lines (blank, rules, table markers, page markers) go.

    A ``PAGE n`` line sets the page of the lines after it.
    """
    page = F.regexp_extract("raw_line", r"^\s*PAGE\s+(\d+)", 1)
    df = df.withColumn("__page", F.when(page != "", page.cast("int")))
    df = carry_forward(df, [key], ["line_no"], "__page", "page")
    noise = F.trim("raw_line").rlike(r"^(|=+|--- TABLE.*|PAGE\s+\d+.*)$")
    split = F.filter(F.transform(F.split("raw_line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return df.filter(~noise).select(key, "page", "line_no", "raw_line", split.alias("cells"))


def word_lines(words: DataFrame, keys: Sequence[str], tolerance: float = 4.0) -> DataFrame:
    """(keys, line_no from 1, raw_line) from word boxes (x, y, word): blank words go, and a word within ``tolerance``
    of the mean height of the line before it joins that line. A page (one value of ``keys``) bounds what a task holds.
    """
    boxes = words.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.trim("word").alias("word")).filter("word <> '' AND x IS NOT NULL AND y IS NOT NULL")
    pages = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.round("y", 1).alias("r"), "x", "y", "word"))).alias("b"))
    start = F.expr("struct(0L AS n, 0D AS y, 0L AS size, cast(array() AS array<struct<n: bigint, x: double, word: string>>) AS out)")

    def step(a: Column, b: Column) -> Column:
        same = (a["size"] > 0) & (F.abs(b["y"] - a["y"] / a["size"]) <= tolerance)
        n = F.when(same, a["n"]).otherwise(a["n"] + 1)
        size, total = (F.when(same, a[f] + v).otherwise(v) for f, v in (("size", F.lit(1).cast("long")), ("y", b["y"])))
        return F.struct(n.alias("n"), total.alias("y"), size.alias("size"), F.concat(a["out"], F.array(F.struct(n.alias("n"), b["x"].alias("x"), b["word"].alias("word")))).alias("out"))

    placed = pages.select(*keys, F.explode(F.aggregate("b", start, step)["out"]).alias("w")).select(*keys, "w.*")
    rows = placed.groupBy(*keys, F.col("n").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("x", "word"))).alias("l"))
    return rows.select(*keys, "line_no", F.array_join("l.word", " ").alias("raw_line"))


def fields(df: DataFrame, key: str, labels: Mapping[str, str]) -> DataFrame:
    """(key, field, value, line_no): for each field the first line whose cell equals its label; the value is the cells after it."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(label.lower()).alias("label")) for f, label in labels.items()])
    hits = df.select(key, "line_no", "cells", F.explode(pairs).alias("f")).select(key, "line_no", "f.field", "cells", F.array_position(F.transform("cells", lambda c: F.lower(c)), F.col("f.label")).alias("at"))
    hits = hits.filter("at > 0").withColumn("value", F.array_join(F.slice("cells", F.col("at").cast("int") + 1, F.size("cells")), " "))
    return top_n(hits, [key, "field"], [F.asc("line_no")], 1, "__r").select(key, "field", "value", "line_no")


def audit(found: DataFrame, keys: DataFrame, key: str, labels: Mapping[str, str]) -> DataFrame:
    """(key, field, issue) for fields without a value."""
    wanted = keys.select(key, F.explode(F.array(*map(F.lit, labels))).alias("field"))
    return wanted.join(found.filter("value <> ''"), [key, "field"], "left_anti").withColumn("issue", F.lit("missing_value"))
