"""Sources and sinks: CSV with header resolution, documents, Parquet stages, journals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import content_key, is_pdf
from lodestar.functions.values import LISTING_HEADERS
from lodestar.operators.tables import insert_if_absent


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """UTF-8 CSV with a header and quoted line breaks; every column a string unless a schema is given. The BOM goes."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def read_first(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV, else an Excel sheet if a reader for it is installed, else an empty table of the schema where there is no such file.

    A file that is there but can't be read is an error.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    if not path.lower().endswith((".xls", ".xlsx")):
        return read_csv(spark, path)
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path).astype(str))


def prefer(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table written at ``path``, else what ``compute`` gives."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.parquet(path)
    return compute()


def header_key(h: str) -> str:
    """A header without case, accents, spaces and punctuation."""
    return re.sub(r"[^a-z0-9]", "", unicodedata.normalize("NFKD", h).encode("ascii", "ignore").decode().lower())


def resolve_headers(columns: Sequence[str], candidates: Mapping[str, Sequence[str]] = LISTING_HEADERS, strict: bool = False) -> dict[str, str]:
    """column -> canonical name, by the first candidate found; a column claimed twice goes to the later canonical."""
    have, out, missing = {header_key(c): c for c in columns}, {}, []
    for canonical, names in candidates.items():
        found = next((have[header_key(n)] for n in [canonical, *names] if header_key(n) in have), None)
        if found is None:
            missing.append(canonical)
        else:
            out[found] = canonical
    if strict and missing:
        raise ValueError(f"no column for {missing}")
    return out


def resolve_report(columns: Sequence[str], candidates: Mapping[str, Sequence[str]]) -> list[tuple[str, str | None, str]]:
    """(field, its first candidate among the columns, ok or MISSING) for every field."""
    have = {header_key(c): c for c in columns}
    found = {field: next((have[header_key(n)] for n in names if header_key(n) in have), None) for field, names in candidates.items()}
    return [(field, column, "ok" if column else "MISSING") for field, column in found.items()]


def resolved(df: DataFrame, candidates: Mapping[str, Sequence[str]], fallbacks: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A column for each field, NULL where none is found; empty values are filled from the field's fallback columns."""
    out = []
    for field, column, _ in resolve_report(df.columns, candidates):
        names = [column, *(c for f, c, _ in resolve_report(df.columns, fallbacks or {}) if f == field)]
        values = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names if c]
        out.append((F.coalesce(*values) if values else F.lit(None).cast("string")).alias(field))
    return df.select(*out)


def with_missing(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``df`` with a typed NULL for each column that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def canonical(df: DataFrame, candidates: Mapping[str, Sequence[str]] = LISTING_HEADERS, strict: bool = False) -> DataFrame:
    return df.withColumnsRenamed(resolve_headers(df.columns, candidates, strict))


def read_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Valid PDF files below a folder: path, length, content, sha256, object_key."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.filter(is_pdf(F.col("content"))).withColumn("sha256", F.sha2("content", 256)).withColumn("object_key", content_key(F.col("content")))


def write_stage(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append the rows whose key the Parquet table lacks, after ``change``; the table is created if absent."""
    try:
        df = insert_if_absent(spark.read.parquet(path), df, key)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    change(df).write.mode("append").parquet(path)


def journal(outcomes: DataFrame, done: str, failed: str) -> None:
    """Append the paths that went well to one table and the others with their errors to another, each once per call."""
    outcomes.filter("error IS NULL").select("path").write.mode("append").parquet(done)
    outcomes.filter("error IS NOT NULL").select("path", "error", F.current_timestamp().alias("at")).write.mode("append").parquet(failed)


def append_audit(df: DataFrame, path: str, actor: str) -> None:
    """Rows of an audit log, stamped and never changed: actor, action, target, at."""
    df.select(F.lit(actor).alias("actor"), "action", "target", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def split_outputs(segmented: DataFrame) -> dict[str, DataFrame]:
    """Views of a classified table: all, empty activities, review queue, audit columns."""
    empty = F.col("method") == "empty_activity"
    audit = [c for c in ("activity_clean", "category", "confidence", "method", "matched_keywords", "blocked_keywords", "needs_review") if c in segmented.columns]
    return {"full": segmented, "empty": segmented.filter(empty), "review": segmented.filter(F.col("needs_review") & ~empty), "audit": segmented.select(*audit)}
