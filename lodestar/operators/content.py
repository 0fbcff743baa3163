"""Content layer: text profiles of companies and offers, their similarity, and what they have in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import values as V
from lodestar.functions.features import rounded
from lodestar.functions.text import ARABIC, normalize
from lodestar.operators.recommend import truthy
from lodestar.operators.tables import top_n

#: A text encoder: texts to rows of a matrix. It is made once in each Python worker.
Encoder = Callable[[list[str]], np.ndarray]


def clean(df: DataFrame, name: str) -> Column:
    """The trimmed text of a column; empty if it is missing or the column is absent."""
    if name not in df.columns:
        return F.lit("")
    c = F.trim(F.col(name).cast("string"))
    return F.when(c.isNull() | F.lower(c).isin("nan", "none", "null"), "").otherwise(c)


def _flag(df: DataFrame, name: str) -> Column:
    return truthy(F.col(name)) if name in df.columns else F.lit(False)


def _named(c: Column, names: Mapping[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), default)


def _sentence(label: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(label), c))


def company_profile(df: DataFrame) -> Column:
    """What a company is, as a text; columns that ``df`` lacks say nothing."""
    activity, sector, size, maturity, model, city = (clean(df, c) for c in ("fr_activite_principale", "category", "company_size", "maturity", "business_model", "city"))
    raw = F.trim(F.regexp_replace(F.regexp_replace(clean(df, "activity_raw_combined"), f"[{ARABIC}]+", ""), r"\s*\|\s*", " "))
    activity = F.substring(F.when(activity != "", activity).otherwise(raw), 1, 400)
    parts = [
        _sentence("Activite: ", activity),
        _sentence("Secteur: ", _named(F.lower(sector), V.SECTOR_TEXTS, F.lower(sector))),
        _sentence("Taille: ", _named(size, V.SIZE_TEXTS, F.lit(""))),
        _sentence("", _named(F.lower(maturity), V.MATURITY_TEXTS, F.lit(""))),
        _sentence("", _named(model, V.MODEL_TEXTS, F.lit(""))),
        *[F.when(_flag(df, c), text) for c, text in V.SIGNAL_TEXTS.items()],
        F.when((city != "") & ~F.lower(city).isin("unknown", "other"), F.concat(F.lit("Situee a "), city)),
    ]
    joined = F.concat_ws(". ", *parts)
    return F.when(joined == "", V.NO_PROFILE).otherwise(F.concat(joined, F.lit(".")))


def offer_profile(df: DataFrame) -> Column:
    """What an offer does, as a text."""
    name, family, description = (clean(df, c) for c in ("offer_name", "family", "description"))
    codes = F.filter(F.transform(F.split(clean(df, "strong_sectors"), ","), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    sectors = F.array_join(F.transform(codes, lambda s: _named(s, V.SECTOR_TEXTS, s)), "; ")
    tags = F.concat_ws(" ; ", *[F.when(_flag(df, c), text) for c, text in V.OFFER_TAGS.items()])
    parts = [F.concat(F.lit("Offre: "), name), F.concat(F.lit("Categorie: "), _named(family, V.FAMILY_TEXTS, family)), F.when(description != "", description), _sentence("Cible: ", sectors), _sentence("Adapte a: ", tags)]
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def terms(profile: Column) -> Column:
    """The distinct words of four letters or more that mean something."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(normalize(profile), F.lit("[a-z]{4,}"), F.lit(0))), F.array(*map(F.lit, V.PROFILE_STOP_WORDS)))


def why_matched(a: Column, b: Column, top: int = 3) -> Column:
    """The longest common terms of two profiles (of equal length the first by alphabet)."""
    common = F.transform(F.array_intersect(terms(a), terms(b)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.when(F.size(common) == 0, "semantic match").otherwise(F.array_join(F.slice(F.array_sort(common), 1, top)["w"], ", "))


def lexical(a: Column, b: Column) -> Column:
    """The cosine of two sets of terms; on the JVM, for where no encoder is at hand."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.sqrt(F.size(a).cast("double") * F.size(b)), F.lit(0.0)), F.lit(0.0))


def encode(profile: Column, make: Callable[[], Encoder]) -> Column:
    """Unit vectors of texts by an encoder that ``make`` opens once in each worker."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for texts in parts:
            v = np.asarray(encoder(texts.fillna("").tolist()), np.float64)
            yield pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    return F.pandas_udf(run, "array<double>")(profile)


def content_scores(companies: DataFrame, catalog: DataFrame, company: str = "identifiant_unique", top: int = V.CONTENT_TOP, floor: float = V.CONTENT_FLOOR, make: Callable[[], Encoder] | None = None) -> DataFrame:
    """(company, offer_id, content_score, rank, why_matched): the offers most similar to each company, above ``floor``.

    The catalog is a stated, small set that every company is held against. ``make`` opens an encoder of
    texts; without one the terms of the profiles are compared. The unrounded similarity is ranked, then
    shown with four digits; ties go to the earlier offer by id.
    """
    c = companies.select(F.col(company).alias("company"), company_profile(companies).alias("p"))
    o = catalog.select("offer_id", offer_profile(catalog).alias("q"))
    if make is None:
        c, o, score = c.withColumn("v", terms(F.col("p"))), o.withColumn("w", terms(F.col("q"))), lexical(F.col("v"), F.col("w"))
    else:
        c, o, score = c.withColumn("v", encode(F.col("p"), make)), o.withColumn("w", encode(F.col("q"), make)), F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    offers = o.agg(F.collect_list(F.struct("offer_id", "q", "w")).alias("offers"))
    pairs = c.join(F.broadcast(offers)).select("company", "p", "v", F.inline("offers")).withColumn("s", score).filter(F.col("s") >= floor)
    best = top_n(pairs.select("company", "offer_id", "s", "p", "q"), ["company"], [F.desc("s"), F.asc("offer_id")], top)
    return best.select(F.col("company").alias(company), "offer_id", rounded(F.col("s"), 4).alias("content_score"), "rank", why_matched(F.col("p"), F.col("q")).alias("why_matched"))
