"""Scorers of listings and of registered companies: value, conversion, priority, tier and campaign in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import features as X
from lodestar.functions import scoring as S
from lodestar.functions.text import blank_to_null
from lodestar.operators.recommend import truthy
from lodestar.operators.tables import except_value, percentile


def _col(df: DataFrame, *names: str) -> Column:
    """The first of the columns that ``df`` has, else NULL."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None).cast("string"))


def _value(df: DataFrame) -> tuple[Column, Column]:
    sector = S.listing_sector(*[F.coalesce(_col(df, c).cast("string"), F.lit("")) for c in ("search_category", "category", "maps_category")])
    own, own_parts = S.firmographic_value(
        _col(df, "category"), _col(df, "capital_tier"), _col(df, "company_size"), _col(df, "connectivity_need"),
        truthy(_col(df, "multisite_signal")), F.upper(_col(df, "business_model")) == "B2B", truthy(_col(df, "international_signal")),
    )
    site = F.when(truthy(_col(df, "has_website")), "yes").otherwise(_col(df, "website"))
    listed, listed_parts = S.listing_value(sector, _col(df, "rating", "maps_rating"), _col(df, "reviews", "maps_reviews_count"), site)
    tier, size = _col(df, "capital_tier"), _col(df, "company_size")
    return S.value_potential(tier, size, own, listed), S.value_potential(tier, size, F.to_json(own_parts), F.to_json(listed_parts))


def _readiness(df: DataFrame) -> tuple[Column, Column]:
    phone = F.when(truthy(_col(df, "callable_prospect")), "yes").otherwise(F.coalesce(blank_to_null(_col(df, "phone")), blank_to_null(_col(df, "maps_phone"))))
    reach = S.reachability(phone, F.coalesce(blank_to_null(_col(df, "website")), blank_to_null(_col(df, "maps_website"))), F.coalesce(blank_to_null(_col(df, "email")), blank_to_null(_col(df, "maps_email"))))
    active = S.prominence(_col(df, "rating", "maps_rating"), _col(df, "reviews", "maps_reviews_count"))
    return S.readiness(reach, _col(df, "digital_signal"), truthy(_col(df, "is_new_company")), active, _col(df, "confidence"))


def _finished(df: DataFrame, value: Column, parts: Column, conversion: Column, why: Column) -> DataFrame:
    df = df.withColumns({"value_score": value, "value_breakdown": parts, "conversion_score": conversion, "conversion_breakdown": why})
    df = df.withColumns({"priority_score": S.priority(F.col("value_score"), F.col("conversion_score")), "tier": S.tier(F.col("value_score"), F.col("conversion_score"))})
    geo = blank_to_null(_col(df, "address")).isNotNull() | blank_to_null(_col(df, "governorate")).isNotNull()
    plan = S.campaign(F.col("tier"), geo, blank_to_null(_col(df, "phone")).isNotNull() | truthy(_col(df, "callable_prospect")), blank_to_null(_col(df, "email")).isNotNull())
    return df.withColumns(plan).orderBy(F.desc("priority_score"))


def score_listings(df: DataFrame, probability: str = "prob_client") -> DataFrame:
    """Listings that are no customers yet, with source, sector and scores; the conversion score is the percentile of ``probability``."""
    if "is_known_customer" in df.columns:
        df = df.filter(except_value(F.col("is_known_customer"), 1))
    df = percentile(df, probability, "__p")
    value, parts = _value(df)
    why = F.to_json(F.struct(F.col("__p").alias("pu_propensity_percentile"), X.rounded(X.number_or_zero(F.col(probability)), 4).alias("modeled_probability")))
    sector = S.listing_sector(*[F.coalesce(_col(df, c).cast("string"), F.lit("")) for c in ("search_category", "category", "maps_category")])
    return _finished(df, value, parts, F.col("__p"), why).drop("__p").withColumns({"source": F.lit("maps"), "sector": sector})


def score_registry(df: DataFrame) -> DataFrame:
    """Registered companies with source, sector and scores; the conversion score is their readiness."""
    value, parts = _value(df)
    conversion, why = _readiness(df)
    return _finished(df, value, parts, conversion, F.to_json(why)).withColumns({"source": F.lit("rne"), "sector": F.col("category")})


def tier_counts(scored: DataFrame) -> DataFrame:
    """One row with the number of prospects of each tier, zero where there are none."""
    return scored.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in ("A", "B", "C", "D")])
