"""Value, readiness, priority, tier and campaign of a prospect."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import values as V
from lodestar.functions.features import number, number_or_zero, rounded
from lodestar.functions.text import blank_to_null


def factor(c: Column, table: Mapping[str, float], default: float) -> Column:
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(c))), F.lit(default))


def weighted(terms: Mapping[str, Column], weights: Mapping[str, float]) -> tuple[Column, Column]:
    """(score out of 100, struct of its terms): each term is rounded to two digits before the sum."""
    parts = {k: rounded(F.lit(100.0 * weights[k]) * c, 2) for k, c in terms.items()}
    total = sum(parts.values(), F.lit(0.0))
    return rounded(F.least(total, F.lit(100.0)), 2), F.struct(*[c.alias(k) for k, c in parts.items()])


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def firmographic_value(sector: Column, tier: Column, size: Column, need: Column, multisite: Column, b2b: Column, international: Column) -> tuple[Column, Column]:
    terms = {"sector_propensity": factor(sector, V.SECTOR_PROPENSITY, 0.5), "capital_tier": factor(tier, V.TIER_FACTOR, 0.3), "company_size": factor(size, V.SIZE_FACTOR, 0.35), "connectivity_need": factor(need, V.NEED_FACTOR, 0.4), "multisite": flag(multisite), "b2b": flag(b2b), "international": flag(international)}
    return weighted(terms, V.VALUE_WEIGHTS)


def prominence(rating: Column, reviews: Column) -> Column:
    """Half rating, half log-saturated volume; 0.30 if neither is known."""
    r = F.least(F.coalesce(number(rating), F.lit(0.0)) / 5.0, F.lit(1.0))
    v = F.least(F.log1p(F.greatest(F.coalesce(number(reviews), F.lit(0.0)), F.lit(0.0))) / F.log1p(F.lit(50.0)), F.lit(1.0))
    return F.when(rating.isNull() & reviews.isNull(), F.lit(0.30)).otherwise(0.5 * r + 0.5 * v)


def listing_value(sector: Column, rating: Column, reviews: Column, website: Column) -> tuple[Column, Column]:
    digital = F.when(blank_to_null(website).isNotNull(), 1.0).otherwise(0.3)
    return weighted({"sector_propensity": factor(sector, V.SECTOR_PROPENSITY, 0.5), "prominence": prominence(rating, reviews), "digital": digital}, V.LISTING_WEIGHTS)


def listing_sector(*texts: Column) -> Column:
    """The first sector of which a keyword is in the texts, together in lower case; else others."""
    text = F.lower(F.concat_ws(" ", *texts))
    out = F.lit("others")
    for sector, keywords in reversed(V.LISTING_SECTORS):
        out = F.when(reduce(or_, [text.contains(k) for k in keywords]), sector).otherwise(out)
    return out


def value_potential(tier: Column, size: Column, firmographic: Column, listing: Column) -> Column:
    """The firmographic value if the tier or the size is given ("unknown" counts as given), else that of the listing."""
    return F.when(blank_to_null(tier).isNotNull() | blank_to_null(size).isNotNull(), firmographic).otherwise(listing)


def reachability(phone: Column, website: Column, email: Column) -> Column:
    return F.least(sum((F.when(blank_to_null(c).isNotNull(), F.lit(V.REACH[k])).otherwise(0.0) for k, c in (("phone", phone), ("website", website), ("email", email))), F.lit(0.0)), F.lit(1.0))


def readiness(reach: Column, digital: Column, recent: Column, active: Column, confidence: Column) -> tuple[Column, Column]:
    """A confidence of zero counts as one half; beyond [0, 1] it is cut."""
    given = number_or_zero(confidence)
    sure = F.least(F.greatest(F.when(given == 0, 0.5).otherwise(given), F.lit(0.0)), F.lit(1.0))
    terms = {"reachability": reach, "digital": factor(digital, V.DIGITAL_FACTOR, 0.3), "recency": F.when(recent, 1.0).otherwise(0.35), "maps_activity": active, "confidence": sure}
    return weighted(terms, V.READINESS_WEIGHTS)


def priority(value: Column, conversion: Column) -> Column:
    return rounded(0.5 * value + 0.5 * conversion, 2)


def tier(value: Column, propensity: Column) -> Column:
    v, p = value >= V.VALUE_CUT, propensity >= V.PROPENSITY_CUT
    return F.when(v & p, "A").when(v, "B").when(p, "C").otherwise("D")


def _by_tier(t: Column, table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[t]


def campaign(t: Column, geo: Column, phone: Column, mail: Column) -> dict[str, Column]:
    """Channel, band, budget, cadence and label: the first channel of the tier that is available."""
    open_ = {"field_sales": geo, "tele_sales": phone, "sms": phone, "email": mail, "social": F.lit(True), "none": F.lit(True)}
    channel = F.lit("none")
    for k, names in V.CHANNELS.items():
        first = F.lit("none")
        for name in reversed(names):
            first = F.when(F.coalesce(open_[name], F.lit(False)), name).otherwise(first)
        channel = F.when(t == k, first).otherwise(channel)
    band = F.when((_by_tier(t, V.BANDS) == "High") & channel.isin("none", "social"), "Medium").otherwise(_by_tier(t, V.BANDS))
    return {"campaign_channel": channel, "budget_band": band, "budget_tnd": _by_tier(band, V.BAND_TND), "cadence": _by_tier(t, V.CADENCE), "tier_label": _by_tier(t, V.TIER_LABELS)}
