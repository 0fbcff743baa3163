"""Firmographic features as Column expressions. NULL never matches; the first rule that holds wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import values as V


def number(c: Column) -> Column:
    """A double, NULL if the text is none or NaN."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def number_or_zero(c: Column) -> Column:
    """A double, 0 if the text is none, NULL or NaN."""
    return F.coalesce(number(c), F.lit(0.0))


def rounded(c: Column, digits: int = 0) -> Column:
    """Half to even on the scaled value; the same in both engines."""
    return F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def bucket(c: Column, steps: Sequence[tuple[float | None, str]], default: str = "unknown") -> Column:
    """The first step that is above the value."""
    out = F.lit(None).cast("string")
    for limit, name in reversed(steps):
        out = F.lit(name) if limit is None else F.when(c < limit, F.lit(name)).otherwise(out)
    return F.when(c.isNull(), F.lit(default)).otherwise(out)


def capital_tier(c: Column) -> Column:
    x = number(c)
    return bucket(F.when(x > 0, x), V.CAPITAL_TIERS)


def parse_date(c: Column) -> Column:
    head = F.substring(c.cast("string"), 1, 10)
    return F.coalesce(*[F.try_to_date(head, f) for f in V.DATE_FORMATS])


def age_years(c: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, c)
    return F.when(days >= 0, days / F.lit(365.25))


def maturity(age: Column) -> Column:
    return bucket(age, V.MATURITY)


def months_between(c: Column, as_of: Column) -> Column:
    """Calendar months, whatever the day."""
    return (F.year(as_of) - F.year(c)) * 12 + F.month(as_of) - F.month(c)


def is_new(c: Column, as_of: Column) -> Column:
    return F.coalesce(months_between(c, as_of).between(0, 12), F.lit(False))


def capital_per_year(capital: Column, age: Column) -> Column:
    x = number(capital)
    return F.when((x > 0) & (age >= 0.5), rounded(x / age))


def dynamism(per_year: Column) -> Column:
    return F.when(per_year.isNull(), "unknown").when(per_year >= V.DYNAMISM_HIGH, "high").when(per_year >= V.DYNAMISM_MEDIUM, "medium").otherwise("low")


def digital_signal(activity: Column) -> Column:
    return F.when(T.any_word(activity, V.DIGITAL_HIGH), "high").when(T.any_word(activity, V.DIGITAL_MEDIUM), "medium").otherwise("standard")


def mobility_signal(activity: Column) -> Column:
    return T.any_word(activity, V.MOBILITY)


def multisite_signal(activity: Column, capital: Column) -> Column:
    return T.any_word(activity, V.MULTISITE) | F.coalesce(number(capital) >= V.MULTISITE_CAPITAL, F.lit(False))


def city(address: Column, cities: Sequence[str] = tuple(V.CITIES)) -> Column:
    """The first listed city that the address names; blank: unknown, none: other."""
    a, out = T.normalize(address), F.lit("other")
    for name in reversed(cities):
        out = F.when(T.any_word(a, [name.lower()]), F.lit(name)).otherwise(out)
    return F.when(a == "", "unknown").otherwise(out)


def governorate(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.CITY_GOVERNORATE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit("Unknown"))


def legal_form(c: Column) -> Column:
    n = T.normalize(c)
    return F.when(n == "", "unknown").otherwise(T.first_containing(n, V.LEGAL_FORMS, F.lit("other")))


def company_size(form: Column, tier: Column, category: Column) -> Column:
    return (
        F.when(form == "solo", "Solo").when((form == "corporate") | (tier == "large"), "Large")
        .when((form == "sme") & (tier == "medium"), "Mid").when((category == "manufacturing") & tier.isin("medium", "large"), "Mid")
        .when((form == "sme") & tier.isin("small", "micro"), "Small").when(form == "partnership", "Small")
        .when(tier == "medium", "Mid").when(tier == "small", "Small").when(tier == "micro", "Solo").otherwise("Unknown")
    )


def business_model(activity: Column) -> Column:
    b, c = T.any_keyword(activity, V.B2B), T.any_keyword(activity, V.B2C)
    return F.when(b & c, "mixed").when(b, "B2B").when(c, "B2C").otherwise("unknown")


def international(*cols: Column) -> Column:
    return T.any_keyword(T.normalize(F.concat_ws(" ", *cols)), V.INTERNATIONAL)


def connectivity_need(activity: Column, category: Column, size: Column, multisite: Column) -> Column:
    big = size.isin("Mid", "Large")
    return (
        F.when(T.any_keyword(activity, V.CONNECTIVITY), "high")
        .when(category.isin("financial_services", "healthcare"), F.when(big, "high").otherwise("medium"))
        .when(category == "agriculture", "low").when(size == "Large", "high").when(size == "Mid", "medium")
        .when(size.isin("Small", "Solo") & multisite, "medium").otherwise("low")
    )


def fleet_size(activity: Column, category: Column, size: Column, mobility: Column) -> Column:
    return (
        F.when(~F.coalesce(mobility, F.lit(False)), "none")
        .when(T.any_keyword(activity, V.LARGE_FLEET), F.when(size.isin("Mid", "Large"), "large").otherwise("medium"))
        .when(T.any_keyword(activity, V.SMALL_FLEET), "small")
        .when((category == "transport") & (size == "Large"), "large").when((category == "transport") & (size == "Mid"), "medium").otherwise("small")
    )


def completeness(*cols: Column) -> Column:
    """Share of columns that hold a value, two digits."""
    filled = sum((T.blank_to_null(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return rounded(filled / F.lit(float(len(cols))), 2)


def callable_prospect(name: Column, address: Column, *activities: Column) -> Column:
    has = [T.blank_to_null(c).isNotNull() for c in (name, address, *activities)]
    rest = has[1]
    for x in has[2:]:
        rest = rest | x
    return has[0] & rest
