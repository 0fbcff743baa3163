"""Offer recommendation: declarative rules, purchase affinity with fallback, and their fusion."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from importlib import resources
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import values as V
from lodestar.functions.features import rounded
from lodestar.operators.tables import top_n

#: Columns that the conditions of rules compare with texts, and those that they take as flags.
TEXTS = ("category", "capital_tier", "company_size", "maturity", "digital_signal")
FLAGS = ("mobility_signal", "multisite_signal", "international_signal", "is_new_company")


class Rule(NamedTuple):
    """``when`` is an SQL condition over TEXTS and FLAGS; an empty target is any, but one must be given."""

    name: str
    when: str
    offer: str
    family: str
    score: float
    reason: str


def truthy(c: Column) -> Column:
    """True, "True", "true", 1 and "1" only."""
    return F.coalesce(c.cast("string").isin("true", "True", "1"), F.lit(False))


def load_rules(text: str | None = None) -> list[Rule]:
    """Rules in order of evaluation from CSV; by default the ninety of offer_rules.csv. A rule without a target is left out."""
    text = text or resources.files(__package__).joinpath("offer_rules.csv").read_text("utf-8")
    rules = [Rule(r["name"], r["when"], r["target_offer"].strip(), r["target_family"].strip(), float(r["score"]), r["reason"]) for r in csv.DictReader(io.StringIO(text))]
    return [r for r in rules if r.offer or r.family]


def rule_scores(companies: DataFrame, catalog: DataFrame, rules: Sequence[Rule], company: str = "identifiant_unique") -> DataFrame:
    """(company, offer_id, rule_score, n_rules_fired, rule_reasons, rule_names): probabilistic OR of the rules that fire.

    Rules are evaluated once per company in one projection; the fired ones are exploded and joined to
    the offers that they target (an offer, a family, or an offer only if it is of the family), so pairs
    without a rule never exist. Reasons and names stand by descending score, then in the order of rules.
    A column that ``companies`` lacks holds for no rule.
    """
    have = set(companies.columns)
    texts = [F.coalesce(F.trim(F.col(c).cast("string")) if c in have else F.lit(""), F.lit("")).alias(c) for c in TEXTS]
    flags = [(truthy(F.col(c)) if c in have else F.lit(False)).alias(c) for c in FLAGS]
    fired = F.array(*[F.when(F.expr(r.when), F.lit(i)) for i, r in enumerate(rules)])
    hits = companies.select(F.col(company).alias("company"), *texts, *flags).select("company", F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("ord"))
    spark = companies.sparkSession
    table = spark.createDataFrame([(i, r.name, r.offer, r.family, r.score, r.reason) for i, r in enumerate(rules)], "ord int, name string, offer string, family string, s double, reason string")
    c = catalog.select("offer_id", F.trim("family").alias("of_family"))
    aimed = table.join(c, ((table.offer == "") | (table.offer == c.offer_id)) & ((table.family == "") | (table.family == c.of_family))).select("ord", "offer_id", "name", "s", "reason")
    factor = F.least(F.greatest(F.lit(1.0) - F.col("s"), F.lit(0.0)), F.lit(1.0))
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "ord", "name", "reason")))
    pairs = hits.join(aimed, "ord").groupBy(F.col("company").alias(company), "offer_id")
    out = pairs.agg(rounded(F.lit(1.0) - F.product(factor), 4).alias("rule_score"), F.count("*").alias("n_rules_fired"), sorted_.alias("x"))
    return out.filter("rule_score <> 0").select(company, "offer_id", "rule_score", "n_rules_fired", F.array_join("x.reason", " | ").alias("rule_reasons"), F.array_join("x.name", ",").alias("rule_names"))


def labelled(purchases: DataFrame, category: str, item: str) -> DataFrame:
    """Purchases of a known category and a mapped item."""
    return purchases.filter((F.trim(F.col(category)) != "") & (F.trim(F.col(item)) != "") & (F.col(item) != V.UNMAPPED))


def with_size(purchases: DataFrame, sizes: DataFrame, key: str, size: str, order: str | None = None) -> DataFrame:
    """``purchases`` with the size of their company; of companies that ``sizes`` repeats the last known size counts."""
    known = sizes.select(key, size, *([order] if order else [])).na.drop(subset=[key, size])
    return purchases.join(last_of(known, [key], order), key, "left")


def affinity(purchases: DataFrame, category: str, size: str, item: str, least: int = V.COLLAB_MIN) -> DataFrame:
    """(level, category, size, item, n, share) at the segment, category and global level; thin groups are left out but the global one.

    Only labelled purchases teach. One scan: the three levels are grouping sets, their totals a window.
    """
    base = labelled(purchases, category, item).select(F.trim(F.col(category)).alias("category"), F.nullif(F.trim(F.col(size)), F.lit("")).alias("size"), F.col(item).alias("item"))
    sets = [["category", "size", "item"], ["category", "item"], ["item"]]
    g = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[0]]).agg(F.count("*").alias("n"), F.grouping("category").alias("all_categories"), F.grouping("size").alias("all_sizes"))
    level = F.when(F.col("all_categories") == 1, "global").when(F.col("all_sizes") == 1, "category").otherwise("segment")
    g = g.withColumn("level", level).filter("level <> 'segment' OR size IS NOT NULL")
    total = F.sum("n").over(Window.partitionBy("level", "category", "size"))
    return g.withColumn("total", total).filter((F.col("total") >= least) | (F.col("level") == "global")).select("level", "category", "size", "item", "n", rounded(F.col("n") / F.col("total"), 4).alias("share"))


def with_fallback(companies: DataFrame, table: DataFrame, company: str, category: str, size: str, top: int = V.COLLAB_TOP) -> DataFrame:
    """(company, item, share, source, rank): shares of the finest level whose group exists.

    The table of shares is reduced to the first ``top`` items of each group, a row for each, and read once.
    """
    key = F.concat_ws("\x01", "level", F.coalesce("category", F.lit("")), F.coalesce("size", F.lit("")))
    best = top_n(table.withColumn("key", key), ["key"], [F.desc("share"), F.desc("n"), F.asc("item")], top)
    groups = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "share"))).alias("items"))
    c, z = F.trim(F.col(category)), F.trim(F.col(size))
    blank = F.lit("")
    levels = [("segment", c, z, F.concat(F.lit("segment:"), c, F.lit("×"), z)), ("category", c, blank, F.concat(F.lit("category:"), c)), ("global", blank, blank, F.lit("global_popularity"))]
    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.concat_ws("\x01", F.lit(name), F.coalesce(a, blank), F.coalesce(b, blank)).alias("key"), source.alias("source")) for i, (name, a, b, source) in enumerate(levels)])
    found = companies.select(F.col(company).alias("company"), F.explode(tries).alias("t")).select("company", "t.*").filter("source IS NOT NULL").join(groups, "key")
    found = found.groupBy("company").agg(F.min_by(F.struct("items", "source"), "i").alias("x"))
    return found.select(F.col("company").alias(company), F.col("x.source").alias("source"), F.inline("x.items")).select(company, "item", "share", "source", "rank")


def last_of(df: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row of each key: the last in ``order`` (a column that goes), or the largest row where rows have no order."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.max_by(F.struct(*rest), order) if order else F.max(F.struct(*rest))
    return df.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.*")


def fuse(pairs: DataFrame, rule: DataFrame, content: DataFrame, collab: DataFrame, company: str, offer: str, order: str, top: int = V.RANK_TOP) -> DataFrame:
    """The best offers of each company from three score layers; a layer without the pair counts zero. Rounded scores are ranked.

    Each layer has its score column and any others (reasons, sources, overlaps); texts that are absent
    are empty, ``collab_source`` is "none". Of pairs that a layer repeats one row counts.
    """
    w = V.FUSION
    j = pairs
    for layer in (rule, content, collab):
        j = j.join(last_of(layer, [company, offer]), [company, offer], "left")
    j = j.na.fill(0.0, ["rule_score", "content_score", "collab_score"])
    if "collab_source" in j.columns:
        j = j.na.fill("none", ["collab_source"])
    j = j.na.fill("", [c for c in ("rule_reasons", "rule_names", "why_matched") if c in j.columns]).na.fill(0, [c for c in ("n_rules_fired",) if c in j.columns])
    j = j.withColumn("final_score", rounded(w[0] * F.col("rule_score") + w[1] * F.col("content_score") + w[2] * F.col("collab_score"), 4))
    return top_n(j, [company], [F.desc("final_score"), F.desc("rule_score"), F.desc("content_score"), F.asc(order)], top)


def match_label(score: Column) -> Column:
    """How strong the best offer of a company fits."""
    out = F.lit(V.MATCH_LABELS[-1][1])
    for least, name in reversed(V.MATCH_LABELS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out
