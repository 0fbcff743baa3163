"""Classification, similarity, scoring, recommendation, entity and extraction queries."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import features as X
from lodestar.functions import scoring as S
from lodestar.functions import text as T
from lodestar.functions import values as V
from lodestar.operators import classify, content, entity, extract, recommend, similarity, tables
from lodestar.plans.base import SQL_CUSTOMERS, SQL_TIER, query, sql_round, table
from lodestar.plans.reports import SQL_NEED, SQL_SIZE, profile
from lodestar.streaming.ingest import ingest

#: A small taxonomy over part names, by priority.
SECTORS = [("transport", ["bolt", "gear"], ["small"]), ("manufacturing", ["ring", "large"], ["red"]), ("retail", ["widget"], [])]


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(p_name, '{w}') AS INTEGER)" for w in words) or "0"


_RULES = " ".join(f"WHEN ({_hits(i)}) > 0 AND ({_hits(e)}) = 0 THEN struct_pack(c := '{s}', p := round_even(least(0.90 + 0.02 * ({_hits(i)}), 0.98) * 1000, 0) / 1000, m := 'taxonomy_rule')" for s, i, e in SECTORS)
_CONFLICTS = " ".join(f"WHEN ({_hits(i)}) > 0 AND ({_hits(e)}) > 0 THEN struct_pack(c := '{s}', p := CAST(0.6 AS DOUBLE), m := 'taxonomy_conflict')" for s, i, e in SECTORS)
SQL_TAXONOMY = f"(CASE {_RULES} {_CONFLICTS} ELSE struct_pack(c := 'others', p := CAST(0.5 AS DOUBLE), m := 'no_rule_match') END)"


@query(f"SELECT p_partkey, t.c AS category, CAST(t.p AS DOUBLE) AS confidence, t.m AS method FROM (SELECT p_partkey, {SQL_TAXONOMY} AS t FROM part)")
def taxonomy_classify(spark: SparkSession, sf: str) -> DataFrame:
    t = classify.taxonomy(T.basic_clean(F.col("p_name")), SECTORS)
    return table(spark, sf, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.category", "t.confidence", "t.method")


@query("""SELECT p_partkey, CASE p_name WHEN 'small ring' THEN 'exact:retail' WHEN 'red widget' THEN 'exact:tourism' ELSE
CASE WHEN regexp_matches(p_name, '\\bwidget\\b') THEN 'partial:retail' WHEN regexp_matches(p_name, '\\bsmall\\b') THEN 'partial:education' END END AS found FROM part""")
def validated_lookup(spark: SparkSession, sf: str) -> DataFrame:
    examples = spark.createDataFrame([("small ring", "healthcare", 1), ("red widget", "tourism", 2), ("small ring", "retail", 3)], "key string, category string, ord int")
    p = classify.exact_examples(table(spark, sf, "part").select("p_partkey", T.basic_clean(F.col("p_name")).alias("name")), "name", examples)
    part = classify.partial_example(F.col("name"), [("ring", "finance"), ("widget", "retail"), ("small", "education")])
    return p.select("p_partkey", F.coalesce(F.concat(F.lit("exact:"), "example_category"), F.concat(F.lit("partial:"), part)).alias("found"))


@query(f"SELECT CASE WHEN p_name = 'small ring' THEN 'validated_example_exact' WHEN t.m = 'taxonomy_rule' THEN t.m WHEN p_size >= 48 THEN 'embedding_similarity' WHEN p_size >= 45 THEN 'embedding_similarity_low_confidence' ELSE t.m END AS method, count(*) AS parts FROM (SELECT p_name, p_size, {SQL_TAXONOMY} AS t FROM part) GROUP BY 1")
def cascade_methods(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("t", classify.taxonomy(T.basic_clean(F.col("p_name")), SECTORS))
    near = similarity.embedding_method(F.when(F.col("p_size") >= 48, 0.93).when(F.col("p_size") >= 45, 0.87).otherwise(0.3))
    layers = [(F.col("p_name") == "small ring", F.lit("validated_example_exact")), (F.col("t.method") == "taxonomy_rule", F.col("t.method")), (near == "embedding_similarity", near)]
    return p.groupBy(classify.cascade(layers, [near, F.col("t.method")]).alias("method")).agg(F.count("*").alias("parts"))


SQL_SIM = "SELECT q.vec_id AS query, r.vec_id AS ref, r.label AS label, round_even(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) * 1000000.0, 0) / 1000000.0 AS sim, round_even(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) * 1000000000000.0, 0) AS fine FROM embeddings q, embeddings r WHERE q.vec_id % 5 = 0 AND r.vec_id % 5 <> 0"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return e.filter("id % 5 = 0"), e.filter("id % 5 <> 0"), e.select(F.col("id").alias("ref"), "label")


@query(f"SELECT query, label, sim, CASE WHEN round_even(sim * 1000, 0) / 1000 >= 0.9 THEN 'embedding_similarity' WHEN round_even(sim * 1000, 0) / 1000 >= 0.85 THEN 'embedding_similarity_low_confidence' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fine DESC, ref) AS r FROM ({SQL_SIM})) WHERE r = 1")
def nn_classify(spark: SparkSession, sf: str) -> DataFrame:
    q, r, labels = _vectors(spark, sf)
    return similarity.nearest(q, r, 1).join(labels, "ref").select("query", "label", "sim", similarity.embedding_method(F.col("sim")).alias("method"))


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fine DESC, ref DESC) AS r FROM ({SQL_SIM})), k AS (SELECT * FROM n WHERE r <= 5 AND sim >= 0.1),
v AS (SELECT query, label, round_even(sum(sim) * 1000000.0, 0) / 1000000.0 AS votes, min(r) AS f FROM k GROUP BY 1, 2), t AS (SELECT query, max(sim) AS top_sim FROM k GROUP BY 1)
SELECT query, label, votes, top_sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, f) AS w FROM v) JOIN t USING (query) WHERE w = 1""")
def knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    q, r, labels = _vectors(spark, sf)
    return similarity.weighted_vote(similarity.nearest(q, r, 5, ties_last=True).join(labels, "ref"), "label", 0.1).select("query", "label", "votes", "top_sim")


@query(f"SELECT query, ref, sim, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fine DESC, ref) AS r FROM ({SQL_SIM}) WHERE sim >= 0.35) WHERE r <= 8")
def content_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, r, _ = _vectors(spark, sf)
    return similarity.nearest(q, r, 8, floor=0.35).select("query", "ref", "sim", "rank")


#: The offers of the fixed rules; a flag is TRUE or FALSE.
OFFERS = list(csv.DictReader(io.StringIO(resources.files(__package__).joinpath("offer_catalog.csv").read_text("utf-8"))))
OFFER_IDS = sorted(o["offer_id"] for o in OFFERS)


def catalog(spark: SparkSession) -> DataFrame:
    flags = ("is_mobility", "is_multisite", "is_security")
    rows = [(*(o[c] for c in ("offer_id", "offer_name", "family")), *(o[c] == "TRUE" for c in flags), OFFER_IDS.index(o["offer_id"])) for o in OFFERS]
    return spark.createDataFrame(rows, "offer_id string, offer_name string, family string, is_mobility boolean, is_multisite boolean, is_security boolean, o int")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL_PROFILE = f"""(SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'healthcare' ELSE lower(c_mktsegment) END AS category, {SQL_TIER} AS capital_tier, {SQL_SIZE} AS company_size, {SQL_NEED} AS connectivity_need, coalesce(n_orders > 10, false) AS multisite_signal,
CASE WHEN first_order IS NULL THEN 'unknown' WHEN date_diff('day', first_order, DATE '2001-08-01') / 365.25 < 1 THEN 'startup' WHEN date_diff('day', first_order, DATE '2001-08-01') / 365.25 < 3 THEN 'growing' WHEN date_diff('day', first_order, DATE '2001-08-01') / 365.25 < 10 THEN 'established' ELSE 'mature' END AS maturity,
coalesce((year(DATE '2001-08-01') - year(last_order)) * 12 + month(DATE '2001-08-01') - month(last_order) BETWEEN 0 AND 12, false) AS is_new_company, c_nationkey % 2 = 0 AS mobility_signal, c_nationkey % 5 = 0 AS international_signal,
CASE c_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'standard' END AS digital_signal, c_acctbal, c_nationkey FROM {SQL_CUSTOMERS})"""
#: The same with the sectors of the rules in place of the driver's market segments.
SECTOR_OF = {"automobile": "transport", "building": "manufacturing", "furniture": "retail", "machinery": "tourism"}
SQL_COMPANIES = f"(SELECT * REPLACE (CASE category {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in SECTOR_OF.items())} ELSE category END AS category) FROM {SQL_PROFILE})"


def companies(spark: SparkSession, sf: str) -> DataFrame:
    sector = F.col("category")
    for k, v in SECTOR_OF.items():
        sector = F.when(F.col("category") == k, v).otherwise(sector)
    return profile(spark, sf).withColumn("category", sector)


SQL_FIRED = " UNION ALL ".join(f"SELECT c_custkey, {i} AS ord, {_quoted(r.name)} AS name, {_quoted(r.reason)} AS reason, {_quoted(r.offer)} AS offer, {_quoted(r.family)} AS family, CAST({r.score} AS DOUBLE) AS s FROM p WHERE {r.when}" for i, r in enumerate(recommend.load_rules()))
SQL_OFFERS = "(VALUES " + ", ".join(f"({_quoted(o['offer_id'])}, {_quoted(o['family'])}, {OFFER_IDS.index(o['offer_id'])})" for o in OFFERS) + ") AS o(offer_id, of_family, o)"
SQL_RULE_SCORES = f"""WITH p AS {SQL_COMPANIES}, h AS ({SQL_FIRED})
SELECT c_custkey, offer_id, {sql_round('1.0 - product(1.0 - s)', 4)} AS rule_score, count(*) AS n_rules_fired, string_agg(reason, ' | ' ORDER BY s DESC, ord) AS rule_reasons, string_agg(name, ',' ORDER BY s DESC, ord) AS rule_names
FROM h JOIN {SQL_OFFERS} ON (h.offer = '' OR h.offer = offer_id) AND (h.family = '' OR h.family = of_family) GROUP BY 1, 2"""


@query(SQL_RULE_SCORES)
def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.rule_scores(companies(spark, sf), catalog(spark), recommend.load_rules(), company="c_custkey")


def _offer_text(o: dict[str, str]) -> str:
    tags = " ; ".join(text for c, text in V.OFFER_TAGS.items() if o[c] == "TRUE")
    return f"Offre: {o['offer_name']}. Categorie: {V.FAMILY_TEXTS[o['family']]}" + (f". Adapte a: {tags}." if tags else ".")


def _sql_named(c: str, names: dict[str, str], label: str = "") -> str:
    return f"CASE {c} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(label + v)}" for k, v in names.items()) + " END"


def _sql_terms(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(strip_accents({text})), '[a-z]{{4,}}'), lambda w: NOT list_contains({V.PROFILE_STOP_WORDS}, w)))"


SQL_TEXT = f"concat_ws('. ', {_sql_named('category', V.SECTOR_TEXTS, 'Secteur: ')}, {_sql_named('company_size', V.SIZE_TEXTS, 'Taille: ')}, {_sql_named('maturity', V.MATURITY_TEXTS)}, {', '.join(f'CASE WHEN {c} THEN {_quoted(t)} END' for c, t in V.SIGNAL_TEXTS.items())}) || '.'"
SQL_OFFER_TEXTS = "(VALUES " + ", ".join(f"({_quoted(o['offer_id'])}, {_quoted(_offer_text(o))})" for o in OFFERS) + ") AS t(offer_id, q)"
SQL_CONTENT = f"""WITH c AS MATERIALIZED (SELECT c_custkey, {_sql_terms(SQL_TEXT)} AS v FROM {SQL_COMPANIES}), o AS MATERIALIZED (SELECT offer_id, {_sql_terms('q')} AS w FROM {SQL_OFFER_TEXTS}),
s AS (SELECT c_custkey, offer_id, list_intersect(v, w) AS shared, coalesce(len(list_intersect(v, w)) / nullif(sqrt(CAST(len(v) AS DOUBLE) * len(w)), 0), 0) AS s FROM c, o),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY s DESC, offer_id) AS r FROM s WHERE s >= 0.1)
SELECT c_custkey, offer_id, round_even(s * 10000.0, 0) / 10000.0 AS content_score, CAST(r AS INTEGER) AS rank, CASE WHEN len(shared) = 0 THEN 'semantic match' ELSE array_to_string(list_transform(list_sort(list_transform(shared, lambda x: struct_pack(n := -length(x), w := x)))[1:3], lambda x: x.w), ', ') END AS why_matched FROM r WHERE r <= 8"""


@query(SQL_CONTENT)
def content_layer(spark: SparkSession, sf: str) -> DataFrame:
    """The text profiles of companies held against those of the offers, without an encoder."""
    return content.content_scores(companies(spark, sf), catalog(spark), "c_custkey", floor=0.1)


#: Purchases of offers: some have no category or a blank one, some parts are no offer.
SQL_PURCHASES = f"""(SELECT CASE c_nationkey WHEN 3 THEN NULL WHEN 4 THEN ' ' ELSE category END AS category, nullif(company_size, 'Unknown') AS size, coalesce(offer_id, 'unmapped') AS item
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN {SQL_OFFERS} ON l_partkey % 41 = o JOIN {SQL_COMPANIES} c ON o_custkey = c.c_custkey)"""
SQL_SHARES = f"""g AS (SELECT category, size, item, count(*) AS n, CASE WHEN GROUPING(size) = 0 THEN 'segment' WHEN GROUPING(category) = 0 THEN 'category' ELSE 'global' END AS level
FROM (SELECT * FROM {SQL_PURCHASES} WHERE trim(category) <> '' AND trim(item) <> '' AND item <> 'unmapped') GROUP BY GROUPING SETS ((category, size, item), (category, item), (item))),
a AS (SELECT level, category, size, item, n, {sql_round('n * 1.0 / total', 4)} AS share FROM (SELECT *, sum(n) OVER (PARTITION BY level, category, size) AS total FROM g WHERE level <> 'segment' OR size IS NOT NULL) WHERE total >= 3 OR level = 'global')"""


def _purchases(spark: SparkSession, sf: str) -> DataFrame:
    li, o = (table(spark, sf, t) for t in ("lineitem", "orders"))
    names = F.create_map(*[x for i, k in enumerate(OFFER_IDS) for x in (F.lit(i).cast("long"), F.lit(k))])
    bought = li.select("l_orderkey", F.coalesce(F.try_element_at(names, F.col("l_partkey") % 41), F.lit(V.UNMAPPED)).alias("item")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = companies(spark, sf).select("c_custkey", F.when(F.col("c_nationkey") == 3, None).when(F.col("c_nationkey") == 4, " ").otherwise(F.col("category")).alias("category"), F.nullif("company_size", F.lit("Unknown")).alias("company_size"))
    sizes = c.select(F.col("c_custkey").alias("o_custkey"), "company_size")
    return recommend.with_size(bought, sizes, "o_custkey", "company_size").join(c.select("c_custkey", "category"), F.col("o_custkey") == F.col("c_custkey")).select("category", "company_size", "item")


@query(f"WITH {SQL_SHARES} SELECT level, category, size, item, n, share FROM a")
def affinity_shares(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.affinity(_purchases(spark, sf), "category", "company_size", "item")


SQL_COLLAB = f"""WITH {SQL_SHARES}, c AS (SELECT c_custkey, category AS c, company_size AS z, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.level = 'segment' AND a.category = p.category AND a.size = p.company_size) THEN 'segment' WHEN EXISTS (SELECT 1 FROM a WHERE a.level = 'category' AND a.category = p.category) THEN 'category' ELSE 'global' END AS level FROM {SQL_COMPANIES} p)
SELECT c_custkey, item, share, CASE c.level WHEN 'segment' THEN 'segment:' || c || '×' || z WHEN 'category' THEN 'category:' || c ELSE 'global_popularity' END AS source, CAST(rank AS INTEGER) AS rank FROM (
SELECT c.*, a.item, a.share, row_number() OVER (PARTITION BY c_custkey ORDER BY share DESC, n DESC, item) AS rank FROM c JOIN a ON a.level = c.level AND (c.level = 'global' OR (a.category = c AND (c.level = 'category' OR a.size = z)))) c WHERE rank <= 10"""


@query(SQL_COLLAB)
def collab_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.with_fallback(companies(spark, sf), affinity_shares(spark, sf), "c_custkey", "category", "company_size").select("c_custkey", "item", "share", "source", "rank")


@query(f"""WITH r AS ({SQL_RULE_SCORES}), t AS ({SQL_CONTENT}), b AS ({SQL_COLLAB}),
f AS (SELECT j.c_custkey, j.offer_id, j.o, coalesce(rule_score, 0.0) AS rule_score, coalesce(n_rules_fired, 0) AS n_rules_fired, coalesce(rule_reasons, '') AS rule_reasons, coalesce(content_score, 0.0) AS content_score, coalesce(why_matched, '') AS why_matched, coalesce(share, 0.0) AS collab_score, coalesce(source, 'none') AS collab_source
FROM (SELECT c_custkey, offer_id, o FROM customer CROSS JOIN {SQL_OFFERS}) j LEFT JOIN r USING (c_custkey, offer_id) LEFT JOIN t USING (c_custkey, offer_id) LEFT JOIN b ON b.c_custkey = j.c_custkey AND b.item = j.offer_id),
s AS (SELECT *, {sql_round('0.4 * rule_score + 0.4 * content_score + 0.2 * collab_score', 4)} AS final_score FROM f)
SELECT c_custkey, CAST(k AS INTEGER) AS rank, offer_id, final_score, rule_score, content_score, collab_score, n_rules_fired, rule_reasons, collab_source, why_matched, CASE WHEN final_score >= 0.6 THEN 'Strong match' WHEN final_score >= 0.45 THEN 'Good match' WHEN final_score >= 0.3 THEN 'Possible fit' ELSE 'Weak signal' END AS match
FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY final_score DESC, rule_score DESC, content_score DESC, o) AS k FROM s) WHERE k <= 3""")
def hybrid_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The three layers over every company and offer, fused."""
    offers = F.explode(F.array(*[F.struct(F.lit(o).alias("offer_id"), F.lit(i).alias("o")) for i, o in enumerate(OFFER_IDS)]))
    pairs = table(spark, sf, "customer").select("c_custkey", offers.alias("x")).select("c_custkey", "x.*")
    rule = rule_scores(spark, sf).drop("rule_names")
    collab = collab_fallback(spark, sf).select("c_custkey", F.col("item").alias("offer_id"), F.col("share").alias("collab_score"), F.col("source").alias("collab_source"))
    best = recommend.fuse(pairs, rule, content_layer(spark, sf).drop("rank"), collab, "c_custkey", "offer_id", "o")
    return best.select("c_custkey", "rank", "offer_id", "final_score", "rule_score", "content_score", "collab_score", "n_rules_fired", "rule_reasons", "collab_source", "why_matched", recommend.match_label(F.col("final_score")).alias("match"))


def _sql_factor(x: str, table_: dict, default: float) -> str:
    return f"CASE lower({x}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + f" ELSE {default} END"


_TERMS = [f"22.0 * {_sql_factor('category', S.V.SECTOR_PROPENSITY, 0.5)}", f"20.0 * {_sql_factor('capital_tier', S.V.TIER_FACTOR, 0.3)}", f"16.0 * {_sql_factor('company_size', S.V.SIZE_FACTOR, 0.35)}", f"16.0 * {_sql_factor('connectivity_need', S.V.NEED_FACTOR, 0.4)}", "10.0 * CASE WHEN multisite_signal THEN 1 ELSE 0 END", "8.0 * CASE WHEN mobility_signal THEN 1 ELSE 0 END", "8.0 * CASE WHEN international_signal THEN 1 ELSE 0 END"]
SQL_VALUE = "round_even(least(" + " + ".join(sql_round(f"CAST({t} AS DOUBLE)", 2) for t in _TERMS) + ", 100.0) * 100, 0) / 100"


def _value(spark: SparkSession, sf: str) -> DataFrame:
    c = profile(spark, sf)
    score, parts = S.firmographic_value(*[F.col(x) for x in ("category", "capital_tier", "company_size", "connectivity_need", "multisite_signal", "mobility_signal", "international_signal")])
    return c.withColumn("value_score", score).withColumn("value_breakdown", F.to_json(parts))


@query(f"SELECT c_custkey, {SQL_VALUE} AS value_score FROM {SQL_PROFILE}")
def value_score(spark: SparkSession, sf: str) -> DataFrame:
    return _value(spark, sf).select("c_custkey", "value_score")


SQL_SCORED = f"(SELECT *, CASE WHEN v >= 65 AND p >= 70 THEN 'A' WHEN v >= 65 THEN 'B' WHEN p >= 70 THEN 'C' ELSE 'D' END AS tier FROM (SELECT c_custkey, c_nationkey, {SQL_VALUE} AS v, {sql_round('(rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0) / count(*) OVER () * 100', 1)} AS p FROM {SQL_PROFILE}))"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.percentile(_value(spark, sf), "c_acctbal", "p")
    return c.withColumn("tier", S.tier(F.col("value_score"), F.col("p")))


@query(f"SELECT tier, count(*) AS prospects, {sql_round('avg(' + sql_round('0.5 * v + 0.5 * p', 2) + ')', 2)} AS avg_priority FROM {SQL_SCORED} GROUP BY 1")
def priority_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("tier").agg(F.count("*").alias("prospects"), X.rounded(F.avg(S.priority(F.col("value_score"), F.col("p"))), 2).alias("avg_priority"))


_GEO, _PHONE, _MAIL = "c_nationkey % 4 = 0", "c_nationkey % 3 = 0", "c_nationkey % 2 = 0"
SQL_CHANNEL = f"(CASE tier WHEN 'A' THEN CASE WHEN {_GEO} THEN 'field_sales' WHEN {_PHONE} THEN 'tele_sales' WHEN {_MAIL} THEN 'email' ELSE 'social' END WHEN 'B' THEN CASE WHEN {_PHONE} THEN 'tele_sales' WHEN {_MAIL} THEN 'email' ELSE 'social' END WHEN 'C' THEN CASE WHEN {_MAIL} THEN 'email' WHEN {_PHONE} THEN 'sms' ELSE 'social' END ELSE 'none' END)"


@query(f"SELECT c_custkey, tier, {SQL_CHANNEL} AS campaign_channel, CASE tier WHEN 'A' THEN CASE WHEN {SQL_CHANNEL} = 'social' THEN 'Medium' ELSE 'High' END WHEN 'B' THEN 'Medium' WHEN 'C' THEN 'Low' ELSE 'None' END AS budget_band FROM {SQL_SCORED}")
def campaign_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = S.campaign(F.col("tier"), F.expr(_GEO), F.expr(_PHONE), F.expr(_MAIL))
    return _scored(spark, sf).select("c_custkey", "tier", plan["campaign_channel"].alias("campaign_channel"), plan["budget_band"].alias("budget_band"))


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf, "supplier").select("s_suppkey", F.regexp_replace("s_name", "^Supplier", "Customer").alias("s_name"), "s_nationkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    block = F.right(T.normalize_name(F.col("s_name")), F.lit(3))
    return s.withColumn("block", block), c.withColumn("block", F.right(T.normalize_name(F.col("c_name")), F.lit(3)))


def _best(spark: SparkSession, sf: str) -> DataFrame:
    s, c = _pairs(spark, sf)
    score = 0.8 * entity.edit_similarity(F.col("s_name"), F.col("c_name")) + F.when(F.col("s_nationkey") == F.col("c_nationkey"), 0.2).otherwise(0.0)
    return entity.best_matches(s, c, X.rounded(score, 6), "s_suppkey", "c_custkey")


SQL_BEST = "(SELECT s_suppkey, c_custkey, score FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS r FROM (SELECT s_suppkey, c_custkey, round_even((0.8 * (1.0 - levenshtein(replace(s_name, 'Supplier', 'Customer'), c_name) / CAST(greatest(length(replace(s_name, 'Supplier', 'Customer')), length(c_name)) AS DOUBLE)) + CASE WHEN s_nationkey = c_nationkey THEN 0.2 ELSE 0.0 END) * 1000000, 0) / 1000000 AS score FROM supplier JOIN customer ON right(s_name, 3) = right(c_name, 3))) WHERE r = 1 AND score > 0)"


@query(f"SELECT s_suppkey, c_custkey, score, CASE WHEN score >= 0.82 THEN 'match' WHEN score >= 0.68 THEN 'review' ELSE 'unmatched' END AS decision FROM {SQL_BEST}")
def entity_block_match(spark: SparkSession, sf: str) -> DataFrame:
    return _best(spark, sf).withColumn("decision", entity.decide(F.col("score")))


@query(f"""WITH b AS {SQL_BEST} SELECT match_source, count(*) AS n FROM (SELECT 'both' AS match_source FROM b WHERE score >= 0.82 UNION ALL SELECT 'register_only' FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b WHERE score >= 0.82) UNION ALL
SELECT 'listing_only' FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM b WHERE score >= 0.68)) GROUP BY 1""")
def master_union(spark: SparkSession, sf: str) -> DataFrame:
    s, c = _pairs(spark, sf)
    return entity.master(c.drop("block"), s.drop("block"), _best(spark, sf), "c_custkey", "s_suppkey").groupBy("match_source").agg(F.count("*").alias("n"))


@query()
def entity_token_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The difflib similarity, after the block."""
    s, c = _pairs(spark, sf)
    return entity.best_by_name(s.withColumn("s_name", T.normalize_name(F.col("s_name"))), c.withColumn("c_name", T.normalize_name(F.col("c_name"))), "s_suppkey", "c_custkey", "s_name", "c_name")


@query("SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE lang <> 'empty' AND (quality = 0 OR toxic = 1)")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    risky = classify.is_risky(F.when(F.col("quality") == 0, "others").otherwise("retail"), F.lit(0.95), F.col("lang"), F.col("toxic") == 1)
    return d.filter(risky).select("doc_id", "quality", "toxic")


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links FROM pages")
def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("links"))


@query("SELECT doc_id, count(*) AS lines, count(*) FILTER (trim(l) <> '') AS filled FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS l FROM documents) GROUP BY 1")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return extract.lines(table(spark, sf, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.trim("raw_line") != "").alias("filled"))


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stream, the first of each content kept, read back from the sink."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    out = f"{base}/ingest-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="lodestar-")
    source = f"{sf}/documents.parquet"
    schema = spark.read.parquet(source).schema
    files = spark.readStream.schema(schema)
    stream = files.option("pathGlobFilter", "documents.parquet").parquet(sf) if _is_file(spark, source) else files.parquet(source)
    stream = stream.select("doc_id", F.sha2("text", 256).alias("sha256"))
    ingest(stream, "sha256", f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id long, sha256 string").parquet(f"{out}/table").select("sha256")

