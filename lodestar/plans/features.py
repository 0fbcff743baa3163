"""Queries of signals, scorers, filters and side outputs over the star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import features as X
from lodestar.functions import text as T
from lodestar.functions import values as V
from lodestar.operators import audit, classify, entity, scorers, tables
from lodestar.plans import decisions
from lodestar.plans.base import ORACLES, query, sql_round, table

#: Activities that parts stand for, by key.
ACTIVITIES = [
    "transport routier de marchandises", "developpement de logiciels", "commerce de gros et distribution", "commerce de detail, boutique", "salon de coiffure", "conseil en ingenierie", "import export de produits",
    "taxi et livraison", "hebergement et cloud", "restaurant", "agence de voyages international", "culture de cereales", "x_gros", "fourniture aux entreprises et vente au detail",
]
FORMS = ["SUARL", "Société à responsabilité limitée", "Société Anonyme (SA)", "Société en nom collectif", "Mutuelle", "x", " "]
SQL_FORMS = ["solo", "sme", "corporate", "partnership", "other", "other", "unknown"]
SIZES = ["Solo", "Small", "Mid", "Large"]


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_pick(c: str, values: Sequence[str]) -> str:
    return f"CASE {c} % {len(values)} " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


def _sql_word(words: Sequence[str]) -> str:
    return f"regexp_matches(a, {_q(chr(92) + 'b(?:' + '|'.join(words) + ')' + chr(92) + 'b')})"


def _sql_keyword(words: Sequence[str]) -> str:
    return "(" + " OR ".join([_sql_word([w for w in words if " " not in w]), *(f"contains(a, {_q(w)})" for w in words if " " in w)]) + ")"


def _pick(c: str, values: Sequence[str]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))


SQL_SIGNALS = f"""SELECT p_partkey, CASE WHEN {_sql_word(V.DIGITAL_HIGH)} THEN 'high' WHEN {_sql_word(V.DIGITAL_MEDIUM)} THEN 'medium' ELSE 'standard' END AS digital_signal, {_sql_word(V.MOBILITY)} AS mobility_signal,
{_sql_word(V.MULTISITE)} OR p_retailprice * 100 >= 100000 AS multisite_signal, CASE WHEN {_sql_keyword(V.B2B)} AND {_sql_keyword(V.B2C)} THEN 'mixed' WHEN {_sql_keyword(V.B2B)} THEN 'B2B' WHEN {_sql_keyword(V.B2C)} THEN 'B2C' ELSE 'unknown' END AS business_model,
{_sql_keyword(V.INTERNATIONAL)} AS international_signal, {_sql_pick('p_partkey', SQL_FORMS)} AS legal_form,
CASE WHEN NOT {_sql_word(V.MOBILITY)} THEN 'none' WHEN {_sql_keyword(V.LARGE_FLEET)} THEN CASE WHEN size IN ('Mid', 'Large') THEN 'large' ELSE 'medium' END WHEN {_sql_keyword(V.SMALL_FLEET)} THEN 'small' ELSE 'small' END AS fleet_size,
CASE WHEN {_sql_keyword(V.CONNECTIVITY)} THEN 'high' WHEN size = 'Large' THEN 'high' WHEN size = 'Mid' THEN 'medium' WHEN size IN ('Small', 'Solo') AND p_size > 25 THEN 'medium' ELSE 'low' END AS connectivity_need
FROM (SELECT *, {_sql_pick('p_partkey', ACTIVITIES)} AS a, {_sql_pick('p_size', SIZES)} AS size FROM part)"""


@query(SQL_SIGNALS)
def activity_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The features of companies from their activity, form and capital."""
    a, size = T.normalize(F.col("a")), F.col("size")
    p = table(spark, sf, "part").withColumns({"a": _pick("p_partkey", ACTIVITIES), "size": _pick("p_size", SIZES), "form": _pick("p_partkey", FORMS)})
    return p.select(
        "p_partkey", X.digital_signal(a).alias("digital_signal"), X.mobility_signal(a).alias("mobility_signal"), X.multisite_signal(a, F.col("p_retailprice") * 100).alias("multisite_signal"), X.business_model(a).alias("business_model"),
        X.international(F.col("a")).alias("international_signal"), X.legal_form(F.col("form")).alias("legal_form"), X.fleet_size(a, F.lit("retail"), size, X.mobility_signal(a)).alias("fleet_size"), X.connectivity_need(a, F.lit("retail"), size, F.col("p_size") > 25).alias("connectivity_need"),
    )


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS first_token, regexp_matches(p_name, '^[a-z]') OR p_name LIKE '%)' AS fragment, contains(p_name, 'ring') OR regexp_matches(p_name, '\\b(?:red|blue)\\b') AS keyword, p_brand || ' - ' || p_type AS joined,
'a' || reverse('b' || CAST(p_size AS VARCHAR)) AS cut, p_name || CASE WHEN reverse(p_name) <> p_name THEN ' | ' || reverse(p_name) ELSE '' END AS variants, regexp_extract('noise {"k": ' || p_size || '} more', '(?s)\\{.*\\}') AS answer, true AS arabic FROM part""")
def text_helpers(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", T.first_token(name).alias("first_token"), T.is_fragment(name).alias("fragment"), (T.any_keyword(name, ["red", "blue", "a very long word"]) | T.any_keyword(name, ["ring x"]) | name.contains("ring")).alias("keyword"),
        T.joined(" - ", F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("joined"), F.concat(F.lit("a"), F.reverse(F.concat(F.lit("b"), F.col("p_size").cast("string")))).alias("cut"),
        T.variants(name).alias("variants"), T.json_in(F.concat(F.lit('noise {"k": '), F.col("p_size").cast("string"), F.lit("} more"))).alias("answer"), T.has_arabic(F.concat(name, F.lit("ب"))).alias("arabic"),
    )


PLACES = {"AUTOMOBILE": "Car dealer", "BUILDING": "Construction company", "FURNITURE": "Furniture store", "HOUSEHOLD": "Medical clinic", "MACHINERY": "Tool rental"}
PLACE_SECTORS = {"AUTOMOBILE": "retail", "BUILDING": "manufacturing", "FURNITURE": "retail", "HOUSEHOLD": "healthcare", "MACHINERY": "others"}
_RATING, _REVIEWS, _SITE = "CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 6 END", "CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 97 END", "CASE WHEN c_custkey % 3 = 0 THEN 'http://x' WHEN c_custkey % 3 = 1 THEN 'nan' END"
_PROMINENCE = f"CASE WHEN ({_RATING}) IS NULL AND ({_REVIEWS}) IS NULL THEN 0.3 ELSE 0.5 * least(coalesce({_RATING}, 0) / 5.0, 1.0) + 0.5 * least(ln(1 + coalesce({_REVIEWS}, 0)) / ln(51), 1.0) END"
_LISTED = " + ".join([sql_round(f"CAST(55.0 * CASE c_mktsegment {' '.join(f'WHEN {_q(k)} THEN {V.SECTOR_PROPENSITY[v]}' for k, v in PLACE_SECTORS.items())} END AS DOUBLE)", 2), sql_round(f"CAST(25.0 * ({_PROMINENCE}) AS DOUBLE)", 2), sql_round("CAST(20.0 * CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.3 END AS DOUBLE)", 2)])
SQL_LISTINGS = f"""SELECT c_custkey, sector, value_score, conversion_score, {sql_round('0.5 * value_score + 0.5 * conversion_score', 2)} AS priority_score, CASE WHEN value_score >= 65 AND conversion_score >= 70 THEN 'A' WHEN value_score >= 65 THEN 'B' WHEN conversion_score >= 70 THEN 'C' ELSE 'D' END AS tier
FROM (SELECT c_custkey, CASE c_mktsegment {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in PLACE_SECTORS.items())} END AS sector, {sql_round(f'least({_LISTED}, 100.0)', 2)} AS value_score, {sql_round('(rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER () * 100', 1)} AS conversion_score
FROM (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE floor(c_acctbal / 10) END AS p FROM customer WHERE c_nationkey <> 1))"""


@query(SQL_LISTINGS)
def listing_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as listings; some have no probability, which counts as 0."""
    place = F.lit(None).cast("string")
    for k, v in PLACES.items():
        place = F.when(F.col("c_mktsegment") == k, v).otherwise(place)
    c = table(spark, sf, "customer").select("c_custkey", place.alias("search_category"), F.expr(_RATING).alias("rating"), F.expr(_REVIEWS).alias("reviews"), F.expr(_SITE).alias("website"), F.when(F.col("c_custkey") % 11 > 0, F.floor(F.col("c_acctbal") / 10).cast("double")).alias("prob_client"), (F.col("c_nationkey") == 1).cast("int").alias("is_known_customer"))
    return scorers.score_listings(c).select("c_custkey", "sector", "value_score", "conversion_score", "priority_score", "tier")


_OWN = decisions.SQL_VALUE.replace("mobility_signal", "(c_custkey % 3 = 0)")
_READY = " + ".join([
    sql_round("CAST(30.0 * CASE WHEN c_custkey % 2 = 0 THEN 0.55 ELSE 0.0 END AS DOUBLE)", 2), sql_round("CAST(20.0 * CASE digital_signal WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END AS DOUBLE)", 2),
    sql_round("CAST(18.0 * CASE WHEN is_new_company THEN 1.0 ELSE 0.35 END AS DOUBLE)", 2), sql_round("CAST(17.0 * 0.3 AS DOUBLE)", 2), sql_round("CAST(15.0 * CASE WHEN c_custkey % 13 = 0 THEN 0.5 ELSE least((c_custkey % 13) / 10.0, 1.0) END AS DOUBLE)", 2),
])
SQL_REGISTRY = f"""SELECT c_custkey, value_score, conversion_score, {sql_round('0.5 * value_score + 0.5 * conversion_score', 2)} AS priority_score, CASE WHEN value_score >= 65 AND conversion_score >= 70 THEN 'A' WHEN value_score >= 65 THEN 'B' WHEN conversion_score >= 70 THEN 'C' ELSE 'D' END AS tier
FROM (SELECT c_custkey, {_OWN} AS value_score, {sql_round(f'least({_READY}, 100.0)', 2)} AS conversion_score FROM {decisions.SQL_COMPANIES})"""


@query(SQL_REGISTRY)
def registry_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as registered companies, with confidences beyond 1."""
    c = decisions.companies(spark, sf).withColumns({"business_model": F.when(F.col("c_custkey") % 3 == 0, "B2B").otherwise("B2C"), "callable_prospect": F.col("c_custkey") % 2 == 0, "confidence": F.col("c_custkey") % 13 / 10.0})
    return scorers.score_registry(c).select("c_custkey", "value_score", "conversion_score", "priority_score", "tier")


@query(f"SELECT count(*) FILTER (tier = 'A') AS A, count(*) FILTER (tier = 'B') AS B, count(*) FILTER (tier = 'C') AS C, count(*) FILTER (tier = 'D') AS D FROM ({SQL_REGISTRY})")
def tier_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scorers.tier_counts(registry_scores(spark, sf))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '^(red|blue).*ring$')")
def regex_search(spark: SparkSession, sf: str) -> DataFrame:
    return tables.search_pattern(table(spark, sf, "part"), "p_name", "^(Red|Blue).*RING$").select("p_partkey", "p_name")


@query("SELECT c_mktsegment AS sector, count(*) AS n FROM customer WHERE c_nationkey % 5 <> 0 AND lower(c_mktsegment) NOT IN ('building', 'machinery') GROUP BY 1")
def known_sectors(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("place", F.when(F.col("c_nationkey") % 5 != 0, F.lit("x")))
    return tables.known(c, ["c_mktsegment", "place"], ("building", "machinery")).groupBy(F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, t.c AS category FROM (SELECT p_partkey, {decisions.SQL_TAXONOMY} AS t FROM part) WHERE t.c = 'others' OR t.m = 'taxonomy_conflict'")
def vague_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = classify.taxonomy(T.basic_clean(F.col("p_name")), decisions.SECTORS)
    return tables.vague(table(spark, sf, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.*")).select("p_partkey", "category")


@query(f"SELECT p_partkey, t.c AS category, CAST(CASE WHEN regexp_matches(p_name, '^[s]') AND t.m <> 'taxonomy_rule' THEN least(t.p, 0.55) ELSE t.p END AS DOUBLE) AS confidence, t.m <> 'taxonomy_rule' AS to_model FROM (SELECT p_partkey, p_name, {decisions.SQL_TAXONOMY} AS t FROM part)")
def model_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of which a language model would see the result; names that begin with s count as fragments."""
    t = audit.cap_fragments(classify.taxonomy(T.basic_clean(F.col("p_name")), decisions.SECTORS), F.col("p_name").rlike("^s"))
    p = table(spark, sf, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.*")
    return p.select("p_partkey", "category", "confidence", audit.needs_model(F.col("method"), F.col("confidence"), F.col("category")).alias("to_model"))


@query("SELECT o_custkey, o_orderkey, c_mktsegment, first_event FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, event_id AS first_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1) ON user_id = c_custkey")
def first_row_join(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "k")
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), "ts", "event_id")
    found = tables.join_first(o.join(c, "k"), e, "k", [F.asc("ts"), F.asc("event_id")])
    return found.select(F.col("k").alias("o_custkey"), "o_orderkey", "c_mktsegment", F.col("event_id").alias("first_event"))


@query("SELECT n, brand FROM (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand LIMIT 12) ORDER BY n, brand DESC")
def top_brands(spark: SparkSession, sf: str) -> DataFrame:
    return tables.top_ascending(table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")), "n", 12, "brand").select("n", "brand")


@query("""SELECT user_id, event_id, array_to_string(list_transform(CASE WHEN list_position(list_transform(l, lambda x: x.t = 'purchase'), true) > 0 THEN l[1:list_position(list_transform(l, lambda x: x.t = 'purchase'), true) - 1] ELSE l END, lambda x: x.t), ',') AS until_purchase
FROM (SELECT user_id, event_id, coalesce(list(struct_pack(t := event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), []) AS l FROM events)""")
def look_ahead(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.look_ahead(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", 5, F.col("event_type") == "purchase", "w")
    return e.select("user_id", "event_id", F.array_join("w", ",").alias("until_purchase"))


@query(f"SELECT category, {sql_round('avg(rule_score)', 4)} AS rule_score, {sql_round('avg(content_score)', 4)} AS content_score, {sql_round('avg(collab_score)', 4)} AS collab_score FROM ({ORACLES['hybrid_rank']}) JOIN {decisions.SQL_COMPANIES} USING (c_custkey) GROUP BY 1")
def layers_by_sector(spark: SparkSession, sf: str) -> DataFrame:
    ranked = decisions.hybrid_rank(spark, sf).join(decisions.companies(spark, sf).select("c_custkey", "category"), "c_custkey")
    return ranked.groupBy("category").agg(*[X.rounded(F.avg(c), 4).alias(c) for c in ("rule_score", "content_score", "collab_score")])


@query(f"SELECT query, label, round_even(sim * 1000, 0) / 1000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fine DESC, ref) AS r FROM ({decisions.SQL_SIM})) WHERE r = 1 AND sim < 0.85")
def low_similarity(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.operators import similarity

    return similarity.low_similarity(decisions.nn_classify(spark, sf)).select("query", "label", X.rounded(F.col("sim"), 3).alias("score"))


#: Names that customers and suppliers stand for: the nation is the first token, and the key's last digits the phone.
SQL_ENTITIES = """WITH s AS (SELECT s_suppkey, lower(replace(n_name, '_', '')) AS block, r_name AS place, right('00000000' || s_suppkey, 8) AS phone FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey, lower(replace(n_name, '_', '')) AS block, CASE WHEN c_custkey % 2 = 0 THEN r_name ELSE '' END AS place, right('00000000' || c_custkey, 8) AS phone FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
j AS (SELECT s_suppkey, c_custkey, round_even((0.55 + 0.2 * CASE WHEN c.place <> '' THEN 0.5 ELSE 0.0 END + 0.25 * CASE WHEN s.phone = c.phone THEN 1.0 ELSE 0.0 END) * 1000, 0) / 1000 AS score FROM s JOIN c USING (block))
SELECT s_suppkey, c_custkey, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.82 THEN 'match' WHEN score >= 0.68 THEN 'review' ELSE 'unmatched' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) AS r FROM j) WHERE r = 1"""


@query(SQL_ENTITIES)
def entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers against customers, blocked on the first token of the normalised name; equal names, part of the places and a few phones."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")

    def side(name: str, key: str, nation: str):
        df = table(spark, sf, name).join(F.broadcast(place), F.col(nation) == F.col("n_nationkey"))
        norm = T.normalize_name(F.concat(F.replace("n_name", F.lit("_"), F.lit("")), F.lit(" SARL")))
        phone = T.normalize_phone(F.concat(F.lit("+216 00000000"), F.col(key).cast("string")))  # lpad would keep the first digits of long keys
        return df.select(key, norm.alias("name"), F.col("r_name").alias("place"), phone.alias("phone"), T.first_token(norm).alias("block"))

    s, c = side("supplier", "s_suppkey", "s_nationkey"), side("customer", "c_custkey", "c_nationkey")
    c = c.withColumn("place", F.when(F.col("c_custkey") % 2 == 0, F.col("place")).otherwise(""))
    return entity.best_by_profile(s, c, "s_suppkey", "c_custkey").withColumn("decision", entity.decide(F.col("score")))
