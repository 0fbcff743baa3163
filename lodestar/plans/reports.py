"""KPI reports, features and counts over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import features as X
from lodestar.functions import text as T
from lodestar.functions import values as V
from lodestar.operators import tables
from lodestar.plans.base import AS_OF, CAPITAL, SQL_CUSTOMERS, SQL_MATURITY, SQL_TIER, as_of, capital, customers, query, share, sql_bucket, sql_round, sql_share, table


@query(f"""SELECT c_mktsegment AS category, {SQL_MATURITY.replace(' d,', ' last_order,')} AS maturity, {SQL_TIER} AS capital_tier, count(*) AS companies, {sql_round(f'avg(c_acctbal * {CAPITAL})')} AS avg_capital
FROM {SQL_CUSTOMERS} GROUP BY 1, 2, 3 ORDER BY companies DESC, 1, 2, 3""")
def capital_tier_cohort(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf).select(F.col("c_mktsegment").alias("category"), X.maturity(X.age_years(F.col("last_order"), as_of())).alias("maturity"), X.capital_tier(capital()).alias("capital_tier"), capital().alias("k"))
    return c.groupBy("category", "maturity", "capital_tier").agg(F.count("*").alias("companies"), X.rounded(F.avg("k")).alias("avg_capital")).orderBy(F.desc("companies"), "category", "maturity", "capital_tier")


@query(f"""SELECT c_mktsegment AS category, count(c_custkey) AS companies, {sql_round(f'avg(c_acctbal * {CAPITAL})', 2)} AS avg_capital, {sql_round(f'median(c_acctbal * {CAPITAL})', 2)} AS median_capital,
{sql_share(f"{SQL_TIER} = 'large'")} AS pct_large, {sql_share('n_orders > 10')} AS pct_active, {sql_share('c_acctbal < 0')} AS pct_negative FROM {SQL_CUSTOMERS} GROUP BY 1 ORDER BY companies DESC, 1""")
def sector_kpis(spark: SparkSession, sf: str) -> DataFrame:
    c = customers(spark, sf)
    return c.groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("c_custkey").alias("companies"), X.rounded(F.avg(capital()), 2).alias("avg_capital"), X.rounded(F.median(capital()), 2).alias("median_capital"), share(X.capital_tier(capital()) == "large").alias("pct_large"), share(F.col("n_orders") > 10).alias("pct_active"), share(F.col("c_acctbal") < 0).alias("pct_negative")).orderBy(F.desc("companies"), "category")


@query(f"""SELECT n_name AS city, coalesce(r_name, 'Unknown') AS governorate, count(*) AS companies, {sql_share('c_acctbal > 5000')} AS pct_high, {sql_round('avg(c_acctbal)', 2)} AS avg_capital
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def geography_summary(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("companies"), share(F.col("c_acctbal") > 5000).alias("pct_high"), X.rounded(F.avg("c_acctbal"), 2).alias("avg_capital"))
    return per.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_name").alias("city"), F.coalesce("r_name", F.lit("Unknown")).alias("governorate"), "companies", "pct_high", "avg_capital")


SQL_NEW = f"coalesce((year(DATE '{AS_OF}') - year(last_order)) * 12 + month(DATE '{AS_OF}') - month(last_order) BETWEEN 0 AND 12, false)"


@query(f"""SELECT r_name AS governorate, count(*) AS companies, {sql_share(SQL_NEW)} AS pct_new, {sql_share("c_mktsegment = 'MACHINERY'")} AS pct_b2b, {sql_round('avg(c_acctbal)', 2)} AS avg_capital
FROM {SQL_CUSTOMERS} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def governorate_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c = customers(spark, sf).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy(F.col("r_name").alias("governorate")).agg(F.count("*").alias("companies"), share(X.is_new(F.col("last_order"), as_of())).alias("pct_new"), share(F.col("c_mktsegment") == "MACHINERY").alias("pct_b2b"), X.rounded(F.avg("c_acctbal"), 2).alias("avg_capital"))


SQL_SIZE = f"(CASE {SQL_TIER} WHEN 'large' THEN 'Large' WHEN 'medium' THEN 'Mid' WHEN 'small' THEN 'Small' WHEN 'micro' THEN 'Solo' ELSE 'Unknown' END)"
SQL_NEED = f"(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN CASE WHEN {SQL_SIZE} IN ('Mid', 'Large') THEN 'high' ELSE 'medium' END WHEN {SQL_SIZE} = 'Large' THEN 'high' WHEN {SQL_SIZE} = 'Mid' THEN 'medium' WHEN {SQL_SIZE} IN ('Small', 'Solo') AND n_orders > 10 THEN 'medium' ELSE 'low' END)"


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as companies: category, tier, size, maturity and signals."""
    c = customers(spark, sf).withColumn("category", F.when(F.col("c_mktsegment") == "HOUSEHOLD", "healthcare").otherwise(F.lower("c_mktsegment")))
    c = c.withColumn("capital_tier", X.capital_tier(capital())).withColumn("multisite_signal", F.coalesce(F.col("n_orders") > 10, F.lit(False)))
    c = c.withColumn("company_size", X.company_size(F.lit(None).cast("string"), F.col("capital_tier"), F.col("category")))
    c = c.withColumn("connectivity_need", X.connectivity_need(F.lit(""), F.col("category"), F.col("company_size"), F.col("multisite_signal")))
    c = c.withColumn("maturity", X.maturity(X.age_years(F.col("first_order"), as_of()))).withColumn("is_new_company", X.is_new(F.col("last_order"), as_of()))
    return c.withColumn("mobility_signal", F.col("c_nationkey") % 2 == 0).withColumn("international_signal", F.col("c_nationkey") % 5 == 0).withColumn("digital_signal", F.when(F.col("c_nationkey") % 3 == 0, "high").when(F.col("c_nationkey") % 3 == 1, "medium").otherwise("standard"))


@query(f"SELECT {SQL_SIZE} AS company_size, {SQL_NEED} AS connectivity_need, count(*) AS companies, {sql_round(f'avg(c_acctbal * {CAPITAL})')} AS avg_capital, {sql_share(SQL_NEW, 1)} AS pct_new FROM {SQL_CUSTOMERS} GROUP BY 1, 2")
def opportunity_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return profile(spark, sf).groupBy("company_size", "connectivity_need").agg(F.count("*").alias("companies"), X.rounded(F.avg(capital())).alias("avg_capital"), share(F.col("is_new_company"), 1).alias("pct_new"))


@query(f"SELECT {SQL_SIZE} AS company_size, {', '.join(f'count(*) FILTER ({SQL_NEED} = {chr(39)}{v}{chr(39)}) AS {v}' for v in ('high', 'medium', 'low'))} FROM {SQL_CUSTOMERS} GROUP BY 1")
def opportunity_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return profile(spark, sf).groupBy("company_size").pivot("connectivity_need", ["high", "medium", "low"]).count().na.fill(0)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS registrations FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 MONTH GROUP BY 1 ORDER BY 1")
def monthly_registrations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    cut = o.agg(F.add_months(F.max("d"), -24).alias("cut"))
    return o.join(F.broadcast(cut), F.col("d") >= F.col("cut")).groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.count("*").alias("registrations")).orderBy("month")


@query("SELECT coalesce(p_name, '(empty)') AS activity, count(*) AS occurrences FROM part WHERE NOT contains(p_name, 'widget') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def top_vague(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(~F.col("p_name").contains("widget")).groupBy(F.coalesce("p_name", F.lit("(empty)")).alias("activity")).agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "activity").limit(30)


@query(f"SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_totalprice >= 300000) AS large, count(DISTINCT o_custkey) AS buyers, {sql_round('avg(o_totalprice)', 2)} AS avg_price FROM orders")
def summary_scalars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.count_if(F.col("o_totalprice") >= 300000).alias("large"), F.count_distinct("o_custkey").alias("buyers"), X.rounded(F.avg("o_totalprice"), 2).alias("avg_price"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY n DESC, 1")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).orderBy(F.desc("n"), "event_type")


@query("""SELECT CASE WHEN regexp_matches(p_name, '\\b(?:bolt|gear)\\b') THEN 'high' WHEN regexp_matches(p_name, '\\b(?:widget)\\b') THEN 'medium' ELSE 'standard' END AS digital_signal,
regexp_matches(p_name, '\\b(?:red|blue)\\b') AS mobility_signal, regexp_matches(p_name, '\\b(?:small)\\b') OR p_retailprice >= 1000 AS multisite_signal, count(*) AS parts FROM part GROUP BY 1, 2, 3""")
def keyword_signals(spark: SparkSession, sf: str) -> DataFrame:
    name = T.normalize(F.col("p_name"))
    level = F.when(T.any_word(name, ["bolt", "gear"]), "high").when(T.any_word(name, ["widget"]), "medium").otherwise("standard")
    multi = T.any_word(name, ["small"]) | (F.col("p_retailprice") >= 1000)
    return table(spark, sf, "part").groupBy(level.alias("digital_signal"), T.any_word(name, ["red", "blue"]).alias("mobility_signal"), multi.alias("multisite_signal")).agg(F.count("*").alias("parts"))


@query("SELECT CASE WHEN contains(p_name, 'red') THEN 'solo' WHEN contains(p_name, 'ring') THEN 'corporate' WHEN contains(p_name, 'blue') THEN 'sme' ELSE 'other' END AS legal_form, count(*) AS parts FROM part GROUP BY 1")
def legal_form_first_match(spark: SparkSession, sf: str) -> DataFrame:
    form = T.first_containing(T.normalize(F.col("p_name")), [("red", "solo"), ("ring", "corporate"), ("blue", "sme")], F.lit("other"))
    return table(spark, sf, "part").groupBy(form.alias("legal_form")).agg(F.count("*").alias("parts"))


@query(f"SELECT {sql_bucket(f'({chr(40)}CASE WHEN date_diff({chr(39)}day{chr(39)}, CAST(o_orderdate AS DATE), DATE {chr(39)}{AS_OF}{chr(39)}) >= 0 THEN date_diff({chr(39)}day{chr(39)}, CAST(o_orderdate AS DATE), DATE {chr(39)}{AS_OF}{chr(39)}) / 365.25 END){chr(41)}', V.MATURITY)} AS maturity, count(*) AS orders FROM orders GROUP BY 1")
def age_maturity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(X.maturity(X.age_years(F.col("o_orderdate").cast("date"), as_of())).alias("maturity")).agg(F.count("*").alias("orders"))


@query(f"SELECT {SQL_NEW.replace('last_order', 'first_order')} AS is_new, {SQL_NEW} AS is_active, count(*) AS companies FROM {SQL_CUSTOMERS} GROUP BY 1, 2")
def new_company_flag(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).groupBy(X.is_new(F.col("first_order"), as_of()).alias("is_new"), X.is_new(F.col("last_order"), as_of()).alias("is_active")).agg(F.count("*").alias("companies"))


SQL_PER_YEAR = f"(CASE WHEN c_acctbal > 0 AND date_diff('day', first_order, DATE '{AS_OF}') / 365.25 >= 0.5 THEN round_even(c_acctbal * {CAPITAL} / (date_diff('day', first_order, DATE '{AS_OF}') / 365.25), 0) END)"


@query(f"SELECT CASE WHEN {SQL_PER_YEAR} IS NULL THEN 'unknown' WHEN {SQL_PER_YEAR} >= 50000 THEN 'high' WHEN {SQL_PER_YEAR} >= 10000 THEN 'medium' ELSE 'low' END AS dynamism, count(*) AS companies, {sql_round(f'avg({SQL_PER_YEAR})', 2)} AS avg_per_year FROM {SQL_CUSTOMERS} GROUP BY 1")
def dynamism(spark: SparkSession, sf: str) -> DataFrame:
    per_year = X.capital_per_year(capital(), X.age_years(F.col("first_order"), as_of()))
    return customers(spark, sf).groupBy(X.dynamism(per_year).alias("dynamism")).agg(F.count("*").alias("companies"), X.rounded(F.avg(per_year), 2).alias("avg_per_year"))


@query(f"SELECT doc_id, {sql_round('(CASE WHEN trim(text) NOT IN (%s) THEN 1 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN quality IS NOT NULL AND quality <> 0 THEN 1 ELSE 0 END) / 3.0' % (chr(39) * 2), 2)} AS data_quality_score FROM documents LEFT JOIN labels USING (doc_id)")
def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", X.completeness(F.col("text"), F.col("lang"), F.col("quality")).alias("data_quality_score"))


@query("SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars_clean, CAST(len(list_filter(string_split(t, ' '), lambda x: x <> '')) AS BIGINT) AS n_words FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-zA-Z0-9\u0600-\u06FF''\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)")
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Clean words are divided by single spaces, so counting those counts the words."""
    d = table(spark, sf, "documents").select("doc_id", T.basic_clean(F.col("text")).alias("t"))
    spaces = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit("")))
    return d.select("doc_id", F.length("t").cast("long").alias("n_chars_clean"), F.when(F.col("t") == "", 0).otherwise(spaces + 1).cast("long").alias("n_words"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name_key, right(regexp_replace(c_name, '\\D', '', 'g'), 8) AS phone_key FROM customer")
def name_phone_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", T.normalize_name(F.col("c_name")).alias("name_key"), T.normalize_phone(F.col("c_name")).alias("phone_key"))


@query("SELECT g.c_mktsegment AS segment, g.n AS total, g.hot AS hot, round_even(100.0 * g.hot / g.n * 10, 0) / 10 AS rate FROM (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (o_totalprice >= 400000) AS hot FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) g WHERE hot > 0")
def concentration_rate(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("total"), F.count_if(F.col("o_totalprice") >= 400000).alias("hot"))
    return g.filter("hot > 0").withColumn("rate", X.rounded(100.0 * F.col("hot") / F.col("total"), 1))


@query("SELECT c_custkey, round_even((rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER () * 100 * 10, 0) / 10 AS propensity FROM (SELECT c_custkey, floor(c_acctbal / 10) AS p FROM customer WHERE c_nationkey IS DISTINCT FROM 1)")
def propensity_percentile(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter(tables.except_value(F.col("c_nationkey"), 1)).select("c_custkey", F.floor(F.col("c_acctbal") / 10).cast("double").alias("p"))
    return tables.percentile(c, "p", "propensity").select("c_custkey", "propensity")


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    return tables.top_n(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("SELECT user_id, event_id, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS p FROM events)")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return tables.carry_forward(e, ["user_id"], ["ts", "event_id"], "p", "last_purchase").select("user_id", "event_id", "last_purchase")


@query("SELECT conv_id, turn, list_sum(l) AS around FROM (SELECT conv_id, turn, list(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS l FROM conversations)")
def look_around(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("n", F.length("text").cast("long"))
    return tables.look_around(c, ["conv_id"], ["turn"], "n", 1, 2, "w").select("conv_id", "turn", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x).alias("around"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77') ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 10")
def search_filter_page(spark: SparkSession, sf: str) -> DataFrame:
    found = tables.search(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], "77")
    return tables.page(found.select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 2, 10)


@query("SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN text END AS text FROM conversations")
def role_masking(spark: SparkSession, sf: str) -> DataFrame:
    roles = spark.createDataFrame([("assistant", "read_text"), ("admin", "read_text"), ("user", "list")], "role string, permission string")
    return tables.masked(table(spark, sf, "conversations"), roles, "read_text", ["text"]).select("conv_id", "turn", "role", "text")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tables.insert_if_absent(o.filter("o_orderstatus = 'F'"), o, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return tables.latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
