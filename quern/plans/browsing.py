"""Browse, search, sort and facet queries; customers stand in for people, nations for events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import browse as b
from quern.operators.stats import counts
from quern.session import table


def people(spark: SparkSession, d: str) -> DataFrame:
    """Customers in the shape of people: age from the key, a photo for some, notable for one segment."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    c = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    age = F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 90).cast("int"))
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("name"), F.col("n_name").alias("event"), F.col("r_name").alias("province"),
        age.alias("age"), F.when(
            F.col("c_acctbal") > 5000, F.lit("http://x/p.jpg")
        ).alias("photo_url"), (F.col("c_mktsegment") == "BUILDING").alias("notable"), F.col("c_mktsegment").alias("verification"),
    )


PEOPLE = """people AS (
  SELECT c_custkey AS id, c_custkey AS ordinal, c_name AS name, n_name AS event, r_name AS province,
    CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 90)::INT END AS age,
    CASE WHEN c_acctbal > 5000 THEN 'http://x/p.jpg' END AS photo_url, c_mktsegment = 'BUILDING' AS notable, c_mktsegment AS verification
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
RELEVANCE = "(CASE WHEN notable THEN 2 ELSE 0 END + CASE WHEN photo_url IS NOT NULL THEN 1 ELSE 0 END)"


def browse_page(spark, d):
    q = b.BrowseQuery(province="ASIA", photo=True, offset=2, limit=48)
    return b.browse(people(spark, d), None, q).select("id", "name", "event", "age")


def text_search_page(spark, d):
    """The needle spans two of the joined fields."""
    p = people(spark, d).where(b.contains_text("1 nation_1", ("name", "event", "province")))
    return p.orderBy(*b.sort_keys("age_desc")).limit(48).select("id", "name", "event", "age")


def bucket_filter(spark, d):
    p = table(spark, d, "part").withColumn("age", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") * 2))
    cases = [p.where(b.in_bucket(F.col("age"), k)).agg(F.lit(k).alias("bucket"), F.count("*").alias("n"), F.min("age").alias("low"), F.max("age").alias("high")) for k in (*b.BUCKETS, "other")]
    out = cases[0]
    for c in cases[1:]:
        out = out.unionByName(c)
    return out


def multi_field_search(spark, d):
    p = table(spark, d, "part")
    return p.where(b.any_contains("BRAND#1", ("p_name", "p_brand", "p_type"))).select("p_partkey", "p_name", "p_brand", "p_type")


def document_search(spark, d):
    """Substring over whole texts."""
    t = table(spark, d, "documents")
    return t.where(F.contains(F.lower("text"), F.lit("license"))).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def timeline_decade_search(spark, d):
    o = table(spark, d, "orders")
    o = o.select(
        "o_orderkey", F.concat(F.substring(F.year("o_orderdate").cast("string"), 1, 3), F.lit("0")).alias("decade"), "o_orderstatus",
        "o_orderpriority"
    )
    return b.timeline(o, "1990", "URGENT", ("o_orderstatus", "o_orderpriority")).select(
        "o_orderkey", "decade", tx.truncate(F.col("o_orderpriority"), 4).alias("short")
    )


def relevance_sort(spark, d):
    return people(spark, d).orderBy(*b.sort_keys("relevance")).select("id", b.relevance().alias("relevance"))


def date_sort_blank_last(spark, d):
    o = table(spark, d, "orders").withColumn(
        "dg", F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).when(F.col("o_orderkey") % 4 != 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return o.orderBy(F.nullif("dg", F.lit("")).desc_nulls_last(), "o_orderkey").select("o_orderkey", "dg")


def event_order_default(spark, d):
    n = table(spark, d, "nation").select(
        F.col("n_name").alias("event"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey")).cast("int").alias("order")
    )
    p = people(spark, d).join(n, "event", "left").withColumn("place", b.event_order())
    return p.orderBy("place", "id").select("id", "event", "place")


def age_sorts(spark, d):
    up, down = (
        people(spark, d).orderBy(*b.sort_keys(s)).offset(10).limit(30).select("id", "age", F.lit(s).alias("sort")) for s in ("age", "age_desc")
    )
    return up.unionByName(down)


def facet_having_min(spark, d):
    return b.facet(people(spark, d), "event", 5).select(F.col("value"), F.col("n"))


def zero_filled_counts(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return b.dimension_counts(s, table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey")


def ilike_lookup(spark, d):
    return table(spark, d, "part").where(b.lookup("b_and#2", ("p_brand", "p_name"))).orderBy("p_partkey").limit(25).select("p_partkey", "p_brand")


def latest_per_thread(spark, d):
    from quern.operators.moderation import latest

    return latest(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn"), F.desc("text")]).select("conv_id", "turn", "role")


def label_counts(spark, d):
    """Observed values only, in order of the key."""
    return counts(table(spark, d, "documents"), "lang").orderBy("lang")


QUERIES = {
    "browse_facets_sorted_page": (browse_page, f"""WITH {PEOPLE} SELECT id, name, event, age FROM people WHERE province = 'ASIA' AND photo_url IS NOT NULL
      ORDER BY age ASC NULLS LAST, {RELEVANCE} DESC, ordinal LIMIT 48 OFFSET 2"""),
    "text_search_page": (text_search_page, f"""WITH {PEOPLE} SELECT id, name, event, age FROM people WHERE contains(lower(name || ' ' || event || ' '
      || province), '1 nation_1')
      ORDER BY age DESC NULLS LAST, {RELEVANCE} DESC, ordinal LIMIT 48"""),
    "bucket_filter": (bucket_filter, """WITH p AS (SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_size * 2 END AS age FROM part)
      SELECT 'child' AS bucket, count(*) AS n, min(age) AS low, max(age) AS high FROM p WHERE age <= 17
      UNION ALL SELECT 'youth', count(*), min(age), max(age) FROM p WHERE age BETWEEN 18 AND 30
      UNION ALL SELECT 'adult', count(*), min(age), max(age) FROM p WHERE age BETWEEN 31 AND 50
      UNION ALL SELECT 'senior', count(*), min(age), max(age) FROM p WHERE age >= 51
      UNION ALL SELECT 'other', count(*), min(age), max(age) FROM p WHERE age IS NOT NULL"""),
    "multi_field_search": (multi_field_search, """SELECT p_partkey, p_name, p_brand, p_type FROM part
      WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'brand#1')"""),
    "document_search": (
        document_search,
        "SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE contains(lower(text), 'license') GROUP BY source"
    ),
    "timeline_decade_search": (timeline_decade_search, """SELECT o_orderkey, substr(year(o_orderdate)::VARCHAR, 1, 3) || '0' AS decade,
      CASE WHEN length(o_orderpriority) > 4 THEN substr(o_orderpriority, 1, 4) || '…' ELSE o_orderpriority END AS short
      FROM orders WHERE year(o_orderdate) // 10 = 199 AND (contains(o_orderstatus, 'URGENT') OR contains(o_orderpriority, 'URGENT'))"""),
    "relevance_sort": (
        relevance_sort, f"WITH {PEOPLE} SELECT id, {RELEVANCE}::INT AS relevance FROM people ORDER BY relevance DESC, ordinal"
    ),
    "date_sort_blank_last": (date_sort_blank_last, """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 <> 1 THEN
      strftime(o_orderdate, '%Y-%m-%d') END AS dg FROM orders)
      SELECT o_orderkey, dg FROM o ORDER BY nullif(dg, '') DESC NULLS LAST, o_orderkey"""),
    "event_order_default": (event_order_default, f"""WITH {PEOPLE}, e AS (SELECT n_name AS event, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey END AS o FROM nation)
      SELECT id, event, coalesce(nullif(o, 0), 99)::INT AS place FROM people LEFT JOIN e USING (event) ORDER BY place, id"""),
    "age_sorts": (age_sorts, f"""WITH {PEOPLE} SELECT * FROM (SELECT id, age, 'age' AS sort FROM people ORDER BY age ASC NULLS LAST, {RELEVANCE} DESC,
      ordinal LIMIT 30 OFFSET 10)
      UNION ALL SELECT * FROM (SELECT id, age, 'age_desc' AS sort FROM people ORDER BY age DESC NULLS LAST, {RELEVANCE} DESC, ordinal LIMIT 30 OFFSET 10)"""),
    "facet_having_min": (
        facet_having_min, f"WITH {PEOPLE} SELECT trim(event) AS value, count(*) AS n FROM people WHERE event <> '' GROUP BY 1 HAVING count(*) >= 5"
    ),
    "zero_filled_counts": (
        zero_filled_counts,
        """SELECT n_nationkey, n_regionkey AS place, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) ON s_nationkey = n_nationkey GROUP BY ALL"""
    ),
    "ilike_lookup": (
        ilike_lookup, "SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE '%b_and#2%' OR p_name ILIKE '%b_and#2%' ORDER BY p_partkey LIMIT 25"
    ),
    "latest_per_thread": (
        latest_per_thread,
        "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1"
    ),
    "label_counts": (label_counts, "SELECT lang, count(*) AS n FROM documents GROUP BY lang"),
}
