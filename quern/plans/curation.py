"""Queries of dating, classification, resolution and enrichment; orders stand in for records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import calendar as cal
from quern.functions.text import record_id
from quern.operators import classify as cl
from quern.operators import enrich as en
from quern.operators import resolve as r
from quern.operators import stats as st
from quern.plans.resolution import people
from quern.session import table
from quern.sources.stage import stage

c = F.col


def text(v) -> F.Column:
    return F.lit(v).cast("string")


def dated(spark: SparkSession, d: str) -> DataFrame:
    """Orders with dates and stories of five kinds, by their key."""
    o = table(spark, d, "orders")
    k, yy = c("o_orderkey") % 5, F.date_format("o_orderdate", "yy")
    month = F.month("o_orderdate").cast("string")
    dj = F.when(k == 0, F.concat(F.lit("1400/"), month, F.lit("/18"))).when(
        k == 1, F.concat(F.lit("13"), yy, F.lit(" / "), month)
    ).when(k == 2, "1399").otherwise(None)
    dg = F.when(k == 3, F.concat(F.lit("20"), F.date_format("o_orderdate", "yy-MM-dd"))).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    story = F.when(
        k == 4, F.concat(F.lit("در ۵ آبان ۱۳"), F.translate(yy, "0123456789", "۰۱۲۳۴۵۶۷۸۹"), F.lit(" جان باخت"))
    ).when(k == 1, "متولد 5 آبان 1370")
    return o.select(c("o_orderkey").alias("id"), dj.alias("date_jalali"), dg.alias("date_gregorian"), story.alias("story"))


def best_year(spark, d):
    """The Jalali date first, months 10 and on of 1400 as 1404, then the Gregorian one, then the story."""
    x = dated(spark, d).withColumn("told", cal.story_year_v1(c("story")))
    return x.select(
        "id", "told", cal.best_year(c("date_jalali"), c("date_gregorian"), c("told")).alias("y")
    ).select("id", "told", "y.year", "y.source")


def date_texts(spark, d):
    o = table(spark, d, "orders")
    day = F.when(
        c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "'در 13'yy/M/d' بود'")
    ).when(c("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "13yy-MM-dd")).otherwise("نامعلوم")
    return o.select("o_orderkey", day.alias("t")).select("o_orderkey", cal.full_date(c("t")).alias("whole"), cal.month_day_text(c("t")).alias("md"))


def reassign_first_pass(spark, d):
    """Only events with a year of their own move, and only to an event of the year; dervishes to theirs."""
    x = dated(spark, d)
    k = c("id") % 7
    x = x.withColumns({"name": F.lit("n"), "event": F.when(k == 0, "executions").when(k < 4, "green_88").otherwise("khizesh_1404")})
    dervish = (c("id") % 2 == 0) & (c("id") % 5 == 1)
    x = x.withColumn("story", F.when(dervish, F.concat(c("story"), F.lit(" درویش"))).otherwise(c("story")))
    return st.moves(cl.reassign_v1(x)[1], "from", "to", "reason", "confidence")


def repaired_dates(spark, d):
    """A Jalali date in the Gregorian field goes where it belongs and is converted."""
    k, o = c("o_orderkey") % 4, table(spark, d, "orders")
    dj = F.when(k == 0, "2020/01/01").when(k == 1, "1398/01/01").when(k == 2, None).otherwise("9999")
    dg = F.when(k < 3, F.concat(F.lit("1390/"), F.month("o_orderdate").cast("string"), F.lit("-1"))).otherwise("2020-01-01")
    x = o.select(c("o_orderkey").alias("id"), dj.alias("date_jalali"), dg.alias("date_gregorian"))
    return cl.repair_dates(x)[0]


def literal_corrections(spark, d):
    x = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("event"))
    n = table(spark, d, "supplier").select(
        (c("s_suppkey") * 7).alias("id"), F.when(c("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("event")
    )
    after, status = cl.apply_corrections(x, n)
    total = after.groupBy("event").agg(F.count("*").alias("n")).select(F.lit("after").alias("kind"), c("event").alias("value"), "n")
    return total.unionByName(
        status.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("status").alias("kind"), c("status").alias("value"), "n")
    )


def test_rows_dropped(spark, d):
    k = c("c_custkey") % 5
    name = F.when(k == 0, "TEST").when(k == 1, "رکورد تست ۱").when(k == 2, "testing").otherwise(c("c_name"))
    return cl.drop_tests(table(spark, d, "customer").select(c("c_custkey").alias("id"), name.alias("name")))


def junk_records(spark, d):
    k = c("o_orderkey") % 6
    story = F.when(k == 0, "نوشته تام  مورلی").when(k == 1, "هواپیمای فوکر").when(k == 2, None).otherwise("تام و مورلی")
    dj = F.when(k == 3, "1320/01/01").when(k == 4, "1390/01/01").when(k == 5, "??")
    return table(spark, d, "orders").select("o_orderkey", cl.is_junk(story, dj).alias("junk"))


def event_tallies(spark, d):
    """Rows of each event before and after a pass, and of dimensions that lacked rows."""
    o = table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("event"))
    after = o.withColumn("event", F.when(c("id") % 4 == 0, "needs_review").when(c("event") == "5-LOW", None).otherwise(c("event")))
    return st.before_after(o, after, "event")


def missing_dimension_rows(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    new = table(spark, d, "supplier").select(
        (c("s_nationkey") + c("s_suppkey") % 10).alias("n_nationkey"),
        F.concat(F.lit("new"), ((c("s_nationkey") + c("s_suppkey") % 10)).cast("string")).alias("n_name")
    ).distinct()
    return st.add_missing(n, new, "n_nationkey")


def largest_box(spark, d):
    """Each order's line with the largest quantity times number, the first of equal ones."""
    box = F.struct(c("l_quantity").cast("long").alias("w"), c("l_linenumber").cast("long").alias("h"))
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return b.select("l_orderkey", st.largest(c("boxes")).alias("b")).select("l_orderkey", "b.w", "b.h")


def completeness(spark, d):
    p = people(spark, d)
    return p.select("id", F.round(r.completeness_v1(), 6).alias("first"), F.round(r.completeness(), 6).alias("second"))


def prints(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as fingerprints: signs as hashes, labels as content hashes, a face on some."""
    from quern.plans.resolution import bits

    b = bits(spark, d)
    return b.select(
        c("vec_id").alias("id"), F.when(c("vec_id") % 3 == 0, F.concat(F.lit("f"), c("label").cast("string"))).alias("sha1"), c("hex").alias("phash"),
        F.reverse("hex").alias("dhash"), F.when(c("vec_id") % 2 == 0, c("hex")).alias("face_phash")
    )


def visual_levels(spark, d):
    """Neighbours by id, and how alike their images are."""
    p = prints(spark, d)
    j = p.alias("x").join(p.alias("y"), c("y.id") == c("x.id") + 1)
    return j.select(c("x.id").alias("a"), c("y.id").alias("b"), r.visual_level("x", "y").alias("level"))


def visual_candidates(spark, d):
    """Pairs that share a band of image or face, or the content hash."""
    return r.block_pairs(r.visual_keys(prints(spark, d)), r.VISUAL_CAP)


def records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records without stories: name families by customer, cities by nation."""
    o, cu = table(spark, d, "orders"), table(spark, d, "customer")
    t = o.join(cu, c("o_custkey") == c("c_custkey"))
    num, k = (c("o_custkey") + 1000).cast("string"), c("o_orderkey")
    name = F.when(k % 4 == 0, F.concat_ws(" ", F.lit("شهید"), num, F.lit("karimi"))).when(k % 4 == 1, F.concat_ws(" ", num, F.lit("karimi x rad"))).when(k % 4 == 2, F.concat_ws(" ", num, F.lit("karimi"))).otherwise(F.concat_ws(" ", num, F.lit("moradi")))
    known = people(spark, d).drop("name", "story", "city", "date_jalali", "age", "birth_year")
    x = t.select(F.lpad(k.cast("string"), 12, "0").alias("id"), name.alias("name"), F.concat(F.lit("city"), (c("c_nationkey") + 10 * (k % 300)).cast("string")).alias("city"),
                 F.date_format("o_orderdate", "13yy/M/d").alias("date_jalali"), F.when(k % 3 == 0, (k % 40).cast("int")).alias("age"), F.when(k % 2 == 0, (1300 + k % 5).cast("int")).alias("birth_year"), text(None).alias("story"))
    return known.join(x, "id")


def name_candidates(spark, d):
    """Pairs of records that share the first token of the name, or the first word of the city; blocks over 800 are skipped."""
    return r.candidates(records(spark, d))


def files(spark: SparkSession, d: str) -> DataFrame:
    """An image for some records; every fifth customer has one file for all of them."""
    o = table(spark, d, "orders").where("o_orderkey % 5 < 2")
    file = F.when(
        c("o_custkey") % 5 == 0, F.sha1(F.concat(F.lit("c"), c("o_custkey").cast("string")))
    ).otherwise(F.sha1(F.concat(F.lit("o"), c("o_orderkey").cast("string"))))
    return o.select(
        F.lpad(c("o_orderkey").cast("string"), 12, "0").alias("id"), file.alias("sha1"),
        *[text(None).alias(k) for k in ("phash", "dhash", "face_phash")]
    )


def scored_pairs(spark, d):
    """The tiers that need no text similarity: the same image, equal names, name families, each with its context."""
    return r.duplicates(records(spark, d), files(spark, d)).where(~c("reason").startswith("NAME_FUZZY"))


def audit_of_merges(spark, d):
    """What a merge did: who was kept, what changed and from whom, the reasons of each cluster."""
    p = people(spark, d)
    key = p.groupBy("name", "date_jalali").agg(F.min("id").alias("component"))
    clusters = stage(p.join(key, ["name", "date_jalali"]).select(c("id").alias("node"), "component"))
    edges = clusters.where("node != component").select(
        c("component").alias("a"), c("node").alias("b"), F.when(c("node").substr(-1, 1) < "5", "NAME_EQ+ctx").otherwise("STORY+name").alias("reason")
    )
    audit = r.merge(p, clusters, edges)[1].where(F.size("merged_ids") > 0)
    change = lambda k: F.get(F.filter("changes", lambda x: x["field"] == k), F.lit(0))
    return audit.select("kept_id", F.array_join("merged_ids", ";").alias("merged"), F.array_join("reasons", ";").alias("reasons"), change("age")["after"].alias("age"), change("age")["src"].alias("age_src"),
                        change("photo_url")["src"].alias("photo_src"), F.array_join("age_conflicts", ";").alias("age_conflicts"))


def merge_summary(spark, d):
    p = people(spark, d)
    key = p.groupBy("name", "date_jalali").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    after, audit = r.merge(p, p.join(key, ["name", "date_jalali"]).select(c("id").alias("node"), "component"))
    return r.merge_summary(p, after, audit)


def review_list(spark, d):
    """Equal texts as one image; two of the three names are related."""
    k = c("doc_id") % 3
    t = table(spark, d, "documents").select(
        F.lpad(c("doc_id").cast("string"), 12, "0").alias("id"),
        F.when(k == 0, "anna berg").when(k == 1, "anna berg lund").otherwise("otto krause").alias("name"), F.sha1("text").alias("sha1")
    )
    gone = t.where("substr(id, 12) = '7'").select(c("id").alias("removed_id"))
    return r.review(t.select("id", "name"), t.select("id", "sha1"), gone).select("sha1", F.array_join("ids", ";").alias("ids"))


def conservative(spark: SparkSession, d: str):
    p = people(spark, d).withColumns(
        {"ordinal": c("id").cast("long"), "story": text(None), "city": F.when(c("age").isNull(), "Old Town").otherwise(" Town ")}
    )
    return r.conservative_dedup(p)


def conservative_survivors(spark, d):
    """Of records of one name, city and day, neither with a story, the fullest stays and takes what it lacks."""
    return conservative(spark, d)[0].select("id", "age", "photo_url", F.array_join("sources", ";").alias("sources"))


def conservative_audit(spark, d):
    return conservative(spark, d)[1]


def targeted_merges(spark, d):
    """Literal pairs; those with a missing end are skipped."""
    p = people(spark, d)
    pairs = p.where("cast(id as long) % 4 = 1").select(c("id").alias("keep"), F.lpad((c("id").cast("long") + 1).cast("string"), 12, "0").alias("dup"))
    return r.apply_merges(p, pairs)[0].select("id", "age", "story", "photo_url", "notable", F.array_join("sources", ";").alias("sources"))


def enriched(spark, d):
    """Customers filled from pages: names, birth years, dates, links, tags, verified photos; two pages give nothing."""
    cu = table(spark, d, "customer")
    k = c("c_custkey")
    s = lambda v: text(v)
    p = cu.select(k.alias("id"), F.when(k % 3 == 0, "Kept").alias("name_en"), F.when(k % 4 == 0, 1300).alias("birth_year"), s(None).alias("date_gregorian"), F.when(k % 5 == 0, "1390/01/01").alias("date_jalali"),
                  F.array(s("http://old")).alias("memorial_links"), F.array(s("a")).alias("sources"), F.when(k % 6 == 0, "http://p").alias("photo_url"))
    raw = cu.where("c_custkey % 2 = 0").select(k.alias("id"), F.concat(F.lit("t"), (k % 9).cast("string")).alias("title"), F.lit("http://fa").alias("fa_url"), F.when(k % 8 == 0, "http://old").alias("en_url"), F.when(k % 10 != 0, k).alias("pageid"),
                                               c("c_name").alias("label_en"), F.lit("+1990-05-01T00:00:00Z").alias("birth"), F.when(k % 14 == 0, "+2019-11-16T00:00:00Z").otherwise("+2019-00-00T00:00:00Z").alias("death"))
    images = cu.select(k.alias("id"), F.lit("http://img").alias("url"), F.when(k % 2 == 0, "verified").otherwise("resolved").alias("status"))
    out, _ = en.enrich(p, raw, spark.createDataFrame([("t2",), ("t4",)], "title string"), images)
    return out.select(
        "id", "name_en", "birth_year", "date_gregorian", "date_jalali", F.array_join("memorial_links", ";").alias("links"),
        F.array_join("sources", ";").alias("sources"), "photo_url"
    )


def resolved_images(spark, d):
    """Chosen files looked up by name and host: resolved, or to be searched for, with the reason."""
    k = c("page_id")
    p = table(spark, d, "pages").select(k.alias("id"), F.lit("t").alias("title"), F.when(k % 5 == 0, F.concat(F.lit("A b"), k.cast("string"), F.lit(".jpg"))).alias("wd_image"),
                                        F.when(k % 5 == 1, F.concat(F.lit("https://upload.wikimedia.org/wikipedia/fa/1/1a/P%20"), k.cast("string"), F.lit(".png"))).when(k % 5 == 2, F.lit("https://x.org/Protest.png")).when(k % 5 == 3, F.lit("https://x.org/q.png")).alias("fa_image"), text(None).alias("en_image"))
    info = p.where("id % 3 != 0").select(F.when(c("id") % 5 == 0, F.concat(F.lit("A_b"), c("id").cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.lit("P "), c("id").cast("string"), F.lit(".png"))).alias("name"),
                                         F.when(c("id") % 5 == 0, "commons.wikimedia.org").otherwise("fa.wikipedia.org").alias("host"), F.lit("u").alias("url"), F.when(c("id") % 2 == 0, "t").alias("thumb"), F.when(c("id") % 7 == 0, "image/svg+xml").otherwise("image/jpeg").alias("mime"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    chosen = en.choose_image(p, spark.createDataFrame([("none",)], "title string"))
    return en.resolve_images(chosen, info).select("id", "status", "reason", "source", "url", "photo_direct", "width")


def generated_ids(spark, d):
    """Ids of records: a hash of normalised name and event, alike for names that differ in blanks only."""
    x = table(spark, d, "customer")
    spaced = record_id(F.concat(F.lit(" "), F.replace(c("c_name"), F.lit("#"), F.lit("  #")), F.lit(" ")), c("c_mktsegment"))
    return x.select("c_custkey", spaced.alias("id"))


_YY = "strftime(o_orderdate, '%y')"
_MD = "month(o_orderdate)"
_FA = "translate({}, '0123456789', '۰۱۲۳۴۵۶۷۸۹')"
_DATED = f"""x AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, {_MD} AS m, year(o_orderdate)::INT AS gy, ('13' || {_YY})::INT AS y13, ('20' ||
  {_YY})::INT AS y20 FROM orders),
  t AS (SELECT *, CASE WHEN k = 4 AND (y13 BETWEEN 1370 AND 1399) THEN y13 END AS told FROM x),
  b AS (SELECT *, CASE WHEN k = 0 THEN CASE WHEN m >= 10 THEN 1404 ELSE 1400 END WHEN k = 1 AND y13 >= 1370 THEN y13
      WHEN k = 2 AND gy BETWEEN 1990 AND 2030 THEN gy - CASE WHEN m >= 4 THEN 621 ELSE 622 END
      WHEN k = 3 AND y20 BETWEEN 1990 AND 2030 THEN y20 - CASE WHEN m >= 4 THEN 621 ELSE 622 END WHEN k = 4 THEN told END AS year,
    CASE WHEN k = 0 OR (k = 1 AND y13 >= 1370) THEN 'dj' WHEN (k = 2 AND gy BETWEEN 1990 AND 2030) OR (k = 3 AND y20 BETWEEN 1990 AND 2030) THEN 'dg'
      WHEN k = 4 AND told IS NOT NULL THEN 'story' END AS source FROM t)"""
_HEX = """e AS (SELECT vec_id AS id, label, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << (63 -
  i)::INT) ELSE 0 END))::HUGEINT AS v FROM embeddings),
  h AS (SELECT *, lpad(lower(hex(v::UBIGINT)), 16, '0') AS s FROM e), """
_PEOPLE = """p AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, o_orderkey AS ok, substr(c_name, 10) || ' person' AS name, strftime(o_orderdate,
  '13%y/%m/%d') AS dj, strftime(o_orderdate, '%m/%d') AS md,
    CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 80)::INT END AS age, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS story, CASE WHEN
      o_orderkey % 5 = 0 THEN 'http://p' END AS photo_url,
    o_totalprice > 300000 AS notable, o_orderpriority AS src FROM orders JOIN customer ON o_custkey = c_custkey)"""
_V1 = """(1 + 1 + CASE WHEN coalesce(age, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN photo_url IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN notable THEN 0.3 ELSE 0 END)"""
_V2 = """(1 + CASE WHEN story IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN photo_url IS NOT NULL THEN 4 ELSE 0 END + 3 + 2 + CASE WHEN coalesce(age, 0) <> 0 THEN 1 ELSE 0 END + coalesce(length(story), 0) / 100 + 1 + CASE WHEN notable THEN 5 ELSE 0 END)"""
_RECORDS = """q AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, (o_custkey + 1000)::VARCHAR AS num, o_orderkey % 4 AS k, 'city' || (c_nationkey +
  10 * (o_orderkey % 300)) AS city, strftime(o_orderdate, '%m/%d') AS md,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 END AS age, CASE WHEN o_orderkey % 2 = 0 THEN 1300 + o_orderkey % 5 END AS birth, o_custkey,
      o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
  keys AS (SELECT id, 'n' || num AS key FROM q UNION ALL SELECT id, 'c' || city FROM q),
  open AS (SELECT * FROM keys QUALIFY count(*) OVER (PARTITION BY key) BETWEEN 2 AND 800),
  cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM open x JOIN open y USING (key) WHERE x.id < y.id)"""
QUERIES = {
    "best_year": (best_year, f"WITH {_DATED} SELECT id, told, year, source FROM b"),
    "date_texts": (date_texts, f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '13' || {_YY} || '/' || {_MD} || '/' || day(o_orderdate) WHEN 1
      THEN strftime(o_orderdate, '13%y-%m-%d') END AS whole,
      CASE WHEN o_orderkey % 3 = 0 THEN '/' || {_MD} || '/' || day(o_orderdate) END AS md FROM orders"""),
    "reassign_first_pass": (reassign_first_pass, f"""WITH {_DATED}, v AS (SELECT *, CASE WHEN id % 7 < 4 THEN 'green_88' ELSE 'khizesh_1404' END AS
      ev, CASE WHEN id % 7 < 4 THEN 1388 ELSE 1404 END AS own FROM b WHERE id % 7 <> 0),
      m AS (SELECT ev, source, CASE year WHEN 1378 THEN 'kuye_daneshgah_78' WHEN 1388 THEN 'green_88' WHEN 1396 THEN CASE WHEN k = 1 AND id % 2 = 0
        THEN 'darvish_96' ELSE 'dey_96' END WHEN 1397 THEN 'mordad_97'
        WHEN 1398 THEN 'aban_98' WHEN 1400 THEN 'khuzestan_1400' WHEN 1401 THEN 'khizesh_1401' WHEN 1404 THEN 'khizesh_1404' END AS target FROM v WHERE year <> own)
      SELECT ev AS "from", target AS "to", source AS reason, 'medium' AS confidence, count(*) AS n FROM m WHERE target IS NOT NULL AND target <> ev GROUP BY ALL"""),
    "repaired_dates": (repaired_dates, f"""WITH x AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, {_MD} AS m FROM orders)
      SELECT id, CASE WHEN k IN (0, 2) THEN '1390/' || lpad(m::VARCHAR, 2, '0') || '/01' WHEN k = 1 THEN '1398/01/01' ELSE '9999' END AS date_jalali,
        CASE WHEN k IN (0, 2) THEN strftime(DATE '2011-03-21' + (CASE WHEN m <= 7 THEN (m - 1) * 31 ELSE 186 + (m - 7) * 30 END)::INT, '%Y-%m-%d')
          WHEN k = 1 THEN '1390/' || m || '-1' ELSE '2020-01-01' END AS date_gregorian FROM x"""),
    "literal_corrections": (literal_corrections, """WITH f AS (SELECT s_suppkey * 7 AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE
      'MACHINERY' END AS event FROM supplier),
      j AS (SELECT coalesce(f.event, c_mktsegment) AS event FROM customer LEFT JOIN f ON id = c_custkey)
      SELECT 'after' AS kind, event AS value, count(*) AS n FROM j GROUP BY ALL
      UNION ALL SELECT 'status', CASE WHEN c_custkey IS NULL THEN 'NOT FOUND' WHEN c_mktsegment = event THEN 'unchanged' ELSE 'moved' END, count(*)
        FROM f LEFT JOIN customer ON id = c_custkey GROUP BY ALL"""),
    "drop_test_rows": (
        test_rows_dropped,
        "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 2 THEN 'testing' ELSE c_name END AS name FROM customer WHERE c_custkey % 5 > 1"
    ),
    "junk_records": (junk_records, "SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 3) AS junk FROM orders"),
    "event_tallies": (event_tallies, """WITH a AS (SELECT o_orderpriority AS e, CASE WHEN o_orderkey % 4 = 0 THEN 'needs_review' WHEN o_orderpriority
      = '5-LOW' THEN NULL ELSE o_orderpriority END AS f FROM orders),
      k AS (SELECT e AS event FROM a UNION SELECT f FROM a)
      SELECT event, (SELECT count(*) FROM a WHERE e IS NOT DISTINCT FROM event) AS "before", (SELECT count(*) FROM a WHERE f IS NOT DISTINCT FROM
        event) AS "after" FROM k"""),
    "missing_dimension_rows": (missing_dimension_rows, """SELECT n_nationkey, n_name FROM nation UNION ALL
      SELECT * FROM (SELECT DISTINCT s_nationkey + s_suppkey % 10 AS k, 'new' || (s_nationkey + s_suppkey % 10) FROM supplier) WHERE k NOT IN (SELECT
        n_nationkey FROM nation)"""),
    "largest_box": (largest_box, """WITH x AS (SELECT l_orderkey, l_quantity::BIGINT AS w, l_linenumber::BIGINT AS h FROM lineitem)
      SELECT l_orderkey, w, h FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY w * h DESC, w, h) = 1"""),
    "completeness": (
        completeness,
        f"""WITH {_PEOPLE} SELECT id, round({_V1} + CASE WHEN story IS NOT NULL THEN 1 ELSE 0 END + coalesce(length(story), 0) / 200, 6)::DOUBLE AS first, round({_V2}, 6)::DOUBLE AS second FROM p"""
    ),
    "visual_levels": (visual_levels, f"""WITH {_HEX} p AS (SELECT id, CASE WHEN id % 3 = 0 THEN label END AS sha, v, s, reverse(s) AS d, id % 2 = 0 AS face FROM h),
      k AS (SELECT x.id AS a, y.id AS b, x.sha = y.sha AS same, bit_count(xor(x.v, y.v)) AS n, list_sum(list_transform(range(1, 17), lambda i:
        bit_count(xor(('0x' || x.d[i])::BIGINT, ('0x' || y.d[i])::BIGINT)))) AS m, x.face AND y.face AS f
        FROM p x JOIN p y ON y.id = x.id + 1)
      SELECT a, b, CASE WHEN coalesce(same, false) OR n <= 12 OR m <= 12 OR (f AND n <= 18) THEN 2 WHEN f AND n <= 78 THEN 1 ELSE 0 END::INT AS level FROM k"""),
    "visual_candidates": (visual_candidates, f"""WITH {_HEX} k AS (SELECT id, 'p' || s[1:3] AS key FROM h UNION ALL SELECT id, 'q' || s[4:6] FROM h
      UNION ALL SELECT id, 'f' || s[1:3] FROM h WHERE id % 2 = 0 UNION ALL SELECT id, 's' || label FROM h WHERE id % 3 = 0),
      o AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY key) BETWEEN 2 AND 400)
      SELECT DISTINCT x.id AS a, y.id AS b FROM o x JOIN o y USING (key) WHERE x.id < y.id"""),
    "name_candidates": (name_candidates, f"WITH {_RECORDS} SELECT a, b FROM cand"),
    "scored_pairs": (scored_pairs, f"""WITH {_RECORDS},
      w AS (SELECT *, CASE k WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS kind, count(*) OVER (PARTITION BY md) AS dn, count(*) OVER (PARTITION BY city) AS cn,
        CASE WHEN o_orderkey % 5 < 2 THEN CASE WHEN o_custkey % 5 = 0 THEN 'c' || o_custkey ELSE 'o' || o_orderkey END END AS file FROM q),
      f AS (SELECT a, b, x.num = y.num AND x.kind = y.kind AS eq, x.num = y.num AND (x.kind = y.kind OR (x.kind < 3 AND y.kind < 3)) AS sub,
        (x.num = y.num) OR (x.kind < 3 AND y.kind < 3) OR (x.kind = 3 AND y.kind = 3) AS shares, x.city = y.city AS city, coalesce(x.age = y.age AND
          x.age <> 0, false) AS age, coalesce(x.birth = y.birth, false) AS birth,
        x.md = y.md AS md, x.md = y.md AND x.dn <= 25 AS rare, x.city = y.city AND x.cn <= 40 AS rarec, coalesce(x.file = y.file, false) AS img FROM
          cand JOIN w x ON x.id = a JOIN w y ON y.id = b),
      g AS (SELECT a, b, img, CASE WHEN img AND (shares OR birth OR rare OR rarec) THEN 'SAME_IMG+corrob' WHEN eq AND (city OR birth OR img OR md OR
        age) THEN 'NAME_EQ+ctx'
        WHEN sub AND (city OR img OR birth OR rare OR age) THEN 'NAME_SUBSET+ctx' END AS reason FROM f)
      SELECT a, b, reason, CASE reason WHEN 'SAME_IMG+corrob' THEN 0.97 WHEN 'NAME_EQ+ctx' THEN 0.92 ELSE 0.9 END::DOUBLE AS conf, img AS same_file
        FROM g WHERE reason IS NOT NULL"""),
    "merge_audit": (audit_of_merges, f"""WITH {_PEOPLE}, w AS (SELECT *, row_number() OVER g AS rank, min(id) OVER (PARTITION BY name, dj) AS comp,
      count(*) OVER (PARTITION BY name, dj) AS n FROM p WINDOW g AS (PARTITION BY name, dj ORDER BY {_V2} DESC, id))
      SELECT min_by(id, rank) AS kept_id, string_agg(id, ';' ORDER BY id) FILTER (rank > 1) AS merged,
        string_agg(DISTINCT CASE WHEN right(id, 1) < '5' THEN 'NAME_EQ+ctx' ELSE 'STORY+name' END, ';' ORDER BY CASE WHEN right(id, 1) < '5' THEN
          'NAME_EQ+ctx' ELSE 'STORY+name' END) FILTER (id <> comp) AS reasons,
        CASE WHEN coalesce(min(age) FILTER (rank = 1), 0) = 0 THEN (min_by(age, rank) FILTER (coalesce(age, 0) <> 0))::VARCHAR END AS age,
        CASE WHEN coalesce(min(age) FILTER (rank = 1), 0) = 0 THEN min_by(id, rank) FILTER (coalesce(age, 0) <> 0) END AS age_src,
        CASE WHEN min(photo_url) FILTER (rank = 1) IS NULL THEN min_by(id, rank) FILTER (photo_url IS NOT NULL) END AS photo_src,
        coalesce(array_to_string(list_sort(list_filter(list_distinct(list(age::VARCHAR) FILTER (rank > 1 AND coalesce(age, 0) <> 0)), lambda x: x <>
          (min_by(age, rank) FILTER (coalesce(age, 0) <> 0))::VARCHAR)), ';'), '') AS age_conflicts
      FROM w WHERE n > 1 GROUP BY name, dj"""),
    "merge_summary": (merge_summary, f"""WITH {_PEOPLE}, g AS (SELECT count(*) AS n FROM p GROUP BY name, dj)
      SELECT (SELECT count(*) FROM p) AS "before", (SELECT count(*) FROM g) AS "after", (SELECT count(*) FROM g WHERE n > 1) AS clusters, (SELECT
        coalesce(sum(n - 1), 0) FROM g)::BIGINT AS removed"""),
    "review_list": (review_list, """WITH t AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, doc_id % 3 = 2 AS otto, sha1(text) AS sha1 FROM documents
      WHERE doc_id % 10 <> 7)
      SELECT sha1, string_agg(id, ';' ORDER BY id) AS ids FROM t GROUP BY sha1 HAVING bool_or(otto) AND NOT bool_and(otto)"""),
    "conservative_survivors": (conservative_survivors, f"""WITH {_PEOPLE}, w AS (SELECT *, row_number() OVER (PARTITION BY name, md ORDER BY {_V1}
      DESC, ok) AS rank, row_number() OVER (PARTITION BY name, md ORDER BY ok) AS place FROM p)
      SELECT min_by(id, rank) AS id, coalesce(min(age) FILTER (rank = 1 AND age <> 0), min_by(age, place) FILTER (coalesce(age, 0) <> 0), min(age)
        FILTER (rank = 1)) AS age, min(photo_url) AS photo_url,
        string_agg(DISTINCT src, ';' ORDER BY src) AS sources FROM w GROUP BY name, md"""),
    "conservative_audit": (conservative_audit, f"""WITH {_PEOPLE}, w AS (SELECT *, row_number() OVER (PARTITION BY name, md ORDER BY {_V1} DESC, ok) AS rank FROM p),
      k AS (SELECT * FROM w WHERE rank = 1)
      SELECT w.name AS name, k.id AS kept_id, k.src AS kept_event, w.id AS removed_id, w.src AS removed_event FROM w JOIN k USING (name, md) WHERE w.rank > 1"""),
    "targeted_merges": (targeted_merges, f"""WITH {_PEOPLE}, m AS (SELECT k.id AS keep, d.id AS dup FROM p k JOIN p d ON d.ok = k.ok + 1 WHERE k.ok % 4 = 1),
      x AS (SELECT coalesce(keep, id) AS g, CASE WHEN keep IS NULL THEN '' ELSE id END AS rank, p.* FROM p LEFT JOIN m ON dup = id)
      SELECT g AS id, coalesce(min_by(age, rank) FILTER (coalesce(age, 0) <> 0), CASE WHEN count(*) = 1 THEN min(age) END) AS age, min_by(story, rank)
        FILTER (story IS NOT NULL) AS story, min_by(photo_url, rank) FILTER (photo_url IS NOT NULL) AS photo_url,
        bool_or(notable) AS notable, array_to_string(list_filter(list(src ORDER BY rank), lambda v, i: NOT list_contains(list_slice(list(src ORDER BY
          rank), 1, i - 1), v)), ';') AS sources FROM x GROUP BY g"""),
    "enrich": (enriched, """WITH x AS (SELECT c_custkey AS k, c_name, c_custkey % 2 = 0 AND c_custkey % 9 NOT IN (2, 4) AS has FROM customer)
      SELECT k AS id, CASE WHEN k % 3 = 0 THEN 'Kept' WHEN has THEN c_name END AS name_en, CASE WHEN k % 4 = 0 THEN 1300 WHEN has THEN 1369 END::INT
        AS birth_year, CASE WHEN has AND k % 14 = 0 THEN '2019-11-16' END AS date_gregorian,
        CASE WHEN k % 5 = 0 THEN '1390/01/01' WHEN has AND k % 14 = 0 THEN '1398/08/25' END AS date_jalali, CASE WHEN has THEN 'http://old;http://fa'
          ELSE 'http://old' END AS links,
        CASE WHEN NOT has THEN 'a' WHEN k % 10 <> 0 THEN 'a;wikipedia_fa;wikidata' ELSE 'a;wikidata' END AS sources, CASE WHEN k % 6 = 0 THEN
          'http://p' WHEN k % 2 = 0 THEN 'http://img' END AS photo_url FROM x"""),
    "resolve_images": (resolved_images, """WITH x AS (SELECT page_id AS k, page_id % 5 AS g FROM pages),
      d AS (SELECT k, CASE g WHEN 0 THEN 'wikidata_P18' WHEN 1 THEN 'fa_pageimage' WHEN 3 THEN 'fa_pageimage' END AS source,
        CASE g WHEN 0 THEN 'https://commons.wikimedia.org/wiki/Special:FilePath/A_b' || k || '.jpg?width=600' WHEN 1 THEN
          'https://upload.wikimedia.org/wikipedia/fa/1/1a/P%20' || k || '.png' WHEN 3 THEN 'https://x.org/q.png' END AS url,
        CASE WHEN g = 3 THEN 'bad_url' WHEN g < 2 AND k % 3 = 0 THEN 'no_info' WHEN g < 2 AND k % 7 = 0 THEN 'bad_type' END AS reason FROM x)
      SELECT k AS id, CASE WHEN source IS NULL OR reason IS NOT NULL THEN 'need_search' ELSE 'resolved' END AS status, reason, source, url,
        CASE WHEN source IS NOT NULL AND reason IS NULL THEN CASE WHEN k % 2 = 0 THEN 't' ELSE 'u' END END AS photo_direct, CASE WHEN source IS NOT
          NULL AND reason IS NULL THEN 10 END::INT AS width FROM d"""),
    "generated_ids": (
        generated_ids, "SELECT c_custkey, 'jvn_' || substr(sha1(replace(trim(c_name), '#', ' #') || '|' || c_mktsegment), 1, 10) AS id FROM customer"
    ),
}
