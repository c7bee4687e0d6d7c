"""Statistics, joins, moderation, classification and publishing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import schema as S
from quern.functions import empties as em
from quern.operators import enrich as en
from quern.operators import moderation as mod
from quern.operators import stats as st
from quern.session import table
from quern.streaming.ratelimit import rate_limit, running_counts

c = F.col


def status_counts(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.when(c("o_orderkey") % 9 != 0, c("o_orderstatus")))
    a = st.counts(o, "s").select(F.lit("all").alias("kind"), c("s"), "n")
    return a.unionByName(st.counts(o, "s", True).select(F.lit("filled").alias("kind"), c("s"), "n"))


def field_coverage(spark, d):
    e = table(spark, d, "customer").withColumns(
        {
            "z": c("c_custkey") % 3, "b": F.when(c("c_custkey") % 4 == 0, "").otherwise(c("c_name")),
            "l": F.when(c("c_custkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("c_name"))
        }
    )
    return st.coverage(
        e,
        {
            "number": em.empty_number(c("z")), "text": em.empty_text(c("b")), "list": em.empty_list(c("l")),
            "segment": em.empty_text(em.blank_to_null(c("c_mktsegment")))
        }
    )


def top15_groups(spark, d):
    return st.top(table(spark, d, "customer"), "c_nationkey", 15)


def rounded_mean(spark, d):
    return st.ages(table(spark, d, "part"), "p_size")


def dashboard_counts(spark, d):
    e = table(spark, d, "events").agg(*[F.count_if(c("event_type") == t).alias(t) for t in ("click", "view", "error", "purchase")])
    o = table(spark, d, "orders").agg(F.count("*").alias("orders"), F.count_if(c("o_orderstatus") == "O").alias("open_orders"))
    label = table(spark, d, "labels").agg(F.count_if(c("toxic") == 1).alias("toxic"))
    return st.scalars(e=e, o=o, l=label)


def stats_distinct(spark, d):
    return st.distinct_counts(table(spark, d, "events"), users="user_id", kinds="event_type")


def dependent_counts(spark, d):
    cu = table(spark, d, "customer").select("c_custkey")
    deps = {
        "orders": (table(spark, d, "orders"), "o_custkey"), "events": (table(spark, d, "events"), "user_id"),
        "turns": (table(spark, d, "conversations"), "conv_id")
    }
    return st.dependents(cu, "c_custkey", deps)


def semi_accept(spark, d):
    yes, no = mod.accepted(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id"), "doc_id")
    n = lambda x, k: x.groupBy("source").agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "source", "n")
    return n(yes, "accepted").unionByName(n(no, "rejected"))


def upsert_settings(spark, d):
    e = table(spark, d, "events")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(
        F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type")
    )
    return mod.upsert(old, e.where("event_id % 2 = 1").select("user_id", "event_id", "event_type"), "user_id", [F.desc("event_id")])


def settings_gate(spark, d):
    rows = table(spark, d, "region").select("r_regionkey", "r_name")
    s = spark.createDataFrame([("comments", "1"), ("photos", "0")], "key string, value string")
    a = mod.guarded(rows, s, "comments").select(F.lit("on").alias("k"), "r_name")
    b = mod.guarded(rows, s, "photos").select(F.lit("off").alias("k"), "r_name")
    return a.unionByName(b).unionByName(mod.setting(s, "missing", "dflt").select(F.lit("default").alias("k"), c("value").alias("r_name")))


def session_expiry(spark, d):
    """Sessions of 12 hours, valid at the last event."""
    e = table(spark, d, "events")
    s = e.select(c("event_id").alias("token"), c("user_id").alias("admin_id"), (c("ts") + F.make_dt_interval(hours=F.lit(12))).alias("expires_at"))
    a = table(spark, d, "customer").select(c("c_custkey").alias("id"), (c("c_custkey") % 5 != 0).alias("is_active"))
    now = e.agg(F.max("ts").alias("now"))  # one row, joined to the sessions when they are read
    return mod.valid_sessions(s.crossJoin(now), a, c("now")).groupBy("state").agg(F.count("*").alias("n"))


def status_transitions(spark, d):
    rows = table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"))
    li = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.max("l_linenumber").alias("at"))
    cmd = li.withColumn("action", F.when(c("at") >= 6, "delete").when(c("at") >= 4, "approve").when(c("at") == 1, "spam").otherwise("noop"))
    out, _ = mod.set_status(rows, cmd, {"approve": "approved", "spam": "spam"})
    return out.groupBy("status").agg(F.count("*").alias("n"))


def auto_hide(spark, d):
    """Customers as comments, error events as reports."""
    cm = table(spark, d, "customer").select(
        c("c_custkey").alias("id"), F.when(c("c_custkey") % 6 == 0, "spam").otherwise("approved").alias("status"),
        (c("c_custkey") % 2).alias("report_count")
    )
    rp = table(spark, d, "events").where("event_type = 'error'").select(c("user_id").alias("comment_id"))
    return mod.auto_hide(cm, rp, 3)


def report_counts(spark, d):
    return running_counts(table(spark, d, "events").where("event_type = 'error'"), "user_id", 3)


def merge_entities(spark, d):
    pe = table(spark, d, "customer").select(c("c_custkey").alias("id"), "c_name")
    co = table(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("person_id"))
    rp = table(spark, d, "events").select("event_id", c("user_id").alias("person_id"), c("event_type").alias("status"), F.lit("").alias("admin_note"))
    m = pe.where("id % 10 = 3").select((c("id") - 1).alias("keep"), c("id").alias("dup"))
    p2, c2, _, r2 = mod.merge_people(pe, co, co, rp, m)
    p2, deps = mod.delete_people(p2, {"c": c2}, pe.where("id % 10 = 7").select("id"))
    count = lambda x, k: x.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    people_left, comments_left = count(p2, "people"), count(deps["c"], "comments")
    moved = count(deps["c"].where("person_id % 10 = 2"), "at_keepers")
    return people_left.unionByName(comments_left).unionByName(moved).unionByName(count(r2.where("admin_note = 'merged'"), "reports"))


def rate_limit_anchored(spark, d):
    """At most three events a user in a day that starts with the first."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return rate_limit(e, "user_id", "ts", "event_id", 3, 86400).select("event_id", "user_id", "allowed")


def conformance_violations(spark, d):
    rules = {"size_range": c("p_size").between(1, 40), "brand_pattern": c("p_brand").rlike("^Brand#[1-3][0-9]$"), "price": c("p_retailprice") > 1000}
    return S.conformance(table(spark, d, "part"), rules, "p_partkey")


def enrich_fill(spark, d):
    """Quality labels fill texts' empty fields."""
    t = table(spark, d, "documents").select("doc_id", F.when(c("doc_id") % 3 == 0, c("lang")).otherwise("").alias("v"), c("lang"))
    l = table(spark, d, "labels").select("doc_id", c("quality").cast("string").alias("q"))
    return t.join(l, "doc_id", "left").select("doc_id", en.fill(c("v"), c("q")).alias("v"))


def choose_files(spark, d):
    p = table(spark, d, "pages").select(
        c("page_id").alias("id"), F.concat(F.lit("t"), (c("page_id") % 7).cast("string")).alias("title"),
        F.when(
            c("page_id") % 2 == 0, F.concat(F.lit("Rally "), c("page_id").cast("string"), F.lit(".png"))
        ).when(c("page_id") % 5 == 0, "A*b é~.jpg").alias("wd_image"),
        F.when(c("page_id") % 3 == 0, c("url")).alias("fa_image"), F.lit("").alias("en_image")
    )
    bl = spark.createDataFrame([("t3",)], "title string")
    return en.choose_image(p, bl).select("id", "status", "source", "url")


def revert_vs_backup(spark, d):
    from quern.operators.classify import revert

    o = table(spark, d, "orders")
    j = F.concat(F.lit("14"), F.substring(F.date_format("o_orderdate", "yy"), 1, 2), F.lit("/01/01"))
    b = o.select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("event"), j.alias("date_jalali"))
    cur = b.withColumn("event", F.when(c("id") % 2 == 0, "moved").otherwise(c("event")))
    return revert(cur, b, "moved", 1495)[0].groupBy("event").agg(F.count("*").alias("n"))


def reclassify_trust_order(spark, d):
    from quern.operators.classify import reassign

    o = table(spark, d, "orders")
    yy = (F.year("o_orderdate") - 595).cast("string")  # 1992 to 1998 become 1397 to 1403
    k = c("o_orderkey") % 4
    story = F.when(
        c("o_orderkey") % 5 == 0, F.concat(F.lit("در "), F.lit("دی ماه "), yy, F.lit(" جان باخت"))
    ).when(c("o_orderkey") % 5 == 1, F.concat(F.lit("کشته "), yy)).otherwise("")
    p = o.select(
        c("o_orderkey").alias("id"), F.lit("x").alias("name"), F.when(k == 3, "executions").otherwise("green_88").alias("event"),
        F.when(k == 0, F.lit(None)).when(k == 1, F.concat(yy, F.lit("/05/01"))).otherwise(yy).alias("date_jalali"), story.alias("story")
    )
    return reassign(
        p.select("id", "name", "event", "date_jalali", "story")
    )[1].groupBy("from", "to", "reason", "confidence").agg(F.count("*").alias("n"))


_SESS = "(SELECT max(ts) FROM events)"
QUERIES = {
    "status_counts": (status_counts, """WITH o AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS s FROM orders)
      SELECT 'all' AS kind, s, count(*) AS n FROM o GROUP BY s UNION ALL SELECT 'filled', s, count(*) FROM o WHERE s IS NOT NULL AND s <> '' GROUP BY s"""),
    "field_coverage": (field_coverage, """SELECT 'number' AS field, count(*) FILTER (c_custkey % 3 <> 0) AS n FROM customer UNION ALL SELECT 'text',
      count(*) FILTER (c_custkey % 4 <> 0) FROM customer
      UNION ALL SELECT 'list', count(*) FILTER (c_custkey % 5 <> 0) FROM customer UNION ALL SELECT 'segment', count(*) FILTER (trim(c_mktsegment) <>
        '') FROM customer"""),
    "top15_groups": (top15_groups, "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 15"),
    "rounded_mean": (rounded_mean, "SELECT count(*) AS total, count(*) FILTER (p_size < 18) AS under, round(avg(p_size))::BIGINT AS mean FROM part"),
    "dashboard_counts": (dashboard_counts, """SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view,
      count(*) FILTER (event_type = 'error') AS error,
      count(*) FILTER (event_type = 'purchase') AS purchase, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus
        = 'O') AS open_orders,
      (SELECT count(*) FROM labels WHERE toxic = 1) AS toxic FROM events"""),
    "stats_distinct": (stats_distinct, "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events"),
    "dependent_counts": (dependent_counts, """SELECT c_custkey, coalesce(o.n, 0) AS orders, coalesce(e.n, 0) AS events, coalesce(v.n, 0) AS turns FROM customer
      LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON o.k = c_custkey LEFT JOIN (SELECT user_id AS k, count(*) AS n FROM
        events GROUP BY 1) e ON e.k = c_custkey
      LEFT JOIN (SELECT conv_id AS k, count(*) AS n FROM conversations GROUP BY 1) v ON v.k = c_custkey"""),
    "semi_accept": (
        semi_accept,
        """SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'accepted' ELSE 'rejected' END AS kind, source, count(*) AS n FROM documents GROUP BY ALL"""
    ),
    "upsert_settings": (upsert_settings, """WITH o AS (SELECT user_id, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM
      events WHERE event_id % 2 = 0 GROUP BY 1),
      n AS (SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events WHERE event_id % 2 = 1 GROUP BY 1)
      SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)"""),
    "settings_gate": (settings_gate, "SELECT 'on' AS k, r_name FROM region UNION ALL SELECT 'default', 'dflt'"),
    "session_expiry": (session_expiry, f"""SELECT CASE WHEN c_custkey % 5 = 0 THEN 'inactive' WHEN ts + INTERVAL 12 HOUR < {_SESS} THEN 'expired' ELSE
      'ok' END AS state, count(*) AS n
      FROM events JOIN customer ON c_custkey = user_id GROUP BY 1"""),
    "status_transitions": (status_transitions, """WITH a AS (SELECT l_orderkey AS id, max(l_linenumber) AS m FROM lineitem GROUP BY 1)
      SELECT CASE WHEN m >= 4 THEN 'approved' WHEN m = 1 THEN 'spam' ELSE o_orderstatus END AS status, count(*) AS n FROM orders LEFT JOIN a ON id =
        o_orderkey WHERE coalesce(m < 6, true) GROUP BY 1"""),
    "auto_hide": (auto_hide, """WITH r AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
      x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'spam' ELSE 'approved' END AS status, c_custkey % 2 + coalesce(n, 0) AS
        report_count, n FROM customer LEFT JOIN r ON user_id = c_custkey)
      SELECT id, CASE WHEN n IS NOT NULL AND status = 'approved' AND report_count >= 3 THEN 'pending' ELSE status END AS status, report_count::BIGINT
        AS report_count FROM x"""),
    "report_counts": (report_counts, """SELECT user_id, count(*) AS n, count(*) >= 3 AS "over" FROM events WHERE event_type = 'error' GROUP BY 1"""),
    "merge_entities": (merge_entities, """WITH m AS (SELECT c.c_custkey AS dup, c.c_custkey - 1 AS keep FROM customer c WHERE c.c_custkey % 10 = 3 AND
      c.c_custkey - 1 IN (SELECT c_custkey FROM customer)),
      p AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT dup FROM m) AND c_custkey % 10 <> 7),
      o AS (SELECT coalesce(keep, o_custkey) AS person FROM orders LEFT JOIN m ON dup = o_custkey),
      k AS (SELECT person FROM o WHERE person NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 7))
      SELECT 'people' AS kind, count(*) AS n FROM p UNION ALL SELECT 'comments', count(*) FROM k UNION ALL SELECT 'at_keepers', count(*) FROM k WHERE person % 10 = 2
      UNION ALL SELECT 'reports', count(*) FROM events JOIN m ON dup = user_id"""),
    "rate_limit_anchored": (rate_limit_anchored, """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER
      BY ts, event_id) AS i FROM events),
      w AS (SELECT event_id, user_id, i, ts AS start, 1 AS n, true AS allowed FROM e WHERE i = 1
        UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN e.ts >= w.start + INTERVAL 1 DAY THEN e.ts ELSE w.start END,
          CASE WHEN e.ts >= w.start + INTERVAL 1 DAY THEN 1 WHEN w.n < 3 THEN w.n + 1 ELSE w.n END, e.ts >= w.start + INTERVAL 1 DAY OR w.n < 3
        FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
      SELECT event_id, user_id, allowed FROM w"""),
    "conformance_violations": (conformance_violations, """SELECT p_partkey, 'size_range' AS violation FROM part WHERE NOT p_size BETWEEN 1 AND 40
      UNION ALL SELECT p_partkey, 'brand_pattern' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]$') UNION ALL SELECT p_partkey,
        'price' FROM part WHERE NOT p_retailprice > 1000"""),
    "enrich_fill_if_empty": (
        enrich_fill,
        "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE coalesce(quality::VARCHAR, '') END AS v FROM documents LEFT JOIN labels USING (doc_id)"
    ),
    "choose_image": (choose_files, """WITH x AS (SELECT *, page_id % 7 = 3 AS bl, page_id % 2 = 1 AND page_id % 5 = 0 AS wd, page_id % 3 = 0 AS fa FROM pages)
      SELECT page_id AS id, CASE WHEN bl THEN 'blacklist' WHEN wd OR fa THEN 'wiki' ELSE 'need_search' END AS status, CASE WHEN bl THEN NULL WHEN wd
        THEN 'wikidata_P18' WHEN fa THEN 'fa_pageimage' END AS source,
        CASE WHEN bl THEN NULL WHEN wd THEN 'https://commons.wikimedia.org/wiki/Special:FilePath/A%2Ab_%C3%A9~.jpg?width=600' WHEN fa THEN url END AS url FROM x"""),
    "revert_vs_backup": (
        revert_vs_backup,
        """SELECT CASE WHEN o_orderkey % 2 = 0 AND strftime(o_orderdate, '%y') <> '95' THEN 'moved' ELSE o_orderpriority END AS event, count(*) AS n FROM orders GROUP BY 1"""
    ),
    "reclassify_trust_order": (reclassify_trust_order, """WITH o AS (SELECT o_orderkey % 4 AS k, o_orderkey % 5 AS s, (year(o_orderdate) - 595)::INT AS y FROM orders),
      e AS (SELECT * FROM (VALUES (1397, 'mordad_97'), (1398, 'aban_98'), (1400, 'khuzestan_1400'), (1401, 'khizesh_1401'), (1402, 'dey_1402'), (1403,
        'dey_1403'), (1404, 'khizesh_1404')) v(y, event)),
      x AS (SELECT o.*, e.event, CASE WHEN o.y = 1400 AND s = 0 THEN 'khizesh_1401' ELSE e.event END AS told FROM o LEFT JOIN e USING (y) WHERE k <> 3),
      r AS (SELECT CASE WHEN s = 0 AND told IS NOT NULL THEN told WHEN event IS NULL THEN NULL WHEN k = 1 THEN told WHEN k = 2 THEN event WHEN k = 0
        AND s = 1 THEN event END AS "to",
        CASE WHEN s = 0 AND told IS NOT NULL THEN 'story_year=' || y WHEN k = 1 THEN 'date_year=' || y WHEN k = 2 THEN 'date_year_only=' || y ELSE
          'story_year_no_date=' || y END AS reason,
        CASE WHEN s = 0 AND told IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM x)
      SELECT 'green_88' AS "from", "to", reason, confidence, count(*) AS n FROM r WHERE "to" IS NOT NULL GROUP BY ALL"""),
}
