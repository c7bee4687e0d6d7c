"""Moderation queries: commands on tables in, new tables out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import browse as b
from quern.operators import moderation as mod
from quern.plans.browsing import people as browsed
from quern.plans.publishing import long_people
from quern.session import table

c = F.col


def text(v) -> F.Column:
    return F.lit(v).cast("string")


def mirror(spark: SparkSession, d: str) -> DataFrame:
    """Customers as mirror rows; the JSON of some is broken or missing."""
    k = c("c_custkey")
    json = F.when(k % 5 == 0, "broken{").when(k % 5 != 1, F.to_json(F.struct(c("c_name").alias("n"), (k % 90).alias("a"), (k % 2 == 0).alias("nt"))))
    return table(spark, d, "customer").select(
        k.alias("id"), c("c_name").alias("name"), text(None).alias("name_en"), c("c_mktsegment").alias("event"), text("town").alias("city"),
        text(None).alias("photo_url"), (k % 2 == 0).alias("notable"), json.alias("data_json")
    )


def sparse_edits(spark, d):
    """Patches of one or two keys: JSON and column change together; a bad address or an empty name refuses the whole patch."""
    p, k = mirror(spark, d), c("id") % 6
    one = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    fields = F.when(k == 0, one("n", "  New ", "a", "44 years")).when(k == 1, one("n", " x")).when(k == 2, one("ph", "ftp://x")).when(k == 3, one("ph", "http://x/y", "c", "  ")).when(k == 4, one("a", "500", "oc", "smith"))
    patches = p.where("id % 3 != 2 OR id % 2 = 0").select("id", fields.alias("fields"), F.when(k == 4, True).alias("notable")).unionByName(
        spark.createDataFrame([(-1, None, True)], "id long, fields map<string,string>, notable boolean")
    )
    out, refused = mod.edit_people(p, patches)
    return out.select("id", "name", "city", "photo_url", "notable", "data_json").unionByName(
        refused.select("id", c("why").alias("name")), allowMissingColumns=True
    )


def json_overlay(spark, d):
    """The JSON's value where it has one, else the column's."""
    return mod.overlay(
        mirror(spark, d).withColumn("name", F.concat(F.lit("column "), c("name"))), "data_json", {"name": "n", "event": "e"}
    ).select("id", "name", "event")


def notable_commands(spark, d):
    """Commands set the value they give, so a second time changes nothing."""
    p = mirror(spark, d)
    commands = p.where("id % 3 = 0").select("id", (c("id") % 4 == 0).alias("notable"))
    return mod.set_notable(mod.set_notable(p, commands), commands).select("id", "notable", "data_json")


def photos_approved(spark, d):
    """Pending suggestions with a valid address and a known person set column and JSON."""
    p = mirror(spark, d)
    k = c("o_orderkey")
    photos = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 5 == 0, -c("o_custkey")).otherwise(c("o_custkey")).alias("person_id"),
        F.concat(F.when(k % 3 == 0, "ftp").otherwise("http"), F.lit("://x/"), k.cast("string")).alias("photo_url"),
        F.when(k % 7 == 0, "approved").otherwise("pending").alias("status")
    )
    people, after, refused = mod.approve_photos(p, photos, photos.where("id % 2 = 0").select("id"))
    n = lambda x, kind, key: x.groupBy(c(key).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    set_ = people.where("photo_url IS NOT NULL").select(
        F.lit("set").alias("kind"), F.concat(c("photo_url"), F.lit(" "), F.get_json_object("data_json", "$.ph")).alias("value"), c("id").alias("n")
    )
    return set_.unionByName(n(after, "status", "status")).unionByName(n(refused, "refused", "why"))


def submissions_approved(spark, d):
    """Pending submissions become reported people, their columns kept as JSON with where they are from."""
    k = c("s_suppkey")
    s = table(spark, d, "supplier").select(
        k.alias("id"), c("s_name").alias("name"), F.lit("e").alias("event"), text(None).alias("city"), (k % 80).cast("int").alias("age"),
        text(None).alias("photo_url"), F.when(k % 4 == 0, "rejected").otherwise("pending").alias("status"), text(None).alias("approved_person_id")
    )
    p = mirror(spark, d).withColumn("id", c("id").cast("string")).limit(0)
    people, after = mod.approve_submissions(s, p, s.where("id % 2 = 0").select("id"))
    return people.join(
        after.select(c("approved_person_id").alias("id"), c("id").alias("submission"), "status"), "id"
    ).select("submission", "status", "name", "notable", "data_json")


def guarded_input(spark, d):
    """Cleaned comments and reports with the reason of a refusal, and the status that each mode gives."""
    v = table(spark, d, "conversations").select(c("conv_id").cast("string").alias("person_id"), (c("turn") % 4).alias("k"), "turn")
    body = F.when(c("k") == 0, " x ").when(c("k") == 1, "  hello ").when(c("k") == 2, None).otherwise("a\u0000b")
    m = mod.guard_comments(v.withColumns({"body": body, "author_name": F.when(c("k") == 1, " me ")})).select(
        "person_id", "turn", "body", "author_name", "why",
        mod.new_comment_status(F.when(c("k") == 1, "pre_approve").otherwise("auto")).alias("status")
    )
    kind = F.when(c("k") == 0, " ").when(c("k") == 1, "duplicate").when(c("k") == 2, "spam").otherwise("other")
    r = mod.guard_reports(v.withColumns({"report_type": kind, "duplicate_of": F.lit(" ")})).select(
        "person_id", "turn", c("report_type").alias("body"), c("duplicate_of").alias("author_name"), "why", F.lit("report").alias("status")
    )
    return m.unionByName(r)


def audit_rows(spark, d):
    v = table(spark, d, "conversations").select(
        F.lit(1).alias("admin_id"), c("role").alias("action"), F.lit("comment").alias("entity_type"), c("conv_id").alias("entity_id"),
        F.repeat("text", 30).alias("detail"), c("turn").alias("created_at")
    )
    return mod.audit(v).select("action", "entity_id", "created_at", F.md5("detail").alias("detail"))


def comments(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 4 == 0, -k).otherwise(c("o_custkey")).alias("person_id"),
        F.when(k % 3 == 0, "pending").when(k % 3 == 1, "approved").otherwise("rejected").alias("status"), (k % 5).alias("report_count")
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    k = c("l_orderkey")
    return table(spark, d, "lineitem").select(
        (k * 10 + c("l_linenumber")).alias("id"), c("l_suppkey").alias("person_id"), c("l_partkey").alias("duplicate_of"),
        F.when(c("l_linenumber") % 2 == 0, "open").otherwise("resolved").alias("status"),
        F.when(k % 2 == 0, "duplicate").otherwise("other").alias("report_type")
    )


def named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"))


def comment_queues(spark, d):
    """The default queue, all statuses, and reported comments whatever was asked."""
    x, p = comments(spark, d), named(spark, d)
    order = [F.desc("report_count"), F.desc("id")]
    q = lambda name, **k: mod.queue(x, p, order=order, **k).select(F.lit(name).alias("queue"), "id", "person_name")
    return q("default").unionByName(q("all", status="all")).unionByName(q("reported", status="approved", reported=True))


def report_queues(spark, d):
    """Open reports of one kind, with the names of both people."""
    x, p = reports(spark, d), named(spark, d)
    q = lambda name, **k: mod.queue(x, p, default="open", **k).select(F.lit(name).alias("queue"), "id", "person_name", "duplicate_name")
    return q("open").unionByName(q("duplicates", kind="duplicate")).unionByName(q("resolved", status="resolved"))


def dashboard(spark, d):
    photos = comments(spark, d).select("id", F.when(c("report_count") > 2, "pending").otherwise("approved").alias("status"))
    return mod.dashboard(comments(spark, d), reports(spark, d), photos, photos.where("id % 2 = 0"), named(spark, d))


def mirror_batch(spark, d):
    """A batch replaces rows of its ids whole: the JSON it does not have is null."""
    p = long_people(spark, d)
    m = p.select(
        "id", "name", "name_en", "event", "city", "photo_url", "slug", c("notable").cast("int").alias("notable"), F.lit("{}").alias("data_json")
    )
    batch = p.where("age % 2 = 0").withColumn("name", F.when(c("age") % 4 == 0, None).otherwise(F.concat(c("name"), F.lit("!"))))
    return mod.replace_mirror(m, batch)


def settled_reports(spark, d):
    """Status commands on reports: the last one counts; commands without a row are given back."""
    r = reports(spark, d)
    k = c("id") % 4
    cmd = r.select(
        "id", F.when(k == 0, "resolve").when(k == 1, "dismiss").otherwise("none").alias("action"), F.lit(1).alias("at")
    ).unionByName(r.where("id % 8 = 0").select("id", F.lit("dismiss").alias("action"), F.lit(2).alias("at")))
    out, lost = mod.set_status(
        r, cmd.unionByName(r.where("id % 9 = 0").select((-c("id")).alias("id"), F.lit("resolve").alias("action"), F.lit(1).alias("at"))),
        {"resolve": "resolved", "dismiss": "dismissed"}
    )
    return out.groupBy("status").agg(F.count("*").alias("n")).unionByName(lost.agg(F.lit("not found").alias("status"), F.count("*").alias("n")))


def province_facet(spark, d):
    """Short values with a letter of the Arabic block only, five rows or more."""
    k = c("c_custkey")
    v = F.when(k % 4 == 0, " تهران ").when(k % 4 == 1, "Tehran").when(k % 4 == 2, F.repeat(F.lit("فارس"), 10)).otherwise(
        F.concat(F.lit("شهر "), (k % 300).cast("string"))
    )
    return b.facet(table(spark, d, "customer").select(v.alias("province")), "province", 5, letters=True).select("value", "n")


def dimension_facet(spark, d):
    """Values of the dimension in its order, those without rows hidden."""
    s = table(spark, d, "supplier").where("s_nationkey % 3 = 0").select(c("s_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.when(c("n_nationkey") % 2 == 0, c("n_regionkey")).alias("n_regionkey"))
    return b.dimension_counts(s, n, "n_nationkey", "n_regionkey", hide_zero=True)


def sorted_pages(spark, d):
    """Pages by date and by name in both directions, with the place of each row."""
    p = browsed(spark, d).withColumn(
        "date_gregorian",
        F.when(c("id") % 3 == 0, "").when(c("id") % 3 == 1, F.concat(F.lit("20"), F.lpad((c("id") % 90).cast("string"), 2, "0"), F.lit("-01-01")))
    )
    out = None
    for s in ("date", "date_asc", "name", "name_desc"):
        page = b.browse(p, None, b.BrowseQuery(sort=s, offset=40, limit=48)).select(F.lit(s).alias("sort"), "id", "name", "date_gregorian")
        out = page if out is None else out.unionByName(page)
    return out


def all_facets(spark, d):
    """Every facet at once, with the search, and how many there are."""
    p = browsed(spark, d).withColumn("gender", F.when(c("id") % 3 == 0, "w").otherwise("m"))
    q = b.BrowseQuery(verification="BUILDING", gender="m", province="ASIA", age="adult", photo=True, notable=True, text=" CUSTOMER#0 ", sort="age_desc")
    one = b.BrowseQuery(event="NATION_8", age="unknown", limit=30)
    found = lambda q: b.filtered(p, q)
    total = lambda name, q: found(q).agg(F.lit(name).alias("part"), F.count("*").alias("id"), F.max("age").alias("age"))
    fields = ("name", "event", "province")
    page = p.where(b.contains_text(q.text, fields)).transform(lambda x: b.filtered(x, replace(q, text=""))).orderBy(*b.sort_keys(q.sort))
    page = page.select(F.lit("page").alias("part"), "id", "age")
    return page.unionByName(total("all", replace(q, text=""))).unionByName(total("event", one))


def labelled_page(spark, d):
    """People whose event the dimension lacks show its key; notable ones only."""
    e = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(
        c("n_name").alias("event"), F.concat(F.lit("Title "), c("n_nationkey").cast("string")).alias("title"),
        F.when(c("n_regionkey") > 0, c("n_regionkey").cast("int")).alias("order")
    )
    return b.browse(browsed(spark, d), e, b.BrowseQuery(notable=True, sort="event", limit=200)).select("id", "label")


_MIRROR = """m AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS event, c_custkey % 2 = 0 AS nt, c_custkey % 5 AS j FROM customer)"""
_JSON = """CASE WHEN j = 0 THEN 'broken{{' WHEN j = 1 THEN NULL ELSE '{{"n":"' || name || '","a":' || id % 90 || ',"nt":' || nt::VARCHAR || '}}' END"""
_COMMENTS = """k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN -o_orderkey ELSE o_custkey END AS person, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, o_orderkey % 5 AS rc FROM orders)"""
_REPORTS = """r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS person, l_partkey AS dup, CASE WHEN l_linenumber % 2 = 0 THEN 'open' ELSE 'resolved' END AS status, CASE WHEN l_orderkey % 2 = 0 THEN 'duplicate' ELSE 'other' END AS kind FROM lineitem)"""
_FA = "translate({}, '0123456789', '۰۱۲۳۴۵۶۷۸۹')"
_BROWSED = """p AS (SELECT c_custkey AS id, c_name AS name, n_name AS event, (CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN
  c_acctbal > 5000 THEN 1 ELSE 0 END) AS rel, c_mktsegment = 'BUILDING' AS notable,
    CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '20' || lpad((c_custkey % 90)::VARCHAR, 2, '0') || '-01-01' END AS dg FROM customer JOIN nation ON
      c_nationkey = n_nationkey)"""
QUERIES = {
    "sparse_edits": (sparse_edits, f"""WITH {_MIRROR}, x AS (SELECT *, id % 6 AS k, {_JSON.format()} AS json, CASE WHEN j > 1 THEN '"n":"' || name ||
      '","a":' || id % 90 || ',"nt":' || nt::VARCHAR ELSE '' END AS body, j > 1 AS ok, id % 6 <> 5 AS sent FROM m)
      SELECT id, CASE WHEN k = 0 THEN 'New' ELSE name END AS name, CASE WHEN k = 3 THEN NULL ELSE 'town' END AS city, CASE WHEN k = 3 THEN
        'http://x/y' END AS photo_url, CASE WHEN k = 4 THEN true ELSE nt END AS notable,
        CASE k WHEN 0 THEN CASE WHEN ok THEN '{{"n":"New","a":44,"nt":' || nt::VARCHAR || '}}' ELSE '{{"n":"New","a":44}}' END WHEN 3 THEN '{{' ||
          CASE WHEN ok THEN '"n":"' || name || '","a":' || id % 90 || ',"nt":' || nt::VARCHAR || ',' ELSE '' END || '"c":null,"ph":"http://x/y"}}'
          WHEN 4 THEN CASE WHEN ok THEN '{{"n":"' || name || '","a":null,"nt":true,"oc":"smith"}}' ELSE '{{"a":null,"oc":"smith","nt":true}}' END ELSE
            json END AS data_json FROM x
      UNION ALL SELECT id, CASE k WHEN 1 THEN 'no_name' ELSE 'bad_url' END, NULL, NULL, NULL, NULL FROM x WHERE k IN (1, 2) UNION ALL SELECT -1,
        'no_person', NULL, NULL, NULL, NULL"""),
    "json_overlay": (json_overlay, f"WITH {_MIRROR} SELECT id, CASE WHEN j > 1 THEN name ELSE 'column ' || name END AS name, event FROM m"),
    "notable_commands": (notable_commands, f"""WITH {_MIRROR}, x AS (SELECT *, id % 3 = 0 AS told, CASE WHEN id % 3 = 0 THEN id % 4 = 0 ELSE nt END AS new FROM m)
      SELECT id, new AS notable, CASE WHEN NOT told THEN {_JSON.format()} WHEN j > 1 THEN '{{"n":"' || name || '","a":' || id % 90 || ',"nt":' ||
        new::VARCHAR || '}}' ELSE '{{"nt":' || new::VARCHAR || '}}' END AS data_json FROM x"""),
    "photos_approved": (photos_approved, """WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS
      person, CASE WHEN o_orderkey % 3 = 0 THEN 'ftp' ELSE 'http' END || '://x/' || o_orderkey AS url, o_orderkey % 7 = 0 AS done FROM orders),
      a AS (SELECT *, CASE WHEN done THEN 'not_pending' WHEN id % 3 = 0 THEN 'bad_url' WHEN person < 0 THEN 'no_person' END AS why FROM f WHERE id % 2 = 0)
      SELECT 'set' AS kind, max_by(url, id) || ' ' || max_by(url, id) AS value, person AS n FROM a WHERE why IS NULL GROUP BY person
      UNION ALL SELECT 'refused', why, count(*) FROM a WHERE why IS NOT NULL GROUP BY why
      UNION ALL SELECT 'status', CASE WHEN done OR id IN (SELECT id FROM a WHERE why IS NULL) THEN 'approved' ELSE 'pending' END, count(*) FROM f GROUP BY 2"""),
    "submissions_approved": (submissions_approved, """SELECT s_suppkey AS submission, 'approved' AS status, s_name AS name, false AS notable,
      '{"n":"' || s_name || '","ne":null,"a":' || s_suppkey % 80 ||
        ',"g":null,"e":"e","c":null,"pr":null,"dj":null,"ca":null,"oc":null,"s":null,"ph":null,"src_text":null,"v":"reported","_source":"community_submission","_submission_id":'
        || s_suppkey || '}' AS data_json
      FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0"""),
    "guarded_input": (guarded_input, """WITH v AS (SELECT conv_id::VARCHAR AS person_id, turn, turn % 4 AS k FROM conversations)
      SELECT person_id, turn, CASE k WHEN 0 THEN 'x' WHEN 1 THEN 'hello' WHEN 2 THEN '' ELSE 'ab' END AS body, CASE WHEN k = 1 THEN 'me' ELSE 'ناشناس'
        END AS author_name, CASE WHEN k IN (0, 2) THEN 'short' END AS why,
        CASE WHEN k = 1 THEN 'pending' ELSE 'approved' END AS status FROM v
      UNION ALL SELECT person_id, turn, CASE k WHEN 1 THEN 'duplicate' WHEN 2 THEN 'spam' ELSE 'other' END, NULL, CASE WHEN k = 2 THEN 'bad_type' END,
        'report' FROM v"""),
    "audit_rows": (
        audit_rows,
        "SELECT role AS action, conv_id::VARCHAR AS entity_id, turn AS created_at, md5(substr(repeat(text, 30), 1, 2000)) AS detail FROM conversations"
    ),
    "comment_queues": (comment_queues, f"""WITH {_COMMENTS}, n AS (SELECT k.*, c_name FROM k LEFT JOIN customer ON c_custkey = person)
      SELECT * FROM (SELECT 'default' AS queue, id, c_name AS person_name FROM n WHERE status = 'pending' ORDER BY rc DESC, id DESC LIMIT 300)
      UNION ALL SELECT * FROM (SELECT 'all', id, c_name FROM n ORDER BY rc DESC, id DESC LIMIT 300) UNION ALL SELECT * FROM (SELECT 'reported', id,
        c_name FROM n WHERE rc > 0 ORDER BY rc DESC, id DESC LIMIT 300)"""),
    "report_queues": (report_queues, f"""WITH {_REPORTS}, n AS (SELECT r.*, a.c_name AS person_name, z.c_name AS duplicate_name FROM r LEFT JOIN
      customer a ON a.c_custkey = person LEFT JOIN customer z ON z.c_custkey = dup)
      SELECT * FROM (SELECT 'open' AS queue, id, person_name, duplicate_name FROM n WHERE status = 'open' ORDER BY id DESC LIMIT 300)
      UNION ALL SELECT * FROM (SELECT 'duplicates', id, person_name, duplicate_name FROM n WHERE status = 'open' AND kind = 'duplicate' ORDER BY id DESC LIMIT 300)
      UNION ALL SELECT * FROM (SELECT 'resolved', id, person_name, duplicate_name FROM n WHERE status = 'resolved' ORDER BY id DESC LIMIT 300)"""),
    "dashboard": (dashboard, f"""WITH {_COMMENTS}, {_REPORTS} SELECT (SELECT count(*) FROM k WHERE status = 'pending') AS comments_pending, (SELECT
      count(*) FROM k WHERE status = 'approved') AS comments_approved,
      (SELECT count(*) FROM k WHERE rc > 0 AND status <> 'rejected') AS comments_reported, (SELECT count(*) FROM r WHERE status = 'open') AS
        reports_open, (SELECT count(*) FROM r WHERE status = 'open' AND kind = 'duplicate') AS reports_duplicate,
      (SELECT count(*) FROM k WHERE rc > 2) AS photos_pending, (SELECT count(*) FROM k WHERE rc > 2 AND id % 2 = 0) AS submissions_pending, (SELECT
        count(*) FROM customer) AS people_total"""),
    "mirror_batch": (mirror_batch, """WITH l AS (SELECT 'jvn_' || lpad(lower(hex(c_custkey)), 10, '0') AS id, c_name AS name, CASE WHEN c_custkey % 3
      = 0 THEN '' ELSE c_name END AS ne, CASE WHEN c_custkey % 11 = 0 THEN 'gone' ELSE 'e' || c_nationkey END AS event,
        CASE WHEN c_custkey % 6 = 0 THEN 'a "b", c' ELSE 'town' END AS city, CASE WHEN c_custkey % 9 = 0 THEN 'http://p' END AS photo_url, CASE WHEN
          c_custkey % 4 = 0 THEN 's' || c_custkey END AS slug, (c_mktsegment = 'BUILDING')::INT AS notable,
        CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 90 END AS age FROM customer)
      SELECT id, CASE WHEN age % 4 = 0 THEN '' WHEN age % 2 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN age % 2 = 0 THEN nullif(ne, '') ELSE
        ne END AS name_en, event, city, photo_url, slug, notable, CASE WHEN coalesce(age % 2 = 0, false) THEN NULL ELSE '{}' END AS data_json FROM
        l"""),
    "settled_reports": (settled_reports, f"""WITH {_REPORTS} SELECT CASE WHEN id % 8 = 0 OR id % 4 = 1 THEN 'dismissed' WHEN id % 4 = 0 THEN
      'resolved' ELSE status END AS status, count(*) AS n FROM r GROUP BY 1
      UNION ALL SELECT 'not found', count(*) FROM r WHERE id % 9 = 0"""),
    "province_facet": (
        province_facet,
        """WITH x AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'تهران' WHEN 3 THEN 'شهر ' || c_custkey % 300 END AS value FROM customer) SELECT value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 5"""
    ),
    "dimension_facet": (
        dimension_facet,
        "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS place, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_nationkey % 3 = 0 GROUP BY ALL"
    ),
    "sorted_pages": (sorted_pages, f"""WITH {_BROWSED}
      SELECT * FROM (SELECT 'date' AS sort, id, name, dg AS date_gregorian FROM p ORDER BY nullif(dg, '') DESC NULLS LAST, rel DESC, id LIMIT 48 OFFSET 40)
      UNION ALL SELECT * FROM (SELECT 'date_asc', id, name, dg FROM p ORDER BY nullif(dg, '') NULLS LAST, rel DESC, id LIMIT 48 OFFSET 40)
      UNION ALL SELECT * FROM (SELECT 'name', id, name, dg FROM p ORDER BY name, rel DESC, id LIMIT 48 OFFSET 40) UNION ALL SELECT * FROM (SELECT
        'name_desc', id, name, dg FROM p ORDER BY name DESC, rel DESC, id LIMIT 48 OFFSET 40)"""),
    "all_facets": (all_facets, """WITH p AS (SELECT c_custkey AS id, upper(n_name) AS nn, n_name, r_name, c_mktsegment AS seg, c_acctbal > 5000 AS photo, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 90 END::INT AS age
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      f AS (SELECT * FROM p WHERE seg = 'BUILDING' AND id % 3 <> 0 AND r_name = 'ASIA' AND age BETWEEN 31 AND 50 AND photo)
      SELECT 'page' AS part, id, age FROM f UNION ALL SELECT 'all', count(*), max(age) FROM f UNION ALL SELECT 'event', count(*), max(age) FROM p WHERE n_name = 'NATION_8' AND age IS NOT NULL"""),
    "labelled_page": (labelled_page, f"""WITH {_BROWSED}, e AS (SELECT n_name AS event, 'Title ' || n_nationkey AS title, n_regionkey AS o FROM nation
      WHERE n_nationkey % 2 = 0)
      SELECT id, coalesce(title, event) AS label FROM p LEFT JOIN e USING (event) WHERE notable ORDER BY coalesce(nullif(o, 0), 99), rel DESC, id LIMIT 200"""),
}
