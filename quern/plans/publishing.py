"""Queries of scans, landed data and published forms; customers and orders stand in for records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schema as S
from quern.functions import text as tx
from quern.operators import browse as b
from quern.session import table
from quern.sources import archive, publish
from quern.sources.stage import shared_dir
from quern.streaming.resume import append_new

c = F.col


def scratch_path(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"


def long_people(spark: SparkSession, d: str) -> DataFrame:
    """Customers as long records, some fields empty; their nations are their events, and one in eleven has none that is known."""
    cu = table(spark, d, "customer")
    k, s = c("c_custkey"), lambda v: F.lit(v).cast("string")
    value = {
        "id": F.concat(F.lit("jvn_"), F.lpad(F.lower(F.hex(k)), 10, "0")), "slug": F.when(
            k % 4 == 0, F.concat(F.lit("s"), k.cast("string"))
        ), "name": c("c_name"), "name_en": F.when(k % 3 == 0, "").otherwise(c("c_name")),
        "event": F.when(k % 11 == 0, "gone").otherwise(
            F.concat(F.lit("e"), c("c_nationkey").cast("string"))
        ), "gender": F.when(k % 5 == 0, None).when(k % 2 == 0, "w").otherwise("m"), "age": F.when(k % 7 != 0, (k % 90).cast("int")),
        "birth_year": s(None).cast("int"), "date_jalali": s(None), "date_gregorian": s(None), "city": F.when(k % 6 == 0, 'a "b", c').otherwise("town"), "province": s(None), "cause": s(None), "occupation": s(None), "story": F.when(k % 2 == 0, "told"),
        "story_en": F.when(k % 8 == 0, "told").when(k % 8 == 2, "said"), "photo_url": F.when(k % 9 == 0, "http://p"), "memorial_links": F.array(F.lit("https://www.x.com/a")), "notable": c("c_mktsegment") == "BUILDING",
        "verification": F.when(k % 2 == 0, "documented").otherwise("reported"), "flagged_review": s(None), "sources": F.array(F.lit("s1"), c("c_mktsegment")),
    }
    return cu.select([value[n].alias(n) for n in S.LONG])


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.concat(F.lit("e"), c("n_nationkey").cast("string")).alias("event"), c("n_name").alias("title"),
        (c("n_regionkey")).cast("int").alias("order")
    )


def meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("version", "1.0.0")], "key string, value string")


def archive_scan(spark, d):
    """A short-form archive document written from the tables and scanned back as long records with their ordinal."""
    cu = table(spark, d, "customer").where("c_custkey <= 500")  # an archive is one document
    k = c("c_custkey")
    person = F.struct(
        k.cast("string").alias("id"), c("c_name").alias("n"), F.lit("e1").alias("e"), F.when(k % 2 == 0, 1).when(k % 3 == 0, 0).alias("nt"),
        F.when(k % 5 == 0, k).alias("a"), F.when(k % 4 == 0, F.array(c("c_mktsegment"))).alias("src")
    )
    doc = cu.agg(
        F.to_json(
            F.struct(
                F.create_map(F.lit("version"), F.lit("1")).alias("meta"),
                F.create_map(F.lit("e1"), F.struct(F.lit("t").alias("title"), F.lit(3).alias("order"))).alias("events"),
                F.sort_array(F.collect_list(F.struct(k, person.alias("p"))))["p"].alias("people")
            )
        ).alias("value")
    )
    path = scratch_path(spark)
    doc.write.text(path)
    p, _, _ = archive.read_archive(spark, path)
    return p.select("ordinal", "id", "name", "notable", "age", F.size("memorial_links").alias("links"), F.array_join("sources", ";").alias("sources"))


def flags_carried(spark, d):
    """Flags of an earlier long file go to records that have none; a missing file gives none."""
    p = long_people(spark, d)
    flagged = p.withColumn("flagged_review", F.when(c("age") % 3 == 0, F.concat(F.lit("old "), c("name"))).when(c("age") % 3 == 1, ""))
    path = scratch_path(spark)
    publish.write_json(flagged, path)
    flags = archive.read_flags(spark, path).unionByName(archive.read_flags(spark, path + "-none"))
    own = p.withColumn("flagged_review", F.when(c("age") % 2 == 0, "new"))
    return archive.carry_flags(own, flags).select("id", "flagged_review")


def last_fingerprints(spark, d):
    """Each id's last good fingerprint in the order of the file."""
    e = table(spark, d, "embeddings").orderBy("vec_id").coalesce(1)
    rec = e.select(
        c("vec_id").cast("string").alias("url"), (c("vec_id") % 3 != 0).alias("ok"), F.sha1(c("vec_id").cast("string")).alias("sha1"),
        F.array(F.concat(F.lit("p"), (c("vec_id") % 100).cast("string")), F.concat(F.lit("q"), c("label").cast("string"))).alias("ids")
    )
    path = scratch_path(spark)
    rec.write.json(path)
    return archive.read_fingerprints(spark, path).select("id", "sha1")


def urls_of_records(spark, d):
    p = long_people(spark, d).withColumn(
        "photo_url", F.when(c("age") % 4 == 0, F.concat(F.lit(" http://p/"), (c("age") % 8).cast("string"), F.lit(" "))).when(c("age") % 4 == 1, "  ")
    )
    return archive.urls_to_ids(p).select("url", F.md5(F.array_join("ids", ";")).alias("ids"), F.size("ids").alias("n"))


def page_details(spark, d):
    """Page records of an encyclopedia's answers; a page that is missing gives nulls."""
    k = c("page_id")
    page = F.struct(
        k.alias("pageid"), F.concat(F.lit("T "), k.cast("string")).alias("title"),
        F.struct(F.concat(F.lit("Q"), k.cast("string")).alias("wikibase_item")).alias("pageprops"),
        F.when(k % 2 == 0, F.struct(c("url").alias("source"))).alias("original"), c("url").alias("fullurl")
    )
    answer = F.to_json(F.struct(F.struct(F.create_map(F.when(k % 4 == 0, "-1").otherwise(k.cast("string")), page).alias("pages")).alias("query")))
    return archive.page_details(table(spark, d, "pages").select(k.alias("id"), answer.alias("pages")), "fa")


def claims(spark, d):
    """Claims of an entity, and the titles of its two pages."""
    k = c("page_id")
    snak = lambda v: F.array(F.struct(F.struct(F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak")))
    item = lambda v: F.struct(v.alias("id"))
    p = table(spark, d, "pages").select(
        k.alias("id"),
        F.to_json(F.struct(F.when(k % 2 == 0, snak(F.concat(F.lit("F"), k.cast("string"), F.lit(".jpg")))).alias("P18"), F.when(k % 3 == 0, snak(F.struct(F.lit("+1990-01-02T00:00:00Z").alias("time")))).alias("P569"), snak(item(F.lit("Q1"))).alias("P19"),
                           F.when(k % 5 == 0, F.concat(snak(item(F.lit("Q7"))), snak(item(F.lit("Q8"))))).when(k % 5 == 1, snak(item(F.lit("Q9")))).alias("P106"))).alias("claims"),
        F.to_json(
            F.struct(
                F.struct(F.lit("En").alias("title")).alias("enwiki"), F.when(k % 2 == 1, F.struct(F.lit("Fa").alias("title"))).alias("fawiki"),
                F.struct(F.lit("De").alias("title")).alias("dewiki")
            )
        ).alias("sitelinks"),
    )
    got = archive.entity_claims(p)
    return got.select(
        "id", "image", "birth", "birth_place", F.array_join("occupations", ";").alias("jobs"), F.element_at("sitelinks", "enwiki").alias("en"),
        F.try_element_at("sitelinks", F.lit("fawiki")).alias("fa"), F.size("sitelinks").alias("n")
    )


def rows_to_do(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return archive.todo(o, o.where("o_orderstatus = 'F'").unionByName(o.where("o_orderstatus = 'F'")), "o_orderkey")


def lookups(spark, d):
    """The newest of timestamped names, and the first row of a key."""
    o = table(spark, d, "orders").select(F.concat(F.lit("backup-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".json")).alias("path"))
    cu = table(spark, d, "customer")
    one = archive.row_of(cu, "c_mktsegment", "BUILDING", "c_custkey").select(c("c_name").alias("value"))
    none = archive.row_of(cu, "c_mktsegment", "none", "c_custkey").select(c("c_name").alias("value"))
    return archive.newest(o).select(
        F.lit("newest").alias("kind"), c("path").alias("value")
    ).unionByName(one.select(F.lit("first").alias("kind"), "value")).unionByName(none.select(F.lit("none").alias("kind"), "value"))


def document(spark, d):
    """Lines of the whole archive document, which one after the other are its JSON."""
    return publish.document_lines(long_people(spark, d), events(spark, d), meta(spark)).select("part.kind", "part.id", F.md5("value").alias("value"))


def lite_document(spark, d):
    return publish.document_lines(
        long_people(spark, d), events(spark, d), meta(spark), lite=True
    ).where("part.kind = 1").select("part.id", c("value"))


def csv_form(spark, d):
    return publish.csv_lines(long_people(spark, d))


def event_documents(spark, d):
    """Parts of each known event's document: its info and count, its people, its end."""
    return publish.by_event(long_people(spark, d), events(spark, d)).select("event", "part", F.md5("value").alias("value"))


def statistics(spark, d):
    s = publish.statistics(long_people(spark, d), events(spark, d))
    flat = lambda k: s.select(F.lit(k).alias("kind"), F.explode(k).alias("value", "n"))
    total = s.select(
        F.explode(F.create_map(F.lit("total"), c("total"), F.lit("notable"), c("notable"))).alias("value", "n")
    ).select(F.lit("all").alias("kind"), "value", "n")
    return total.unionByName(flat("by_event")).unionByName(flat("by_verification")).unionByName(flat("by_gender"))


def versions(spark, d):
    """Two versions side by side, the older one untouched; a dry run writes none."""
    p, folder = long_people(spark, d).select("id", "name", "age"), scratch_path(spark)
    first = publish.apply_versioned(p, folder, "v=1")
    second = publish.apply_versioned(spark.read.json(first).select(p.columns).where("age > 30"), folder, "v=2")
    dry = publish.apply_versioned(p, folder, "v=3", apply=False)
    n = lambda path, k: spark.read.json(path).agg(F.lit(k).alias("version"), F.count("*").alias("n"), F.sum("age").alias("age"))
    return n(first, "first").unionByName(n(second, "second")).withColumn("dry", F.lit(dry is None))


def saved_in_steps(spark, d):
    """Work saved in steps, cut short after a part of the rows and taken up again."""
    p, folder = long_people(spark, d).select("id", "age"), scratch_path(spark)
    work = lambda x: x.withColumn("done", F.concat("id", F.lit("!")))
    publish.save_in_steps(p.where("age < 20"), work, "id", folder, 200)
    return publish.save_in_steps(p, work, "id", folder, 500)


def cards(spark, d):
    return b.cards(long_people(spark, d), events(spark, d))


def details(spark, d):
    p = long_people(spark, d)
    more = F.transform(
        F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("https://www.h"), i.cast("string"), F.lit(".netflix.com/"), c("city").substr(1, 1))
    )
    x = b.details(p.withColumn("memorial_links", F.concat(F.array(F.lit("bad")), more)))
    show = lambda f: F.concat_ws("=", f["label"], f["value"])
    return x.select(
        "id", F.array_join(F.transform("facts", show), ";").alias("facts"),
        F.array_join(F.transform("links", lambda u: F.concat_ws(":", u["host"], u["kind"])), ";").alias("links"), "story", "story_en"
    )


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Orders as timeline entries, their clerks' decades one of two words."""
    o = table(spark, d, "orders")
    return o.select(
        c("o_orderkey").alias("id"), F.concat(F.lit("t"), c("o_orderkey").cast("string")).alias("title"),
        F.date_format("o_orderdate", "yyyy").alias("date"), F.when(c("o_orderkey") % 3 == 0, "صنفی").otherwise("۱۳۹۰").alias("decade"),
        F.repeat(c("o_orderpriority"), (c("o_orderkey") % 9).cast("int")).alias("spark"), c("o_orderstatus").alias("casualties")
    )


def summary_table(spark, d):
    return b.summary_rows(timeline(spark, d))


def resumed_appends(spark, d):
    """Three runs over a folder that files are added to: each reads only what is new, the last finds nothing."""
    base, o = scratch_path(spark), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    run = lambda: append_new(spark, o.schema, f"{base}/in", f"{base}/out", f"{base}/ck", lambda x: x.where("o_orderstatus != 'P'"))
    for part in (0, 1):
        o.where(c("o_orderkey") % 2 == part).write.mode("append").parquet(f"{base}/in")
        run()
    run()
    return spark.read.parquet(f"{base}/out")


def appended_rows(spark, d):
    """Inserts add to what is there; equal rows count each."""
    base, e = scratch_path(spark), table(spark, d, "events").select("event_id", "event_type")
    for part in (0, 1, 1):
        publish.append(e.where(c("event_id") % 3 == part), base)
    return spark.read.parquet(base).groupBy("event_type").agg(F.count("*").alias("n"))


def report_caps(spark, d):
    """A report's first changes and first clusters."""
    o = table(spark, d, "orders")
    changes = publish.head(o.select(c("o_orderkey").cast("string").alias("id")), "changes", 25, "id")
    clusters = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1").select(c("o_custkey").cast("string").alias("id"))
    return changes.unionByName(publish.head(clusters, "clusters", 60, "id"))


def version_bumps(spark, d):
    k = c("p_partkey")
    v = F.when(k % 3 == 0, F.concat_ws(".", (k % 7).cast("string"), (k % 13).cast("string"), k.cast("string"))).when(k % 3 == 1, "x").otherwise("1.2")
    return table(spark, d, "part").select("p_partkey", tx.bump_minor(v).alias("version"))


def random_ids(spark, d):
    """Random ids differ in every row; only their form and number can be compared."""
    x = table(spark, d, "customer").select(tx.random_hex().alias("id"))
    return x.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct"), F.count_if(c("id").rlike("^[0-9a-f]{10}$")).alias("formed"))


_LONG = """l AS (SELECT c_custkey AS k, 'jvn_' || lpad(lower(hex(c_custkey)), 10, '0') AS id, CASE WHEN c_custkey % 4 = 0 THEN 's' || c_custkey END AS
  slug, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name_en,
    CASE WHEN c_custkey % 11 = 0 THEN 'gone' ELSE 'e' || c_nationkey END AS event, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN
      'w' ELSE 'm' END AS gender, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 90)::INT END AS age,
    CASE WHEN c_custkey % 6 = 0 THEN 'a "b", c' ELSE 'town' END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'told' END AS story, CASE c_custkey % 8 WHEN
      0 THEN 'told' WHEN 2 THEN 'said' END AS story_en, CASE WHEN c_custkey % 9 = 0 THEN 'http://p' END AS photo_url,
    c_mktsegment = 'BUILDING' AS notable, CASE WHEN c_custkey % 2 = 0 THEN 'documented' ELSE 'reported' END AS verification, c_mktsegment AS seg FROM customer)"""
_RECORD = """to_json({id: id, slug: slug, name: name, name_en: name_en, event: event, gender: gender, age: age, birth_year: NULL, date_jalali: NULL, date_gregorian: NULL, city: city, province: NULL, cause: NULL, occupation: NULL, story: story, story_en: story_en,
    photo_url: photo_url, memorial_links: ['https://www.x.com/a'], notable: notable, verification: verification, flagged_review: NULL, sources: ['s1', seg]})::VARCHAR"""
_EV = "ev AS (SELECT 'e' || n_nationkey AS event, n_name AS title, n_regionkey::INT AS o FROM nation)"
_Q = """'"'"""
QUERIES = {
    "archive_scan": (archive_scan, """SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INT AS ordinal, c_custkey::VARCHAR AS id, c_name AS name,
      c_custkey % 2 = 0 AS notable, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::INT END AS age, 0::INT AS links,
      CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE '' END AS sources FROM customer WHERE c_custkey <= 500"""),
    "flags_carried": (
        flags_carried, f"WITH {_LONG} SELECT id, CASE WHEN age % 2 = 0 THEN 'new' WHEN age % 3 = 0 THEN 'old ' || name END AS flagged_review FROM l"
    ),
    "last_fingerprints": (last_fingerprints, """WITH x AS (SELECT vec_id, 'p' || vec_id % 100 AS id FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL
      SELECT vec_id, 'q' || label FROM embeddings WHERE vec_id % 3 <> 0)
      SELECT id, sha1(max(vec_id)::VARCHAR) AS sha1 FROM x GROUP BY id"""),
    "urls_of_records": (
        urls_of_records,
        f"WITH {_LONG} SELECT 'http://p/' || age % 8 AS url, md5(string_agg(id, ';' ORDER BY id)) AS ids, count(*)::INT AS n FROM l WHERE age % 4 = 0 GROUP BY 1"
    ),
    "page_details": (page_details, """WITH x AS (SELECT page_id AS id, page_id % 4 <> 0 AS has, * FROM pages)
      SELECT id, CASE WHEN has THEN 'T ' || page_id END AS title, CASE WHEN has THEN page_id END AS pageid, CASE WHEN has THEN 'Q' || page_id END AS
        qid, NULL::VARCHAR AS extract, CASE WHEN has AND id % 2 = 0 THEN url END AS pageimage_original,
        NULL::VARCHAR AS pageimage_thumb, CASE WHEN has THEN url END AS fullurl, CASE WHEN has THEN 'fa' END AS lang FROM x"""),
    "entity_claims": (claims, """SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'F' || page_id || '.jpg' END AS image, CASE WHEN page_id % 3 = 0
      THEN '+1990-01-02T00:00:00Z' END AS birth, 'Q1' AS birth_place,
      CASE page_id % 5 WHEN 0 THEN 'Q7;Q8' WHEN 1 THEN 'Q9' END AS jobs, 'En' AS en, CASE WHEN page_id % 2 = 1 THEN 'Fa' END AS fa, (1 + page_id %
        2)::INT AS n FROM pages"""),
    "rows_to_do": (rows_to_do, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"),
    "lookups": (lookups, """SELECT 'newest' AS kind, 'backup-' || strftime(max(o_orderdate), '%Y%m%d') || '.json' AS value FROM orders
      UNION ALL SELECT 'first', min_by(c_name, c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING'"""),
    "archive_document": (document, f"""WITH {_LONG}, {_EV}, f AS (SELECT min(id) AS first FROM l)
      SELECT 1::INT AS kind, id, md5(CASE WHEN id = first THEN '' ELSE ',' END || {_RECORD}) AS value FROM l, f UNION ALL SELECT 2, '', md5(']}}')
      UNION ALL SELECT 0, '', md5('{{"metadata":{{"version":"1.0.0"}},"events":{{' || (SELECT string_agg('"' || event || '":' ||
        to_json({{title: title, "order": o}})::VARCHAR, ',' ORDER BY event) FROM ev) || '}},"people":[')"""),
    "lite_document": (lite_document, f"""WITH {_LONG}, f AS (SELECT min(id) AS first FROM l)
      SELECT id, CASE WHEN id = first THEN '' ELSE ',' END || '{{"id":"' || id || '","n":"' || name || '","ne":"' || name_en || '","e":"' || event ||
        '"' || coalesce(',"g":"' || gender || '"', '') || coalesce(',"a":' || age, '')
        || ',"c":' || to_json(city)::VARCHAR || ',"nt":' || notable::VARCHAR || ',"v":"' || verification || '"' || coalesce(',"s":"' || story || '"',
          '') || '}}' AS value FROM l, f"""),
    "csv_form": (
        csv_form,
        f"""WITH {_LONG} SELECT concat_ws(',', id, name, name_en, event, coalesce(gender, ''), coalesce(age::VARCHAR, ''), '', '', '', CASE WHEN city = 'town' THEN city ELSE {_Q} || replace(city, '"', '""') || {_Q} END, '', '', '', notable::VARCHAR, verification, 's1; ' || seg) AS value FROM l"""
    ),
    "event_documents": (event_documents, f"""WITH {_LONG}, {_EV}, f AS (SELECT event, min(id) AS first, count(*) AS n FROM l GROUP BY event)
      SELECT event, 'p' || id AS part, md5(CASE WHEN id = first THEN '' ELSE ',' END || {_RECORD}) AS value FROM l JOIN ev USING (event) JOIN f USING (event)
      UNION ALL SELECT event, '', md5('{{"event":"' || event || '","info":' || to_json({{title: title, "order": o}})::VARCHAR || ',"count":' ||
        coalesce(n, 0) || ',"people":[') FROM ev LEFT JOIN f USING (event) UNION ALL SELECT event, 'z', md5(']}}') FROM ev"""),
    "statistics": (statistics, f"""WITH {_LONG}, {_EV} SELECT 'all' AS kind, 'total' AS value, count(*) AS n FROM l UNION ALL SELECT 'all', 'notable',
      count(*) FILTER (notable) FROM l
      UNION ALL SELECT 'by_event', ev.event, count(id) FROM ev LEFT JOIN l USING (event) GROUP BY 2 UNION ALL SELECT 'by_verification', verification,
        count(*) FROM l GROUP BY 2 UNION ALL SELECT 'by_gender', gender, count(*) FROM l WHERE gender IS NOT NULL GROUP BY 2"""),
    "versions": (
        versions,
        f"WITH {_LONG} SELECT 'first' AS version, count(*) AS n, sum(age)::BIGINT AS age, true AS dry FROM l UNION ALL SELECT 'second', count(*), sum(age)::BIGINT, true FROM l WHERE age > 30"
    ),
    "saved_in_steps": (saved_in_steps, f"WITH {_LONG} SELECT id, age, id || '!' AS done FROM l"),
    "cards": (
        cards,
        f"""WITH {_LONG}, {_EV} SELECT id, name, coalesce(title, event) AS label, coalesce(translate(age::VARCHAR, '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' ساله · ', '') || city AS meta, verification AS badge, notable AS star, photo_url AS photo FROM l LEFT JOIN ev USING (event)"""
    ),
    "details": (details, f"""WITH {_LONG} SELECT id, concat_ws(';', 'age=' || translate(age::VARCHAR, '0123456789', '۰۱۲۳۴۵۶۷۸۹') || ' سال', 'gender='
      || gender, 'city=' || city) AS facts,
      'منبع:generic;' || array_to_string(list_transform(range(1, 6), lambda i: 'h' || i || '.netflix.com:twitter'), ';') AS links, story, CASE WHEN
        story_en = 'said' THEN 'said' END AS story_en FROM l"""),
    "summary_table": (summary_table, """WITH x AS (SELECT o_orderkey AS id, 't' || o_orderkey AS title, strftime(o_orderdate, '%Y') AS date,
      repeat(o_orderpriority, (o_orderkey % 9)::INT) AS s, o_orderstatus AS casualties FROM orders WHERE o_orderkey % 3 <> 0)
      SELECT id, title, date, CASE WHEN length(s) > 60 THEN substr(s, 1, 60) || '…' ELSE s END AS spark, casualties FROM x"""),
    "resumed_appends": (resumed_appends, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'"),
    "appended_rows": (
        appended_rows, "SELECT event_type, sum(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END)::BIGINT AS n FROM events WHERE event_id % 3 < 2 GROUP BY 1"
    ),
    "report_caps": (report_caps, """SELECT * FROM (SELECT 'changes' AS part, o_orderkey::VARCHAR AS id FROM orders ORDER BY 2 LIMIT 25)
      UNION ALL SELECT * FROM (SELECT 'clusters', o_custkey::VARCHAR AS id FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY 2 LIMIT 60)"""),
    "version_bumps": (
        version_bumps,
        "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 7) || '.' || (p_partkey % 13 + 1) || '.0' ELSE '1.1.0' END AS version FROM part"
    ),
    "random_ids": (random_ids, 'SELECT count(*) AS n, count(*) AS "distinct", count(*) AS formed FROM customer'),
}
