"""Operators on small invented records."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quern import schema as S
from quern.functions import calendar as cal
from quern.functions import text as tx
from quern.operators import classify, enrich, moderation, resolve
from quern.operators.components import components
from quern.sources import archive, publish
from quern.streaming.ratelimit import decide, rate_limit, rate_limit_stream


def person(i, **k):
    base = {n: None for n in S.LONG} | {"id": f"jvn_{i:010x}", "name": f"نام {i}", "event": "green_88", "memorial_links": [], "sources": ["a"], "notable": False, "verification": "reported"}
    return tuple((base | k)[n] for n in S.LONG)


def people(spark, *rows):
    return spark.createDataFrame(list(rows), S.PERSON)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_text_functions(spark):
    q = lambda c: one(spark, c)
    assert q(tx.fold_digits(F.lit("۱۲٣4"))) == "1234" and q(tx.to_native_digits(F.lit(105))) == "۱۰۵"
    assert q(tx.norm_name_v1(F.lit("علي‌ كريم "))) == "علی کریم"
    assert q(tx.norm_text(F.lit("مُحَمّد‌رضا (آذر) #۱_۲"))) == "محمد رضا اذر 1_2"
    assert q(tx.norm_text_v1(F.lit("a_b#c، ۱"))) == "a b c 1"
    assert q(tx.norm_name(F.lit("شهید دکتر علی احمدی"))) == "علی احمدی"
    a = lambda s: F.split(F.lit(s), " ")
    for x, y, want in (("a b", "a b c", True), ("a c", "a b c", True), ("c a", "a b c", False), ("a", "a b", False), ("a", "a", True), ("a b b", "a b c d", False)):
        assert q(tx.is_subset(a(x), a(y))) is want and q(tx.is_subset(a(y), a(x))) is want
    assert q(tx.hamming_hex(F.lit("f" * 64), F.lit("0" * 64))) == 256 and q(tx.hamming_hex(F.lit("ff"), F.lit("f"))) == 999
    assert q(tx.int_prefix(F.lit("12abc"))) == 12 and q(tx.int_prefix(F.lit("200"))) is None and q(tx.int_prefix(F.lit("x"))) is None
    assert q(tx.bump_minor(F.lit("1.2.3"))) == "1.3.0" and q(tx.bump_minor(F.lit("x"))) == "1.1.0"
    assert json.loads(q(tx.with_key(F.lit("bad{"), "nt", F.lit(True)))) == {"nt": True} and json.loads(q(tx.with_key(F.lit(None).cast("string"), "ph", F.lit('a"b')))) == {"ph": 'a"b'}
    kept = '{"b":1.5,"a":"x\\"y","n":null,"l":[1,{"k":"v"}],"t":true}'
    assert json.loads(q(tx.with_key(F.lit(kept), "a", F.lit(None).cast("string")))) == json.loads(kept) | {"a": None}
    assert list(json.loads(q(tx.with_key(F.lit(kept), "n", F.lit(3))))) == list("banlt") and json.loads(q(tx.with_key(F.lit(kept), "z", F.lit("ی"))))["z"] == "ی"
    assert q(tx.media_file(F.lit("https://c.org/wiki/Special:FilePath/A%20b.jpg?width=6"))) == ("A b.jpg", "commons.wikimedia.org") and q(tx.media_file(F.lit("https://x/q.png"))) is None
    assert q(tx.unquote(F.lit("100%+a%20b"))) == "100%+a%20b" and q(tx.unquote(F.lit("a+b%20c"))) == "a+b c"
    assert q(tx.link_kind(F.lit("https://netflix.com/a"))) == "twitter"  # the rule is a part of the host
    assert q(tx.html_escape(F.lit("<a&'\">"))) == "&lt;a&amp;&#39;&quot;&gt;" and q(tx.clean(F.lit("  ab\u0000c "), 2)) == "ab"
    assert q(tx.host(F.lit("https://www.x.com/a"))) == "x.com" and q(tx.link_kind(F.lit("nonsense"))) == "invalid"


def test_dates(spark):
    q = lambda c: one(spark, c)
    assert q(cal.jalali_year(F.lit("۱۴۰۱/۰۷"))) == 1401 and q(cal.jalali_year(F.lit("??"))) is None
    assert not q(cal.has_month(F.lit("1401/00/00"))) and q(cal.has_month(F.lit("1401/10/1")))
    assert q(cal.jalali_text(F.to_date(F.lit("2025-03-20")))) == "1403/12/30"
    assert str(q(cal.from_jalali(F.lit(1403), F.lit(12), F.lit(30)))) == "2025-03-20" and q(cal.from_jalali(F.lit(1402), F.lit(12), F.lit(30))) is None
    assert q(cal.approx_jalali_year(F.lit("2020-04-01"))) == 1399 and q(cal.approx_jalali_year(F.lit("1980-04-01"))) is None
    assert cal.read_story_year("در دی‌ماه ۱۳۹۶ جان باخت") == (1396, "high")
    assert cal.read_story_year("متولد ۱۳۷۰") == (None, None) and cal.read_story_year("سال ۱۳۹۸ کشته شد") == (1398, "medium")
    assert cal.read_story_year_v1("در 5 آبان 1398") == 1398 and cal.read_story_year_v1("متولد 5 آبان 1370") is None
    j = lambda s: q(F.to_json(cal.to_jalali(F.lit(s).cast("date"))))
    assert j("1831-03-21") == '{"y":1210,"m":1,"d":1}' and j("2256-03-19") == '{"y":1634,"m":12,"d":29}' and j("1831-03-20") == j("2256-03-20") == "{}"
    assert q(cal.from_jalali(F.lit(1635), F.lit(1), F.lit(1))) is None and q(cal.from_jalali(F.lit(1209), F.lit(1), F.lit(1))) is None
    assert q(tx.squeeze(F.lit(" a\t b\n\nc\u00a0d "))) == "a b c d"
    days = spark.range(0, 150_000, 7).select(F.date_add(F.lit("1840-01-01").cast("date"), F.col("id").cast("int")).alias("d")).withColumn("j", cal.to_jalali(F.col("d")))
    assert days.where(~cal.from_jalali(F.col("j.y"), F.col("j.m"), F.col("j.d")).eqNullSafe(F.col("d"))).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = dict(components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300} == got
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_resolution(spark):
    p = people(
        spark,
        person(1, name="علی احمدی راد", city="تهران", age=20, story="x" * 30, sources=["a"], photo_url="u1"),
        person(2, name="شهید علی احمدی راد", city="تهران", age=21, story="y" * 50, sources=["b", "a"], notable=True),
        person(3, name="علی راد", city="تهران"),
        person(4, name="رضا کریمی", city="شیراز"),
    )
    e = resolve.score(p, resolve.candidates(p))
    got = {(r.a[-1], r.b[-1]): r.reason for r in e.collect()}
    assert got == {("1", "2"): "NAME_EQ+ctx", ("1", "3"): "NAME_SUBSET+ctx", ("2", "3"): "NAME_SUBSET+ctx"}
    cl = resolve.split(e, resolve.is_strong())
    out, audit = resolve.merge(p, cl, e)
    rows = {r.id[-1]: r for r in out.collect()}
    assert sorted(rows) == ["2", "4"] and rows["2"].story == "y" * 50 and rows["2"].sources == ["b", "a"] and rows["2"].photo_url == "u1" and rows["2"].age == 21
    a = audit.first()
    assert len(a.merged_ids) == 2 and a.age_conflicts == ["20"] and a.reasons == ["NAME_EQ+ctx", "NAME_SUBSET+ctx"]
    assert [(x.field, x.before, x.after, x.src[-1]) for x in a.changes] == [("photo_url", None, "u1", "1")]
    prints = spark.createDataFrame([(f"jvn_{i:010x}", "s", "0" * 64, "0" * 64, None) for i in (1, 4)], "id string, sha1 string, phash string, dhash string, face_phash string")
    none = spark.createDataFrame([], "removed_id string")
    assert [len(r.ids) for r in resolve.review(p, prints, none).collect()] == [2]
    assert resolve.score(p, resolve.candidates(p, prints), prints).count() >= 3
    merged, done = resolve.apply_merges(p, spark.createDataFrame([(f"jvn_{1:010x}", f"jvn_{4:010x}"), (f"jvn_{1:010x}", "missing")], "keep string, dup string"))
    assert merged.count() == 3 and done.count() == 1


def test_block_cap_is_strict(spark):
    keyed = spark.createDataFrame([(i, "k") for i in range(5)] + [(10, "m"), (11, "m"), (12, None)], "id long, key string")
    assert resolve.block_pairs(keyed, 4).collect() == [(10, 11)] and resolve.block_pairs(keyed, 5).count() == 11


def test_fuzzy_ratio_scores_whole_texts_of_whole_blocks(spark, tmp_path):
    from difflib import SequenceMatcher
    from random import Random

    from quern.plans import resolution

    rng = Random(4)
    text = lambda i: "one two " + str(i % 3) + "\n" + "".join(rng.choices("abcdefgh ijXYZ0\n", k=rng.choice((5, 150, 400))))
    docs = [(i, text(i), "en") for i in range(250)] + [(300, "alone here", "en"), (301, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = resolution.fuzzy_ratio(spark, str(tmp_path)).collect()
    assert len({(x.a, x.b) for x in got}) == len(got) == 250 * 249 // 2
    for x in rng.sample(got, 300):
        assert x.a < x.b and x.ratio == round(SequenceMatcher(None, docs[x.a][1], docs[x.b][1]).ratio(), 6)


def test_fuzzy_ratio_skips_no_block(spark, tmp_path):
    from quern.plans import resolution

    docs = spark.range(820).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two\n"), F.repeat(F.lit("x"), (F.col("id") % 3).cast("int"))).alias("text"), F.lit("en").alias("lang"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = resolution.fuzzy_ratio(spark, str(tmp_path))
    assert got.count() == got.select("a", "b").distinct().count() == 820 * 819 // 2


def test_subset_name_makes_its_lists_once(spark):
    from quern.plans import texts

    plan = texts.subset_name(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") < 40


def test_queue_ends_alike_in_each_run(spark):
    """Rows of equal ids at the queue's end do not depend on how the table lies."""
    from quern.operators import moderation

    rows = [(i // 40, i, 1000 - i, "open") for i in range(400)]
    names = spark.createDataFrame([(i, f"n{i}") for i in range(0, 1001, 2)], "id long, name string")
    seen = set()
    for parts, way in ((1, 1), (1, -1), (7, 1)):
        r = spark.createDataFrame(rows[::way], "id long, person_id long, duplicate_of long, status string").repartition(parts)
        seen.add(tuple(sorted((x.id, x.person_id) for x in moderation.queue(r, names, default="open", limit=100).collect())))
    assert len(seen) == 1 and sorted(p for i, p in seen.pop() if i == 7) == list(range(280, 300))


def test_classification(spark):
    p = people(
        spark,
        person(1, date_jalali="1398/08/25"), person(2, date_jalali="1340/01/01"), person(3, event="executions", date_jalali="1398/01/01"), person(4, date_jalali="1388"),
        person(5, date_jalali="1388", story="سال 1398 کشته شد"), person(6, story="دی ماه 1396"), person(7),
    )
    out, audit = classify.reassign(p)
    got = {r.id[-1]: r.event for r in out.collect()}
    assert got == {"1": "aban_98", "2": "needs_review", "3": "executions", "4": "green_88", "5": "aban_98", "6": "dey_96", "7": "green_88"}
    assert {r.id[-1] for r in audit.collect()} == {"1", "2", "5", "6"} and out.columns == p.columns
    v1 = {r.id[-1]: r.event for r in classify.reassign_v1(p)[0].collect()}
    assert v1["1"] == "aban_98" and v1["3"] == "executions"
    late = people(spark, person(1, date_jalali="1400/10/18"), person(2, date_jalali="1400/05/18"), person(3, date_jalali="1400/10/18", event="khizesh_1404"))
    assert {r.id[-1]: r.event for r in classify.reassign_v1(late)[0].collect()} == {"1": "khizesh_1404", "2": "khuzestan_1400", "3": "khizesh_1404"}
    fixed, status = classify.apply_corrections(p, spark.createDataFrame([("jvn_0000000001", "dey_96"), ("nope", "x")], "id string, event string"))
    assert {r.status for r in status.collect()} == {"moved", "NOT FOUND"} and fixed.count() == 7
    broken = people(spark, person(1, date_jalali="2020", date_gregorian="1398/08/25"), person(2, date_jalali="1398/01/01"))
    rep, log = classify.repair_dates(broken)
    assert log.count() == 1 and {(r.date_jalali, r.date_gregorian) for r in rep.collect()} == {("1398/08/25", "2019-11-16"), ("1398/01/01", None)}
    assert classify.drop_tests(people(spark, person(1, name="Test"), person(2))).count() == 1
    assert classify.revert(p.withColumn("event", F.lit("khizesh_1404")), p, year=1398)[1].count() == 2


def test_enrichment(spark):
    p = people(spark, person(1), person(2, name_en="Kept", birth_year=1300))
    raw = spark.createDataFrame([("jvn_0000000001", "t1", "http://fa", None, 1, "Name", "+1990-05-01T00:00:00Z", "+2019-11-16T00:00:00Z"), ("jvn_0000000002", "bad", "http://fa2", None, 2, "Other", None, None)], "id string, title string, fa_url string, en_url string, pageid int, label_en string, birth string, death string")
    images = spark.createDataFrame([("jvn_0000000002", "http://img", "verified"), ("jvn_0000000001", "http://no", "resolved")], "id string, url string, status string")
    out, report = enrich.enrich(p, raw, spark.createDataFrame([("bad",)], "title string"), images)
    r = {x.id[-1]: x for x in out.collect()}
    assert (r["1"].name_en, r["1"].birth_year, r["1"].date_gregorian, r["1"].date_jalali) == ("Name", 1369, "2019-11-16", "1398/08/25")
    assert r["1"].sources == ["a", "wikipedia_fa", "wikidata"] and r["1"].photo_url is None and r["2"].name_en == "Kept" and r["2"].photo_url == "http://img"
    assert report.count() == 1


def test_archive_round_trip(spark, tmp_path):
    doc = {"meta": {"version": "1"}, "events": {"green_88": {"title": "t", "title_en": "T", "year_fa": "۱", "year": 1388, "order": 1, "category": "c"}, "aban_98": {"title": "u", "order": 2}},
           "people": [{"id": "jvn_0000000001", "n": "الف", "e": "green_88", "nt": 1, "v": "documented", "src": ["s1", "s2"], "g": "زن"}, {"id": "jvn_0000000002", "n": "ب\"x", "e": "gone", "v": "reported", "src": []}]}
    path = tmp_path / "archive.json"
    path.write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    p, ev, meta = archive.read_archive(spark, str(path))
    rows = p.orderBy("ordinal").collect()
    assert [r.notable for r in rows] == [True, False] and rows[1].memorial_links == [] and meta.count() == 1
    bad = {(r.id[-1], r.violation) for r in S.conformance(p, S.person_rules()).collect()}
    assert bad == {("2", "event_enum"), ("2", "sources_min_items")}
    long = p.drop("ordinal")
    publish.publish(long, ev, str(tmp_path / "out"))
    stats = json.loads(next((tmp_path / "out/statistics").glob("*.json")).read_text())
    assert stats["total"] == 2 and stats["by_event"] == {"aban_98": 0, "green_88": 1} and stats["notable"] == 1
    raw = b"".join(f.read_bytes() for d in ("0-header", "1-rows") for f in sorted((tmp_path / "out/csv" / d).glob("*.txt")))
    assert raw.startswith("\ufeffid,".encode()) and raw.count(b"\r\n") == 3 and b"s1; s2" in raw and b'"\xd8\xa8""x"' in raw
    import csv

    publish.write_csv(long, str(tmp_path / "one"), one_file=True)
    (one,) = (tmp_path / "one").glob("*.txt")
    got = list(csv.reader(one.read_text(encoding="utf-8-sig").splitlines()))
    assert got[0] == S.CSV and sorted(r[1] for r in got[1:]) == ["الف", 'ب"x'] and len(got) == 3
    publish.write_document(long, ev, meta, str(tmp_path / "doc"))
    whole = json.loads("".join(f.read_text() for f in sorted((tmp_path / "doc").glob("*.txt"))))
    assert whole["metadata"] == {"version": "1"} and list(whole["events"]) == ["aban_98", "green_88"] and [x["name"] for x in whole["people"]] == ["الف", 'ب"x'] and whole["people"][0]["age"] is None
    publish.write_document(long, ev, meta, str(tmp_path / "lite"), lite=True)
    lite = json.loads("".join(f.read_text() for f in sorted((tmp_path / "lite").glob("*.txt"))))
    assert lite["people"][0] == {"id": "jvn_0000000001", "n": "الف", "e": "green_88", "g": "زن", "nt": True, "v": "documented"} and set(lite) == {"meta", "events", "people"}
    publish.write_event_documents(long, ev, str(tmp_path / "by"))
    each = {d.name: json.loads("".join(f.read_text() for f in sorted(d.glob("*.txt")))) for d in (tmp_path / "by").glob("event=*")}
    assert {k: (v["event"], v["count"], len(v["people"])) for k, v in each.items()} == {"event=green_88": ("green_88", 1, 1), "event=aban_98": ("aban_98", 0, 0)} and each["event=green_88"]["info"]["title"] == "t"
    assert os.path.isdir(tmp_path / "out/by-event/people/event=green_88") and not os.path.exists(tmp_path / "out/by-event/people/event=gone")
    assert spark.read.json(str(tmp_path / "out/min")).count() == 2
    assert archive.read_flags(spark, str(tmp_path / "none")).count() == 0
    assert S.to_long(spark.createDataFrame([("x", "n", None)], "id string, n string, nt string")).first().notable is False


def test_moderation(spark):
    p = spark.createDataFrame([("p1", "a", None, False, '{"n":"a"}'), ("p2", "b", None, True, "bad")], "id string, name string, photo_url string, notable boolean, data_json string")
    ph = spark.createDataFrame([(1, "p1", "http://x/y", "pending"), (2, "p1", "ftp://x", "pending"), (3, "zz", "http://x", "pending"), (4, "p2", "http://x", "done")], "id int, person_id string, photo_url string, status string")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int")
    people_, photos, refused = moderation.approve_photos(p, ph, ids)
    assert {r.id: r.photo_url for r in people_.collect()} == {"p1": "http://x/y", "p2": None}
    assert {r.id: r.why for r in refused.collect()} == {2: "bad_url", 3: "no_person", 4: "not_pending"} and photos.where("status = 'approved'").count() == 1
    told = spark.createDataFrame([("p1", True), ("p2", True)], "id string, notable boolean")
    t = {r.id: r for r in moderation.set_notable(moderation.set_notable(p, told), told).collect()}
    assert t["p1"].notable and json.loads(t["p1"].data_json) == {"n": "a", "nt": True} and t["p2"].notable and json.loads(t["p2"].data_json) == {"nt": True}
    sub = spark.createDataFrame([(1, "n", "e", None, None, "pending", None), (2, "m", "e", None, None, "approved", None)], "id int, name string, event string, city string, photo_url string, status string, approved_person_id string")
    people_, subs = moderation.approve_submissions(sub, p.withColumns({"event": F.lit("e"), "city": F.lit("c")}), ids)
    assert people_.count() == 3 and subs.where("approved_person_id IS NOT NULL").count() == 1


def test_rate_limit_windows():
    import numpy as np

    assert decide(np.array([0, 1, 2, 3, 10, 11]), 3, 10)[0] == [True, True, True, False, True, True]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    data = [(i, f"k{i % 3}" if i % 7 else "", t0 + datetime.timedelta(seconds=(i * 37) % 400)) for i in range(120)]
    e = spark.createDataFrame(data, "event_id int, user_id string, ts timestamp")
    batch = {r.event_id: r.allowed for r in rate_limit(e, "user_id", "ts", "event_id", 2, 60).collect()}
    assert all(batch[i] for i, k, _ in data if not k) and len(batch) == 120
    e.where("user_id != ''").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = rate_limit_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "event_id", 2, 60)
    q = s.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: r.allowed for r in spark.sql("SELECT * FROM limited").collect()}
    assert got == {i: batch[i] for i in got} and len(got) == sum(bool(k) for _, k, _ in data)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and callable(entry.entry)
    with pytest.raises(KeyError):
        entry.queries()["none"]
