"""Scoring and the conservative pass against plain Python versions over pairs, and awkward tables."""

from __future__ import annotations

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quern import schema as S
from quern.operators import classify, enrich, moderation, resolve

from .test_operators import people, person

NAMES = "علی احمدی|علی احمدی راد|شهید علی احمدی|علی ب احمدی|ا احمدی|ا احمدی راد|رضا کریمی|رضا کریمى|رضا کریم|سید رضا کریمی نو|علی راد".split("|")
STORY = "در روز سرد زمستان در میدان شهر جان باخت و پیکر او در زادگاهش به خاک سپرده شد"


def invented(n=140, seed=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        story = rng.choice([None, "کوتاه", STORY, STORY.replace("سرد", "گرم"), STORY[::-1], "داستان " * 12])
        rows.append({"id": i, "name": rng.choice(NAMES), "city": rng.choice(["تهران", "شهر نو", "نو آباد", None, ""]), "age": rng.choice([None, 0, 20, 30]), "birth_year": rng.choice([None, 1370, 1380]),
                     "date_jalali": rng.choice(["1401/10/18", "1398-8-25", "1398/8/25", "??", None]), "story": story})
    return rows


def hashes(rows, seed=5):
    rng, out = random.Random(seed), {}
    for r in rows:
        if rng.random() < 0.6:
            base = rng.choice([0, (1 << 256) - 1, 0x5A << 100])
            flip = lambda v: f"{v ^ sum(1 << b for b in rng.sample(range(256), rng.choice([0, 5, 12, 13, 60]))):064x}"
            out[r["id"]] = {"sha1": rng.choice(["a", "b", None, ""]), "phash": flip(base), "dhash": flip(base), "face_phash": rng.choice([None, flip(base)])}
    return out


FOLD = str.maketrans("يكﻩةأإآٱ", "یکههاااا", "ًٌٍَُِّْ")


def norm(t):
    import regex

    return regex.sub(r"[^\\p{L}\\p{N}_\u0600-\u06FF]+", " ", (t or "").translate(FOLD).replace("\u200c", " ")).strip()


def name(t):
    return " ".join(w for w in norm(t).split() if w not in {"شهید", "سید"})


def tokens(t):
    return [w for w in name(t).split() if len(w) > 1]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def subset(a, b):
    short, long = sorted((tokens(a), tokens(b)), key=len)
    if not short:
        return False
    rest = iter(long)
    return short == long or (len(short) > 1 and all(w in rest for w in short))


def day(r):
    import re

    m = re.search(r"\d{3,4}[/-](\d{1,2})[/-](\d{1,2})", r["date_jalali"] or "")
    return m and (int(m[1]), int(m[2]))


def differ(a, b):
    return 999 if not a or not b or len(a) != len(b) else (int(a, 16) ^ int(b, 16)).bit_count()


def level(x, y):
    if not x or not y:
        return 0
    if (x["sha1"] and x["sha1"] == y["sha1"]) or differ(x["phash"], y["phash"]) <= 12 or differ(x["dhash"], y["dhash"]) <= 12 or differ(x["face_phash"], y["face_phash"]) <= 18:
        return 2
    return 1 if differ(x["face_phash"], y["face_phash"]) <= 78 else 0


def plain_scores(rows, prints):
    """Every candidate pair and its tier, a condition at a time."""
    keys = {}
    for r in rows:
        keys.setdefault("n" + (tokens(r["name"]) or [""])[0], set()).add(r["id"])
        if norm(r["city"]):
            keys.setdefault("c" + norm(r["city"]).split()[0], set()).add(r["id"])
    seen = {}
    for i, p in prints.items():
        for k in (p["sha1"] and "s" + p["sha1"], "p" + p["phash"][:3], "q" + p["phash"][3:6], p["face_phash"] and "f" + p["face_phash"][:3]):
            if k:
                seen.setdefault(k, set()).add(i)
    pairs = {x for cap, ks in ((800, keys), (400, seen)) for ids in ks.values() if len(ids) <= cap for x in itertools.combinations(sorted(ids), 2)}
    by = {r["id"]: r for r in rows}
    days, cities = [day(r) for r in rows], [norm(r["city"]) for r in rows]
    out = {}
    for a, b in pairs:
        x, y = by[a], by[b]
        image = level(prints.get(a), prints.get(b)) == 2
        overlap = bool(set(tokens(x["name"])) & set(tokens(y["name"])))
        city = norm(x["city"]) != "" and norm(x["city"]) == norm(y["city"])
        word = bool({w for w in norm(x["city"]).split() if len(w) > 2} & {w for w in norm(y["city"]).split() if len(w) > 2})
        sx, sy = norm(x["story"]), norm(y["story"])
        story = len(sx) > 40 and len(sy) > 40 and ratio(sx, sy) >= 0.6
        born, aged = (bool(x[k]) and x[k] == y[k] for k in ("birth_year", "age"))
        date = day(x) is not None and day(x) == day(y)
        rare, rare_city = date and days.count(day(x)) <= 25, city and cities.count(norm(x["city"])) <= 40
        equal = name(x["name"]) != "" and name(x["name"]) == name(y["name"])
        if image and (overlap or born or story or rare or rare_city):
            out[a, b] = "SAME_IMG+corrob"
        elif equal and (city or word or born or image or date or aged):
            out[a, b] = "NAME_EQ+ctx"
        elif subset(x["name"], y["name"]) and (city or word or image or born or rare or aged):
            out[a, b] = "NAME_SUBSET+ctx"
        elif ratio(name(x["name"]), name(y["name"])) >= 0.88 and city and (born or rare or story or image):
            out[a, b] = "NAME_FUZZY+strong_ctx"
        elif story and overlap:
            out[a, b] = "STORY+name"
    return out


def as_people(spark, rows):
    return people(spark, *(person(r["id"], **{k: v for k, v in r.items() if k != "id"}) for r in rows))


@pytest.mark.parametrize("seed", [4, 11])
def test_tiers_match_a_plain_version(spark, seed):
    rows = invented(seed=seed)
    prints = hashes(rows)
    key = lambda i: f"jvn_{i:010x}"
    p = as_people(spark, rows)
    f = spark.createDataFrame([(key(i), *(v[k] for k in ("sha1", "phash", "dhash", "face_phash"))) for i, v in prints.items()], "id string, sha1 string, phash string, dhash string, face_phash string")
    want = plain_scores(rows, prints)
    got = resolve.score(p, resolve.candidates(p, f), f).collect()
    assert {(r.a, r.b): r.reason for r in got} == {(key(a), key(b)): v for (a, b), v in want.items()} and len(got) == len(want)
    assert {v for v in want.values()} == {"SAME_IMG+corrob", "NAME_EQ+ctx", "NAME_SUBSET+ctx", "NAME_FUZZY+strong_ctx", "STORY+name"}
    assert {(r.a, r.b) for r in got if r.same_file} == {(key(a), key(b)) for a, b in want if a in prints and b in prints and prints[a]["sha1"] and prints[a]["sha1"] == prints[b]["sha1"]}


def test_names_of_single_letters(spark):
    """Tokens of one letter count in equality alone, not in a name's parts."""
    t = lambda s: F.filter(F.split(F.lit(s), " "), lambda w: F.char_length(w) > 1)
    from quern.functions import text as tx

    for a, b, want in (("ا رضایی", "ا رضایی محمدی", False), ("علی ب رضایی", "علی رضایی تهرانی", True), ("رضایی", "رضایی", True)):
        assert spark.range(1).select(tx.is_subset(t(a), t(b)).alias("x")).first().x is want


def test_later_seeds_absorb_earlier_keepers(spark):
    """The fullest of the first star, a later row, is gathered again by a seed between; filled fields count by then."""
    long = "once upon a time there was a long story told"
    p = people(
        spark,
        person(1, name="a b", story=long, sources=["z"]), person(2, name="a b", city="here", date_jalali="1400/01/02"),
        person(3, name="a b", story=long + "!", city="here now", date_jalali="1400/01/02", age=5, photo_url="u", sources=["m", "b"]), person(4, name="a b", story="other"), person(5, name=""), person(6, name=""),
    ).withColumn("ordinal", F.col("id"))
    after, audit = resolve.conservative_dedup(p)
    rows = {r.id[-1]: r for r in after.collect()}
    assert sorted(rows) == ["3", "4", "5", "6"] and rows["3"].sources == ["a", "b", "m", "z"]
    assert {(r.removed_id[-1], r.kept_id[-1]) for r in audit.collect()} == {("1", "3"), ("2", "3")}


def test_order_decides_the_conservative_pass(spark):
    rows = [person(i, name="a b", city="x", date_jalali="1400/1/2", age=a) for i, a in ((1, 7), (2, None), (3, 8))]
    for order, want in (((1, 2, 3), "1"), ((3, 2, 1), "3")):
        p = people(spark, *rows).withColumn("ordinal", F.element_at(F.create_map(*[F.lit(v) for i, o in enumerate(order) for v in (f"jvn_{o:010x}", i)]), F.col("id")))
        assert [r.id[-1] for r in resolve.conservative_dedup(p)[0].collect()] == [want]


def test_clusters_hold_by_name_family_or_file(spark):
    """A chain of stories falls apart, fuzzy names and equal files hold."""
    e = [(1, 2, "STORY+name", False), (2, 3, "STORY+name", True), (3, 4, "NAME_FUZZY+strong_ctx", False), (4, 5, "STORY+name", False), (5, 6, "NAME_EQ+ctx", False), (20, 21, "STORY+name", False)]
    cl = resolve.split(spark.createDataFrame(e, "a long, b long, reason string, same_file boolean"), resolve.is_strong())
    assert dict((r.node, r.component) for r in cl.collect()) == {2: 2, 3: 2, 4: 2, 5: 5, 6: 5, 20: 20, 21: 20}


def test_review_of_a_file_that_many_share(spark):
    p = people(spark, *(person(i, name=f"name{i} of{i}") for i in range(60)), *(person(100 + i, name="علی احمدی" + " راد" * (i % 2)) for i in range(20)))
    prints = p.select("id", F.when(F.col("name").startswith("name"), "many").otherwise("kin").alias("sha1"))
    got = resolve.review(p, prints, spark.createDataFrame([("jvn_0000000003",)], "removed_id string")).collect()
    assert [(r.sha1, len(r.ids)) for r in got] == [("many", 59)]


def test_empty_and_null_records(spark):
    """No operator fails on tables without rows, or on records that have nothing but an id."""
    blank = [person(i, **{k: None for k in S.LONG if k != "id"}) for i in range(3)]
    for p in (spark.createDataFrame([], S.PERSON), people(spark, *blank)):
        e = resolve.score(p, resolve.candidates(p))
        cl = resolve.split(e, resolve.is_strong())
        after, audit = resolve.merge(p, cl, e)
        assert e.count() == 0 and cl.count() == 0 and audit.count() == 0 and after.count() == p.count()
        assert resolve.conservative_dedup(p.withColumn("ordinal", F.col("id")))[0].count() == p.count()
        assert classify.reassign(p)[0].count() == classify.reassign_v1(p)[0].count() == p.count()
        raw = spark.createDataFrame([], "id string, title string, fa_url string, en_url string, pageid int, label_en string, birth string, death string")
        assert enrich.enrich(p, raw, spark.createDataFrame([], "title string"))[0].count() == p.count()
        m = p.select("id", "name", "event", "city", "photo_url", "name_en", "notable", F.lit(None).cast("string").alias("data_json"))
        none = spark.createDataFrame([], "id string, fields map<string,string>, notable boolean")
        assert moderation.edit_people(m, none)[0].count() == p.count() and moderation.set_notable(m, none.select("id", "notable")).count() == p.count()


def test_extra_columns_are_carried(spark):
    """Columns of names that the operators use themselves."""
    extra = {k: F.lit(7) for k in ("rank", "component", "nm", "st", "reason", "n", "size")}
    p = people(spark, person(1, name="علی احمدی", city="x"), person(2, name="علی احمدی", city="x"), person(3, name="رضا"))
    e = resolve.score(p.withColumns(extra), resolve.candidates(p.withColumns(extra)))
    assert [r.reason for r in e.collect()] == ["NAME_EQ+ctx"]
    q = p.withColumns({k: v for k, v in extra.items() if k not in ("rank", "component")})
    out, _ = classify.reassign(q)
    assert out.columns == q.columns and out.where("nm = 7").count() == 3


def test_blocks_are_scored_without_their_pairs(spark):
    """Tiers as by pairs, and of a block of unlike names no pair is written or compared by its text."""
    from quern.sources import stage as stages

    rows = invented(seed=4)
    prints = hashes(rows)
    f = spark.createDataFrame([(f"jvn_{i:010x}", *(v[k] for k in ("sha1", "phash", "dhash", "face_phash"))) for i, v in prints.items()], "id string, sha1 string, phash string, dhash string, face_phash string")
    for args in ((as_people(spark, rows), f), (as_people(spark, rows),)):
        want = resolve.score(args[0], resolve.candidates(*args), *args[1:])
        assert sorted(map(str, resolve.duplicates(*args).collect())) == sorted(map(str, want.collect()))
    rng, before = random.Random(7), len(stages._made)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(120)]
    unlike = people(spark, *(person(i, name=f"{n} {n[::-1]}", city="x", birth_year=1300) for i, n in enumerate(names)))
    assert resolve.duplicates(unlike).count() == 0
    assert max(d.count() for d in stages._made[before:]) <= 240


def test_a_long_name_on_many_days(spark):
    """Rows of one name meet those of their day only: 12,000 rows are not 72 million comparisons."""
    import time

    n = 12_000
    base = people(spark, person(0, name="a b", city="x")).drop("id", "date_jalali")
    p = spark.range(n).crossJoin(base).withColumns({"ordinal": F.col("id"), "date_jalali": F.concat(F.lit("1400/"), (F.col("id") % 80 + 10).cast("string"), F.lit("/"), (F.floor(F.col("id") / 80) % 75 + 10).cast("int").cast("string"))})
    p = p.withColumn("id", F.concat(F.lit("jvn_"), F.lpad(F.col("id").cast("string"), 10, "0"))).select(*S.LONG, "ordinal")
    began = time.perf_counter()
    after, audit = resolve.conservative_dedup(p)
    got = {(r.kept_id, r.removed_id) for r in audit.collect()}
    assert got == {(f"jvn_{i:010d}", f"jvn_{i + 6000:010d}") for i in range(6000)} and after.count() == 6000
    assert time.perf_counter() - began < 40
