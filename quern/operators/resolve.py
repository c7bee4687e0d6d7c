"""Entity resolution: blocking, scoring, clustering, survivorship, review."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.functions import calendar as cal
from quern.functions import text as tx
from quern.functions.empties import empty_list, empty_number, empty_text, truthy
from quern.functions.similarity import ratio
from quern.operators.components import components
from quern.operators.stats import scalars
from quern.sources.stage import stage

#: Block sizes kept, distances of equal images and faces, rarity bounds, shares.
NAME_CAP, VISUAL_CAP = 800, 400
SAME_IMAGE, SAME_FACE, NEAR_FACE = 12, 18, 78
RARE_DATE, RARE_CITY, FUZZY_NAME, STORY_SHARE, STORY_LEAST = 25, 40, 0.88, 0.6, 40
SMALL_CLUSTER = 4
#: Weights of a record's completeness.
WEIGHTS = {
    "name": 1, "story": 6, "photo_url": 4, "date_jalali": 3, "city": 2, "age": 1, "birth_year": 1, "name_en": 1, "story_en": 3, "province": 1,
    "cause": 1, "occupation": 1, "gender": 1
}
NUMBERS, LISTS = ("age", "birth_year"), ("sources", "memorial_links")


def is_empty(name: str) -> Column:
    c = F.col(name)
    return empty_number(c) if name in NUMBERS else empty_list(c) if name in LISTS else empty_text(c)


#: Fields that the first measure of completeness counts.
FULLNESS = (
    "name_en", "gender", "age", "birth_year", "date_jalali", "date_gregorian", "city", "province", "cause", "occupation", "story", "story_en",
    "photo_url"
)


def completeness_v1() -> Column:
    n = sum((F.when(is_empty(f), 0).otherwise(1) for f in FULLNESS), F.lit(0))
    return n + F.coalesce(F.char_length("story"), F.lit(0)) / 200 + F.when(
        F.col("verification") == "documented", 0.5
    ).otherwise(0) + F.when(truthy(F.col("notable")), 0.3).otherwise(0)


def completeness() -> Column:
    n = sum((F.when(is_empty(f), 0).otherwise(w) for f, w in WEIGHTS.items()), F.lit(0))
    long = F.least(F.coalesce(F.char_length("story"), F.lit(0)), F.lit(600)) / 100
    return n + long + F.greatest(F.coalesce(F.size("sources"), F.lit(0)), F.lit(0)) + F.when(truthy(F.col("notable")), 5).otherwise(0)


def block_pairs(keyed: DataFrame, cap: int, key: str = "key", id_: str = "id") -> DataFrame:
    """Distinct pairs a < b of ids that share a key; keys with more than ``cap`` ids are skipped.

    The skip is part of the result's meaning, and bounds each key's pairs. The keys are
    staged, as counting them and both sides of the join need them.
    """
    k = stage(keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(id_).alias("i")).distinct())
    small = k.groupBy("k").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= cap)).select("k")
    k = k.join(small, "k")
    return k.alias("x").join(k.alias("y"), "k").where("x.i < y.i").select(F.col("x.i").alias("a"), F.col("y.i").alias("b")).distinct()


def shared_files(prints: DataFrame, least: int = 2) -> DataFrame:
    """(sha1, n, ids): image files that ``least`` records or more have, and the sorted set of those."""
    return prints.where("sha1 IS NOT NULL").groupBy("sha1").agg(
        F.array_sort(F.collect_set("id")).alias("ids")
    ).withColumn("n", F.size("ids")).where(F.col("n") >= least).select("sha1", "n", "ids")


def name_keys(people: DataFrame) -> DataFrame:
    """(id, key): the name's first token, if it has any, and the city's first word."""
    first, city = F.coalesce(F.get(tx.name_tokens(F.col("name")), F.lit(0)), F.lit("")), F.split(tx.norm_text(F.col("city")), " ")[0]
    keys = F.array(F.concat(F.lit("n:"), first), F.when(city != "", F.concat(F.lit("c:"), city)))
    return people.select("id", F.explode(F.array_compact(keys)).alias("key"))


def visual_keys(prints: DataFrame) -> DataFrame:
    """(id, key): two bands of three digits of the image hash, one of the face hash, and the content hash."""
    band = lambda c, at, tag: F.when(F.col(c) != "", F.concat(F.lit(tag), F.substring(c, at, 3)))
    keys = F.array_compact(
        F.array(
            F.when(F.col("sha1") != "", F.concat(F.lit("s:"), F.col("sha1"))), band("phash", 1, "p:"), band("phash", 4, "q:"),
            band("face_phash", 1, "f:")
        )
    )
    return prints.select("id", F.explode(keys).alias("key"))


def candidates(people: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b) of the two families of blocks."""
    out = block_pairs(name_keys(people), NAME_CAP)
    return out if prints is None else out.union(block_pairs(visual_keys(prints), VISUAL_CAP)).distinct()


def visual_level(x: str, y: str) -> Column:
    """2 the same image, 1 maybe the same face, 0 neither."""
    c = lambda t, n: F.col(f"{t}.{n}")
    d = lambda n: tx.hamming_hex(c(x, n), c(y, n))
    same = (
        (c(x, "sha1") != "") & (c(x, "sha1") == c(y, "sha1"))
    ) | (d("phash") <= SAME_IMAGE) | (d("dhash") <= SAME_IMAGE) | (d("face_phash") <= SAME_FACE)
    return F.when(F.coalesce(same, F.lit(False)), 2).when(d("face_phash") <= NEAR_FACE, 1).otherwise(0)


def features(people: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """Staged: what pairs of records are compared by; empty fields are null. ``name_bits`` and ``tok_bits`` count the letters of name and tokens."""
    p = people.withColumns({
        "nm": tx.norm_name(F.col("name")), "tok": tx.name_tokens(F.col("name")), "ct": F.nullif(tx.norm_text(F.col("city")), F.lit("")),
        "st": tx.norm_text(F.col("story")), "_md": cal.month_day(F.col("date_jalali")),
    })
    p = p.withColumn("md", F.col("_md.month") * 100 + F.col("_md.day"))
    dates = p.where("md is not null").groupBy("md").agg(F.count("*").alias("date_n"))
    cities = p.where("ct is not null").groupBy("ct").agg(F.count("*").alias("city_n"))
    p = p.join(dates, "md", "left").join(cities, "ct", "left")
    cols = ["id", "nm", "tok", "ct", "md", "st"]
    if prints is not None:
        p = p.join(prints.select("id", "sha1", "phash", "dhash", "face_phash"), "id", "left")
        cols += ["sha1", "phash", "dhash", "face_phash"]
    c, yes = F.col, lambda v: F.coalesce(v, F.lit(False))
    long = F.when(F.char_length("st") > STORY_LEAST, F.char_length("st"))
    return stage(
        p.select(
            *cols, F.nullif("age", F.lit(0)).alias("age"), F.nullif("birth_year", F.lit(0)).alias("birth_year"),
            yes(c("date_n") <= RARE_DATE).alias("rare_date"), yes(c("city_n") <= RARE_CITY).alias("rare_city"),
            F.filter(F.split("ct", " "), lambda w: F.length(w) > 2).alias("ctok"), long.alias("long_story"), F.char_length("nm").alias("name_n"),
            *[tx.letter_bits(c("nm"), i).alias(f"name_bits{i}") for i in (0, 1)],
            *[tx.letter_bits(F.array_join("tok", ""), i).alias(f"tok_bits{i}") for i in (0, 1)]
        )
    )


def compared(prints: bool) -> dict[str, Column]:
    """Conditions of a pair x, y of ``features`` that need no text similarity; null where a field is."""
    x, y = (lambda n: F.col(f"x.{n}")), (lambda n: F.col(f"y.{n}"))
    same = lambda n: x(n) == y(n)
    # letters that only one of the two names has are no part of a match, so the ratio is 1 less their share at most
    apart = sum((F.bit_count(x(f"name_bits{i}").bitwiseXOR(y(f"name_bits{i}"))) for i in (0, 1)), F.lit(0))
    least, total = F.least(x("long_story"), y("long_story")), x("long_story") + y("long_story")
    return {
        "same_file": (x("sha1") != "") & same("sha1") if prints else F.lit(False),
        "image": visual_level("x", "y") == 2 if prints else F.lit(False), "city": same("ct"), "ctok": F.arrays_overlap(x("ctok"), y("ctok")),
        "by": same("birth_year"), "age_eq": same("age"), "md_eq": same("md"), "rare_date": same("md") & x("rare_date"),
        "rare_city": same("ct") & x("rare_city"), "equal": (x("nm") != "") & same("nm"), "subset": tx.is_subset(x("tok"), y("tok")),
        "overlap": F.arrays_overlap(x("tok"), y("tok")), "long_story": 2.000001 * least >= STORY_SHARE * total,
        "near": apart <= (1.000001 - FUZZY_NAME) * (x("name_n") + y("name_n"))
    }


def may_be(prints: bool) -> Column:
    """What every pair has that a tier could hold for, told by a few comparisons of numbers and short texts."""
    x, y, f = (lambda n: F.col(f"x.{n}")), (lambda n: F.col(f"y.{n}")), compared(prints)
    yes = lambda c: F.coalesce(c, F.lit(False))
    # a subset's letters are all among those of the other
    within = lambda a, b: (a("tok_bits0").bitwiseAND(b("tok_bits0")) == a("tok_bits0")) & (
        a("tok_bits1").bitwiseAND(b("tok_bits1")) == a("tok_bits1")
    )
    names = yes(f["equal"]) | within(x, y) | within(y, x)
    named = names & (yes(f["city"]) | yes(f["by"]) | yes(f["md_eq"]) | yes(f["age_eq"]) | yes(f["ctok"]))
    out = named | yes(f["long_story"]) | (yes(f["near"]) & yes(f["city"]) & (yes(f["by"]) | yes(f["rare_date"])))
    if not prints:
        return out
    hashed = lambda t: t("phash").isNotNull() | t("dhash").isNotNull() | t("face_phash").isNotNull()
    return out | yes(f["same_file"]) | (hashed(x) & hashed(y))


def flagged(pairs: DataFrame, prints: bool) -> DataFrame:
    """(a, b, conditions) of joined pairs x, y."""
    flags = [F.coalesce(v, F.lit(False)).alias(k) for k, v in compared(prints).items()]
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), *flags)


def score(people: DataFrame, pairs: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """(a, b, reason, conf, same_file) of pairs that are duplicates, by the first tier that holds; same_file: their images are the same bytes."""
    p = features(people, prints)
    j = pairs.join(p.alias("x"), F.col("a") == F.col("x.id")).join(p.alias("y"), F.col("b") == F.col("y.id"))
    return tiers(p, stage(flagged(j.where(may_be(prints is not None)), prints is not None)))


def duplicates(people: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """``score`` of ``candidates``, without writing these: a block's records meet with what they are compared by, and only pairs that may be duplicates go on."""
    p, with_prints = features(people, prints), prints is not None
    families = [(name_keys(people), NAME_CAP)] + ([(visual_keys(prints), VISUAL_CAP)] if with_prints else [])
    found = None
    for keys, cap in families:
        k = stage(keys.where("key IS NOT NULL").distinct())
        small = k.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= cap)).select("key")
        k = stage(k.join(small, "key").join(p, "id"))
        # dealt by key, not broadcast: the work is the pairs, not the bytes
        one = flagged(k.alias("x").hint("merge").join(k.alias("y"), "key").where(F.col("x.id") < F.col("y.id")).where(may_be(with_prints)), with_prints)
        found = one if found is None else found.unionByName(one)
    return tiers(p, stage(found.distinct()))


def tiers(p: DataFrame, j: DataFrame) -> DataFrame:
    """(a, b, reason, conf, same_file) of flagged pairs of ``features``.

    Similarities run only on pairs whose cheap conditions leave them open, in passes of their own:
    names and stories travel with the pairs that need them only, and are joined to those again.
    """
    c, yes = F.col, lambda v: F.coalesce(v, F.lit(False))
    texts = p.select("id", "nm", "st")
    with_texts = lambda d: d.join(texts.toDF("a", "nx", "sx"), "a").join(texts.toDF("b", "ny", "sy"), "b")
    sure = (c("equal") & (c("city") | c("ctok") | c("by") | c("image") | c("md_eq") | c("age_eq"))) | (
        c("subset") & (c("city") | c("ctok") | c("image") | c("by") | c("rare_date") | c("age_eq"))
    )
    needs_story = c("long_story") & (c("image") | c("overlap") | c("city")) & ~(sure & ~c("image"))
    with_story = with_texts(j.where(needs_story)).select("a", "b", (ratio(c("sx"), c("sy")) >= STORY_SHARE).alias("story"))
    needs_name = c("city") & ~sure & c("near") & (c("by") | c("rare_date") | c("image") | c("long_story"))
    with_name = with_texts(j.where(needs_name)).select("a", "b", (ratio(c("nx"), c("ny")) >= FUZZY_NAME).alias("fuzzy"))
    j = j.join(with_story, ["a", "b"], "left").join(with_name, ["a", "b"], "left")
    story, fuzzy = yes(c("story")), yes(c("fuzzy"))
    tier = lambda r, k: F.struct(F.lit(r).alias("reason"), F.lit(k).alias("conf"))
    got = (
        F.when(c("image") & (c("overlap") | c("by") | story | c("rare_date") | c("rare_city")), tier("SAME_IMG+corrob", 0.97))
        .when(c("equal") & (c("city") | c("ctok") | c("by") | c("image") | c("md_eq") | c("age_eq")), tier("NAME_EQ+ctx", 0.92))
        .when(c("subset") & (c("city") | c("ctok") | c("image") | c("by") | c("rare_date") | c("age_eq")), tier("NAME_SUBSET+ctx", 0.90))
        .when(fuzzy & c("city") & (c("by") | c("rare_date") | story | c("image")), tier("NAME_FUZZY+strong_ctx", 0.85))
        .when(story & c("overlap"), tier("STORY+name", 0.84))
    )
    return j.withColumn("t", got).where("t is not null").select("a", "b", "t.reason", "t.conf", "same_file")


def split(edges: DataFrame, strong: Column, small: int = SMALL_CLUSTER) -> DataFrame:
    """(node, component) of edges (a, b, ...): components over ``small`` hold together by ``strong`` edges only.

    Whatever is alone then is in no cluster.
    """
    edges = stage(edges)
    comp = stage(components(edges, "a", "b"))
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    kept = comp.join(size.where(F.col("n") <= small), "component").select("node", "component")
    big = comp.join(size.where(F.col("n") > small), "component").select("node")
    inner = edges.where(strong).join(big, edges.a == big.node, "left_semi")
    return kept.unionByName(components(inner, "a", "b"))


#: Reasons of the name family.
NAME_FAMILY = ["NAME_EQ+ctx", "NAME_SUBSET+ctx", "NAME_FUZZY+strong_ctx"]


def is_strong() -> Column:
    """Of the edges of ``score``: the same image file, or a reason of the name family."""
    return F.col("reason").isin(NAME_FAMILY) | F.col("same_file")


def reasons(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(component, reasons): sorted distinct reasons of the edges within each cluster."""
    at = lambda k, n: clusters.select(F.col("node").alias(k), F.col("component").alias(n))
    inner = edges.join(at("a", "component"), "a").join(at("b", "_other"), "b").where(F.col("component") == F.col("_other"))
    return inner.groupBy("component").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def merge(people: DataFrame, clusters: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(people after merging, audit): the most complete record of a cluster survives.

    Empty fields take the first value in order of completeness, the longer story wins, lists
    are united in that order, notable if any is. A differing age or photo is logged. Ties go
    by id. The audit has what changed: field, value before and after, and the record it is
    from; and, given ``edges``, the reasons of each cluster. Clusters are record-sized groups.
    """
    c = F.col
    m = people.join(clusters, people.id == clusters.node).drop("node")
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy("component").orderBy(completeness().desc(), "id")))
    plain = [x for x in people.columns if x not in ("id", "story", "story_en", "notable", *LISTS)]
    longer = [x for x in ("story", "story_en") if x in people.columns]
    first = lambda n: F.min_by(c(n), F.when(~is_empty(n), c("rank"))).alias(n)
    longest = lambda n: F.max_by(c(n), F.struct(F.coalesce(F.char_length(n), F.lit(0)), -c("rank"))).alias(n)
    ranked = lambda n: F.array_sort(F.collect_list(F.struct("rank", c(n).alias("v"))))
    united = lambda n: F.aggregate(
        ranked(n), F.array().cast("array<string>"), lambda acc, r: F.array_union(acc, F.coalesce(r["v"], F.array().cast("array<string>")))
    ).alias(n)
    others = lambda n: F.array_sort(F.collect_set(F.when((c("rank") > 1) & ~is_empty(n), c(n).cast("string"))))
    # of each field that may change: the base's value, and the record that the new one is from
    base = lambda n: F.min_by(c(n).cast("string"), "rank").alias(f"_was_{n}")
    source = lambda n: F.min_by("id", F.when(~is_empty(n), c("rank"))).alias(f"_by_{n}")
    origin = lambda n: F.max_by("id", F.struct(F.coalesce(F.char_length(n), F.lit(0)), -c("rank"))).alias(f"_by_{n}")
    g = m.groupBy("component").agg(
        F.min_by("id", "rank").alias("id"), *map(first, plain), *map(longest, longer), F.bool_or(F.coalesce("notable", F.lit(False))).alias("notable"), *map(united, LISTS),
        F.array_sort(F.collect_list(F.when(c("rank") > 1, c("id")))).alias("merged_ids"), F.array_sort(
            F.collect_list(F.when(c("rank") > 1, c("name")))
        ).alias("merged_names"),
        others("age").alias("ages"), others("photo_url").alias("photos"), *map(base, plain + longer), *map(source, plain), *map(origin, longer),
    )
    show = lambda n: F.when(
        (c(n).cast("string") != "") & ~c(n).cast("string").eqNullSafe(c(f"_was_{n}")),
        F.struct(
            F.lit(n).alias("field"), F.substring(c(f"_was_{n}"), 1, 40).alias("before"), F.substring(c(n).cast("string"), 1, 40).alias("after"),
            c(f"_by_{n}").alias("src")
        )
    )
    g = g.withColumn("changes", F.array_compact(F.array(*map(show, plain + longer))))
    audit = g.select(
        "component", c("id").alias("kept_id"), c("name").alias("kept_name"), "merged_ids", "merged_names", "changes",
        F.array_except("ages", F.array(c("age").cast("string"))).alias("age_conflicts"),
        F.array_except("photos", F.array("photo_url")).alias("alt_photos")
    )
    if edges is not None:
        audit = audit.join(reasons(edges, clusters), "component", "left")
    rest = people.join(clusters, people.id == clusters.node, "left_anti")
    return rest.unionByName(g.select(*people.columns)), audit.drop("component")


def merge_summary(people: DataFrame, after: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: records before and after, clusters, records removed."""
    n = lambda d, k: d.agg(F.count("*").alias(k))
    return scalars(
        b=n(people, "before"), a=n(after, "after"),
        c=audit.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.size("merged_ids")), F.lit(0)).alias("removed"))
    )


@F.pandas_udf(T.BooleanType())
def all_related(names: pd.Series) -> pd.Series:
    """Whether every two of a group's names (as token arrays in their text) are a subset of each other or alike."""
    from difflib import SequenceMatcher

    def related(a: str, b: str) -> bool:
        short, long = sorted(([w for w in x.split() if len(w) > 1] for x in (a, b)), key=len)
        rest = iter(long)
        return (
            bool(short) and (short == long or (len(short) > 1 and all(w in rest for w in short)))
        ) or bool(a and b) and SequenceMatcher(None, a, b).ratio() >= FUZZY_NAME

    return pd.Series([all(related(a, b) for i, a in enumerate(x) for b in x[i + 1 :]) for x in map(list, names)], dtype=bool)


def review(people: DataFrame, prints: DataFrame, removed: DataFrame) -> DataFrame:
    """(sha1, ids): records that share an image though not all their names are related.

    The least and the greatest name of an image settle nearly all of them: an image of
    many unlike people is told by those two, and its names are never gathered. Only of images
    whose two are related the distinct names, spellings of one by then, are compared.
    """
    p = people.join(removed, people.id == removed.removed_id, "left_anti").join(prints.select("id", "sha1"), "id").where("sha1 != ''")
    p = stage(p.select("id", "sha1", tx.norm_name(F.col("name")).alias("nm")).distinct())
    two = p.groupBy("sha1").agg(F.min("nm").alias("lo"), F.max("nm").alias("hi")).where("lo != hi")
    two = stage(two.select("sha1", all_related(F.array("lo", "hi")).alias("near")))
    close = p.join(two.where("near"), "sha1", "left_semi").groupBy("sha1").agg(F.array_sort(F.collect_set("nm")).alias("names"))
    apart = two.where("NOT near").select("sha1").unionByName(close.where(~all_related(F.col("names"))).select("sha1"))
    return p.join(apart, "sha1", "left_semi").groupBy("sha1").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def conservative_dedup(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People after the conservative first pass, and (name, kept_id, kept_event, removed_id, removed_event).

    Within one normalised name, rows in order of ``ordinal``: each row not yet removed is a
    seed and gathers the later rows with a similar story, or the same city and day with
    further evidence. The fullest of them stays and takes what it lacks from the others,
    with sources united and sorted; a keeper may be gathered again by a later seed, and
    is compared as it is by then. Depends on the order of rows, so a name is one task. A seed
    meets only rows of its own day, and those with a story long enough if it has one; a day that
    a keeper takes over counts from then on.
    """
    cols = people.withColumns(
        {
            "__nm": tx.norm_name_v1(F.col("name")), "__st": tx.norm_text_v1(F.col("story")), "__ct": F.trim(F.coalesce("city", F.lit(""))),
            "__md": cal.month_day_text(F.col("date_jalali"))
        }
    )
    single = cols.where("__nm = ''")
    many = cols.where("__nm != ''")
    fields = [f for f in people.columns if f not in ("id", "event", "ordinal")]
    out_schema = T.StructType([*people.schema.fields, T.StructField("__into", people.schema["id"].dataType), T.StructField("__at", T.IntegerType())])

    shape = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        def share(a: str, b: str, least: float) -> float:
            """The ratio, or 0 where a bound of it is not over ``least``."""
            m = SequenceMatcher(None, a, b)
            return m.ratio() if m.real_quick_ratio() > least and m.quick_ratio() > least else 0.0

        empty = lambda v: v is None or v in ("", 0, [])
        told = lambda r: len(r["__st"]) > 25

        def alike(s: dict, o: dict) -> bool:
            day = bool(s["__md"] and s["__md"] == o["__md"])
            near = share(s["__st"], o["__st"], 0.6 if day else 0.82) if told(s) and told(o) else 0.0
            if near > 0.82:
                return True
            a, b = s["__ct"], o["__ct"]
            if not (day and a and b and (a in b or b in a or share(a, b, 0.7) > 0.7)):
                return False
            agree = any(not empty(s[k]) and s[k] == o[k] for k in ("age", "birth_year"))
            return near > 0.6 or agree or not s["__st"] or not o["__st"]

        def absorb(keeper: dict, other: dict) -> None:
            for k in fields:
                v = other[k]
                if empty(v):
                    continue
                if empty(keeper[k]):
                    keeper[k] = v
                elif k == "sources":
                    keeper[k] = sorted(set(keeper[k]) | set(v))
            for k, of in (("__st", "story"), ("__ct", "city"), ("__md", "date_jalali")):
                if not keeper[k] and not empty(keeper[of]):  # filled just now
                    keeper[k] = other[k]

        def fullness(r: dict) -> float:
            n = sum(not empty(r[f]) for f in FULLNESS)
            return n + len(r["story"] or "") / 200 + 0.5 * (r["verification"] == "documented") + 0.3 * bool(r["notable"])

        def settled(rows: list[dict]) -> list[dict]:
            """Rows of one name, by ``ordinal``, each with the row that it went into."""
            rows = sorted(rows, key=lambda r: r["ordinal"])
            days: dict[str, list[int]] = {}
            tales = [k for k, r in enumerate(rows) if told(r)]
            for k, r in enumerate(rows):
                if r["__md"]:
                    days.setdefault(r["__md"], []).append(k)
            gone: dict[int, tuple] = {}
            for i, s in enumerate(rows):
                if i in gone:
                    continue
                day = days.get(s["__md"], [])
                # past rows and those gone are not met again
                day[:] = [k for k in day if k > i and k not in gone]
                meets = day
                if told(s):
                    tales[:] = [k for k in tales if k > i and k not in gone]
                    meets = sorted({*day, *tales})
                star = [i, *(k for k in meets if alike(s, rows[k]))]
                best = max(star, key=lambda k: (fullness(rows[k]), -k))
                was = rows[best]["__md"], told(rows[best])
                for k in star:
                    if k != best:
                        absorb(rows[best], rows[k])
                        gone[k] = (rows[best]["id"], len(gone))
                if rows[best]["__md"] != was[0]:
                    insort(days.setdefault(rows[best]["__md"], []), best)
                if told(rows[best]) != was[1]:
                    insort(tales, best)
            for k, r in enumerate(rows):
                r["__into"], r["__at"] = gone.get(k, (None, None))
            return rows

        def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
            # columns that are null throughout are not converted
            values = [x.to_pylist() if x.null_count < len(x) else [None] * len(x) for x in batch.columns]
            return (dict(zip(batch.schema.names, v)) for v in zip(*values))

        def written(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, shape)

        one: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for r in rows_of(batch):
                if one and one[0]["__nm"] != r["__nm"]:
                    out += settled(one)
                    one = []
                one.append(r)
            if out:
                yield written(out)
        if one:
            yield written(settled(one))

    # names lie one after the other in sorted partitions, so that a batch holds many of them
    done = stage(many.repartition("__nm").sortWithinPartitions("__nm").mapInArrow(run, out_schema))
    after = done.where("__into IS NULL").select(*people.columns).unionByName(single.select(*people.columns))
    keepers = people.select(F.col("id").alias("__into"), F.col("event").alias("kept_event"))
    audit = done.where("__into IS NOT NULL").join(keepers, "__into", "left")
    return after, audit.select(
        tx.norm_name_v1(F.col("name")).alias("name"), F.col("__into").alias("kept_id"), "kept_event", F.col("id").alias("removed_id"),
        F.col("event").alias("removed_event")
    )


def apply_merges(people: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Literal merges (keep, dup); a pair with a missing end is skipped. People after, and an audit."""
    good = pairs.join(people.select(F.col("id").alias("keep")), "keep", "left_semi").join(people.select(F.col("id").alias("dup")), "dup", "left_semi")
    clusters = good.select(F.col("keep").alias("component"), F.col("dup").alias("node"))
    clusters = clusters.unionByName(good.select(F.col("keep").alias("component"), F.col("keep").alias("node")).distinct())
    c = F.col
    m = people.join(clusters, people.id == clusters.node).withColumn(
        "rank", F.when(c("id") == c("component"), F.lit("")).otherwise(c("id").cast("string"))
    )
    first = lambda n: F.min_by(c(n), F.when(~is_empty(n), c("rank"))).alias(n)
    united = lambda n: F.aggregate(
        F.array_sort(F.collect_list(F.struct("rank", c(n).alias("v")))), F.array().cast("array<string>"), lambda a,
        r: F.array_union(a, F.coalesce(r["v"], F.array().cast("array<string>")))
    ).alias(n)
    g = m.groupBy("component").agg(
        *[first(n) for n in people.columns if n not in ("id", "notable", *LISTS)], F.bool_or(F.coalesce("notable", F.lit(False))).alias("notable"),
        *map(united, LISTS)
    ).withColumnRenamed("component", "id")
    return people.join(clusters, people.id == clusters.node, "left_anti").unionByName(g.select(*people.columns)), good
