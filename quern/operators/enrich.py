"""Fill-if-empty enrichment from landed encyclopedia data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import calendar as cal
from quern.functions.empties import empty_number, empty_text
from quern.functions.text import commons_url, media_file, path_tail

#: Parts of file names that are no portrait's.
BAD_FILES = [
    "solidarity", "colage", "collage", "protest", "demonstration", "rally", "mural", "placard", "banner", "memorial_park", "statue", "iep2009", ".svg"
]


def fill(old: Column, new: Column, number: bool = False) -> Column:
    """The old value unless it is empty."""
    return F.when(empty_number(old) if number else empty_text(old), F.coalesce(new, old)).otherwise(old)


def enrich(people: DataFrame, raw: DataFrame, blacklist: DataFrame, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """People with empty fields filled, and (id, fields) of those filled.

    ``raw``: id, title, fa_url, en_url, pageid, label_en, birth, death (encyclopedia times).
    ``blacklist``: title; its pages give nothing. ``images``: id, url, status; verified ones only.
    """
    c = F.col
    ok = raw.join(blacklist.select("title"), "title", "left_anti").withColumnRenamed("id", "_id")
    j = people.join(ok, people.id == c("_id"), "left")
    birth, death = cal.parse_wd_time(c("birth")), cal.parse_wd_time(c("death"))
    has = c("_id").isNotNull()
    links = F.array_union(c("memorial_links"), F.array_compact(F.array("fa_url", "en_url")))
    tags = F.array_compact(
        F.array(
            F.when(c("pageid").isNotNull(), F.lit("wikipedia_fa")),
            F.when(c("label_en").isNotNull() | birth.isNotNull() | death.isNotNull(), F.lit("wikidata"))
        )
    )
    new = {
        "name_en": fill(c("name_en"), c("label_en")),
        "birth_year": fill(c("birth_year"), cal.to_jalali(birth)["y"], True),
        "date_gregorian": fill(c("date_gregorian"), death.cast("string")),
        "date_jalali": fill(c("date_jalali"), cal.jalali_text(death)),
        "memorial_links": F.when(has, links).otherwise(c("memorial_links")),
        "sources": F.when(has, F.array_union("sources", tags)).otherwise(c("sources")),
    }
    changed = F.array_compact(F.array(*[F.when(~v.eqNullSafe(c(k)), F.lit(k)) for k, v in new.items()]))
    out = j.select("id", changed.alias("fields"), *[new.get(k, c(k)).alias(k) for k in people.columns if k != "id"])
    report = out.where(F.size("fields") > 0).select("id", "fields")
    out = out.select(*people.columns)
    if images is not None:
        good = images.where("status = 'verified'").select(c("id").alias("_id"), "url").dropDuplicates(["_id"])
        out = out.join(good, out.id == c("_id"), "left").withColumn("photo_url", fill(c("photo_url"), c("url"))).select(*people.columns)
    return out, report


def bad_file(name: Column, tokens: list[str] | None = None) -> Column:
    low = F.lower(name)
    return F.exists(F.array(*map(F.lit, tokens or BAD_FILES)), lambda t: F.contains(low, t))


def choose_image(raw: DataFrame, blacklist: DataFrame) -> DataFrame:
    """(id, status, source, url): the first acceptable of the Wikidata file and the images of the Persian and English pages.

    ``wd_image`` is a file name, of which the archive's address is made; of the others,
    addresses, the last part of the path is the name that is looked at.
    """
    c = F.col
    one = lambda s, name, url: F.struct(F.lit(s).alias("source"), name.alias("name"), url.alias("url"))
    cand = F.array(
        one("wikidata_P18", c("wd_image"), F.when(c("wd_image") != "", commons_url(c("wd_image")))),
        *[one(s, path_tail(c(k)), c(k)) for s, k in (("fa_pageimage", "fa_image"), ("en_pageimage", "en_image"))]
    )
    first = F.get(F.filter(cand, lambda x: x["url"].isNotNull() & (x["url"] != "") & ~bad_file(x["name"])), F.lit(0))
    bl = blacklist.select(c("title").alias("_t")).distinct()
    d = raw.join(bl, c("title") == c("_t"), "left").withColumn("pick", F.when(c("_t").isNull(), first))
    status = F.when(c("_t").isNotNull(), "blacklist").when(c("pick").isNull(), "need_search").otherwise("wiki")
    return d.select("id", status.alias("status"), "pick.source", "pick.url")


def resolve_images(decisions: DataFrame, info: DataFrame) -> DataFrame:
    """Chosen images with what is known of their files (name, host, url, thumb, mime, width, height).

    A chosen image (status wiki) becomes resolved, or need_search with a reason: bad_url,
    no_info or bad_type. Other decisions stay as they are.
    """
    c = F.col
    i = info.select(
        c("name").alias("_n"), c("host").alias("_h"), c("url").alias("photo_fullres"), F.coalesce("thumb", "url").alias("photo_direct"), "mime",
        "width", "height"
    ).dropDuplicates(["_n", "_h"])
    d = decisions.withColumn("_f", F.when(c("status") == "wiki", media_file(c("url"))))
    j = d.join(i, (c("_f.name") == c("_n")) & (c("_f.host") == c("_h")), "left")
    picture = F.coalesce(c("mime").startswith("image") & ~F.contains("mime", F.lit("svg")), F.lit(False))
    why = F.when(
        (c("status") != "wiki") | c("url").isNull(), None
    ).when(c("_f").isNull(), "bad_url").when(c("_n").isNull(), "no_info").when(~picture, "bad_type")
    good = (c("status") == "wiki") & c("url").isNotNull() & why.isNull()
    told = lambda k: F.when(good, c(k)).alias(k)
    return j.select(
        "id", F.when(why.isNotNull(), "need_search").when(good, "resolved").otherwise(c("status")).alias("status"), why.alias("reason"), "source",
        "url", *map(told, ("photo_direct", "photo_fullres", "mime", "width", "height"))
    )
