"""Reassigning records to events by their dates and stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import calendar as cal
from quern.functions.text import fold_digits

#: Events by year, of the first and of the later pass, and stories that are no record.
EVENT_YEARS = {
    "kuye_daneshgah_78": 1378, "green_88": 1388, "dey_96": 1396, "darvish_96": 1396, "mordad_97": 1397, "kazerun_97": 1397, "aban_98": 1398,
    "khuzestan_1400": 1400, "khizesh_1401": 1401, "khizesh_1404": 1404
}
YEARS_V1 = {
    1378: "kuye_daneshgah_78", 1388: "green_88", 1396: "dey_96", 1397: "mordad_97", 1398: "aban_98", 1400: "khuzestan_1400", 1401: "khizesh_1401",
    1404: "khizesh_1404"
}
YEARS = {1377: "chain_murders_77", **YEARS_V1, 1402: "dey_1402", 1403: "dey_1403"}
DERVISH, DEY = "دراویش|درویش|گنابادی", "دی"
JUNK = [r"تام\s*مورلی", r"محل\s*دفن\s*او\s*فاضلاب", r"وحوش\s*انگلیسی", r"حمله\s*انگلیسی", r"هواپیمای\s*فوکر"]


def event_of(year: Column, years: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in years.items() for x in kv]), year)


def _audit(d: DataFrame, target: Column, reason: Column, conf: Column) -> tuple[DataFrame, DataFrame]:
    keep = [c for c in d.columns if not c.startswith("_")]
    d = d.withColumns({"_to": target, "_why": reason, "_conf": conf})
    moved = d.where(F.col("_to") != F.coalesce("event", F.lit("")))
    audit = moved.select(
        "id", "name", F.col("event").alias("from"), F.col("_to").alias("to"), F.col("_why").alias("reason"), F.col("_conf").alias("confidence"),
        "date_jalali", F.substring("story", 1, 140).alias("story_excerpt")
    )
    return d.withColumn("event", F.coalesce("_to", "event")).select(*keep), audit


def reassign_v1(people: DataFrame, event_years: dict[str, int] | None = None, years: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """People and audit after the first pass: the best year picks the event; other events stay."""
    event_years, years = event_years or EVENT_YEARS, years or YEARS_V1
    d = people.withColumn("_sy", cal.story_year_v1.asNondeterministic()(cal.tells_year(F.col("story"))))
    d = d.withColumn("_y", cal.best_year(F.col("date_jalali"), F.col("date_gregorian"), F.col("_sy")))
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in event_years.items() for x in kv]), F.col("event"))
    y = F.col("_y.year")
    target = event_of(y, years)
    open_ = own.isNotNull() & (y != own) & target.isNotNull() & (target != F.col("event"))
    named = F.when((y == 1396) & F.coalesce("story", F.lit("")).rlike(DERVISH), "darvish_96").otherwise(target)
    return _audit(d, F.when(open_, named), F.col("_y.source"), F.lit("medium"))


def is_junk(story: Column, date_jalali: Column) -> Column:
    out = F.coalesce(cal.jalali_year(date_jalali) < cal.FIRST_YEAR, F.lit(False))
    for p in JUNK:
        out |= F.coalesce(story, F.lit("")).rlike(p)
    return out


def reassign(people: DataFrame, years: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """People and audit after the trust-ordered pass.

    Junk goes to review; events without a year of their own stay. Then, the first that
    has an event: a sure story; a date with month; a bare year, unless a story says
    otherwise; a story alone. The special case of 1400 holds in the first two steps.
    """
    years = years or YEARS
    c = F.col
    # named nondeterministic, so that the optimizer computes it once a row and not again under a filter
    d = people.withColumn("_sy", cal.story_year.asNondeterministic()(cal.tells_year(c("story"))))
    # each a column of its own, so that it is computed once however often the rules name it
    d = d.withColumns(
        {
            "_dj": cal.jalali_year(c("date_jalali")), "_month": cal.has_month(c("date_jalali")),
            "_dey": F.contains(F.coalesce("story", F.lit("")), F.lit(DEY)), "_junk": is_junk(c("story"), c("date_jalali")),
            "_fixed": ~F.coalesce(c("event").isin(list(years.values())), F.lit(False)), "_s": c("_sy.year"), "_c": c("_sy.conf")
        }
    )
    d = d.withColumns({"_es": event_of(c("_s"), years), "_ed": event_of(c("_dj"), years)})
    special = lambda y, e: F.when((y == 1400) & c("_dey"), F.lit("khizesh_1401")).otherwise(e)
    told, bare = c("_c").isin("high", "medium"), c("_ed").isNotNull() & ~c("_month")
    year = lambda tag, y: F.concat(F.lit(tag), y.cast("string"))
    steps = (
        (c("_c") == "high", special(c("_s"), c("_es")), year("story_year=", c("_s")), F.lit("high")),
        (c("_month"), special(c("_dj"), c("_ed")), year("date_year=", c("_dj")), F.lit("medium")),
        (bare & told & (c("_s") != c("_dj")), c("_es"), year("story_year_over_date=", c("_s")), c("_c")),
        (~c("_month"), c("_ed"), year("date_year_only=", c("_dj")), F.lit("medium")),
        (c("_dj").isNull() & told, c("_es"), year("story_year_no_date=", c("_s")), c("_c")),
    )
    # the target, by which rows are kept, stands alone: the optimizer writes it out wherever it is named
    target = F.when(c("_junk"), "needs_review").when(c("_fixed"), c("event")).otherwise(F.coalesce(*[F.when(when, to) for when, to, _, _ in steps]))
    fixed = lambda why, how: F.struct(F.lit(why).alias("why"), F.lit(how).alias("conf"))
    taken = F.coalesce(*[F.when(when & to.isNotNull(), F.struct(why.alias("why"), how.alias("conf"))) for when, to, why, how in steps])
    d = d.withColumn("_y", F.when(c("_junk"), fixed("junk_or_invalid", "high")).when(c("_fixed"), fixed("protected_event", "n/a")).otherwise(taken))
    return _audit(d, target, c("_y.why"), c("_y.conf"))


def revert(current: DataFrame, backup: DataFrame, event: str = "khizesh_1404", year: int = 1400) -> tuple[DataFrame, DataFrame]:
    """Undo moves into ``event`` of rows whose Jalali date is of ``year``. People after, and an audit."""
    b = backup.select(F.col("id").alias("_id"), F.col("event").alias("_was"))
    j = current.join(b, current.id == F.col("_id"), "left")
    back = (F.col("event") == event) & (F.col("_was") != event) & (cal.jalali_year(F.col("date_jalali"), "full") == year)
    j = j.withColumn("_back", F.coalesce(back, F.lit(False)))
    audit = j.where("_back").select("id", F.col("event").alias("from"), F.col("_was").alias("to"))
    return j.withColumn("event", F.when(F.col("_back"), F.col("_was")).otherwise(F.col("event"))).select(*current.columns), audit


def drop_tests(people: DataFrame, marker: str = "تست") -> DataFrame:
    return people.where(~(F.contains(F.coalesce("name", F.lit("")), F.lit(marker)) | (F.lower(F.coalesce("name", F.lit(""))) == "test")))


def apply_corrections(people: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Literal corrections (id, event). People after, and (id, event, status) of every correction."""
    f = fixes.select(F.col("id").alias("_id"), F.col("event").alias("_to"))
    out = people.join(f, people.id == F.col("_id"), "left").withColumn("event", F.coalesce("_to", "event")).select(*people.columns)
    known = people.select(F.col("id").alias("_k"), F.col("event").alias("_was"))
    status = F.when(F.col("_k").isNull(), "NOT FOUND").when(F.col("_was") == F.col("event"), "unchanged").otherwise("moved")
    return out, fixes.join(known, F.col("id") == F.col("_k"), "left").select("id", "event", status.alias("status"))


def repair_dates(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the Jalali date's year is out of range and the Gregorian field holds a Jalali date, move and convert."""
    c = F.col
    y = F.regexp_extract(fold_digits(c("date_jalali")), r"^(\d{3,4})", 1).try_cast("int")
    p = r"^(1[34]\d\d)[/-](\d{1,2})[/-](\d{1,2})"
    gy, gm, gd = (F.regexp_extract(fold_digits(c("date_gregorian")), p, i).try_cast("int") for i in (1, 2, 3))
    broken = (y.isNull() | ~y.between(1300, 1410)) & gy.isNotNull()
    d = people.withColumn("_fix", F.coalesce(broken, F.lit(False)))
    fixed = d.withColumns(
        {
            "date_jalali": F.when(c("_fix"), F.format_string("%d/%02d/%02d", gy, gm, gd)).otherwise(c("date_jalali")),
            "date_gregorian": F.when(c("_fix"), cal.from_jalali(gy, gm, gd).cast("string")).otherwise(c("date_gregorian"))
        }
    )
    return fixed.select(*people.columns), d.where("_fix").select("id", "date_jalali", "date_gregorian")
