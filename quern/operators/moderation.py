"""Moderation as pure transitions: tables and commands in, new tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators.stats import scalars


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with the same key; of several the first in ``order``."""
    if order:
        new = latest(new, [key], order)
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def setting(settings: DataFrame, key: str, default: str) -> DataFrame:
    """One row, column value: the setting or its default."""
    return settings.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))


def accepted(rows: DataFrame, known: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key exists, rows whose does not)."""
    return rows.join(known, on, "left_semi"), rows.join(known, on, "left_anti")


def valid_sessions(sessions: DataFrame, admins: DataFrame, now: Column) -> DataFrame:
    """(token, admin_id, state): ok, inactive or expired; sessions of no admin are left out."""
    a = admins.select(F.col("id").alias("admin_id"), "is_active")
    state = F.when(~F.col("is_active"), "inactive").when(F.col("expires_at") < now, "expired").otherwise("ok")
    return sessions.join(a, "admin_id").select("token", "admin_id", state.alias("state"))


def set_status(rows: DataFrame, commands: DataFrame, statuses: dict[str, str], id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """Apply (id, action, at): the last action's status; ``delete`` drops the row. Rows after, and commands without a row."""
    to = F.create_map(*[F.lit(x) for kv in statuses.items() for x in kv])
    last = latest(commands, [id_], [F.desc("at"), F.desc("action")]).select(F.col(id_).alias("_id"), F.col("action").alias("_action"))
    j = rows.join(last, F.col(id_) == F.col("_id"), "left").where(F.coalesce(F.col("_action") != "delete", F.lit(True)))
    out = j.withColumn("status", F.coalesce(F.try_element_at(to, F.col("_action")), F.col("status"))).select(*rows.columns)
    return out, commands.join(rows.select(id_), id_, "left_anti")


def auto_hide(comments: DataFrame, reports: DataFrame, threshold: int) -> DataFrame:
    """Add reports to their comments' counts; approved ones that reach the threshold by them become pending."""
    n = reports.groupBy(F.col("comment_id").alias("id")).agg(F.count("*").alias("_n"))
    c = comments.join(n, "id", "left").withColumn("report_count", F.col("report_count") + F.coalesce("_n", F.lit(0)))
    hide = F.col("_n").isNotNull() & (F.col("status") == "approved") & (F.col("report_count") >= threshold)
    return c.withColumn("status", F.when(hide, "pending").otherwise(F.col("status"))).select(*comments.columns)


def new_comment_status(mode: Column) -> Column:
    """Of a new comment: it waits where comments are approved beforehand, else it shows at once."""
    return F.when(mode == "pre_approve", "pending").otherwise("approved")


def merge_people(people: DataFrame, comments: DataFrame, photos: DataFrame, reports: DataFrame, merges: DataFrame) -> tuple[DataFrame, ...]:
    """Merges (keep, dup), both known: dependents move, the duplicate's reports are resolved and kept, the duplicate goes."""
    ok = merges.join(
        people.select(F.col("id").alias("keep")), "keep", "left_semi"
    ).join(people.select(F.col("id").alias("dup")), "dup", "left_semi").where("keep != dup")
    m = ok.select("dup", "keep")
    point = lambda d: d.join(
        m, F.col("person_id") == F.col("dup"), "left"
    ).withColumn("person_id", F.coalesce("keep", "person_id")).select(*d.columns)
    r = reports.join(m, F.col("person_id") == F.col("dup"), "left")
    r = r.withColumns(
        {
            "status": F.when(F.col("dup").isNotNull(), "resolved").otherwise(F.col("status")),
            "admin_note": F.when(F.col("dup").isNotNull(), "merged").otherwise(F.col("admin_note"))
        }
    ).select(*reports.columns)
    return people.join(m, people.id == m.dup, "left_anti"), point(comments), point(photos), r


def delete_people(people: DataFrame, dependents: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """People and each dependent table (person_id) without the ids."""
    gone = ids.select(F.col("id").alias("_gone"))
    drop = lambda d, k: d.join(gone, F.col(k) == F.col("_gone"), "left_anti")
    return drop(people, "id"), {n: drop(d, "person_id") for n, d in dependents.items()}


def patch(people: DataFrame, patches: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Sparse patches (id, fields map): only keys present change; blanks become null, ``int`` columns parse within 1 to 129."""
    j = people.join(patches.select(F.col("id").alias("_id"), "fields"), people.id == F.col("_id"), "left")
    for name, kind in columns.items():
        j = j.withColumn(
            name,
            F.when(
                F.coalesce(F.map_contains_key("fields", name), F.lit(False)), cleaned(F.try_element_at("fields", F.lit(name)), kind)
            ).otherwise(F.col(name))
        )
    return j.select(*people.columns)


def cleaned(v: Column, kind: str, most: int = 2000) -> Column:
    """A patch's value: a whole number of 1 to 129, or trimmed text of ``most`` characters; null if nothing is left."""
    return tx.int_prefix(v) if kind == "int" else F.nullif(tx.clean(v, most), F.lit(""))


#: Keys of a person's JSON that a patch may set, each with its kind, longest text and the column it mirrors.
PATCHED = {
    "n": ("text", 100, "name"), "ne": ("text", 100, "name_en"), "a": ("int", 3, None), "g": ("text", 20, None), "e": ("text", 40, "event"), "c": ("text", 60, "city"),
    "pr": ("text", 60, None), "dj": ("text", 30, None), "dg": ("text", 10, None), "ca": ("text", 200, None), "oc": ("text", 100, None), "s": ("text", 5000, None),
    "ph": ("url", 1000, "photo_url"), "src_text": ("text", 2000, None), "v": ("text", 20, None),
}


def edit_people(people: DataFrame, patches: DataFrame, keys: dict[str, tuple[str, int, str | None]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sparse patches (id, fields map, notable boolean or null) on mirror columns and data_json together.

    Only keys present change, both in the JSON, as null, number or string, and in the
    column they mirror. A patch is refused whole (id, why): its person is unknown, its photo is
    no http address, or it leaves a name of under two characters. One patch a person.
    """
    keys = keys or PATCHED
    p = patches.select(
        F.col("id").alias("_id"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("_f"), F.col("notable").alias("_nt")
    )
    has = lambda k: F.map_contains_key("_f", k)
    value = lambda k: cleaned(F.try_element_at("_f", F.lit(k)), *keys[k][:2])
    bad_url = F.lit(False)
    for k, (kind, *_) in keys.items():
        if kind == "url":
            bad_url |= F.coalesce(has(k) & value(k).isNotNull() & ~tx.is_http_url(value(k)), F.lit(False))
    short = has("n") & (F.coalesce(F.char_length(value("n")), F.lit(0)) < 2) if "n" in keys else F.lit(False)
    known = people.select(F.col("id").alias("_k"))
    why = F.when(F.col("_k").isNull(), "no_person").when(bad_url, "bad_url").when(short, "no_name")
    checked = p.join(known, F.col("_id") == F.col("_k"), "left").withColumn("_why", why)
    j = people.join(checked.where("_why IS NULL"), people.id == F.col("_id"), "left")
    entry = lambda k: F.when(
        has(k), F.create_map(F.lit(k), tx.json_text(value(k)))
    ).otherwise(F.create_map().cast("map<string,string>"))
    flag = F.when(
        F.col("_nt").isNotNull(), F.create_map(F.lit("nt"), tx.json_text(F.col("_nt")))
    ).otherwise(F.create_map().cast("map<string,string>"))
    new = {
        "data_json": F.when(
            F.col("_id").isNotNull(), tx.with_keys(F.col("data_json"), F.map_concat(*map(entry, keys), flag))
        ).otherwise(F.col("data_json")),
        "notable": F.coalesce("_nt", "notable")
    }
    for k, (*_, column) in keys.items():
        if column:
            new[column] = F.when(F.coalesce(has(k), F.lit(False)), value(k)).otherwise(F.col(column))
    return j.withColumns(new).select(*people.columns), checked.where("_why IS NOT NULL").select(F.col("_id").alias("id"), F.col("_why").alias("why"))


def mirror_rows(people: DataFrame) -> DataFrame:
    """Mirror rows of long records: eight columns, empty texts as null but the name, notable as 0 or 1."""
    c = F.col
    return people.select(
        "id", F.coalesce("name", F.lit("")).alias("name"),
        *[F.nullif(c(k), F.lit("")).alias(k) for k in ("name_en", "event", "city", "photo_url", "slug")],
        F.coalesce("notable", F.lit(False)).cast("int").alias("notable")
    )


def replace_mirror(mirror: DataFrame, people: DataFrame) -> DataFrame:
    """The mirror after a batch: rows of the same id are replaced whole, so what a batch has not, data_json, is null."""
    return mirror.join(people.select("id"), "id", "left_anti").unionByName(mirror_rows(people), allowMissingColumns=True).select(*mirror.columns)


def queue(
    rows: DataFrame, people: DataFrame, status: str | None = None, kind: str | None = None, default: str = "pending", reported: bool = False,
    order: list[Column] | None = None, limit: int = 300
) -> DataFrame:
    """A review queue: rows of a status (``default`` if none is asked, ``all`` for any) and kind, with the names of their people.

    ``reported`` asks for rows that were reported, whatever their status. Rows of unknown people stay.
    Rows that ``order`` leaves equal go by their other fields, so that the queue's end is the same in each run.
    """
    status = status or default
    if reported:
        rows = rows.where("report_count > 0")
    elif status != "all":
        rows = rows.where(F.col("status") == status)
    if kind:
        rows = rows.where(F.col("report_type") == kind)
    names = lambda a, on: people.select(F.col("id").alias(on), F.col("name").alias(a))
    out = rows.join(names("person_name", "person_id"), "person_id", "left")
    if "duplicate_of" in rows.columns:
        out = out.join(names("duplicate_name", "duplicate_of"), "duplicate_of", "left")
    ties = [F.asc(n) for n in dict.fromkeys([*rows.columns, *out.columns]) if not dict(out.dtypes)[n].startswith(("map", "variant"))]
    return out.orderBy(*(order or [F.desc("id")]), *ties).limit(limit)


#: Kinds of reports.
REPORT_TYPES = ["duplicate", "wrong_info", "inappropriate", "other"]


def dashboard(comments: DataFrame, reports: DataFrame, photos: DataFrame, submissions: DataFrame, people: DataFrame) -> DataFrame:
    """One row of eight counts, each table read once."""
    n = lambda d, **tests: d.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    is_ = lambda s: F.col("status") == s
    c = n(
        comments, comments_pending=is_("pending"), comments_approved=is_("approved"), comments_reported=(F.col("report_count") > 0) & ~is_("rejected")
    )
    r = n(reports, reports_open=is_("open"), reports_duplicate=(F.col("report_type") == "duplicate") & is_("open"))
    return scalars(
        c=c, r=r, f=n(photos, photos_pending=is_("pending")), s=n(submissions, submissions_pending=is_("pending")),
        p=people.agg(F.count("*").alias("people_total"))
    )


def guard_comments(rows: DataFrame) -> DataFrame:
    """(rows' columns, why): cleaned comments, and why one is refused, else null; a nameless author gets the default."""
    c = F.col
    d = rows.withColumns(
        {
            "person_id": tx.clean(c("person_id"), 40), "body": tx.clean(c("body")),
            "author_name": F.coalesce(F.nullif(tx.clean(c("author_name"), 60), F.lit("")), F.lit("ناشناس"))
        }
    )
    return d.withColumn("why", F.when((c("person_id") == "") | (F.char_length("body") < 2), "short"))


def guard_reports(rows: DataFrame) -> DataFrame:
    """Reports with a blank kind as ``other``; refused without a person or of an unknown kind."""
    c = F.col
    d = rows.withColumns(
        {
            "person_id": tx.clean(c("person_id"), 40), "report_type": F.coalesce(F.nullif(tx.clean(c("report_type"), 30), F.lit("")), F.lit("other")),
            "duplicate_of": F.nullif(tx.clean(c("duplicate_of"), 40), F.lit(""))
        }
    )
    return d.withColumn("why", F.when(c("person_id") == "", "no_person").when(~c("report_type").isin(REPORT_TYPES), "bad_type"))


def overlay(mirror: DataFrame, json: str, keys: dict[str, str]) -> DataFrame:
    """Columns overlaid by the JSON object's keys where it has them."""
    o = tx.parse_object(F.col(json))
    return mirror.withColumns({c: F.coalesce(F.try_element_at(o, F.lit(k)), F.col(c)) for c, k in keys.items()})


def set_notable(people: DataFrame, commands: DataFrame) -> DataFrame:
    """Set notable to the value that commands (id, notable) give, in column and JSON together; one command a person, so replaying it changes nothing."""
    j = people.join(commands.select(F.col("id").alias("_id"), F.coalesce("notable", F.lit(False)).alias("_nt")), people.id == F.col("_id"), "left")
    told = F.col("_id").isNotNull()
    return j.withColumns(
        {
            "data_json": F.when(told, tx.with_key(F.col("data_json"), "nt", F.col("_nt"))).otherwise(F.col("data_json")),
            "notable": F.coalesce("_nt", "notable")
        }
    ).select(*people.columns)


def approve_photos(people: DataFrame, photos: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Approve pending suggestions with a valid URL and a known person: people, photos, refused (id, why)."""
    c = photos.join(ids.select("id").distinct(), "id", "left_semi")
    known = people.select(F.col("id").alias("_p"))
    c = c.join(known, c.person_id == known._p, "left")
    why = F.when(F.col("status") != "pending", "not_pending").when(
        ~tx.is_http_url(F.col("photo_url")), "bad_url"
    ).when(F.col("_p").isNull(), "no_person")
    good = latest(c.where(why.isNull()), ["person_id"], [F.desc("id")]).select(F.col("person_id").alias("_id"), F.col("photo_url").alias("_url"))
    done = c.where(why.isNull()).select(F.col("id").alias("_d"))
    p = people.join(good, people.id == F.col("_id"), "left")
    p = p.withColumns(
        {
            "data_json": F.when(F.col("_id").isNotNull(), tx.with_key(F.col("data_json"), "ph", F.col("_url"))).otherwise(F.col("data_json")),
            "photo_url": F.coalesce("_url", "photo_url")
        }
    ).select(*people.columns)
    f = photos.join(done, photos.id == done._d, "left").withColumn(
        "status", F.when(F.col("_d").isNotNull(), "approved").otherwise(F.col("status"))
    ).select(*photos.columns)
    return p, f, c.where(why.isNotNull()).select("id", why.alias("why"))


#: Keys of an approved submission's JSON and the submission's columns.
SNAPSHOT = {
    "n": "name", "ne": "name_en", "a": "age", "g": "gender", "e": "event", "c": "city", "pr": "province", "dj": "date_jalali", "ca": "cause",
    "oc": "occupation", "s": "story", "ph": "photo_url", "src_text": "sources"
}


def approve_submissions(submissions: DataFrame, people: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approve pending submissions: they become reported people with an id of their own."""
    ok = submissions.join(ids.select("id").distinct(), "id", "left_semi").where("status = 'pending'")
    pid = F.concat(F.lit("jvn_"), F.substring(F.sha1(F.concat_ws("|", F.lit("submission"), F.col("id").cast("string"))), 1, 10))
    have = lambda c: F.col(c) if c in submissions.columns else F.lit(None).cast("string")
    told = [have(long).alias(short) for short, long in SNAPSHOT.items()]
    snap = F.to_json(
        F.struct(*told, F.lit("reported").alias("v"), F.lit("community_submission").alias("_source"), F.col("id").alias("_submission_id")),
        {"ignoreNullFields": "false"}
    )
    new = ok.select(pid.alias("id"), "name", "event", "city", "photo_url", F.lit(False).alias("notable"), snap.alias("data_json"))
    done = ok.select(F.col("id").alias("_id"), pid.alias("_pid"))
    s = submissions.join(done, submissions.id == F.col("_id"), "left")
    s = s.withColumns(
        {
            "status": F.when(F.col("_id").isNotNull(), "approved").otherwise(F.col("status")),
            "approved_person_id": F.coalesce("_pid", "approved_person_id")
        }
    ).select(*submissions.columns)
    return people.unionByName(new, allowMissingColumns=True), s


def audit(commands: DataFrame) -> DataFrame:
    """Audit rows of commands (admin_id, action, entity_type, entity_id, detail, created_at)."""
    return commands.select(
        "admin_id", "action", "entity_type", F.col("entity_id").cast("string").alias("entity_id"), F.substring("detail", 1, 2000).alias("detail"),
        "created_at"
    )


def guarded(rows: DataFrame, settings: DataFrame, flag: str) -> DataFrame:
    """The rows if the feature's flag is ``1``, else none."""
    on = settings.where((F.col("key") == flag) & (F.col("value") == "1")).limit(1).select(F.lit(1).alias("_on"))
    return rows.crossJoin(on).drop("_on")  # one row at most
