"""Schemas of the archive's tables, key maps, and conformance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Short and long field names, and their order in the long form.
SHORT_TO_LONG = {
    "id": "id", "sl": "slug", "n": "name", "ne": "name_en", "e": "event", "g": "gender", "a": "age", "by": "birth_year",
    "dj": "date_jalali", "dg": "date_gregorian", "c": "city", "pr": "province", "ca": "cause", "oc": "occupation", "s": "story",
    "se": "story_en", "ph": "photo_url", "ml": "memorial_links", "nt": "notable", "v": "verification", "fr": "flagged_review", "src": "sources",
}
LONG = list(SHORT_TO_LONG.values())
#: Keys of the lite form and columns of the CSV form, in order.
LITE = ["id", "n", "ne", "e", "g", "a", "dj", "c", "pr", "ca", "oc", "nt", "v", "s"]
CSV = ["id", "name", "name_en", "event", "gender", "age", "birth_year", "date_jalali", "date_gregorian", "city", "province", "cause", "occupation", "notable", "verification", "sources"]
#: The closed sets of the record schema.
EVENTS = [
    "kuye_daneshgah_78", "green_88", "dey_96", "darvish_96", "mordad_97", "kazerun_97", "aban_98", "khuzestan_1400", "khizesh_1401",
    "khizesh_1404", "executions", "deaths_in_custody", "chain_murders_77", "dey_1402", "dey_1403", "needs_review",
]
GENDERS = ["مرد", "زن"]
VERIFICATIONS = ["documented", "reported"]

_INTS, _LISTS = {"age", "birth_year"}, {"memorial_links", "sources"}


def _type(name: str) -> T.DataType:
    return T.IntegerType() if name in _INTS else T.ArrayType(T.StringType()) if name in _LISTS else T.BooleanType() if name == "notable" else T.StringType()


#: A person in the long form, and in the short form as it is stored (notable is 0, 1 or a boolean).
PERSON = T.StructType([T.StructField(n, _type(n)) for n in LONG])
PERSON_SHORT = T.StructType([T.StructField(s, T.StringType() if s == "nt" else _type(n)) for s, n in SHORT_TO_LONG.items()])
EVENT = T.StructType([T.StructField(n, T.IntegerType() if n in ("year", "order") else T.StringType()) for n in ("event", "title", "title_en", "year_fa", "year", "order", "category")])
TIMELINE = T.StructType([T.StructField(n, T.StringType()) for n in "id title date decade category scope icon color casualties arrested summary spark details outcome source".split()] + [T.StructField("year", T.IntegerType())])
FINGERPRINT = "url string, ok boolean, w int, h int, phash string, dhash string, ahash string, whash string, face_phash string, nfaces int, sha1 string, err string, ids array<string>"


def conformance(df: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """(key, violation), a row for each rule that a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("violation"))


def person_rules() -> dict[str, Column]:
    """The record schema's rules: required fields, pattern, closed sets, bounds, one source at least."""
    c = F.col
    optional = lambda n, ok: c(n).isNull() | ok
    return {
        "id_pattern": c("id").rlike("^jvn_[0-9a-f]{10}$"),
        "name_required": c("name").isNotNull(),
        "event_enum": c("event").isin(EVENTS),
        "gender_enum": optional("gender", c("gender").isin(GENDERS)),
        "age_range": optional("age", c("age").between(0, 120)),
        "verification_enum": c("verification").isin(VERIFICATIONS),
        "sources_min_items": F.size("sources") >= 1,
    }


def to_long(people: DataFrame) -> DataFrame:
    """Short records to long ones: fixed order, lists empty and notable false where missing."""
    have = set(people.columns)
    col = lambda s, n: F.col(s).cast(_type(n)) if s in have else F.lit(None).cast(_type(n))

    def value(s: str, n: str) -> Column:
        if n in _LISTS:
            return F.coalesce(col(s, n), F.array().cast("array<string>"))
        if n == "notable":
            return F.coalesce(F.col(s).cast("string").isin("1", "true", "True") if s in have else F.lit(False), F.lit(False))
        return col(s, n)

    return people.select([value(s, n).alias(n) for s, n in SHORT_TO_LONG.items()])


def to_lite(people: DataFrame) -> DataFrame:
    """Long records to the 14 short keys of the lite form."""
    return people.select([F.col(SHORT_TO_LONG[k]).alias(k) for k in LITE])
