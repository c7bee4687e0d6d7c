"""Text functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, letter folds, marks and honorifics of Persian text.
PERSIAN_DIGITS, ARABIC_DIGITS, DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
FOLD_FROM, FOLD_TO = "يكﻩةأإآٱ", "یکههاااا"
HARAKAT = "ًٌٍَُِّْ"
HONORIFICS = ["شهید", "مرحوم", "زنده", "یاد", "سید", "سیده", "حاج", "دکتر", "مهندس"]
ZWNJ, RLM, LRM = "‌", "‏", "‎"


def fold_digits(c: Column, arabic: bool = True) -> Column:
    """Persian digits, and Arabic-Indic ones if ``arabic``, to ASCII."""
    return F.translate(c, PERSIAN_DIGITS + (ARABIC_DIGITS if arabic else ""), DIGITS * (2 if arabic else 1))


def to_native_digits(c: Column) -> Column:
    return F.translate(c.cast("string"), DIGITS, PERSIAN_DIGITS)


def squeeze(c: Column) -> Column:
    """White-space runs to one space, none at the ends; single spaces are passed over."""
    return F.trim(F.regexp_replace(c, r"(?U)\s\s+|[^\S ]", " "))


def norm_name_v1(c: Column) -> Column:
    return squeeze(F.translate(F.coalesce(c, F.lit("")), ZWNJ + "يك", " یک"))


def norm_text_v1(c: Column) -> Column:
    """Digits and two letters folded; runs of what is neither letter nor number become one space."""
    t = F.translate(F.coalesce(c, F.lit("")), PERSIAN_DIGITS + ZWNJ + "يك", DIGITS + " یک")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def norm_text(c: Column) -> Column:
    """Digits, eight letters and marks folded; word characters, ``_`` and the Arabic block stay."""
    t = F.translate(F.coalesce(c, F.lit("")), PERSIAN_DIGITS + ARABIC_DIGITS + ZWNJ + FOLD_FROM + RLM + LRM + HARAKAT, DIGITS * 2 + " " + FOLD_TO)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_؀-ۿ]+", " "))


def norm_name(c: Column) -> Column:
    """norm_text without honorifics."""
    words = F.filter(F.split(norm_text(c), " "), lambda w: ~w.isin(HONORIFICS) & (w != ""))
    return F.array_join(words, " ")


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(norm_name(c), " "), lambda w: F.char_length(w) > 1)


def letter_bits(c: Column, part: int) -> Column:
    """How often letters of each of 16 kinds occur, four bits a kind, as many set as there are (four at most); ``part`` 0 or 1 of 32 kinds.

    The bits in which two texts differ are at most as many as the letters that one of them has and the other lacks.
    """
    at = lambda ch: F.ascii(ch) % 16 * 4
    shift = lambda way, v, n: F.call_function(way, v, n)
    more = lambda acc, ch: (shift("shiftright", acc, at(ch)).bitwiseAND(F.lit(15)) * 2 + 1).bitwiseAND(F.lit(15))
    mine = F.filter(F.split(c, ""), lambda ch: (F.ascii(ch) % 32 >= 16) == bool(part))
    return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, ch: acc.bitwiseOR(shift("shiftleft", more(acc, ch), at(ch))))


def is_subset(a: Column, b: Column) -> Column:
    """Names as token arrays: equal, or the shorter (two tokens at least) a prefix or subsequence of the longer."""
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    # the place after each matched token, or -1 once one is missing
    step = lambda at, w: F.when(at < 0, at).otherwise(
        F.coalesce(
            F.nullif(F.array_position(F.slice(long, at + 1, F.greatest(F.size(long) - at, F.lit(0))), w), F.lit(0)) + at, F.lit(-1)
        ).cast("int")
    )
    found = F.aggregate(short, F.lit(0), step) >= 0
    return F.when((F.size(a) == 0) | (F.size(b) == 0), False).when(a == b, True).otherwise((F.size(short) >= 2) & found)


def clean(c: Column, n: int = 2000) -> Column:
    """Not null; NULs dropped, trimmed, cut to n characters."""
    return F.substring(F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\u0000"), F.lit(""))), 1, n)


def html_escape(c: Column) -> Column:
    """Five characters as entities; null becomes empty."""
    out = F.coalesce(c, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def truncate(c: Column, n: int) -> Column:
    """The first n characters and an ellipsis, if there are more."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def is_http_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))


def host(c: Column) -> Column:
    """Host of a URL, the first ``www.`` removed; null if it has none."""
    h = F.nullif(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return F.regexp_replace(h, r"^(.*?)www\.", "$1")


def link_kind(c: Column) -> Column:
    """Kind of a link by its host, in order."""
    h = host(c)
    return (
        F.when(h.isNull(), "invalid")
        .when(h.contains("x.com") | h.contains("twitter"), "twitter")
        .when(h.contains("instagram"), "instagram")
        .when(h.rlike("youtube|youtu\\.be"), "youtube")
        .when(h.contains("wikipedia"), "wikipedia")
        .otherwise("generic")
    )


def path_tail(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def record_id(name: Column, event: Column) -> Column:
    """Generated id: a hash of normalised name and event."""
    return F.concat(F.lit("jvn_"), F.substring(F.sha1(F.concat_ws("|", norm_name_v1(name), event)), 1, 10))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of hexadecimal strings of one length (up to 64 digits), else 999."""
    piece = lambda c, i: F.conv(F.substring(F.rpad(c, 64, "0"), 1 + 16 * i, 16), 16, -10).cast("long")
    bits = sum((F.bit_count(piece(a, i).bitwiseXOR(piece(b, i))) for i in range(4)), F.lit(0))
    ok = a.isNotNull() & b.isNotNull() & (F.length(a) == F.length(b)) & (F.length(a) > 0)
    return F.when(ok, bits).otherwise(999)


def int_prefix(c: Column, low: int = 1, high: int = 129) -> Column:
    """Leading integer of a text within bounds, else null."""
    n = F.regexp_extract(F.trim(c.cast("string")), r"^[+-]?\d+", 0).try_cast("int")
    return F.when(n.between(low, high), n)


def bump_minor(c: Column, fallback: str = "1.1.0") -> Column:
    """x.y.z to x.(y+1).0; else the fallback."""
    p = F.split(c, r"\.")
    return F.when(c.rlike(r"^\d+\.\d+\.\d+$"), F.concat_ws(".", p[0], (p[1].try_cast("int") + 1).cast("string"), F.lit("0"))).otherwise(fallback)


def parse_object(c: Column) -> Column:
    """A JSON object as a map of strings; anything invalid as an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_text(c: Column) -> Column:
    """A scalar's JSON text; ``null`` of null."""
    wrapped = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.coalesce(F.substring(wrapped, F.lit(2), F.char_length(wrapped) - 2), F.lit("null"))


def raw_object(c: Column) -> Column:
    """A JSON object as a map to the JSON text of its values; anything invalid as an empty map.

    A value keeps its kind: a string its quotes, a number, boolean or null its word.
    """
    values = F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, "map<string,variant>"))
    keys = F.coalesce(F.map_keys(values), F.array().cast("array<string>"))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.to_json(F.try_element_at(values, k)), F.lit("null"))))


def as_object(m: Column) -> Column:
    """The JSON object of a map to JSON texts, in the map's order."""
    pair = lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"])
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), pair), ","), F.lit("}"))


def with_keys(c: Column, new: Column) -> Column:
    """The JSON object with the keys of ``new``, a map to JSON texts, set; keys already there keep their place."""
    old = raw_object(c)
    kept = F.transform_values(old, lambda k, v: F.coalesce(F.try_element_at(new, k), v))
    return as_object(F.map_concat(kept, F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k))))


def with_key(c: Column, key: str, value: Column) -> Column:
    """The JSON object with one key set to a string, number or boolean as such."""
    return with_keys(c, F.create_map(F.lit(key), json_text(value)))


def random_hex(n: int = 5) -> Column:
    """2 n random hexadecimal digits, new in every run and row."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 2 * n)


def commons_url(name: Column, width: int = 600) -> Column:
    """Address of a file of the media archive: blanks as underscores, percent-encoded but for slashes."""
    enc = F.url_encode(F.replace(name, F.lit(" "), F.lit("_")))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return F.concat(F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), enc, F.lit(f"?width={width}"))


def unquote(c: Column) -> Column:
    """Percent-decoded; a plus stays a plus, and what cannot be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def media_file(url: Column) -> Column:
    """struct(name, host) of a media file's address, of the archive's or of an upload's form; null of others."""
    direct = F.regexp_extract(url, r"Special:FilePath/([^?]+)", 1)
    p = r"/wikipedia/([a-z]+)/(?:thumb/)?[0-9a-f]/[0-9a-f]{2}/([^/?]+)"
    lang, name = F.regexp_extract(url, p, 1), F.regexp_extract(url, p, 2)
    commons = F.lit("commons.wikimedia.org")
    both = lambda n, h: F.struct(unquote(n).alias("name"), h.alias("host"))
    return F.when(direct != "", both(direct, commons)).when(
        lang != "", both(name, F.when(lang == "commons", commons).otherwise(F.concat(lang, F.lit(".wikipedia.org"))))
    )
