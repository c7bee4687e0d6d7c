"""Text, date and number functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import calendar as cal
from quern.functions import text as tx
from quern.session import dealt, table

c = F.col


def normalise_text(spark, d):
    return dealt(table(spark, d, "documents")).select(
        "doc_id", F.md5(tx.norm_text(c("text"))).alias("v2"), F.md5(tx.norm_text_v1(c("text"))).alias("v1"),
        F.md5(tx.norm_name_v1(c("text"))).alias("name")
    )


def tokens(spark, d):
    t = tx.name_tokens(c("text"))
    return dealt(table(spark, d, "documents")).select("doc_id", F.size(t).alias("n"), F.get(t, F.lit(0)).alias("first"))


def digit_fold(spark, d):
    """Digits of both scripts folded, or Persian ones alone."""
    native, arabic = tx.to_native_digits(c("o_orderkey")), F.translate(c("o_custkey").cast("string"), "0123456789", tx.ARABIC_DIGITS)
    both = F.concat(native, F.lit("/"), arabic)
    return table(spark, d, "orders").select(
        "o_orderkey", native.alias("native"), tx.fold_digits(both).alias("folded"), tx.fold_digits(both, False).alias("persian")
    )


def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tx.html_escape(c("html"))).alias("escaped"))


def truncate_ellipsis(spark, d):
    odd = F.concat(F.lit(" \u0000"), c("text"), F.lit("\u0000 "))
    return table(spark, d, "documents").select("doc_id", tx.truncate(c("text"), 38).alias("short"), F.md5(tx.clean(odd, 50)).alias("cleaned"))


def urls(spark, d):
    u = c("url")
    bent = F.when(c("page_id") % 5 == 0, F.concat(F.lit("x:"), u)).when(
        c("page_id") % 5 == 1, F.replace(u, F.lit("://"), F.lit("://www."))
    ).otherwise(u)
    return table(spark, d, "pages").select("page_id", bent.alias("u")).select(
        "page_id", tx.host(c("u")).alias("host"), tx.link_kind(c("u")).alias("kind"), tx.is_http_url(c("u")).alias("valid"),
        tx.path_tail(c("u")).alias("tail")
    )


def id_sha1(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.record_id(c("c_name"), c("c_mktsegment")).alias("id"))


def int_prefix_parse(spark, d):
    v = F.concat(F.lit(" "), c("p_size").cast("string"), F.lit("3x"))
    signed = F.concat(
        F.when(c("p_partkey") % 3 == 0, "-").when(c("p_partkey") % 3 == 1, "+").otherwise("no "), c("p_size").cast("string"), F.lit(".9")
    )
    return table(spark, d, "part").select("p_partkey", tx.int_prefix(v).alias("n"), tx.int_prefix(signed, -20, 20).alias("signed"))


def subset_name(spark, d):
    t = F.split(c("p_name"), " ")
    # names of one to five tokens of a brand's digits, in order or not, whole or with gaps
    w = F.concat(t, F.split(c("p_brand"), "#"), F.array((c("p_size") % 3).cast("string")))
    a, n = F.slice(w, 1, c("p_size") % 4 + 1), c("p_partkey") % 5
    other = F.when(n == 0, w).when(n == 1, F.reverse(w)).when(n == 2, F.filter(w, lambda x, i: i % 2 == 0)).when(n == 3, F.slice(w, 2, 4)).otherwise(
        F.array(w[0], F.lit("x"), w[1], F.lit("y"), w[2])
    )
    # both lists columns of their own, so that each is made once a row and not at every step of the comparison
    p = dealt(table(spark, d, "part")).select("p_partkey", a.alias("a"), other.alias("b"))
    return p.select("p_partkey", tx.is_subset(c("a"), c("b")).alias("first"), tx.is_subset(c("b"), c("a")).alias("second"))


def jalali_dates(spark, d):
    """To the Solar Hijri calendar and back, and the approximate year."""
    j = cal.to_jalali(c("day"))
    o = dealt(table(spark, d, "orders")).select("o_orderkey", c("o_orderdate").cast("date").alias("day"))
    # each part a column of its own, so that it is computed once
    o = o.select("o_orderkey", "day", j["y"].alias("y"), j["m"].alias("m"), j["d"].alias("d"))
    return o.select(
        "o_orderkey", "y", "m", "d", cal.from_jalali(c("y"), c("m"), c("d")).alias("back"), cal.jalali_text(c("day")).alias("text"),
        cal.approx_jalali_year(c("day").cast("string")).alias("approx")
    )


def partial_dates(spark, d):
    """Year, month and day of dates of which some lack parts."""
    day = c("o_orderdate")
    k = c("o_orderkey") % 5
    t = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("??/01")).when(k == 2, F.concat(F.lit("13"), F.date_format(day, "yy/MM/dd"))).when(k == 3, F.concat(F.lit("14"), F.date_format(day, "yy"))).otherwise(
        tx.to_native_digits(F.concat(F.lit("14"), F.date_format(day, "yy/M/d")))
    )
    return table(spark, d, "orders").select("o_orderkey", t.alias("t")).select(
        "o_orderkey", cal.jalali_year(c("t")).alias("year"), cal.has_month(c("t")).alias("month"), cal.month_day(c("t"))["month"].alias("mm"),
        cal.month_day(c("t"))["day"].alias("dd")
    )


def relative_times(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    r = cal.relative_time(c("ts"), c("now"))
    return e.crossJoin(now).groupBy(r["unit"].alias("unit"), r["n"].alias("n")).agg(F.count("*").alias("events"))  # the right side is one row


def wd_times(spark, d):
    k = c("o_orderkey") % 4
    t = F.when(k == 0, F.lit("+1990-00-01T00:00:00Z")).when(k == 1, F.lit("+1889-01-01T00:00:00Z")).when(k == 2, F.lit("+2001-02-30T00:00:00Z")).otherwise(
        F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    )
    return table(spark, d, "orders").select("o_orderkey", cal.parse_wd_time(t).cast("string").alias("day"))


_NORM = r"""trim(regexp_replace(regexp_replace(translate(translate(text, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩' || chr(8204) || chr(8207) || chr(8206), '01234567890123456789 '), 'يكﻩةأإآٱ' || 'ًٌٍَُِّْ', 'یکههاااا'), '[^\p{L}\p{N}_؀-ۿ ]', ' ', 'g'), '\s+', ' ', 'g'))"""
_V1 = r"""trim(regexp_replace(regexp_replace(regexp_replace(translate(text, '۰۱۲۳۴۵۶۷۸۹' || chr(8204) || 'يك', '0123456789 یک'), '[#@_]', ' ', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g'))"""
_NAME = r"trim(regexp_replace(translate(text, chr(8204) || 'يك', ' یک'), '\s+', ' ', 'g'))"
_TOK = f"list_filter(string_split({_NORM}, ' '), lambda w: length(w) > 1 AND w NOT IN ('شهید', 'مرحوم', 'زنده', 'یاد', 'سید', 'سیده', 'حاج', 'دکتر', 'مهندس'))"
_HOST = r"nullif(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
QUERIES = {
    "normalise_text": (normalise_text, f"SELECT doc_id, md5({_NORM}) AS v2, md5({_V1}) AS v1, md5({_NAME}) AS name FROM documents"),
    "tokens": (tokens, f"SELECT doc_id, len({_TOK})::INT AS n, ({_TOK})[1] AS first FROM documents"),
    "digit_fold": (
        digit_fold,
        """SELECT o_orderkey, translate(o_orderkey::VARCHAR, '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS native, o_orderkey || '/' || o_custkey AS folded, o_orderkey || '/' || translate(o_custkey::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS persian FROM orders"""
    ),
    "html_escape": (
        html_escape,
        """SELECT page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages"""
    ),
    "truncate_ellipsis": (
        truncate_ellipsis,
        "SELECT doc_id, CASE WHEN length(text) > 38 THEN substr(text, 1, 38) || '…' ELSE text END AS short, md5(substr(trim(' ' || text || ' ', ' '), 1, 50)) AS cleaned FROM documents"
    ),
    "url_host_class": (urls, f"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'x:' || url WHEN 1 THEN replace(url, '://', '://www.') ELSE
      url END AS u FROM pages),
      h AS (SELECT *, regexp_replace({_HOST}, '^(.*?)www\\.', '\\1') AS host FROM p)
      SELECT page_id, host, CASE WHEN host IS NULL THEN 'invalid' WHEN contains(host, 'x.com') OR contains(host, 'twitter') THEN 'twitter' WHEN
        contains(host, 'instagram') THEN 'instagram'
        WHEN regexp_matches(host, 'youtube|youtu\\.be') THEN 'youtube' WHEN contains(host, 'wikipedia') THEN 'wikipedia' ELSE 'generic' END AS kind,
        regexp_matches(u, '(?i)^https?://[^\\s/?#]+') AS valid, string_split(u, '/')[-1] AS tail FROM h"""),
    "id_sha1": (id_sha1, "SELECT c_custkey, 'jvn_' || substr(sha1(trim(c_name) || '|' || c_mktsegment), 1, 10) AS id FROM customer"),
    "int_prefix_parse": (
        int_prefix_parse,
        "SELECT p_partkey, CASE WHEN p_size * 10 + 3 BETWEEN 1 AND 129 THEN (p_size * 10 + 3)::INT END AS n, CASE WHEN p_partkey % 3 < 2 AND p_size <= 20 THEN (CASE WHEN p_partkey % 3 = 0 THEN -p_size ELSE p_size END)::INT END AS signed FROM part"
    ),
    "subset_name": (subset_name, """WITH RECURSIVE w AS (SELECT p_partkey, p_partkey % 5 AS n, p_size % 4 + 1 AS k,
      list_concat(list_concat(string_split(p_name, ' '), string_split(p_brand, '#')), [(p_size % 3)::VARCHAR]) AS w FROM part),
      x AS (SELECT p_partkey, w[1:k] AS a, CASE n WHEN 0 THEN w WHEN 1 THEN list_reverse(w) WHEN 2 THEN list_filter(w, lambda v, i: i % 2 = 1) WHEN 3
        THEN w[2:5] ELSE [w[1], 'x', w[2], 'y', w[3]] END AS o FROM w),
      s AS (SELECT *, CASE WHEN len(a) <= len(o) THEN a ELSE o END AS short, CASE WHEN len(a) <= len(o) THEN o ELSE a END AS long FROM x),
      g AS (SELECT p_partkey, short, long, 1 AS i, 0 AS pos FROM s UNION ALL
        SELECT p_partkey, short, long, i + 1, CASE WHEN list_contains(long[pos + 1:], short[i]) THEN pos + list_position(long[pos + 1:], short[i]) END
          FROM g WHERE pos IS NOT NULL AND i <= len(short)),
      f AS (SELECT p_partkey, max(i) FILTER (pos IS NOT NULL) AS got FROM g GROUP BY 1)
      SELECT p_partkey, a = o OR (len(short) >= 2 AND got = len(short) + 1) AS first, a = o OR (len(short) >= 2 AND got = len(short) + 1) AS second
        FROM s JOIN f USING (p_partkey)"""),
    "jalali_dates": (jalali_dates, """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, date_diff('day', DATE '1831-03-21', o_orderdate::DATE) AS n FROM orders),
      s AS (SELECT *, n % 12053 % 1461 AS s, 1210 + n // 12053 * 33 + n % 12053 // 1461 * 4 AS leap FROM o), k AS (SELECT *, CASE WHEN s < 366 THEN s
        ELSE (s - 1) % 365 END AS k FROM s)
      SELECT o_orderkey, (leap + CASE WHEN s < 366 THEN 0 ELSE (s - 1) // 365 END)::INT AS y, (CASE WHEN k < 186 THEN k // 31 + 1 ELSE (k - 186) // 30 + 7 END)::INT AS m,
        (CASE WHEN k < 186 THEN k % 31 ELSE (k - 186) % 30 END + 1)::INT AS d, day AS back, format('{:d}/{:02d}/{:02d}', leap + CASE WHEN s < 366 THEN
          0 ELSE (s - 1) // 365 END, CASE WHEN k < 186 THEN k // 31 + 1 ELSE (k - 186) // 30 + 7 END, CASE WHEN k < 186 THEN k % 31 ELSE (k - 186) %
          30 END + 1) AS text, CASE WHEN year(day) BETWEEN 1990 AND 2030 THEN (year(day) - CASE WHEN month(day) >= 4 THEN 621 ELSE 622 END)::INT END
          AS approx FROM k"""),
    "partial_dates": (partial_dates, r"""WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k, strftime(o_orderdate, '%y') AS yy, month(o_orderdate)::INT
      AS mm, day(o_orderdate)::INT AS dd FROM orders)
      SELECT o_orderkey, CASE k WHEN 2 THEN ('13' || yy)::INT WHEN 3 THEN ('14' || yy)::INT WHEN 4 THEN ('14' || yy)::INT END AS year, k IN (2, 4) AS month,
        CASE WHEN k IN (2, 4) THEN mm END AS mm, CASE WHEN k IN (2, 4) THEN dd END AS dd FROM t"""),
    "relative_time": (relative_times, """WITH s AS (SELECT epoch(date_trunc('second', (SELECT max(ts) FROM events)))::BIGINT -
      epoch(date_trunc('second', ts))::BIGINT AS s FROM events)
      SELECT CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' WHEN s < 2592000 THEN 'day' ELSE 'month' END AS unit,
        (CASE WHEN s < 60 THEN 0 WHEN s < 3600 THEN s // 60 WHEN s < 86400 THEN s // 3600 WHEN s < 2592000 THEN s // 86400 ELSE s // 2592000
          END)::BIGINT AS n, count(*) AS events FROM s GROUP BY 1, 2"""),
    "wd_time": (wd_times, "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"),
}
