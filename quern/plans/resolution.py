"""Entity-resolution queries; documents stand in for records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.similarity import Against
from quern.functions.text import hamming_hex
from quern.operators import resolve as r
from quern.operators.components import components
from quern.operators.stats import rarity
from quern.session import dealt, table
from quern.sources.stage import stage

c = F.col


def exact_dup_groups(spark, d):
    t = table(spark, d, "documents").select(c("doc_id").alias("id"), F.sha1("text").alias("sha1"))
    return r.shared_files(t).select("sha1", "n", F.md5(F.array_join("ids", ";")).alias("ids"))


def rarity_weights(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "MM-dd")).alias("md"))
    return rarity(o, "md", "md_n").select("o_orderkey", "md", "md_n", (c("md_n") <= r.RARE_DATE).alias("rare"))


def keyed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select(
        c("doc_id").alias("id"), F.concat_ws("|", "lang", F.lower(F.substring_index(F.substring_index("text", "\n", 1), " ", 2))).alias("key")
    )


def block_pairs(spark, d):
    return r.block_pairs(keyed(spark, d), r.NAME_CAP)


def bits(spark: SparkSession, d: str) -> DataFrame:
    """Signs of the first 64 entries of each embedding as 16 hexadecimal digits."""
    nibble = lambda k: F.substring(
        F.lit("0123456789abcdef"), 1 + sum((F.when(F.get("embedding", F.lit(4 * k + j)) > 0, 8 >> j).otherwise(0) for j in range(4)), F.lit(0)),
        F.lit(1)
    )
    return table(spark, d, "embeddings").select("vec_id", "label", F.concat(*[nibble(k) for k in range(16)]).alias("hex"))


def hamming_bands(spark, d):
    """Pairs that share a band of 12 bits and differ in 18 at most; crowded bands are skipped."""
    b = bits(spark, d)
    k = b.select(
        c("vec_id").alias("id"),
        F.explode(F.array(F.concat(F.lit("p"), F.substring("hex", 1, 3)), F.concat(F.lit("q"), F.substring("hex", 9, 3)))).alias("key")
    )
    p = r.block_pairs(k, 400)
    x, y = b.select(c("vec_id").alias("a"), c("hex").alias("ha")), b.select(c("vec_id").alias("b"), c("hex").alias("hb"))
    return p.join(x, "a").join(y, "b").select("a", "b", hamming_hex(c("ha"), c("hb")).alias("bits")).where("bits <= 18")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Equal first 40 characters, or equal texts: a star per group."""
    t = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 40).alias("k"), F.sha1("text").alias("h"))
    e = None
    for key, why in (("k", "STORY+name"), ("h", "NAME_EQ+ctx")):
        low = t.groupBy(key).agg(F.min("doc_id").alias("a"))
        one = t.join(low, key).where("doc_id != a").select("a", c("doc_id").alias("b"), F.lit(why).alias("reason"), F.lit(False).alias("same_file"))
        e = one if e is None else e.unionByName(one)
    return e


def dup_components(spark, d):
    return components(edges(spark, d), "a", "b")


def chain_split(spark, d):
    """Large components hold together by equal texts alone, which stand for equal names."""
    return r.split(edges(spark, d), r.is_strong())


#: Documents of a block that meet those of another part of it in one task.
TILE = 100


def fuzzy_ratio(spark, d):
    """difflib's ratio of whole texts of all pairs of a block, the smaller id first; equal pairs of texts are scored once a tile.

    A block is dealt into parts, and each two parts meet in a tile of their own, so a large block
    is many tasks of bounded size. No block is skipped: the pairs of a block grow with its square.
    """
    k = keyed(spark, d).where("id is not null and key is not null").distinct()
    n = k.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    k = k.join(n, "key").withColumn("parts", F.ceil(c("n") / TILE).cast("int"))
    k = k.withColumn("part", F.pmod(F.xxhash64("id"), c("parts")).cast("int"))
    k = k.join(table(spark, d, "documents").select(c("doc_id").alias("id"), "text"), "id")
    k = k.withColumn("other", F.explode(F.sequence(F.lit(0), c("parts") - 1)))
    k = k.select("key", "id", "text", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def run(pdf):
        import pandas as pd

        rows = sorted(zip(pdf["id"].tolist(), pdf["part"].tolist(), pdf["text"].tolist()), key=lambda x: x[0])
        one, out = pdf["lo"].iloc[0] == pdf["hi"].iloc[0], []
        known: dict[str | None, dict[str | None, float]] = {}
        for at, (b, part, y) in enumerate(rows):
            against = None
            mine = known.setdefault(y, {})
            for a, p, x in rows[:at]:
                if a == b or (p == part and not one):
                    continue
                if x not in mine:
                    against = against or Against(y)
                    mine[x] = round(against.ratio(x), 6)
                out.append((a, b, mine[x]))
        return pd.DataFrame(out, columns=["a", "b", "ratio"])

    kind = k.schema["id"].dataType.simpleString()
    return k.groupBy("key", "lo", "hi").applyInPandas(run, f"a {kind}, b {kind}, ratio double")


def people(spark: SparkSession, d: str, deal: bool = False) -> DataFrame:
    """Orders as records: names repeat by customer, cities by nation and key."""
    o, cu = table(spark, d, "orders"), table(spark, d, "customer")
    t = (dealt(o) if deal else o).join(cu, c("o_custkey") == c("c_custkey"))
    s = lambda x: F.lit(x).cast("string")
    return t.select(
        F.lpad(c("o_orderkey").cast("string"), 12, "0").alias("id"), F.concat(
            F.substring("c_name", 10, 9), F.lit(" person")
        ).alias("name"), s(None).alias("name_en"), c("o_orderpriority").alias("event"), s(None).alias("gender"),
        F.when(c("o_orderkey") % 3 == 0, (c("o_orderkey") % 80).cast("int")).alias("age"), s(None).cast("int").alias("birth_year"), F.date_format("o_orderdate", "'13'yy/MM/dd").alias("date_jalali"), s(None).alias("date_gregorian"),
        F.concat(F.lit("city"), (c("c_nationkey") + 25 * (c("o_orderkey") % 400)).cast("string")).alias("city"), s(None).alias("province"), s(None).alias("cause"), s(None).alias("occupation"), F.when(c("o_orderkey") % 2 == 0, c("o_orderstatus")).alias("story"), s(None).alias("story_en"),
        F.when(c("o_orderkey") % 5 == 0, F.lit("http://p")).alias("photo_url"), F.array(c("o_orderstatus")).alias("memorial_links"), (c("o_totalprice") > 300000).alias("notable"), F.lit("reported").alias("verification"), F.array(c("o_orderpriority")).alias("sources"),
    )


def dup_pairs_scored(spark, d):
    return r.duplicates(people(spark, d, deal=True))


def survivor_merge(spark, d):
    """Orders of one customer and day are one record."""
    p = stage(people(spark, d))
    key = p.groupBy("name", "date_jalali").agg(F.min("id").alias("component"))
    cl = stage(p.join(key, ["name", "date_jalali"]).select(c("id").alias("node"), "component"))
    return r.merge(p, cl)[0].select("id", "age", "story", "photo_url", "notable", F.array_join("sources", ";").alias("sources"))


_KEY = "lang || '|' || lower(array_to_string(list_slice(string_split(string_split(text, chr(10))[1], ' '), 1, 2), ' '))"
_EDGES = """t AS (SELECT doc_id, substr(text, 1, 40) AS k, sha1(text) AS h FROM documents),
  e AS (SELECT min(doc_id) OVER (PARTITION BY k) AS a, doc_id AS b, 'STORY+name' AS reason FROM t UNION ALL SELECT min(doc_id) OVER (PARTITION BY h),
    doc_id, 'NAME_EQ+ctx' FROM t),
  g AS (SELECT * FROM e WHERE a <> b)"""
_P = """p AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, c_name AS name, strftime(o_orderdate, '13%y/%m/%d') AS dj, CASE WHEN o_orderkey % 3 = 0
  THEN (o_orderkey % 80)::INT END AS age,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS story, CASE WHEN o_orderkey % 5 = 0 THEN 'http://p' END AS photo_url, o_totalprice > 300000
      AS notable, o_orderpriority AS src
  FROM orders JOIN customer ON o_custkey = c_custkey),
  w AS (SELECT *, row_number() OVER (PARTITION BY name, dj ORDER BY
      1 + CASE WHEN story IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN photo_url IS NOT NULL THEN 4 ELSE 0 END + 3 + 2 + CASE WHEN age IS NOT NULL AND
        age <> 0 THEN 1 ELSE 0 END
      + coalesce(length(story), 0) / 100 + 1 + CASE WHEN notable THEN 5 ELSE 0 END DESC, id) AS rank FROM p)"""
QUERIES = {
    "exact_dup_groups": (
        exact_dup_groups,
        "SELECT sha1(text) AS sha1, count(*)::INT AS n, md5(string_agg(doc_id::VARCHAR, ';' ORDER BY doc_id)) AS ids FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2"
    ),
    "rarity_weights": (rarity_weights, """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%m-%d') END AS md FROM orders)
      SELECT o_orderkey, md, CASE WHEN md IS NOT NULL THEN count(*) OVER (PARTITION BY md) END AS md_n, CASE WHEN md IS NOT NULL THEN count(*) OVER
        (PARTITION BY md) <= 25 END AS rare FROM o"""),
    "block_pairs": (block_pairs, f"""WITH t AS (SELECT doc_id AS id, {_KEY} AS key, count(*) OVER (PARTITION BY {_KEY}) AS n FROM documents), s AS
      (SELECT * FROM t WHERE n BETWEEN 2 AND 800)
      SELECT x.id AS a, y.id AS b FROM s x JOIN s y USING (key) WHERE x.id < y.id"""),
    "hamming_bands": (hamming_bands, """WITH b AS (SELECT vec_id AS id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0
      THEN (1::HUGEINT << (63 - i)::INT) ELSE 0 END))::HUGEINT AS v FROM embeddings),
      k AS (SELECT id, 'p' || (v >> 52)::VARCHAR AS key FROM b UNION ALL SELECT id, 'q' || ((v >> 20) & 4095)::VARCHAR FROM b),
      s AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY key) BETWEEN 2 AND 400),
      q AS (SELECT DISTINCT x.id AS a, y.id AS b FROM s x JOIN s y USING (key) WHERE x.id < y.id)
      SELECT a, b, bit_count(xor(m.v, n.v))::INT AS bits FROM q JOIN b m ON m.id = a JOIN b n ON n.id = q.b WHERE bit_count(xor(m.v, n.v)) <= 18"""),
    "dup_components": (dup_components, f"""WITH RECURSIVE {_EDGES}, z AS (SELECT a, b FROM g UNION SELECT b, a FROM g), r AS (SELECT a AS node, a AS
      comp FROM z UNION SELECT z.b, r.comp FROM r JOIN z ON z.a = r.node)
      SELECT node, min(comp) AS component FROM r GROUP BY 1"""),
    "chain_split": (chain_split, f"""WITH RECURSIVE {_EDGES}, z AS (SELECT a, b FROM g UNION SELECT b, a FROM g), r AS (SELECT a AS node, a AS comp
      FROM z UNION SELECT z.b, r.comp FROM r JOIN z ON z.a = r.node),
      k AS (SELECT node, min(comp) AS component FROM r GROUP BY 1), n AS (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM k),
      y AS (SELECT z.a, z.b FROM (SELECT a, b FROM g WHERE reason = 'NAME_EQ+ctx' UNION SELECT b, a FROM g WHERE reason = 'NAME_EQ+ctx') z JOIN n ON
        n.node = z.a WHERE n.size > 4),
      q AS (SELECT a AS node, a AS comp FROM y UNION SELECT y.b, q.comp FROM q JOIN y ON y.a = q.node)
      SELECT node, component FROM n WHERE size <= 4 UNION ALL SELECT node, min(comp) FROM q GROUP BY 1"""),
    "fuzzy_ratio": (fuzzy_ratio, None),
    "dup_pairs_scored": (dup_pairs_scored, None),
    "survivor_merge": (survivor_merge, f"""WITH {_P}
      SELECT min_by(id, rank) AS id, min_by(age, rank) FILTER (age IS NOT NULL AND age <> 0) AS age, min_by(story, rank) FILTER (story IS NOT NULL) AS story,
        min_by(photo_url, rank) FILTER (photo_url IS NOT NULL) AS photo_url, bool_or(notable) AS notable,
        array_to_string(list_filter(list(src ORDER BY rank), lambda x, i: NOT list_contains(list_slice(list(src ORDER BY rank), 1, i - 1), x)), ';') AS sources
      FROM w GROUP BY name, dj"""),
}
