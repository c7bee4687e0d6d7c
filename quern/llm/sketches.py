"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash space. Sketches of
parts merge by union, and the share of one sketch's hashes that another has estimates
containment however unequal the two documents are. A short text of which too few hashes
would stay is kept at a denser fraction, two or four times as many; a fingerprint says which, and
two of different fractions are compared below the lower threshold, where both are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, numbered, small_batches, tidied

WORDS = 5
#: One hash in FRACTION is kept, or in half or a quarter of it where fewer than LEAST are; hashes are
#: written with DIGITS hex digits, their first, after the fraction's digit.
FRACTION, LEAST, DIGITS = 4, 16, 12
#: Rows that one task reads in order; cuts of the order, which the driver holds, at most; ids looked at for each.
#: At the most, a task reads a hundred-thousandth of all rows, in a stream.
RUN, CUTS, LOOKED_AT = 4_000, 100_000, 16
WORDS_KEPT = 400_000


class Sketch(tuple):
    """(fraction, sorted distinct hashes of DIGITS hex digits below 1 / fraction of their space)."""

    __slots__ = ()

    def at(self, fraction: int) -> np.ndarray:
        """The hashes of a sparser fraction."""
        return self[1] if fraction == self[0] else self[1][self[1] < np.uint64((1 << 4 * DIGITS) // fraction)]


class Sketcher:
    """Sketch of a UTF-8 text; one without words has no hash, any other some."""

    def __init__(self, words: int = WORDS, fraction: int = FRACTION):
        import xxhash

        self.digest, self.words, self.fraction = xxhash.xxh3_64_intdigest, words, fraction
        self.known: dict[bytes, int] = {}
        self.mult = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(words)], np.uint64)

    def hashes(self, text: bytes) -> np.ndarray:
        """One hash per shingle; fewer words than a shingle has are one, none give none."""
        w = text.lower().split()
        if not w:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = [known[x] for x in w]
        except KeyError:
            if len(known) > WORDS_KEPT:
                known.clear()
            for x in set(w):
                if x not in known:
                    known[x] = self.digest(x)
            h = [known[x] for x in w]
        v = np.array(h, np.uint64)
        k = min(self.words, len(v))
        n = len(v) - k + 1
        s = np.zeros(n, np.uint64)
        for i in range(k):
            s = (s ^ (s >> np.uint64(29))) * self.mult[i] + v[i : i + n]
        s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        s = (s ^ (s >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return s ^ (s >> np.uint64(31))

    def __call__(self, text: bytes) -> Sketch:
        h, f = self.hashes(text) >> np.uint64(64 - 4 * DIGITS), self.fraction
        while True:
            kept = np.unique(h[h < np.uint64((1 << 4 * DIGITS) // f)])
            if f == 1 or len(kept) >= LEAST:
                return Sketch((f, kept))
            f //= 2


def as_text(sketch: Sketch) -> str:
    """The fraction, then the hashes in order, DIGITS hex digits each."""
    raw = sketch[1].astype(">u8").view(np.uint8).reshape(-1, 8)
    return f"{sketch[0]:x}" + raw[:, 8 - DIGITS // 2 :].tobytes().hex()


def from_text(s: str) -> Sketch:
    return Sketch((int(s[0], 16), np.array([int(s[i : i + DIGITS], 16) for i in range(1, len(s), DIGITS)], np.uint64)))


def merged(a: Sketch, b: Sketch) -> Sketch:
    """Sketch of two documents together, at the sparser of their fractions."""
    f = max(a[0], b[0])
    return Sketch((f, np.union1d(a.at(f), b.at(f))))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has; an empty text is contained."""
    f = max(a[0], b[0])
    x, y = a.at(f), b.at(f)
    if not len(x):  # of a short text nothing may be left at b's fraction: then no shingle is seen to be shared
        return float(not len(a[1]))
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity; two texts without words are alike, one is not like another."""
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    f = max(a[0], b[0])
    x, y = a.at(f), b.at(f)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def sketch_documents(docs: DataFrame, words: int = WORDS, fraction: int = FRACTION) -> DataFrame:
    """(doc_id, fingerprint), one row per input row; a null text counts as empty."""
    small_batches(docs.sparkSession)
    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        s = Sketcher(words, fraction)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([as_text(s(t or b"")) for t in as_bytes(b.column(1))], pa.string())], names=["doc_id", "fingerprint"]
            )

    return src.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def part_finder(cuts: list[tuple[bool, int, int]]):
    """A column function (none, k, h) to the number of sorted ``cuts`` at or before the row, those without id in parts of their own."""
    ks, hs = (np.array([c[i] for c in cuts if not c[0]], np.int64) for i in (1, 2))
    none = np.array([c[2] for c in cuts if c[0]], np.int64)

    @F.pandas_udf("int")
    def part(z: pd.Series, k: pd.Series, h: pd.Series) -> pd.Series:
        z, k, h = z.to_numpy(bool), k.to_numpy(np.int64), h.to_numpy(np.int64)
        lo, hi = np.searchsorted(ks, k, "left"), np.searchsorted(ks, k, "right")
        out = lo.copy()
        for v in np.unique(k[hi > lo]).tolist():  # ids that are cuts themselves
            at = k == v
            a, b = np.searchsorted(ks, v, "left"), np.searchsorted(ks, v, "right")
            out[at] = a + np.searchsorted(hs[a:b], h[at], "right")
        return pd.Series(np.where(z, len(ks) + 1 + np.searchsorted(none, h, "right"), out).astype(np.int32))

    return part


def dealing_keys(spark: SparkSession, n: int) -> list[int]:
    """A key for each of ``n`` partitions that hash partitioning puts there, so that each part is a task of its own."""
    keys: dict[int, int] = {}
    upto = 16 * n + 64
    while len(keys) < n:
        at = spark.range(upto).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("key"))
        keys, upto = {r.p: r.key for r in at.collect()}, 2 * upto  # a row a part
    return [keys[p] for p in range(n)]


def with_neighbour(docs: DataFrame) -> DataFrame:
    """Rows (part, guard, doc_id, text) in parts by descending doc_id, sorted within.

    The row after a part's last is the first row of the next, which comes along once more
    as the part's ``guard`` (after the very last, the very first). Cuts are ids of a sample,
    so parts hold about RUN rows, or more beyond CUTS of them, and each is a task of its own. Null doc_ids
    come last; rows of one doc_id are ordered by a hash of text and place, and cut like others.
    """
    src, a, b = numbered(docs)  # the scan itself, whose rows have places; any other is staged
    src = src.select(
        "doc_id", "text", F.col("doc_id").isNull().alias("z"), F.bitwise_not(F.coalesce("doc_id", F.lit(0)).cast("long")).alias("k"),
        F.xxhash64("text", a, b).alias("h")
    )
    ids = src.select("z", "k", "h")
    n, = ids.agg(F.count("*")).first()
    parts = max(1, min(CUTS, n // RUN))
    step = max(1, n // (parts * LOOKED_AT))
    looked = sorted(tuple(r) for r in ids.where(F.pmod("h", F.lit(step)) == 0).collect()) if parts > 1 else []  # LOOKED_AT a part
    cuts = [looked[i * len(looked) // parts] for i in range(1, parts)] if looked else []
    part = part_finder(cuts)("z", "k", "h")
    # the first row of each part: which part precedes it
    top = ids.withColumn("part", part).groupBy("part").agg(F.min(F.struct("z", "k", "h")).alias("w"))
    order = sorted((r.part, *r.w) for r in top.collect())  # a row a part
    place = {x[0]: i for i, x in enumerate(order)}
    deal = dealing_keys(docs.sparkSession, len(order)) if order else []
    firsts = [(place[order[i - 1][0]], x[0], i, x[2], x[3]) for i, x in enumerate(order)]
    firsts = [(*x, deal[x[0]], deal[x[2]]) for x in firsts]
    guards = docs.sparkSession.createDataFrame(firsts, "before int, own int, place int, d long, g long, key_before long, key long")
    src = src.withColumn("own", part).join(F.broadcast(guards), "own")  # a row a part
    src = src.withColumn("opens", (F.col("k") == F.col("d")) & (F.col("h") == F.col("g")))
    each = F.array(F.struct(F.col("place").alias("part"), F.lit(False).alias("guard"), "key"))
    also = F.array(F.struct(F.col("before").alias("part"), F.lit(True).alias("guard"), F.col("key_before").alias("key")))
    out = src.withColumn("p", F.explode(F.when(F.col("opens"), F.concat(each, also)).otherwise(each)))
    out = out.select("p.part", "p.guard", "p.key", "doc_id", "z", "k", "h", "text").repartition(len(order) or 1, "key")
    return out.sortWithinPartitions("part", "guard", "z", "k", "h").select("part", "guard", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, words: int = WORDS, fraction: int = FRACTION) -> DataFrame:
    """Fingerprint every document and an edited text of it, and compare.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next: one row per input row. The edit puts the next document's first third-length
    in place of the last third, the next by descending doc_id. A lone document is its own
    next. Null texts count as empty; an empty table gives no rows.
    """
    import hashlib

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(words, fraction)
        held = None  # (part, doc_id, text, sketch) that waits for its next
        for b in batches:
            out: list[tuple] = []
            for part, guard, i, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                t = t or ""
                own = sketch(t.encode())
                if held is not None and held[0] == part:
                    k = len(held[2]) // 3
                    edited = (held[2][: len(held[2]) - k] + t[:k]).encode()
                    e = sketch(edited)
                    out.append(
                        (
                            held[1], len(held[2]), hashlib.sha256(edited).hexdigest(), as_text(held[3]), as_text(e), likeness(held[3], e),
                            likeness(held[3], own)
                        )
                    )
                held = None if guard else (part, i, t, own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x, y) for x,
                    y in zip(
                        zip(*out) if out else [()] * 7,
                        (b.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    )
                ],
                names=names
            )

    return with_neighbour(docs).mapInArrow(
        tidied(run),
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
