"""Exact deduplication against a minimal perfect hash of historical digests.

The index is cut into buckets by digest. A bucket holds a minimal perfect hash in levels
of bit arrays (a key sits on the first level where it is alone at its position) and, in
slot order, full digests with their winners. A lookup compares all 32 bytes, so a digest
that is no member is told apart with certainty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import numbered, text_or_empty, without
from quern.sources.stage import stage

#: Distinct digests of a bucket of the index, about 4 MB.
BUCKET = 50_000
LOAD, LEVELS = 1.5, 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, *carry: str) -> DataFrame:
    """(carried columns, doc_id, digest of 32 bytes, n code points, rid), staged; rid tells repeated rows apart."""
    t = text_or_empty()
    rows = docs.select(*carry, "doc_id", F.unhex(F.sha2(normalised(t), 256)).alias("digest"), F.char_length(t).cast("long").alias("n"))
    return stage(rows.withColumn("rid", F.monotonically_increasing_id()))


def winners(rows: DataFrame) -> DataFrame:
    """One row a digest: its winner (most code points, smallest doc_id, null last) and count."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("w")
    agg = rows.groupBy("digest").agg(best, F.count("*").alias("cnt"))
    return agg.select(
        "digest", (-F.col("w.m")).alias("n"), F.col("w.z").alias("z"), F.coalesce("w.doc_id", F.lit(0)).cast("long").alias("doc"),
        F.col("w.rid").alias("rid"), "cnt"
    )


def positions(words: np.ndarray, level: int, m: int) -> np.ndarray:
    """Place of each digest (four 64-bit words) in the bit array of a level."""
    h = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 1))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(m)).astype(np.int64)


def as_words(digest) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d) for d in digest), "<u8").reshape(-1, 4)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels, left = [], words
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("digests are not distinct")
            m = max(8, math.ceil(LOAD * len(left)))
            at = positions(left, len(levels), m)
            count = np.bincount(at, minlength=m)
            levels.append((count == 1).astype(np.int64))
            left = left[count[at] > 1]
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each digest if it is a member; else any slot, or -1."""
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = positions(words[left], level, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x.astype(np.uint8)).tobytes() for x in self.levels)

    @classmethod
    def load(cls, sizes, blob: bytes) -> PerfectHash:
        levels, at = [], 0
        for m in sizes:
            n = -(-int(m) // 8)
            levels.append(np.unpackbits(np.frombuffer(blob[at : at + n], np.uint8), count=int(m)).astype(np.int64))
            at += n
        return cls(levels)


INDEX = "bucket long, sizes array<long>, bits binary, digests binary, n binary, z binary, doc binary, rid binary, cnt binary"


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket: the hash, and full digests, winners and counts in slot order."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = as_words(pdf.digest)
        mph = PerfectHash.build(words)
        order = np.argsort(mph.slots(words))
        sizes, bits = mph.dump()
        col = lambda x, t: np.asarray(x, t)[order].tobytes()
        return pd.DataFrame({"bucket": [pdf.bucket.iloc[0]], "sizes": [sizes], "bits": [bits], "digests": [words[order].tobytes()], **{k: [col(pdf[k], t)] for k, t in (("n", "<i8"), ("z", "u1"), ("doc", "<i8"), ("rid", "<i8"), ("cnt", "<i8"))}})

    return history.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(build, INDEX)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("long")


def merge(index: DataFrame, fresh: DataFrame, buckets: int) -> DataFrame:
    """Look every fresh digest up; one row a digest of either side: digest, doc, z, rid, cnt, known.

    A member's winner and count are merged into its slot; nonmembers, which ``fresh``
    has grouped already, follow as groups of their own.
    """

    def lookup(idx: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        cols = ("n", "z", "doc", "rid", "cnt")
        f = {k: new[k].to_numpy() for k in cols}
        words = as_words(new.digest) if len(new) else np.zeros((0, 4), np.uint64)
        if len(idx):
            r = idx.iloc[0]
            own = np.frombuffer(r.digests, "<u8").reshape(-1, 4)
            h = {k: np.frombuffer(r[k], "u1" if k == "z" else "<i8").astype(np.int64) for k in cols}
            slot = PerfectHash.load(r.sizes, r.bits).slots(words)
            member = slot >= 0
            member[member] = (own[slot[member]] == words[member]).all(axis=1)
            s, m = slot[member], {k: f[k][member].astype(np.int64) for k in cols}
            better = (m["n"] > h["n"][s]) | (m["n"] == h["n"][s]) & (
                (m["z"] < h["z"][s]) | (m["z"] == h["z"][s]) & ((m["doc"] < h["doc"][s]) | (m["doc"] == h["doc"][s]) & (m["rid"] < h["rid"][s]))
            )
            for k in ("n", "z", "doc", "rid"):
                h[k][s[better]] = m[k][better]
            h["cnt"][s] += m["cnt"]
        else:
            own, h, member = np.zeros((0, 4), np.uint64), {k: np.zeros(0, np.int64) for k in cols}, np.zeros(len(words), bool)
        digest = [x.tobytes() for x in own] + [x.tobytes() for x in words[~member]]
        out = {k: np.concatenate((h[k], f[k][~member].astype(np.int64))) for k in ("z", "doc", "rid", "cnt")}
        return pd.DataFrame(
            {
                "digest": digest, "doc": out["doc"], "z": out["z"].astype(bool), "rid": out["rid"], "cnt": out["cnt"],
                "known": np.arange(len(digest)) < len(own)
            }
        )

    right = fresh.withColumn("bucket", bucket_of(buckets)).groupBy("bucket")
    return index.groupBy("bucket").cogroup(right).applyInPandas(lookup, "digest binary, doc long, z boolean, rid long, cnt long, known boolean")


def middle(rows: DataFrame) -> float | None:
    """The middle of the range of doc_ids, as a double; None without any."""
    low, high = rows.agg(F.min("doc_id").cast("double"), F.max("doc_id").cast("double")).first()
    return None if low is None else (low + high) / 2


def exact_duplicates(docs: DataFrame, *carry: str) -> DataFrame:
    """Carried columns, doc_id, keep_id, group_size, kept, text_sha256, known: one row per input row.

    Texts are equal when they are after deleting white space; null counts as empty. The
    row with most code points, then the smallest doc_id (null last) stays; of rows that
    agree in both, one. The historical side are the doc_ids below the middle of their
    range (a null doc_id is new); ``known`` tells whether the digest was in the
    index. An empty table gives no rows; other columns are ignored. Equal digests are
    aggregated before any shuffle, so a hot text is one row by then.
    """
    rows = digests(docs, *carry)
    half = middle(rows)
    old = F.coalesce(F.col("doc_id").cast("double") < F.lit(half), F.lit(False)) if half is not None else F.lit(False)
    history = stage(winners(rows.where(old)))
    buckets = max(1, math.ceil(history.count() / BUCKET))
    index = build_index(history, buckets)
    out = merge(index, winners(rows.where(~old)), buckets).withColumnRenamed("rid", "keep_rid")
    got = rows.join(out, "digest")
    return got.select(
        *carry, "doc_id", F.when(~F.col("z"), F.col("doc")).alias("keep_id"), F.col("cnt").alias("group_size"),
        (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without repeated texts, one row of each text."""
    rows, *numbers = numbered(docs)
    return without(rows, numbers, exact_duplicates(rows, *numbers).where(~F.col("kept")))
