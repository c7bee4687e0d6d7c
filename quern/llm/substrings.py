"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut after every byte where the gear hash of the last 16 bytes has its high bits
zero, unless the chunk would be shorter than the least; one that would be longer than the
most ends there. (In a text that repeats itself the hash may never be zero; the most is a
prime, so that the forced cuts of two such texts come to meet at each of its phases.) Cuts
depend on nearby bytes only, so an insertion moves the cuts around it and no others, and
a passage that occurs in several documents falls into the same chunks but for its rims.
Chunks are deduplicated by digest; consecutive repeated chunks make a repeated span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, fresh, small_batches, tidied
from quern.sources.stage import stage

#: High bits that a cut needs zero, least and most bytes of a chunk, and words a run needs with its rims;
#: bytes that a passage loses at its two rims, about.
MASK_BITS, LEAST, MOST, WORDS, RIMS = 4, 12, 61, 34, 60
#: Stands for a null doc_id, after all others.
NO_ID = (1 << 63) - 1

_S = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_S = (_S ^ (_S >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
GEAR = ((_S ^ (_S >> np.uint64(27))) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: bytes) -> np.ndarray:
    """Gear hash h = 2 h + G[byte] (16 bits, so of 16 bytes) at every byte, by doubling the window four times."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8):
        n = h.copy()
        n[s:] += h[:-s] << np.uint16(s)
        h = n
    return h


def cuts(data: bytes, mask_bits: int = MASK_BITS, least: int = LEAST) -> list[int]:
    """Ends of the chunks, the last at the text's end; none for an empty text."""
    if not data:
        return []
    at = (np.flatnonzero((gear_hashes(data) >> np.uint16(16 - mask_bits)) == 0) + 1).tolist() if len(data) > 1 else []
    out, last = [], 0
    for c in (*at, len(data)):
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= least and c < len(data):
            out.append(c)
            last = c
    return [*out, len(data)]


#: White space, and first bytes of letters that are written without spaces (U+0E00 to U+0EFF,
#: U+1000 to U+109F and U+3000 to U+9FFF), two of which count as a word.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_UNSPACED = np.isin(np.arange(256), range(0xE3, 0xEA))


def half_words(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Twice the words of the chunks that end at ``ends``: a word counts where it begins, a letter of unspaced scripts as half a word."""
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    n = np.zeros(len(a) + 1, np.int64)
    begins = ~space
    begins[1:] &= space[:-1]
    n[1:] = 2 * begins
    n[1:] += _UNSPACED[a]
    for lead, lo, hi in ((0xE0, 0xB8, 0xBC), (0xE1, 0x80, 0x83)):
        n[1:-1] += (a[:-1] == lead) & (a[1:] >= lo) & (a[1:] < hi)
    n = np.cumsum(n)
    return np.diff(n[ends], prepend=0)


def chunks(docs: DataFrame, mask_bits: int = MASK_BITS, least: int = LEAST) -> DataFrame:
    """(doc, k, digest, more, start, size, halves): the chunks of each document.

    doc is the doc_id (NO_ID for null) and k a hash of the text, which tells apart texts of
    one doc_id; digest and more are 96 bits of XXH3; halves are twice the words begun.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash("text").alias("k"), "text")
    names = ["doc", "k", "digest", "more", "start", "size", "halves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            held, n = [], 0
            for i, t in enumerate(as_bytes(b.column(2))):
                ends = np.array(cuts(t or b"", mask_bits, least), np.int64)
                if not len(ends):
                    continue
                starts = np.concatenate(([0], ends[:-1]))
                d = np.frombuffer(b"".join([digest(t[x:y]) for x, y in zip(starts.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)
                held.append((np.full(len(ends), i), d[:, 0], d[:, 1].astype(np.int32), starts, ends - starts, half_words(t, ends)))
                n += len(ends)
                if n > 200_000:
                    yield batch(b, held)
                    held, n = [], 0
            if held:
                yield batch(b, held)

    def batch(b, held):
        row, dig, more, start, size, halves = (np.concatenate(x) for x in zip(*held))
        take = pa.array(row)
        cols = [pa.array(dig), pa.array(more), *(pa.array(x.astype(np.int32)) for x in (start, size, halves))]
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *cols], names=names)

    return src.mapInArrow(tidied(run), "doc long, k int, digest long, more int, start int, size int, halves int")


def repeats(docs: DataFrame, words: int = WORDS, mask_bits: int = MASK_BITS, least: int = LEAST) -> DataFrame:
    """Repeated spans: doc_id, start, end (bytes of the UTF-8 text), words, first, first_doc_id, text_hash.

    A run is neighbouring chunks that each occur in two documents or more. It counts if its words,
    and those that RIMS more bytes of its own density would have, are ``words`` or more:
    a passage loses up to a chunk at either rim, which is many words where they are short. White space
    separates words; of scripts without it two letters are one. What only one document repeats is left alone. A run is given as spans that are
    ``first`` throughout or nowhere: chunks that are met here first (smallest doc_id, null
    last), which a dedup keeps, and such as an earlier document has. So each chunk is kept
    somewhere. The default finds passages of over 50 words and leaves phrases alone. Null and empty texts
    have no spans. Rows that agree in doc_id and text are one document; texts that share a
    doc_id, or have none, are documents of their own, told apart by text_hash, but none comes
    before another: what they have first they all keep. Other
    columns are ignored.

    Digests are aggregated before the shuffle, so a chunk of a third of all documents is a
    row a task; repeated digests then meet the chunks again in a join that adaptive
    execution splits for a hot digest. Runs are found per document.
    """
    all_ = chunks(docs, mask_bits, least)
    # plain numbers, which a hash aggregate keeps in place; two documents differ in one of the two
    ends = [F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("k").alias("k_low"), F.max("k").alias("k_high")]
    seen = all_.groupBy("digest", "more").agg(*ends).where("low < high OR k_low < k_high").select("digest", "more", "low")
    # staged, so that the join deals both sides anew and can split a hot digest; chunks are cut again, which takes less than keeping them
    hit = all_.join(stage(seen), ["digest", "more"])
    hit = hit.select("doc", "k", "start", "size", "halves", "low", (F.col("low") == F.col("doc")).alias("own"))
    place = Window.partitionBy("doc", "k").orderBy("start", "size")
    # copies of a row give the same chunks again; a run goes on where the chunk before ends
    one = hit.groupBy("doc", "k", "start", "size", "halves", "low", "own").agg(F.count("*").alias("_n"))
    one = one.withColumn("new", (F.coalesce(F.lag(F.col("start") + F.col("size")).over(place), F.lit(-1)) != F.col("start")).cast("int"))
    one = one.withColumn("turn", F.when(~F.lag("own").over(place).eqNullSafe(F.col("own")), 1).otherwise(F.col("new")))
    one = one.withColumns({"run": F.sum("new").over(place), "part": F.sum("turn").over(place)})
    span = one.groupBy("doc", "k", "run", "part").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum("halves").alias("halves"), F.first("own").alias("first"), F.min("low").alias("low")
    )
    whole = Window.partitionBy("doc", "k", "run")
    span = span.withColumns({"all": F.sum("halves").over(whole), "bytes": F.sum(F.col("end") - F.col("start")).over(whole)})
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return span.where(F.col("all") * (1 + F.lit(RIMS) / F.col("bytes")) >= 2 * words).select(
        known("doc").alias("doc_id"), "start", "end", F.floor(F.col("halves") / 2).alias("words"), "first", known("low").alias("first_doc_id"),
        F.col("k").alias("text_hash")
    )


def strip(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans that are not ``first`` cut out of their texts."""
    i, k, c = (fresh(docs, n) for n in ("__id", "__k", "__cuts"))
    cutsdf = spans.where(~F.col("first")).groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(k)).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias(c)
    )
    both = docs.join(cutsdf, F.col("doc_id").eqNullSafe(F.col(i)) & (F.hash("text") == F.col(k)), "left").select(*docs.columns, c)
    schema = docs.schema
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = []
            for t, cs in zip(as_bytes(b.column(at)), b.column(len(b.columns) - 1).to_pylist()):
                if t is None or not cs:
                    texts.append(t)
                    continue
                keep, last = [], 0
                for c in cs:
                    keep.append(t[last : c["start"]])
                    last = c["end"]
                texts.append(b"".join([*keep, t[last:]]))
            cols = list(b.columns[:-1])
            cols[at] = pa.array([None if t is None else t.decode("utf-8", "ignore") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return both.mapInArrow(run, schema)

