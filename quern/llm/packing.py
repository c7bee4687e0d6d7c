"""Sum-of-squares packing of token sequences.

An item goes where the sum over residual gaps of the squared number of open bins with
that gap becomes smallest: into an open bin of some gap, or a new one. Items are packed
in cells of bounded size side by side; bins that a cell leaves open are items of a second
pass over all cells.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches, tidied
from quern.sources.stage import stage

LENGTH = 2048
#: Items of a cell, and the distinct words a worker remembers.
CELL, WORDS_KEPT = 100_000, 200_000
#: A character that is a token of its own, and signs that may end a word.
BETWEEN = "\x01"
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Pairs of words on which the tokenizer is probed.
PROBES = (("the", "quick"), ("a", "b"), ("unbelievable", "xylophones"), ("cafe", "naïve"), ("don", "tomorrow"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of a column of texts.

    A tokenizer that drops white space, never joins across it and folds ASCII case gives
    a text the ids of its words in turn. Each distinct word of a batch is encoded once,
    without case and the signs at its end, which are encoded as a word of their own; the first
    WORDS_KEPT such words met are remembered, which frequent ones are soon among. Words are
    encoded many at a time, with a control character between them whose id is its own.
    A tokenizer that fails the probes of this encodes whole texts, ``plain``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        ids = lambda t: list(self.tok.encode(t, add_special_tokens=False).ids)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]  # matched in raw text, with their case
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.marks = "".join(sorted(MARKS.difference(*added)))  # so none of them is cut
        self.plain = len(ids(BETWEEN)) != 1
        for a, b in PROBES:
            self.plain |= ids(f" {a}\t\n{b}  ") != ids(a) + ids(b) or ids(a.upper()) != ids(a) or ids(f"{a} {BETWEEN} {b}") != ids(a) + ids(BETWEEN) + ids(b)
            self.plain |= any(ids(a + c) != ids(a) + ids(c) for c in (*self.marks, *(3 * m for m in self.marks), self.marks, self.marks[::-1]))
        self.between = ids(BETWEEN)[0]

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Case is folded by the tokenizer too, and signs at the end,
        after an ASCII letter, are tokens apart from it, so fewer need encoding."""
        known, marks, added = self.known, self.marks, self.added.search
        stems, tails = [], []
        for i, w in enumerate(words):
            if w.isascii():
                low = w.lower()
                if low != w and not added(low):
                    w = low
            stem = w.rstrip(marks)
            if stem != w and "a" <= stem[-1:] <= "z":
                tails.append((i, w[len(stem) :]))
                w = stem
            stems.append(w)
        found = [known.get(w) for w in stems]
        need = {w for w, x in zip(stems, found) if x is None}
        need.update(t for _, t in tails if t not in known)
        fresh = self.encode_alone(list(need))
        found = [fresh[w] if x is None else x for w, x in zip(stems, found)]
        for i, t in tails:
            found[i] += fresh[t] if t in fresh else known[t]
        if len(known) < WORDS_KEPT:
            known.update(fresh)
        return found

    def encode_alone(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, by the tokenizer."""
        out = {w: array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes() for w in words if BETWEEN in w}
        need = [w for w in words if w not in out]
        for at in range(0, len(need), 2000):
            part = need[at : at + 2000]
            (e,) = self.tok.encode_batch_fast([f" {BETWEEN} ".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == self.between)
            raw = ids.tobytes()
            assert len(cut) == len(part) - 1
            out.update((w, raw[a:b]) for w, a, b in zip(part, [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(raw)]))
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and the last's end)."""
        if self.plain:
            found = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = words.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        found = self.encode(distinct)
        ids = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int32, len(distinct)) // 4
        first = np.cumsum(size, dtype=np.int32) - size
        each = size[index] if len(index) else np.zeros(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(each, dtype=np.int32))).astype(np.int32)
        place = np.repeat(first[index] - ends[:-1], each) if len(index) else np.zeros(0, np.int32)
        place += np.arange(ends[-1], dtype=np.int32)
        out = ids[place]
        return out, ends[np.asarray(words.offsets) - words.offsets[0].as_py()]


@cache
def encoder(path: str) -> Encoder:
    """A worker's encoder, which its tasks share."""
    return Encoder(path)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches, small ones joined to about ``size`` bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pieces(docs: DataFrame, path: str | None, length: int = LENGTH, end: int = 0) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32: a row per piece, staged.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone. Only
    documents over ``length`` are cut. row numbers the input rows, so repeated ones stay apart.
    """
    small_batches(docs.sparkSession)
    src = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path or vocabulary()), np.array([end], "<u4").tobytes()
        for b in gathered(batches):
            out: list[list[int]] = [[], [], [], [], []]
            tokens, ends = encode(b.column(2))
            for i, (lo, hi) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                ids = tokens[lo:hi].astype("<u4").tobytes() + tail
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    for x, v in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        x.append(v)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
                names=["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            )

    kind = src.schema["doc_id"].dataType.simpleString()
    return stage(src.mapInArrow(tidied(run), f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long"))


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the order given."""
    count = np.zeros(length + 1, np.int64)  # open bins by residual gap
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    bins, offsets, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        if s == length:
            bins[i], made = made, made + 1
            continue
        # change of the sum: bins of gap h become bins of gap h - s; a full bin counts nothing
        change = count[: length - s + 1] - count[s:]
        change[0] = -count[s]
        change = 2 * change + 2
        change[0] -= 1
        change[count[s:] == 0] = 1 << 60
        change[-1] = 2 * count[length - s] + 1  # a new bin
        g = int(change.argmin())
        h = g + s
        if h == length:
            b, used, made = made, 0, made + 1
        else:
            b, used = stacks[h].pop()
            count[h] -= 1
        bins[i], offsets[i] = b, used
        if g:
            stacks[g].append((b, used + s))
            count[g] += 1
    return bins, offsets


def packed(sizes: np.ndarray, length: int = LENGTH, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed from the longest down; then the items of bins left
    open are placed again so, until that saves no bin."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    bins[order], offsets[order] = sum_of_squares(sizes[order], length)
    for _ in range(rounds):
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        loose = np.flatnonzero(used[bins] < length)
        loose = loose[np.argsort(-sizes[loose], kind="stable")]
        b, o = sum_of_squares(sizes[loose], length)
        if not len(loose) or b.max() + 1 >= (used < length).sum():
            break
        number = np.cumsum(used == length) - 1  # full bins keep their order, the new ones follow
        bins, base = number[bins], int((used == length).sum())
        bins[loose], offsets[loose] = base + b, o
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.

    Every row of ``docs`` is packed, repeated ones as often; null doc_ids are carried;
    an empty table gives no rows; other columns are ignored. Reruns over the same files
    agree. Cells hold about ``CELL`` pieces by a hash, each packed on its own; the open
    bins of all cells are packed again, their pieces moved together.
    """
    p = pieces(docs, path, length)  # a worker finds its own copy of the vocabulary
    short = p.where(F.col("length") < length)
    cells = max(1, -(-short.count() // CELL))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], ignore_index=True)
        b, o = packed(pdf.length.to_numpy(), length)
        return pdf.assign(bin=b, offset=o)

    cell = F.pmod(F.xxhash64("row", "piece"), F.lit(cells)).cast("long")
    kind = p.schema["doc_id"].dataType.simpleString()
    one = stage(
        short.withColumn("cell", cell).groupBy("cell").applyInPandas(
            first, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long, cell long, bin long, offset long"
        )
    )
    bins = one.groupBy("cell", "bin").agg(F.sum("length").alias("used"))
    open_ = stage(bins.where(F.col("used") < length))
    again = max(1, -(-open_.count() // CELL))

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "bin"], ignore_index=True)
        b, o = packed(pdf.used.to_numpy(), length)
        return pdf.assign(to=b, shift=o)[["cell", "bin", "group", "to", "shift"]]

    group = F.pmod(F.xxhash64("cell", "bin", F.lit(1)), F.lit(again)).cast("long")
    two = open_.withColumn("group", group).groupBy("group").applyInPandas(second, "cell long, bin long, group long, to long, shift long")
    out = one.join(two, ["cell", "bin"], "left")
    # numbers of three kinds, told apart by their remainder: kept bins, repacked bins, full pieces
    seq = F.when(F.col("to").isNull(), 3 * (F.col("cell") + F.col("bin") * cells)).otherwise(3 * (F.col("group") + F.col("to") * again) + 1)
    placed = out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", seq.alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
    # rows are numbered partition by partition, and a document's full pieces come first, so this pair is unique
    whole = p.where(F.col("length") == length).withColumn("k", F.monotonically_increasing_id())
    full = whole.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (3 * F.col("k") + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(full)
