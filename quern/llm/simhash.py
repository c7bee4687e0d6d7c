"""Near-duplicates by 64-bit SimHash and Golay-code fuzzy keys.

A fingerprint is cut into segments of 22, 21 and 21 bits. The binary Golay code
(23, 12) is perfect with radius 3: each 23-bit word has one codeword within three
bits. The decoded index of a segment and of all its one-bit neighbours are its keys,
one or six of them. Two segments at most two bits apart have a common neighbour, hence
a common key.

Two fingerprints at most four bits apart split their errors over three segments:

- no segment has more than two: the triple of segment keys is shared;
- one has three or more: of the other two, one is equal and the other differs in at
  most one bit, so (equal segment, key of the other) is shared.

Keys are joined by sorting; candidates are verified on the whole fingerprints, and for
near copies (``keep_one``) on a second fingerprint, of five-word shingles, as well. A key
that many fingerprints have is dealt over tiles of two parts each, so no task holds it whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, numbered, small_batches, tidied, without
from quern.operators.components import components
from quern.sources.stage import stage

WORDS, SEED, BITS = 4, 42, 4
#: Near copies: words of a shingle of the second fingerprint, and the bits in which it may differ. Shingles
#: of which two sets share 0.8 have a cosine of 0.89, so 10 of 64 bits differ on average; 12 leaves room for chance.
COPY_WORDS, COPY_BITS = 5, 12
#: Fingerprints of one key that a task compares; one in SAMPLE is looked at to find keys with more, and so many are split.
PART, SAMPLE, HOT_KEYS = 20_000, 64, 10_000
#: Fingerprints whose keys one task makes.
TASK_NODES = 100_000
#: The Golay code's generator polynomial, segment widths and offsets.
GENERATOR = 0xC75
WIDTHS, SHIFTS = (22, 21, 21), (42, 21, 0)


def fold_bits(hashes: list[int], weights: np.ndarray | None = None) -> int:
    """The bits set in over half the hashes (of the whole-numbered weights, if given)."""
    n, counts = 0, np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        h = np.array(hashes[at : at + (1 << 15)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w = None if weights is None else weights[at : at + (1 << 15)]
        counts += bits.sum(0, dtype=np.int64) if w is None else w @ bits
        n += len(h) if w is None else int(w.sum())
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def shingle_hashes(w: list[bytes], words: int) -> list[int]:
    """XXH64 of the shingles of ``words`` words, repeats included; of all words where there are fewer."""
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    k = min(words, len(w))
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text; no words give zero."""
    w = (text or b"").lower().split()
    return fold_bits(shingle_hashes(w, words)) if w else 0


def copy_fingerprints(text: bytes | None) -> tuple[int, int]:
    """SimHash of a text's distinct words, each weighing 1 + ln of its count, and of its distinct five-word shingles.

    An edited word changes one feature of the first, which so stays within four bits where
    the second, on five shingles an edit, moves further.
    """
    w = (text or b"").lower().split()
    if not w:
        return 0, 0
    counts = Counter(w)
    hashes = [xxhash.xxh64_intdigest(x, SEED) for x in counts]
    weights = np.round(1024 * (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts))))).astype(np.int64)
    return fold_bits(hashes, weights), fold_bits(list(dict.fromkeys(shingle_hashes(w, COPY_WORDS))))


def fingerprints(docs: DataFrame, words: int = WORDS, *carry: str, copies: bool = False) -> DataFrame:
    """(doc_id, carried columns, fp long); for ``copies`` the two fingerprints of near copies, fp and also.

    A null text counts as no words.
    """
    small_batches(docs.sparkSession)
    src = docs.select("doc_id", *carry, F.col("text").alias("__text"))
    names = ["fp", "also"] if copies else ["fp"]
    schema = src.drop("__text").withColumns({n: F.lit(0).cast("long") for n in names}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(b.num_columns - 1))
            fp = np.array(
                [copy_fingerprints(t) if copies else (fingerprint(t, words),) for t in texts], np.uint64
            ).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(np.ascontiguousarray(x)) for x in fp.T)], names=schema.names)

    return src.mapInArrow(tidied(run), schema)


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


def _leaders() -> np.ndarray:
    """The error of at most three bits that has each syndrome."""
    one = [1 << i for i in range(23)]
    errors = np.array(
        [
            0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]),
            *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])
        ],
        np.int64
    )
    table = np.zeros(2048, np.int64)
    table[_syndrome(errors)] = errors
    return table


LEADER = _leaders()
UNIT = _syndrome(np.array([1 << i for i in range(23)]))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which 64-bit words differ; on unsigned words, as the count of a negative one is its absolute value's."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def decode(x: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    return (x ^ LEADER[_syndrome(x)]) >> 11


def segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]


def segment_keys(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment its distinct keys, padded to six, and which of the six count."""
    s = _syndrome(x)
    flips = np.array([0, *(1 << i for i in range(width))], np.int64)
    near = x[:, None] ^ flips
    idx = np.sort((near ^ LEADER[s[:, None] ^ np.concatenate(([0], UNIT[:width]))]) >> 11, axis=1)
    new = np.ones(idx.shape, bool)
    new[:, 1:] = idx[:, 1:] != idx[:, :-1]
    order = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(idx, order, 1), np.take_along_axis(new, order, 1)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints."""
    seg = segments(fp)
    keys, real = zip(*(segment_keys(x, w) for x, w in zip(seg, WIDTHS)))
    n = len(fp)
    triple = keys[0][:, :, None, None] << 24 | keys[1][:, None, :, None] << 12 | keys[2][:, None, None, :]
    ok = real[0][:, :, None, None] & real[1][:, None, :, None] & real[2][:, None, None, :]
    row = np.broadcast_to(np.arange(n)[:, None, None, None], ok.shape)
    rows, out = [row[ok]], [triple[ok]]
    for tag, (a, b) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), 1):
        pair = np.int64(tag) << 40 | seg[a][:, None] << 12 | keys[b]
        rows.append(np.broadcast_to(np.arange(n)[:, None], pair.shape)[real[b]])
        out.append(pair[real[b]])
    return np.concatenate(rows), np.concatenate(out)


def runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first ``key`` columns, in pieces that hold every key's rows whole."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        part = [np.asarray(c) for c in b.columns]
        if not len(part[0]):
            continue
        new = np.zeros(len(part[0]), bool)
        for c in part[:key]:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[-1][k][-1] != part[k][0] for k in range(key)):
            new[0] = True
        cuts = np.flatnonzero(new)
        if len(cuts):  # the last key of the batch may go on in the next
            done = [[c[: cuts[-1]] for c in part]] if cuts[-1] else []
            if held or done:
                yield [np.concatenate(x) for x in zip(*held, *done)]
            held = []
            part = [c[cuts[-1] :] for c in part]
        held.append(part)
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def near(fps: list[np.ndarray], at, one, limits: tuple[int, ...]) -> np.ndarray:
    """Whether the rows ``at`` are linked with the row ``one``: no fingerprint differs in more bits than its limit."""
    ok = differing(fps[0][at], fps[0][one]) <= limits[0]
    for f, most in zip(fps[1:], limits[1:]):
        ok &= differing(f[at], f[one]) <= most
    return ok


def near_runs(batches: Iterator[pa.RecordBatch], limits: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows (key, tile, group, fingerprints) sorted by key and tile: pairs of groups that a verified link joins.

    A run of one key is compared only across groups, which merge as links are found, so
    a tight cluster costs about its size times the groups left, and the pairs given are
    no more than the groups of the run.
    """
    seen: set[tuple[int, int]] = set()
    for key, tile, group, *fps in runs(batches, 2):
        heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))))
        size = np.diff(np.concatenate((heads, [len(key)])))
        two = heads[size == 2]
        two = two[group[two] != group[two + 1]]
        two = two[near(fps, two, two + 1, limits)]
        found = list(zip(group[two].tolist(), group[two + 1].tolist()))
        for at, n in zip(heads[size > 2].tolist(), size[size > 2].tolist()):
            f, g, own = [x[at : at + n] for x in fps], group[at : at + n], group[at : at + n].copy()
            if (own == own[0]).all():
                continue
            for i in range(n):
                other = np.flatnonzero(own != own[i])
                if not len(other):
                    if (own == own[0]).all():
                        break
                    continue
                for j in other[near(f, other, i, limits)].tolist():
                    if own[j] != own[i]:
                        found.append((int(g[i]), int(g[j])))
                        own[own == own[j]] = own[i]
        found = [p for p in dict.fromkeys((min(p), max(p)) for p in found) if p not in seen]
        if found:
            seen.update(found)
            if len(seen) > 1_000_000:  # only saves repeats; components() drops the others
                seen.clear()
            a, c = zip(*found)
            yield np.array(a, np.int64), np.array(c, np.int64)


def _coarse(batches: Iterator[pa.RecordBatch], limits: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Of (key, tile, node, fingerprints) sorted by key and tile: (node, grp, fingerprints), groups being links within one key.

    Long runs are grouped in pieces; links between pieces are left to the second pass.
    """
    for key, tile, node, *fps in runs(batches, 2):
        group = node.copy()
        heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]))))
        ends = np.concatenate((heads[1:], [len(key)]))
        for lo, hi in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist()):
            for at in range(lo, hi, PART):
                stop = min(hi, at + PART)
                f, left = [x[at:stop] for x in fps], np.arange(stop - at)
                while len(left):
                    reach, left = [left[0]], left[1:]
                    root = node[at + reach[0]]
                    while reach and len(left):
                        hit = near(f, left, reach.pop(), limits)
                        reach.extend(left[hit].tolist())
                        group[at + left[hit]] = root
                        left = left[~hit]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, group, *fps)], names=["node", "grp", "fp", "also"][: 2 + len(fps)])


def first_key(fp: np.ndarray) -> np.ndarray:
    i, j, k = (decode(x) for x in segments(fp))
    return i << 24 | j << 12 | k


def hot_keys(fps: DataFrame, all_keys: bool) -> dict[int, int]:
    """Parts of the keys that more than PART fingerprints are expected to have, by a sample; HOT_KEYS at most.

    What is split decides where pairs are compared, never which.
    """

    def run(batches):
        for b in batches:
            fp = np.asarray(b.column(0))
            for at in range(0, len(fp), 1000):
                part = fp[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(fuzzy_keys(part)[1] if all_keys else first_key(part))], names=["key"])

    some = fps.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(SAMPLE)) == 0).select("fp")
    n = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > PART)
    return {r.key: -(-r.n * SAMPLE // PART) for r in n.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()}


def spread(key: np.ndarray, node: np.ndarray, hot: dict[int, int], pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, tile) with the rows of hot keys in parts by their node, or once in every tile of two parts."""
    row, tile = np.arange(len(key)), np.zeros(len(key), np.int32)
    if not hot:
        return row, key, tile
    is_hot = np.isin(key, np.fromiter(hot, np.int64, len(hot)))
    more_rows, more_tiles = [row[~is_hot]], [tile[~is_hot]]
    for i in np.flatnonzero(is_hot).tolist():
        parts = hot[int(key[i])]
        own = int((int(node[i]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32) % parts
        tiles = [min(own, x) * parts + max(own, x) for x in range(parts)] if pairs else [own]
        more_rows.append(np.full(len(tiles), i))
        more_tiles.append(np.array(tiles, np.int32))
    row = np.concatenate(more_rows)
    return row, key[row], np.concatenate(more_tiles)


def tasks(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def classes(nodes: DataFrame, limits: tuple[int, ...] = (BITS,)) -> DataFrame:
    """(node, class) of distinct ``nodes``: (fp), each its own node, or (node, fp, also) with two limits.

    Nodes are linked when fp differs in limits[0] bits at most, and also in limits[1].
    First every node meets those with the same triple of nearest codewords, one
    key each, which joins most of a tight cluster; then all keys are met and only links
    between groups are looked for. limits[0] may be four at most.
    """
    if limits[0] > 4:
        raise ValueError("the keys guarantee four bits at most")
    names = ["fp", "also"][: len(limits)]
    longs = lambda *c: ", ".join(f"{x} long" for x in c)
    nodes = nodes.select("fp", F.col("fp").alias("node")) if len(limits) == 1 else nodes
    nodes = nodes.select("node", *names)
    hot_first, hot_all = hot_keys(nodes, False), hot_keys(nodes, True)

    def coarse_keys(batches):
        for b in batches:
            node, *fps = (np.asarray(c) for c in b.columns)
            row, key, tile = spread(first_key(fps[0]), node, hot_first, False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(tile), *(pa.array(x[row]) for x in (node, *fps))], names=["key", "tile", "node", *names]
            )

    coarse = nodes.mapInArrow(
        coarse_keys, f"key long, tile int, {longs('node', *names)}"
    ).repartition("key", "tile").sortWithinPartitions("key", "tile", "node")
    grouped = stage(coarse.mapInArrow(lambda x: _coarse(x, limits), longs("node", "grp", *names)))
    plain = len(limits) == 1

    def all_keys(batches):
        for b in batches:
            node, group, *fps = (np.asarray(c) for c in b.columns)
            for at in range(0, len(node), 1000):
                row, key = fuzzy_keys(fps[0][at : at + 1000])
                row = row + at
                took, key, tile = spread(key, node[row], hot_all, True)
                row = row[took]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(tile), pa.array((group ^ fps[0] if plain else group)[row]), *(pa.array(x[row]) for x in fps)],
                    names=["key", "tile", "off", *names]
                )

    def links(batches):
        def undo(bs):
            for b in bs:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.asarray(b.column(2)) ^ np.asarray(b.column(3))), *b.columns[3:]],
                    names=["key", "tile", "grp", *names]
                )

        for a, c in near_runs(undo(batches) if plain else batches, limits):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["src", "dst"])

    # a node has some 180 keys, so few nodes are a task; where the node is its fingerprint, the
    # group travels as its difference from it, mostly zero, which compresses
    many = grouped.repartition(max(tasks(nodes.sparkSession), grouped.count() // TASK_NODES), "node")
    keys = many.mapInArrow(
        tidied(all_keys), f"key long, tile int, {longs('off', *names)}"
    ).repartition("key", "tile").sortWithinPartitions("key", "tile")
    comp = components(keys.mapInArrow(tidied(links), "src long, dst long"))
    joined = grouped.join(comp.withColumnRenamed("node", "__n"), F.col("grp") == F.col("__n"), "left")
    return joined.select("node", F.coalesce("component", "grp").alias("class"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the class).

    One row per input row. Null and empty texts have fingerprint zero and are linked
    like any other; repeated rows and equal texts share a fingerprint and so a class; a
    null doc_id never names a class that has another. Other columns are ignored. Only
    distinct fingerprints are compared, so copies cost a partial aggregate.
    """
    rows = stage(fingerprints(docs, words))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    cls = stage(classes(rows.select("fp").distinct(), (bits,)).withColumnRenamed("node", "fp"))
    low = cls.join(least, "fp").groupBy("class").agg(F.min("low").alias("component_id"))
    named = cls.join(low, "class").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = BITS, copy_bits: int = COPY_BITS) -> DataFrame:
    """The documents, one of each class of near copies: the smallest doc_id stays, a null one only where the class has no other.

    Two texts are linked when the fingerprints of their words differ in ``bits`` at most
    and those of their five-word shingles in ``copy_bits``, which is a similarity of about
    0.8; a class is what links reach. Rows of a class that share the doc_id are told apart
    by their place in the input, so one row stays whatever ids are null or repeated, and
    every class keeps a row. Texts without words are one class. Other columns are carried;
    an empty table gives no rows.
    """
    docs, *numbers = numbered(docs)
    rows = stage(fingerprints(docs, WORDS, *numbers, copies=True))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", *numbers)).alias("w")
    # equal pairs of fingerprints are one node, numbered anew as a pair is no number
    pairs = stage(rows.groupBy("fp", "also").agg(one).withColumn("node", F.monotonically_increasing_id()))
    best = classes(pairs, (bits, copy_bits)).join(pairs, "node").groupBy("class").agg(F.min("w").alias("w"))
    kept = best.select(*[F.col("w")[c].alias(c) for c in numbers])
    return without(docs, numbers, rows.join(kept, numbers, "left_anti"))
