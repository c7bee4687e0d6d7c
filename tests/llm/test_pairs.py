"""SimHash near-dedup and exact dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quern.llm import exact, simhash

from .support import SCHEMA, find, frame, prose, rows


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(4, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_classes(fps: list[int]) -> dict[int, int]:
    parent = {f: f for f in fps}
    u = sorted(parent)
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {f: find(parent, f) for f in u}


def check_near(got, data):
    want = [(i, plain_fingerprint(t)) for i, t, *_ in data]
    cls = brute_classes([f for _, f in want])
    low = defaultdict(list)
    for i, f in want:
        if i is not None:
            low[cls[f]].append(i)
    want = sorted(((i, f"{f:016x}", min(low[cls[f]], default=None)) for i, f in want), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_golay_keys_meet():
    rng = random.Random(5)
    for n in range(5):
        for _ in range(40):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            a, c = (set(simhash.fuzzy_keys(np.array([v], np.uint64).view(np.int64))[1].tolist()) for v in (x, y))
            assert a & c


def test_every_word_decodes_within_three_bits():
    x = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    assert np.bitwise_count(simhash.LEADER[simhash._syndrome(x)]).max() <= 3
    assert len(np.unique(simhash.LEADER)) == 2048


def test_near_duplicates_match_brute_force(spark):
    data = rows()
    check_near(simhash.near_duplicates(frame(spark, data)).collect(), data)


@pytest.mark.parametrize("part", [20_000, 5])
def test_near_duplicates_of_planted_fingerprints(spark, part, monkeypatch):
    """Chains and large tight clusters, links across the sign bit included, also with keys split into many tiles."""
    if part == 5:
        monkeypatch.setattr(simhash, "PART", 5)
        monkeypatch.setattr(simhash, "SAMPLE", 1)
    rng = random.Random(2)
    fps = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            x2 = x
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x2 ^= 1 << b
            fps.append(x2)
            if rng.random() < 0.1:
                x = x2
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = {r[0]: r[1] for r in simhash.classes(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = brute_classes([f & (1 << 64) - 1 for f in fps])
    pairs = lambda m: {frozenset(g) for g in (lambda d: [d[m[k]].append(k) for k in m] and d.values())(defaultdict(list))}
    assert pairs({k & (1 << 64) - 1: v for k, v in got.items()}) == pairs(want)


def test_near_duplicates_of_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        simhash.classes(spark.createDataFrame([], "fp long"), (5,))


def plain_bits(hashes_and_weights):
    total = sum(w for _, w in hashes_and_weights)
    return sum(1 << b for b in range(64) if 2 * sum(w for h, w in hashes_and_weights if h >> b & 1) > total)


def plain_copy(text):
    """The two fingerprints of near copies, a feature at a time."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0, 0
    h = lambda x: xxhash.xxh64_intdigest(x, 42)
    k = min(5, len(w))
    return plain_bits([(h(x), round(1024 * (1 + math.log(w.count(x))))) for x in set(w)]), plain_bits([(h(x), 1) for x in {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}])


def brute_copies(texts, bits=4, copy_bits=12):
    """Class of each text by all pairs."""
    f = [plain_copy(t) for t in texts]
    parent = {i: i for i in range(len(f))}
    for i, a in enumerate(f):
        for j in range(i):
            if (a[0] ^ f[j][0]).bit_count() <= bits and (a[1] ^ f[j][1]).bit_count() <= copy_bits:
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return [find(parent, i) for i in range(len(f))]


def check_kept(kept, data):
    """One row of each class stays, with the smallest doc_id of the class, null last."""
    texts = [r[1] for r in data]
    cls = brute_copies(texts)
    of = dict(zip(texts, cls))
    best = {}
    for r, c in zip(data, cls):
        best[c] = min(best.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted(of[r.text] for r in kept) == sorted(best)
    assert all((r.doc_id is None, r.doc_id or 0) == best[of[r.text]] for r in kept)


def near_copies(seed=12, n=40):
    """Texts, each with some copies in which words are changed, dropped or put in."""
    rng, out = random.Random(seed), []
    for i in range(n):
        w = prose(rng, rng.randint(60, 250)).split()
        out.append((i, " ".join(w)))
        for k in range(rng.randint(0, 3)):
            v = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 60))):
                v[rng.randrange(len(v))] = prose(rng, 1)
            out.append((1000 + 10 * i + k, " ".join(v)))
    return [(i, t, "en", "s", 1) for i, t in out]


@pytest.mark.parametrize("part", [20_000, 3])
def test_keep_one_of_each_class(spark, part, monkeypatch):
    """Also where every key of four fingerprints is split."""
    if part == 3:
        monkeypatch.setattr(simhash, "PART", 3)
        monkeypatch.setattr(simhash, "SAMPLE", 1)
    data = rows() + near_copies()
    kept = simhash.keep_one(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    check_kept(kept.collect(), data)


def test_keep_one_finds_most_near_copies(spark):
    data = near_copies(n=80)
    got = {r.doc_id for r in simhash.keep_one(frame(spark, data)).collect()}
    copies = [r for r in data if r[0] >= 1000]
    assert set(range(80)) <= got and sum(r[0] not in got for r in copies) >= 0.8 * len(copies)


def test_keep_one_with_null_and_repeated_ids(spark, tmp_path):
    """Null ids do not make different texts one, nor does an id that two texts share; on a staged table and on files."""
    rng = random.Random(8)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    data = [(i, t, "en", "s", 1) for i, t in [(None, a), (None, b), (None, b), (None, c), (3, c), (5, d), (5, e), (4, d), (5, e), (6, None), (6, "")]]
    docs = frame(spark, data).repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    for t in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        kept = simhash.keep_one(t)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted([(None, a), (None, b), (3, c), (4, d), (5, e), (6, "")], key=str)
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_names_of_ours_among_the_columns(spark):
    """Columns that are called as the stages' own ones stay as they are."""
    from pyspark.sql import functions as F

    from quern.llm import mixing

    data = [r for r in rows(40)]
    names = ("__file", "__row", "__copy", "_a", "_b", "_k", "__id", "__d", "_s", "rid", "w", "node")
    docs = spark.createDataFrame(data, SCHEMA).withColumns({n: F.lit(7) for n in names})
    for f in (simhash.keep_one, exact.keep_first, mixing.emit):
        out = f(docs)
        assert out.columns == docs.columns and all(r[n] == 7 for r in out.collect() for n in names)


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def brute_exact(data):
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t, *_ in data:
        g = groups[norm(t)]
        w = min(g)
        out.append((i, None if w[1] else w[2], len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_duplicates_match_brute_force(spark):
    data = rows()
    got = exact.exact_duplicates(frame(spark, data)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(data)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert {r.known for r in got} == {True, False}
    assert exact.exact_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_keeps_the_longer_of_old_and_new(spark):
    data = [(1, "a b", None, None, 0), (2, "c", None, None, 0), (9, "a  b ", None, None, 0), (8, "x", None, None, 0), (7, "x", None, None, 0), (None, "c", None, None, 0)]
    got = {(r.doc_id, r.keep_id, r.kept, r.known) for r in exact.exact_duplicates(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {(1, 9, False, True), (9, 9, True, True), (2, 2, True, True), (None, 2, False, True), (7, 7, True, False), (8, 7, False, False)}


def test_perfect_hash_is_minimal_and_checks_bytes():
    words = exact.as_words([hashlib.sha256(str(i).encode()).digest() for i in range(3000)])
    h = exact.PerfectHash.load(*exact.PerfectHash.build(words).dump())
    assert sorted(h.slots(words).tolist()) == list(range(3000))
    other = exact.as_words([hashlib.sha256(f"x{i}".encode()).digest() for i in range(3000)])
    s = h.slots(other)
    inverse = np.argsort(h.slots(words))
    assert not (words[inverse[s[s >= 0]]] == other[s >= 0]).all(axis=1).any()
    with pytest.raises(ValueError):
        exact.PerfectHash.build(np.concatenate((words[:1], words[:1])))


def test_runs_stay_whole_over_batches():
    key = np.repeat([3, 5, 6, 9], [1, 700, 2, 40]).astype(np.int64)
    tile = np.zeros(len(key), np.int32)
    tile[300:701] = 1
    at = np.arange(len(key))
    for n in (1, 7, 100, 5000):
        got = list(simhash.runs((pa.RecordBatch.from_arrays([pa.array(x[i : i + n]) for x in (key, tile, at)], names=list("abc")) for i in range(0, len(key), n)), 2))
        assert np.concatenate([x[2] for x in got]).tolist() == at.tolist()
        ends = [(x[0][-1], x[1][-1]) for x in got]
        assert len(set(ends)) == len(ends) and all((a[0][-1], a[1][-1]) != (b[0][0], b[1][0]) for a, b in zip(got, got[1:]))


def test_keep_first_of_null_and_repeated_ids(spark):
    data = [(i, t, "en", "s", 1) for i, t in [(None, "a b"), (None, "ab "), (None, "c"), (2, "c"), (2, "d"), (2, "d"), (3, None), (1, "")]]
    kept = exact.keep_first(frame(spark, data)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("None", "a b"), ("2", "c"), ("2", "d"), ("1", "")])


def test_keep_first_keeps_whole_rows(spark):
    data = rows()
    kept = exact.keep_first(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t, *_ in data})


def test_exact_matches_sql(spark, duck):
    from quern.llm.queries import oracle_sql, queries

    d = "/root/testdata/sf0.001"
    got = sorted(tuple(sorted(r.asDict().items())) for r in queries()["op9_exact"](spark, d).collect())
    assert got == sorted(tuple(sorted(r.items())) for r in duck(oracle_sql()["op9_exact"], d))
