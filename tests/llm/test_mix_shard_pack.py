"""Mixing, sharding and packing against their contracts."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import mixing, packing, sharding

from .support import SCHEMA, frame, rows


def brute_targets(sizes: dict) -> dict:
    """Targets by sharing again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("skew", [False, True])
def test_mix_follows_targets(spark, skew, monkeypatch):
    if skew:
        monkeypatch.setattr(mixing, "TIES", 3)
    data = rows(300)
    if skew:
        data += [(1000 + i, "hot text here", "en", "src1", 1) for i in range(200)] + [(5000 + i, "tiny", "en", "one", 1) for i in range(2)]
    got = mixing.mix(frame(spark, data)).collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s, _ in data:
        sizes[s] += size(t)
    want, taken, most = brute_targets(sizes), Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(frame(spark, data).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_is_the_same_in_cells(spark, duck, monkeypatch, tmp_path):
    """Whole groups in one window, three rows a cell, and SQL: the same copies of the same ids."""
    from quern.llm.queries import oracle_sql

    data = rows(200) + [(1000 + i, "hot text here", "en", "src1", 1) for i in range(300)] + [(None, "hot text here", "en", "src1", 1)] * 50 + [(7, "hot text here", "en", None, 1)] * 30
    docs = frame(spark, data)
    keys = []
    for ties in (10**9, 10_000, 3):
        monkeypatch.setattr(mixing, "TIES", ties)
        keys.append(sorted(str((r.doc_id, r.source, r.size, r.copies)) for r in mixing.mix(docs.repartition(3)).collect()))
    assert keys[0] == keys[1] == keys[2]
    import duckdb

    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    q = con.sql(oracle_sql()["op3_mixing"])
    at = [q.columns.index(c) for c in ("doc_id", "source", "size", "copies")]
    assert sorted(str(tuple(r[i] for i in at)) for r in q.fetchall()) == keys[0]


def test_mix_of_empty_table_and_of_empty_texts(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", 0)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_emit_repeats_rows(spark):
    data = rows(100)
    want = Counter()
    for r in mixing.mix(frame(spark, data)).collect():
        want[r.doc_id] += r.copies
    out = mixing.emit(frame(spark, data))
    assert out.columns == frame(spark, data).columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == +want
    text = {}
    for i, t, *_ in data:
        text.setdefault(i, set()).add(t)
    assert all(r.text in text[r.doc_id] for r in got)


def test_mix_matches_sql(spark, duck):
    from quern.llm.queries import oracle_sql, queries

    d = "/root/testdata/sf0.001"
    key = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for _, v in sorted(r.items()))
    assert sorted(key(r.asDict()) for r in queries()["op3_mixing"](spark, d).collect()) == sorted(key(r) for r in duck(oracle_sql()["op3_mixing"], d))


def test_shards_hold_equal_counts(spark):
    data = rows(500) + [(7, "same", "en", "x", 4)] * 100 + [(None, None, None, None, None)] * 20
    got = sharding.shard(frame(spark, data)).collect()
    assert len(got) == len(data)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t, *_ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == want
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("run", [10_000, 4])
def test_shards_match_a_walk_row_by_row(spark, run, monkeypatch):
    """Each row starts at its position and goes on clockwise to the first node whose shard has room; rows arrive along the ring."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "RUN", run)
    data = rows(300) + [(7, "same", "en", "x", 4)] * 60 + [(None, None, None, None, None)] * 20
    docs = frame(spark, data)
    nodes = sharding.ring(spark, 5, 16)
    assert len(set(nodes)) == 80 and sorted(nodes) == nodes
    text = F.coalesce("text", F.lit(""))
    at = F.xxhash64("doc_id", F.crc32(F.encode(text, "UTF-8")).cast("long"), (F.octet_length(text) + 1).cast("long"))
    where = [(r.doc_id, zlib.crc32((r.text or "").encode()), r.at) for r in docs.select("doc_id", "text", at.alias("at")).collect()]
    first = [next((k for k, (p, _) in enumerate(nodes) if p >= x), 0) for *_, x in where]
    along = lambda i: (first[i], (where[i][2] - nodes[first[i] - 1][0]) % (1 << 64))
    room = [len(where) // 5 + (s < len(where) % 5) for s in range(5)]
    want, moved = Counter(), 0
    for i in sorted(range(len(where)), key=along):
        k = first[i]
        while not room[nodes[k % 80][1]]:
            k += 1
        moved += k != first[i]
        room[nodes[k % 80][1]] -= 1
        want[where[i][0], where[i][1], nodes[k % 80][1], nodes[first[i]][1]] += 1
    got = Counter((r.doc_id, r.text_crc32, r.shard, r.home_shard) for r in sharding.shard(docs, 5, 16).collect())
    assert moved and got == want


def test_shards_move_few_rows_when_one_is_added(spark):
    data = [(i, f"text {i}", "en", "s", 1) for i in range(4000)]
    a, b = ({r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(data, SCHEMA), n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.15 * len(a)  # an even split moves 1/9, a plain modulo 8/9
    assert sum(sharding.fill([5, 0, 9, 1], [0, 1, 2, 0], 3)[1]) == 15


def test_ring_walk_overflows_clockwise():
    pieces, used = sharding.fill([9, 0, 0], [0, 1, 2], 3)
    assert pieces == [(0, 0, 3, 0, 0), (0, 3, 6, 1, 0), (0, 6, 9, 2, 0)] and used == [3, 3, 3]


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(packing.vocabulary())


def test_encoder_agrees_with_the_tokenizer(spark, tokenizer):
    texts = [r[1] or "" for r in rows(60)] + ["İstanbul CAFÉ́ x y　z e ́", "don't 12,345.67 #tag @you https://a.b/c?d=e", "a\x1cb\x85c ​d", "﻿x \U0001f468‍\U0001f469"]
    e = packing.Encoder(packing.vocabulary())
    ids, ends = e(pa.array([None, *texts, ""]).slice(1))
    for t, lo, hi in zip(texts, ends, ends[1:]):
        assert ids[lo:hi].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_words_that_differ_in_case_and_end_signs_are_encoded_once(tokenizer):
    """The tokenizer's added tokens keep their case and signs."""
    texts = ["word Word! word&&& WORD... word,\"' word", "<|STARTOFTEXT|> a<|endoftext|> x<|EndOfText|>! <|startoftext|>.", "it's it'S' o'' don'T. a\x01b!! ß!? é... 12!!! ''' ...", "a-b-- c_d__ e>> f<|"]
    e = packing.Encoder(packing.vocabulary())
    assert not e.plain
    for _ in range(2):  # the second time from what is remembered
        ids, ends = e(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [w for w in e.known if "word" in w.lower()] == ["word"]


def test_other_tokenizers_encode_whole_texts(tokenizer):
    """One that keeps white space and case is noticed and gives its own ids."""
    import tokenizers

    path = packing.vocabulary("byte_bpe_50k.json")
    e, tok = packing.Encoder(path), tokenizers.Tokenizer.from_file(path)
    assert e.plain and not packing.Encoder(packing.vocabulary()).plain
    texts = ["The  Quick brown", None, "", "a\tb"]
    ids, ends = e(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pack_places_every_token(spark, tokenizer):
    data = rows(150)
    got = packing.pack(frame(spark, data)).collect()
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    want = Counter()
    for i, t, *_ in data:
        x = ids(t)
        for k in range(0, len(x), 2048):
            p = x[k : k + 2048]
            want[i, k // 2048, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pack_in_many_cells_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 20)
    got = packing.pack(frame(spark, rows(150))).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048


def test_sum_of_squares_packs_tightly():
    rng = np.random.default_rng(4)
    sizes = np.sort(np.minimum(2047, rng.lognormal(5.8, 1, 20_000).astype(int) + 1))[::-1]
    b, o = packing.packed(sizes)
    fill = np.bincount(b, weights=sizes)
    assert fill.max() <= 2048 and len(fill) <= 1.01 * np.ceil(sizes.sum() / 2048)
