"""The corpus pipeline against a brute-force version, stage by stage."""

from __future__ import annotations

from collections import Counter

from quern.llm import toxicity

from .test_mix_shard_pack import brute_targets
from .test_pairs import brute_copies, norm

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in c.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    out = [docs]
    for _, f in c.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    rows = [x.collect() for x in out]
    assert all(x.columns == docs.columns for x in out[:-1])
    lex = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    a = lex.automaton()
    clean = [r for r in rows[0] if toxicity.score_of(toxicity.measures(toxicity.fold(r.text), a, lex.exceptions), lex.curve) < 0.7]
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in clean}
    groups = {}
    for r in rows[1]:
        groups.setdefault(norm(r.text), []).append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in rows[2]} == {min(g)[1] for g in groups.values()}
    cls = brute_copies([r.text for r in rows[2]])
    low = {}
    for r, k in zip(rows[2], cls):
        low[k] = min(low.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in rows[3]) == sorted(low.values())
    sizes, taken = Counter(), Counter()
    for r in rows[3]:
        sizes[r.source] += len(r.text.encode().split())
    for r in rows[4]:
        taken[r.source] += len(r.text.encode().split())
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 2 * max(len(r.text.encode().split()) for r in rows[3] if r.source == s)
    assert Counter(r.doc_id for r in rows[5] if r.piece == 0) == Counter(r.doc_id for r in rows[4])
    assert sorted(map(str, c.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(str, out[5].drop("sequence_id", "offset").collect()))
