"""Sharding and mixing."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from corpus import CLASHING, documents, odd_rows, sentence

from tidalspan.llm import sharding
from tidalspan.llm.mixing import mix_sources, period, places_of, schedule, shares_of
from tidalspan.llm.sharding import hypergeometric, matrix, piece_sizes, shuffle_into_shards


def test_matrix_has_exact_margins_and_the_right_law():
    blocks, pieces = np.array([5, 0, 7, 8]), np.array([6, 7, 7])
    total = np.zeros((4, 3))
    for seed in range(400):
        m = matrix(blocks, pieces, seed)
        assert (m.sum(axis=1) == blocks).all() and (m.sum(axis=0) == pieces).all()
        total += m
    assert np.abs(total / 400 - np.outer(blocks, pieces) / 20).max() < 0.2
    rng = np.random.default_rng(1)
    big = [hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(50)]  # beyond numpy's sampler
    assert abs(np.mean(big) - 750_000) < 400 and np.std(big) > 100
    sizes, per = piece_sizes(1003, 16, 8, 10, 1)
    shards = sizes.reshape(16, per).sum(axis=1)
    assert shards.sum() == 1003 and shards.max() - shards.min() == 1


def test_shards(spark):
    rows = [(i, f"text {i % 7}") for i in range(997)] + odd_rows()
    df = documents(spark, rows).repartition(5)
    out = shuffle_into_shards(df, 7, piece_rows=40).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, ((r[0], r[1]) for r in rows)))
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    assert set(out[0].asDict()) == set(df.columns)  # those called shard and slot are replaced
    from_first = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(from_first, range(len(from_first)))[0, 1]) < 0.15
    assert shuffle_into_shards(documents(spark, [])).count() == 0
    assert [(r.shard in range(16), r.slot) for r in shuffle_into_shards(documents(spark, [(1, None)])).collect()] == [(True, 0)]


def test_shards_of_files_need_no_copy(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", "x") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(4)
    frame.write.parquet(str(tmp_path / "docs"))
    frame.where("false").write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    with monkeypatch.context() as m:
        m.setattr(sharding, "keep", None)
        out = shuffle_into_shards(docs, 3, piece_rows=20)
        got = out.collect()
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, got))  # a second run decides the same
    assert sorted((r.doc_id, r.text, r.file) for r in got) == rows
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == [0, 1, 2] and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert len({r.doc_id for r in shuffle_into_shards(docs.where("doc_id % 2 = 0"), 3).collect()}) == 250  # a filter leaves gaps


@pytest.mark.parametrize("shares", [{0: 1}, {0: 500, 1: 300, 2: 200}, {0: 997, 1: 1, 2: 1, 3: 1}, dict(enumerate([7, 5, 3, 3, 2, 1]))])
def test_period_keeps_every_source_within_one_block(shares):
    places, total = period(shares), sum(shares.values())
    at = {t: s for s, p in places.items() for t in p}
    assert sorted(at) == list(range(total))
    done = Counter()
    for t in range(total):
        done[at[t]] += 1
        assert all(abs(done[s] - (t + 1) * a / total) < 1 for s, a in shares.items())


def test_schedule_goes_on_when_sources_run_out():
    blocks, shares = {0: 40, 1: 3, 2: 17, 3: 0}, {0: 3, 1: 5, 2: 2, 3: 1}
    plan = schedule(blocks, shares)
    seen = {}
    for s, phases in plan.items():
        for phase, first, past, share, total, slot, places in phases:
            for b in range(first, past):
                q = b - first
                t = slot + q // share * total + places[q % share]
                assert slot + q * total // share <= t < slot - (-(q + 1) * total // share)
                seen[t] = s
    assert sorted(seen) == list(range(60)) and Counter(seen.values()) == Counter({0: 40, 1: 3, 2: 17})
    assert plan[3] == []


@pytest.mark.parametrize("weights, blocks", [
    ([1 / 3] + [2 / 57] * 19, [20_000] + [2000] * 19),  # thousandths are 14 blocks off
    ([math.sqrt(n) for n in (90_000, 30_011, 7, 1234)], [5625, 1876, 1, 78]),
    ([1 / 3] + [2 / 9000] * 3000, [3000] + [3] * 3000),  # more sources than thousandths
])
def test_schedule_keeps_to_the_weights_themselves(weights, blocks):
    plan = schedule(dict(enumerate(blocks)), dict(enumerate(shares_of(weights))))
    at = sorted((slot, phase, s, release, deadline) for s, _, phase, release, deadline, slot in places_of(plan))
    assert [a[0] for a in at] == list(range(sum(blocks))) and all(r <= t < d for t, _, _, r, d in at)
    live, done, phase, start = set(range(len(blocks))), Counter(), 0, 0
    placed = Counter()
    for t, p, s, *_ in at:
        if p != phase:
            live, phase, start = {x for x in live if placed[x] < blocks[x]}, p, t
            done = Counter()
        done[s] += 1
        placed[s] += 1
        if t % 50 == 0 or t < 1000:
            total = sum(weights[x] for x in live)
            assert all(abs(done[x] - (t + 1 - start) * weights[x] / total) < 1 + 1e-9 for x in live)
    assert placed == Counter(dict(enumerate(blocks)))


def test_mixture_keeps_to_the_weights_themselves(spark):
    weights = {"a": 1.0, "b": 1999.0}  # thousandths give each of them 1 and 1000
    df = spark.range(4001).selectExpr("id as doc_id", "if(id % 2000 = 0, 'a', 'b') as source", "'' as text")
    slots = [r.slot for r in mix_sources(df, weights, block_rows=1).where("source = 'a'").orderBy("slot").collect()]
    assert len(slots) == 3 and all(2000 * q <= t < 2000 * (q + 1) for q, t in enumerate(slots))


def test_mixture(spark):
    rows = [(i, sentence(i, 3), None, "big") for i in range(300)] + [(1000 + i, "x", None, f"s{i % 3}") for i in range(90)] + odd_rows()
    df = documents(spark, rows)
    out = mix_sources(df, {"big": 2.0, "s0": 1.0, "s1": 1.0, "s2": -1.0}, block_rows=4, resolution=20).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.source) for r in out))) == sorted(map(str, ((r[0], r[1], (r + (None,) * 3)[3]) for r in rows)))
    blocks = {}
    for r in out:
        blocks.setdefault((r.source, r.source_block), []).append(r)
        assert r.release <= r.slot < r.deadline
    assert sorted({b[0].slot for b in blocks.values()}) == list(range(len(blocks)))
    assert all(sorted(r.row_in_block for r in b) == list(range(len(b))) and len(b) <= 4 for b in blocks.values())
    order = [b[0].source for b in sorted(blocks.values(), key=lambda b: b[0].slot)]
    assert Counter(order[:28]) == Counter({"big": 14, "s0": 7, "s1": 7})  # until the small ones run out
    behind = [b[0].slot for (s, _), b in blocks.items() if s not in ("big", "s0", "s1")]
    assert min(behind) == len(blocks) - len(behind)  # what has no weight comes last
    assert set(out[0].asDict()) >= set(df.columns) and len(CLASHING) > 5
    assert mix_sources(documents(spark, [])).count() == 0
    assert mix_sources(documents(spark, [(None, None)])).select("slot").collect()[0].slot == 0
    weights = [math.sqrt(300), math.sqrt(30)]
    assert weights[0] > weights[1]
