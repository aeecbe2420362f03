"""Near-duplicate documents and lines, and components."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from corpus import components as brute_components
from corpus import documents, odd_rows, sentence, shingles

from tidalspan import shared
from tidalspan.llm import line_dedup
from tidalspan.llm.components import components
from tidalspan.llm.line_dedup import CROWD, LONG, _groups, fuzzy_line_dedup, lines, similar, sketches
from tidalspan.llm.line_dedup import _open_rows as line_open_rows
from tidalspan.llm.line_dedup import shingles as line_shingles
from tidalspan.llm.near_dedup import MINIMA, _open_rows, bands_of, near_duplicates


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)] + [(100, 101)],
    [(0, i) for i in range(1, 200)] + [(500, 3), (501, 500)],
    [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4)],
    [],
])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    find = brute_components(real, {x for e in real for x in e})
    least = {}
    for n in got:
        least[find(n)] = min(n, least.get(find(n), n))
    assert got == {n: least[find(n)] for n in {x for e in real for x in e}}


def near_copies():
    """A chain of edits, a large group of near copies, and texts that share half of their words."""
    rng = random.Random(5)
    rows = odd_rows()
    base = sentence(50, 120).split()
    words = list(base)
    for step in range(8):  # each a little further from the first
        words[step * 14] = f"edit{step}"
        rows.append((100 + step, " ".join(words)))
    for i in range(60):
        copy = sentence(60, 150).split()
        copy[rng.randrange(150)] = f"changed{i}"
        rows.append((200 + i, " ".join(copy)))
    rows += [(300 + i, sentence(70, 60) + " " + sentence(80 + i, 60)) for i in range(20)]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_copies()
    got = near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = [shingles(r[1]) for r in rows]
    find = brute_components([(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 75 * len(a | b)], range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    want = []
    for i, r in enumerate(rows):
        comp = least.get(find(i)) if sets[i] else r[0]
        want.append((r[0], len(sets[i]), comp, r[0] == comp))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def shuffled(spark):
    """Bytes that the session has written for shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_near_duplicates_shuffle_no_whole_texts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"{rng.getrandbits(32):08x}" for _ in range(5000))) for i in range(120)]
    rows.append((500, rows[7][1] + " more words"))
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        got = near_duplicates(documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [r.doc_id for r in got if not r.kept] == [500]
    assert shuffled(spark) - before < sum(len(t) for _, t in rows) / 2


def test_near_rows_open_each_other_in_one_bucket():
    a = np.arange(MINIMA, dtype=np.uint32)
    b = a.copy()
    b[:4] = 7  # all bands but the first
    open_rows = _open_rows(0.5)
    found = []
    for band in sorted(set(bands_of(a)[0].tolist()) & set(bands_of(b)[0].tolist())):
        rows = [(band, 0, 0, 0, n, n, m.tobytes()) for n, m in ((1, a), (2, b))]
        for out in open_rows([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], list("abcdefg"))]):
            found += [(band, c) for c in out.column(5).to_pylist()]
    assert found == [(bands_of(a)[0][1], 1), (bands_of(a)[0][1], 2)]


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert [tuple(r) for r in near_duplicates(documents(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_lines_match_brute_force(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest "
    rows = [(i, t) for i, t, *_ in odd_rows()] + [
        (30, f"{long}one\n\n  {long.upper()}one\nshort\nother line here"), (31, f"{long}two\nshort\nSHORT "), (32, f"x\n{long}one hundred\nshort"),
        (33, None), (34, "\n\n"), (35, "\n".join(f"{long}{'a' * i}" for i in range(40)))]
    got = fuzzy_line_dedup(documents(spark, rows)).collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    names = sorted({x for r in rows for _, x in lines(r[1] or "")})
    sets = {x: line_shingles(x) for x in names}
    find = brute_components([(a, b) for i, a in enumerate(names) for b in names[:i] if similar(sets[a], sets[b], 75)], names)
    owner, want = {}, []
    for i in order:
        for _, x in lines(rows[i][1] or ""):
            owner.setdefault(find(x), rows[i][0])
    for i in order:
        here, seen, gone = lines(rows[i][1] or ""), set(), []
        for n, x in here:
            if owner[find(x)] != rows[i][0] or find(x) in seen:
                gone.append(n)
            seen.add(find(x))
        want.append((rows[i][0], len(here), len(here) - len(gone), gone))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_lines_with_one_edit_are_found(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for n in range(25, 71):  # one replaced, added or lost letter anywhere, so at edit distance 1
        line = "".join(rng.choice(letters) for _ in range(n))
        at, kind = rng.randrange(n), n % 3
        edited = line[:at] + ["#", "#" + line[at], ""][kind] + line[at + 1:]
        rows += [(n, line), (100 + n, edited)]
    rows.append((500, "\n".join("".join(rng.choice(letters) for _ in range(n)) for n in range(25, 71))))  # nothing like them
    by = {r.doc_id: r for r in fuzzy_line_dedup(documents(spark, rows)).collect()}
    assert all(by[n].dropped == [] and by[100 + n].dropped == [0] for n in range(25, 71))
    assert by[500].dropped == []


def test_long_lines_of_the_same_few_letters_stay(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("etaoin shr") for _ in range(12_000))) for i in range(4)]
    assert all(r.dropped == [] for r in fuzzy_line_dedup(documents(spark, rows)).collect())
    rulers = fuzzy_line_dedup(documents(spark, [(1, "-" * 40), (2, "-" * 400)])).collect()
    assert sorted((r.doc_id, r.dropped) for r in rulers) == [(1, []), (2, [0])]


def test_lines_shuffle_few_whole_lines(spark):
    rng = random.Random(11)
    letters = lambda n: f"{rng.getrandbits(4 * n):0{n}x}"
    bases = [letters(920) for _ in range(12)]
    rows = [(i, bases[i % 12] + letters(1080)) for i in range(480)]  # of each twelfth any two have similarity 0.3
    rows.append((900, rows[5][1][:-3] + "end"))
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        got = fuzzy_line_dedup(documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [r.doc_id for r in got if r.dropped] == [900]
    assert shuffled(spark) - before < sum(len(t) for _, t in rows)


def test_open_rows_of_units_across_batches():
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    texts = [base, base[:-3] + "end", *("".join(rng.choice("0123456789") for _ in range(300)) for _ in range(3)), "#" + base]
    marks = dict(zip(range(6), sketches(texts, LONG)))
    # bucket, x, y, side, comp, cls: the alike are 0, 1 and 5; in the third unit they are of one component
    units = [(1, 0, 0, 0, n, n) for n in range(5)] + [(2, 0, -1, 0, 0, 0), (2, 0, -1, 0, 1, 1), (2, 0, -1, 1, 5, 5), (2, 0, -1, 1, 4, 4)]
    units += [(3, 0, 0, 0, 9, 0), (3, 0, 0, 0, 9, 1), (3, 0, 0, 0, 4, 4)]
    table = pa.table({c: pa.array(v, pa.int64()) for c, v in zip("abcdef", zip(*units))}).append_column(
        "short", pa.nulls(len(units), pa.binary())).append_column("long", pa.array([marks[u[5]] for u in units], pa.binary()))
    for size in (1, 2, 3, 5, 100):
        got = [tuple(r.values()) for b in line_open_rows(75)(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert got == [units[0], units[1], units[5], units[6], units[7]]


def test_unlike_lines_that_share_bands_are_not_kept(spark, monkeypatch):
    rng = random.Random(13)
    words = [f"{rng.getrandbits(24):06x}" for _ in range(100)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(9))) for i in range(4000)]  # of few words, so that bands meet
    rows += [(9000, rows[3][1] + "x"), (9001, rows[4][1] + "x")]
    count = {}

    def counted(df, name):
        out = shared.keep(df, name)
        count.setdefault(name, out.count())
        return out

    monkeypatch.setattr(line_dedup, "keep", counted)
    got = fuzzy_line_dedup(documents(spark, rows)).collect()
    assert {9000, 9001} <= {r.doc_id for r in got if r.dropped}
    assert count["sketches"] <= 200


def test_groups_of_a_bucket_follow_near_marks():
    rng = np.random.default_rng(14)
    for n in (1, 2, 5, CROWD, CROWD + 1, 3 * CROWD):
        bucket = np.sort(np.concatenate([np.full(n, 7), rng.integers(8, 30, 60)])).astype(np.uint64)
        mark = rng.integers(0, 1 << 63, (len(bucket), 2), dtype=np.uint64)
        chained = np.flatnonzero(rng.random(len(bucket)) < 0.5)
        for a, b in zip(chained, chained[1:]):  # each a few bits from the one before
            mark[b] = mark[a] ^ np.uint64(0b1011 << int(rng.integers(50)))
        find = brute_components([(i, j) for i in range(len(bucket)) for j in range(i) if bucket[i] == bucket[j]
                                 and sum(bin(int(x)).count("1") for x in mark[i] ^ mark[j]) <= 8], range(len(bucket)))
        least = {}
        for i in range(len(bucket)):
            least.setdefault(find(i), i)
        assert _groups(bucket, mark, 8).tolist() == [least[find(i)] for i in range(len(bucket))]


def test_lines_of_nothing(spark):
    assert fuzzy_line_dedup(documents(spark, [])).count() == 0
