"""Operator 11 against brute force on odd and on real documents."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from corpus import documents, odd_rows, sentence

from tidalspan.llm.divergence import quality_rules

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "language"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def kind(c):
    if c in " \t\n\x0b\x0c\r":
        return 1
    k = unicodedata.category(c)
    return {"Ll": 0, "Lu": 2}.get(k, {"L": 3, "M": 3, "N": 4, "P": 5}.get(k[0], 6))


def apart(p, q):
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    half = lambda x: sum(v * math.log2(v / m[k]) for k, v in x.items() if v > 0)
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2))


def shares(counts):
    total = sum(counts.values())
    return {k: v / total for k, v in counts.items()}


def brute(rows, common=100):
    """(the columns above, word distance, class distance) of (doc_id, text, lang) rows."""
    per_lang, classes = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang in rows:
        if lang is not None and text:
            per_lang[lang].update(words(text))
            classes[lang].update(map(kind, text))
    refs = {}
    for lang in sorted(x for x in per_lang if per_lang[x]):
        total = sum(per_lang[lang].values())
        top = sorted(per_lang[lang].items(), key=lambda x: (-x[1], x[0].encode()))[:common]
        refs[lang] = ({w: n / total for w, n in top}, shares(classes[lang]))
    out = []
    for _, text, _ in rows:
        text = text or ""
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        runs = Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if runs[tuple(w[i: i + 8])] > 1 for j in range(i, i + 8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        best = (math.inf, None, None, None)
        for lang, (known, by_class) in refs.items():
            wd = cd = None
            if len(w) >= 50:
                mine = Counter(x if x in known else None for x in w)
                wd = apart(shares(mine), known | {None: 1 - sum(known.values())})
            if len(text) >= 300:
                cd = apart(shares(Counter(map(kind, text))), by_class)
            if wd is not None or cd is not None:
                best = min(best, ((wd or 0) + (cd or 0), lang, wd, cd), key=lambda x: x[0])
        _, lang, wd, cd = best
        kept = not failed and (wd is None or wd <= 0.26 + 2 / math.sqrt(len(w))) and (cd is None or cd <= 0.16 + 2.4 / math.sqrt(len(text)))
        out.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed, kept, lang, wd, cd))
    return out


def same(got, wanted):
    order = lambda x: str(x[:8])
    for a, b in zip(sorted(got, key=order), sorted(wanted, key=order), strict=True):
        assert a[:8] == b[:8]
        for x, y in zip(a[8:], b[8:]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)


def judged(frame):
    return [tuple(r[c] for c in [*COLUMNS, "word_distance", "class_distance"]) for r in quality_rules(frame).collect()]


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    same(judged(docs), brute(rows))


def test_odd_documents(spark):
    run = sentence(5, 8)
    extra = [(20, f"{run} {run}", "en"), (21, f"{run} {sentence(6, 20)} {run}", "en"), (22, "a " * 500, "en"), (23, "a b " * 40 + sentence(9, 300), "fr"), (24, "# * $ % & | < > " * 30, None),
             (25, "x\ny\r\nx\n \nx\ny\r\n", "en"), (26, "  \u0085 é ß ǅ ª 漢字 \U0001F600 ½ " * 20, "en"), (27, sentence(7, 60).upper(), "en")]
    rows = [(*r, None, None)[:3] for r in [*odd_rows(), *extra]]
    same(judged(documents(spark, [*odd_rows(), *extra])), brute(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (None, " \n")], [(1, sentence(1, 80))]])
def test_without_references(spark, rows):
    same(judged(documents(spark, rows)), brute([(i, t, None) for i, t in rows]))


def test_clean_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    got = quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean, junk = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert all(clean) and sum(junk) / len(junk) < 0.2


def test_no_python(spark):
    plan = quality_rules(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
