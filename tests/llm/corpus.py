"""Small documents with everything odd in them, and plain brute-force versions to hold operators against."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Column names that operators add themselves.
CLASHING = ("n_shingles", "kept", "lang_pred", "score", "shard", "slot", "row", "at", "cls", "src", "phase", "key", "n_words", "spans")


def sentence(seed: int, n: int) -> str:
    """Words that depend on the seed and hardly repeat."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991:x}" for i in range(n))


def documents(spark, rows):
    """doc_id, text, lang, source, n_chars from (doc_id, text[, lang[, source]]), with columns of clashing names."""
    full = [(r + (None,) * 4)[:4] for r in rows]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, l, s, len(t or ""), *["x"] * len(CLASHING)) for i, t, l, s in full], names)


def odd_rows():
    long = sentence(1, 30_000)
    return [
        (1, sentence(2, 100), "en", "a"), (2, sentence(2, 100), "en", "a"), (3, sentence(2, 95) + " other end here", "en", "b"),
        (4, None, "en", "b"), (5, "", None, None), (6, " \n\t ", "fr", None), (7, "one", "fr", "c"), (8, "One", "fr", "c"),
        (9, long, "en", "a"), (10, long + " more", "en", "a"), (None, sentence(3, 50), None, "a"), (None, sentence(2, 100), "en", "a"),
        (12, sentence(4, 40), "fr", "a"), (12, sentence(4, 40), "fr", "a"), (13, "été ñandú\u0000 übel", "es", "c"), (14, "12345 .,;", "en", "c"),
    ]


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        root[find(a)] = find(b)
    return find


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
