"""Operator 12 against a plain brute force with the files' own libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tidalspan.llm import alignment
from tidalspan.llm.alignment import A_ENDS, B_ENDS, FILE_A, FILE_B, FOLDER, align_tokens, cross_tokenizer_alignment, overlaps, read_files
from tidalspan.llm.queries import QUERIES

SF = "/root/testdata"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{FOLDER}/{FILE_A}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{FILE_B}")


def plain(text, libraries):
    """(a ids, b ids, groups as lists, linked id pairs) token by token."""
    if not text:
        return [], [], [], []
    a_lib, b_lib = libraries
    letters = alignment.byte_letters()
    a = a_lib.encode(" " + text, add_special_tokens=False).ids
    b = b_lib.encode(text)
    a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(b_lib.id_to_piece, b)]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], [], []
    a_ends, b_ends, n = {}, {}, 0
    for i, x in enumerate(a_bytes):
        a_ends[n := n + len(x)] = i
    n = 0
    for i, x in enumerate(b_bytes):
        b_ends[n := n + len(x)] = i
    groups, links, i, j = [], [], 0, 0
    for end in sorted(a_ends.keys() & b_ends.keys()):
        groups.append((a[i: a_ends[end] + 1], b[j: b_ends[end] + 1]))
        i, j = a_ends[end] + 1, b_ends[end] + 1
        links.append((a[i - 1], b[j - 1]))
    return a, b, groups, links


def expected(texts, libraries):
    done = [plain(t, libraries) for t in texts]
    count = Counter(x for d in done for x in d[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for a, b, groups, links in done:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_whole_table(spark, libraries):
    folder = f"{SF}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_alignment"](spark, folder).collect()}
    assert got == dict(zip([d.doc_id for d in docs], expected([d.text for d in docs], libraries)))


def test_odd_texts(spark, libraries):
    texts = [None, "", " ", "a", "▁", "x▁y", "<|endoftext|> <s> </s> <unk> <0x41>", "  \n\t two  spaces ", "naïve 日本語 \U0001F600‍\U0001F4BB", "é",
             "\u0000\u0001", "a" * 5000, "ab " * 3000, "\r\n\r\n", "don't we'll 12345678", "a", "a"]
    docs = spark.createDataFrame([(i if i else None, t, t, i) for i, t in enumerate(texts)], "doc_id long, text string, groups string, pairs int")
    rows = cross_tokenizer_alignment(docs).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(expected(texts, libraries))
    assert sum(r.doc_id is None for r in rows) == 1


def test_empty_table(spark):
    assert cross_tokenizer_alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_are_real_and_pieces_make_no_difference(spark, libraries):
    text = "The quick brown fox, été naïve 2024! " * 20
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    files = read_files()
    whole, cut = (align_tokens(docs, files, piece=p).first() for p in (10**6, 3))
    assert whole == cut
    a, b, groups, _ = plain(text, libraries)
    assert whole.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_merge_path_pieces():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)), n) for _ in range(2))
        wanted = [(e, int((a < e).sum()), int((b < e).sum()), (e in a) * A_ENDS + (e in b) * B_ENDS) for e in sorted({*a.tolist(), *b.tolist()})]
        for piece in (1, 2, 3, 7, 1000):
            assert list(zip(*(x.tolist() for x in overlaps(a, b, piece)))) == wanted


def test_same_ids_as_the_library_of_the_file(libraries):
    t = alignment.Tokenizers(*read_files())
    for text in ("it's 1st² ١٢ ǅʰ   x　", "".join(map(chr, range(1, 700))), "\n" * 300 + " " * 300 + "." * 300):
        found = t.encode(text)
        assert found is None or found[0].tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
