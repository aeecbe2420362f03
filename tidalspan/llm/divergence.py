"""Quality rules: repetition and length, and how far a document's histograms lie from those of its language.

A language's reference is learned from all documents that are marked with it: the shares of the classes of characters,
and the shares of its commonest words with all other words as one more share.  A document is held against every
reference by the Jensen-Shannon distance (base 2, so from 0 to 1) of both histograms and judged by the nearest one.  A
histogram of few samples is far from its source by chance alone, by a distance that falls with the root of their number.
So the limits fall with it too, and short documents are not judged at all.

Everything is DataFrame expressions.  A document's words stay in its row as an array of hashes; runs of eight words are
hashed by doubling (1, 2, 4, 8), sorted to find what occurs twice, and no word is shuffled but for counting the words of
a language, which aggregates before it shuffles.  A reference has a bounded number of words, so what is written into
the plan has a size of its own for each language.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalspan.llm.store import keep

SPACES, WINDOW = r"[\x20\x09-\x0D]+", 8
#: Classes of characters; what is in none of them is the last.
CLASSES = {"lower": r"\p{Ll}+", "space": SPACES, "upper": r"\p{Lu}+", "letter": r"[\p{Lt}\p{Lm}\p{Lo}\p{M}]+", "digit": r"\p{N}+", "mark": r"\p{P}+", "other": None}
COMMON = 100
LEAST_WORDS, LEAST_CHARS = 50, 300
#: Limits of the distances: the first number plus the second by the root of the words or characters.
WORDS_APART, CLASSES_APART = (0.26, 2.0), (0.16, 2.4)
MIN_WORDS, REPEATED_PERCENT = 20, 30


def words_of(text: str) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _paired(hashes: str, step: int) -> Column:
    """Hash of each entry with the one ``step`` further on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, F.lit(1 + step), n), lambda x, y: F.xxhash64(x, y))


def with_measures(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes (array of counts) and hashes of the words.

    ``docs`` has a column text without nulls.
    """
    df = docs.withColumn("words", words_of("text")).withColumn("n_words", F.size("words").cast("bigint"))
    df = df.withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("bigint"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).drop("words", "lines")
    # Character classes: what one class leaves is all that the next has to look at.
    counts, rest = [], F.col("text")
    for i, pattern in enumerate(CLASSES.values()):
        if pattern is None:
            counts.append(F.char_length(f"left{i - 1}"))
            continue
        df = df.withColumn(f"left{i}", F.regexp_replace(rest, pattern, ""))
        counts.append(F.char_length(rest) - F.char_length(f"left{i}"))
        rest = F.col(f"left{i}")
    df = df.withColumn("classes", F.array(*[c.cast("bigint") for c in counts]))
    symbols = F.char_length(F.regexp_replace("left1", r"[^#*$%&|<>]+", "")).cast("bigint")  # neither letters nor spaces
    df = df.withColumn("n_symbols", symbols).drop("text", *[f"left{i}" for i in range(len(CLASSES) - 1)])
    # Windows of eight words that occur twice or more.
    for into, of, step in (("h2", "hashes", 1), ("h4", "h2", 2), ("h8", "h4", 4)):
        df = df.withColumn(into, _paired(of, step))
    placed = F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), placed)).drop("h2", "h4", "h8")
    hash_at = lambda k: F.get(F.col("placed"), k - 1)["h"]
    same = F.filter(F.sequence(F.lit(1), F.size("placed")), lambda k: F.coalesce(hash_at(k) == hash_at(k - 1), F.lit(False)) | F.coalesce(hash_at(k) == hash_at(k + 1), F.lit(False)))
    df = df.withColumn("same", F.when(F.col("placed").isNotNull(), same))
    df = df.withColumn("starts", F.sort_array(F.transform("same", lambda k: F.get(F.col("placed"), k - 1)["i"])))
    covered = F.transform("starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), i + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("bigint")).drop("placed", "same", "starts")


def common_words(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(lang, word, share): the commonest words of every language and their shares of its words, ties by the word."""
    counts = docs.where("lang is not null").select("lang", F.explode(words_of("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = keep(counts, "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    first = counts.withColumn("place", place).where(F.col("place") <= common)
    return first.join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("share"))


def _literal(value: object, kind: str) -> Column:
    """A nested constant."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _term(p: Column, q: Column) -> Column:
    """One entry of twice the Jensen-Shannon divergence."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return part(p) + part(q)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), twice / 2))


def _word_distance(i: int, shares: float) -> Column:
    """Distance of the entries found from reference ``i``, whose common words have ``shares`` of its words.

    Common words that the document lacks add their share; those that it has replace it.
    """
    def step(a: Column, x: Column) -> Column:
        q = x["q"][i]
        return F.when(q > 0, F.struct((a["d"] + _term(x["p"], q) - q).alias("d"), (a["p"] + x["p"]).alias("p"))).otherwise(a)

    def end(a: Column) -> Column:
        return _distance(a["d"] + _term(F.greatest(F.lit(0.0), 1 - a["p"]), F.lit(1 - shares)))

    return F.aggregate("found", F.struct(F.lit(shares).alias("d"), F.lit(0.0).alias("p")), step, end)


def with_word_distances(df: DataFrame, words: list[tuple[str, list[tuple[int, float]]]]) -> DataFrame:
    """Add far: per reference (language, [(hash of a word, share)]) the distance of the histograms of common words."""
    shares: dict[int, list[float]] = {}
    for at, (_, known) in enumerate(words):
        for h, q in known:
            shares.setdefault(h, [0.0] * len(words))[at] = q
    n_buckets = 1 << max(4, (2 * len(shares)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(n_buckets)]
    for h, q in shares.items():
        buckets[h & (n_buckets - 1)].append({"h": h, "q": q})
    df = df.withColumn("keys", _literal([[x["h"] for x in b] for b in buckets], "array<array<bigint>>"))
    df = df.withColumn("table", _literal(buckets, "array<array<struct<h:bigint,q:array<double>>>>"))
    slot = lambda h: h.bitwiseAND(n_buckets - 1).cast("int")
    df = df.withColumn("sorted", F.sort_array(F.filter("hashes", lambda h: F.array_contains(F.get(F.col("keys"), slot(h)), h)))).drop("hashes")
    at = lambda k: F.get(F.col("sorted"), k - 1)
    changes = F.filter(F.sequence(F.lit(1), F.size("sorted")), lambda k: (k == 1) | (at(k) != at(k - 1)))
    df = df.withColumn("changes", F.when(F.size("sorted") > 0, changes).otherwise(F.array().cast("array<int>")))
    ends = lambda j: F.coalesce(F.get(F.col("changes"), j + 1), F.size("sorted") + 1)
    df = df.withColumn("counted", F.transform("changes", lambda k, j: F.struct(at(k).alias("h"), ((ends(j) - k) / F.col("n_words")).alias("p"))))
    entry = lambda h: F.get(F.filter(F.get(F.col("table"), slot(h)), lambda y: y["h"] == h), F.lit(0))["q"]
    df = df.withColumn("found", F.transform("counted", lambda x: F.struct(x["p"].alias("p"), entry(x["h"]).alias("q")))).drop("sorted", "changes", "counted", "keys", "table")
    far = [_word_distance(i, sum(q for _, q in known)) for i, (_, known) in enumerate(words)]
    return df.withColumn("far", F.array(*far) if far else F.array().cast("array<double>")).drop("found")


def class_distances(classes: Column, references: list[list[float]]) -> Column:
    """Per reference the distance of the histograms of character classes."""
    total = F.nullif(sum((classes[i] for i in range(1, len(CLASSES))), classes[0]), F.lit(0))
    out = [_distance(sum((_term(classes[i] / total, F.lit(q)) for i, q in enumerate(ref)), F.lit(0.0))) for ref in references]
    return F.array(*out) if out else F.array().cast("array<double>")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: int = COMMON, least_words: int = LEAST_WORDS,
                  least_chars: int = LEAST_CHARS, words_apart: tuple[float, float] = WORDS_APART, classes_apart: tuple[float, float] = CLASSES_APART) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, language, word_distance, class_distance.

    base_failed: fewer than 20 words, or over 30 % of the words in windows of eight that the text has twice.  kept is
    false for these; others are kept unless a histogram is too far (``words_apart``, ``classes_apart``) from the nearest
    reference, which is the language of the smallest sum of distances (ties to the first by name).  The histogram of common words counts in documents of at
    least ``least_words`` words, that of characters in those of at least ``least_chars`` characters; without a reference
    no distance counts.  Distances that don't count are null, and so is language if none does.

    One row per input row, repeated rows and null ids included.  A null text is empty, and an empty text fails by its
    length.  Rows with a null language help no reference but are judged alike.  Windows and words are told apart by
    64-bit hashes.  Other columns are not looked at; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = common_words(docs, common).select("lang", F.xxhash64("word").alias("h"), "share").orderBy("lang", F.desc("share"), "h").collect()  # ``common`` rows for each language
    languages = sorted({r.lang for r in known})
    words = [(name, [(r.h, r.share) for r in known if r.lang == name]) for name in languages]
    measured = keep(with_word_distances(with_measures(docs), words), "measured")
    sums = [F.sum(F.col("classes")[i]).alias(name) for i, name in enumerate(CLASSES)]
    totals = {r.lang: r[1:] for r in measured.where("lang is not null").groupBy("lang").agg(*sums).collect()}  # one row per language
    references = [[n / sum(totals[name]) for n in totals[name]] for name in languages]
    n_chars = sum((F.col("classes")[i] for i in range(1, len(CLASSES))), F.col("classes")[0])
    by_words, by_chars = F.col("n_words") >= least_words, n_chars >= least_chars
    df = measured.withColumn("near", class_distances(F.col("classes"), references))
    both = [F.struct((F.when(by_words, F.col("far")[i]).otherwise(0.0) + F.when(by_chars, F.col("near")[i]).otherwise(0.0)).alias("d"), F.lit(i).alias("i")) for i in range(len(languages))]
    best = F.least(*both)["i"] if len(both) > 1 else F.lit(0 if both else None).cast("int")
    df = df.withColumn("best", F.when(by_words | by_chars, best))
    df = df.withColumn("word_distance", F.when(by_words, F.get("far", F.col("best")))).withColumn("class_distance", F.when(by_chars, F.get("near", F.col("best"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    within = lambda c, limit, n: F.coalesce(F.col(c) <= limit[0] + limit[1] / F.sqrt(n), F.lit(True))
    fits = within("word_distance", words_apart, F.col("n_words")) & within("class_distance", classes_apart, n_chars)
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fits).alias("kept"),
                     F.get(names, F.col("best")).alias("language"), "word_distance", "class_distance")
