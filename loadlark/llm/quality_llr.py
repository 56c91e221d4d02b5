"""Quality rules: fixed counts, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets. Two multinomials over the buckets,
one of trusted texts and one of the whole corpus, give each bucket a log ratio; a
text's score is the mean over its n-grams, so that its length doesn't count.
Every document is thresholded at one fixed value: the score that all but a small
share of the trusted texts reach. Corpus counts cover all rows, and trusted ones
all texts that are labelled so. All of it is DataFrame expressions: a text's words
stay in one row, the ratio table is a constant of the plan whose size depends on
the number of buckets alone.

Defined cases: null and empty texts have no words and fail the base rules;
repeated rows are judged alike; without trusted rows all ratios are 0 and the
base rules alone decide; other columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

#: Bits of the table that is asked before ids are looked up: 2 MB.
ID_BITS = 1 << 24
SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Fit:
    buckets: int = 1 << 13
    #: Share of trusted texts that may fall below the cut.
    rejected: float = 0.005
    #: How far below that quantile the cut lies.
    slack: float = 0.03
    smoothing: float = 1.0


@dataclass(frozen=True)
class Model:
    ratio: tuple[float, ...]
    cut: float

    def table(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.3f}" for x in self.ratio)), ",").cast("array<double>")


def words(text: Column) -> Column:
    none = F.expr("cast(array() as array<string>)")
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
        lambda t: F.when(t == "", none).otherwise(F.split(t, f"{SPACE}+")),
    )


def grams(w: Column, buckets: int) -> Column:
    """Bucket of each word, then of each pair of neighbours."""
    n = F.lit(buckets)
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), n).cast("int"))
    two = F.transform(
        F.arrays_zip(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))).alias("b")),
        lambda x: (F.pmod(F.xxhash64(x["a"], x["b"]), n) + n).cast("int"),
    )
    return F.concat(one, two)


def repeated_words(w: Column) -> Column:
    """Words in windows of three that the text has twice or more."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = lambda k: ((k > 0) & (s[k - 1]["h"] == s[k]["h"])) | ((k < F.size(s) - 1) & (s[k + 1]["h"] == s[k]["h"]))
            return F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twice), lambda k: s[k]["i"])

        return let(
            let(ordered, starts),
            lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))),
        )

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(
        let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))
    )


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \t-\r]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def ratio_of(g: Column, table: Column) -> Column:
    """Mean log ratio of an array of buckets; null without any."""
    return let(
        g, lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda a, x: a + table[x]) / F.size(b))
    )


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``ids``, of the same type.

    ``ids`` are looked up by a shuffle, whose size follows the texts. So that only
    texts with a chance are shuffled, a table of ``ID_BITS`` bits, one set by the
    hash of each id, goes before it; it is broadcast and doesn't grow with the ids.
    """
    word, bit = F.expr(f"pmod(xxhash64(doc_id), {ID_BITS}L) div 64"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64L) as int))")
    held = ids.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    likely = docs.join(F.broadcast(held), (word == F.col("_word")) & (bit.bitwiseAND(F.col("_bits")) != 0), "left_semi")
    return likely.join(ids.distinct().hint("shuffle_hash"), "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model:
    """Counts every text of ``docs``; trusted are all those with ``quality = 1``.

    A fifth of the trusted texts isn't counted as such and sets the cut, so that
    it holds for texts that the counts haven't seen. Each part is looked up where
    it is needed, and no text is saved; the fifth's scores are counted in steps of
    0.0001, so that the quantile comes from a table that doesn't grow with them.
    """
    texts = docs.select("doc_id", "text")
    same = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")  # hashes depend on the type
    trusted = labels.filter("quality = 1 and doc_id is not null").select(same)
    fifth = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    counted, apart = (among(texts.filter(part), trusted.filter(part)) for part in (~fifth, fifth))

    def counts(texts: DataFrame) -> list[int]:
        found = texts.select(F.explode(let(words(F.col("text")), lambda w: grams(w, how.buckets))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
        held = [0] * (2 * how.buckets)
        for r in found.collect():  # 2 * buckets rows at most
            held[r["g"]] = r["n"]
        return held

    n, t = counts(docs), counts(counted)
    ratio: list[float] = []
    for part in (slice(0, how.buckets), slice(how.buckets, None)):
        total_n, total_t = sum(n[part]), sum(t[part])
        for a, b in zip(n[part], t[part], strict=True):
            raw = (a + how.smoothing) / (total_n + how.smoothing * how.buckets)
            good = (b + how.smoothing) / (total_t + how.smoothing * how.buckets)
            ratio.append(math.log(good / raw) if total_t else 0.0)
    model = Model(tuple(ratio), -math.inf)
    scores = apart.select(
        let(words(F.col("text")), lambda w: F.when(F.size(w) >= 50, ratio_of(grams(w, how.buckets), model.table()))).alias("s")
    )
    steps = scores.filter("s is not null").groupBy(F.round("s", 4).alias("s")).agg(F.count("*").alias("n"))
    cut = steps.agg(F.percentile("s", how.rejected, F.col("n")).alias("q")).first()["q"]
    return Model(tuple(ratio), round(cut - how.slack, 6) if cut is not None else -math.inf)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``."""
    buckets, table = len(model.ratio) // 2, model.table()
    t = F.coalesce("text", F.lit(""))
    facts = docs.select(
        "doc_id",
        let(
            words(F.col("text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                F.coalesce(ratio_of(grams(w, buckets), table), F.lit(0.0)).alias("score"),
            ),
        ).alias("f"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        repeated_lines(t).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return facts.select(
        "doc_id", "f.n_words", "f.word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words", "f.score"
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") >= model.cut)).alias("kept"), "score",
    )
