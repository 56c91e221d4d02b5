"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all training texts is the
unlabelled set. With class prior ``p`` the risk of a scorer ``g`` is
``p * R_P(+) + max(0, R_U(-) - p * R_P(-))``: when the bracket turns negative
the step goes back up its gradient, which keeps a flexible model from pushing
the unlabelled risk below zero. The model is a sparse linear one over the
hashed distinct words of a text, fitted with numpy on the driver from a bounded
sample and applied to every whole text in Arrow batches.

Defined cases: a null text counts as empty; an empty text has no features and
gets the score of the bias; repeated rows are scored alike; null labels are
unlabelled; without any confirmed toxic row every score is the prior's. Extra
columns of any name pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .common import durable

BITS = 18


@dataclass(frozen=True)
class Fit:
    """Sizes and rates of the training; the sample bounds hold at any input size."""

    max_positive: int = 6_000
    max_unlabelled: int = 12_000
    max_words: int = 4_000_000
    steps: int = 120
    rate: float = 0.15
    #: The l1 penalty is ``l1_of_one`` by the number of positives, and ``l1`` at least: few positives can be told apart by chance words.
    #: Both were chosen by four-fold cross-validation on training ids, at 31 and at 262 positives.
    l1: float = 2e-4
    l1_of_one: float = 0.1
    least_texts: int = 5

    def penalty(self, n_positive: int) -> float:
        return max(self.l1, self.l1_of_one / n_positive)


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct hashed words of each row: lower case, letters and digits only."""
    data, off = A.buffers(column)
    for i, j in A.slices(off):
        part, o = A.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        s, e, first = A.word_bounds(part, o, A.ALNUM)
        index = (A.word_hashes(part, s, e) >> A.U(64 - BITS)).astype(np.int32)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(index[a:b])


def train(texts: list[np.ndarray], positive: np.ndarray, prior: float, fit: Fit = Fit()) -> tuple[np.ndarray, float]:
    """Weights of the hashed words and the bias. ``positive`` marks the confirmed rows, all others are unlabelled."""
    weights, bias = np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior)))
    n_pos = int(positive.sum())
    if not n_pos or n_pos == len(texts):
        return weights, bias
    sizes = np.array([len(x) for x in texts])
    flat = np.concatenate(texts) if len(texts) else np.zeros(0, np.int32)
    seen = np.bincount(flat, minlength=1 << BITS)
    use = np.flatnonzero(seen >= fit.least_texts)
    place = np.full(1 << BITS, -1, np.int32)
    place[use] = np.arange(len(use))
    row = np.repeat(np.arange(len(texts)), sizes)
    col = place[flat]
    keep = col >= 0
    row, col = row[keep], col[keep]
    w, b = np.zeros(len(use)), bias
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.where(positive, 1 / n_pos, 1 / (len(texts) - n_pos))
    l1 = fit.penalty(n_pos)
    for step in range(1, fit.steps + 1):
        g = np.bincount(row, w[col], len(texts)) + b
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        minus = np.logaddexp(0, g)  # loss of calling it clean
        bracket = (minus * share)[~positive].sum() - prior * (minus * share)[positive].sum()
        # derivatives: of the loss as positive s - 1, of the loss as negative s
        back = np.where(positive, -prior * s, s) * share
        grad = np.where(positive, prior * (s - 1) * share, 0) + back if bracket >= 0 else -back
        gw, gb = np.bincount(col, grad[row], len(w)), grad.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        scale = fit.rate / (np.sqrt(v / c2) + 1e-4)
        w = w - scale * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)  # the l1 term's proximal step
        b -= fit.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-4)
    weights[use] = w
    return weights, float(b)


def scores(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of each row of the column."""
    out, at = np.empty(len(column)), 0
    data, off = A.buffers(column)
    for i, j in A.slices(off):
        part, o = A.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        s, e, first = A.word_bounds(part, o, A.ALNUM)
        index = (A.word_hashes(part, s, e) >> A.U(64 - BITS)).astype(np.int64)
        used = np.flatnonzero(weights[index])
        doc = np.searchsorted(first, used, "right") - 1
        pair = np.unique((doc << BITS) | index[used])
        out[at : at + j - i] = np.bincount(pair >> BITS, weights[pair & ((1 << BITS) - 1)], j - i) + bias
        at += j - i
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def held_out(doc_id) -> F.Column:
    """Every fifth row by checksum; its label is never read in training."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


def kept(positive: np.ndarray, unlabelled: np.ndarray, how: Fit) -> tuple[int, int]:
    """How many positive and unlabelled texts of these word counts, first ones first, fit into ``max_words``.

    Each side has its share of the words, in proportion to its bound of texts,
    and what the other leaves; a side that has texts keeps one at least.
    """
    share = how.max_words * how.max_positive // (how.max_positive + how.max_unlabelled)
    budgets = max(share, how.max_words - int(unlabelled.sum())), max(how.max_words - share, how.max_words - int(positive.sum()))
    one = lambda n, most: min(len(n), max(1, int(np.searchsorted(np.cumsum(n), most, "right"))))
    return one(positive, budgets[0]), one(unlabelled, budgets[1])


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> tuple[np.ndarray, float]:
    """A model from ``labels(doc_id, toxic)`` and the texts of ``docs(doc_id, text)``.

    At most ``max_positive`` positives and ``max_unlabelled`` texts are taken,
    by a hash of their ids, one row of an id; only their ids are broadcast, at
    most 18,000. Where they have more than ``max_words`` words, each side keeps
    the first of its texts (:func:`kept`), and only these come to the driver.
    """
    allowed = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = allowed.filter(F.col("toxic").isNotNull()).agg(
        F.avg(F.col("toxic").cast("double")).alias("p"), F.count("*").alias("n")
    ).first()
    prior = min(max(known["p"] if known["n"] else 0.05, 0.001), 0.5)
    by_hash = F.xxhash64("doc_id")
    pos = allowed.filter("toxic = 1").select("doc_id").distinct().orderBy(by_hash, "doc_id").limit(how.max_positive)
    unl = (
        docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
        .orderBy(by_hash, "doc_id").limit(how.max_unlabelled)
    )
    ids = pos.withColumn("_pos", F.lit(True)).unionByName(unl.withColumn("_pos", F.lit(False)))
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(by_hash.alias("_order"), "_pos", F.xxhash64("text").alias("_of"), "text")

    def hashed(batches):
        for b in batches:
            words = pa.array(list(features(b.column(3))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), words], ["place", "pos", "of", "words"])

    each = sample.mapInArrow(hashed, "place long, pos boolean, of long, words array<int>")
    one = durable(each.groupBy("pos", "place").agg(F.min(F.struct("of", "words"))["words"].alias("words")))
    sizes = one.select("pos", "place", F.size("words").alias("n")).toArrow().sort_by("place")
    is_pos, place, n = (sizes.column(c).to_numpy() for c in ("pos", "place", "n"))
    is_pos = is_pos.astype(bool)
    fits = F.lit(False)
    for side, count in zip((True, False), kept(n[is_pos], n[~is_pos], how), strict=True):
        if count:
            fits |= (F.col("pos") == side) & (F.col("place") <= int(place[is_pos == side][count - 1]))
    rows = one.filter(fits).toArrow().sort_by([("pos", "descending"), ("place", "ascending")])
    words = [np.asarray(x, np.int32) for x in rows.column("words").to_numpy()]
    return train(words, rows.column("pos").to_numpy().astype(bool), prior, how)


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with a score of its ``text`` column in the column ``name``; all other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB at any input size
    at = docs.columns.index("text")

    def scored(batches):
        weights, bias = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(scores(b.column(at), weights, bias))], [*map(str, range(b.num_columns + 1))]
            )

    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), T.StructField("s", T.DoubleType())])
    return docs.mapInArrow(scored, schema).toDF(*docs.columns, name)
