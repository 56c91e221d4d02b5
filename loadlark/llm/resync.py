"""Token counts of texts of any length, huge ones in overlapping chunks.

A text up to a chunk and its overlap long is encoded whole. A longer one is cut every
``chunk`` code points; each piece runs on past its end by an overlap, and the pieces
of a text are dealt to different tasks. A piece is encoded with offsets. In each
overlap two pieces hold the same characters, and their tokens are spliced at the
first position that both prove stable:

* a pre-token (a word, a run of signs) starts there in both encodings. The scanner
  that makes pre-tokens runs from left to right and remembers nothing but its place,
  so from a common start on both go on alike, whatever the later piece's cut did to
  its first tokens; merges stay inside of a pre-token.
* no normal form joins what is before with what is after: the character there is a
  starter and never the second one of a composition.
* it lies ``margin`` characters before the earlier piece's end, more than a special
  token or a contraction is long, so that what is before is not touched by that end.

Where an overlap has no such position, as inside a word of a million letters, it is
widened fourfold for that pair of pieces alone, which are encoded again; once it would
reach over the whole next piece the two become one. A text's count is the sum over its
splices of the tokens before them in the earlier piece less those in the later one,
and all tokens of the last piece.

Defined cases: a null or empty text has no tokens and no bytes; a special token's
string inside a text counts as the library has it, as one token; repeated rows and
null ids are counted like any others; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import Workspace


@dataclass(frozen=True)
class Plan:
    """Code points of a chunk and of the first overlap; ``margin`` must be longer than any special token."""

    chunk: int = 1 << 14
    overlap: int = 1 << 9
    margin: int = 64


@cache
def tokenizer(path: str):
    """The library's tokenizer, once for each Python worker, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@cache
def _composing() -> frozenset[str]:
    """Characters that some composition has in a place after its first: what stands before can change with them."""
    later = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of Hangul
    for c in map(chr, range(0x30000)):
        form = unicodedata.decomposition(c)
        if form and form[0] != "<":
            later.update(unicodedata.normalize("NFD", c)[1:])
    return frozenset(later)


def starts_anew(c: str) -> bool:
    """No normal form joins ``c``, or reorders it, with what stands before."""
    if c < "\x80":
        return True
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(c) and not unicodedata.combining(first) and first not in _composing() and c not in _composing()


def stable(text: str, encoding) -> Iterator[tuple[int, int]]:
    """Positions where a pre-token starts and normal forms are apart, each with the number of tokens before it."""
    before, end = None, 0
    for i, (word, (at, until)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        # a letter whose lower case is two characters can end one pre-token and start the next: no position is between
        if word != before and at >= end and starts_anew(text[at]):
            yield at, i
        before, end = word, until


_MARKS = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
_PIECE = pa.schema(
    [("row", pa.int64()), ("start", pa.int64()), ("next", pa.int64()), ("overlap", pa.int64()), ("before", pa.int64()), ("length", pa.int64())]
)
_PIECE_SQL = "row long, start long, next long, overlap long, before long, length long"
_MARKS_SQL = "array<struct<at:long,n:long>>"


def whole(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of texts that are one piece each; a worker looks up words that it has met (see :mod:`.tokens`)."""

    def counted(batches):
        for b in batches:
            n = [len(raw) // 4 for raw in tokens.encoded(b.column(2), path)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


def encode(texts: DataFrame, pieces: DataFrame, path: str, plan: Plan) -> DataFrame:
    """``pieces`` with ``total``, its tokens, and the stable positions in the overlaps at both ends.

    ``pieces(row, start, next, overlap, before, length)``: a piece is read from ``start`` to
    ``next`` and on by ``overlap``; ``before`` is the overlap with the piece before it.
    """

    def cut(batches):
        schema = _PIECE.append(pa.field("text", pa.string()))
        for b in batches:
            for text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i in range(0, len(own), 64):
                    yield pa.RecordBatch.from_pylist([p | {"text": text[p["start"] : p["next"] + p["overlap"]]} for p in own[i : i + 64]], schema)

    def encoded(batches):
        schema = _PIECE.append(pa.field("total", pa.int64())).append(pa.field("left", _MARKS)).append(pa.field("right", _MARKS))
        for b in batches:
            out = []
            for p in b.to_pylist():
                text, start = p.pop("text"), p["start"]
                e = tokenizer(path).encode(text, add_special_tokens=False)
                marks = [(start + at, n) for at, n in stable(text, e)]
                end = start + len(text)
                p["left"] = [{"at": at, "n": n} for at, n in marks if at < start + p["before"]]
                p["right"] = [{"at": at, "n": n} for at, n in marks if p["next"] <= at <= end - plan.margin]
                out.append(p | {"total": len(e)})
            yield pa.RecordBatch.from_pylist(out, schema)

    lists = pieces.groupBy("row").agg(F.collect_list(F.struct(*_PIECE.names)).alias("pieces"))  # a text's pieces: a small part of its own size
    return (
        texts.join(lists, "row").select("text", "pieces").mapInArrow(cut, _PIECE_SQL + ", text string")
        .repartition("row", "start")
        .mapInArrow(encoded, f"{_PIECE_SQL}, total long, left {_MARKS_SQL}, right {_MARKS_SQL}")
    )


def spliced(encoded: DataFrame) -> DataFrame:
    """Pieces with ``n``, the tokens that they add: up to their splice, less those of the next piece before it; null if there is no splice."""
    later = Window.partitionBy("row").orderBy("start")  # one text's pieces, no more than a text can have
    common = F.array_intersect("right.at", F.lead("left.at").over(later))
    tokens_before = lambda marks: F.get(F.filter(marks, lambda m: m["at"] == F.col("_at")), F.lit(0))["n"]
    return (
        encoded.withColumn("_left", F.lead("left").over(later))
        .withColumn("_at", F.array_min(common))
        .withColumn("n", F.when(F.col("next") == F.col("length"), F.col("total")).otherwise(tokens_before(F.col("right")) - tokens_before(F.col("_left"))))
        .drop("_left", "_at")
    )


def widened(found: DataFrame) -> DataFrame:
    """The pieces of the next round: ``changed`` tells which of them must be encoded."""
    order = Window.partitionBy("row").orderBy("start")
    wider = F.col("overlap") * 4
    asked = found.select(
        *_PIECE.names, F.col("n").isNull().alias("_failed"), F.lead("next").over(order).alias("_then"),
    ).select(
        "*",
        F.when(F.col("_failed"), wider).otherwise(F.col("overlap")).alias("_wider"),
        (F.col("_failed") & (F.col("next") + wider >= F.col("_then"))).alias("_joined"),
    )
    return (
        asked.withColumn("_before", F.coalesce(F.lag("_wider").over(order), F.lit(0)))
        .withColumn("_after_failed", F.coalesce(F.lag("_failed").over(order), F.lit(False)))
        .withColumn("_group", F.sum(F.when(F.lag("_joined").over(order), 0).otherwise(1)).over(order))
        .groupBy("row", "_group")
        .agg(
            F.min("start").alias("start"), F.max("next").alias("next"), F.max_by("_wider", "start").alias("overlap"),
            F.min_by("_before", "start").alias("before"), F.max("length").alias("length"), F.bool_or(F.col("_failed") | F.col("_after_failed")).alias("changed"),
        )
        .drop("_group")
    )


def counts(docs: DataFrame, path: str, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of ``docs(doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    most = plan.chunk + plan.overlap
    fits = (F.col("n_bytes") <= most) | (F.length("text") <= most)
    short = whole(sized.filter(fits), path)
    work = Workspace(docs.sparkSession)
    huge = work.save(sized.filter(~fits).select(F.monotonically_increasing_id().alias("row"), "*"))
    length = F.length("text").cast("long")
    chunk = F.lit(plan.chunk).cast("long")
    pieces = huge.select("row", length.alias("length")).select(
        "row", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - plan.overlap - 1, chunk)).alias("start")
    ).select(
        "row", "start",
        F.when(F.col("start") + plan.chunk + plan.overlap < F.col("length"), F.col("start") + plan.chunk).otherwise(F.col("length")).alias("next"),
        F.when(F.col("start") + plan.chunk + plan.overlap < F.col("length"), plan.overlap).otherwise(0).cast("long").alias("overlap"),
        F.when(F.col("start") > 0, plan.overlap).otherwise(0).cast("long").alias("before"), "length",
    )
    texts = huge.select("row", "text")
    state = work.save(encode(texts, pieces, path, plan))
    while True:
        found = work.save(spliced(state).drop("total", "left", "right"))
        if found.filter("n is null").isEmpty():
            break
        asked = work.save(widened(found))
        again = encode(texts, asked.filter("changed").drop("changed"), path, plan)
        newer = work.save(again.unionByName(state.join(asked.filter("not changed").select("row", "start"), ["row", "start"])))
        work.drop(state, asked, found)
        state = newer
    sums = found.groupBy("row").agg(F.sum("n").alias("n_tokens"))
    return short.unionByName(huge.select("row", "doc_id", "n_bytes").join(sums, "row").select("doc_id", "n_bytes", "n_tokens"))
