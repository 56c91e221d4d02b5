"""Packing token sequences: dominance reduction, then best fit.

A document's pieces are its tokens with the end id, cut only if it is longer
than a sequence (the first piece takes what full pieces leave over). A bin
packing instance of any size has at most ``capacity`` different lengths, so its
histogram is all that a plan needs. On the histogram, longest pieces first,
Martello and Toth's criterion fixes sets that dominate every alternative: a
piece that nothing fits beside, a pair that fills a sequence, the best partner
where only one more piece fits, or where no two smaller ones together exceed
it. What can't be fixed goes by best fit decreasing.

The plan says, for each length, which numbers (a gapless rank of the pieces of
that length) go to which sequences and offsets. Its size depends on the
capacity alone, so it is broadcast; pieces find their row by length and rank.

Defined cases: a null or empty text is one piece, the end id; repeated rows and
null ids are packed like any others; an empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import durable, numbered

CAPACITY = 1024


def pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of ``docs(doc_id, text)``."""

    def cut(batches):
        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(tokens.encoded(b.column(1), path)):
                raw += tail
                n = len(raw) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * z]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _dominant(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixed sets and how often each; takes them out of ``left``, a histogram of lengths."""
    fixed = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for x in lengths:
            left[x] -= times
            if not left[x]:
                del left[x]

    for a in sorted(left, reverse=True):
        while left.get(a):
            room = capacity - a
            rest = sorted(left)
            if left[a] == 1:
                rest.remove(a)
            fits = [x for x in rest if x <= room]
            if not fits:
                fix((a,), left[a] if 2 * a > capacity else 1)
                continue
            b = fits[-1]
            times = min(left[a], left[b]) if b != a else left[a] // 2
            low = []
            for x in rest:  # the smallest three pieces beside one of length a
                low += [x] * min(3, left[x] - (x == a))
                if len(low) >= 3:
                    break
            if b == room or sum(low[:2]) > room or len(low) < 2:
                # filled, or nothing else fits beside a: checked again before another length of b is taken
                fix((a, b), times)
                continue
            if len(low) < 3 or sum(low[:3]) > room:  # two pieces at most: does one alone beat any two?
                best_two, hi = 0, len(fits) - 1
                for lo, x in enumerate(fits):
                    while hi >= lo and x + fits[hi] > room:
                        hi -= 1
                    if hi < lo:
                        break
                    y = fits[hi]
                    if hi == lo and left[x] - (x == a) < 2:
                        continue
                    best_two = max(best_two, x + y)
                if b >= best_two:
                    fix((a, b), 1)
                    continue
            break
    return fixed


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing; equal pieces and equal sequences are handled by number."""
    open_: dict[int, Counter] = {}

    def put(lengths: tuple[int, ...], times: int) -> None:
        if times:
            open_.setdefault(capacity - sum(lengths), Counter())[lengths] += times

    for a in sorted(left, reverse=True):
        n = left[a]
        while n:
            room = min((r for r in open_ if r >= a), default=None)
            if room is None:
                k = capacity // a
                put((a,) * k, n // k)
                put((a,) * (n % k), 1 if n % k else 0)
                break
            lengths, times = min(open_[room].items())
            k = room // a
            full = min(times, n // k)
            part = n if not full else 0  # fewer than k are left: they share one sequence
            used = full or 1
            open_[room][lengths] -= used
            if not open_[room][lengths]:
                del open_[room][lengths]
                if not open_[room]:
                    del open_[room]
            put(lengths + (a,) * (k if full else part), used)
            n -= full * k if full else part
    return [(lengths, times) for kinds in open_.values() for lengths, times in kinds.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``length, first rank, last rank (exclusive), first sequence, offset`` for every piece of the histogram."""
    left = {k: n for k, n in histogram.items() if n}
    sets = _dominant(left, capacity) + _best_fit(left, capacity)
    rows, used, sequence = [], Counter(), 0
    for lengths, times in sorted(_merged(sets).items(), reverse=True):
        offset = 0
        for x in lengths:
            rows.append((x, used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return rows


def _merged(sets):
    out = Counter()
    for lengths, times in sets:
        out[tuple(sorted(lengths, reverse=True))] += times
    return out


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, path, end_id, capacity))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # ``capacity`` rows at most
    rows = plan(counts, capacity)
    placed = spark.createDataFrame(
        rows or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long"
    )
    ranked = numbered(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    return (
        ranked.join(F.broadcast(placed), "length")
        .filter("rank >= low and rank < high")
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
        )
    )
