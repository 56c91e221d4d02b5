"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are reduced to letters and digits without their case, of
every script, so that case, spacing, dashes and quotes of any form don't hide a
passage. For an item of length ``L`` with at most ``e = error * L`` edits the
q-gram lemma says that an occurrence keeps at least ``L + 1 - q - q * e`` of the
item's q-grams, on diagonals (text position less item position) within ``e`` of
each other. Hits are therefore counted in overlapping diagonal bands of width
``2 * e + 1``, each starting ``e`` after the last, so that any run of diagonals
of width ``e + 1`` lies whole in one band; bands that reach the bound are
verified by banded alignment of the whole item against the text region.

Texts are scanned in Arrow batches: eight bytes are one 64-bit q-gram, a bitmap
drops those that no item has, and only the rest is looked up. The item index is
broadcast in blocks of at most ``block_chars`` and made once a worker; a larger
benchmark takes several passes, each saved before the next block is sent, instead of
a larger broadcast.

Defined cases: null and empty texts or items, and items without a letter or digit,
give no row; the edits that an item may have follow from its length alone, by one
rule: as many as ``error`` says and the lemma can prove, which is none below two
q-grams; such a short item is searched exactly and between word ends of the text, so
that an answer like a name isn't found inside of words; an item is found whole or not
at all;
the best region (least edits, then first) is reported for each document and item;
repeated rows are reported each; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .common import Workspace

Q = 8
SCHEMA = "doc_id long, item_id long, start long, end long, edits int, n_shared int"


@dataclass(frozen=True)
class Plan:
    error: float = 0.08
    block_chars: int = 8_000_000

    def budget(self, length: int) -> int:
        """Edits that an item of this length may have: with more, the lemma wouldn't promise a single shared q-gram."""
        return max(0, min(int(self.error * length), (length - Q) // Q))


def reduced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of letters and digits without their case, each row's offsets among them, and their old positions."""
    chars, at = A.folded(data)
    return chars, np.searchsorted(at, offsets), at


def letters(text: str) -> np.ndarray:
    """The reduced bytes of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return reduced(raw, np.array([0, len(raw)]))[0]


def grams(data: np.ndarray) -> np.ndarray:
    """The 64-bit q-gram at each position that has one."""
    if len(data) < Q:
        return np.zeros(0, A.U)
    return np.ndarray((len(data) - Q + 1,), np.uint64, np.ascontiguousarray(data), 0, (1,))


class Index:
    """The q-grams of the items: a bitmap for the first look, then their places. Shorter items stand in ``tiny``, by length."""

    def __init__(self, items: list[tuple[int, str]], plan: Plan):
        self.ids, self.text, self.edits, self.tiny = [], [], [], {}
        keys, item, place = [], [], []
        for item_id, text in items:
            chars = letters(text)
            if not len(chars):
                continue
            if len(chars) < Q:
                self.tiny.setdefault(len(chars), []).append((int.from_bytes(chars.tobytes(), "little"), len(self.ids)))
            else:
                g = np.array(grams(chars))
                keys.append(g)
                item.append(np.full(len(g), len(self.ids), np.int32))
                place.append(np.arange(len(g), dtype=np.int32))
            self.ids.append(item_id)
            self.text.append(chars)
            self.edits.append(plan.budget(len(chars)))
        empty = [np.zeros(0, np.int32)]
        keys, item, place = np.concatenate(keys or [np.zeros(0, A.U)]), np.concatenate(item or empty), np.concatenate(place or empty)
        order = np.argsort(keys, kind="stable")
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.item, self.place = item[order], place[order]
        self.shift = A.U(64 - max(20, min(26, len(keys).bit_length() + 4)))
        self.bitmap = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.bitmap[self._slot(self.keys)] = True
        self.edit = np.array(self.edits, np.int64)
        self.length = np.array([len(x) for x in self.text], np.int64)
        self.bound = self.length + 1 - Q - Q * self.edit
        self.between = self.length < 2 * Q
        self.tiny = {n: tuple(np.array(x) for x in zip(*sorted(own), strict=True)) for n, own in self.tiny.items()}

    def whole(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text position and item number of all occurrences of the tiny items."""
        wide = grams(np.concatenate([chars, np.zeros(Q, np.uint8)]))[: len(chars)]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n, (keys, item) in self.tiny.items():
            g = wide & A.U((1 << 8 * n) - 1)
            lo, hi = np.searchsorted(keys.astype(A.U), g), np.searchsorted(keys.astype(A.U), g, "right")
            at = np.flatnonzero(hi > lo)
            for k in range(int((hi - lo).max(initial=0))):  # as often as one tiny text stands in the benchmark
                more = at[lo[at] + k < hi[at]]
                found.append((more, item[lo[more] + k]))
        at, item = (np.concatenate(x) for x in zip(*found, strict=True))
        return at, item

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * A.U(0x9E3779B97F4A7C15)) >> self.shift

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item number and item position of all shared q-grams."""
        at = np.flatnonzero(self.bitmap[self._slot(g)])
        k = np.searchsorted(self.keys, g[at])
        k[k == len(self.keys)] = 0
        same = self.keys[k] == g[at]
        at, k = at[same], k[same]
        n = self.first[k + 1] - self.first[k]
        each = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[each], self.place[each]


def aligned(item: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """Least edits of the whole ``item`` against a part of ``region``, with that part's bounds; None above ``budget``.

    The region is about as long as the item plus a band on either side, so each
    row of the table is the band: one numpy pass a row, gaps along the row by a
    running minimum.
    """
    n = len(region)
    exact = region.tobytes().find(item.tobytes())
    if exact >= 0:
        return 0, exact, exact + len(item)
    steps = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), steps.copy()
    scale = n + 2
    for c in item:
        # cost and begin as one number, so that the least cost carries its begin
        packed = cost * scale + begin
        best = packed + scale
        best[1:] = np.minimum(best[1:], packed[:-1] + scale * (region != c))
        run = np.minimum.accumulate(best - steps * scale) + steps * scale
        cost, begin = run // scale, run % scale
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(begin[end]), end) if cost[end] <= budget else None


class Held:
    """A block of the benchmark; its index is made once in each worker."""

    def __init__(self, items: list[tuple[int, str]], plan: Plan):
        self.items, self.plan, self.made = items, plan, None

    def __reduce__(self):
        return Held, (self.items, self.plan)

    def index(self) -> Index:
        if self.made is None:
            self.made = Index(self.items, self.plan)
        return self.made


def search(column: pa.Array, index: Index):
    """``row, item number, first byte, last byte (exclusive), edits, shared`` of each occurrence."""
    data, off = A.buffers(column)
    if not index.ids:
        return
    for i, j in A.slices(off):
        chars, o, at = reduced(data[off[i] : off[j]], off[i : j + 1] - off[i])
        found: dict[tuple[int, int], tuple] = {}

        def word_ends(a: int, b: int, d: int) -> bool:
            return (a == o[d] or at[a - 1] + 1 < at[a]) and (b == o[d + 1] or at[b - 1] + 1 < at[b])

        for d, it, low, high, n in _regions(chars, o, index):
            best = found.get((d, it))
            if best and best[0] == 0 and best[1] <= low:
                continue
            if index.between[it]:
                size = int(index.length[it])
                text, p = chars[low:high].tobytes(), -1
                while (p := text.find(index.text[it].tobytes(), p + 1)) >= 0:
                    if word_ends(low + p, low + p + size, d):
                        if best is None or low + p < best[1]:
                            found[d, it] = (0, low + p, low + p + size, n)
                        break
                continue
            hit = aligned(index.text[it], chars[low:high], int(index.edit[it]))
            if hit and (best is None or (hit[0], low + hit[1]) < (best[0], best[1])):
                found[d, it] = (hit[0], low + hit[1], low + hit[2], n)
        for (d, it), (edits, a, b, n) in sorted(found.items()):
            yield i + d, it, int(at[a] - (off[i + d] - off[i])), int(at[b - 1] - (off[i + d] - off[i])) + 1, edits, n


def _regions(chars: np.ndarray, o: np.ndarray, index: Index):
    """``row, item number, low, high, shared`` of each band that reaches an item's bound, most shared q-grams first."""
    at, item = index.whole(chars) if index.tiny else (np.zeros(0, np.int64),) * 2
    doc = np.searchsorted(o, at, "right") - 1
    for d, it, p in sorted(zip(doc.tolist(), item.tolist(), at.tolist(), strict=True)):
        if p + index.length[it] <= o[d + 1]:
            yield d, it, p, p + int(index.length[it]), 1
    g = grams(chars)
    if not len(g) or not len(index.keys):
        return
    pos, item, place = index.hits(g)
    doc = np.searchsorted(o, pos, "right") - 1
    inside = pos + Q <= o[doc + 1]
    pos, item, place, doc = pos[inside], item[inside].astype(np.int64), place[inside].astype(np.int64), doc[inside]
    if not len(pos):
        return
    longest = int(index.length.max())
    band = (pos - place - o[doc] + longest) // np.maximum(index.edit[item], 1)  # from 0 up
    # each hit counts in its band and in the one before, which it overlaps
    doc, item, place = (np.concatenate([x, x]) for x in (doc, item, place))
    band = np.concatenate([band, np.maximum(band - 1, 0)])
    # bands with too few hits, repeats included, go before the exact count
    key = A.mix(A.mix((doc * len(index.ids) + item).astype(A.U)) + band.astype(A.U))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key)))
    use = order[np.repeat(n >= index.bound[item[order[first]]], n)]
    doc, item, band, place = doc[use], item[use], band[use], place[use]
    if not len(doc):
        return
    order = np.lexsort((place, band, item, doc))
    rows = np.stack([doc[order], item[order], band[order], place[order]])
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    rows = rows[:, new]  # a text may repeat a q-gram; the lemma counts each of the item's once
    first = np.flatnonzero(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(0)]))
    n = np.diff(np.append(first, rows.shape[1]))
    full = n >= index.bound[rows[1, first]]
    doc, item, band, n = *rows[:3, first[full]], n[full]
    for k in np.lexsort((band, -n, item, doc)).tolist():
        d, it = int(doc[k]), int(item[k])
        w, length, e = max(int(index.edit[it]), 1), int(index.length[it]), int(index.edit[it])
        low = int(o[d]) + int(band[k]) * w - longest
        yield d, it, max(int(o[d]), low - e), min(int(o[d + 1]), low + 2 * w + length + e), int(n[k])


def _blocks(benchmark: DataFrame, plan: Plan):
    """The number of blocks, and broadcasts of whole items, together all of the benchmark, each of ``block_chars`` bytes or about that.

    A block is sent when the one before isn't needed any more.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "text is not null and item_id is not null"
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // plan.block_chars))

    def sent():
        for block in range(n):
            own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block)
            listed = sorted((r["item_id"], r["text"]) for r in own.toLocalIterator())
            yield spark.sparkContext.broadcast(Held(listed, plan))

    return n, sent()


def occurrences(docs: DataFrame, benchmark: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, item_id, start, end, edits, n_shared`` (code points of the text) of ``docs(doc_id, text)``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(shared):
        def found(batches):
            index = shared.value.index()
            for b in batches:
                out = []
                for row, it, a, z, edits, n in search(b.column(1), index):
                    raw = b.column(1)[row].as_py().encode()
                    start = len(raw[:a].decode())
                    out.append((b.column(0)[row].as_py(), index.ids[it], start, start + len(raw[a:z].decode(errors="ignore")), edits, n))
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                cols = zip(*out, strict=True) if out else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "edits", "n_shared"]
                )

        return found

    n, blocks = _blocks(benchmark, plan)
    if n == 1:
        return texts.mapInArrow(scan(next(blocks)), SCHEMA)
    work, tables = Workspace(docs.sparkSession), []
    for x in blocks:
        tables.append(work.save(texts.mapInArrow(scan(x), SCHEMA)))
        x.destroy()
    return reduce(DataFrame.unionByName, tables)


def clean(docs: DataFrame, benchmark: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns; the rows are filtered where they are scanned."""
    at, names = docs.columns.index("text"), docs.columns
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])

    def scan(shared):
        def kept(batches):
            index = shared.value.index()
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in search(b.column(at), index)]] = False
                yield pa.RecordBatch.from_arrays(b.filter(pa.array(keep)).columns, plain.names)

        return kept

    n, blocks = _blocks(benchmark, plan)
    if n == 1:
        return docs.mapInArrow(scan(next(blocks)), plain).toDF(*names)
    work, left = Workspace(docs.sparkSession), None
    for x in blocks:
        fewer = work.save((docs if left is None else left).mapInArrow(scan(x), plain))
        x.destroy()
        if left is not None:
            work.drop(left)
        left = fewer
    return left.toDF(*names)
