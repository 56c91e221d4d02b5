"""Near-duplicate classes by HyperMinHash.

A document is its set of distinct word shingles, each a mixed 64-bit hash. For
each of ``bands * rows`` hash functions a register keeps of the least value the
number of leading zeros (6 bits) and the next 10 bits (the mantissa). Band keys
are hashes of ``rows`` compressed registers. Pairs that share a bucket get a
collision-corrected estimate of their Jaccard index from the registers; those
far below the threshold are dropped, all others are confirmed on full sets.

No bucket is ever expanded into all its pairs:

* documents with the same set are one class before any banding, named by a hash of
  the set;
* buckets with the same members count once;
* a bucket of more than ``block`` members is split into blocks, so that no task
  holds a whole hot bucket;
* next to the registers stands a parity sketch of the set, of four to eight bits
  a shingle: each bit says whether an odd number of shingles hash to it. Two sets
  differ in at least as many shingles as their sketches in bits, whatever their
  size, which drops, without loss, all but a few pairs below 0.84 before they
  leave their piece, so that a family of like texts under the threshold gives no
  pairs to confirm;
* a first round takes from each block a spanning forest of its most similar
  pairs, confirms it and labels the components; a second round confirms those
  remaining pairs of a bucket whose ends are still in different components, each
  pair only in the first band that it shares. Links within a component can't
  change the result, so none is lost.

Components come from label propagation with pointer jumping. What later steps
read is saved as Parquet in the shared folder and dropped when it is done with;
only the result stays. With 30 bands of 6 registers a pair at 0.85 is missed with
probability (1 - 0.85**6)**30 = 7e-7.

Defined cases: texts that are null or without words have an empty set and link
with nothing; texts with fewer words than a shingle are one shingle; rows with a
null id aren't linked (``component_id`` null, kept); each row of a repeated id is
judged by its own set, and of rows with one id :func:`deduplicated` drops those
whose own class has a smaller id; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .common import Workspace, unused

MANTISSA = 10
#: Least and most bits of a set's sketch, as powers of two.
SKETCH_BITS = (11, 20)
#: Sets that are broadcast with their class, at most.
HOT = 100_000


@dataclass(frozen=True)
class Plan:
    words: int = 3
    percent: int = 85
    bands: int = 30
    rows: int = 6
    block: int = 512
    #: Standard deviations that an estimate may lie below the threshold.
    margin: float = 6.0

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least_estimate(self) -> float:
        j = self.percent / 100
        return j - self.margin * (j * (1 - j) / self.registers) ** 0.5


def shingle_sets(column: pa.Array, k: int):
    """Of slices of the column: the sorted distinct shingle hashes of its rows, one after another, and their bounds."""
    data, off = A.buffers(column)
    salt = A.mix(np.arange(1, 2 * k + 2, dtype=A.U))
    for i, j in A.slices(off):
        part, o = A.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        s, e, first = A.word_bounds(part, o, A.NOT_SPACE)
        h = A.word_hashes(part, s, e)
        n = len(h) - k + 1
        run = np.full(max(n, 0), salt[k], A.U)
        for x in range(k):
            run = A.mix(run ^ (h[x : x + len(run)] * (salt[x] | A.U(1))))
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                sets.append(np.unique(run[a : b - k + 1]))
            elif b > a:
                one = np.full(1, salt[k + b - a], A.U)
                for x in range(a, b):
                    one = A.mix(one ^ (h[x : x + 1] * (salt[x - a] | A.U(1))))
                sets.append(one)
            else:
                sets.append(np.zeros(0, A.U))
        bounds = np.cumsum([0, *map(len, sets)])
        yield np.concatenate(sets) if sets else np.zeros(0, A.U), bounds


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one, of 64-bit minima, as 16-bit registers."""
    zeros = np.zeros(least.shape, A.U)
    x = least.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        low = x < (A.U(1) << A.U(64 - shift))
        zeros[low] += A.U(shift)
        x[low] <<= A.U(shift)
    mantissa = (x << A.U(1)) >> A.U(64 - MANTISSA)
    return ((zeros << A.U(MANTISSA)) | mantissa).astype(np.uint16)


def registers(flat: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` registers for each non-empty set."""
    rng = np.random.default_rng(20240229)
    mul = rng.integers(1, 1 << 63, count, dtype=np.uint64) * A.U(2) + A.U(1)
    add = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), count), A.U)
    step = 1 << 15
    # pieces of whole sets that stay in the cache; one larger set stands alone
    i = 0
    ends = np.append(starts[1:], len(flat))
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
        part, at = flat[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        v = np.empty_like(part)
        for r in range(count):
            np.multiply(part, mul[r], out=v)
            np.add(v, add[r], out=v)
            np.minimum.reduceat(v, at, out=out[i:j, r])
        i = j
    return compress(out)


def sketches(flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The parity sketch of each set, of at least four bits for each of its shingles."""
    sizes = np.diff(bounds)
    bits = np.clip(np.ceil(np.log2(np.maximum(4 * sizes, 1))), *SKETCH_BITS).astype(np.int64)
    width = np.int64(1) << bits
    start = np.concatenate([[0], np.cumsum(width)])
    low = (flat & np.repeat(width - 1, sizes).astype(A.U)).astype(np.int64)
    odd = np.bincount(np.repeat(start[:-1], sizes) + low, minlength=int(start[-1])) & 1
    packed = np.packbits(odd.astype(bool)).tobytes()
    return [packed[a // 8 : z // 8] for a, z in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


class Sketches:
    """The sketches of a piece's members; those of different sizes are compared at the smaller one."""

    def __init__(self, raw: list[bytes]):
        self.words = np.array([len(x) // 8 for x in raw])
        self.place, self.rows = np.empty(len(raw), np.int64), {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.place[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(raw[k] for k in own), np.uint64).reshape(len(own), w)

    @staticmethod
    def _folded(rows: np.ndarray, words: int) -> np.ndarray:
        while (half := rows.shape[-1] // 2) >= words:
            rows = rows[..., :half] ^ rows[..., half:]
        return rows

    def differ(self, x: int, others: np.ndarray) -> np.ndarray:
        """A lower bound of the number of shingles that only one of two sets has."""
        out, own = np.empty(len(others), np.int64), int(self.words[x])
        mine = self.rows[own][self.place[x]]
        for w in np.unique(self.words[others]).tolist():
            of = self.words[others] == w
            theirs, least = self.rows[w][self.place[others[of]]], min(w, own)
            out[of] = np.bitwise_count(self._folded(theirs, least) ^ self._folded(mine, least)).sum(1, dtype=np.int64)
        return out


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id, of, n, k1, k2, regs, sketch``: a hash of the text, the set's size, a 128-bit key of it, its registers and its sketch."""

    def made(batches):
        for b in batches:
            n, k1, k2, regs, maps = [], [], [], [], []
            for flat, bounds in shingle_sets(b.column(2), plan.words):
                sizes = np.diff(bounds)
                one, two = A.mix(flat ^ A.U(0x5851F42D4C957F2D)), A.mix(flat + A.U(0x14057B7EF767814F))
                for keys, h in ((k1, one), (k2, two)):
                    sums = np.concatenate([np.zeros(1, A.U), np.cumsum(h)])
                    keys.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                n.append(sizes)
                packed = iter(registers(flat, bounds, plan.registers))
                regs += [next(packed).tobytes() if size else None for size in sizes.tolist()]
                maps += sketches(flat, bounds)
            cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cat(n)), pa.array(cat(k1)), pa.array(cat(k2)), pa.array(regs, pa.binary()), pa.array(maps, pa.binary())],
                ["doc_id", "of", "n", "k1", "k2", "regs", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), "text").mapInArrow(
        made, "doc_id long, of long, n long, k1 long, k2 long, regs binary, sketch binary"
    )


def corrected(equal: np.ndarray, registers: int) -> np.ndarray:
    """Jaccard index from the share of equal registers, less what different minima share by chance.

    Two independent minima agree in their leading zeros with probability 1/3 at
    most for sets of like size, and then in the mantissa with 2**-MANTISSA.
    """
    chance = 2.0**-MANTISSA / 3
    return (equal / registers - chance) / (1 - chance)


def _forest(a: np.ndarray, b: np.ndarray, est: np.ndarray) -> list[int]:
    """The pairs, best first, that join two components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    chosen = []
    for k in np.lexsort((b, a, -est)).tolist():
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            chosen.append(k)
    return chosen


def pair_blocks(members: DataFrame, plan: Plan, forest: bool) -> DataFrame:
    """Candidate pairs ``a < b`` of each piece of the buckets.

    ``members``: bucket, band, m (its size), rep, n, comp, regs, sketch. With
    ``forest`` a spanning forest of each block, in which a pair may come up in
    several buckets; else all pairs between components, each once: ``main`` is
    the bucket's largest one, with ``n_main`` members. Members of others meet all
    blocks, those of the largest only the blocks of others, so that copies of
    rows grow with the few that are still apart, not with the bucket.
    """
    pick = lambda n: F.pmod(F.xxhash64("rep", "bucket"), n).cast("int")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(plan.block)).cast("int"))
    if forest:
        # blocks of their own for each bucket: what one keeps apart another brings together
        dealt = members.withColumn("blk", pick(blocks(F.col("m")))).withColumns({"lo": F.col("blk"), "hi": F.col("blk")})
    else:
        main = F.col("comp") == F.col("main")
        rare, common = blocks(F.col("m") - F.col("n_main")), blocks(F.col("n_main"))
        dealt = (
            members.withColumns({"rare": rare, "common": common})
            .withColumn("blk", F.when(main, F.col("rare") + pick(F.col("common"))).otherwise(pick(F.col("rare"))))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, F.col("rare")).otherwise(F.col("rare") + F.col("common")) - 1)))
            .withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")})
        )
    dealt = (
        dealt.select("bucket", "band", "lo", "hi", "blk", "rep", "n", "comp", "regs", "sketch")
        .repartition("bucket", "lo", "hi")
        .sortWithinPartitions("bucket", "lo", "hi", "rep")
    )
    width, least, percent = plan.registers, plan.least_estimate, plan.percent

    def work(band, lo, hi, blk, rep, n, comp, regs, maps):
        order = np.argsort(blk, kind="stable") if lo != hi else np.arange(len(rep))
        rep, n, comp = rep[order], n[order], comp[order]
        regs = np.frombuffer(b"".join(regs[k] for k in order), np.uint16).reshape(len(rep), width)
        maps = Sketches([maps[k] for k in order])
        split = int(np.searchsorted(blk[order], hi)) if lo != hi else 0
        found_a, found_b, found_e = [], [], []
        for x in range(split) if lo != hi else range(len(rep) - 1):
            others = np.arange(split, len(rep)) if lo != hi else np.arange(x + 1, len(rep))
            ok = 100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])
            if not forest:
                ok &= comp[others] != comp[x]
            others = others[ok]
            if not len(others):
                continue
            equal = regs[others] == regs[x]
            est = corrected(equal.sum(1), width)
            near = est >= least
            if not forest:
                near &= equal.reshape(len(others), plan.bands, plan.rows).all(2).argmax(1) == band
            others, est = others[near], est[near]
            if not len(others):
                continue
            near = (100 + percent) * maps.differ(x, others) <= (100 - percent) * (n[others] + n[x])
            found_a.append(np.full(int(near.sum()), rep[x]))
            found_b.append(rep[others[near]])
            found_e.append(est[near])
        if not found_a:
            return None
        a, b, est = map(np.concatenate, (found_a, found_b, found_e))
        a, b = np.minimum(a, b), np.maximum(a, b)
        if forest:
            chosen = _forest(a, b, est)
            a, b = a[chosen], b[chosen]
        return a, b

    def pairs(batches):
        key, held = None, None

        def flush():
            if held:
                a, b = work(*key[1:], *map(np.concatenate, held[:4]), *([x for part in held[i] for x in part] for i in (4, 5))) or ((), ())
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for t in batches:
            if not t.num_rows:
                continue
            keys = np.stack([t.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
            values = [*(t.column(i).to_numpy(zero_copy_only=False) for i in range(4, 8)), t.column(8).to_pylist(), t.column(9).to_pylist()]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                k = tuple(keys[:, s].tolist())
                if k != key:
                    yield from flush()
                    key, held = k, [[] for _ in values]
                for part, x in zip(held, values, strict=True):
                    part.append(x[s:e])
        yield from flush()

    found = dealt.mapInArrow(pairs, "a long, b long")
    return found.distinct() if forest else found


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose full sets meet the threshold, in whole numbers."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("total"))
        .filter(F.expr(f"{100 + plan.percent} * i >= {plan.percent} * total"))
        .select("a", "b")
    )


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``node, comp``: the least node reachable, for each end of an edge."""
    both = work.save(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    held = work.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        labels = held.select("node", "comp")
        step = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
            .join(labels, "node")
            .select("node", F.col("comp").alias("old"), F.least("near", "comp").alias("comp"))
        )
        far = labels.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        step = work.save(
            step.join(far, "comp", "left").select("node", "old", F.coalesce(F.least("comp", "jump"), "comp").alias("comp"))
        )
        work.drop(held)
        held = step
        if step.filter("comp <> old").isEmpty():
            work.drop(both)
            return held


def deduplicated(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``docs`` with the least id of each class; all rows like it with its id, and rows without an id, stay."""
    doc_id, of = unused(docs.columns, "_gone"), unused(docs.columns, "_gone_of")
    gone = _classes(docs, plan).filter("doc_id <> comp").select(F.col("doc_id").alias(doc_id), F.col("of").alias(of)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(doc_id)) & (F.xxhash64("text") == F.col(of)), "left_anti")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``."""
    return _classes(docs, plan).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"),
    )


def _classes(docs: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id, of, n, comp`` for each row: a hash of its text, its set's size, the least id linked with it."""
    work = Workspace(docs.sparkSession)
    sigs = work.save(signatures(docs, plan))
    own = sigs.filter("n > 0 and doc_id is not null")
    classes = work.save(
        own.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "of", "n", "regs", "sketch")).alias("first"), F.count("*").alias("c"))
        .select("k1", "k2", F.xxhash64("k1", "k2").alias("rep"), "c", "first.*")
    )
    size = 2 * plan.rows
    buckets = classes.select(
        "rep",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(plan.bands - 1)),
                lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * size + 1, F.lit(size))),
            )
        ).alias("band", "bucket"),
    )
    shared = (
        buckets.groupBy("bucket", "band").agg(
            F.count("*").alias("m"), F.min("rep").alias("lo"), F.bit_xor(F.xxhash64("rep")).alias("x"))
        .filter("m > 1")
        .groupBy("m", "lo", "x").agg(F.min(F.struct("band", "bucket"))["bucket"].alias("bucket"))
        .select("bucket", "m")
    )
    members = work.save(buckets.join(shared, "bucket").select("bucket", "band", "m", "rep"))
    facts = work.save(classes.select("rep", "n", "regs", "sketch").join(members.select("rep").distinct(), "rep"))
    k = plan.words

    def sets_of(batches):
        for b in batches:
            for flat, bounds in shingle_sets(b.column(1), k):
                n = len(bounds) - 1
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, n), lists], ["rep", "shingles"])
                b = b.slice(n)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), "text").join(
        classes.join(members.select("rep").distinct(), "rep").select("doc_id", "of", "rep"), ["doc_id", "of"]
    )
    columns = ("bucket", "band", "m", "rep", "n", "comp", "regs", "sketch")
    tried = work.save(pair_blocks(members.join(facts.withColumn("comp", F.col("rep")), "rep").select(*columns), plan, forest=True))
    sets = work.save(texts.select("rep", "text").mapInArrow(sets_of, "rep long, shingles array<long>").dropDuplicates(["rep"]))
    links = work.save(confirmed(tried, sets, plan))
    labels = components(links, work)

    marked = members.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").select(
        "bucket", "band", "m", "rep", F.coalesce("comp", "rep").alias("comp")
    )
    largest = work.save(
        marked.groupBy("bucket", "m", "comp").agg(F.count("*").alias("c"))
        .groupBy("bucket", "m").agg(F.max(F.struct("c", "comp")).alias("t"))
        .filter("t.c < m").select("bucket", F.col("t.comp").alias("main"), F.col("t.c").alias("n_main"))
    )
    rest = marked.join(largest, "bucket").join(facts, "rep").select(*columns, "main", "n_main")
    left = work.save(pair_blocks(rest, plan, forest=False).join(tried, ["a", "b"], "left_anti"))
    more = work.save(confirmed(left, sets, plan))
    work.drop(sets, tried, left, largest, members, facts)
    if not more.isEmpty():
        work.drop(labels)
        labels = components(links.unionByName(more), work)
    in_component = classes.select("k1", "k2", "rep", "doc_id").join(labels.select(F.col("node").alias("rep"), "comp"), "rep")
    least = in_component.groupBy("comp").agg(F.min("doc_id").alias("least"))
    least = in_component.join(least, "comp").select("k1", "k2", "least")
    ids = work.save(
        classes.select("k1", "k2", "doc_id", "c").join(least, ["k1", "k2"], "left").select("k1", "k2", "c", F.coalesce("least", "doc_id").alias("comp"))
    )
    # sets of very many rows would land in one task each; there are HOT of them at most, which are broadcast
    hot = F.col("c") >= max(1_000, sigs.count() // HOT)
    in_hot = own.select("doc_id", "of", "n", "k1", "k2").join(F.broadcast(ids.filter(hot).drop("c")), ["k1", "k2"], "left")
    others = in_hot.filter("comp is null").drop("comp").join(ids.filter(~hot).drop("c"), ["k1", "k2"])
    columns = ("doc_id", "of", "n", "comp")
    linked = in_hot.filter("comp is not null").select(*columns).unionByName(others.select(*columns))
    alone = sigs.filter("n = 0 or doc_id is null").select("doc_id", "of", "n", F.col("doc_id").alias("comp"))
    done = work.save(linked.unionByName(alone))
    work.drop(sigs, classes, links, more, labels, ids)
    return done
