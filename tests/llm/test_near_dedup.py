"""Near-duplicate classes: families under the threshold, repeated ids, clashing columns, intermediates."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loadlark.llm import hyperminhash

DOCS = "doc_id long, text string"


def word_list(rng, n):
    return [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(n)]


def family(rng, members, words, changed):
    """Texts that share all but ``changed`` words, each its own, spread out."""
    base = word_list(rng, words)
    out = []
    for _ in range(members):
        own = list(base)
        for k in rng.sample(range(words), changed):
            own[k] = f"own{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def sizes_of(pairs):
    a, b = pairs
    i = len(np.intersect1d(a, b))
    return i / (len(a) + len(b) - i)


def test_a_family_under_the_threshold_gives_few_pairs(spark, monkeypatch):
    rng = random.Random(3)
    texts = family(rng, 300, 3000, 57)
    plan = hyperminhash.Plan(block=64)
    flat, bounds = zip(*hyperminhash.shingle_sets(pa.array(texts[:12]), 3), strict=True)
    sets = [f[b[k] : b[k + 1]] for f, b in zip(flat, bounds, strict=True) for k in range(len(b) - 1)]
    j = [sizes_of((sets[x], sets[y])) for x in range(12) for y in range(x)]
    assert 0.77 < min(j) and max(j) < 0.83
    counts, confirmed = [], hyperminhash.confirmed

    def counted(pairs, sets, plan):
        counts.append(pairs.count())
        return confirmed(pairs, sets, plan)

    monkeypatch.setattr(hyperminhash, "confirmed", counted)
    rows = hyperminhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4), plan).collect()
    assert len(rows) == 300 and all(r["kept"] for r in rows)
    assert sum(counts) <= 300  # of 44,850 possible pairs


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 40, 600, 700, 5000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 9, dtype=np.uint64)])) for s in sets]
    flat, bounds = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    held = hyperminhash.Sketches(hyperminhash.sketches(flat, bounds))
    for x in range(len(sets)):
        got = held.differ(x, np.arange(len(sets)))
        for y, n in enumerate(got.tolist()):
            true = len(np.setxor1d(sets[x], sets[y]))
            assert n <= true and (y != x or n == 0)
        assert got[(x + 5) % 10] >= 0.85 * len(np.setxor1d(sets[x], sets[(x + 5) % 10]))


def test_rows_of_a_repeated_id_are_judged_apart(spark):
    rng = random.Random(8)
    one, two = " ".join(word_list(rng, 60)), " ".join(word_list(rng, 60))
    rows = [(1, one), (5, one), (5, two), (5, two), (None, one), (7, None), (8, ""), (9, " ".join([*two.split()[:-1], "x"]))]
    docs = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], DOCS + ", _gone int, _gone_of int, rep int, comp int")
    kept = hyperminhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, one), (5, two), (5, two), (0, one), (7, ""), (8, "")])
    assert hyperminhash.deduplicated(docs.limit(0)).count() == 0


def test_only_the_result_stays_in_the_shared_folder(spark):
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{place}/work-*"))
    text = " ".join(word_list(random.Random(1), 50))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "a b c d")], DOCS)
    assert {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    (made,) = set(glob.glob(f"{place}/work-*")) - before
    assert len(os.listdir(made)) == 1


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = word_list(rng, 150_000)
    near = list(words)
    for k in rng.sample(range(len(near)), 3000):
        near[k] = f"own{k}"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "b" * 2_000_000)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(docs).filter(F.col("doc_id") > 0).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
