"""Importance resampling towards a target corpus, on an integer word dictionary.

Each task keeps a dictionary of the words it has met and gives each an id. A run
of words is a tuple of ids, and each tuple has an id of its own; only a tuple that
is new has its bytes put together and hashed into a bucket. The counts of tuples
in a text are then joined to the tuples' buckets. What is kept of a text is that
list of (bucket, count), a saved table a fraction of the text's size, so texts are
read and hashed once.

The dictionary is a task's own. One for the whole corpus would have to be joined to
every occurrence of every word, a shuffle larger than the texts, with a third of
the rows at the commonest words; hashing a word once a task costs next to nothing
beside that. When it holds ``kept`` entries it starts anew, which changes no result.

The gain of a bucket compares its share of the target with its share of the corpus.
A text's weight is the sum over its runs; a Gumbel draw by id added to it makes the
``k`` highest scores a sample without replacement in proportion to exp(weight). They
are ranked by a range partition, not in one task.

Defined cases: a null or empty text has no features and weight 0; a text with fewer
than ``min_words`` is scored and never drawn; a null id is drawn for as the empty
string and comes first among ties; repeated rows tie and get ranks of their own; an
empty target makes all gains depend on the corpus alone; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .common import Workspace

#: Bytes of words once A-Z are lower case: digits, letters and everything outside of ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


@dataclass(frozen=True)
class Plan:
    """Features are runs of 1 to ``longest`` words in ``buckets``; ``percent`` of the texts of ``min_words`` or more are drawn."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    min_words: int = 20
    seed: int = 2024
    kept: int = 1_000_000


class Dictionary:
    """Ids of words, ids of tuples of them, and the bucket of each tuple."""

    def __init__(self, plan: Plan):
        self.plan = plan
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.tuples: dict[tuple[int, int], int] = {}  # (id of the tuple without its last word, or -1; id of that word)
        self.members: list[tuple[int, ...]] = []
        self.buckets: list[int] = []

    def word_ids(self, words: pa.Array) -> np.ndarray:
        """Ids of an array of words; each distinct one is looked up once."""
        coded = words.dictionary_encode()
        found = []
        for w in coded.dictionary.to_pylist():
            if w not in self.ids:
                self.ids[w] = len(self.words)
                self.words.append(w)
            found.append(self.ids[w])
        return np.array(found, np.int64)[coded.indices.to_numpy()] if found else np.zeros(0, np.int64)

    def tuple_ids(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Ids of the tuples ``before`` (-1: none) with the word ``last`` behind; a new one is hashed."""
        pairs, where = np.unique((before + 1) << 32 | last, return_inverse=True)
        found = []
        for p in pairs.tolist():
            key = ((p >> 32) - 1, p & 0xFFFFFFFF)
            if key not in self.tuples:
                self.tuples[key] = len(self.members)
                self.members.append((*(self.members[key[0]] if key[0] >= 0 else ()), key[1]))
                self.buckets.append(zlib.crc32(b" ".join(self.words[i] for i in self.members[-1])) % self.plan.buckets)
            found.append(self.tuples[key])
        return np.array(found, np.int64)[where.ravel()] if found else np.zeros(0, np.int64)

    def counted(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each row, and row, bucket and count of each of its distinct tuples."""
        if len(self.members) + len(self.words) >= self.plan.kept:
            self.clear()
        data = A.LOWER[data]
        s, e, first = A.word_bounds(data, offsets, _INSIDE)
        ends = np.zeros(len(s) + 1, np.int64)
        np.cumsum(e - s, out=ends[1:])
        letters = data[_INSIDE[data]].tobytes()
        ids = self.word_ids(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(letters)]))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        level, seen = np.full(len(ids), -1, np.int64), []
        for n in range(1, self.plan.longest + 1):  # level[i]: the tuple of n - 1 words before word i + n - 1
            last = ids[n - 1 :]
            level = level[: len(last)]
            whole = row[: len(last)] == row[n - 1 :]
            level = np.where(whole, level, -1)
            level = self.tuple_ids(level, last)
            seen.append((row[: len(last)][whole], level[whole]))
        rows, tuples = (np.concatenate(x) for x in zip(*seen, strict=True))
        codes, counts = np.unique(rows * max(1, len(self.members)) + tuples, return_counts=True)
        tuples = codes % max(1, len(self.members))
        return np.diff(first), codes // max(1, len(self.members)), np.array(self.buckets or [0], np.int64)[tuples], counts


def features(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, n_words, buckets, counts`` of ``docs(doc_id, text)``: one entry for each distinct run of words."""

    def made(batches) -> Iterator[pa.RecordBatch]:
        known = Dictionary(plan)
        for b in batches:
            data, offsets = A.buffers(b.column(1))
            for i, j in A.slices(offsets):
                words, rows, buckets, counts = known.counted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = pa.array(np.searchsorted(rows, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i), pa.array(words, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(buckets, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                    ],
                    ["doc_id", "n_words", "buckets", "counts"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        made, "doc_id long, n_words long, buckets array<int>, counts array<int>"
    )


def totals(counted: DataFrame) -> dict[int, int]:
    """Features of all texts in each bucket: as many entries as there are buckets, at most."""
    pairs = counted.select(F.inline(F.arrays_zip("buckets", "counts")))
    return {r["buckets"]: r["n"] for r in pairs.groupBy("buckets").agg(F.sum("counts").alias("n")).collect()}


def gains(target: dict[int, int], corpus: dict[int, int], plan: Plan) -> list[int]:
    """Of each bucket, thousandths of the log ratio of smoothed shares, rounded down."""
    all_target, all_corpus = float(sum(target.values()) + plan.buckets), float(sum(corpus.values()) + plan.buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1) * all_corpus / ((corpus.get(b, 0) + 1) * all_target)))
        for b in range(plan.buckets)
    ]


def resample(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row of ``docs``; ``target`` has a column ``text``."""
    spark = docs.sparkSession
    work = Workspace(spark)
    counted = work.save(features(docs, plan).withColumn("_row", F.monotonically_increasing_id()))
    wanted = totals(features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), plan))
    gain = F.split(F.lit(",".join(map(str, gains(wanted, totals(counted), plan)))), ",").cast("array<long>")
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296)))
    zero = F.lit(0).cast("long")
    scored = counted.select(
        "doc_id", "n_words", "_row",
        F.aggregate("counts", zero, lambda a, n: a + n).alias("n_features"),
        F.aggregate(F.arrays_zip("buckets", "counts"), zero, lambda a, x: a + gain[x["buckets"]] * x["counts"]).alias("weight"),
    ).withColumn("score", (F.col("weight") + noise).cast("long"))
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("_row").asc()]  # no two rows alike: a repeated row fills no range of its own
    ranges = work.save(
        scored.filter(F.col("n_words") >= plan.min_words).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    before, at = [], 0
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():  # one row a shuffle partition
        before.append((r["_range"], at))
        at += r["count"]
    starts = spark.createDataFrame(before, "_range int, _before long")
    rank = F.col("_before") + F.col("_place") + 1
    drawn = ranges.join(F.broadcast(starts), "_range").withColumn("rank", F.when(rank <= plan.percent * at // 100, rank))
    short = scored.filter(F.col("n_words") < plan.min_words).withColumn("rank", F.lit(None).cast("long"))
    kept = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*kept).unionAll(short.select(*kept))


#: The same rows in DuckDB's SQL, with the plan's defaults.
ORACLE = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)::BIGINT[]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
dw AS (SELECT r, unnest(words) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(w), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table
),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM (SELECT DISTINCT bucket FROM hashed) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
weights AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)
),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS k FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN k <= 10 * (SELECT count(*) FROM ranked) // 100 THEN k END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
