"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Inside and outside of a word, as every contract of this package has it.
SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own machine; a
    cluster has no folder that could stand in, so that is an error.
    """
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="loadlark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    return place


class Workspace:
    """Parquet tables of one job, in a folder of its own under the shared one.

    A saved table cuts the lineage: a lost executor costs no recomputation of
    what came before. Tables are dropped as soon as nothing reads them any more;
    those that a returned DataFrame reads stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.saved_at = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for table in tables:
            path = files.Path(table.saved_at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` saved in a :class:`Workspace` of its own."""
    return Workspace(df.sparkSession).save(df)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once: a lambda's variable, which no optimizer rule copies."""
    return F.transform(F.array(value), body)[0]


def running_totals(lengths: Column, block: int = 128) -> Column:
    """Sums of all entries before each one; two levels, so that a long array isn't summed anew for each entry."""
    add = lambda a, b: a + b
    zero = F.lit(0).cast("int")

    def over(xs: Column) -> Column:
        n_blocks = F.ceil(F.size(xs) / F.lit(block)).cast("int")
        sums = F.transform(
            F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))),
            lambda b: F.aggregate(F.slice(xs, b * block + 1, F.lit(block)), zero, add),
        )
        return let(
            let(sums, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), zero, add))),
            lambda before: F.transform(
                xs,
                lambda _, i: before[F.floor(i / F.lit(block)).cast("int")]
                + F.aggregate(
                    F.slice(xs, F.floor(i / F.lit(block)).cast("int") * block + 1, i % block), zero, add
                ),
            ),
        )

    return let(lengths, over)


def regex_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, end, value>>``, in code points.

    The pieces between the matches and the matches themselves have all the
    lengths that positions need. Patterns must not match the empty string.
    """
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def placed(h: Column, gaps: Column) -> Column:
        before = running_totals(F.zip_with(gaps, h, lambda g, m: F.length(g) + F.length(m)))
        heads = F.zip_with(before, gaps, lambda b, g: b + F.length(g))
        return F.zip_with(
            heads, h, lambda a, m: F.struct(a.alias("start"), (a + F.length(m)).alias("end"), m.alias("value"))
        )

    def of(t: Column) -> Column:
        return let(
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda h: F.when(F.size(h) == 0, empty).otherwise(
                let(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(h)), lambda gaps: placed(h, gaps))
            ),
        )

    return let(text, of)


def digest(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of ``array<struct<start, kind_no, kind, end>>`` in that order."""
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, spread: Column | None = None) -> DataFrame:
    """``df`` with a gapless number from 0 within ``keys``; no key's rows ever meet in one task.

    Rows are dealt into about the square root of their count buckets by
    ``spread``, a hash of ``order`` if not given; a bucket's first number is the count of all buckets before it,
    so a window never spans more than a bucket, or a key's list of buckets.
    """
    n_rows = df.count()
    n = F.lit(max(1, int(n_rows**0.5)))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order) if spread is None else spread, n))
    before = (
        dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select(*keys, "_bucket", "_before")
    )
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return (
        dealt.join(before, [*keys, "_bucket"])
        .withColumn(name, (F.col("_before") + place).cast("long"))
        .select(*df.columns, name)
    )
