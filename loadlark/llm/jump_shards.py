"""Shards by jump consistent hashing.

The shard of a document follows from its id and the shard count alone: a 64-bit
key drives a linear congruential generator whose draws give the shard counts at
which the document would move; the last one below the count is its shard. One
more shard takes the rows that move into it, and no row moves elsewhere. There
is no ring and no table, all of it is an expression; the slot within a shard is
numbered in buckets by id and text, so that neither a shard nor the rows of one
repeated or missing id pass through one task; rows that are equal in both do.

Defined cases: a null text has size 1 and checksum 0; a null id hashes as the
empty string; repeated rows share a shard and get slots of their own; other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

MULTIPLIER = 2862933555777941757
_HI, _LO = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF


def key_halves(doc_id: Column) -> tuple[Column, Column]:
    """The first 64 bits of the id's digest, as two numbers of 32 bits."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return part(1), part(9)


def jump(hi: str, lo: str, shards: int) -> Column:
    """``struct<shard, grown>`` for ``shards`` and one more, of a 64-bit key in two columns.

    Products are made of 16-bit parts: they stay below 2**63, so nothing overflows.
    """
    low = f"(s.lo & 65535) * {_LO} + 1"
    mid = f"shiftright(s.lo, 16) * {_LO} + shiftright({low}, 16)"
    new_lo = f"shiftleft(({mid}) & 65535, 16) | (({low}) & 65535)"
    new_hi = (
        f"(shiftright({mid}, 16) + s.lo * {_HI} + (s.hi & 65535) * {_LO}"
        f" + shiftleft((shiftright(s.hi, 16) * {_LO}) & 65535, 16)) & 4294967295"
    )
    return F.expr(
        f"""aggregate(sequence(1, {shards + 1}),
        named_struct('hi', {hi}, 'lo', {lo}, 'j', 0L, 'shard', -1L, 'grown', -1L),
        (s, _) -> CASE WHEN s.j > {shards} THEN s ELSE
          transform(array(named_struct('hi', {new_hi}, 'lo', {new_lo})), k -> named_struct(
            'hi', k.hi, 'lo', k.lo,
            'j', cast(floor((s.j + 1) * (2147483648D / (shiftright(k.hi, 1) + 1))) as bigint),
            'shard', CASE WHEN s.j < {shards} THEN s.j ELSE s.shard END,
            'grown', s.j))[0] END,
        s -> named_struct('shard', cast(s.shard as int), 'grown', cast(s.grown as int)))"""
    )


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of ``docs(doc_id, text)``."""
    hi, lo = key_halves(F.col("doc_id"))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        hi.alias("_hi"), lo.alias("_lo"),
    ).withColumn("_at", jump("_hi", "_lo", shards))
    flat = keyed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_at.shard").alias("shard"),
        F.col("_at.grown").alias("grown_shard"), "_lo",
    )
    return numbered(flat, ["shard"], ["doc_id", "text_crc32", "size"], "slot", F.col("_lo") + F.col("text_crc32")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


#: The same rows in DuckDB's SQL, for 16 shards.
ORACLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)::BIGINT[]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0) + 1 AS size,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) END AS text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hi,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 9, 8))::BIGINT AS lo
  FROM documents, crc_table
),
walk AS (
  SELECT r, hi::HUGEINT * 4294967296 + lo AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL
  SELECT r, k2, j, floor((j + 1) * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, j, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < 17)
),
ended AS (SELECT r, CAST(max(CASE WHEN j < 16 THEN j END) AS INT) AS shard, CAST(max(CASE WHEN j < 17 THEN j END) AS INT) AS grown_shard FROM walk GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY (lo + text_crc32) % greatest(1, floor(sqrt((SELECT count(*) FROM documents)))::BIGINT),
    doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM d JOIN ended USING (r)
"""
