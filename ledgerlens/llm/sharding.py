"""Sharding by jump consistent hashing, in DataFrame functions only.

Lamping and Veach's jump hash walks a key's pseudo-random sequence of bucket
numbers 0 = b0 < b1 < ...; the shard among n is the last one below n. So one walk
gives the shard for n and for n + 1, and a row moves only into the appended shard.

Law: ``key``. The 64-bit key is ``doc_id`` itself; shard = jump(doc_id, n).

Edge cases: a null doc_id counts as key 0. A null text has size 1 and a null
crc. Repeated rows get neighbouring slots, ties in the order are theirs only. Texts
count whole at any length. An empty table gives an empty result. Other columns of the
input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Multiplier of the published algorithm's linear congruential generator.
LCG = 2862933555777941757
#: Multiplier of the hash that orders a shard (another published generator's).
ORDER = 6364136223846793005
#: Rows that one slot window holds on average.
ROWS_PER_CHUNK = 100_000

_MASK32 = 0xFFFFFFFF
_M = [(LCG >> s) & 0xFFFF for s in (0, 16, 32, 48)]


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) of key * LCG + 1 mod 2**64, by limbs that never overflow a long.

    Plain ``*`` on longs raises under ANSI arithmetic, and the caller's setting
    must neither matter nor be changed.
    """
    low = lo * F.lit(_M[0]) + F.shiftleft((lo * F.lit(_M[1])).bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = (
        F.shiftright(low, 32)
        + F.shiftright(lo * F.lit(_M[1]), 16)
        + lo * F.lit(_M[2])
        + F.shiftleft((lo * F.lit(_M[3])).bitwiseAND(F.lit(0xFFFF)), 16)
        + hi * F.lit(_M[0])
        + F.shiftleft((hi * F.lit(_M[1])).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    return high.bitwiseAND(F.lit(_MASK32)), low.bitwiseAND(F.lit(_MASK32))


def jump_shards(key: Column, n: int) -> Column:
    """struct<shard, grown>: the shard of ``key`` among n shards and among n + 1.

    A walk visits growing bucket numbers, so n + 1 steps always suffice.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_MASK32)).alias("lo"),
        F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
    )

    def walk(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        jump = F.floor((s["at"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            jump.alias("at"),
            F.when(jump < n, jump).otherwise(s["shard"]).alias("shard"),
            F.when(jump < n + 1, jump).otherwise(s["grown"]).alias("grown"),
        )
        return F.when(s["at"] > n, s).otherwise(moved)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(n + 1)), start, walk)
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def _times(hi: Column, lo: Column, factor: int) -> Column:
    """The high 32 bits of key * factor mod 2**64, by limbs that never overflow a long."""
    f = [F.lit((factor >> s) & 0xFFFF) for s in (0, 16, 32, 48)]
    low = lo * f[0] + F.shiftleft((lo * f[1]).bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftright(low, 32) + F.shiftright(lo * f[1], 16) + lo * f[2] + F.shiftleft((lo * f[3]).bitwiseAND(F.lit(0xFFFF)), 16)
    high = high + hi * f[0] + F.shiftleft((hi * f[1]).bitwiseAND(F.lit(0xFFFF)), 16)
    return high.bitwiseAND(F.lit(_MASK32))


def place(key: Column) -> Column:
    """A number below 2**32 that orders a shard's rows: multiplicative hashing of the key."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    return _times(F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_MASK32)), ORDER)


def shard_documents(docs: DataFrame, n_shards: int = 16, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    A shard's rows are in the order of (place, doc_id, crc, size), whatever their
    number, and slots count from 0 in that order without a gap. No shard is numbered in one
    task: ranges of places make chunks of about ``rows_per_chunk``, a chunk is numbered
    alone and starts where the earlier chunks of its shard end. Repeated rows are
    counted before they meet. The table of chunk counts has rows / rows_per_chunk rows; it
    and their number need the ids alone, so nothing is written in between.
    Texts are scanned once and never shuffled.
    """
    seen = (
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    chunks = max(1, -(-docs.count() // (rows_per_chunk * n_shards)))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("j", jump_shards(F.col("doc_id"), n_shards)).withColumn("place", place(F.col("doc_id")))
        chunk = F.shiftright(F.col("place") * F.lit(chunks), 32).cast("int")
        return rows.select("*", F.col("j.shard").alias("shard"), F.col("j.grown").alias("grown_shard"), chunk.alias("chunk")).drop("j")

    counts = placed(docs.select("doc_id")).groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    earlier = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("of_shard"), F.col("chunk").alias("of_chunk"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    order = [F.asc_nulls_last(c) for c in ("place", "doc_id", "text_crc32", "size")]
    within = W.partitionBy("shard", "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("copies").over(within), F.lit(0))
    # Neither is ever null; with a plain equality Spark would compute both once more, where it scans, to filter nulls.
    same = F.col("shard").eqNullSafe(F.col("of_shard")) & F.col("chunk").eqNullSafe(F.col("of_chunk"))
    numbered = placed(seen).withColumn("first", first).join(offsets, same)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    slots = numbered.select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("offset") + F.col("first")).alias("start"), at.alias("at"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"), "grown_shard")
