"""Places in a total order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place in ``order`` (a total one), from 1.

    Ranges of the order are sorted apart and written; a range's rows begin where the earlier ranges
    end. Only the ranges' row counts, one number each, are gathered.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # An id is the partition's number in the high bits and the row's in the low 33.
    held = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranges")
    part, row = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["n"] for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begin, starts = 0, []
    for p in range(parts):
        starts.append(begin)
        begin += counts.get(p, 0)
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), part + 1)
    return held.withColumn(name, first + row + 1).drop("__id")
