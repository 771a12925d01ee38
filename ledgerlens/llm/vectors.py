"""Vectors as binary codes: what both searches share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that aren't zero."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def modal_width(rows: DataFrame) -> int:
    """The most frequent number of components (the smaller of ties); 0 without rows."""
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(top["d"]) if top else 0


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``width`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def pack(signs: np.ndarray) -> np.ndarray:
    """Row x 64-bit words of a boolean matrix; the first column is the lowest bit."""
    bits = np.packbits(signs, axis=1, bitorder="little")
    short = -bits.shape[1] % 8
    if short:
        bits = np.pad(bits, ((0, 0), (0, short)))
    return np.ascontiguousarray(bits).view("<u8")


def top_rows(batch_fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(batch_fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, batch_fields, strict=True)], names=[n for n, _ in batch_fields])


def coded(rows: DataFrame, code, words: int, width: int) -> DataFrame:
    """vec_id, code (array<long>), k1, k2 (a 128-bit hash of the vector), embedding.

    ``code`` maps a float64 matrix to row x word codes; it travels in the closure and is small.
    """
    schema = rows.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            if not batch.num_rows:
                continue
            own = as_matrix(batch.column("embedding"), width)
            codes = code(own.astype(np.float64)).view("<i8")
            keys = np.frombuffer(b"".join(hashlib.md5(x.tobytes()).digest() for x in np.ascontiguousarray(own)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), words).cast(pa.list_(pa.int64())),
                    pa.array(np.ascontiguousarray(keys[:, 0])),
                    pa.array(np.ascontiguousarray(keys[:, 1])),
                    batch.column("embedding"),
                ],
                names=["vec_id", "code", "k1", "k2", "embedding"],
            )

    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, code array<long>, k1 long, k2 long, embedding {schema}")


def dealt_grid(rows: DataFrame, queries: DataFrame, columns: list[str], blocks: int, qblocks: int) -> DataFrame:
    """Rows and queries (``is_query``) by a grid of blocks: a partition holds one (block, qblock), whatever AQE thinks of its size."""
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(*columns, F.lit(False).alias("is_query"), deal(blocks).alias("block"), every(qblocks).alias("qblock"))
    right = queries.select(*columns, F.lit(True).alias("is_query"), deal(qblocks).alias("qblock"), every(blocks).alias("block"))
    both = left.unionByName(right).repartitionById(blocks * qblocks, F.col("block") * qblocks + F.col("qblock"))
    return both.sortWithinPartitions("block", "qblock")
