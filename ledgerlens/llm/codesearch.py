"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit per component, set where it is positive. Codes are cut
in substrings, each with a direct-address table of its rows. A query probes the
substrings at radius 0, then 1, 2, ...; once the first j + 1 of m substrings are
done at radius s, every code within m * s + j has been verified, so the search ends
when the kth verified distance is that small. Nothing is estimated or cut off.

Rows are dealt in blocks, each with tables of its own, and every block answers every
query exactly; the best k of the blocks' answers are exact. The query set is stated
(a fraction of the rows), so this is a search in blocks and not a join of all pairs.
Rows with the same code are searched as one; the smallest k + 1 of their ids
can be in a result (ties go to smaller ids).

Edge cases: as in the approximate search: null, zero, null-holding or non-finite vectors
and those of another width than the most frequent take no part. Rows that repeat an id and
code count once. Fewer other rows than k: all of them. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.arrowgroups import group_heads, whole_groups
from ledgerlens.llm.vectors import coded, dealt_grid, modal_width, pack, top_rows, usable
from ledgerlens.session import materialize

SEGMENT_BITS = 16
#: Rows of a block: enough blocks for a cluster's cores, but no more rows than a task holds.
MIN_BLOCK, MAX_BLOCK, QUERY_BLOCK = 4096, 1 << 20, 1 << 16


class CodeIndex:
    """The substring tables of a block's codes (row x 64-bit words, the first ``bits`` in use)."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, bits: int) -> None:
        self.codes, self.ids = codes, ids
        self.cuts = [(at, min(SEGMENT_BITS, bits - at)) for at in range(0, bits, SEGMENT_BITS)]
        self.tables = []
        for cut in self.cuts:
            key = self._segment(codes, cut)
            order = np.argsort(key, kind="stable")
            self.tables.append((order, np.append(0, np.cumsum(np.bincount(key, minlength=1 << cut[1])))))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def _segment(codes: np.ndarray, cut: tuple[int, int]) -> np.ndarray:
        # A cut never crosses a word, as 64 is a multiple of SEGMENT_BITS.
        word = codes[..., cut[0] // 64]
        return ((word >> np.uint64(cut[0] % 64)) & np.uint64((1 << cut[1]) - 1)).astype(np.int64)

    def _masks(self, bits: int, ones: int) -> np.ndarray:
        if (bits, ones) not in self.masks:
            self.masks[bits, ones] = np.array([sum(1 << b for b in c) for c in combinations(range(bits), ones)], dtype=np.int64)
        return self.masks[bits, ones]

    def nearest(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k codes nearest to ``code``, ties to smaller ids."""
        seen = np.zeros(len(self.ids), bool)
        rows, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = len(self.cuts)
        own = [int(self._segment(code, cut)) for cut in self.cuts]
        for s in range(SEGMENT_BITS + 1):
            for j, cut in enumerate(self.cuts):
                if s <= cut[1]:
                    order, heads = self.tables[j]
                    keys = own[j] ^ self._masks(cut[1], s)
                    first, size = heads[keys], heads[keys + 1] - heads[keys]
                    full = size > 0
                    if full.any():
                        first, size = first[full], size[full]
                        at = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                        got = order[at]
                        got = got[~seen[got]]
                        seen[got] = True
                        rows = np.append(rows, got)
                        distances = np.append(distances, np.bitwise_count(self.codes[got] ^ code).sum(axis=1, dtype=np.int64))
                # Strictly nearer than what is yet to come, or ties could have smaller ids.
                if len(rows) >= k and np.partition(distances, k - 1)[k - 1] <= m * s + j:
                    best = np.lexsort((self.ids[rows], distances))[:k]
                    return self.ids[rows[best]], distances[best]
        best = np.lexsort((self.ids[rows], distances))[:k]
        return self.ids[rows[best]], distances[best]


def _answer(bits: int, words: int, k: int):
    keys = ["block", "qblock"]
    fields = [("query", pa.int64()), ("row", pa.int64()), ("distance", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            heads = group_heads(table, keys)
            for lo, hi in zip(heads[:-1], heads[1:], strict=True):
                part = table.slice(lo, hi - lo).combine_chunks()
                kind = part.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
                if kind.all() or not kind.any():
                    continue
                ids = part.column("vec_id").to_numpy()
                codes = part.column("code").combine_chunks().flatten().to_numpy().reshape(len(ids), words).view(np.uint64)
                index = CodeIndex(codes[~kind], ids[~kind], bits)
                rows = []
                for q in np.flatnonzero(kind):
                    got, distance = index.nearest(codes[q], k)
                    rows += zip([int(ids[q])] * len(got), got.tolist(), distance.tolist(), strict=True)
                    if len(rows) > 100_000:
                        yield top_rows(fields, rows)
                        rows = []
                if rows:
                    yield top_rows(fields, rows)

    return run


def exact_top_k(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, distance: the k other rows with the nearest codes, exactly."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    bits = modal_width(rows)
    if not bits:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    words = -(-bits // 64)
    rows = rows.where(F.size("embedding") == bits)
    all_rows = materialize(coded(rows, lambda x: pack(x > 0), words, bits).select("vec_id", "code").distinct(), "codes")

    # One class per code; the limit is pushed below the shuffle, so a crowded code sends few rows.
    by_code = W.partitionBy("code").orderBy("vec_id")
    few = all_rows.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k + 1)
    classes = few.groupBy("code").agg(F.min("vec_id").alias("vec_id"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    classes = materialize(classes, "classes")
    query_ids = all_rows.where(is_query).select(F.col("vec_id").alias("query_id"), "code")
    query_ids = materialize(query_ids.join(classes.select("code", F.col("vec_id").alias("query")), "code").select("query_id", "query", "code"), "queries")
    asked = query_ids.select(F.col("query").alias("vec_id"), "code").distinct()
    total, n_asked = classes.count(), asked.count()
    blocks = max(-(-total // MAX_BLOCK), min(16, -(-total // MIN_BLOCK)), 1)
    qblocks = max(1, -(-n_asked // QUERY_BLOCK))

    found = dealt_grid(classes, asked, ["vec_id", "code"], blocks, qblocks).mapInArrow(_answer(bits, words, k + 1), "query long, row long, distance long")

    nearness = lambda key, tie: W.partitionBy(key).orderBy("distance", tie)
    found = found.withColumn("n", F.row_number().over(nearness("query", "row"))).where(F.col("n") <= k + 1).drop("n")
    members = classes.select(F.col("vec_id").alias("row"), F.explode("members").alias("vec_id"))
    spread = found.join(members, "row").withColumn("n", F.row_number().over(nearness("query", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    own = spread.join(query_ids.select("query", "query_id"), "query").where(F.col("vec_id") != F.col("query_id"))
    ranked = own.withColumn("rank", F.row_number().over(nearness("query_id", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))
