"""Approximate nearest neighbours by multi-index hashing.

Codes: the vectors' principal axes are rotated so that their signs lose least
(iterative quantisation, fitted on a bounded sample); a code has a bit per axis.
Rows lie in blocks; in each block the codes are cut in ``SEGMENTS`` substrings and
every substring has an index of its own (rows sorted by its key). By the pigeonhole
principle a code within radius r of a query agrees with it in some substring up to that
substring's share of r. So a query probes each index for the keys within that share,
keeps the codes within r, and ranks them by the inner product of the original vectors
in double precision.

The radius isn't a constant: a bounded number of queries is searched exactly over
all rows, and r is the distance that covers ``COVER`` of their neighbours' codes.
Queries that find fewer rows than asked for are searched again with the full
radius, so every query gets its k rows where there are so many.

Equal vectors are searched as one; of their ids the smallest k + 1 can be in a
result (ties go to smaller ids), so the others are never needed.

The query set is stated (a fraction of the rows), so this is a search in blocks: a grid
of row blocks (bounded in bytes) and query blocks, a task for each. A vector travels once
for each query block, a query once for each row block, and never once for each key probed.

Edge cases: null, zero, null-holding or non-finite vectors take no part, nor those whose
width isn't the most frequent one (an inner product with them isn't defined). Rows that
repeat an id and vector count once. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.arrowgroups import group_heads, whole_groups
from ledgerlens.llm.vectors import as_matrix, coded, dealt_grid, modal_width, pack, top_rows, usable
from ledgerlens.session import materialize

#: Rows that fit the rotation, and queries that fit the radius over all rows.
SAMPLE, RADIUS_QUERIES = 8192, 64
#: Share of the radius queries' true neighbours whose codes the radius covers.
COVER = 0.975
SEGMENTS, MAX_BITS = 4, 64
#: Bytes of a row block's vectors, the least rows and the blocks that a small table is still cut in, and a query block's rows.
BLOCK_BYTES, MIN_BLOCK, MIN_BLOCKS, QUERY_BLOCK = 64 << 20, 4096, 16, 1 << 16


def fit_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix) whose signs are the code: principal axes, then the rotation that
    alternates between signs and the orthogonal map nearest to them."""
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred / max(1, len(x)))
    axes = axes[:, ::-1][:, :bits]
    v = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        b = np.where(v @ rotation > 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(v.T @ b)
        rotation = u @ w
    return mean, axes @ rotation


def segment_cuts(bits: int, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(shift, width) of the substrings: near equal, all within one 64-bit word."""
    ends = [round(bits * (j + 1) / segments) for j in range(segments)]
    return [(a, b - a) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def segment_radii(radius: int, cuts: list[tuple[int, int]]) -> list[int]:
    """Each substring's radius: r = m * q + a gives q to the first a + 1, q - 1 to the others (-1: not probed)."""
    q, a = divmod(radius, len(cuts))
    return [min(w, q if j <= a else q - 1) for j, (_, w) in enumerate(cuts)]


def _radius_sample(index: DataFrame, queries: np.ndarray, codes: np.ndarray, k: int, width: int) -> list:
    """(query, score, distance) of the k best rows of each sample query, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("q", pa.int64()), ("score", pa.float64()), ("distance", pa.int64())]
        for batch in batches:
            if not batch.num_rows:
                continue
            s = queries @ as_matrix(batch.column("embedding"), width).astype(np.float64).T
            own = batch.column("code").to_numpy(zero_copy_only=False).astype(np.uint64)
            rows = []
            for i in range(len(queries)):
                best = np.argsort(-s[i], kind="stable")[: k + 1]
                rows += [(i, float(s[i, j]), int(np.bitwise_count(own[j] ^ codes[i]))) for j in best]
            yield top_rows(fields, rows)

    got = index.mapInArrow(run, "q long, score double, distance long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "distance"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k + 1).collect()


class SubstringIndex:
    """A block's rows by the key of every substring that a radius probes."""

    def __init__(self, codes: np.ndarray, cuts: list[tuple[int, int]], radii: list[int]) -> None:
        self.tables = []
        for cut, radius in zip(cuts, radii, strict=True):
            if radius >= 0:
                key = self.segment(codes, cut)
                order = np.argsort(key, kind="stable")
                heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                self.tables.append((cut, radius, order, key[order][heads], np.diff(np.append(heads, len(key)))))
        self.codes = codes

    @staticmethod
    def segment(codes, cut: tuple[int, int]):
        return ((codes >> np.uint64(cut[0])) & np.uint64((1 << cut[1]) - 1)).astype(np.uint32)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """All rows whose codes lie within ``radius`` of ``code``."""
        found = np.zeros(len(self.codes), bool)
        for cut, share, order, keys, sizes in self.tables:
            probed = np.bitwise_count(keys ^ self.segment(code, cut)) <= share
            found[order[np.repeat(probed, sizes)]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _search(cuts: list[tuple[int, int]], radii: list[int], radius: int, k: int, width: int):
    keys = ["block", "qblock"]
    fields = [("query", pa.int64()), ("row", pa.int64()), ("score", pa.float64())]

    def one_group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = table.column("is_query").to_numpy().astype(bool)
        if asks.all() or not asks.any():
            return
        ids = table.column("vec_id").to_numpy()
        codes = table.column("code").to_numpy().view(np.uint64)
        vectors = as_matrix(table.column("embedding"), width)
        index, row_ids, row_vectors = SubstringIndex(codes[~asks], cuts, radii), ids[~asks], vectors[~asks]
        out: list[tuple] = []
        for q in np.flatnonzero(asks):
            found = index.within(codes[q], radius)
            if not len(found):
                continue
            score = row_vectors[found].astype(np.float64) @ vectors[q].astype(np.float64)
            if len(found) > k:  # ties at the end stay, to be settled by id
                edge = np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[score >= edge], score[score >= edge]
            best = np.lexsort((row_ids[found], -score))[:k]
            out += zip([int(ids[q])] * len(best), row_ids[found[best]].tolist(), score[best].tolist(), strict=True)
            if len(out) > 100_000:
                yield top_rows(fields, out)
                out = []
        if out:
            yield top_rows(fields, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            heads = group_heads(table, keys)
            for lo, hi in zip(heads[:-1], heads[1:], strict=True):
                yield from one_group(table.slice(lo, hi - lo).combine_chunks())

    return run


def _probe(index: DataFrame, queries: DataFrame, total: int, cuts: list, radius: int, k: int, width: int) -> DataFrame:
    """(query, row, score): each query's best k rows within ``radius`` of its code."""
    radii = segment_radii(radius, cuts)
    rows = max(1, BLOCK_BYTES // (4 * width))
    blocks = max(-(-total // rows), min(MIN_BLOCKS, -(-total // MIN_BLOCK)), 1)
    qblocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = dealt_grid(index, queries, ["vec_id", "code", "embedding"], blocks, qblocks).mapInArrow(_search(cuts, radii, radius, k, width), "query long, row long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def nearest(embeddings: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row where ``is_query``.

    ``is_query`` is a Column over ``vec_id``.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    width = modal_width(rows)
    if not width:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    bits = min(MAX_BITS, width)
    mean, axes = fit_rotation(np.stack(list(sample)).astype(np.float64), bits)
    cuts = segment_cuts(bits, min(SEGMENTS, bits))
    all_rows = materialize(coded(rows, lambda x: pack((x - mean) @ axes > 0), 1, width).withColumn("code", F.col("code")[0]), "codes")

    # One class per vector; the limit is pushed below the shuffle, so a crowded vector sends few rows.
    by_vector = W.partitionBy("k1", "k2").orderBy("vec_id")
    few = all_rows.dropDuplicates(["vec_id", "k1", "k2"]).withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    lead = F.min(F.struct("vec_id", "code", "embedding")).alias("lead")
    classes = few.groupBy("k1", "k2").agg(lead, F.array_sort(F.collect_list("vec_id")).alias("members"))
    classes = materialize(classes.select("k1", "k2", "lead.*", "members"), "classes")
    query_ids = materialize(
        all_rows.where(is_query).select("vec_id", "k1", "k2").distinct().withColumnRenamed("vec_id", "query_id")
        .join(classes.select("k1", "k2", F.col("vec_id").alias("query")), ["k1", "k2"]).select("query_id", "query"),
        "queries",
    )
    asked = materialize(classes.join(query_ids.select(F.col("query").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "code", "embedding"), "asked")
    total = classes.count()

    drawn = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(RADIUS_QUERIES).collect()
    if not drawn:
        return spark.createDataFrame([], schema)
    codes = np.array([r["code"] for r in drawn], dtype=np.int64).view(np.uint64)
    best = _radius_sample(classes, np.array([r["embedding"] for r in drawn], dtype=np.float64), codes, k, width)
    radius = int(np.quantile([r["distance"] for r in best], COVER, method="higher"))

    found = materialize(_probe(classes, asked, total, cuts, radius, k + 1, width), "found")
    wanted = min(k + 1, total)
    short = asked.join(found.groupBy("query").count().where(F.col("count") >= wanted), asked["vec_id"] == F.col("query"), "left_anti")
    short = materialize(short, "short")
    if radius < bits and not short.isEmpty():
        again = _probe(classes, short, total, cuts, bits, k + 1, width)
        found = found.join(short.select(F.col("vec_id").alias("query")), "query", "left_anti").unionByName(again)

    members = classes.select(F.col("vec_id").alias("row"), F.explode("members").alias("vec_id"))
    spread = found.join(members, "row")
    nearness = lambda key: W.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    spread = spread.withColumn("n", F.row_number().over(nearness("query"))).where(F.col("n") <= k + 1).drop("n")
    own = spread.join(query_ids, "query").where(F.col("vec_id") != F.col("query_id"))
    ranked = own.withColumn("rank", F.row_number().over(nearness("query_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
