"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, ... and share
all words; no source's target exceeds ``MAX_REPEATS`` times its size, and the excess
is shared again by weight until none does.

Draw: a source whose target is r times its size takes every document floor(r)
times, and draws documents for the rest. Its documents fall by a hash into ``BLOCKS``
blocks; blocks are permuted, and drawn whole in that order until the rest is reached;
the block that crosses it is cut between two documents. Each pass over the documents
(a whole copy or the rest) is a set of drawn blocks. A binary tree over the output
shards splits every source's exact number of drawn blocks: at each node the left
half's quotas come from a multivariate hypergeometric draw, so leaves hold exact
quotas and the blocks of a pass are dealt to shards without overlap by rank.
Inside a shard documents are ordered by a hash.

The table of blocks has at most ``BLOCKS`` rows per source at every size, so a source with
a third of all rows is as many groups as any other, and no window is longer. Texts are
scanned for their sizes, and once more where they are written; planning moves none.
Sources are the origins of a corpus: their names and sums (not their rows) reach the driver.

Edge cases: null, empty and blank texts have size 0 and count as taken 0 words. An empty
table gives an empty result. Sources of size 0 have target 0. A null source is a
source of its own. Texts are counted whole at any length. Repeated rows count each, and
those of one doc_id, text and source are taken or left together. Ties can't be: keys are
hashes of doc_id and text. Reruns give the same draw. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Blocks of a source (a power of two), and of a block's parts.
BLOCKS = 1024
SHARDS = 16
#: Up to so many sources a table with a row for each is broadcast (at most 20 MB).
BROADCAST_SOURCES = 20_000
SEED = 29


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_sizes(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Share the sum of ``sizes`` by weight; what lies above cap * size is shared again."""
    left = float(sum(sizes))
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = cap * float(sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(counts: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shard x source quotas: row sums differ by at most one, column sums are ``counts``."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(counts)), np.int64)

    def node(lo: int, hi: int, own: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        total = int(own.sum())
        # The left half's exact share of the blocks of this node, as shards lo..hi-1 hold them.
        left = sum(total // (hi - lo) + (1 if i < total % (hi - lo) else 0) for i in range(mid - lo))
        draw = rng.multivariate_hypergeometric(own, left, method="marginals") if total else own
        node(lo, mid, draw)
        node(mid, hi, own - draw)

    node(0, shards, counts.astype(np.int64))
    return out


def _read(docs: DataFrame, *more: Column | str) -> DataFrame:
    """Rows with their source and key, and the block and part that the key's hash gives."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED), "text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), *more)
    spot = F.xxhash64("key", F.lit(SEED))
    part = lambda shift: F.shiftright(spot, shift).bitwiseAND(F.lit(BLOCKS - 1)).cast("int")
    return keyed.withColumns({"block": part(0), "part": part(20)})


def _few(df: DataFrame, sources: int) -> DataFrame:
    """A table with one row per source: broadcast where that is proven to be few."""
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df


def _cuts(narrow: DataFrame, crossed: DataFrame, sources: int) -> DataFrame:
    """source_no, cut_part, cut_key: the last part and key that a source's crossed block gives.

    Two levels: the words of the block's parts find the part in which the rest ends, the words of
    that part's keys the key, so no task orders more than a part of a block.
    """
    own = narrow.join(_few(crossed, sources), narrow["source"].eqNullSafe(crossed["c_source"]) & (F.col("block") == F.col("c_block")))
    parts = own.groupBy("source_no", "part").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    order = W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ended = parts.withColumn("ahead", F.coalesce(F.sum("words").over(order), F.lit(0))).where("ahead <= need AND ahead + words > need")
    ended = ended.select(F.col("source_no").alias("p_source"), F.col("part").alias("cut_part"), "ahead")
    inside = own.join(_few(ended, sources), (F.col("source_no") == F.col("p_source")) & (F.col("part") == F.col("cut_part")))
    keys = inside.groupBy("source_no", "cut_part", "key").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("ahead").alias("ahead"))
    order = W.partitionBy("source_no").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    # Nearest cut: a document is drawn if its middle lies before the rest's end.
    middle = F.col("ahead") + F.coalesce(F.sum("words").over(order), F.lit(0)) + F.col("words") / 2
    judged = keys.withColumn("drawn", middle <= F.col("need"))
    return judged.groupBy("source_no", "cut_part").agg(F.max(F.when(F.col("drawn"), F.col("key"))).alias("cut_key"))


def plan_mix(narrow: DataFrame, shards: int, weights: tuple[float, ...]) -> DataFrame:
    """What becomes of each block: source, block, source_size, target, whole, drawn, cut_part, cut_key, shards.

    ``drawn`` is 0 (not), 1 (all of it) or 2 (up to the cut); ``shards`` holds the shard of each pass
    (0: the rest, 1..: whole copies), null where a pass doesn't take the block.
    """
    spark = narrow.sparkSession
    blocks = materialize(narrow.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "blocks")
    totals = blocks.groupBy("source").agg(F.sum("words").alias("size"), F.count(F.lit(1)).alias("blocks")).collect()
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = target_sizes([r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))])
    plan, counts = [], np.array([r["blocks"] for r in totals], np.int64)
    for i, (r, t) in enumerate(zip(totals, goal, strict=True)):
        whole = min(MAX_REPEATS, int(t // r["size"])) if r["size"] else 0
        plan.append((r["source"], i, int(r["size"]), float(t), whole, float(t - whole * r["size"])))
    sources = spark.createDataFrame(plan, "source string, source_no int, source_size long, target double, whole int, rest double").withColumnRenamed("source", "s_source")

    named = blocks.join(_few(sources, len(plan)), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    order = W.partitionBy("source_no").orderBy(F.xxhash64("source_no", "block", F.lit(SEED)), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = named.withColumns({"rank": (F.row_number().over(order) - 1).cast("long"), "before": before})
    # A block that begins before the rest is reached is drawn; one that goes beyond it is cut.
    drawn = F.when(F.col("before") >= F.col("rest"), 0).when(F.col("before") + F.col("words") > F.col("rest"), 2).otherwise(1)
    ranked = materialize(ranked.withColumn("drawn", drawn), "ranked")
    crossed = ranked.where("drawn = 2").select(F.col("source").alias("c_source"), F.col("block").alias("c_block"), "source_no", (F.col("rest") - F.col("before")).alias("need"))
    cuts = materialize(_cuts(narrow, materialize(crossed, "crossed"), len(plan)), "cuts")
    drawn_of = {r["source_no"]: r["n"] for r in ranked.where("drawn > 0").groupBy("source_no").agg(F.count(F.lit(1)).alias("n")).collect()}

    # Every pass has its own tree of quotas; a block's shard is where its rank falls among its source's.
    whole = np.array([p[4] for p in plan], np.int64)
    ends = []
    for turn in range(MAX_REPEATS + 1):
        own = np.where(whole >= turn, counts, 0) if turn else np.array([drawn_of.get(i, 0) for i in range(len(plan))], np.int64)
        ends.append(np.cumsum(split_quotas(own, shards, SEED + turn), axis=0))
    quotas = spark.createDataFrame([(s, [ends[t][:, s].tolist() for t in range(MAX_REPEATS + 1)]) for s in range(len(plan))], "q_source int, ends array<array<long>>")
    taken = lambda t: F.when((t == 0) & (F.col("drawn") > 0) | (t > 0) & (t <= F.col("whole")), F.size(F.filter(F.get("ends", t), lambda e: e <= F.col("rank"))))
    dealt = ranked.join(_few(quotas, len(plan)), F.col("source_no") == F.col("q_source")).join(_few(cuts.withColumnRenamed("source_no", "k_source"), len(plan)), F.col("source_no") == F.col("k_source"), "left")
    out = dealt.select(
        F.col("source").alias("d_source"), F.col("block").alias("d_block"), "source_size", "target", "whole", "drawn", "cut_part", "cut_key",
        F.transform(F.sequence(F.lit(0), F.lit(MAX_REPEATS)), taken).alias("shards"),
    )
    return materialize(out, "dealt")


def _place(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and placements (array of copy, shard, key)."""
    joined = rows.join(dealt, rows["source"].eqNullSafe(dealt["d_source"]) & (F.col("block") == F.col("d_block")))
    upto = (F.col("part") < F.col("cut_part")) | (F.col("part") == F.col("cut_part")) & F.coalesce(F.col("key") <= F.col("cut_key"), F.lit(False))
    rest = (F.col("drawn") == 1) | (F.col("drawn") == 2) & F.coalesce(upto, F.lit(False))
    copies = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(MAX_REPEATS)), lambda t: (t == 0) & rest | (t > 0) & (t <= F.col("whole"))),
        lambda t: F.struct(t.alias("copy"), F.element_at("shards", t + 1).cast("int").alias("shard"), F.xxhash64("key", t).alias("key")),
    )
    return joined.withColumn("placements", copies)


def _sized(docs: DataFrame) -> DataFrame:
    """The documents' sizes and keys, without texts."""
    return _read(docs, word_count(F.col("text")).alias("size"))


def mix_documents(docs: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, copies, placements (array of copy, shard, key), by row.

    ``placements`` holds one entry per copy; ``key`` orders a shard's documents.
    """
    narrow = materialize(_sized(docs), "sized")
    placed = _place(narrow, plan_mix(narrow, shards, weights))
    return placed.select("doc_id", "size", "source_size", "target", F.size("placements").alias("copies"), "placements")


def shard_parts(spark: SparkSession, shards: int = SHARDS) -> int:
    """Partitions of a shard: as many in all as the session shuffles to, or more."""
    return -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)


def mixed(docs: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix as rows of ``docs``: every column, one row per copy taken, shard after shard.

    A shard is ``shard_parts`` partitions in a row, each a range of keys and ordered by them;
    keys are hashes, so the ranges hold about the same number of copies.
    """
    names = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in names]).alias("__row"))
    # Texts are read again and placed by their keys, so that planning moves none of them.
    # Planning alone reads the sizes here: a few files by their volume, not one for each task that scans texts.
    narrow = materialize(_sized(docs).hint("rebalance"), "sized")
    placed = _place(_read(packed, "__row"), plan_mix(narrow, shards, weights))
    copies = placed.select(F.explode("placements").alias("__copy"), "__row")
    shard, key, parts = F.col("__copy.shard"), F.col("__copy.key"), shard_parts(docs.sparkSession, shards)
    part = F.shiftright((F.shiftright(key, 40) + (1 << 23)) * parts, 24).cast("int")
    dealt = copies.repartitionById(shards * parts, shard * parts + part)
    return dealt.sortWithinPartitions("__copy.shard", "__copy.key").select("__row.*")
