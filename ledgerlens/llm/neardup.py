"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation.

1. One scan makes each text's shingle set: its size, a 128-bit signature, MinHash
   band keys and an odd sketch (the MinHash samples folded into a parity bitmap).
   Equal sets form a class; its smallest doc_id stands for it from here on.
2. Representatives that share a band key meet in a bucket. There the XOR population
   count of two odd sketches estimates their similarity; those well below the
   threshold are dropped. A bucket gives a star per connected piece, not its pairs.
3. The stars' components are the only groups whose full sets are compared. Each
   group is explored breadth first with exact intersections, so it gives a tree of
   true links; large groups are compared block against block.
4. Components of the true links, joined back to all rows.

Buckets beyond ``BUCKET_ROWS`` and groups beyond ``GROUP_ROWS`` rows or
``GROUP_SHINGLES`` shingles are split in blocks; every pair of blocks is a unit of
work of its own, so no task holds an unbounded group and no pair is left out.

A link needs ``100 * intersection >= percent * union`` on 64-bit hashes of shingles.
With 25 bands of 5 rows a pair of similarity 0.8 misses every band with probability
5e-5 (0.85: 4e-7), and the sketch cut lies over four standard deviations below 0.8.

Edge cases: null or blank texts have an empty set and link with nothing. With
fewer words than a shingle has, the whole sequence is the only shingle. A null
doc_id links with nothing, has a null component and is kept. Rows that repeat a
doc_id count as versions of one document. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrowgroups import group_heads, whole_groups
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.textscan import LOWER, byte_view, mix64, slices, span_hashes, word_bounds
from ledgerlens.session import arrow_pass, materialize

BANDS, ROWS = 25, 5
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, and the largest XOR population count that is still a candidate
#: (an estimated similarity of 0.57).
SKETCH_BITS, MAX_XOR = 256, 74
BUCKET_ROWS, GROUP_ROWS, GROUP_SHINGLES = 8192, 1024, 1_000_000

_rng = np.random.default_rng(20)
_MULT = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_COMBINE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, and their offsets."""
    lower = LOWER[data]
    starts, ends, offs = word_bounds(lower, offsets)
    words = span_hashes(lower, starts, ends)
    n = np.diff(offs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.append(0, np.cumsum(count))
    acc = np.zeros(len(words), np.uint64)
    for j in range(k):  # window sums over the flat words; windows across texts are left out below
        acc[: len(words) - j] += words[j:] * _COMBINE[j]
    long_text = np.repeat(n >= k, n)
    place = np.arange(len(words)) - np.repeat(offs[:-1], n)
    inside = long_text & (place + k <= np.repeat(n, n))
    hashes = np.empty(out[-1], np.uint64)
    target = np.repeat(out[:-1], n) + place
    hashes[target[inside]] = mix64(acc[inside])
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = words[offs[i] : offs[i + 1]]
        hashes[out[i]] = mix64((own * _COMBINE[: len(own)]).sum(keepdims=True) + np.full(1, len(own), np.uint64) * _COMBINE[63:])[0]
    for i in np.flatnonzero(count > 1):
        hashes[out[i] : out[i + 1]].sort()
    if len(hashes):
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        fresh[out[:-1][count > 0]] = True
        kept = np.append(0, np.cumsum(fresh))
        hashes, out = hashes[fresh], kept[out]
    return hashes, out


def sketches(hashes: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Signatures, band keys and odd sketches of the non-empty sets."""
    heads = offs[:-1]
    n = len(heads)
    sig1, sig2 = np.add.reduceat(mix64(hashes), heads), np.add.reduceat(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), heads)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((SAMPLES, n), np.uint32)
    for i in range(SAMPLES):
        least[i] = np.minimum.reduceat((short ^ _FLIP[i]) * _MULT[i], heads)
    tagged = mix64(least.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64)[:, None] << np.uint64(32)))
    bit = (tagged >> np.uint64(56)).astype(np.int64) % SKETCH_BITS
    parity = (np.bincount((np.arange(n) * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    odd = np.packbits(parity.reshape(n, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)
    bands = np.zeros((BANDS, n), np.uint64)
    for r in range(ROWS):
        bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + tagged[r::ROWS])
    return {"sig1": sig1, "sig2": sig2, "bands": bands.T.copy(), "odd": odd}


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            for lo, hi in slices(offsets):
                hashes, offs = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
                size = np.diff(offs)
                full = size > 0
                n = hi - lo
                sig = np.zeros((2, n), np.int64)
                bands = np.zeros((n, BANDS), np.int64)
                odd = np.zeros((n, SKETCH_BITS // 64), np.int64)
                if full.any():
                    got = sketches(hashes, np.append(offs[:-1][full], offs[-1]))
                    sig[0, full], sig[1, full] = got["sig1"].view(np.int64), got["sig2"].view(np.int64)
                    bands[full], odd[full] = got["bands"].view(np.int64), got["odd"].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, n),
                        pa.array(size, pa.int64()),
                        pa.array(sig[0]),
                        pa.array(sig[1]),
                        pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64())),
                        pa.FixedSizeListArray.from_arrays(pa.array(odd.ravel()), SKETCH_BITS // 64).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "sig1", "sig2", "bands", "odd"],
                )

    return run


def sketch_stars(ids: np.ndarray, odd: np.ndarray) -> list[tuple[int, int]]:
    """(smallest id, id) edges of the pieces connected by close odd sketches.

    Breadth first: a visited row is compared with the rows not yet visited, so dense
    groups cost about one pass and only unrelated rows cost all pairs (of 32 bytes).
    """
    order = np.argsort(ids, kind="stable")
    ids, odd = ids[order], odd[order]
    rest = np.arange(len(ids))
    out: list[tuple[int, int]] = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(odd[rest] ^ odd[at]).sum(axis=1, dtype=np.int64) <= MAX_XOR
            if near.any():
                found = rest[near]
                rest = rest[~near]
                out += [(int(ids[root]), int(ids[j])) for j in found]
                queue += found.tolist()
    return out


def _bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["key", "unit"]
    for table in whole_groups(batches, keys):
        heads = group_heads(table, keys)
        sizes = np.diff(heads)
        if (sizes < 2).all():
            continue
        ids = table.column("doc_id").to_numpy()
        odd = np.stack([table.column(f"o{j}").to_numpy() for j in range(SKETCH_BITS // 64)], axis=1).view(np.uint64)
        edges: list[tuple[int, int]] = []
        pair = heads[:-1][sizes == 2]  # most buckets: both sketches are compared at once
        close = np.bitwise_count(odd[pair] ^ odd[pair + 1]).sum(axis=1, dtype=np.int64) <= MAX_XOR
        a, b = ids[pair[close]], ids[pair[close] + 1]
        for i in np.flatnonzero(sizes > 2):
            edges += sketch_stars(ids[heads[i] : heads[i + 1]], odd[heads[i] : heads[i + 1]])
        src = np.concatenate([np.minimum(a, b), np.array([e[0] for e in edges], np.int64)])
        dst = np.concatenate([np.maximum(a, b), np.array([e[1] for e in edges], np.int64)])
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def exact_stars(ids: np.ndarray, hashes: np.ndarray, offs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(smallest id, id) edges of the pieces connected by true links."""
    out: list[tuple[int, int]] = []
    values, inverse = np.unique(hashes, return_inverse=True)
    mark = np.zeros(len(values), np.int64)
    order = np.argsort(ids, kind="stable")
    size = np.diff(offs)
    rest = order[size[order] > 0]
    flat = np.concatenate([inverse[offs[i] : offs[i + 1]] for i in rest]) if len(rest) else inverse[:0]
    while len(rest) > 1:
        root = rest[0]
        flat, rest = flat[size[root] :], rest[1:]
        queue = [root]
        while queue and len(rest):
            at = queue.pop()
            own = inverse[offs[at] : offs[at + 1]]
            mark[own] = 1
            heads = np.append(0, np.cumsum(size[rest])[:-1])
            shared = np.add.reduceat(mark[flat], heads)
            mark[own] = 0
            linked = 100 * shared >= percent * (size[at] + size[rest] - shared)
            if linked.any():
                out += [(int(ids[root]), int(ids[j])) for j in rest[linked]]
                queue += rest[linked].tolist()
                flat = flat[np.repeat(~linked, size[rest])]
                rest = rest[~linked]
    return out


def _group_stars(k: int, percent: int):
    keys = ["group", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            heads = group_heads(table, keys)
            ids = table.column("doc_id").to_numpy()
            edges: list[tuple[int, int]] = []
            texts = table.column("text")
            for lo, hi in zip(heads[:-1], heads[1:], strict=True):
                if hi - lo > 1:
                    data, offsets = byte_view(texts.slice(lo, hi - lo))
                    hashes, sizes = [], [np.zeros(1, np.int64)]
                    for a, b in slices(offsets, 1 << 22):
                        h, o = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                        hashes.append(h)
                        sizes.append(np.diff(o))
                    edges += exact_stars(ids[lo:hi], np.concatenate(hashes), np.cumsum(np.concatenate(sizes)), percent)
            if edges:
                src, dst = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _units(blocks, own):
    """Every unit (pair of blocks) that a row of block ``own`` belongs to; unit 0 where one block suffices."""
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    return F.when(blocks <= 1, F.array(F.lit(0).cast("long"))).otherwise(pairs)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    list_schema = "doc_id long, n_shingles long, sig1 long, sig2 long, bands array<long>, odd array<long>"
    scanned = materialize(arrow_pass(texts, _scan(k), list_schema), "shingles")

    # Classes of equal sets; from here on one representative each.
    usable = scanned.where("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "bands", "odd", "n_shingles")).alias("first")
    classes = materialize(
        usable.groupBy("sig1", "sig2").agg(first, F.count(F.lit(1)).alias("rows")).select("sig1", "sig2", "first.*", "rows"), "classes"
    )

    # Buckets of one band key.
    words = [F.col("odd")[j].alias(f"o{j}") for j in range(SKETCH_BITS // 64)]
    banded = classes.select("doc_id", *words, F.explode("bands").alias("key"))
    crowded = (
        classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BUCKET_ROWS)
        .select("key", F.ceil(F.col("rows") / (BUCKET_ROWS // 2)).cast("long").alias("blocks"))
    )
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        units = banded.withColumn("unit", F.lit(0).cast("long"))
    else:
        blocks = F.coalesce("blocks", F.lit(1).cast("long"))
        units = banded.join(crowded, "key", "left").withColumn("unit", F.explode(_units(blocks, F.pmod(F.xxhash64("doc_id"), blocks)))).drop("blocks")
    stars = (
        units.repartition("key", "unit").sortWithinPartitions("key", "unit").mapInArrow(_bucket_stars, "src long, dst long").distinct()
    )
    coarse = materialize(connected_components(stars), "candidates")

    # Exact links inside the candidates' groups.
    sized = coarse.join(classes.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    groups = (
        sized.groupBy(F.col("root").alias("group"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("shingles"))
        .select(
            "group",
            F.when((F.col("rows") <= GROUP_ROWS) & (F.col("shingles") <= GROUP_SHINGLES), 1)
            .otherwise(F.greatest(F.ceil(F.col("rows") / (GROUP_ROWS // 2)), F.ceil(F.col("shingles") / (GROUP_SHINGLES // 2))))
            .cast("long")
            .alias("blocks"),
        )
    )
    member = coarse.select(F.col("node").alias("doc_id"), F.col("root").alias("group")).join(groups, "group")
    member = materialize(
        member.select("doc_id", "group", F.explode(_units(F.col("blocks"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")))).alias("unit")), "members"
    )
    links = (
        texts.join(member, "doc_id")
        .select("group", "unit", "doc_id", "text")
        .repartition("group", "unit")
        .sortWithinPartitions("group", "unit")
        .mapInArrow(_group_stars(k, percent), "src long, dst long")
    )
    exact = connected_components(links)

    # Row -> class -> component.
    placed = classes.select("sig1", "sig2", F.col("doc_id").alias("node")).join(exact, "node", "left")
    placed = placed.select("sig1", "sig2", F.coalesce("root", "node").alias("component"))
    rows = scanned.select("doc_id", "n_shingles", "sig1", "sig2")
    full = rows.where("n_shingles > 0 and doc_id is not null").join(placed, ["sig1", "sig2"])
    empty = rows.where("n_shingles = 0 or doc_id is null").withColumn("component", F.col("doc_id"))
    both = full.select("doc_id", "n_shingles", "component").unionByName(empty.select("doc_id", "n_shingles", "component"))
    return both.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, that stay: one document of each component."""
    gone = near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
