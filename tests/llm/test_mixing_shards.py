import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing
from ledgerlens.llm.queries import QUERIES
from ledgerlens.session import materialize, table

SF = "/root/testdata/sf0.01"


def brute(docs, shards=mixing.SHARDS):
    """{(doc_id, key): (target, [(copy, shard)])} by walking each source's documents in order, row by row."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(mixing.SEED), "text")
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64(key, F.lit(mixing.SEED)).alias("spot")).collect()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in rows if r.source == s) for s in names]
    targets = mixing.target_sizes(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    spark = docs.sparkSession
    pairs = spark.range(len(names) * mixing.BLOCKS).select(F.expr(f"cast(id div {mixing.BLOCKS} as int)").alias("s"), F.expr(f"cast(id % {mixing.BLOCKS} as int)").alias("b"))
    turn_of = {(r.s, r.b): (r.h, r.b) for r in pairs.withColumn("h", F.xxhash64("s", "b", F.lit(mixing.SEED))).collect()}
    block = lambda r: r.spot & (mixing.BLOCKS - 1)
    ordered, ranks, drawn, whole = [], [], [], []
    for i, s in enumerate(names):
        own = sorted((r for r in rows if r.source == s), key=lambda r: (turn_of[i, block(r)], (r.spot >> 20) & (mixing.BLOCKS - 1), r.key))
        ranks.append({b: n for n, b in enumerate(dict.fromkeys(block(r) for r in own))})
        whole.append(min(3, int(targets[i] // sizes[i])) if sizes[i] else 0)
        rest, at, took, blocks = targets[i] - whole[i] * sizes[i], 0, set(), set()
        begin = {}
        for r in own:
            begin.setdefault(block(r), at)
            if begin[block(r)] < rest:
                blocks.add(block(r))
                end = begin[block(r)] + sum(x["size"] for x in own if block(x) == block(r))
                if end <= rest or at + r["size"] / 2 <= rest and at <= rest:
                    took.add((r.doc_id, r.key))
            at += r["size"]
        ordered.append(own)
        drawn.append((took, blocks))
    ends = []
    for t in range(4):
        counts = np.array([len(drawn[i][1]) if t == 0 else len(ranks[i]) * (t <= whole[i]) for i in range(len(names))])
        ends.append(np.cumsum(mixing.split_quotas(counts, shards, mixing.SEED + t), axis=0))
    out = {}
    for i in range(len(names)):
        for r in ordered[i]:
            shard = lambda t, i=i, r=r: int((ends[t][:, i] <= ranks[i][block(r)]).sum())
            copies = [(0, shard(0))] if (r.doc_id, r.key) in drawn[i][0] else []
            out[r.doc_id, r.key] = (targets[i], copies + [(t, shard(t)) for t in range(1, whole[i] + 1)])
    return out


@pytest.mark.parametrize("blocks", [mixing.BLOCKS, 4])
def test_plan_against_brute_force(spark, monkeypatch, blocks):
    """With four blocks, whole blocks are cut inside, through parts and keys."""
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    docs = table(spark, SF, "documents").select("doc_id", "source", "text")
    odd = [(-1, None, "a b c"), (-2, None, None), (-3, None, "d"), (-4, "empty", " \n"), (-5, "empty", None), (-6, "zz", "x " * 5000)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, source string, text string"))
    want = brute(docs)
    key = F.xxhash64(F.col("doc_id").cast("long"), F.lit(mixing.SEED), "text")
    keys = {r.doc_id: r.key for r in docs.select("doc_id", key.alias("key")).collect()}
    got = {(r.doc_id, keys[r.doc_id]): (r.target, [(p.copy, p.shard) for p in r.placements]) for r in mixing.mix_documents(docs).collect()}
    assert got.keys() == want.keys() and {k for k in got if got[k] != want[k]} == set()


def test_quotas_decide_the_result(spark, monkeypatch):
    """op7's shards are the tree's: other quotas, other shards."""
    rows = QUERIES["op7_hypergeometric_mixing"](spark, SF).collect()
    assert all(len(r.shard) == len(r.key) and (len(r.shard) * r.size == r.taken or r.size == 0) for r in rows)
    assert len({s for r in rows for s in r.shard}) == mixing.SHARDS
    monkeypatch.setattr(mixing, "split_quotas", lambda counts, shards, seed=0: np.zeros((shards, len(counts)), np.int64))
    changed = QUERIES["op7_hypergeometric_mixing"](spark, SF).collect()
    assert {s for r in changed for s in r.shard} == {mixing.SHARDS}


def test_mix_is_written_by_shard_and_key(spark, tmp_path):
    docs = table(spark, SF, "documents")
    want = sorted((p.shard, p.key, r.doc_id) for r in mixing.mix_documents(docs).collect() for p in r.placements)
    for n in (4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            mixing.mixed(docs).write.parquet(str(tmp_path / str(n)))
            parts = mixing.shard_parts(spark)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        got = []
        for path in sorted((tmp_path / str(n)).glob("part-*.parquet")):
            at = int(path.name.split("-")[1])
            got += [(at // parts, r.doc_id) for r in spark.read.parquet(str(path)).coalesce(1).collect()]
        assert got == [(shard, doc) for shard, _, doc in want]


def test_sizes_are_written_by_volume(spark, monkeypatch):
    """However many tasks scan texts, planning a small mix writes a few files, and every document counts."""
    written = {}

    def noted(df, name):
        written[name] = materialize(df, name)
        return written[name]

    monkeypatch.setattr(mixing, "materialize", noted)
    docs = table(spark, SF, "documents").repartition(24)
    mixing.mixed(docs)
    assert written["sized"].count() == docs.count()
    assert {name: n for name, df in written.items() if (n := len(df.inputFiles())) > 8} == {}
