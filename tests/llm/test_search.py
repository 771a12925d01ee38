import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import annsearch, codesearch
from ledgerlens.llm.codesearch import CodeIndex, exact_top_k
from ledgerlens.llm.annsearch import nearest, segment_cuts, segment_radii

SCHEMA = "vec_id long, embedding array<float>, code string, k1 string"


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[ids[q]] = [(ids[i], score[i]) for i in order]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")


@pytest.mark.parametrize("small_tasks", [False, True])
def test_recall(spark, vectors, monkeypatch, small_tasks):
    if small_tasks:  # a grid of several blocks on both sides
        monkeypatch.setattr(annsearch, "BLOCK_BYTES", 4 * 64 * 150)
        monkeypatch.setattr(annsearch, "QUERY_BLOCK", 9)
    rows = vectors.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    want = exact(ids, x, [i for i in range(len(ids)) if ids[i] % 20 == 0], 20)
    got = {}
    for r in nearest(vectors, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in want[q]} & {a for a, _ in got[q]}) / 20 for q in want]) >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    for q, found in got.items():
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
        assert all(abs(s - x[place[q]] @ x[place[v]]) < 1e-12 for v, s in found)


ODD = [(i, [1.0, 0.5, 0.25]) for i in range(0, 90)] + [(90, [1.0, 0.5, 0.2]), (100, [0.0, 0.0, 0.0]), (120, None), (140, [1.0, None, 0.0]), (160, [1.0, float("nan"), 0.0]), (180, [float("inf"), 0.0, 1.0]), (200, [1.0]), (220, [-1.0, 0.2, 0.3]), (None, [1.0, 1.0, 1.0]), (3, [1.0, 0.5, 0.25])]


def odd(spark):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in ODD], SCHEMA).repartition(3)


def test_nearest_edges(spark):
    rows = nearest(odd(spark), F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 20, 40, 60, 80, 220}
    assert by[0] == list(range(1, 21)) and by[40] == list(range(20)) and len(by[220]) == 20  # ties go to smaller ids
    assert nearest(odd(spark).limit(0), F.col("vec_id") % 20 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], "", ""), (1, [0.0, 1.0], "", "")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.0)]


def test_pigeonhole_radii():
    cuts = segment_cuts(64)
    assert cuts == [(0, 16), (16, 16), (32, 16), (48, 16)]
    for r in range(65):
        radii = segment_radii(r, cuts)
        assert sum(x + 1 for x in radii) >= min(r + 1, 64)  # a code that misses every substring differs in more than r bits


def test_probing_finds_every_code_within_the_radius():
    """Brute force over all codes, for all radii."""
    rng = np.random.default_rng(8)
    for bits in (64, 37, 5):
        codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
        codes &= np.uint64((1 << bits) - 1)
        cuts = segment_cuts(bits, min(4, bits))
        for radius in (0, 1, 3, bits // 4, bits // 2, bits):
            index = annsearch.SubstringIndex(codes, cuts, segment_radii(radius, cuts))
            for q in codes[:20]:
                assert index.within(q, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q) <= radius).tolist()


def brute_codes(rows, k):
    ok = [(i, [x > 0 for x in v]) for i, v in rows if i is not None and v is not None and len(v) == 3 and None not in v and all(map(np.isfinite, v)) and any(v)]
    ok = sorted({i: c for i, c in ok}.items())
    return {(q, n, *t) for q, c in ok if q % 100 == 0 for n, t in enumerate(sorted((sum(a != b for a, b in zip(c, d, strict=True)), i) for i, d in ok if i != q)[:k], 1)}


def test_exact_codes_edges(spark, monkeypatch):
    monkeypatch.setattr(codesearch, "MIN_BLOCK", 2)
    monkeypatch.setattr(codesearch, "QUERY_BLOCK", 1)
    rows = exact_top_k(odd(spark), F.col("vec_id") % 100 == 0, 10).collect()
    assert {(r.query_id, r["rank"], r.distance, r.vec_id) for r in rows} == brute_codes(ODD, 10)
    assert exact_top_k(odd(spark).limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_incremental_search_is_exact():
    rng = np.random.default_rng(2)
    for bits, n in ((64, 500), (40, 300), (16, 50), (100, 200)):
        words = -(-bits // 64)
        signs = rng.random((n, bits)) < 0.5
        from ledgerlens.llm.vectors import pack

        codes, ids = pack(signs), rng.permutation(n)
        assert codes.shape == (n, words)
        index = CodeIndex(codes, ids, bits)
        for q in range(0, n, 37):
            distance = (signs != signs[q]).sum(axis=1)
            order = np.lexsort((ids, distance))[:12]
            got, d = index.nearest(codes[q], 12)
            assert got.tolist() == ids[order].tolist() and d.tolist() == distance[order].tolist()
