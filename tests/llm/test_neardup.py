import random
import re

import numpy as np
import pytest

from ledgerlens.llm import neardup
from ledgerlens.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    """(size by id, smallest id of its component by id), over all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: len(s) for i, s in sets}, {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("limits", [None, (4, 4, 500)])
def test_whole_table(spark, sf_dir, monkeypatch, limits):
    if limits:  # every bucket and group is split in blocks
        for name, v in zip(("BUCKET_ROWS", "GROUP_ROWS", "GROUP_SHINGLES"), limits, strict=True):
            monkeypatch.setattr(neardup, name, v)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size, comp = brute([(r.doc_id, r.text) for r in docs.collect()], 4, 80)
    rows = neardup.near_duplicates(docs, 4, 80).collect()
    assert {r.doc_id: r.n_shingles for r in rows} == size and {r.doc_id: r.component_id for r in rows} == comp
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chains_and_large_groups(spark):
    """A chain whose ends aren't alike, a dense group, and texts that share a passage only."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows, words = [], list(base)
    for i in range(40):  # each step changes one more word
        rows.append((i, " ".join(words)))
        words[rnd.randrange(60)] = f"c{i}"
    other = [f"q{i}" for i in range(80)]
    for i in range(60):
        w = list(other)
        w[i] = "Z"
        rows.append((100 + i, " ".join(w).upper() if i % 2 else " ".join(w)))
    passage = [f"p{i}" for i in range(30)]
    rows += [(300 + i, " ".join(passage + [f"u{i}x{j}" for j in range(30)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    size, comp = brute(rows, 4, 80)
    got = neardup.near_duplicates(docs, 4, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == comp and {r.doc_id: r.n_shingles for r in got} == size


def test_edges(spark, odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs, 4, 80).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (3, 4, 5))
    assert by[6].n_shingles == 1 and by[8].n_shingles == 9 and by[None].component_id is None and by[None].kept
    kept = neardup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, 9, None}
    assert neardup.near_duplicates(no_docs).collect() == [] and neardup.deduplicated(no_docs).collect() == []


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0, 50, 111, 250):  # replaced members: similarity (1000 - n) / (1000 + n)
        b = a.copy()
        b[:share] = rng.integers(0, 1 << 63, share, dtype=np.uint64)
        both = [np.sort(a), np.sort(b)]
        odd = neardup.sketches(np.concatenate(both), np.array([0, 1000, 2000]))["odd"]
        differ = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
        n, k = neardup.SKETCH_BITS, neardup.SAMPLES
        estimate = 1 + n / (4 * k) * np.log(1 - 2 * differ / n)
        assert abs(estimate - (1000 - share) / (1000 + share)) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 105), (105, 103), (200, 200), (None, 3)] + [(300, 300 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 103: 100, 105: 100} | {i: 300 for i in range(300, 340)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
