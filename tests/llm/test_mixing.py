import numpy as np

from ledgerlens.llm import mixing


def test_targets():
    assert mixing.target_sizes([10, 10, 10], [5.0, 2.0, 1.0]) == [18.75, 7.5, 3.75]
    got = mixing.target_sizes([1, 100, 100], [5.0, 2.0, 1.0])
    assert got[0] == 3 and abs(sum(got) - 201) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert mixing.target_sizes([0, 4], [5.0, 2.0]) == [0.0, 4.0] and mixing.target_sizes([], []) == []


def test_tree_splits_exactly():
    counts = np.array([100, 7, 0, 31])
    quotas = mixing.split_quotas(counts, 16)
    assert (quotas.sum(axis=0) == counts).all() and np.ptp(quotas.sum(axis=1)) <= 1 and (quotas >= 0).all()
    assert (mixing.split_quotas(counts, 16) == quotas).all()


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_documents(docs).collect()
    by_source = {r.doc_id: r.source for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(by_source)
    taken, target, longest = {}, {}, {}
    for r in rows:
        s = by_source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.copies * r.size
        target[s], longest[s] = r.target, max(longest.get(s, 0), r.size)
        assert 0 <= r.copies <= 3 and len(r.placements) == r.copies
        assert all(0 <= p.shard < 16 for p in r.placements) and len({p.copy for p in r.placements}) == r.copies
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert {r.doc_id: r.placements for r in again} == {r.doc_id: r.placements for r in rows}


def test_edges(odd_docs, no_docs):
    rows = mixing.mix_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix_documents(no_docs).collect() == [] and mixing.mixed(no_docs).collect() == []
