import zlib

from ledgerlens.llm.sharding import shard_documents


def jump(key, n):
    """The published algorithm, as the brute-force version."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_matches_the_published_algorithm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = lambda r: ((r.doc_id * 6364136223846793005 % (1 << 64)) >> 32, r.doc_id, r.text_crc32, r.size)
    for per_chunk in (5, 100_000):
        rows = shard_documents(docs, 16, per_chunk).collect()
        assert len(rows) == len(texts)
        slots = {}
        for r in rows:
            assert (r.shard, r.grown_shard) == (jump(r.doc_id, 16), jump(r.doc_id, 17))
            assert r.grown_shard in (r.shard, 16)
            assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 1
            slots.setdefault(r.shard, []).append(r)
        # One law of slots at every size of chunks.
        for own in slots.values():
            assert [r.slot for r in sorted(own, key=order)] == list(range(len(own)))


def test_repeated_rows_get_a_slot_each(spark):
    docs = spark.createDataFrame([(7, "same")] * 300 + [(7, "other"), (None, None), (None, None)], "doc_id long, text string").repartition(7)
    rows = shard_documents(docs, 4, 10).collect()
    assert len(rows) == 303 and {(r.doc_id, r.shard, r.grown_shard) for r in rows} == {(7, jump(7, 4), jump(7, 5)), (None, 0, 0)}
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_negative_and_large_keys(spark):
    keys = [-1, -(2**63), 2**63 - 1, 0, 12345678901234]
    docs = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")
    assert {r.doc_id: r.shard for r in shard_documents(docs).collect()} == {k: jump(k, 16) for k in keys}


def test_edges(odd_docs, no_docs):
    rows = shard_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.law == "key" for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[3].size == 1 and by[3].text_crc32 is None and by[None].shard == jump(0, 16)
    assert shard_documents(no_docs).collect() == []


def test_native_plan(odd_docs):
    plan = shard_documents(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_writes_no_table_in_between(spark, odd_docs, tmp_path, monkeypatch):
    """Chunk counts need the ids alone, so executors make no files but the result's."""
    monkeypatch.setattr("ledgerlens.session.shared_root", lambda _: f"file://{tmp_path}")
    assert len(shard_documents(odd_docs, 16, 2).collect()) == odd_docs.count()
    assert list(tmp_path.iterdir()) == []


def test_oracles_agree(spark, sf_dir):
    """The queries that SQL can express equal DuckDB's answer."""
    import duckdb

    from ledgerlens.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert set(ORACLES) <= set(QUERIES)
    for name, sql in ORACLES.items():
        relation = con.sql(sql)
        rows = QUERIES[name](spark, sf_dir).select(*relation.columns).collect()
        assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, relation.fetchall())), name
