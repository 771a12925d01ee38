"""The queries of the ten operators, each over its whole table.

``QUERIES`` maps a name to a callable of (spark, sf_dir); ``ORACLES`` holds DuckDB
SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The vocabulary that the encoding query and the pipeline use.
VOCABULARY = "byte_bpe_50k.json"


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query("op1_html_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.htmltext import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@query("op2_jump_hash_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@query("op3_multi_index_hashing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from ledgerlens.llm.annsearch import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op4_odd_sketch_neardup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.langid import fit_language_model, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_language_model(docs))


@query("op6_exact_code_search")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from ledgerlens.llm.codesearch import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op7_hypergeometric_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.mixing import mix_documents

    mix = mix_documents(table(spark, sf_dir, "documents"))
    taken = (mix["copies"] * mix["size"]).cast("long").alias("taken")
    # One entry per copy, in the same order.
    shard, key = (mix[f"placements.{c}"].alias(c) for c in ("shard", "key"))
    return mix.select("doc_id", "size", "source_size", "target", taken, shard, key)


@query("op8_quality_qda")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.quality import fit_quality_model, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_quality_model(docs, table(spark, sf_dir, "labels")))


@query("op9_warc_capture_index")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


ORACLES["op9_warc_capture_index"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p
), m AS (
  SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id <> m.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id <> m.last THEN m.last END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""

ORACLES["op6_exact_code_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

#: Shards by the published walk in wide integers, checksums by the usual table (reversed polynomial 0xEDB88320).
ORACLES["op2_jump_hash_sharding"] = """
WITH RECURSIVE walk(doc_id, key, pos, shard, grown) AS (
  SELECT DISTINCT doc_id, CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM documents
  UNION ALL
  SELECT doc_id, key, jump, CASE WHEN jump < 16 THEN jump ELSE shard END, CASE WHEN jump < 17 THEN jump ELSE grown END FROM (
    SELECT doc_id, key, shard, grown, floor((pos + 1)::DOUBLE * (2147483648.0::DOUBLE / ((key // 8589934592)::BIGINT + 1)::DOUBLE))::BIGINT AS jump FROM (
      SELECT doc_id, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key, pos, shard, grown FROM walk WHERE pos < 17) a) b
), placed AS (
  SELECT doc_id, shard::INTEGER AS shard, grown::INTEGER AS grown_shard,
    (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END * 6364136223846793005) % 18446744073709551616 // 4294967296 AS place FROM walk WHERE pos >= 17
), crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, n) AS c FROM range(256) r(n)) x
), hexed AS (
  SELECT doc_id, text, hex(encode(text)) AS h, octet_length(encode(text)) AS bytes FROM documents
), sized AS (
  SELECT doc_id, coalesce(bytes, 0)::BIGINT + 1 AS size, CASE WHEN text IS NOT NULL THEN xor(4294967295::BIGINT, list_reduce(
    list_transform(regexp_extract_all(h, '..'), lambda p: (strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT)) END AS text_crc32 FROM hexed, crc_table
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, p.shard, row_number() OVER (PARTITION BY p.shard ORDER BY p.place, s.doc_id, s.text_crc32, s.size) - 1 AS slot, p.grown_shard
FROM sized s JOIN placed p ON p.doc_id = s.doc_id
"""

#: All pairs that share a shingle, and what is reachable over the links.
ORACLES["op4_odd_sketch_neardup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(generate_series(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT c.a, c.b FROM common c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= 80 * (x.n + y.n - c.k)
), reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (
  SELECT id, min(other) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least m ON m.id = d.doc_id
"""
