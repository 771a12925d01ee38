"""Queries do the whole job: all words, all annotations, all of a text."""

import random

import duckdb
from pyspark.sql import functions as F

from ledgerlens.functions import fuzzy
from ledgerlens.plans.aggregates import ag_question_counts
from ledgerlens.plans.catalog import load_all
from ledgerlens.plans.evaluation import ground, sc_ground_truth
from ledgerlens.plans.projections import so_batch_keys, st_intersect, st_missing_offenders, st_subset

QUERIES, ORACLES = load_all()


def put(spark, folder, **tables):
    """A folder of tables, given as DataFrames."""
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_all_words_fuse(spark, sf_dir):
    count = F.ceil(F.size(F.split("text", " ")) / 4)
    want = {r.doc_id: r.n for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", count.alias("n")).collect()}
    got = {r.doc_id: r.n for r in QUERIES["wn_fuse_rows"](spark, sf_dir).groupBy("doc_id").agg((F.max("ord") + 1).alias("n")).collect()}
    assert got == want


def naive(value, texts):
    needle, top = fuzzy.matchable(value) or "", (0.0, None, None)
    for n in range(1, min(len(needle.split()) + 2, 8) + 1 if needle else 1):
        for at in range(len(texts) - n + 1):
            found = fuzzy.matchable(" ".join(texts[at : at + n]))
            score = fuzzy.indel_ratio(needle, found) if found else 0.0
            if score > top[0]:
                top = (score, at, n)
    return top


def test_grounding_compares_all_windows(spark, tmp_path):
    rng = random.Random(5)
    pool = ["ab", "abc", "b", "", "c\nd", "É", "ﬁx", "ـ", "x", "aab", "ca", "52118", "٥٢", "é", "́a"]
    for _ in range(400):
        texts = [rng.choice(pool) for _ in range(rng.randint(1, 30))]
        value = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 3)))
        assert fuzzy.best_window(value, [fuzzy.matchable(w) or "" for w in texts]) == naive(value, texts)
    text = " ".join(["aaa"] * 4 + ["Xsecond", "third", "fourth"] + ["pad"] * 93 + ["second", "third", "fourth"])
    sf = put(spark, tmp_path, documents=spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = QUERIES["sc_fuzzy_ground"](spark, sf).first()
    assert (got.value, got.score, got.pos, got.n) == ("second third fourth", 100.0, 100, 3)
    assert ground(spark.createDataFrame([], "doc_id long, value string"), spark.createDataFrame([], "doc_id long, pos int, word string, x0 int, x1 int")).collect() == []


def test_words_with_line_breaks_are_no_shorter_windows(spark, tmp_path):
    texts = ["And erwher the. The end of it The.\nThe", "the.\nThe end the. The end of", "x the.\nThe the. The end of", "a b it. It x it.\nIt it. It"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sf = put(spark, tmp_path, documents=docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = sorted((i, at) for i, _, _, at in con.sql(ORACLES["sc_ground"]).fetchall())
    assert sorted((r.doc_id, r.pos) for r in QUERIES["sc_ground"](spark, sf).collect()) == want == [(0, 2), (1, 2), (2, 2), (3, 2)]
    assert fuzzy.best_window("c d", ["c d", "", "c", "d"], split=True) == (100.0, 2, 2)
    assert fuzzy.best_window("c d", ["x", "", "c d"], split=True) == (100.0, 2, 1)


def test_every_id_is_asked_for(spark):
    rows = [(3999, "confirmed"), (4001, "confirmed"), (28007, "rejected")]
    got = st_missing_offenders(spark.createDataFrame(rows, "id long, status string")).collect()
    assert sorted(map(tuple, got)) == [(27993, "missing", False), (28007, "not_confirmed", False), (196049, "missing", False)]


def test_keys_of_every_annotation(spark):
    fields = spark.createDataFrame([(1, "total"), (199, "late"), (200, "later"), (10**9, "last")], "annotation_id long, field_key string")
    specs = spark.createDataFrame([("total", 6), ("last", 3)], "field_key string, position int")
    assert sorted(map(tuple, so_batch_keys(fields, specs).collect())) == [("last", 3), ("late", 9), ("later", 9), ("total", 6)]


def test_whole_questions_and_answers(spark):
    opening = "What is the name of the store"
    said = [(1, 0, "user", f"{opening} at the top?"), (2, 0, "user", f"{opening}  at the Top"), (3, 0, "user", f"{opening} below?"), (3, 1, "assistant", "x")]
    talks = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    assert list(map(tuple, ag_question_counts(talks).collect())) == [(f"{opening.lower()} at the top", 2), (f"{opening.lower()} below", 1)]
    said = [(1, 0, "Acme one"), (1, 3, "Acme two"), (2, 0, " Acme one"), (2, 3, "Acme one\n"), (2, 6, "  "), (3, 1, "INV-1"), (3, 4, "INV-2")]
    talks = spark.createDataFrame(said, "conv_id long, turn long, text string")
    assert sorted(map(tuple, sc_ground_truth(talks).collect())) == [(2, "seller_name", 1), (3, "invoice_number", 2)]


def test_sets_of_whole_texts(spark, sf_dir):
    pad = [" ".join(f"{c}{i}" for i in range(50)) for c in "ab"]
    texts = {-1: f"{pad[0]} late {pad[1]} late", -2: " ".join(pad), -3: "one", -4: "", -5: "a b\na  a", -6: f"{pad[0]} {pad[0]}"}
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = given.union(spark.createDataFrame(list(texts.items()), given.schema))
    overlap, nested = set(), {}
    for r in docs.collect():
        words = r.text.split()
        a, b = set(words[: (len(words) + 1) // 2]), set(words[(len(words) + 1) // 2 :])
        if a & b:
            overlap.add(r.doc_id)
        nested[r.doc_id] = bool(a and b and (a <= b or b <= a))
    assert {r.doc_id for r in st_intersect(docs).collect()} == overlap and {i for i in overlap if i < 0} == {-1, -5, -6}
    assert {r.doc_id: r.nested for r in st_subset(docs).collect()} == nested and {i for i in texts if nested[i]} == {-5, -6}
