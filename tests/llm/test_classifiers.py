import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex

from ledgerlens.llm import langid, quality


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def train_texts(texts, langs):
    return langid.train([langid.bag_of(np.frombuffer(t.encode(), np.uint8)) for t in texts], langs)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_held_out_accuracy(docs):
    rows = langid.identify(docs, langid.fit_language_model(docs)).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.97


def test_quality_held_out(docs, labels):
    rows = quality.score_documents(docs, quality.fit_quality_model(docs, labels)).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.95
    good, bad = [r.score for r in own if truth[r.doc_id]], [r.score for r in own if not truth[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_scores_do_not_depend_on_the_slices(monkeypatch):
    column = pa.array(["The cat sat. " * n for n in (1, 50, 3)] + ["", None, "A!! B!! C!!"])
    whole = quality.text_statistics(column)
    for at in range(len(column)):
        assert np.allclose(quality.text_statistics(column.slice(at, 1)), whole[at : at + 1])
    model = train_texts(["the cat and the dog", "der hund und die katze"] * 12, ["en", "de"] * 12)
    a, b = langid.predict_arrays(model, column), [langid.predict_arrays(model, column.slice(i, 1)) for i in range(len(column))]
    assert a[0] == [x[0][0] for x in b] and np.allclose(a[1], [x[1][0] for x in b])
    assert a[0][3:5] == ["und", "und"]


def plain_language(model, text):
    """Brute force: n-gram by n-gram, embedding by embedding."""
    if not regex.search(r"\p{L}", text or ""):
        return "und", 0.0
    folded = bytearray()
    for b in text.encode():
        c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if c != 32 or not folded or folded[-1] != 32:
            folded.append(c)
    buckets = []
    for at in range(len(folded)):
        if at + 3 <= len(folded):
            buckets.append((int.from_bytes(folded[at : at + 3], "little") * 2654435761 & 0xFFFFFFFF) >> 18)
        if at + 4 <= len(folded):
            buckets.append(((int.from_bytes(folded[at : at + 4], "little") ^ 0x5BD1E995) * 2246822519 & 0xFFFFFFFF) >> 18)
    mean = sum((model.table[b].astype(float) for b in buckets), np.zeros(model.table.shape[1])) / max(1, len(buckets))
    z = ((mean if model.out is None else mean @ model.out) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_language_against_brute_force(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_language_model(docs)
    for df in (docs, odd_docs.where("doc_id <> 8")):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in langid.identify(df, model).collect():
            lang, score = plain_language(model, texts[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-5


def test_the_language_sample_is_that_of_the_labelled_rows(spark, sf_dir):
    """Training on all bags made here of the rows that may be read gives the same model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_language_model(docs, per_language=10**6)
    from pyspark.sql import functions as F

    rows = [r for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect() if not held_out(r.doc_id)]
    again = train_texts([r.text for r in rows], [r.lang for r in rows])
    assert model.languages == again.languages and np.allclose(model.table, again.table) and model.temperature == again.temperature


def plain_statistics(text):
    """Brute force of the fourteen statistics, character by character."""
    data = (text or "").encode()
    words = data.split()
    kinds = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "mark": b",.;:?'-\""}
    low = sum(b in kinds["lower"] or b >= 128 for b in data)
    up, digit, mark = (sum(b in kinds[k] for b in data) for k in ("upper", "digit", "mark"))
    is_symbol = lambda b: 33 <= b < 127 and not any(b in r for r in kinds.values())
    symbol, lines, size, n = sum(map(is_symbol, data)), data.count(b"\n"), len(data), len(words)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / max(1, n)
    spread = max(0.0, sum(s * s for s in sizes) / max(1, n) - mean * mean) ** 0.5
    logit = lambda part, whole: np.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    repeats, distinct = sum(a == b for a, b in zip(words, words[1:])), len(set(words))
    ends, lone = sum(is_symbol(w[-1]) for w in words), sum(len(w) == 1 and is_symbol(w[0]) for w in words)
    return [
        np.log1p(size), np.log1p(n), np.log1p(mean), np.log1p(spread), logit(up, up + low), logit(digit, size), logit(mark, size), logit(symbol, size),
        logit(lines, n), logit(ends, n), logit(lone, n), logit(repeats, n), np.log((distinct + 1) / (n + 1)), np.log((distinct + 1) / (n + 1) ** 0.8),
    ]


def plain_discriminant(x, y, points):
    """Brute force: densities from the covariance matrices themselves."""
    pooled = sum((v - x[y == c].mean(axis=0))[:, None] * (v - x[y == c].mean(axis=0)) for v, c in zip(x, y, strict=True)) / len(x) + 1e-4 * np.eye(x.shape[1])
    logs = []
    for c in (0, 1):
        own = x[y == c]
        cov = (1 - quality.TO_POOLED) * np.cov(own.T, bias=True) + quality.TO_POOLED * pooled
        cov = (1 - quality.TO_DIAGONAL) * cov + quality.TO_DIAGONAL * np.diag(np.diag(cov)) + 1e-4 * np.eye(x.shape[1])
        d = points - own.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((y == c).mean()))
    return logs[1] - logs[0]


def test_quality_against_brute_force(spark, docs, labels):
    """All rows: plain statistics, covariances fitted on the labelled folds, calibration as fitted."""
    model = quality.fit_quality_model(docs, labels, sample=10**6)
    texts, truth = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    ids = sorted(texts)
    points = np.array([plain_statistics(texts[i]) for i in ids])
    learn = [k for k, i in enumerate(ids) if i in truth and not held_out(i)]
    raw = plain_discriminant(points[learn], np.array([truth[ids[k]] for k in learn]), points)
    want = 1 / (1 + np.exp(-(model.slope * np.arcsinh(raw) + model.shift)))
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-6)


def test_language_edges(spark, odd_docs, no_docs):
    model = langid.fit_language_model(odd_docs)
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    pred = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert all(pred[i] == ("und", 0.0) for i in (3, 4, 5))
    kept = langid.accepted(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert langid.fit_language_model(no_docs) is None and langid.identify(no_docs, None).collect() == []
    assert {r.lang_pred for r in langid.identify(odd_docs, None).collect()} == {"und"}


def test_quality_edges(spark, odd_docs, no_docs):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    rows = quality.score_documents(odd_docs, quality.fit_quality_model(odd_docs, none)).collect()
    assert len(rows) == odd_docs.count() and {r.score for r in rows} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in (1, 1, 2, 5, 6, 7, 8, 9)] + [(None, 1, 0), (3, None, 0)], schema)
    model = quality.fit_quality_model(odd_docs, some)
    rows = quality.score_documents(odd_docs, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == odd_docs.count()
    assert quality.accepted(odd_docs, model).columns == odd_docs.columns
    assert quality.score_documents(no_docs, quality.fit_quality_model(no_docs, some)).collect() == []


def test_discriminant_separates_shifted_covariances():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(400, 4)) * 0.3, rng.normal(size=(400, 4)) * 3])
    y = np.repeat([1, 0], 400)
    assert ((quality.train(x, y).scores(x) >= 0.5) == y).mean() > 0.9
