import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_classifiers import plain_language, plain_statistics
from test_mixing_shards import brute as brute_mix
from test_neardup import brute

from ledgerlens.llm import langid, quality
from ledgerlens.llm.queries import vocabulary_path
from ledgerlens.session import materialize, table


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


@pytest.fixture(scope="module")
def seen(spark, sf_dir):
    """Every stage's input and output."""
    docs, out = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        out[name] = before, docs
        if name != "bpe":
            assert docs.columns == before.columns
    return out


def test_quality(spark, sf_dir, seen):
    """Kept: the plain statistics' log densities, by the model's means and whitening, pass the threshold."""
    before, after = seen["quality"]
    model = quality.fit_quality_model(before, table(spark, sf_dir, "labels"))
    want = []
    for r in before.collect():
        x = np.array(plain_statistics(r.text))
        density = [-0.5 * (np.sum((model.whiten[c] @ (x - model.means[c])) ** 2) + model.log_dets[c]) for c in (0, 1)]
        if 1 / (1 + np.exp(-(model.slope * np.arcsinh(density[1] - density[0] + model.prior) + model.shift))) >= 0.3:
            want.append(r.doc_id)
    assert ids(after) == sorted(want) and 0 < len(want) < before.count()


def test_language(seen):
    before, after = seen["language"]
    model = langid.fit_language_model(before)
    found = {r.doc_id: plain_language(model, r.text) for r in before.collect()}
    assert ids(after) == sorted(i for i, (lang, score) in found.items() if lang != "und" and score >= corpus_pipeline.REJECT_LANGUAGE)


def test_neardup(seen):
    before, after = seen["neardup"]
    _, component = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert ids(after) == sorted(i for i, c in component.items() if i == c)


def test_mix(seen):
    """Every document as often as a walk through each source's documents takes it, and each row whole."""
    before, after = seen["mix"]
    want = Counter({doc: len(copies) for (doc, _), (_, copies) in brute_mix(before).items() if copies})
    rows = {r.doc_id: r for r in before.collect()}
    got = after.collect()
    assert Counter(r.doc_id for r in got) == want and all(r == rows[r.doc_id] for r in got)


def test_bpe(seen):
    from tokenizers import Tokenizer

    before, after = seen["bpe"]
    library = Tokenizer.from_file(vocabulary_path())
    texts = {r.doc_id: r.text for r in before.collect()}
    assert ids(after) == ids(before)
    for r in after.dropDuplicates(["doc_id"]).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert r.ids == want and r.n_tokens == len(want) and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_run_gives_the_last_stage(spark, sf_dir, seen):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    digests = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert digests(got) == digests(seen["bpe"][1])


def test_empty_and_odd_documents(spark, sf_dir, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert materialize(stage(spark, no_docs, sf_dir), name).collect() == []
    stage = dict(corpus_pipeline.STAGES)
    kept = {name: materialize(f(spark, odd_docs, sf_dir), name) for name, f in stage.items()}
    assert all(kept[n].columns == odd_docs.columns for n in stage if n != "bpe")
    # The labels of sf0.001 name documents 1 to 9 of these by id; repeated rows go together.
    assert Counter(ids_or_none(kept["quality"]))[9] in (0, 2)
    assert not {3, 4, 5} & set(ids_or_none(kept["language"]))
    assert Counter(ids_or_none(kept["neardup"])) == Counter([1, 3, 4, 5, 6, 7, 8, 9, 9, None])
    mix = Counter(ids_or_none(kept["mix"]))
    want = Counter({doc: n for doc, n in copies_of(odd_docs).items() if n})
    assert mix == want
    assert Counter(ids_or_none(kept["bpe"])) == Counter(ids_or_none(odd_docs))
    assert {r.doc_id: r.n_tokens for r in kept["bpe"].collect() if r.doc_id in (3, 4)} == {3: 0, 4: 0}


def ids_or_none(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def copies_of(docs):
    """Copies of each doc_id by brute force, repeated rows counted each."""
    rows = Counter(ids_or_none(docs))
    return {doc: len(copies) * rows[doc] for (doc, _), (_, copies) in brute_mix(docs).items()}
