import random

import pytest

from ledgerlens.llm import langid


@pytest.mark.parametrize("most", [langid.MAX_TEXTS, 140])
def test_all_languages_are_learned(spark, monkeypatch, most):
    """Eighty languages, the last ten rare: more than 64, and at 140 texts about one of each."""
    monkeypatch.setattr(langid, "MAX_TEXTS", most)
    drawn = []
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda texts, langs: drawn.extend(langs) or train(texts, langs))
    rng = random.Random(3)
    rows = []
    for i in range(80):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)]
        rows += [(len(rows) + j, " ".join(rng.choices(words, k=40)), f"l{i:02}") for j in range(40 if i < 70 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language_model(docs)
    assert model.languages == [f"l{i:02}" for i in range(80)]
    if most == 140:
        assert max(map(drawn.count, drawn)) <= 2
    else:
        got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
        right = [got[i] == lang for i, _, lang in rows]
        assert sum(right) >= 0.95 * len(rows) and sum(right[-80:]) >= 72
