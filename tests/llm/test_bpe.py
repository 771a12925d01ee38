import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)
PIECES = ["a", "aa", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "中", "🙂", "'s", "'ll", "9", "²", "½", "_", "-", "$$$", "<|endoftext|>", "<|end", "́", "\x00", "İ", "ﬁ", "​", "　"]


def same(texts):
    own = bpe.load(PATH)
    for text, ids, want in zip(texts, own.encode_batch(texts), REFERENCE.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text
        assert own.decode(ids) == REFERENCE.decode(want.ids, skip_special_tokens=False) == text


def test_mixed_pieces():
    rnd = random.Random(1)
    same(["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", "a" * 5000, " " * 999])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    same([t.encode("utf-8", "ignore").decode() for t in texts])


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "FLAT_WORDS", 3)
    own = bpe.ByteBPE(PATH)
    texts = [f"word{i} other{i * 7} thing" for i in range(50)]
    for part in (texts[:25], texts[25:], texts):
        assert [x.tolist() for x in own.encode_batch(part)] == [x.ids for x in REFERENCE.encode_batch(part, add_special_tokens=False)]


def test_query_and_edges(spark, odd_docs, no_docs):
    rows = bpe.encode_documents(odd_docs, PATH, keep_ids=True).collect()
    texts = sorted((r.doc_id or -1, r.text or "") for r in odd_docs.collect())
    assert len(rows) == len(texts)
    for r, (doc, text) in zip(sorted(rows, key=lambda r: (r.doc_id or -1, r.n_tokens)), texts, strict=True):
        ids = np.array(REFERENCE.encode(text, add_special_tokens=False).ids, "<u4")
        assert (r.doc_id or -1) == doc and r.n_tokens == len(ids) and list(r.ids) == ids.tolist()
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(no_docs, PATH).collect() == []
