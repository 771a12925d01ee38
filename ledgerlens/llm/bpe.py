"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The words of a slice of texts are pre-split by the vocabulary's pattern and each
distinct new word is encoded once: the byte symbols of many words lie in one flat
array; every round looks up all neighbouring pairs by binary search over the
sorted pair keys, finds each word's lowest rank, merges its occurrences from left
to right, and goes on until no word has a known pair. Known words come from a
bounded per-worker cache (emptied when full, never a cap on what is encoded).

Edge cases: a null or empty text has no ids and decodes to the empty text;
added special tokens in a text become their own id; any Unicode text encodes, whole at
any length. Repeated rows are encoded each, a null doc_id is kept. An empty table gives
an empty result. Other columns are ignored. Of equal ranks in a word the leftmost pair merges first.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerlens.session import arrow_pass

#: Fixed value: the byte-level pre-splitting pattern of the public vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern over Latin-1 texts, whose letters, numbers and spaces can be spelt out; the plain engine is faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \\t\\n\\r\\f\\v\\x85\\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
NO_RANK = np.int64(1 << 40)
#: Words a worker remembers before it starts anew.
CACHE_WORDS = 500_000
#: New words of a text slice that are encoded in one flat array.
FLAT_WORDS = 20_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes, by the published rule: visible Latin-1
    characters stand for themselves, the others for 256, 257, ... in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


_split_any, _split_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall


def split_words(text: str) -> list[str]:
    """A text's words by the vocabulary's pattern."""
    if text.isascii():
        return _split_latin(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _split_any(text)
    return _split_latin(text)


class ByteBPE:
    """A vocabulary of a ``tokenizers`` JSON file with a plain ByteLevel BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        alphabet = byte_alphabet()
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.base = np.int64(size)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        # A pair listed twice keeps its first, lowest rank.
        keep = np.ones(len(keys), bool)
        keep[1:] = keys[order][1:] != keys[order][:-1]
        order = order[keep]
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Ids of known words as packed bytes: a fifth of the memory of tuples, and texts are joins of them.
        self.packed = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, rank) of the pairs that begin at ``where``; unknown ones and word ends rank last."""
        pair = symbols[where] * self.base + symbols[where + 1]
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        known = (self.keys[at] == pair) & (word[where] == word[where + 1])
        return at, np.where(known, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word, by merge rounds over one flat array of symbols.

        A pair is looked up when it comes into being: all of them at first, later
        those on either side of a merged symbol.
        """
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), sizes)
        at, rank = np.zeros(len(symbols), np.int64), np.full(len(symbols), NO_RANK)
        if len(symbols) > 1:
            at[:-1], rank[:-1] = self._pairs(symbols, word, np.arange(len(symbols) - 1))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, heads)
            spans = np.diff(np.append(heads, len(symbols)))
            open_ = lowest < NO_RANK
            if not open_.all():  # words without a known pair leave the flat array
                live = np.repeat(open_, spans)
                done.append((word[~live], symbols[~live]))
                if not open_.any():
                    break
                at, rank, symbols, word = at[live], rank[live], symbols[live], word[live]
                spans, lowest = spans[open_], lowest[open_]
            # Overlapping hits (as in "aaa") merge from the left: every second of a run.
            where = np.flatnonzero(rank == np.repeat(lowest, spans))
            run = np.append(True, np.diff(where) > 1)
            order = np.arange(len(where))
            where = where[(order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0]
            symbols[where] = self.made[at[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, word, at, rank = symbols[keep], word[keep], at[keep], rank[keep]
            merged = where - np.arange(len(where))  # as so many symbols before it went
            rank[merged] = NO_RANK
            again = np.concatenate([merged, merged - 1])
            again = again[(again >= 0) & (again + 1 < len(symbols))]
            at[again], rank[again] = self._pairs(symbols, word, again)
        if not done:
            return [b""] * len(words)
        word, symbols = np.concatenate([w for w, _ in done]), np.concatenate([x for _, x in done])
        packed = symbols[np.argsort(word, kind="stable")].astype(self.packed).tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=len(words))) * self.packed.itemsize).tolist()
        return [packed[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), FLAT_WORDS):
            part = words[at : at + FLAT_WORDS]
            self.cache.update(zip(part, self.encode_words(part), strict=True))

    def _words(self, text: str) -> list[bytes | str]:
        """A text's words in order; an added special token is its packed id."""
        if self.specials is None or not any(s in text for s in self.special):
            return split_words(text)
        own: list[bytes | str] = []
        for piece in self.specials.split(text):
            if piece in self.special:
                own.append(np.array([self.special[piece]], self.packed).tobytes())
            elif piece:
                own.extend(split_words(piece))
        return own

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; words new to the cache are merged together."""
        parts = [self._words(text) for text in texts]
        fresh = set().union(*parts)
        new = [w for w in fresh if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:  # what these texts need is learnt anew, in full
            self.cache.clear()
            new = list(fresh)
        special = [w for w in new if isinstance(w, bytes)]
        if special:
            self.cache.update(zip(special, special, strict=True))
            new = [w for w in new if isinstance(w, str)]
        self._learn(new)
        known = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(known, own)), self.packed).astype(np.uint32) for own in parts]

    def decode(self, ids: np.ndarray) -> str:
        pieces = self.pieces
        return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary at ``path``, read once per worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def _text_slices(texts: list[str | None], limit: int = 1 << 19) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters together, or of one text."""
    run: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        if run and held + len(text) > limit:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``keep_ids`` adds the ids as array<int>. ``path`` names the vocabulary file on
    every executor. One pass over the partitions, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at = 0
            for texts in _text_slices(batch.column("text").to_pylist()):
                ids = bpe.encode_batch(texts)
                cols = {
                    "doc_id": batch.column("doc_id").slice(at, len(texts)),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                }
                if keep_ids:
                    cols["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)
                at += len(texts)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return arrow_pass(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, schema)
