"""Language identification: averaged hashed subword embeddings, linear softmax, SGD.

A text's features are its hashed byte trigrams and tetragrams (ASCII lower-cased,
runs of non-letters folded to one space). Their embeddings are averaged and a
linear softmax gives the language; both are trained by stochastic gradient descent
in numpy on a bounded sample of labelled texts. As average and linear map commute,
prediction needs only one table (bucket x language) of embedding times weights.
A temperature fitted on a tenth of the sample calibrates the probabilities. ``identify``
names a language for every text with a letter; ``accepted`` rejects texts whose
calibrated probability is below ``reject_below``, and those without a letter.

Edge cases: null text, empty text or a text without a letter: ``und``, score 0.
No labelled row at all: every text is ``und`` with score 0. Of equally probable languages
the first by name. A letter alone (too short for a subword) has the languages' prior.
Texts are read whole at any length. Repeated rows count each. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.textscan import byte_view, slices
from ledgerlens.session import arrow_pass, bound_arrow_batches

#: Hash buckets, embedding width, and the labelled texts per language that training reads (about).
BUCKETS, WIDTH, PER_LANGUAGE = 1 << 14, 16, 400
#: Labelled texts that training reads in all (about): beyond 16 languages fewer of each, but one at least.
MAX_TEXTS = 16 * PER_LANGUAGE
#: With more languages the embeddings and the output layer are kept apart, as their product grows with the languages.
FOLDED_LANGUAGES = 64
EPOCHS, RATE = 8, 0.5

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all texts' subwords, and each text's offsets into them."""
    folded = _FOLD[data]
    blank = folded == 0x20
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep[heads] = True
    at = np.zeros(len(folded) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    b, offs = folded[keep].astype(np.uint32), at[offsets]
    n = len(b)
    if n < 4:
        b = np.append(b, np.full(4 - n, 0x20, np.uint32))
    three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    four = three[:-1] | (b[3:] << np.uint32(24))
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    three, four = (three * np.uint32(2654435761)) >> shift, ((four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> shift
    # Both n-grams that begin at a byte sit side by side; those that reach into the next text go.
    size = np.diff(offs)
    left = np.repeat(offs[1:], size) - np.arange(n)
    both = np.empty((n, 2), np.uint32)
    both[:, 0], both[:, 1] = np.append(three, [0, 0])[:n], np.append(four, [0, 0, 0])[:n]
    whole = np.stack([left >= 3, left >= 4], axis=1)
    count = np.maximum(size - 2, 0) + np.maximum(size - 3, 0)
    return both[whole], np.append(0, np.cumsum(count))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language, or bucket x width with ``out``
    bias: np.ndarray
    temperature: float
    out: np.ndarray | None = None  # width x language

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, text x language."""
        grams, offs = subwords(data, offsets)
        sums = np.empty((len(offs) - 1, self.table.shape[1]))
        counts = np.diff(offs)
        full = np.flatnonzero(counts)
        for j in range(self.table.shape[1]):  # one flat gather per column keeps the arrays small
            got = self.table[:, j].take(grams) if len(grams) else np.zeros(0, np.float32)
            sums[:, j] = 0
            if len(full):
                sums[full, j] = np.add.reduceat(got, offs[:-1][full], dtype=np.float64)
        means = sums / np.maximum(counts, 1)[:, None]
        logits = ((means if self.out is None else means @ self.out) + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]


def bag_of(data: np.ndarray) -> Bag:
    """A text's distinct buckets and their shares: all that training reads of it, at most ``BUCKETS`` numbers."""
    ids, n = np.unique(subwords(data, np.array([0, len(data)]))[0], return_counts=True)
    return ids, (n / max(1, n.sum())).astype(np.float32)


def train(bags: list[Bag], langs: list[str], seed: int = 7) -> LanguageModel | None:
    """Fit the model to bags of labelled texts; None without any."""
    if not bags:
        return None
    languages = sorted(set(langs))
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in langs])
    rng = np.random.default_rng(seed)
    k = len(languages)
    emb = (rng.standard_normal((BUCKETS, WIDTH)) * 0.05).astype(np.float32)
    out = np.zeros((WIDTH, k), np.float32)
    bias = np.zeros(k, np.float32)
    order = rng.permutation(len(bags))
    check, fit = order[: len(order) // 10], order[len(order) // 10 :]
    # Sparse rows are small averages, so embeddings step with a larger rate than the output layer.
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(fit):
            ids, w = bags[i]
            if not len(ids):
                continue
            hidden = w @ emb[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            emb[ids] -= (20 * rate) * np.outer(w, back)
    folded = k <= FOLDED_LANGUAGES
    model = LanguageModel(languages, emb @ out if folded else emb, bias.astype(np.float64), 1.0, None if folded else out)
    held = check if len(check) >= 20 else fit
    means = [bags[i][1] @ model.table[bags[i][0]] if len(bags[i][0]) else np.zeros(model.table.shape[1]) for i in held]
    z = np.array([(m if folded else m @ out) + model.bias for m in means])
    best = np.inf
    for t in np.geomspace(0.05, 10, 60):  # temperature by held-back likelihood
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        loss = np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]) + 1e-3 * abs(np.log(t))
        if loss < best:
            best, model.temperature = loss, float(t)
    return model


def fit_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Train on about ``per_language`` texts of each language, drawn by hash.

    Every language is learned: where they are many, fewer texts of each are drawn,
    ``MAX_TEXTS`` in all or one of each. Only rows with a language whose fold isn't 0 are
    read. The draw is a hash threshold per language that its least hash is never above.
    Executors make the drawn texts' bags; those (at most twice as many of a language as
    asked for, ``BUCKETS`` numbers each at most) reach the driver, texts never do.
    """
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold_of(F.col("doc_id")) != 0, F.lit(True))
    )
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).cast("double") / 1e6
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(share).alias("least")).collect()
    if not counts:
        return None
    each = min(per_language, max(1, MAX_TEXTS // len(counts)))
    drawn = [(r["lang"], min(1.0, each / r["count"]), r["least"]) for r in counts]
    limits = docs.sparkSession.createDataFrame(drawn, "lang string, below double, least double")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    sample = known.join(F.broadcast(limits), "lang").where((share < F.col("below")) | (share == F.col("least")))
    sample = sample.select("lang", "text", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a bag at a time, so long texts don't add up
                ids, weights = bag_of(byte_view(batch.column("text").slice(i, 1))[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(i, 1), batch.column("at").slice(i, 1), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([weights], pa.list_(pa.float32()))],
                    names=["lang", "at", "ids", "weights"],
                )

    bags = arrow_pass(sample, run, "lang string, at struct<o0:long,o1:long,o2:long>, ids array<int>, weights array<float>")
    # Ordered, so that the bound (never reached in expectation) cuts the same rows each time.
    ranked = bags.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("at"))).where(F.col("n") <= 2 * each)
    rows = ranked.orderBy("at").select("lang", "ids", "weights").toArrow()
    column = lambda name: (x.values.to_numpy(zero_copy_only=False) for x in rows.column(name))
    return train(list(zip(column("ids"), column("weights"), strict=True)), rows.column("lang").to_pylist())


def predict_arrays(model: LanguageModel | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language or und, score) of each text of an Arrow column."""
    n = len(column)
    lang, score = ["und"] * n, np.zeros(n)
    if model is None or n == 0:
        return lang, score
    data, offsets = byte_view(column)
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        p = model.probabilities(part, offsets[lo : hi + 1] - offsets[lo])
        best = p.argmax(axis=1)
        for i in range(lo, hi):
            raw = part[offsets[i] - offsets[lo] : offsets[i + 1] - offsets[lo]]
            if _LETTER.search(raw.tobytes().decode("utf-8", errors="replace")):
                lang[i], score[i] = model.languages[best[i - lo]], p[i - lo, best[i - lo]]
    return lang, score


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict_arrays(held.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text"
    )
    return arrow_pass(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel | None, reject_below: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is found with enough confidence."""
    bound_arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def sure(text: pd.Series) -> pd.Series:
        lang, score = predict_arrays(held.value, pa.Array.from_pandas(text, type=pa.large_string()))
        return pd.Series((np.array(lang) != "und") & (score >= reject_below))

    return docs.where(sure(docs["text"]))
