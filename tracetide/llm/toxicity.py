"""Toxicity by multiple-instance learning: sentences get scores, documents combine them by noisy-or.

A sentence's score is a logistic function of its words. Only documents have labels; the gradient of the noisy-or sends a
document's label to the sentences that explain it. A fit reads a bounded sample of labelled rows in one task; scoring
reads every text as a whole on the executors, and names the sentences that offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracetide.llm.common import chunks, id_hash, table
from tracetide.llm.words import Words, find_words

#: Labelled rows that a fit reads, the longest text among them, and all their characters; rows go by a hash of their id.
SAMPLE_DOCS = 8000
SAMPLE_CHARS = 50_000
SAMPLE_TOTAL = 32_000_000
#: A word of the model occurs in so many toxic documents of the sample, and so many standard deviations above chance.
MIN_DOCS = 8
MIN_DEVIATIONS = 6.0
ROUNDS = 400
RATE = 0.1
DECAY = 5e-6
THRESHOLD = 0.7
OFFENDING = 0.5

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\n")] = True


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The sentence number of every word, and the text of every sentence. Sentences end at . ! ? and line breaks."""
    marks = np.cumsum(_ENDS[words.data])[words.begin]
    fresh = np.ones(len(marks), dtype=bool)
    fresh[1:] = marks[1:] != marks[:-1]
    return np.cumsum(fresh) - 1, words.text_of()[fresh]


@dataclass
class Model:
    """Sorted word hashes, their weights, the weight a sentence starts from, and the chance of a text without any sign.

    Only sentences with a word of the model take part, so a long text is not toxic for its length.
    """

    words: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes among the words of the model; -1 for others."""
        if len(self.words) == 0:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """For each text its score and its offending sentences as (first word, last word, score)."""
        words = find_words(texts)
        sentence, owner = sentences(words)
        at = self.numbers(words.hash)
        hit = at >= 0
        z = self.bias + np.bincount(sentence[hit], self.weights[at[hit]], minlength=len(owner))
        p = _logistic(z) * (np.bincount(sentence[hit], minlength=len(owner)) > 0)
        clear = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts)) + np.log1p(-self.leak)
        starts = np.searchsorted(sentence, np.arange(len(owner) + 1))
        bad: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        for s in np.flatnonzero(p >= OFFENDING).tolist():
            t = int(owner[s])
            first = int(words.first[t])
            bad[t].append((int(starts[s]) - first, int(starts[s + 1]) - 1 - first, float(p[s])))
        for t in range(len(texts)):
            yield float(-np.expm1(clear[t])), bad[t]


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Weights that make the noisy-or of sentence scores likely for the labels (gradient steps on all rows at once).

    Without rows nothing is toxic; where all labels are equal no word tells, and every text scores alike.
    """
    y = np.array(labels, dtype=np.float64)
    words = find_words(texts)
    sentence, owner = sentences(words)
    order = np.lexsort((words.text_of(), words.hash))
    w, t = words.hash[order], words.text_of()[order]
    fresh = np.ones(len(w), dtype=bool)
    fresh[1:] = (w[1:] != w[:-1]) | (t[1:] != t[:-1])
    known, docs = np.unique(w[fresh], return_counts=True)
    toxic = np.bincount(np.searchsorted(known, w[fresh]), y[t[fresh]], minlength=len(known))
    share = docs / max(1, len(texts))
    chance = y.sum() * share
    above = (toxic - chance) / np.sqrt(np.maximum(chance * (1 - share), 1e-9))
    known = known[(toxic >= MIN_DOCS) & (above >= MIN_DEVIATIONS)]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.0
    model = Model(known, np.zeros(len(known)), -4.0, mean)
    if len(known) == 0:
        return model
    at = model.numbers(words.hash)
    hit = at >= 0
    # sentences with a word of the model, numbered anew
    signs, place = np.unique(sentence[hit], return_inverse=True)
    feature, owner = at[hit], owner[signs]
    theta = np.concatenate([np.zeros(len(known)), [-4.0, np.log(mean / (1 - mean))]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        p = _logistic(theta[-2] + np.bincount(place, theta[feature], minlength=len(owner)))
        leak = float(_logistic(theta[-1]))
        clear = (1 - leak) * np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(texts)))
        pull = np.where(y > 0, -clear / np.maximum(1 - clear, 1e-9), 1.0) / len(texts)
        dz = p * pull[owner]
        grad = np.concatenate([np.bincount(feature, dz[place], minlength=len(known)), [dz.sum(), leak * pull.sum()]])
        grad[:-2] += DECAY * theta[:-2]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(known, theta[:-2], float(theta[-2]), float(_logistic(theta[-1])))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_TOTAL) -> Model:
    """A model from at most `sample_docs` labelled rows; (doc_id, toxic) with toxic 0 or 1, others are left out.

    Ids are picked by a hash, and then their rows as long as they stay within the bounds: rows that share an id, or long
    texts, make no fit larger. Equal rows count once.
    """
    picked = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    )
    rows = docs.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id")  # the bound is the limit above
    rows = rows.select("doc_id", F.col("text").cast("string"), F.col("toxic").cast("int")).distinct()
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.col("text")
    rows = rows.orderBy(*order).limit(sample_docs)
    # the one window over all rows is over those of the limit
    so_far = F.sum(F.length("text")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("__chars", so_far).where(F.col("__chars") <= sample_chars).drop("__chars")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        model = fit([r[1] for r in found], [r[2] for r in found])
        columns = [pa.array([model.words.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias]), pa.array([model.leak])]
        yield pa.RecordBatch.from_arrays(columns, names=["words", "weights", "bias", "leak"])

    row = rows.repartition(1).mapInArrow(learn, "words binary, weights binary, bias double, leak double").first()
    if row is None:
        return fit([], [])
    return Model(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["weights"], np.float64), row["bias"], row["leak"])


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of `docs` with score, predicted (score >= 0.7) and offending: (first word, last word, score).

    A text without words, null or empty, has no sentence and scores the leak. Equal rows get equal results, an empty table
    an empty one; very long texts are scored whole. Columns of `docs` that are not kept are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.bias, model.leak))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
        for batch in chunks(batches, len(keep)):
            found = list(own.score(batch.column(len(keep)).to_pylist()))
            scores = np.clip([f[0] for f in found], 0.0, 1.0)
            bad = [[dict(zip(("first_word", "last_word", "score"), s, strict=True)) for s in f[1]] for f in found]
            made = [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(bad, kind)]
            names = [*keep, "score", "predicted", "offending"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)

    slim = docs.select(*keep, F.col("text").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(
        work,
        f"{fields}, score double, predicted int, offending array<struct<first_word:bigint,last_word:bigint,score:double>>",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_hash(F.col("doc_id")) % 3 == 1, F.lit(True))
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(~held))
    return scored(docs.select("doc_id", "text", held.alias("held_out")), model, ("doc_id", "held_out"))
