"""Languages of documents as mixtures: expectation-maximisation over n-gram likelihoods, languages chosen by penalty.

A language is a distribution over hashed windows of four letters. The distributions are counted over all training
documents on the executors, and stay in a table there; what reaches the driver is one block of languages at a time, each a
row of fixed width. For a document, expectation-maximisation estimates the share of every language; then the language with
the smallest share is dropped and the rest fitted again for as long as the penalised likelihood gets better. Where there
are more languages than a block holds, the chosen ones meet the next block, until all languages had their turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.common import chunks, id_hash, staged, table
from tracetide.llm.words import mix

GRAM = 4
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Languages that a document meets at once: 64 MB of likelihoods. There may be any number of blocks.
BLOCK = 256
#: Languages that a task counts before it hands their sums on.
HELD = 64
ROUNDS = 20
#: Cost of one more language, times the logarithm of the number of windows; windows overlap, so it is above 1/2.
PENALTY = 2.0

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of all windows of four bytes: letters in lower case, ASCII characters that are no letters as one blank.

    Windows with more than one blank are left out, so digits and symbols say nothing.
    """
    raw = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    blank = raw == 32
    raw = raw[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint64)  # runs of blanks are one
    if len(raw) < GRAM:
        return np.zeros(0, dtype=np.int64)
    grams = raw[: len(raw) - GRAM + 1].copy()
    for k in range(1, GRAM):
        grams = grams << np.uint64(8) | raw[k : len(raw) - GRAM + 1 + k]
    blanks = np.convolve(raw == 32, np.ones(GRAM, dtype=np.int64), "valid")
    return (mix(grams[blanks <= 1]) >> np.uint64(64 - 15)).astype(np.int64)


@dataclass
class Model:
    """Names of the languages of one block, the likelihood of every bucket in each of them, and counts of later blocks."""

    names: list[str]
    likelihood: np.ndarray
    rest: DataFrame | None = None

    def following(self) -> Model | None:
        """The next block of languages."""
        return None if self.rest is None else _block(self.rest)

    def mixture(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """The main language, its share, and the shares of all chosen languages."""
        found, _ = self.chosen(text, [], [])
        if not found:
            return "und", 0.0, []
        return found[0][0], min(1.0, found[0][1]), found

    def chosen(self, text: str | None, earlier: list[tuple[str, float]], columns: list[bytes]) -> tuple[list[tuple[str, float]], list[bytes]]:
        """Languages with their shares, largest first, and the likelihood of the text's buckets in each of them.

        `earlier` and `columns` are the result of the blocks before this one; these languages compete with the block's.
        """
        if not text or not self.names or not _LETTER.search(text):
            return [], []
        buckets = gram_buckets(text)
        if len(buckets) == 0:  # fewer letters than a window: the first languages by name, without weight
            return earlier or [(n, 1.0 / len(self.names)) for n in self.names], []
        seen, counts = np.unique(buckets, return_counts=True)
        table = np.column_stack([*(np.frombuffer(c) for c in columns), self.likelihood[seen]])
        names = [*(n for n, _ in earlier), *self.names]
        active = np.arange(len(names))
        shares, fit = _shares(table, counts)
        step = PENALTY * np.log(len(buckets))
        while len(active) > 1:
            stay = np.delete(np.arange(len(active)), np.argmin(shares))
            fewer, fit_fewer = _shares(table[:, active[stay]], counts, shares[stay])
            if fit - fit_fewer > step:
                break
            active, shares, fit = active[stay], fewer, fit_fewer
        order = sorted(range(len(active)), key=lambda k: (-shares[k], names[active[k]]))
        return [(names[active[k]], float(shares[k])) for k in order], [table[:, active[k]].tobytes() for k in order]


def _shares(table: np.ndarray, counts: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Shares of the languages of `table` by expectation-maximisation, and the log-likelihood."""
    k = table.shape[1]
    shares = np.full(k, 1.0 / k) if begin is None else begin / begin.sum() if begin.sum() > 0 else np.full(k, 1.0 / k)
    total = counts.sum()
    for _ in range(ROUNDS if k > 1 else 0):
        mixed = table @ shares
        new = shares * (table.T @ (counts / mixed)) / total
        done = np.abs(new - shares).max() < 1e-3
        shares = new
        if done:
            break
    return shares, float(counts @ np.log(table @ shares))


def train(docs: DataFrame) -> Model:
    """A model from the text and lang of every row of `docs` where both are set: its first block of languages by name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in sorted(sums.items()):
                hit = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(own[hit], pa.int64())],
                    names=["lang", "bucket", "n"],
                )
            sums.clear()

        for batch in chunks(batches, 0):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums and len(sums) == HELD:
                    yield from told()
                own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                own += np.bincount(gram_buckets(text), minlength=BUCKETS)
        yield from told()

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("text").cast("string"), F.col("lang").cast("string")
    )
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return _block(staged(counts, "gram-counts"))


def _block(counts: DataFrame) -> Model:
    """The first languages of `counts` by name, and the counts of those after them."""
    names = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(BLOCK + 1).collect()]
    rest = counts.where(F.col("lang") > names[BLOCK - 1]) if len(names) > BLOCK else None
    names = names[:BLOCK]
    likelihood = np.full((BUCKETS, len(names)), SMOOTHING)
    if not names:
        return Model(names, likelihood)
    # a block's languages times buckets at most, whatever the number of documents or languages
    rows = counts.where(F.col("lang") <= names[-1]).groupBy("lang")
    rows = rows.agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toArrow()
    for lang, bucket, n in zip(*(rows.column(k) for k in range(3)), strict=True):
        likelihood[bucket.values.to_numpy(), names.index(lang.as_py())] += n.values.to_numpy()
    return Model(names, likelihood / likelihood.sum(axis=0), rest)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of `docs` with lang_pred, score and languages (name and share, largest first).

    Null text and text without a letter is `und` with score 0, as is any text if the model knows no language. score is
    the share of the main language. Ties go to the name that comes first; a text shorter than a window is shared evenly by
    the first block. Equal rows get equal results, an empty table an empty one; very long texts are counted whole. Columns
    of `docs` that are not kept are not read, whatever their names. Any number of languages is met in blocks; each block
    after the first reads the texts and the languages chosen so far from the shared folder.
    """
    width = len(keep)
    rows = docs.select(*keep, F.col("text").cast("string"))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[:width]]
    # kept columns go by number, so that their names cannot clash with the others
    rows = rows.toDF(*(f"c{k}" for k in range(width)), "text")
    block: Model | None = model
    while block is not None:
        rows = _met(rows, block, kinds)
        block = block.following()
        if block is not None:
            rows = staged(rows, "languages")
    languages = F.col("languages")
    first = F.get(languages, F.lit(0))
    return rows.select(
        *(F.col(f"c{k}").alias(name) for k, name in enumerate(keep)),
        F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"),
        F.least(F.coalesce(first["share"], F.lit(0.0)), F.lit(1.0)).alias("score"),
        "languages",
    )


def _met(rows: DataFrame, model: Model, kinds: list[str]) -> DataFrame:
    """`rows` (kept columns, text, and the result of earlier blocks) after their texts met one more block.

    The text, and the likelihoods of the chosen languages, are carried only if another block follows.
    """
    width, more = len(kinds), model.rest is not None
    shared = rows.sparkSession.sparkContext.broadcast((model.names, model.likelihood))
    part = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in chunks(batches, width):
            texts = batch.column(width).to_pylist()
            if batch.num_columns > width + 1:
                earlier = [[(x["lang"], x["share"]) for x in f] for f in batch.column(width + 1).to_pylist()]
                columns = batch.column(width + 2).to_pylist()
            else:
                earlier = columns = [[]] * len(texts)
            found = [own.chosen(*x) for x in zip(texts, earlier, columns, strict=True)]
            made = [pa.array([[{"lang": n, "share": s} for n, s in f] for f, _ in found], part)]
            names = [f"c{k}" for k in range(width)]
            if more:
                made = [batch.column(width), *made, pa.array([c for _, c in found], pa.list_(pa.binary()))]
            names += ["text", "languages", "likelihoods"] if more else ["languages"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=names)

    fields = [*(f"c{k} {kind}" for k, kind in enumerate(kinds)), *(["text string"] if more else [])]
    fields += ["languages array<struct<lang:string,share:double>>", *(["likelihoods array<binary>"] if more else [])]
    return rows.mapInArrow(work, ", ".join(fields))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_hash(F.col("doc_id")) % 5 == 0, F.lit(True))
    model = train(docs.where(~held))
    found = predict(docs.select("doc_id", "text", held.alias("held_out")), model, ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")
