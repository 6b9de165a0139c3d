"""Benchmark decontamination: a broadcast set of test windows against every window of the documents.

Windows of ten words of the benchmark go to all executors as a hash set whose size is checked first. A benchmark beyond
the bound is cut into slices of whole items that are scanned in turn, so the set in memory stays bounded and no item is
left out. Documents are read once for each slice and never shuffled for it; hits are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracetide.llm.common import chunks, settled, shielded, staged, table
from tracetide.llm.words import find_words, window_hashes

WINDOW = 10
#: Most bytes of window text in one broadcast set.
MAX_SET_BYTES = 32_000_000

_ITEM_SCHEMA = "item_id string, phrase binary, n int, h long"
_HIT_SCHEMA = "n_words long, starts array<int>, sizes array<int>, items array<string>"


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, phrase, n, h): the distinct windows of every item; an item of fewer words is one window."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            ids = batch.column(0).to_pylist()
            words = find_words(batch.column(1).to_pylist())
            out = set()
            for t, item in enumerate(ids):
                a, b = int(words.first[t]), int(words.first[t + 1])
                n = min(size, b - a)
                if item is None or n == 0:
                    continue
                hashes = window_hashes(words.hash[a:b], n).view(np.int64).tolist()
                out.update((item, words.phrase(a + k, n), n, h) for k, h in enumerate(hashes))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                names=["item_id", "phrase", "n", "h"],
            )

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return items.mapInArrow(make, _ITEM_SCHEMA).distinct()


class TestSet:
    """Windows looked up by hash: a bit table first, then a sorted array, then the words themselves."""

    __test__ = False

    def __init__(self, rows: list[tuple[str, bytes, int, int]]):
        self.items: dict[tuple[int, bytes], list[str]] = {}
        by_size: dict[int, set[int]] = {}
        for item, phrase, n, h in rows:
            self.items.setdefault((n, bytes(phrase)), []).append(item)
            by_size.setdefault(n, set()).add(h)
        self.sizes = {n: np.sort(np.array(list(hs), dtype=np.int64).view(np.uint64)) for n, hs in sorted(by_size.items())}
        self.bits = {}
        for n, hs in self.sizes.items():
            self.bits[n] = np.zeros(1 << 20, dtype=bool)
            self.bits[n][(hs >> np.uint64(44)).astype(np.int64)] = True

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[int], list[int], list[str]]]:
        """For each text its number of words, starts and sizes of verified windows, and the items found."""
        words = find_words(texts)
        found: list[list[tuple[int, int, bytes]]] = [[] for _ in texts]
        for n, known in self.sizes.items():
            hashes = window_hashes(words.hash, n)
            hits = np.flatnonzero(self.bits[n][(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, hashes[hits]), len(known) - 1)
            hits = hits[known[at] == hashes[hits]]
            owner = np.searchsorted(words.first, hits, side="right") - 1
            inside = hits + n <= words.first[owner + 1]
            for k, t in zip(hits[inside].tolist(), owner[inside].tolist(), strict=True):
                phrase = words.phrase(k, n)
                if (n, phrase) in self.items:
                    found[t].append((k - int(words.first[t]), n, phrase))
        for t, hits in enumerate(found):
            items = sorted({i for _, n, phrase in hits for i in self.items[n, phrase]})
            yield int(words.first[t + 1] - words.first[t]), [k for k, _, _ in hits], [n for _, n, _ in hits], items


def _scanned(docs: DataFrame, rows: list[tuple[str, bytes, int, int]]) -> DataFrame:
    """`docs` (the text last) with the columns of one scan instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    keep = docs.columns[:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSet(shared.value)
        for batch in chunks(batches, len(keep)):
            n_words, starts, sizes, items = zip(*tests.scan(batch.column(len(keep)).to_pylist()), strict=True)
            made = [
                pa.array(n_words, pa.int64()),
                pa.array(starts, pa.list_(pa.int32())),
                pa.array(sizes, pa.list_(pa.int32())),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *made], names=[*keep, "n_words", "starts", "sizes", "items"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(scan, f"{fields}, {_HIT_SCHEMA}")


def _slices(benchmark: DataFrame, size: int, max_set_bytes: int) -> Iterator[list[tuple[str, bytes, int, int]]]:
    """The distinct windows of the benchmark, in sets of about the bound; the windows of an item stay together."""
    windows = staged(benchmark_windows(benchmark, size), "benchmark-windows")
    total = windows.agg(F.coalesce(F.sum(F.length("phrase") + F.length("item_id")), F.lit(0))).first()[0]
    n = -(-total // max_set_bytes) or 1
    for k in range(n):
        rows = windows if n == 1 else windows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [tuple(r) for r in rows.collect()]


def window_hits(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_set_bytes: int = MAX_SET_BYTES
) -> DataFrame:
    """(doc_id, th, n_words, starts, sizes, items): the verified windows of every document row.

    Null text has no words. th stands for the text. Items without id or words find nothing. Equal rows give equal rows.
    """
    text = F.col("text").cast("string")
    slim = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    scans = [_scanned(slim, rows) for rows in _slices(benchmark, size, max_set_bytes)]
    n = len(scans)
    if n == 1:
        return scans[0]
    # a slice is about the bound, and never more than the bound and one item
    out = reduce(DataFrame.unionByName, scans)
    merged = (
        out.groupBy("doc_id", "th")
        .agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("starts")).alias("starts"),
            F.flatten(F.collect_list("sizes")).alias("sizes"),
            F.flatten(F.collect_list("items")).alias("items"),
            F.count(F.lit(1)).alias("__copies"),
        )
        .withColumn("__copies", F.sequence(F.lit(1), (F.col("__copies") / n).cast("int")))
    )
    return merged.withColumn("__copies", F.explode("__copies")).drop("__copies")


def contamination(hits: DataFrame) -> DataFrame:
    """Digest of `window_hits`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans holds the merged intervals of hit words as (first, last); n_hit counts the words in them.
    """
    spans = F.array_sort(
        F.transform(F.arrays_zip("starts", "sizes"), lambda z: F.struct(z["starts"].alias("a"), (z["starts"] + z["sizes"] - 1).alias("b")))
    )
    df = settled(hits, s=spans, i=F.array_sort(F.array_distinct("items")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    merged = F.aggregate(
        "s",
        F.struct(none.alias("done"), F.lit(-1).alias("a"), F.lit(-2).alias("b")),
        lambda acc, x: F.when(
            (x["a"] <= acc["b"] + 1) & (acc["a"] >= 0),
            F.struct(acc["done"].alias("done"), acc["a"].alias("a"), F.greatest(acc["b"], x["b"]).alias("b")),
        ).otherwise(
            F.struct(
                F.when(acc["a"] >= 0, F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))
                .otherwise(acc["done"])
                .alias("done"),
                x["a"].alias("a"),
                x["b"].alias("b"),
            )
        ),
        lambda acc: F.when(
            acc["a"] >= 0, F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))
        ).otherwise(acc["done"]),
    )
    df = settled(df, spans=F.when(F.size("s") == 0, none).otherwise(merged))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"] + 1)
    return df.select(
        "doc_id",
        "th",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("i").cast("long").alias("n_items"),
        F.sha2(F.array_join("i", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("s") > 0).alias("contaminated"),
        "spans",
    )


def without_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_set_bytes: int = MAX_SET_BYTES) -> DataFrame:
    """`docs` (with a string column text) without the rows that hold a benchmark window.

    Rows are dropped where they are scanned, and none is moved. Null and empty texts stay, as do all rows if the benchmark
    is empty; equal rows go or stay together. Columns may have any names.
    """
    at, shape = docs.columns.index("text"), docs.schema
    for rows in _slices(benchmark, size, max_set_bytes):
        if rows:
            docs = _left(docs, at, shape, rows)
    return docs


def _left(docs: DataFrame, at: int, shape: StructType, rows: list[tuple[str, bytes, int, int]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSet(shared.value)
        for batch in chunks(batches, at):
            yield batch.filter(pa.array([not items for _, _, _, items in tests.scan(batch.column(at).to_pylist())]))

    return docs.mapInArrow(clean, shape)


def without_spans(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """`docs` with the hit words cut out of their texts, up to the next word; all other characters stay."""
    docs, named = shielded(docs)
    hits = contamination(window_hits(docs, benchmark, **options)).where("contaminated")
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "spans").dropDuplicates(["__id", "__th"])
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__th"))
    names = [*(c for c in docs.columns if c != "text"), "__spans", "text"]
    df = docs.join(hits.withColumnRenamed("spans", "__spans"), same, "left").select(*names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, len(names) - 1):
            texts = batch.column(len(names) - 1).to_pylist()
            for t, spans in enumerate(batch.column(len(names) - 2).to_pylist()):
                if spans:
                    words = find_words([texts[t]])
                    raw = texts[t].encode("utf-8", "surrogatepass")
                    begins = [*(words.begin - 1).tolist(), len(raw)]  # the joined bytes begin with a separator
                    for span in reversed(spans):
                        raw = raw[: begins[span["a"]]] + raw[begins[span["b"] + 1] :]
                    texts[t] = raw.decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names) - 2], pa.array(texts, pa.string())], names=[*names[:-2], "text"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "__spans")
    return named(df.mapInArrow(cut, fields).select(*docs.columns))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document against the whole benchmark."""
    hits = window_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination(hits).drop("th", "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark window."""
    return without_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The same rows in DuckDB.
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""
