"""Audit of corpus filters that interact: what each filter removes in every order, by part of the corpus.

A document's failures are bits of a mask, so every order of the filters follows from counts by mask. The last filter looks
for exact repeats. A counting Bloom sketch goes first: counters are added up over all tasks, and a text with a counter
that only it raised is guaranteed to be unique. Only the texts that are left, the possible repeats, are shuffled whole, to
find the smallest id of each text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.llm.common import chunks, staged, table

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
MIN_WORDS = 200
MARKS = "#$%&*|"
#: Counters for each document. With three positions one unique text in some 100 is taken for a possible repeat.
COUNTERS_PER_ROW = 12
#: Bits of a row of the full-counter bitmap, as Spark's bitmap functions fix it.
BITMAP_BITS = 32768
#: Most counters of a sketch: its bitmap, a bit for each, takes 256 MB on an executor at most. Beyond some 200 million
#: documents the sketch clears fewer texts and more of them are shuffled; results stay the same.
MAX_COUNTERS = 1 << 31

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = MARKS.encode()


def failures(text: bytes) -> int:
    """The mask of filters A to D that a text fails, from its UTF-8 form.

    A: under 200 words; B: under half of the words are different; C: over 2 % of the characters are A-Z; D: a mark.
    """
    words = text.split()  # bytes split at the six ASCII blanks alone
    capitals = len(text) - len(text.translate(None, _UPPER))
    characters = len(text.translate(None, _CONTINUED))
    mask = 1 if len(words) < MIN_WORDS else 0
    mask |= 2 if 100 * len(set(words)) < 50 * len(words) else 0
    mask |= 4 if 100 * capitals > 2 * characters else 0
    return mask | (8 if len(text.translate(None, _MARKS)) < len(text) else 0)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 0):
        masks = [failures(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        columns = [pa.array(masks, pa.int32()), *batch.columns[1:]]
        yield pa.RecordBatch.from_arrays(columns, names=["mask", *batch.schema.names[1:]])


def _hashes(text: Column) -> list[Column]:
    """128 bits of a text in two longs."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def flags(docs: DataFrame) -> DataFrame:
    """(mask, doc_id, part, h1, h2) of every row, written: one scan of the texts. Null texts and sources are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.col("doc_id").cast("long"), part.alias("part"), *_hashes(text))
    return staged(rows.mapInArrow(_judge, "mask int, doc_id long, part string, h1 long, h2 long"), "flags")


def counters_for(n: int, limit: int = MAX_COUNTERS) -> int:
    """A power of two with at least COUNTERS_PER_ROW counters for each of n rows, up to the limit."""
    return min(max(BITMAP_BITS, 1 << max(0, COUNTERS_PER_ROW * n - 1).bit_length()), limit)


def _positions(h1: Column, h2: Column, counters: int) -> list[Column]:
    """The three places of a text in the sketch."""
    return [h.bitwiseAND(F.lit(counters - 1)) for h in (h1, h2, F.xxhash64(h1, h2))]


def sketch(hashed: DataFrame, counters: int) -> DataFrame:
    """(bucket, bitmap): the counters that two rows or more raised, a bit for each.

    The counters are the groups of an aggregation: each task counts its own rows first and the sums of all tasks merge, so
    a text that a third of the rows hold raises its counters once for each task.
    """
    place = F.explode(F.array_distinct(F.array(*_positions(F.col("h1"), F.col("h2"), counters)))).alias("place")
    full = hashed.select(place).groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # the functions number bits from 1
    bit = F.col("place") + 1
    return full.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))


def possible_repeats(rows: DataFrame, bitmaps: DataFrame, counters: int) -> DataFrame:
    """The rows (with h1 and h2) whose counters are all full. The bitmap has at most counters / 8 bytes, so it is sent to
    all executors and no row moves."""
    names = ["at1", "at2", "at3"]
    kept = rows.withColumns(dict(zip(names, _positions(F.col("h1"), F.col("h2"), counters), strict=True)))
    for name in names:
        bit = F.col(name).bitwiseAND(F.lit(BITMAP_BITS - 1)).cast("int")
        byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        here = (F.shiftright(F.col(name), 15) + 1 == F.col("bucket")) & (F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1)
        kept = kept.join(F.broadcast(bitmaps), here, "left_semi")
    return kept.drop(*names)


def smallest_ids(docs: DataFrame, bitmaps: DataFrame, counters: int) -> DataFrame:
    """(h1, h2, doc_id) of the smallest id of every text that may repeat, found on the whole texts.

    Equal texts meet in their own task before the shuffle. Rows without an id take no part.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text.alias("text"), *_hashes(text))
    found = possible_repeats(rows, bitmaps, counters)
    return found.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", *_hashes(F.col("text")))


def masks(docs: DataFrame, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """(doc_id, part, mask, n): rows with all five bits, equal rows counted.

    A row fails E if a smaller id has its text, in whatever part; rows without an id neither fail E nor make others fail.
    Rows that share an id and a text are rows of their own, none smaller than the other.
    """
    rows = flags(docs)
    counters = counters_for(rows.count(), max_counters)
    bitmaps = staged(sketch(rows.where("doc_id IS NOT NULL"), counters), "sketch")
    smallest = smallest_ids(docs, bitmaps, counters)
    repeated = possible_repeats(rows.where("doc_id IS NOT NULL"), bitmaps, counters)
    repeated = repeated.groupBy("doc_id", "h1", "h2", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    repeated = repeated.join(smallest.hint("merge"), ["doc_id", "h1", "h2"], "left_anti")
    # a row counts once with its mask as it is; a repeat counts once more with E and is taken off without it
    passed = rows.select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n"))
    less = repeated.select("doc_id", "part", "mask", (-F.col("n")).alias("n"))
    more = repeated.select("doc_id", "part", F.col("mask").bitwiseOR(F.lit(REPEAT)).alias("mask"), "n")
    return passed.unionByName(less).unionByName(more).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n > 0")


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counts. An id with several label rows is good, or toxic, if one of them says so.

    Rows were counted by id before they meet the labels, so a repeated id is one row for each part and mask.
    """
    by_id = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"),
    )
    joined = masked.where("doc_id IS NOT NULL").join(by_id.hint("merge"), "doc_id", "left")
    rest = masked.where("doc_id IS NULL").select("*", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    weigh = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c)
    return joined.unionByName(rest).groupBy("part", "mask").agg(F.sum("n").alias("n"), weigh("good"), weigh("toxic"))


def audited(counts: DataFrame) -> DataFrame:
    """One row for each part, order and step; the counts by mask are all it needs.

    What a filter does depends only on the set of filters before it: 80 pairs of filter and set for each part give all
    600 rows. A set comes up in |set|! (4 - |set|)! orders, which weights it in the Shapley sum.
    """
    bits = {1 << k: name for k, name in enumerate(FILTERS)}
    befores = [(b, before, bin(before).count("1")) for b in bits for before in range(1 << len(bits)) if not before & b]
    cases = [F.struct(F.lit(b).alias("bit"), F.lit(p).alias("before"), F.lit(factorial(n) * factorial(4 - n)).alias("orders")) for b, p, n in befores]
    each = counts.select("*", F.inline(F.array(*cases)))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, value: str, name: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).alias(name)

    sums = each.groupBy("part", "bit", "before", "orders").agg(
        total(~fails & ~gone, "n", "kept"),
        total(fails & ~gone, "n", "removed"),
        total(fails & gone, "n", "redundant"),
        total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(fails & ~gone, "good", "good_lost"),
        total(fails & ~gone, "toxic", "toxic_lost"),
    )
    sums = sums.select("*", F.sum(F.col("removed") * F.col("orders")).over(W.partitionBy("part", "bit")).alias("shapley"))
    steps = [
        ("".join(bits[b] for b in order), step, b, sum(order[: step - 1]))
        for order in permutations(bits) for step, b in enumerate(order, 1)
    ]
    out = sums.join(F.broadcast(counts.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, before int")), ["bit", "before"])
    return out.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley")
    )


def audit(docs: DataFrame, labels: DataFrame, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """The whole audit of `docs` (doc_id, text, source) with `labels` (doc_id, quality, toxic).

    Rows that repeat count as often as they stand in the table. An empty table has no parts and gives no rows; other
    columns, whatever their names, are not read.
    """
    return audited(mask_counts(masks(docs, max_counters), labels))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of the documents table."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts
), failed AS (
  SELECT doc_id, part,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(least < doc_id, false) AS e
  FROM worded
), marked AS (
  SELECT doc_id, part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask FROM failed
), judged AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM marked LEFT JOIN judged USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest([0, 1, 2, 3, 4]) AS f, unnest(['A', 'B', 'C', 'D', 'E']) AS name
), orders AS (
  SELECT p.name || q.name || r.name || s.name || t.name AS filter_order, [p.f, q.f, r.f, s.f, t.f] AS fs
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.f NOT IN (q.f, r.f, s.f, t.f) AND q.f NOT IN (r.f, s.f, t.f) AND r.f NOT IN (s.f, t.f) AND s.f <> t.f
), steps AS (
  SELECT filter_order, step, 1 << fs[step] AS bit,
         coalesce(list_sum(list_transform(fs[1:step - 1], lambda x: 1 << x)), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), found AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found
"""
