"""Token ids as Parquet: one list column in document order, with what a reader needs to fetch parts of it.

A folder holds `data` (doc_id, part, start_in_part, n_tokens, ids; files in ascending doc_id order) and `index` (one row
for each part: its first and last doc_id, documents, tokens, and the tokens of all parts before it). Ids are dictionary or
delta encoded; row groups and pages are small, and every page has its minimum and maximum in the page index, so a reader
that filters on doc_id opens few pages, and one that wants only lengths reads no ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.llm.common import chunks, table
from tracetide.llm.tokens import END_ID, encoder, tokenizer_path
from tracetide.session import work_path

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 512
SLICE_BYTES = 4 << 20


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit ids over one buffer."""
    values = b"".join(encoded)
    offsets = pa.array([0, *accumulate(len(x) // 4 for x in encoded)], pa.int32())
    flat = pa.Array.from_buffers(pa.int32(), len(values) // 4, [None, pa.py_buffer(values)])
    return pa.ListArray.from_arrays(offsets, flat)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, encoding: str = "dictionary") -> None:
    """Tokenize whole texts (null: empty), append the end id, and write the folder.

    Rows are dealt by ranges of doc_id (null ids first) and sorted inside. Rows of one id go by a hash of their text and
    then by it, equal rows by their place in the input, so an id of very many rows is cut into ranges like any others. An
    empty table makes a folder without rows.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer or tokenizer_path(), END_ID)
        part, at = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, 1, SLICE_BYTES):
            encoded = [code.encode(t) for t in batch.column(1).to_pylist()]
            counts = [len(x) // 4 for x in encoded]
            starts = list(accumulate(counts, initial=at))
            at = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([part] * len(counts), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    id_lists(encoded),
                ],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "text", "place")
    rows = rows.drop("tie", "place").mapInArrow(encode, "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>")
    options = {
        "compression": "zstd",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "PARQUET_2_0",
    }
    rows.write.options(**options).parquet(f"{path}/data")
    data = docs.sparkSession.read.parquet(f"{path}/data")
    parts = data.groupBy("part").agg(
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"),
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    # one row for each written part
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts.withColumn("base", F.coalesce(before, F.lit(0)).cast("long")).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Filters on doc_id reach the files."""
    data = spark.read.parquet(f"{path}/data")
    index = spark.read.parquet(f"{path}/index").select("part", "base")  # one short row for each file
    start = (F.col("base") + F.col("start_in_part")).alias("start")
    return data.join(F.broadcast(index), "part").select("doc_id", start, "n_tokens", "ids")


def id_checks(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the ids as little-endian unsigned 32-bit integers."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = memoryview(lists.values.buffers()[1] or b"").cast("B")
            shift = lists.values.offset
            ends = [4 * (shift + x) for x in lists.offsets.to_pylist()]
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        check, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every document, read the files back, and return their digest."""
    path = work_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return id_checks(read_tokens(spark, path))
