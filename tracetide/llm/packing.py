"""Packing of token pieces into training windows by Karmarkar-Karp multiway differencing.

Documents are cut into full windows and short pieces. Short pieces are dealt to tasks in batches of some hundred windows;
in a batch, differencing merges partial partitions with opposing imbalances until one partition into near-equal windows
is left, and the number of windows rises while one of them exceeds the capacity. Only lengths and checks of pieces are
shuffled, never ids or texts, and pieces of one document need not meet.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.common import chunks, staged, table
from tracetide.llm.tokens import END_ID, encoder, tokenizer_path

CAPACITY = 2048
#: Longest of the pieces that are differenced; shorter ones balance better and cut more documents.
PIECE = 512
#: The last piece of a document leaves this many tokens and up to twice as many apart: fine weights for the last merges.
TAIL = 16
#: Windows of a batch, and tokens of a task. Spare tokens of a window let differencing end without a further window.
BATCH_WINDOWS = 512
#: Most pieces of a batch for each of its windows; batches of very short documents have fewer windows.
BATCH_PIECES = 256
TASK_TOKENS = 8_000_000
SPARE = 2

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of every document.

    Null text is empty and has its end id as only token. Rows that repeat an id, or have none, are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer or tokenizer_path(), END_ID)
        for batch in chunks(batches, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(code.encode(text))
                total = at = len(ids) // 4
                at -= total % capacity
                cuts = [*range(0, at, capacity), *range(at, total, piece), total]
                if total - cuts[-2] > 2 * TAIL and cuts[-2] >= at:
                    last = total - cuts[-2]
                    cuts.insert(-1, total - TAIL - last % TAIL)
                rows += [(doc, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), total) for a, b in zip(cuts, cuts[1:], strict=False)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def differencing(lengths: np.ndarray, k: int) -> list[list[int]]:
    """k groups of item numbers with near-equal sums, by Karmarkar-Karp differencing.

    A partial partition is its sums in falling order, less the smallest of all k, and the node of a tree for each sum. Only
    groups that hold something are kept; the others have a sum of zero and stand last. The two partitions with the
    largest spread are merged, the largest sums of one with the smallest of the other. All partitions together keep no
    more sums than there are items.
    """
    n = len(lengths)
    if n == 0 or k == 0:
        return [[] for _ in range(k)]
    children: list[tuple[int, int]] = []
    sizes = lengths.astype(np.int64)
    items = np.arange(n, dtype=np.int64)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        heap.append((-int(sizes[i]), len(heap), sizes[i : i + 1], items[i : i + 1]))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        # the groups of b stand at the end of the k places, in reverse; where they reach those of a, two become one
        met = max(0, len(a) + len(b) - k)
        apart, own = len(a) - met, len(b) - met
        b, b_nodes = b[::-1], b_nodes[::-1]
        sums = np.concatenate([a[:apart], a[apart:] + b[:met], b[met:]])
        joined = n + len(children) + np.arange(met)
        nodes = np.concatenate([a_nodes[:apart], joined, b_nodes[met:]])
        children += zip(a_nodes[apart:].tolist(), b_nodes[:met].tolist(), strict=True)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        if apart + met + own == k:
            sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, nodes[order]))
        tie += 1
    groups = []
    for node in heap[0][3].tolist():
        group, todo = [], [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                group.append(x)
            else:
                todo += children[x - n]
        groups.append(group)
    return groups + [[] for _ in range(k - len(groups))]


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Groups of items with sums of at most `capacity`; no item is longer than that."""
    k = -(-int(lengths.sum()) // capacity)
    while True:
        groups = differencing(lengths, k)
        if all(int(lengths[g].sum()) <= capacity for g in groups):
            return [g for g in groups if g]
        k += 1


def packed(pieces: DataFrame, capacity: int = CAPACITY, batch_windows: int = BATCH_WINDOWS) -> DataFrame:
    """`pieces` with sequence_id and offset.

    Every piece is in one sequence; offsets have no gaps. Pieces are dealt evenly, whatever their ids, and sorted in their
    task. Spark sorts rows before it deals them out, so a lost task repeats its result. Equal rows and rows without an id
    are pieces of their own; an empty table gives no rows. Columns of other names are not carried.
    """
    pieces = staged(pieces, "pieces")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    room = batch_windows * (capacity - SPARE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        next_id = TaskContext.get().partitionId() << 33

        def placed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal next_id
            rows = pa.Table.from_batches(parts).combine_chunks()
            lengths = rows.column("length").to_numpy()
            short = np.flatnonzero(lengths < capacity)
            groups = [short[g] for g in windows(lengths[short], capacity)] + [[i] for i in np.flatnonzero(lengths >= capacity)]
            sequence = np.zeros(len(lengths), dtype=np.int64)
            offset = np.zeros(len(lengths), dtype=np.int64)
            for g in groups:
                sequence[g] = next_id
                offset[g] = np.cumsum(lengths[g]) - lengths[g]
                next_id += 1
            arrays = [*(c.combine_chunks() for c in rows.columns), pa.array(sequence), pa.array(offset)]
            return pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=names)

        held: list[pa.RecordBatch] = []
        tokens = count = 0
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            weight = np.where(lengths < capacity, lengths, 0)
            begin = 0
            for i, w in enumerate(weight.tolist()):
                tokens += w
                count += 1
                if tokens >= room or count >= BATCH_PIECES * batch_windows:
                    held.append(batch.slice(begin, i + 1 - begin))
                    yield placed(held)
                    held, tokens, count, begin = [], 0, 0, i + 1
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield placed(held)

    n = max(1, -(-int(total) // TASK_TOKENS))
    dealt = pieces.repartition(n).sortWithinPartitions(
        F.xxhash64("doc_id", "start"), "doc_id", "start", "length", "ids_crc32"
    )
    return dealt.mapInArrow(pack, f"{_PIECES}, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    return packed(token_pieces(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the documents that are left."""
    return packed(token_pieces(docs))
