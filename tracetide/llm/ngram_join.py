"""Jaccard self-join of documents on five-word shingles: MinHash bands find pairs, full shingle sets verify them.

Texts with equal shingle sets are one class from the start, so groups of copies never grow into pairs. Classes whose band
hashes meet are candidates. Candidates that hang together form a component, a component is cut into blocks of bounded
size, and every pair of blocks is a group of its own: there a pair is verified if it shares a band. Only links per class
and a forest of the linked classes leave such a group, never the pairs, and every link between different classes counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.common import chunks, shielded, staged, table
from tracetide.llm.words import find_words, mix, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Of pairs that are just similar enough, this share meets in a band.
RECALL = 0.9999
ROWS = 5
#: Classes and shingles of a block, as the mean over the blocks of a component.
BLOCK_CLASSES = 256
BLOCK_SHINGLES = 1 << 20
#: Rows of a graph table that a task writes. A task writes a file, and opening a file starts a process beside the executor.
TASK_EDGES = 1 << 16


def bands_for(recall: float = RECALL, similarity: float = SIMILARITY, rows: int = ROWS) -> int:
    """The number of bands with which a pair of the given similarity meets at least with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted; fewer than n words make one shingle."""
    if len(words) == 0:
        return words
    return np.unique(window_hashes(words, min(n, len(words))))


def _sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The shingle set of every text; a text of other characters only is a single shingle as a whole."""
    words = find_words(texts)
    for t, text in enumerate(texts):
        sh = shingles(words.hash[words.first[t] : words.first[t + 1]], n)
        if len(sh) == 0 and text:
            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            sh = np.frombuffer(digest, dtype=np.uint64)
        yield sh


def _key(shingle_bytes: bytes) -> bytes | None:
    return hashlib.blake2b(shingle_bytes, digest_size=16).digest() if shingle_bytes else None


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[count:] >> np.uint64(32)).astype(np.uint32)


def _band_hashes(sh: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of the MinHash signature of a shingle set."""
    a, b = _multipliers(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(sh), 2048):
        part = (sh[k : k + 2048] >> np.uint64(32)).astype(np.uint32)
        values = part[None, :] * a[:, None] + b[:, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(low, values.min(axis=1), out=low)
    grid = low.reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + grid[:, r]
    return mix(out).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = SHINGLE) -> DataFrame:
    """(doc_id, key, size, bands) of every row: a 128-bit key of the shingle set, its size, and the band hashes.

    Null and empty texts have no key. A text of other characters only has its whole self as a single shingle.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            keys, sizes, hashes = [], [], []
            for sh in _sets(batch.column(1).to_pylist(), n):
                keys.append(_key(sh.tobytes()))
                sizes.append(len(sh))
                hashes.append(_band_hashes(sh, bands, rows) if len(sh) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "key", "size", "bands"],
            )

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(sign, "doc_id long, key binary, size long, bands array<long>")


def shingle_sets(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, key, shingles) of every row: sorted distinct 64-bit hashes and their key."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            sets = [sh.tobytes() for sh in _sets(batch.column(1).to_pylist(), n)]
            keys = [_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                names=["doc_id", "key", "shingles"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        make, "doc_id long, key binary, shingles binary"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) edges; root is one of the component's nodes.

    Each round every node takes its smallest neighbour, or itself, as label, and the edges between labels are the next
    round's graph. A star is gone after one round, and where nodes are hashes only a share of them is left each time. Edges
    are made distinct before they meet the labels of their other end, so a hub with very many edges is one row by then.
    Rounds are written to the shared folder; the number of edges that are left is all that reaches the driver. No later
    table has more rows than edges have ends, so a round with few edges is written by few tasks.
    """
    ordered = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    written = lambda df, label, most: staged(df.coalesce(max(1, -(-most // TASK_EDGES))), label)
    edges = staged(edges.where("a <> b").select(*ordered("a", "b")).distinct(), "edges")
    rounds = []
    first = left = edges.count()
    while left:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a"))
        labels = written(ends.groupBy("node").agg(F.least("node", F.min("next")).alias("root")), "labels", 2 * left)
        rounds.append(labels)
        half = edges.join(labels.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").select("x", "b").distinct()
        whole = half.join(labels.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        edges = written(whole.select(*ordered("x", "y")).distinct(), "edges", left)
        left = edges.count()
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for labels in rounds[1:]:
        further = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        found = found.join(further, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return written(found, "components", 2 * first)


def _verified(
    batches: Iterator[pa.RecordBatch], similarity: float
) -> Iterator[pa.RecordBatch]:
    """Links of every (component, i, j) group of a sorted stream: rows (a, b, links).

    A row (a, a, links) adds to the links of class a; a row (a, b, null) joins two classes.
    """
    names = ["root", "i", "j", "key", "block", "copies", "bands", "shingles"]
    held: list[pa.RecordBatch] = []

    def solve(group: pa.Table) -> pa.RecordBatch:
        keys = group.column("key").to_pylist()
        block = group.column("block").to_numpy()
        copies = group.column("copies").to_numpy()
        bands = np.array(group.column("bands").to_pylist(), dtype=np.int64)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = np.zeros(len(keys), dtype=np.int64)
        parent = list(range(len(keys)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        edges = []
        # shingles as small numbers, so that sets of a row are compared with one lookup table
        vocabulary = np.unique(np.concatenate(sets))
        coded = [np.searchsorted(vocabulary, s) for s in sets]
        ends = np.cumsum(sizes[right])
        flat = np.concatenate([coded[y] for y in right]) if len(right) else np.zeros(0, np.int64)
        member = np.zeros(len(vocabulary), dtype=np.int64)
        for x in left.tolist():
            meet = (bands[right] == bands[x]).any(axis=1)
            meet &= np.minimum(sizes[right], sizes[x]) >= similarity * np.maximum(sizes[right], sizes[x])
            if i == j:
                meet &= right > x
            if not meet.any():
                continue
            member[coded[x]] = 1
            sums = np.concatenate([[0], np.cumsum(member[flat])])
            member[coded[x]] = 0
            common = sums[ends] - sums[ends - sizes[right]]
            # whole-number form of common / union >= similarity
            ok = meet & (common >= similarity * (sizes[x] + sizes[right] - common) - 1e-9)
            for y in right[ok].tolist():
                links[x] += copies[y]
                links[y] += copies[x]
                p, q = find(x), find(y)
                if p != q:
                    parent[p] = q
                    edges.append((x, y))
        hit = np.flatnonzero(links)
        a = [keys[x] for x in [*hit.tolist(), *(e[0] for e in edges)]]
        b = [keys[y] for y in [*hit.tolist(), *(e[1] for e in edges)]]
        n = [*links[hit].tolist(), *([None] * len(edges))]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])

    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        begin = 0
        for k, key in enumerate(keys):
            if key != last:
                held.append(batch.slice(begin, k - begin))
                if last is not None:
                    yield solve(pa.Table.from_batches(held, schema=batch.schema).rename_columns(names))
                held, last, begin = [], key, k
        held.append(batch.slice(begin))
    if last is not None:
        yield solve(pa.Table.from_batches(held).rename_columns(names))


def similar(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links), one row for every row of `docs`.

    copy_id is the smallest doc_id with the same shingle set, class_id the smallest of the documents that links of at
    least `similarity` connect. n_links counts the other rows to which a row itself is that similar, copies included.
    Null and empty texts, and rows without an id, are alone with no links (class_id is their doc_id). Rows that repeat an
    id count as rows of their own, also in the links of others; texts are classes, not ids. An empty table gives an empty result.
    """
    bands = bands_for(recall, similarity, rows)
    signed = staged(signatures(docs, bands, rows, n), "signatures")
    usable = signed.where("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = usable.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    classes = staged(classes, "classes")
    # the sides of the two joins below grow with the corpus, so they are merged at every size and never broadcast
    met = classes.select("key", F.explode("bands").alias("band"))
    crowded = met.groupBy("band").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = met.join(crowded.drop("n").hint("merge"), "band").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    groups = components(edges).select(F.col("node").alias("key"), "root")
    # blocks
    chosen = groups.join(classes, "key")
    shape = chosen.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("total"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    shape = shape.select("root", parts.alias("parts"))
    chosen = chosen.join(shape, "root").select(
        "root", "parts", "rep", "key", "copies", "bands", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("block")
    )
    chosen = staged(chosen, "candidates")
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    wanted = chosen.select(F.col("rep").alias("doc_id")).hint("merge")
    sets = shingle_sets(texts.join(wanted, "doc_id", "left_semi"), n)
    sets = sets.groupBy(F.col("doc_id").alias("rep"), "key").agg(F.first("shingles").alias("shingles"))
    full = chosen.join(sets, ["rep", "key"])
    pairs = full.select(
        "root", "key", "block", "copies", "bands", "shingles",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
    ).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block", "copies", "bands", "shingles"
    )
    pairs = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key")
    found = staged(pairs.mapInArrow(lambda b: _verified(b, similarity), "a binary, b binary, links long"), "links")
    links = found.where("links IS NOT NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("more"))
    linked = staged(components(found.where("links IS NULL")).select(F.col("node").alias("key"), "root").join(classes.select("key", "rep"), "key"), "linked")
    named = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = linked.join(named, "root").select("key", "class_id")
    copies = classes.select("key", F.col("rep").alias("copy_id"), "copies").join(links, "key", "left").join(named, "key", "left")
    out = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(copies, "key", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "copy_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"),
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return similar(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id stays; rows without an id stay."""
    lost = similar(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    docs, named = shielded(docs)
    return named(docs.join(lost, F.col("doc_id") == F.col("__id"), "left_anti").select(*docs.columns))
