"""Helpers the corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.session import remove, work_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that part words in the lower-cased word rule; everything else is a word character.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space of the plain word rule.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[ \t\n\x0B\f\r]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where it was not installed or sent along.

    That works where they see the driver's folders, as in a local session; a cluster gets the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [known])])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written inside each open `scratch`, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that `staged` writes inside are deleted at the end; what is to last is written elsewhere by then."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        remove(spark, paths)


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the files.

    The table is then computed once, whatever reads it, and outlives its executors. A folder with a `path` of its own
    belongs to the caller, and no `scratch` deletes it.
    """
    if path is None:
        path = work_path(df.sparkSession, label)
        if _SCOPES:
            _SCOPES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with further columns that are evaluated once, here.

    The optimizer likes to substitute a column's expression wherever the column is used, also inside the lambda of a
    higher-order function or in a filter moved down, and then works it out again for every element. It does not look
    through a generator, so the values pass through one that makes a single row.
    """
    made = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select("*", F.inline(F.array(made)))


def shielded(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` without columns named like helpers (two leading underscores), and a function that gives them their names back.

    Operators name their helper columns that way; columns of the input pass through them under other names.
    """
    taken = {c.lower() for c in df.columns}
    safe: dict[str, str] = {}
    for name in df.columns:
        if name.startswith("__"):
            other = f"kept{name}"
            while other.lower() in taken:
                other = f"kept_{other}"
            taken.add(other.lower())
            safe[name] = other
    if not safe:
        return df, lambda found: found
    return df.withColumnsRenamed(safe), lambda found: found.withColumnsRenamed({v: k for k, v in safe.items()})


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def id_hash(column: Column) -> Column:
    """crc32 of an id's decimal text, which splits rows into training and held-out parts."""
    return F.crc32(column.cast("string").cast("binary"))


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about `limit` bytes of text each, so that arrays built from them stay small.

    A single longer text makes a slice of its own. Empty batches vanish.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_pylist()
        begin = total = 0
        for row, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(begin, row - begin)
                begin, total = row, 0
            total += size
        if begin < len(sizes):
            yield batch.slice(begin)
