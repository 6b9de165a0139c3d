"""Session helpers: a tuned local builder and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Temporary folders of local sessions by application; the setting itself cannot be changed in a running session.
_LOCAL_ROOTS: dict[str, str] = {}


def build_session(name: str = "tracetide", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder: there the driver
    and the executors are one machine.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tracetide-")
    return _LOCAL_ROOTS[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders below the shared folder, in whatever file system they lie; absent ones are passed over."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        if not path.startswith(shared_root(spark).rstrip("/") + "/"):
            raise ValueError(f"{path} is not below the shared folder")
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def pin(df: DataFrame) -> DataFrame:
    """Write a small intermediate table to the shared folder and go on from there.

    Used for tables of about one row per capture that several branches of a plan
    need: they are computed once and survive the loss of executors.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that are worked out here, once a row.

    The optimizer moves a filter on a column below aggregations and puts the column's expression in its place: a name
    parsed for each capture would be parsed for each packet. It does not look through a generator, so the values
    pass through one that makes a single row.
    """
    made = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select("*", F.inline(F.array(made)))
