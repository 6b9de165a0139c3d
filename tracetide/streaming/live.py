"""Two packet reports as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import bidir_key
from ..operators.flows import flow_packets
from ..session import work_path
from ..sources.adapter import packets_from_events

CAP = "filename"
LATENESS = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of packets with event time ``ts``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return with_event_time(packets_from_events(raw))


def with_event_time(packets: DataFrame) -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros("ts_us"))


def window_throughput(packets: DataFrame, window_s: int = 300, lateness: str = LATENESS) -> DataFrame:
    """Bytes and mean rate per capture and tumbling window; works on a stream and on a table."""
    timed = packets.withWatermark("ts", lateness)
    return timed.groupBy(CAP, F.window("ts", f"{window_s} seconds").alias("w")).agg(
        F.sum("frame_len").alias("bytes"), F.count(F.lit(1)).alias("packets")
    ).select(
        CAP, F.unix_micros("w.start").alias("start_us"), "bytes", "packets",
        (F.col("bytes") * 8.0 / window_s).alias("mean_bps"),
    )


def flow_activity(packets: DataFrame, gap_s: int = 30, lateness: str = LATENESS) -> DataFrame:
    """Activity phases of each bidirectional flow: a new one starts after a pause longer than the gap."""
    rows = flow_packets(packets).select(CAP, "proto", *bidir_key(), "ts", "ts_us", "frame_len").withWatermark("ts", lateness)
    keys = [CAP, "proto", "ip1", "port1", "ip2", "port2"]
    return rows.groupBy(*keys, F.session_window("ts", f"{gap_s} seconds").alias("w")).agg(
        F.sum("frame_len").alias("bytes"), F.count(F.lit(1)).alias("packets"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
    ).drop("w")


#: Sessions of one flow are merged in each task before they meet, so a flow with most of the packets moves as few rows.
MERGE_FIRST = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def drain(
    stream: DataFrame, mode: str = "complete", label: str = "stream", folder: str | None = None, counts: dict[str, int] | None = None
) -> DataFrame:
    """Run a stream over what is there now and return its result table.

    In complete mode each batch holds the whole result and replaces the last one;
    in append mode closed rows are added. With ``folder`` a later call goes on from the
    checkpoint that an earlier one left there. ``counts`` gets the number of
    ``batches`` with data, and of ``late`` rows that came behind the watermark.
    """
    spark = stream.sparkSession
    folder = folder or work_path(spark, label)
    out, state = f"{folder}/out", f"{folder}/state"

    def keep(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again writes the same folder again
        target = f"{out}/batch={0 if mode == 'complete' else batch_id}"
        batch.write.mode("overwrite").parquet(target)

    before = spark.conf.get(MERGE_FIRST, None)
    spark.conf.set(MERGE_FIRST, "true")
    try:
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(keep)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(MERGE_FIRST) if before is None else spark.conf.set(MERGE_FIRST, before)
    if counts is not None:
        for progress in query.recentProgress:
            counts["batches"] = counts.get("batches", 0) + (progress["numInputRows"] > 0)
            dropped = sum(o["numRowsDroppedByWatermark"] for o in progress["stateOperators"])
            counts["late"] = counts.get("late", 0) + dropped
    return spark.read.schema(stream.schema).parquet(out).drop("batch")
