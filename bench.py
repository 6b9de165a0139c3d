"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS how often each query runs (its median counts).
With BENCH_PACKETS=n four reports are timed over a table of about n packets instead, made of the given events.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tracetide.plans.registry import registry  # noqa: E402
from tracetide.session import build_session  # noqa: E402

HEADLINE = (
    "bidir_flows", "flow_metrics", "condition_table", "capture_summary", "per_second_peaks",
    "bucket_summary", "window_throughput", "iat_capture_order", "iat_sorted", "unidir_flows",
    "top_values", "dst_diversity", "distribution_tables", "tcp_seq_quality", "local_ip",
    "percentiles", "duplicate_packets", "planner_repair", "stream_window_throughput", "iforest_score",
)


def timed(df_of, runs: int) -> float:
    """The median time of a query in seconds."""
    times = []
    for _ in range(runs):
        begin = time.perf_counter()
        df_of().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - begin)
    return round(median(times), 3)


def many_packets(spark: SparkSession, sf_dir: str, wanted: int) -> DataFrame:
    """The packets of the events, repeated under new numbers, times and ports until there are about as many as wanted."""
    from tracetide.sources.adapter import packets

    p = packets(spark, sf_dir)
    n = p.count()
    times = max(1, round(wanted / n))
    copy = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy")
    more = p.select("*", copy).withColumns(
        {
            "packet_no": F.col("packet_no") * times + F.col("copy"), "ts_us": F.col("ts_us") + F.col("copy") * 37,
            "sport": F.when(F.col("sport") >= 40000, F.col("sport") + F.col("copy") % 50).otherwise(F.col("sport")),
        }
    )
    path = tempfile.mkdtemp(prefix="bench-")
    more.drop("copy").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", cores=cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    name = "headline_total"
    if wanted := int(os.environ.get("BENCH_PACKETS", "0")):
        from tracetide.operators import captures, flows, series, tcp

        name, p = "packets_total", many_packets(spark, sf_dir, wanted)
        queries = {
            "capture_summary": lambda: captures.capture_summary(p), "flow_metrics": lambda: flows.flow_metrics(p),
            "bucket_series": lambda: series.bucket_series(p), "tcp_seq_quality": lambda: tcp.tcp_seq_quality(p),
        }
        times = {"packets": p.count()}
    else:
        known = registry()
        queries = {q: lambda q=q: known[q][0](spark, sf_dir) for q in HEADLINE}
        # start the session, its code generation and its file readers before the clock runs
        known["proto_counts"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times = {}
    spent = {q: timed(df_of, runs) for q, df_of in queries.items()}
    print(
        json.dumps(
            {
                "metric": name,
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": times | spent,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
