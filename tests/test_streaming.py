"""Streams against the same query over a table, and late rows in append mode."""

from pyspark.sql import functions as F

from tracetide.streaming import live

SCHEMA = "filename string, ts_us long, frame_len long"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return live.with_event_time(raw)


def test_complete_mode_over_several_batches_equals_the_table(spark, tmp_path):
    path, minute = str(tmp_path / "in"), 60_000_000
    for part in range(3):
        write(spark, path, [("c", (part * 7 + i) * minute, 10) for i in range(6)])
    got = live.drain(live.window_throughput(source(spark, path)))
    want = live.window_throughput(live.with_event_time(spark.read.parquet(path)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_append_mode_emits_closed_windows_and_drops_late_rows(spark, tmp_path):
    path, minute = str(tmp_path / "in"), 60_000_000
    # a row counts as late once the watermark of the batch before is past it
    for rows in ([("c", 1 * minute, 1)], [("c", 61 * minute, 1)], [("c", 63 * minute, 1)], [("c", 2 * minute, 100), ("c", 62 * minute, 1)], [("c", 99 * minute, 1)]):
        write(spark, path, rows)
    got = live.drain(live.window_throughput(source(spark, path)), mode="append")
    rows = {r["start_us"] // minute: r["bytes"] for r in got.collect()}
    assert rows[0] == 1  # the late row of window 0 is not counted
    assert 95 not in rows  # still open


def test_sessions_split_only_beyond_the_gap(spark):
    s = 1_000_000
    rows = [("c", 6, "a", "b", 1, 2, t * s, 10) for t in (0, 30, 61)]
    df = spark.createDataFrame(rows, "filename string, proto_num int, src string, dst string, sport int, dport int, ts_us long, frame_len long")
    got = live.flow_activity(live.with_event_time(df)).orderBy("first_us").collect()
    assert [(r["first_us"], r["last_us"], r["packets"]) for r in got] == [(0, 30 * s, 2), (61 * s, 61 * s, 1)]


def test_a_restart_goes_on_and_late_rows_are_counted(spark, tmp_path):
    """Four batches in three runs over one checkpoint; a row behind the watermark is dropped and told."""
    s, path, folder = 1_000_000, str(tmp_path / "in"), str(tmp_path / "run")
    schema = "filename string, proto_num int, src string, dst string, sport int, dport int, ts_us long, frame_len long"
    row = lambda t: ("c", 6, "a", "b", 1, 2, t * s, 10)
    counts, got = {}, None
    for times in ([[0, 20], [45]], [[2000, 2010]], [[10, 2030, 4000]]):
        for part in times:
            spark.createDataFrame([row(t) for t in part], schema).coalesce(1).write.mode("append").parquet(path)
        raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = live.drain(live.flow_activity(live.with_event_time(raw)), mode="append", folder=folder, counts=counts)
    assert sorted((r["first_us"] // s, r["last_us"] // s, r["packets"]) for r in got.collect()) == [(0, 45, 3), (2000, 2030, 3)]
    assert counts == {"batches": 4, "late": 1}
    assert spark.conf.get(live.MERGE_FIRST, None) in (None, "false")
