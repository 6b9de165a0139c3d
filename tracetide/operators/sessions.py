"""Admin session results, their logs, and connection logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import lenient_float
from ..functions.text import snippet
from .ordered import exact_percentiles, top_n


def status(ok: Column, errors: Column) -> Column:
    return F.when(ok & (errors == 0), "OK").when(ok, "WARN").otherwise("FAIL")


def session_status(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One report row per session result (nested ``errors`` and ``precheck``)."""
    n = F.greatest(F.size(F.coalesce("errors", F.array())), F.lit(0))
    banner = F.coalesce("precheck.banner", F.lit(""))
    return results.select(
        "session_id", "host", "ip",
        status(F.coalesce("ok", F.lit(False)), n).alias("status"),
        "duration_s",
        n.alias("errs"),
        F.col("precheck.state").alias("precheck_state"),
        snippet(banner, 60).alias("banner"),
        *keep,
    )


def host_rollup(sessions: DataFrame, order: str = "ts") -> DataFrame:
    """Sessions per host with the last one's status, duration and error count."""
    last = F.max_by(F.struct("session_id", "status", "duration_s", "errs"), order)
    return sessions.groupBy("host").agg(F.count(F.lit(1)).alias("sessions"), last.alias("l")).select(
        "host", "sessions",
        F.col("l.session_id").alias("last_session"), F.col("l.status").alias("last_status"),
        F.col("l.duration_s").alias("last_duration_s"), F.col("l.errs").alias("last_errs"),
    )


def session_event_union(events: DataFrame, results: DataFrame) -> DataFrame:
    """Log events and session results of all hosts in one table."""
    return events.withColumn("record", F.lit("event")).unionByName(
        results.withColumn("record", F.lit("result")), allowMissingColumns=True
    )


def _unset(text: Column) -> Column:
    """Connection-log number: unset (null or ``-``) counts as 0; other text, also the empty text of a padded row, must be a number."""
    return F.when(text.isNull() | (text == "-"), 0.0).otherwise(lenient_float(text))


def conn_summary(conns: DataFrame) -> DataFrame:
    """Totals of a connection log: one row."""
    size = _unset(F.col("orig_bytes")) + _unset(F.col("resp_bytes"))
    rows = conns.select(
        F.when(F.col("resp_h") != "", F.col("resp_h")).alias("server"),
        F.when(F.col("orig_h") != "", F.col("orig_h")).alias("client"),
        size.alias("bytes"),
        _unset(F.col("duration")).alias("dur"),
    )

    def distinct(col: str) -> DataFrame:
        return rows.where(F.col(col).isNotNull()).select(col).distinct().agg(F.count(F.lit(1)).alias(f"unique_{col}s"))

    totals = rows.agg(
        F.count(F.lit(1)).alias("total_connections"),
        F.round(F.coalesce(F.sum("bytes"), F.lit(0.0)), 6).alias("total_conn_bytes"),
        F.round(F.avg("dur"), 9).alias("avg_conn_duration_s"),
    )
    med = exact_percentiles(rows, [], "dur", {"median_conn_duration_s": 0.5}).select("median_conn_duration_s")
    # four one-row tables with different columns become one row
    stacked = totals
    for part in (distinct("server"), distinct("client"), med):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def conn_top(conns: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent services, servers and clients of a connection log."""
    dims = F.create_map(
        F.lit("service"), F.coalesce("service", F.lit("-")),
        F.lit("server"), F.coalesce("resp_h", F.lit("")),
        F.lit("client"), F.coalesce("orig_h", F.lit("")),
    )
    counts = (
        conns.select(F.explode(dims).alias("dim", "value"), "conn_no")
        .where(F.col("value") != "")
        .groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"), F.min("conn_no").alias("first_no"))
    )
    return top_n(counts, ["dim"], [F.desc("n"), F.asc("first_no")], n).select("dim", "rank", "value", "n")
