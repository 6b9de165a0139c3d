"""Readers for tool logs, summary tables, connection logs and session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import duration_group
from ..functions.numbers import lenient_int
from ..operators.ordered import attach_small

# Texts of the capture tool.
DURATION_LINE = r"Capture duration:\s+([0-9.]+)"
CUT_SHORT = (
    "appears to have been cut short in the middle of a packet",
    "will continue anyway",
)
CUT_SHORT_SHORT = "cut short in the middle of a packet"
# Columns of the two summary tables.
CAPTURE_COLUMNS = (
    "filename string, profile string, duration_label string, duration_requested_min string, run_idx string, "
    "capture_duration_s string, packets_total string, bytes_total string, mean_bps string, peak_mbps_1s string, "
    "tcp_pkts string, udp_pkts string, icmp_pkts string, other_pkts string, udp443_pkts string, tcp443_pkts string, "
    "top_udp_dport string, top_udp_dport_pkts string, top_tcp_dport string, top_tcp_dport_pkts string, "
    "capinfos_truncated string, capinfos_stderr string, totals_source string, totals_consistent string, "
    "error string, path string"
)
FLOW_COLUMNS = (
    "filename string, profile string, duration_label string, duration_requested_min string, run_idx string, "
    "capture_duration_s string, capinfos_truncated string, capinfos_stderr string, flows string, flows_per_min string, "
    "median_bytes_per_flow string, median_dur_s string, median_pkts_per_flow string, error string, path string"
)
_WHOLE = {
    "duration_requested_min", "run_idx", "packets_total", "bytes_total", "tcp_pkts", "udp_pkts", "icmp_pkts",
    "other_pkts", "udp443_pkts", "tcp443_pkts", "top_udp_dport", "top_udp_dport_pkts", "top_tcp_dport",
    "top_tcp_dport_pkts", "flows",
}
_REAL = {
    "capture_duration_s", "mean_bps", "peak_mbps_1s", "flows_per_min", "median_bytes_per_flow", "median_dur_s",
    "median_pkts_per_flow",
}
# Fields used of a connection log.
CONN_FIELDS = {
    "orig_h": "id.orig_h", "resp_h": "id.resp_h", "service": "service",
    "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes", "duration": "duration",
}
SESSION_EVENT = (
    "ts double, host string, session_id string, commands array<string>, stdout_snippet string, sftp string, "
    "syslog_sent string, icmp boolean, dns boolean, http boolean, ip string, ns string, qname string, url string, "
    "ok boolean, code int, err string, err2 string"
)


def _stripped(text: str) -> Column:
    """The text without white space, line ends included, at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def decode_tool_log(rows: DataFrame) -> DataFrame:
    """Duration, truncation and error text from (filename, exit_code, stdout, stderr).

    A failed tool is an error only when the capture is not simply cut short.
    """
    err = _stripped("stderr")
    cut = err.contains(CUT_SHORT[0]) & err.contains(CUT_SHORT[1])
    found = F.regexp_extract(F.coalesce("stdout", F.lit("")), DURATION_LINE, 1)
    code = F.col("exit_code")
    failed = (code != 0) & ~cut
    return rows.select(
        "filename",
        F.when(~failed, F.nullif(found, F.lit("")).try_cast("double")).alias("capture_duration_s"),
        cut.cast("int").alias("capinfos_truncated"),
        F.when(cut, err).otherwise("").alias("capinfos_stderr"),
        F.when(failed, F.concat(F.lit("capinfos_failed(exit="), code.cast("string"), F.lit("): "), err))
        .otherwise("").alias("error"),
    )


def _table_cells(stdout: Column, least: int) -> Column:
    """Numbers in the rows of the tool's ruled tables: for each line between bars with at least ``least`` cells, all cells by their digits (0 without)."""
    lines = F.transform(F.split(F.coalesce(stdout, F.lit("")), r"\r?\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    rows = F.transform(F.filter(lines, lambda x: x.startswith("|")), lambda x: F.split(F.trim(x, F.lit("|")), r"\|"))
    digits = lambda c: F.coalesce(F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint"), F.lit(0))
    return F.transform(F.filter(rows, lambda r: F.size(r) >= least), lambda r: F.transform(r, digits))


def _tool_error(mode: str, failed: str) -> Column:
    """Error text of a statistics run that did not end well, else empty."""
    code, err = F.col("exit_code"), _stripped("stderr")
    told = F.when(err.contains(CUT_SHORT_SHORT), f"tshark_truncated({mode})").otherwise(
        F.concat(F.lit(f"tshark_{failed}_failed(exit="), code.cast("string"), F.lit("): "), err)
    )
    return F.when(code != 0, told).otherwise("")


def decode_io_totals(rows: DataFrame) -> DataFrame:
    """Frames and bytes of a capture from (filename, exit_code, stdout, stderr) of the ``io,stat,0`` run.

    The totals stand in the last two numbers of a row of the ruled table; of several rows the
    one with most frames counts, the first of equals. A run that failed or gave no
    such row has nulls and an error.
    """
    numbers = F.transform(_table_cells(F.col("stdout"), 1), lambda r: F.filter(r, lambda v: v > 0))
    pairs = F.transform(F.filter(numbers, lambda r: F.size(r) >= 2), lambda r: F.struct(F.element_at(r, -2).alias("frames"), F.element_at(r, -1).alias("bytes")))
    none = F.lit(None).cast("struct<frames: bigint, bytes: bigint>")
    best = F.aggregate(pairs, none, lambda a, x: F.when(a.isNull() | (x["frames"] > a["frames"]), x).otherwise(a))
    known = rows.select("filename", "exit_code", "stderr", F.when(F.col("exit_code") == 0, best).alias("_best"))
    error = _tool_error("io,stat,0", "io_stat_0")
    return known.select(
        "filename", F.col("_best.frames").alias("frames"), F.col("_best.bytes").alias("bytes"),
        F.when(error != "", error).when(F.col("_best").isNull(), "tshark_io_stat_0_parse_failed").otherwise("").alias("error"),
    )


def decode_io_peaks(rows: DataFrame) -> DataFrame:
    """Largest one-second rate of a capture from the ``io,stat,1`` run: the last cell of rows with at least three."""
    last = F.transform(_table_cells(F.col("stdout"), 3), lambda r: F.element_at(r, -1))
    peak = F.when(F.col("exit_code") == 0, F.array_max(last))
    return rows.select(
        "filename", F.when(peak > 0, peak * 8.0 / 1e6).alias("peak_mbps_1s"), _tool_error("io,stat,1", "io_stat_1").alias("error")
    )


def normalise_summaries(rows: DataFrame, group_hours: bool = True) -> DataFrame:
    """Typed summary rows: empty error text, truncation 0, one label for an hour."""
    out = {}
    for c in rows.columns:
        if c in _WHOLE:
            out[c] = lenient_int(F.col(c), None)
        elif c in _REAL:
            out[c] = F.col(c).try_cast("double")
    out["error"] = F.coalesce("error", F.lit(""))
    out["capinfos_truncated"] = lenient_int(F.col("capinfos_truncated").cast("string"), 0).cast("int")
    if "totals_consistent" in rows.columns:
        out["totals_consistent"] = lenient_int(F.col("totals_consistent"), None).cast("int")
    if group_hours:
        out["duration_label"] = duration_group(F.col("duration_label"))
    return rows.withColumns(out)


def scan_summaries(spark: SparkSession, path: str | list[str], kind: str = "captures", group_hours: bool = True) -> DataFrame:
    """Read a summary table with header: ``captures`` or ``flows``."""
    schema = CAPTURE_COLUMNS if kind == "captures" else FLOW_COLUMNS
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return normalise_summaries(rows, group_hours)


def scan_conn_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated connection log.

    The columns of each file are named by its ``#fields`` line (not by its first data
    line, which would lose a row); a file without one has its first line as header.
    Unset cells (``-``) are null, cells that a short row lacks are empty text.
    """
    lines = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("conn_no"), F.col("_metadata.file_path").alias("_file")
    ).where(F.col("value") != "")
    is_header, is_note = F.col("value").startswith("#fields"), F.col("value").startswith("#")
    heads = lines.groupBy("_file").agg(
        F.min_by("value", F.when(is_header, F.col("conn_no"))).alias("_named"),
        F.min_by("value", F.when(~is_note, F.col("conn_no"))).alias("_first"),
    )
    heads = heads.select(
        "_file",
        F.coalesce(F.slice(F.split("_named", "\t"), 2, 1 << 20), F.split("_first", "\t")).alias("_header"),
        F.when(F.col("_named").isNull(), F.col("_first")).alias("_skip"),
    )
    if heads.isEmpty():
        raise ValueError(f"empty connection log: {path}")
    # one short row for each file: counted before it is sent around
    data = attach_small(lines.where(~is_note), heads, ["_file"]).where(~F.col("value").eqNullSafe(F.col("_skip")))
    cells = F.split("value", "\t", -1)

    def field(name: str) -> Column:
        place = F.array_position("_header", name).cast("int")
        cell = F.coalesce(F.get(cells, place - 1), F.lit(""))
        return F.when(place > 0, F.nullif(cell, F.lit("-")))

    return data.select("conn_no", *[field(src).alias(dst) for dst, src in CONN_FIELDS.items()])


def event_kind() -> Column:
    """Which of the six kinds a log event is."""
    kinds = {"commands": "commands", "sftp": "sftp", "syslog_sent": "syslog", "icmp": "icmp", "dns": "dns", "http": "http"}
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for c, k in kinds.items()])


def scan_session_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON-lines events of all hosts under one schema, with ``event_kind``."""
    return spark.read.schema(SESSION_EVENT).json(path).withColumn("event_kind", event_kind())
