"""Quality rules, planner audit and sessions on literal rows."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracetide.operators import planner_audit as pa
from tracetide.operators import quality_rules as q
from tracetide.operators import sessions

SUMMARY = "filename string, capture_duration_s double, capinfos_truncated int, totals_consistent int, error string"


def test_quality_flags(spark):
    rows = [
        ("capturaAgenteWeb5m1.pcapng", 300.0, 0, 1, ""), ("capturaAgenteWeb5m2.pcapng", 315.0, 0, 1, ""),  # bounds are inside
        ("capturaAgenteWeb5m3.pcapng", 315.1, 0, 0, ""), ("capturaAgenteWeb5m4.pcapng", 100.0, 1, 0, " x "),
        ("capturaAgenteWeb5m5.pcapng", None, 0, None, None), ("other.pcapng", 1.0, 0, 1, ""), ("capturaAgenteWeb30m1.pcapng", 1.0, 0, 0, ""),
    ]
    got = {r["filename"]: (r["severity"], r["reasons"]) for r in q.qc_flags(spark.createDataFrame(rows, SUMMARY)).collect()}
    assert got["capturaAgenteWeb5m3.pcapng"] == ("soft", "totals_consistent=0; duration_out_of_range(315.1s not in [285.0,315.0])")
    assert got["capturaAgenteWeb5m4.pcapng"] == ("hard", "capinfos_truncated=1; error=x; duration_out_of_range(100.0s not in [285.0,315.0])")
    assert got["capturaAgenteWeb30m1.pcapng"] == ("soft", "totals_consistent=0")
    assert [k for k, v in got.items() if v[0] is None] == [
        "capturaAgenteWeb5m1.pcapng", "capturaAgenteWeb5m2.pcapng", "capturaAgenteWeb5m5.pcapng", "other.pcapng",
    ]


def test_empty_report_says_none(spark):
    empty = spark.createDataFrame([], "filename string, reasons string, severity string")
    lines = [r["line"] for r in q.qc_report(empty, "t").orderBy("section", "place", "filename").collect()]
    assert lines == ["QC report for: t", "== Captures to re-capture (hard failures) ==", "None.", "== Suspicious captures (soft flags; review) ==", "None."]


def test_abort_policy(spark):
    df = spark.createDataFrame([("a", None), ("b", "boom")], "f string, e string")
    assert [r[0] for r in df.select(q.error_policy([F.col("e"), F.lit(None).cast("string")])).collect()] == ["", "boom"]
    with pytest.raises(PySparkException, match="boom"):
        df.select(q.error_policy([F.col("e")], abort=True)).collect()


def test_manifest(spark):
    full = {g: "v" for g in q.MANIFEST_GROUPS}
    rows = [{"run_id": "a", **full, "artifact_checksums": "x"}, {"run_id": "b", **full, "snapshot_id": " ", "artifact_checksums": None}]
    schema = "run_id string, " + ", ".join(f"{g} string" for g in q.MANIFEST_GROUPS) + ", artifact_checksums string"
    got = {r["run_id"]: (r["missing"], r["has_checksums"], r["complete"]) for r in q.manifest_check(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("", True, True), "b": ("snapshot_id", False, False)}


def test_cleaning(spark):
    cases = {
        '```JSON\n{"a": 1,}\n```': '{"a": 1}',
        'x {"a": [1, 2, ], } y': '{"a": [1, 2]}',
        "} {": "",  # the last closing brace stands before the first opening one
        "none": "none",
        "": "",
        "  {": "{",
        "{{}}": "{{}}",
        '{"ñ": "…"} é': '{"ñ": "…"}',
        "``` {} ```": "{}",
    }
    df = spark.createDataFrame([(r,) for r in cases], "raw string")
    got = {r[0]: r[1] for r in df.select("raw", pa.clean_output(F.col("raw"))).collect()}
    assert got == cases


def test_repair(spark):
    raws = [
        {"tipo": "buscar_google", "termino": "x", "delay": 9}, {"tipo": " Abrir_URL now", "url": "ftp://a", "delay": 99}, {"tipo": "mirar_youtube"},
        {"tipo": "usar_twitter", "delay": "12"}, {"tipo": "hack"}, {"tipo": 3}, [1], {"tipo": "", "delay": 9}, {"tipo": "buscar_google", "termino": "y", "delay": True},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)], "i int, raw string").withColumn("parsed", F.col("raw"))
    got = {r["i"]: r for r in pa.repaired(df).collect()}
    assert (got[0]["action_type"], got[0]["delay"], got[0]["was_repaired"]) == ("buscar_google", 9, False)
    assert (got[1]["action_type"], got[1]["delay"], got[1]["url"], got[1]["was_repaired"]) == ("abrir_url", 25, pa.DEFAULT_URL, True)
    assert got[2]["search"] in pa.DEFAULT_SEARCHES and got[2]["delay"] in pa.DELAY_DEFAULTS
    assert got[3]["delay"] in pa.DELAY_DEFAULTS and got[8]["delay"] == 8
    assert [got[i]["action_type"] for i in (4, 5, 6, 7)] == [None] * 4


@pytest.mark.parametrize(
    "raw,reason",
    [
        ('{"type":"search_google","termin":"latest network security incidents","delay":12}', "additional_field"),
        ('{"tipo":"search_google","termino":"weather","delay":9}', "additional_field"),
        ('{"type":"open_url","url":"https://www.wikipedia.org/","delay":8}', None),
        ('{"type":"watch_youtube","search":"computer networks lecture","delay":17}', None),
        ('{"type":"show_correo","delay":14}', "type_not_allowed"),
        ('{"type":"open_url","term":"somewhere","delay":10}', "missing_url"),
        ('{"type":"watch_youtube","delay":60}', "delay_out_of_range"),
        ('{"type":"hack_wifi","delay":10}', "type_not_allowed"),
        ('{"type":"watch_youtube","delay":1,"url":"http://a","term":"b"}', "forbidden_url_and_term"),
        ('{"type":"watch_youtube","delay":1,"url":"http://a"}', None),
        ('{"type":"use_twitter","delay":5.0}', None),
        ('{"type":"use_twitter","delay":"5"}', "delay_not_integer"),
        ('{"type":"use_twitter","delay":true}', "delay_not_integer"),
        ('{"type":"search_google","delay":5,"term":"' + "x" * 121 + '"}', "bad_term"),
        ("[]", "not_an_object"),
        ("nope", "not_json"),
        ('{"type":"use_twitter","delay":5} x', "not_json"),
        ('{"type":"use_twitter","delay":5},{"type":"use_twitter","delay":5}', "not_json"),
        ('{"type":"use_twitter","delay":5}],[1', "not_json"),
        ('{"delay":5}', "missing_type"),
    ],
)
def test_strict_schema(spark, raw, reason):
    r = pa.strict_checks(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r["valid"], r["reason"]) == (reason is None, reason)


def test_repair_of_far_numbers_nulls_and_second_values(spark):
    raws = [
        '{"tipo":"usar_twitter","delay":99999999999999999999999}', '{"tipo":"usar_twitter","delay":-99999999999999999999999}',
        '{"tipo":"buscar_google","termino":null,"delay":9}', '{"tipo":"usar_twitter","delay":9} y luego {"tipo":"abrir_url","delay":10}',
        '{"tipo":"usar_twitter","delay":9.0}',
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").withColumn("parsed", F.col("raw"))
    got = {r["i"]: r for r in pa.repaired(df).collect()}
    assert [got[i]["delay"] for i in (0, 1)] == [25, 8]
    assert got[2]["term"] is None and not got[2]["was_repaired"]
    assert got[3]["action_type"] is None and got[4]["delay"] in pa.DELAY_DEFAULTS
    assert spark.createDataFrame([(raws[3],)], "x string").select(pa.parsed_text(F.col("x"))).first()[0] is None


def test_outcomes(spark):
    rows = [("p", 1, None, False), ("p", 2, "abrir_url", True), ("q", 1, None, False), ("q", 2, None, False), ("q", 3, "abrir_url", False), ("r", 1, "usar_twitter", False)]
    df = spark.createDataFrame(rows, "prompt string, attempt long, action_type string, was_repaired boolean")
    got = {r["prompt"]: tuple(r)[1:] for r in pa.outcomes(df, 2).collect()}
    assert got == {"p": (2, "repaired", "abrir_url"), "q": (2, "fallback", None), "r": (1, "valid", "usar_twitter")}


def test_sessions(spark):
    schema = (
        "session_id string, host string, ip string, ok boolean, errors array<map<string,string>>, "
        "precheck struct<state:string,banner:string,error:string>, duration_s double, ts double"
    )
    rows = [
        ("1", "h", "i", True, [], ("open", "b" * 61, None), 1.0, 1.0), ("2", "h", "i", True, [{"exec": "x"}], None, 2.0, 3.0),
        ("3", "g", "i", False, [{"a": "b"}, {"c": "d"}], ("closed", None, "e"), 3.0, 2.0),
    ]
    df = spark.createDataFrame(rows, schema)
    st = sessions.session_status(df)
    got = {r["session_id"]: (r["status"], r["errs"], r["precheck_state"], r["banner"]) for r in st.collect()}
    assert got == {"1": ("OK", 0, "open", "b" * 60 + "…"), "2": ("WARN", 1, None, ""), "3": ("FAIL", 2, "closed", "")}
    roll = {r["host"]: tuple(r)[1:] for r in sessions.host_rollup(st.join(df.select("session_id", "ts"), "session_id")).collect()}
    assert roll == {"h": (2, "2", "WARN", 2.0, 1), "g": (1, "3", "FAIL", 3.0, 2)}
