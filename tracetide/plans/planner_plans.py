"""Registered queries over planner outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import planner_audit as pa
from ..sources.adapter import table

_FENCE = "```"


def _quote(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N} ]", "")


def raw_outputs(spark, sf) -> DataFrame:
    """Conversation turns as planner answers: good ones, sloppy ones, and plain text."""
    turns = table(spark, sf, "conversations")
    r = F.char_length("text") % 9
    kind = F.element_at(F.array(*map(F.lit, pa.RUNTIME_TYPES + ("hackear_wifi",))), (F.col("conv_id") % 7 + 1).cast("int"))
    word = F.when(F.char_length("text") % 4 == 0, "").otherwise(_quote(F.col("text")))
    delay = ((F.char_length("text") * 7) % 41).cast("string")
    body = F.concat(
        F.lit('{"tipo": "'), kind, F.lit('", "termino": "'), word, F.lit('", "url": "'),
        F.when(F.char_length("text") % 3 == 0, "https://a.test/x").otherwise("a.test"),
        F.lit('", "busqueda": "'), word, F.lit('", "delay": '), delay,
    )
    raw = (
        F.when(r == 0, F.concat(body, F.lit("}")))
        .when(r == 1, F.concat(F.lit(f"{_FENCE}json\n"), body, F.lit(f"}}\n{_FENCE}")))
        .when(r == 2, F.concat(F.lit("Claro: "), body, F.lit(",\n}. Listo")))
        .when(r == 3, F.replace(F.concat(body, F.lit("}")), F.lit('"'), F.lit("'")))
        .when(r == 4, F.concat(F.lit('{"tipo": "  '), F.upper(kind), F.lit(' ahora"}')))
        .when(r == 5, F.concat(F.lit('{"type": "open_url", "delay": '), delay, F.lit(', "url": "https://b.test"}')))
        .when(r == 6, F.concat(F.lit('{"tipo": "'), kind, F.lit('", "delay": "12"')))
        .when((r == 7) & (F.col("conv_id") % 2 == 0), F.concat(body, F.lit("} y luego {"), body.substr(2, 1 << 20), F.lit("}")))
        .when(r == 7, "} {")
        .otherwise(F.col("text"))
    )
    return turns.select("conv_id", "turn", raw.alias("raw"))


_TYPES = "['" + "', '".join(pa.RUNTIME_TYPES + ("hackear_wifi",)) + "']"
RAW = r"""
t AS (SELECT conv_id, turn, text, length(text) % 9 AS r, """ + _TYPES + r"""[conv_id % 7 + 1] AS kind,
   CASE WHEN length(text) % 4 = 0 THEN '' ELSE regexp_replace(text, '[^\p{L}\p{N} ]', '', 'g') END AS word, ((length(text) * 7) % 41)::VARCHAR AS d FROM conversations),
b AS (SELECT *, '{"tipo": "' || kind || '", "termino": "' || word || '", "url": "' || CASE WHEN length(text) % 3 = 0 THEN 'https://a.test/x' ELSE 'a.test' END
   || '", "busqueda": "' || word || '", "delay": ' || d AS body FROM t),
raws AS (SELECT conv_id, turn, CASE r WHEN 0 THEN body || '}' WHEN 1 THEN '```json' || chr(10) || body || '}' || chr(10) || '```' WHEN 2 THEN 'Claro: ' || body || ',' || chr(10) || '}. Listo'
   WHEN 3 THEN replace(body || '}', '"', '''') WHEN 4 THEN '{"tipo": "  ' || upper(kind) || ' ahora"}' WHEN 5 THEN '{"type": "open_url", "delay": ' || d || ', "url": "https://b.test"}'
   WHEN 6 THEN '{"tipo": "' || kind || '", "delay": "12"' WHEN 7 THEN CASE WHEN conv_id % 2 = 0 THEN body || '} y luego {' || substring(body, 2) || '}' ELSE '} {' END ELSE text END AS raw FROM b),
bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '(?i)^```(?:json)?\s*', ''), '\s*```$', '') AS x FROM raws),
cut AS (SELECT *, CASE WHEN strpos(x, '{') > 0 AND strpos(x, '}') > 0 THEN
   CASE WHEN length(x) - strpos(reverse(x), '}') + 1 >= strpos(x, '{') THEN substring(x, strpos(x, '{'), length(x) - strpos(reverse(x), '}') + 2 - strpos(x, '{')) ELSE '' END ELSE x END AS y FROM bare),
cleans AS (SELECT conv_id, turn, raw, regexp_replace(regexp_replace(y, ',\s*([}\]])', '\1', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM cut)"""
PARSED = RAW + """,
parsed AS (SELECT *, CASE WHEN cleaned <> '' AND json_valid(cleaned) THEN cleaned WHEN cleaned <> '' AND json_valid(replace(cleaned, '''', '"')) THEN replace(cleaned, '''', '"') END AS parsed FROM cleans)"""


def _list(values) -> str:
    return "['" + "', '".join(values) + "']"


REPAIRED = PARSED + r""",
j AS (SELECT *, CASE WHEN json_type(parsed) = 'OBJECT' AND json_type(parsed, '$.tipo') = 'VARCHAR' THEN json_extract_string(parsed, '$.tipo') END AS tipo FROM parsed),
k AS (SELECT *, lower(regexp_extract(tipo, '^\s*(\S+)', 1)) AS w FROM j),
typed AS (SELECT *, CASE WHEN w IN ('""" + "', '".join(pa.RUNTIME_TYPES) + r"""') THEN w END AS action_type,
   CASE WHEN json_type(parsed, '$.delay') IN ('BIGINT', 'UBIGINT') THEN json_extract(parsed, '$.delay')::BIGINT END AS given FROM k),
fill AS (SELECT *, coalesce(trim(json_extract_string(parsed, '$.termino')), '') = '' AND action_type = 'buscar_google' AS te,
   NOT starts_with(coalesce(trim(json_extract_string(parsed, '$.url')), ''), 'http') AND action_type = 'abrir_url' AS ub,
   coalesce(trim(json_extract_string(parsed, '$.busqueda')), '') = '' AND action_type = 'mirar_youtube' AS se FROM typed),
repaired AS (SELECT conv_id, turn, action_type, CASE WHEN action_type IS NOT NULL THEN greatest(8, least(25, coalesce(given, [10, 11, 12][length(raw) % 3 + 1]))) END AS delay,
   CASE WHEN te THEN """ + _list(pa.DEFAULT_TERMS) + r"""[length(raw) % 3 + 1] WHEN action_type IS NOT NULL THEN json_extract_string(parsed, '$.termino') END AS term,
   CASE WHEN ub THEN '""" + pa.DEFAULT_URL + r"""' WHEN action_type IS NOT NULL THEN json_extract_string(parsed, '$.url') END AS url,
   CASE WHEN se THEN """ + _list(pa.DEFAULT_SEARCHES) + r"""[length(raw) % 3 + 1] WHEN action_type IS NOT NULL THEN json_extract_string(parsed, '$.busqueda') END AS search,
   action_type IS NOT NULL AND (given IS NULL OR given NOT BETWEEN 8 AND 25 OR te OR ub OR se OR w <> tipo) AS was_repaired FROM fill)"""
OUTCOMES = REPAIRED + """,
a AS (SELECT {'c': conv_id, 'p': turn // 2} AS prompt, turn % 2 + 1 AS attempt, action_type, was_repaired FROM repaired),
f AS (SELECT prompt, min(attempt) FILTER (WHERE action_type IS NOT NULL) AS good, count(*) AS tries, arg_min(action_type, attempt) FILTER (WHERE action_type IS NOT NULL) AS action_type,
   arg_min(was_repaired, attempt) FILTER (WHERE action_type IS NOT NULL) AS rep FROM a GROUP BY 1),
o AS (SELECT coalesce(good, tries) AS attempts, CASE WHEN good IS NULL THEN 'fallback' WHEN rep THEN 'repaired' ELSE 'valid' END AS outcome, action_type FROM f)
SELECT outcome, action_type, count(*) AS prompts, sum(attempts)::BIGINT AS attempts FROM o GROUP BY 1, 2"""


def _parsed(spark, sf):
    rows = raw_outputs(spark, sf).withColumn("cleaned", pa.clean_output(F.col("raw")))
    return rows.withColumn("parsed", pa.parsed_text(F.col("cleaned")))


def planner_clean(spark, sf):
    return raw_outputs(spark, sf).select("conv_id", "turn", pa.clean_output(F.col("raw")).alias("cleaned"))


def planner_parse(spark, sf):
    return _parsed(spark, sf).select("conv_id", "turn", "parsed")


def _repaired(spark, sf):
    return pa.repaired(_parsed(spark, sf)).select("conv_id", "turn", "action_type", "delay", "term", "url", "search", "was_repaired")


def planner_outcomes(spark, sf):
    """Every two turns in a row of a conversation are the tries of one prompt."""
    prompt = F.struct("conv_id", F.floor(F.col("turn") / 2).alias("part"))
    tries = _repaired(spark, sf).select(
        prompt.alias("prompt"), (F.col("turn") % 2 + 1).alias("attempt"), "action_type", "was_repaired"
    )
    return pa.outcome_counts(pa.outcomes(tries, 2))


def strict_outputs(spark, sf) -> DataFrame:
    """Answers in the published schema, many with one fault."""
    r = F.char_length("text") % 12
    kind = F.element_at(F.array(*map(F.lit, pa.SCHEMA_TYPES + ("hack_wifi",))), (F.col("conv_id") % 7 + 1).cast("int"))
    head = F.concat(F.lit('{"type": "'), kind, F.lit('"'))
    delay = F.concat(F.lit(', "delay": '), (F.char_length("text") % 30).cast("string"))
    raw = (
        F.when(r == 0, F.concat(head, F.lit("}")))
        .when(r == 1, F.concat(head, delay, F.lit(', "term": ""}')))
        .when(r == 2, F.concat(head, delay, F.lit(', "term": "x", "url": "https://c.test"}')))
        .when(r == 3, F.concat(head, delay, F.lit(', "url": "ftp://c.test"}')))
        .when(r == 4, F.concat(head, F.lit(', "delay": 3.5}')))
        .when(r == 5, F.concat(head, delay, F.lit(', "extra": 1}')))
        .when(r == 6, F.concat(F.lit("["), delay.substr(3, 100), F.lit("]")))
        .when(r == 7, F.concat(head, delay, F.lit(', "url": "https://c.test"}')))
        .when(r == 8, F.concat(head, delay, F.lit(', "search": "'), _quote(F.col("text")), F.lit('"}')))
        .when(r == 9, "[1, 2]")
        .when(r == 10, F.concat(head, delay, F.lit(', "term": "x"} and more')))
        .otherwise(F.concat(head, delay, F.lit(', "term": "latest news"}')))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))


def planner_repeated(spark, sf):
    """Answers that give keys twice, some with text behind them: the last value holds."""
    n = F.char_length("text")
    kind = F.element_at(F.array(*map(F.lit, pa.RUNTIME_TYPES + ("hackear_wifi",))), (F.col("conv_id") % 7 + 1).cast("int"))
    raw = F.concat(
        F.lit('{"tipo": 5, "delay": 99, "termino": "a", "tipo": "'), kind, F.lit('", "url": "https://a.test", "busqueda": "b", "delay": '), (n % 41).cast("string"),
        F.when(n % 5 == 0, '} {"tipo": 1}').when(n % 5 == 1, ', "termino": "c"').otherwise("}"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))
    rows = rows.withColumn("parsed", pa.parsed_text(F.col("raw")))
    return pa.repaired(rows).select("conv_id", "turn", "action_type", "delay", "term", "url", F.col("parsed").isNotNull().alias("is_json"))


REPEATED = "WITH t AS (SELECT conv_id, turn, length(text) AS n, ['" + "', '".join(pa.RUNTIME_TYPES + ("hackear_wifi",)) + """'][conv_id % 7 + 1] AS kind FROM conversations),
u AS (SELECT *, CASE WHEN n % 5 > 1 AND kind <> 'hackear_wifi' THEN kind END AS action_type FROM t)
SELECT conv_id, turn, action_type, CASE WHEN action_type IS NOT NULL THEN greatest(8, least(25, n % 41)) END AS delay, CASE WHEN action_type IS NOT NULL THEN 'a' END AS term,
  CASE WHEN action_type IS NOT NULL THEN 'https://a.test' END AS url, n % 5 > 1 AS is_json FROM u"""


def planner_strict(spark, sf):
    return pa.strict_checks(strict_outputs(spark, sf)).select("conv_id", "turn", "valid", "reason")


STRICT = r"""
WITH t AS (SELECT conv_id, turn, length(text) % 12 AS r, (length(text) % 30) AS d, ['""" + "', '".join(pa.SCHEMA_TYPES + ("hack_wifi",)) + r"""'][conv_id % 7 + 1] AS k,
  length(regexp_replace(text, '[^\p{L}\p{N} ]', '', 'g')) AS n FROM conversations),
u AS (SELECT *, CASE WHEN k = 'hack_wifi' THEN 'type_not_allowed' WHEN r <> 4 AND d > 25 THEN 'delay_out_of_range' END AS c FROM t)
SELECT conv_id, turn, reason IS NULL AS valid, reason FROM (SELECT conv_id, turn, CASE
  WHEN r IN (6, 10) THEN 'not_json' WHEN r = 9 THEN 'not_an_object' WHEN r = 5 THEN 'additional_field' WHEN r = 0 THEN 'missing_delay'
  WHEN c = 'type_not_allowed' THEN c WHEN r = 4 THEN 'delay_not_integer' WHEN c IS NOT NULL THEN c
  WHEN r = 1 THEN 'bad_term' WHEN r = 3 THEN 'bad_url' WHEN r = 8 AND n NOT BETWEEN 1 AND 120 THEN 'bad_search'
  WHEN k = 'search_google' AND r IN (3, 7, 8) THEN 'missing_term' WHEN k = 'search_google' AND r = 2 THEN 'forbidden_url'
  WHEN k = 'open_url' AND r NOT IN (2, 7) THEN 'missing_url' WHEN k = 'open_url' AND r = 2 THEN 'forbidden_term'
  WHEN k = 'watch_youtube' AND r = 2 THEN 'forbidden_url_and_term' END AS reason FROM u)"""

QUERIES = {
    "planner_repeated_keys": (planner_repeated, REPEATED),
    "planner_clean": (planner_clean, "WITH " + RAW + " SELECT conv_id, turn, cleaned FROM cleans"),
    "planner_parse": (planner_parse, "WITH " + PARSED + " SELECT conv_id, turn, parsed FROM parsed"),
    "planner_repair": (_repaired, "WITH " + REPAIRED + " SELECT * FROM repaired"),
    "planner_strict": (planner_strict, STRICT),
    "planner_outcomes": (planner_outcomes, "WITH " + OUTCOMES),
}
