"""Licence scans: ordered signature rules behind a keyword prefilter, overlapping detections resolved.

Everything is made of built-in functions, row by row, without a shuffle. A text without any of the gate words is done
after one look. In other texts only rules whose keyword occurs are run; matches are turned into intervals; an interval
inside another is suppressed, and of two that overlap the one with the higher priority stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.common import NON_WORD, lower_ascii, settled, shielded, table
from tracetide.llm.license_rules import GATES, Rule, rules

#: Phrases that always count, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Confidence of a phrase where no rule matched.
PHRASE_SCORE = 0.9

_FOUND = "array<struct<start:int,turned_end:int,turned_priority:int,number:int,label:string,confidence:double>>"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _padded(phrase: str) -> str:
    """Every word with a space of its own on both sides, so neighbouring phrases share none."""
    return "".join(f" {w} " for w in phrase.split())


def base_columns(docs: DataFrame) -> DataFrame:
    """`docs` with __low, n_words, n_base, first_word, last_word, base (sorted labels) of the phrases."""
    df = settled(docs, __low=lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    bare = F.trim(F.regexp_replace("__low", NON_WORD, "  "))
    df = settled(df, __bare=bare)
    df = settled(
        df,
        n_words=F.when(F.col("__bare") == "", F.lit(0)).otherwise(_spaces(F.col("__bare")) / 2 + 1).cast("long"),
        __norm=F.concat(F.lit(" "), "__bare", F.lit(" ")),
    ).drop("__bare")
    norm = F.col("__norm")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        p, k = F.lit(_padded(phrase)), len(phrase.split())
        there = F.contains(norm, p)
        counts.append(F.when(there, (F.length(norm) - F.length(F.replace(norm, p, F.lit("")))) / F.length(p)).otherwise(0))
        firsts.append(F.when(there, _spaces(F.substring_index(norm, _padded(phrase), 1)) / 2))
        lasts.append(F.when(there, F.col("n_words") - _spaces(F.substring_index(norm, _padded(phrase), -1)) / 2 - k))
        labels.append(F.when(there, F.lit(label)))
    return settled(
        df,
        n_base=sum(counts[1:], counts[0]).cast("long"),
        first_word=F.least(*firsts).cast("long"),
        last_word=F.greatest(*lasts).cast("long"),
        base=F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    ).drop("__norm")


def _rule_table(known: list[Rule]) -> Column:
    return F.array(
        *(
            F.struct(
                F.lit(r.number).alias("number"),
                F.lit(r.label).alias("label"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.confidence).alias("confidence"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(r.pattern).alias("pattern"),
            )
            for r in known
        )
    )


#: Elements that are folded at a time; the results of blocks are joined once.
_BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, start: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of at least one value, what `join` makes of `start` and all values before it.

    Blocks are folded for themselves, so the work grows far less than with the square of the number of values.
    """

    def blocks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))

    def places(parts: Column, sums: Column) -> Column:
        def inside(part: Column, b: Column) -> Column:
            begin = F.struct(F.aggregate(F.slice(sums, F.lit(1), b), start, join).alias("at"), F.array().cast("array<int>").alias("out"))
            step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
            return F.aggregate(part, begin, step, lambda acc: acc["out"])

        return F.flatten(F.transform(parts, inside))

    whole = lambda parts: _let(F.transform(parts, lambda p: F.aggregate(p, start, join)), lambda sums: places(parts, sums))
    return _let(values, lambda v: _let(blocks(v), whole))


def _intervals(low: Column, d: Column) -> Column:
    """The matches `d.m` of one rule as intervals; the pieces between matches give their places."""

    def walk(pieces: Column) -> Column:
        gaps = lambda i: F.length(F.get(pieces, i))
        sizes = F.transform(d["m"], lambda x, i: gaps(i) + F.length(x))

        def one(ends: Column) -> Column:
            def interval(x: Column, i: Column) -> Column:
                start = F.get(ends, i) + gaps(i)
                return F.struct(
                    start.alias("start"),
                    (-(start + F.length(x))).alias("turned_end"),
                    (-d["priority"]).alias("turned_priority"),
                    d["number"].alias("number"),
                    d["label"].alias("label"),
                    d["confidence"].alias("confidence"),
                )

            return F.transform(d["m"], interval)

        return _let(_before(sizes, F.lit(0), lambda a, b: a + b), one)

    return _let(F.split(low, d["pattern"], -1), walk)


def detections(df: DataFrame, known: list[Rule]) -> DataFrame:
    """`df` (with __low) with `found`: the detections that are left, as (start, -end, -priority, number, label, confidence).

    start and end are places of code points in the lower-cased text.
    """
    low = F.col("__low")
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains(low, F.lit(word))
    tried = F.transform(
        F.filter(_rule_table(known), lambda r: F.contains(low, r["keyword"])),
        lambda r: F.struct(
            r["number"].alias("number"),
            r["label"].alias("label"),
            r["priority"].alias("priority"),
            r["confidence"].alias("confidence"),
            r["pattern"].alias("pattern"),
            F.regexp_extract_all(low, r["pattern"], F.lit(0)).alias("m"),
        ),
    )
    matched = F.filter(tried, lambda d: F.size(d["m"]) > 0)
    everything = F.flatten(F.transform(matched, lambda d: _intervals(low, d)))
    # by start, longest first: an interval lies inside an earlier one if it does not reach beyond all of them
    df = settled(df, __all=F.when(gate, F.array_sort(everything)).otherwise(F.array().cast(_FOUND)))
    some = F.col("__all")
    ends = F.transform(some, lambda d: -d["turned_end"])
    df = settled(df, __reach=F.when(F.size(some) > 0, _before(ends, F.lit(-1), lambda a, b: F.greatest(a, b))))
    outer = F.filter("__all", lambda d, i: -d["turned_end"] > F.get("__reach", i))
    df = settled(df, __outer=outer).drop("__all", "__reach")
    rank = ("turned_priority", "number")

    def stays(d: Column, i: Column) -> Column:
        row = F.col("__outer")
        before, after = F.get(row, i - 1), F.get(row, i + 1)
        own = F.struct(*(d[c] for c in rank))
        lost = (i > 0) & (-before["turned_end"] > d["start"]) & (F.struct(*(before[c] for c in rank)) < own)
        lost = lost | ((i + 1 < F.size(row)) & (-d["turned_end"] > after["start"]) & (F.struct(*(after[c] for c in rank)) < own))
        return ~F.coalesce(lost, F.lit(False))

    return settled(df, found=F.filter("__outer", stays)).drop("__outer", "__low")


def scanned(docs: DataFrame, known: list[Rule] | None = None) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score and found.

    Null text is empty: no words, no labels, score 0, first and last word null. score is the highest confidence of what
    was found. Columns of `docs` that are named like results give way, other names may be anything; equal rows give equal
    results, an empty table gives an empty one. The time for a text is nearly linear in its length and its matches.
    """
    docs, named = shielded(docs)
    docs = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found", "base")
    df = detections(base_columns(docs), known or rules())
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("found", lambda d: d["label"]), F.col("base"))))
    best = F.array_max(F.transform("found", lambda d: d["confidence"]))
    found = df.select(
        *docs.columns, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.greatest(best, F.when(F.size("base") > 0, F.lit(PHRASE_SCORE))), F.lit(0.0)).alias("score"),
        "found",
    )
    return named(found)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scanned(docs).drop("text", "found")


def _rows(values: list[tuple]) -> str:
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in values)
    return f"(VALUES {text})"


#: The same rows in DuckDB.
SQL = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), w AS (
  SELECT doc_id, low, regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM d
), phrase AS (
  SELECT string_split(p, ' ') AS p, label FROM {_rows(list(PHRASES))} t(p, label)
), base AS (
  SELECT doc_id, i - 1 AS place, label
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0) JOIN phrase ON ws[i] = p[1] AND ws[i:i + len(p) - 1] = p
), b AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels
  FROM base GROUP BY doc_id
), r AS (
  SELECT * FROM {_rows([(r.number, r.label, r.priority, r.confidence, r.keyword, r.pattern) for r in rules()])}
    t(number, label, priority, confidence, keyword, pattern)
), m AS (
  SELECT doc_id, number, label, priority, confidence, regexp_extract_all(low, pattern) AS m, string_split_regex(low, pattern) AS p
  FROM d JOIN r ON contains(low, keyword) AND regexp_matches(low, pattern)
  WHERE {" OR ".join(f"contains(low, '{g}')" for g in GATES)}
), iv AS (
  SELECT doc_id, number, label, priority, confidence,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
         length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)
), o AS (
  SELECT *, s + n AS e FROM iv
), kept AS (
  SELECT * FROM (
    SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, priority DESC, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o)
  WHERE reach IS NULL OR e > reach
), near AS (
  SELECT *, lag(e) OVER v AS pe, lag(priority) OVER v AS pp, lag(number) OVER v AS pn,
         lead(s) OVER v AS ns, lead(priority) OVER v AS np, lead(number) OVER v AS nn
  FROM kept WINDOW v AS (PARTITION BY doc_id ORDER BY s)
), left_over AS (
  SELECT * FROM near
  WHERE NOT coalesce(pe > s AND (pp > priority OR pp = priority AND pn < number), false)
    AND NOT coalesce(e > ns AND (np > priority OR np = priority AND nn < number), false)
), f AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(confidence) AS best FROM left_over GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(f.labels, []), coalesce(b.labels, [])))), ',') AS labels,
       CAST(coalesce(greatest(best, CASE WHEN b.labels IS NOT NULL THEN {PHRASE_SCORE} END), 0) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""
