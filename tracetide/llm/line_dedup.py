"""Removal of passages that repeat earlier ones, found as windows of three lines.

Lines with a character besides white space are numbered within their text, and every three in a row make a window. The
first occurrence of a window in order of (doc_id, position) stays; what later occurrences cover is merged and removed.
Blank lines take no part and stay. Built-in functions only: windows are counted before and in the shuffle, and the join
that finds later occurrences has plain equality keys, so Spark can split a window that a third of all rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracetide.llm.common import BLANKS, settled, shielded, table

WINDOW = 3


def _lines(text: Column) -> Column:
    """The lines of a text with their places: (line, place), blank lines left out."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("place")))
    return F.filter(numbered, lambda s: F.trim(s["line"], F.lit(BLANKS)) != "")


def window_rows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, th, pos, h1, h2): the windows of every text with an id; th stands for the text.

    A window is known by 96 bits of hash over its lines with their line breaks.
    """
    df = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id",
        F.xxhash64("text").alias("th"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "").alias("lines"),
    )
    df = settled(df, l=F.when(F.size("lines") >= size, F.col("lines")).otherwise(F.array().cast("array<string>")))
    lines = F.col("l")
    windows = F.transform(
        F.slice(lines, F.lit(1), F.greatest(F.size(lines) - (size - 1), F.lit(0))),
        lambda x, i: F.struct(
            F.xxhash64(x, *(F.get(lines, i + k) for k in range(1, size))).alias("h1"),
            F.hash(x, *(F.get(lines, i + k) for k in range(1, size))).alias("h2"),
        ),
    )
    return df.select("doc_id", "th", F.posexplode(windows).alias("pos", "w")).select(
        "doc_id", "th", "pos", "w.h1", "w.h2"
    )


def removed_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, th, spans): intervals of line numbers (blank lines not counted) that repeat earlier windows.

    Where a window repeats within its own text, the lines of the first occurrence stay whole.
    """
    rows = window_rows(docs, size)
    firsts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("d"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = rows.join(firsts.drop("n"), ["h1", "h2"])
    # from here on only repeated windows are left; all that follows needs one exchange by document
    seen = seen.repartition("doc_id")
    first_pos = F.min("pos").over(W.partitionBy("doc_id", "h1", "h2"))
    seen = seen.withColumn("f", first_pos).where("doc_id > d OR pos > f")
    begin = F.when(F.col("doc_id") == F.col("d"), F.greatest("pos", F.col("f") + size)).otherwise(F.col("pos"))
    return seen.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct(begin.alias("a"), (F.col("pos") + (size - 1)).alias("b"))).alias("spans")
    )


def deduplicated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """`docs` with the text after removal, and n_lines (not blank) and n_removed.

    Order is that of doc_id; rows with equal id and text count as one document, and so do windows of rows that share an
    id with other text (the smallest position is first). A row without id, text or three lines passes unchanged; null
    text has zero lines. A text that loses all its lines becomes empty, or the blank lines it had. Columns of `docs` that
    are named n_lines or n_removed give way; other names may be anything. An empty table gives an empty result.
    """
    docs, named = shielded(docs.drop("n_lines", "n_removed"))
    own = docs.columns
    spans = removed_spans(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), size)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    df = docs.withColumn("__th2", F.xxhash64(F.col("text").cast("string")))
    df = df.join(spans, (F.col("doc_id") == F.col("__id")) & (F.col("__th2") == F.col("__th")), "left")
    covered = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["a"], s["b"]))))
    df = settled(
        df,
        __gone=covered,
        n_lines=F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")), F.lit(0)).cast("long"),
        __places=F.when(F.col("__spans").isNotNull(), F.transform(_lines(F.col("text")), lambda s: s["place"])),
        __split=F.when(F.col("__spans").isNotNull(), F.split("text", "\n")),
    )
    # numbers among the lines that are not blank -> places among all lines -> the places that stay
    df = settled(df, __drop=F.transform("__gone", lambda i: F.get("__places", i)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__split") - 1), F.col("__drop"))
    df = settled(df, __stay=F.when(F.col("__spans").isNotNull(), stay))
    kept = F.transform("__stay", lambda i: F.get("__split", i))
    found = df.select(
        *(
            F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")
            if c == "text"
            else F.col(c)
            for c in own
        ),
        "n_lines",
        F.coalesce(F.when(F.col("__spans").isNotNull(), F.size("__gone")), F.lit(0)).cast("long").alias("n_removed"),
    )
    return named(found)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after removal."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "text", "n_lines", "n_removed")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts after removal, n_chars brought up to date; a text with nothing left goes."""
    found = deduplicated(docs)
    left = F.trim(F.col("text"), F.lit(BLANKS)) != ""
    found = found.where((F.col("n_removed") == 0) | left)
    length = F.length("text").cast("long")
    return found.select(*(length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


#: The same rows in DuckDB, windows compared as text.
SQL = f"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), n AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos, place, line FROM (
    SELECT doc_id, unnest(range(0, len(ls))) AS place, unnest(ls) AS line FROM l)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), w AS (
  SELECT doc_id, pos, {" || chr(10) || ".join(["line"] + [f"lead(line, {k}) OVER o" for k in range(1, WINDOW)])} AS win
  FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), f AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) AS d, min(pos) OVER (PARTITION BY win, doc_id) AS f
  FROM w WHERE win IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = d THEN greatest(pos, f + {WINDOW}) ELSE pos END, pos + {WINDOW})) AS pos
  FROM f WHERE doc_id > d OR pos > f
), gone AS (
  SELECT n.doc_id, n.place FROM n JOIN g USING (doc_id, pos)
), kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.place) AS text
  FROM (SELECT doc_id, unnest(range(0, len(ls))) AS place, unnest(ls) AS line FROM l) a
  LEFT JOIN gone ON a.doc_id = gone.doc_id AND a.place = gone.place WHERE gone.place IS NULL GROUP BY a.doc_id
)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST((SELECT count(*) FROM n WHERE n.doc_id = l.doc_id) AS BIGINT) AS n_lines,
       CAST((SELECT count(*) FROM gone WHERE gone.doc_id = l.doc_id) AS BIGINT) AS n_removed
FROM l LEFT JOIN kept USING (doc_id)
"""
