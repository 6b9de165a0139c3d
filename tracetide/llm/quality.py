"""Quality rules whose cutoffs come from quantile sketches of each language and source.

Everything is made of built-in functions. The base measures are exact; the cutoffs are fences around the quartiles of
the documents that pass the base rules. Sketches are built per (language, source), so a source with a third of all rows
is summed up before the shuffle, and the sketches of a language are merged where one of its sources is too small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.common import BLANK_RUN, BLANKS, settled, shielded, staged, table

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fence:
    """A measure and its fences: quartile -/+ reach * max(quartile distance, spread)."""

    name: str
    spread: int
    low: bool = False
    high: bool = True


#: Measures in thousandths (shares of words or lines) or hundredths (letters a word).
FENCES = (
    Fence("symbol_rate", 10),
    Fence("dup_line_rate", 100),
    Fence("repeat_rate", 100),
    Fence("word_length", 60, low=True),
)
REACH = 4
#: Groups with fewer documents take the cutoffs of their language, and tiny languages those of all documents.
MIN_DOCS = 30
#: With k = 4,096 a sketch ranks to about 0.1 %, and up to so many values it is exact.
SKETCH_K = 4096


def measures(docs: DataFrame) -> DataFrame:
    """All of `docs` with the base columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or blank text has zeros throughout and fails. Three-word windows are compared by a 64-bit hash inside their
    own text only. Helper columns start with two underscores.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.trim(text, F.lit(BLANKS))
    df = settled(
        docs,
        __words=F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN)),
        __lines=F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != ""),
        n_symbols=(F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long"),
    )
    words = F.col("__words")
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    df = settled(
        df,
        n_words=F.size(words).cast("long"),
        word_chars=F.length(F.array_join(words, "")).cast("long"),
        __n_lines=F.size("__lines").cast("long"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        __windows=windows,
    ).drop("__words", "__lines")
    # windows side by side once sorted: equal neighbours are repeats; most texts have none
    pairs = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = settled(
        df, __order=F.when(F.size("__windows") > F.size(F.array_distinct("__windows")), F.sort_array(pairs))
    ).drop("__windows")
    order = F.col("__order")
    repeats = F.filter(
        F.transform(
            order,
            lambda x, i: F.when(
                ((i > 0) & (F.get(order, i - 1)["h"] == x["h"]))
                | ((i + 1 < F.size(order)) & (F.get(order, i + 1)["h"] == x["h"])),
                x["i"],
            ).otherwise(F.lit(-1)),
        ),
        lambda p: p >= 0,
    )
    covered = F.array_distinct(F.flatten(F.transform(repeats, lambda p: F.array(p, p + 1, p + 2))))
    df = settled(
        df, n_repeat_words=F.when(order.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long")
    ).drop("__order")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _rates(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("__n_lines"), F.lit(1))
    return df.withColumns(
        {
            "__symbol_rate": F.floor(1000 * F.col("n_symbols") / words),
            "__dup_line_rate": F.floor(1000 * F.col("n_dup_lines") / lines),
            "__repeat_rate": F.floor(1000 * F.col("n_repeat_words") / words),
            "__word_length": F.floor(100 * F.col("word_chars") / words),
        }
    )


def sketches(rated: DataFrame) -> DataFrame:
    """One row for each language and source: a quantile sketch of every measure over documents that pass the base rules.

    The table can be stored, and sketches of later data merged into it.
    """
    good = ~F.col("base_failed")
    return rated.groupBy("__lang", "__source").agg(
        F.count(F.when(good, 1)).alias("__n"),
        *(F.kll_sketch_agg_bigint(F.when(good, F.col(f"__{f.name}")), SKETCH_K).alias(f"__{f.name}") for f in FENCES),
    )


def _cut(sketch: Column, fence: Fence, reach: int) -> list[Column]:
    some = F.kll_sketch_get_n_bigint(sketch) > 0
    q1, q3 = (F.when(some, F.kll_sketch_get_quantile_bigint(sketch, F.lit(q))) for q in (0.25, 0.75))
    slack = reach * F.greatest(q3 - q1, F.lit(fence.spread))
    return [
        (q1 - slack if fence.low else F.lit(None).cast("long")).alias(f"__{fence.name}_low"),
        (q3 + slack if fence.high else F.lit(None).cast("long")).alias(f"__{fence.name}_high"),
    ]


def thresholds(parts: DataFrame, reach: int = REACH, min_docs: int = MIN_DOCS) -> DataFrame:
    """Cutoffs of each language and source from the table of sketches; small groups use merged sketches."""
    merged = [F.sum("__n").alias("__n"), *(F.kll_merge_agg_bigint(f"__{f.name}").alias(f"__{f.name}") for f in FENCES)]
    parts = staged(parts, "quality-sketches")
    by_lang = parts.groupBy("__lang").agg(*merged)
    total = parts.agg(*merged).first()  # one row of bounded size
    wide = parts.alias("s").join(by_lang.alias("l"), F.col("s.__lang").eqNullSafe(F.col("l.__lang")))
    pick = [
        F.when(F.col("s.__n") >= min_docs, F.col(f"s.__{f.name}"))
        .when(F.col("l.__n") >= min_docs, F.col(f"l.__{f.name}"))
        .otherwise(F.lit(total[f"__{f.name}"]))
        .alias(f"__{f.name}")
        for f in FENCES
    ]
    chosen = wide.select(F.col("s.__lang").alias("__lang_cut"), F.col("s.__source").alias("__source_cut"), *pick)
    return chosen.select("__lang_cut", "__source_cut", *(c for f in FENCES for c in _cut(F.col(f"__{f.name}"), f, reach)))


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged(docs: DataFrame, keep: tuple[str, ...] | None = None, reach: int = REACH, min_docs: int = MIN_DOCS) -> DataFrame:
    """Columns `keep` of `docs` (default: all) with the base columns and `kept`.

    kept is false if base_failed, or if a measure lies beyond a fence of the document's language and source. Null
    languages and sources are groups of their own; equal rows get equal verdicts. A column of `docs` that is named like
    a result gives way to it; other names may be anything. An empty table gives an empty result. The measures are written once to the shared folder;
    the cutoffs are taken from those files and joined to them.
    """
    docs = docs.drop(*RESULTS) if keep is None else docs.select(*dict.fromkeys((*keep, "text", "lang", "source")))
    docs, named = shielded(docs)
    keep = docs.columns if keep is None else docs.columns[: len(keep)]
    groups = {f"__{c}": F.col(c).cast("string") for c in ("lang", "source")}
    df = _rates(measures(docs.withColumns(groups)))
    df = staged(df.drop("__n_lines", *(c for c in docs.columns if c not in keep)), "quality-measures")
    cuts = staged(thresholds(sketches(df), reach, min_docs), "quality-cuts")
    df = df.join(
        cuts, F.col("__lang").eqNullSafe(F.col("__lang_cut")) & F.col("__source").eqNullSafe(F.col("__source_cut")), "left"
    )
    inside = F.lit(True)
    for f in FENCES:
        value = F.col(f"__{f.name}")
        inside = inside & F.coalesce(value >= F.col(f"__{f.name}_low"), F.lit(True))
        inside = inside & F.coalesce(value <= F.col(f"__{f.name}_high"), F.lit(True))
    return named(df.select(*keep, *RESULTS[:-1], (~F.col("base_failed") & inside).alias("kept")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict for every document."""
    return judged(table(spark, sf_dir, "documents"), keep=("doc_id",))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep."""
    return judged(docs).where("kept").select(*docs.columns)



def _q(column: str, share: float) -> str:
    return f"quantile_disc({column}, {share})"


_COLS = [f.name for f in FENCES]
#: The same rows in DuckDB. Sketches of up to SKETCH_K values are exact, as are these quantiles.
SQL = f"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         row_number() OVER () AS rid
  FROM documents
), grams AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), again AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1)
  GROUP BY rid
), m AS (
  SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, greatest(len(lines), 1) AS n_lines
  FROM w LEFT JOIN again USING (rid)
), r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * n_dup_lines // n_lines AS dup_line_rate,
         1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 100 * word_chars // greatest(n_words, 1) AS word_length
  FROM m
), s AS (
  SELECT lang, source, count(*) AS n, {", ".join(f"{_q(c, .25)} AS {c}_1, {_q(c, .75)} AS {c}_3" for c in _COLS)}
  FROM r WHERE NOT base_failed GROUP BY lang, source
), l AS (
  SELECT lang, count(*) AS n, {", ".join(f"{_q(c, .25)} AS {c}_1, {_q(c, .75)} AS {c}_3" for c in _COLS)}
  FROM r WHERE NOT base_failed GROUP BY lang
), a AS (
  SELECT {", ".join(f"{_q(c, .25)} AS {c}_1, {_q(c, .75)} AS {c}_3" for c in _COLS)} FROM r WHERE NOT base_failed
), cut AS (
  SELECT s.lang, s.source, {", ".join(
      f"CASE WHEN s.n >= {MIN_DOCS} THEN s.{c}_{k} WHEN l.n >= {MIN_DOCS} THEN l.{c}_{k} ELSE a.{c}_{k} END AS {c}_{k}"
      for c in _COLS for k in (1, 3))}
  FROM s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(
           f"{f.name} <= {f.name}_3 + {REACH} * greatest({f.name}_3 - {f.name}_1, {f.spread})"
           + (f" AND {f.name} >= {f.name}_1 - {REACH} * greatest({f.name}_3 - {f.name}_1, {f.spread})" if f.low else "")
           for f in FENCES)}, true) AS kept
FROM r LEFT JOIN cut ON r.lang IS NOT DISTINCT FROM cut.lang AND r.source IS NOT DISTINCT FROM cut.source
"""
