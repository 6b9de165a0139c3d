"""Registered corpus queries against DuckDB on whole tables and on odd rows."""

import math

import duckdb
import pytest

from tracetide.llm.plans import QUERIES


def rows(names, values):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in values), key=repr)


def twin(sql, sf_dir):
    with duckdb.connect() as con:
        for name in ("documents", "benchmark", "labels"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet{'/*.parquet' if 'odd' in sf_dir else ''}'")
        found = con.execute(sql)
        return rows([c[0] for c in found.description], found.fetchall())


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory, odd, spark):
    """The odd rows with one row for each id, which the SQL forms take for granted."""
    path = f"{tmp_path_factory.mktemp('tables')}/odd"
    odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    items = [(1, "w11x5 w11x6 w11x7 w11x8 w11x9 w11x10 w11x11 w11x12 w11x13 w11x14 w11x15"), (2, None), (3, ""), (4, "one TWO"), (None, "x x x"), (4, "w8")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(5, 1, 0), (5, 0, 1), (7, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (12, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in QUERIES.items() if sql))
@pytest.mark.parametrize("where", ["tables", "odd"])
def test_twin(spark, sf_dir, odd_dir, name, where):
    query, sql = QUERIES[name]
    path = sf_dir if where == "tables" else odd_dir
    df = query(spark, path)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == twin(sql, path)
