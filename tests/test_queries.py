"""Every query against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from loomcat.functions import text
from loomcat.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    answer = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    assert got == plain([tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()])


def test_queries_without_sql(spark):
    found = queries.QUERIES["entity_match_longest"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert found and all(texts[r.doc_id][r.start : r.end] == r.name for r in found)
    assert queries.QUERIES["normalised_names"](spark, SF).count() == len(texts)


def test_whole_texts_are_normalised(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.search_name for r in queries.QUERIES["normalised_names"](spark, SF).collect()}
    assert got == {k: text.normalise(t) if t is not None else None for k, t in texts.items()}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
