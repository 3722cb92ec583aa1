"""Training-data queries against their SQL."""

import duckdb
import pytest

from loomcat.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    answer = c.execute(queries.ORACLES[name])
    columns = [x[0] for x in answer.description]
    assert sorted(map(str, queries.QUERIES[name](spark, SF).select(*columns).toLocalIterator())) == sorted(str(spark_row(columns, r)) for r in answer.fetchall())


def spark_row(columns, values):
    from pyspark.sql import Row

    return Row(*columns)(*values)
