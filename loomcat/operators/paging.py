"""Deep pages from a stored order.

`LIMIT n OFFSET m` sorts all rows, or at least m + n of them, for every page. Where pages of one order
are asked for again and again, the order is stored instead: rows sorted into ranges of its columns,
one folder a range, each row with its place, and a small table of how many rows lie before each
range. A page then reads the one or two folders it lies in.

The order's columns must decide every tie that matters: rows that are equal in all of them have an
order, which stays as stored. Offsets past the end give empty pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range.
ROWS = 100_000


@dataclass(frozen=True)
class StoredOrder:
    spark: SparkSession
    root: str
    schema: T.StructType

    @staticmethod
    def build(rows: DataFrame, by: list[Column], root: str, per_range: int = ROWS) -> StoredOrder:
        """Store rows in the order of the sort columns `by` (asc, desc, nulls first or last)."""
        spark, ranges = rows.sparkSession, max(1, -(-rows.count() // per_range))
        placed = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
        placed = placed.select("*", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"), F.spark_partition_id().alias("_range"))
        placed.write.partitionBy("_range").parquet(f"{root}/rows")
        order = StoredOrder(spark, root, rows.schema)
        sizes = order._rows().groupBy("_range").agg(F.count("*").alias("n"))
        sizes.coalesce(1).write.parquet(f"{root}/ranges")
        return order

    def _rows(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_range", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows")

    def spans(self, offset: int, size: int) -> list[tuple[int, int, int]]:
        """(range, first, last place) of the ranges that a page lies in; a row for each range is read."""
        out, before = [], 0
        for r in sorted(self.spark.read.schema("_range int, n long").parquet(f"{self.root}/ranges").collect()):
            lo, hi = max(offset - before, 0), min(offset + size - before, r["n"])
            if lo < hi:
                out.append((r["_range"], lo, hi))
            before += r["n"]
        return out

    def page(self, offset: int, size: int) -> DataFrame:
        """Rows offset to offset + size of the order, in it."""
        if offset < 0 or size < 0:
            raise ValueError("offset and size are 0 or more")
        spans = self.spans(offset, size)
        if not spans:
            return self._rows().limit(0).drop("_place", "_range")
        inside = F.lit(False)
        for at, lo, hi in spans:
            inside = inside | ((F.col("_range") == at) & F.col("_place").between(lo, hi - 1))
        found = self._rows().where(F.col("_range").isin([x[0] for x in spans])).where(inside)
        return found.orderBy("_range", "_place").limit(size).drop("_place", "_range")
