"""Unique visitors from bitmaps that merge.

Every visitor gets a number, dense from 1, which a bitmap has a bit for. A day's visitors are bitmaps
of 32,768 bits each, one for each bucket of numbers that has any; the visitors of several days are
the or of theirs. So a day is read once, when it comes; a week or all time reads bitmaps only, and
nothing is counted distinct over visits.

Numbers are given in order of ip_hash within the visitors that come together, by a global sort in
pieces. Days that come again replace themselves. Visits without a day or a visitor don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import ranked, table
from . import activity

NUMBERS = "ip_hash string, number long"
BITMAPS = "bucket long, bitmap binary, views long, day string"


@dataclass(frozen=True)
class Visitors:
    """Bitmaps below `root`, as `numbers` (the visitors) and `days`."""

    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def add(self, visits: DataFrame) -> None:
        """Visits (at, ip_hash, agent) of whole days; what there is of these days is replaced."""
        days = table(activity.visit_days(visits.where("at IS NOT NULL AND ip_hash IS NOT NULL")), "visit-days")
        known = self._read("numbers", NUMBERS)
        last = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
        new = days.select("ip_hash").distinct().join(known, "ip_hash", "left_anti")
        numbered = ranked(new, [F.asc("ip_hash")], "ip_hash").select("ip_hash", (F.col("rank") + last).cast("long").alias("number"))
        table(numbered, "numbers").write.mode("append").parquet(f"{self.root}/numbers")
        bits = days.join(self._read("numbers", NUMBERS), "ip_hash").groupBy("day", F.bitmap_bucket_number("number").alias("bucket"))
        out = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"), F.sum("views").alias("views"))
        out.select("bucket", "bitmap", "views", "day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/days")

    def between(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """One row, views and visitors of the days from first to last."""
        rows = self._read("days", BITMAPS)
        rows = rows.where(F.col("day") >= first) if first else rows
        rows = rows.where(F.col("day") <= last) if last else rows
        merged = rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("views").alias("views"))
        return merged.agg(F.coalesce(F.sum("views"), F.lit(0)).cast("long").alias("views"), F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("visitors"))

    def stats(self, now: int) -> DataFrame:
        """As activity.visit_stats: today, the last days (and later ones), and all."""
        today, start = (self.spark.range(1).select(F.date_format(F.timestamp_seconds(F.lit(now + 8 * 3600 - 86400 * k)), "yyyy-MM-dd")).first()[0] for k in (0, activity.TREND_DAYS - 1))
        parts = {"today": self.between(today, today), "week": self.between(start), "total": self.between()}
        out = None
        for name, row in parts.items():  # one row each
            row = row.withColumnsRenamed({x: f"{name}_{x}" for x in ("views", "visitors")})
            out = row if out is None else out.crossJoin(row)
        return out
