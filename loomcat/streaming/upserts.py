"""A table of daily counts that micro-batches are merged into.

Days are folders that are never changed; a manifest says which folder holds each day, and which batch
was merged last. A batch reads and rewrites the days it touches, then claims the next manifest, so
readers find one row a key without grouping anything, and see a batch as a whole or not at all.
A batch that comes again (numbers only grow) changes nothing. `compact` deletes folders and manifests
that no reader of the last `keep` versions needs, so files don't pile up.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.activity import merge_days
from ..sources import publish

SCHEMA = "ip_hash string, views long, last_at long, day string"


@dataclass(frozen=True)
class DayTable:
    spark: SparkSession
    root: str

    def _manifest(self, number: int | None = None) -> dict | None:
        known = [m for m in publish.manifests(self.spark, self.root) if number is None or m["number"] == number]
        return known[-1] if known else None

    def _days(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.root}/versions").parquet(*(f"{self.root}/versions/{f}" for f in folders.values())).select("day", "ip_hash", "views", "last_at")

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merge rows (day, ip_hash, views, last_at; a row a key) of a batch; False if it was merged
        already. Another writer's batch that touches the same days meanwhile is merged as well: the
        days are then read again."""
        touched = [r[0] for r in rows.select("day").distinct().collect()]  # days of a batch
        written: dict[str, str] = {}

        def make(known: list[dict]) -> dict | None:
            last = known[-1] if known else {"batch": -1, "days": {}}
            if batch <= last["batch"]:
                return None
            version, old = uuid.uuid4().hex, {d: last["days"][d] for d in touched if d in last["days"]}
            merged = merge_days(self._days(old), rows.select("day", "ip_hash", "views", "last_at"))
            merged.repartition(max(1, len(touched)), "day").write.partitionBy("day").parquet(f"{self.root}/versions/v={version}")
            written.update({d: f"v={version}/day={d}" for d in touched})
            return {"batch": batch, "days": last["days"] | written}

        return publish.claim_next(self.spark, self.root, make) is not None

    def read(self, number: int | None = None, days: list[str] | None = None) -> DataFrame:
        """day, ip_hash, views, last_at: of the last version, or of one that is still there; of all
        days or only some, whose folders alone are read."""
        manifest = self._manifest(number)
        folders = manifest["days"] if manifest else {}
        return self._days(folders if days is None else {d: folders[d] for d in days if d in folders})

    def compact(self, keep: int = 1) -> int:
        """Delete what versions before the last `keep` alone need. Returns how many folders went."""
        known = publish.manifests(self.spark, self.root)
        needed = {f for m in known[-keep:] for f in m["days"].values()}
        gone = {f for m in known[:-keep] for f in m["days"].values()} - needed
        for f in gone:
            publish._delete(self.spark, f"{self.root}/versions/{f}")
        for m in known[:-keep]:
            publish._delete(self.spark, f"{self.root}/manifests/{m['number']:012d}")
        return len(gone)
