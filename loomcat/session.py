"""Session defaults: UTC, ANSI mode, adaptive execution. Cluster sizes are left to the deployment."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "loomcat", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
