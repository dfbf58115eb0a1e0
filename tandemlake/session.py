"""A session with the settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tandemlake", **settings: str) -> SparkSession:
    """Adaptive execution with skew handling; other settings as given or as the cluster has them."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"} | settings
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
