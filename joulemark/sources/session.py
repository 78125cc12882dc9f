"""The session's settings, and the package's way to workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Workers find this package also where the session was begun from elsewhere."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def session(name: str = "joulemark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf wins."""
    given = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=given | conf).getOrCreate()
