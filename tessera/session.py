"""Spark sessions with the settings that the library expects."""

from pyspark.sql import SparkSession


def session(app: str = "tessera", **settings: str) -> SparkSession:
    """A session with adaptive plans and UTC times; further settings by name, with _ for the dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
