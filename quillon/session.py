"""A session with the settings the engine is written for."""

from pyspark.sql import SparkSession


def session(app: str = "quillon", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow. conf: further settings, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
