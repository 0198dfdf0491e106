"""Sessions with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Times are UTC, and of duplicate keys in an event the last counts, as common JSON parsers have it.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true", "spark.sql.adaptive.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", memory: str = "4g", **more: str) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName("eventlantern").config("spark.driver.memory", memory)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
