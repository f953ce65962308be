"""Session settings that the semantics rely on. All can be set on a running session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """The session with the settings above."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def local_session(name: str = "weftplan", cores: str = "*", partitions: int = 8) -> SparkSession:
    """For tests and trials."""
    return configure(SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.shuffle.partitions", partitions).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
