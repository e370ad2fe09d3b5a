"""Session settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of the Arrow batches that tasks exchange with Python, the setting that bounds them, and Spark's own bounds.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_LARGER = {"67108864", "67108864b", "64m", "64mb", str((1 << 31) - 1), f"{(1 << 31) - 1}b"}


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as 10,000 rows of long texts don't fit; a session that sets its own bound keeps it."""
    if spark.conf.get(BATCH_SETTING, "67108864").lower() in _LARGER:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def build_session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; conf overrides or adds settings (dots as __)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
