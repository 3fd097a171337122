"""Session defaults that suit both a laptop and a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "fundlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC as its zone.

    Shuffle partitions stay at what the cluster configures; adaptive execution
    coalesces small ones and splits skewed ones.  Keyword arguments are Spark
    settings with ``__`` in place of dots.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Rather one more shuffle than one task with a hot key.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # The JVM never compiles methods above 8000 bytes; past that, Spark's
        # split expressions are faster than one big generated method.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
