"""Session settings that the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # The JVM does not compile methods of more than 8000 bytes. Above that size Spark then leaves an expression out of
    # the fused stage and splits it into small methods, which makes parsing more than twice as fast.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Times without a zone, in tables and in lines, are read in this zone.
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession, **changes: str) -> SparkSession:
    for name, value in {**SETTINGS, **changes}.items():
        spark.conf.set(name, value)
    return spark
