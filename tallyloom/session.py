"""Session builder for tests and benches. A cluster supplies its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tallyloom", cores: int | str | None = None, **conf: str) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    settings = {
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
