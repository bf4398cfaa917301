"""One place that builds the session, so that tests, bench and examples run under the same settings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "rillmark", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the caller brings its own and nothing here is used."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by its name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
