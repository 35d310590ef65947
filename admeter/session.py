"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results or how skew is treated.  Cluster sizing
# (executors, memory, shuffle partitions) is left to the deployment.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A prompt can be large: keep the batches handed to a model function small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply ``SETTINGS`` to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def local_session(cores: str | int = "*", app_name: str = "admeter",
                  shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
