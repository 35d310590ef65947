"""Runs that are written whole.

A run's tables are written into folders of their own for each attempt,
``<base>/<table>/run_id=…/attempt=…``, and count only from the moment one row
of the manifest ``<base>/_commits`` names them.  Readers take each run's last
committed attempt, so a run that is repeated under its id, with other cohorts or
without rejects, leaves exactly the tables of its last attempt, and one that
broke off leaves nothing.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .writers import write_run_table

MANIFEST = "run_id string, attempt string, committed_at bigint, tables map<string,string>"
STAMPS = ("run_id", "attempt")


class Attempt:
    """One attempt at a run: tables written here are seen by readers after ``commit``."""

    def __init__(self, spark: SparkSession, base_dir: str, run_id: str):
        self.spark, self.base_dir, self.run_id = spark, base_dir, run_id
        self.id = uuid.uuid4().hex
        self.schemas: dict[str, T.StructType] = {}

    def path(self, name: str) -> str:
        return f"{self.base_dir}/{name}/run_id={self.run_id}/attempt={self.id}"

    def write(self, df: DataFrame, name: str, *, partition_by=("cohort_id",), mode: str = "overwrite") -> DataFrame:
        """Write a table of this attempt and read it back: later steps start from the files.  Runs a job.

        Without rows there is no file to read a schema from, so it is kept here and in the manifest.
        """
        data = df.drop(*STAMPS)
        keys = [k for k in partition_by if k in data.columns]
        write_run_table(data, self.path(name), partition_by=keys, mode=mode)
        self.schemas[name] = data.schema
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        schema = self.schemas[name]
        rows = self.spark.read.schema(schema).parquet(self.path(name))
        return rows.select(*schema.names, F.lit(self.run_id).alias("run_id"))

    def commit(self) -> None:
        """Make the tables written so far the run's, and remove what earlier commits of the run wrote.  Runs a job."""
        earlier = [r["attempt"] for r in _manifest(self.spark, self.base_dir).filter(F.col("run_id") == self.run_id).select("attempt").collect()]
        tables = {name: schema.json() for name, schema in self.schemas.items()}
        row = self.spark.createDataFrame([(self.run_id, self.id, time.time_ns(), tables)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.base_dir}/_commits")
        for attempt in earlier:
            _remove(self.spark, self.base_dir, self.run_id, attempt)


def _remove(spark: SparkSession, base_dir: str, run_id: str, attempt: str) -> None:
    """Delete the folders that an attempt wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(base_dir)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    pattern = path(root, f"*/run_id={run_id}/attempt={attempt}")
    deeper = path(root, f"*/*/run_id={run_id}/attempt={attempt}")
    for found in (files.globStatus(pattern), files.globStatus(deeper)):
        for status in found or []:
            files.delete(status.getPath(), True)


def _manifest(spark: SparkSession, base_dir: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{base_dir}/_commits")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], MANIFEST)
        raise


def committed(spark: SparkSession, base_dir: str) -> DataFrame:
    """``run_id, attempt, committed_at, tables``: the last commit of each run."""
    newest = W.partitionBy("run_id").orderBy(F.col("committed_at").desc(), F.col("attempt").desc())
    ranked = _manifest(spark, base_dir).withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def read_committed(spark: SparkSession, base_dir: str, name: str, run_id: str | None = None) -> DataFrame | None:
    """A table of all committed runs, or of one, with ``run_id``; None where no commit names it.

    The manifest, a row per run, joins on the folders' columns, so files of other attempts are not opened.
    """
    runs = committed(spark, base_dir).filter(F.map_contains_key("tables", name))
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    last = runs.orderBy(F.col("committed_at").desc()).select("attempt", F.col("tables")[name].alias("schema")).first()
    if last is None:
        return None
    schema = T.StructType.fromJson(json.loads(last["schema"]))
    stamped = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in STAMPS]])
    rows = spark.read.schema(stamped).parquet(f"{base_dir}/{name}")
    return rows.join(runs.select(*STAMPS), list(STAMPS), "left_semi").select(*schema.names, "run_id")
