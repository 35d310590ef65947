"""Checked queries for sources and sinks: tables written to a scratch folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from admeter.sinks import Attempt, append_scores, read_committed, write_results
from admeter.sources import load

from .registry import query
from .views import eval_scores, table


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder: below the one that executors share, where the session names it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="workload-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _counted(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with whether their place in the input is their own."""
    places = df.groupBy("ordinal").count().filter("count > 1").limit(1).select(F.lit(True).alias("shared"))
    return df.select(*columns).join(places, F.lit(True), "left").select(*columns, F.col("shared").isNull().alias("own_place"))


@query("csv_source", "", "SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderstatus AS status, o_orderpriority AS priority, true AS own_place FROM orders")
def csv_source_q(spark, sf):
    """Semicolons, blanks around headers, an all-null column: text columns, each row with a place."""
    path = scratch(spark, "csv")
    orders = table(spark, sf, "orders")
    given = orders.select(F.col("o_orderkey").alias(" order_key"), F.col("o_orderstatus").alias("status "), F.lit(None).cast("string").alias("empty"),
                          F.col("o_orderpriority").alias("priority"))
    given.repartition(3).write.option("header", True).option("sep", ";").csv(path)
    read = load(spark, path, format="csv", options={"sep": ";", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True})
    return _counted(read, *[c for c in read.columns if c != "ordinal"])


@query("json_source", "", "SELECT event_id, event_type, value, true AS own_place FROM events")
def json_source_q(spark, sf):
    path = scratch(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type", "value").repartition(3).write.json(path)
    return _counted(load(spark, path, format="json", options={"multiLine": False}), "event_id", "event_type", "value")


@query("parquet_source", "", "SELECT l_orderkey, l_linenumber, true AS own_place FROM lineitem")
def parquet_source_q(spark, sf):
    return _counted(load(spark, f"{sf}/lineitem.parquet"), "l_orderkey", "l_linenumber")


@query("run_replaced", "", """SELECT 'run_0' AS run_id, lang AS cohort_id, doc_id FROM documents
UNION ALL SELECT 'run_1', lang, doc_id FROM documents WHERE doc_id % 3 = 0 AND lang <> 'en'""")
def run_replaced_q(spark, sf):
    """A run that was committed, repeated with other cohorts, and begun a third time without an end, beside another run."""
    base = scratch(spark, "runs")
    docs = table(spark, sf, "documents").select(F.col("lang").alias("cohort_id"), "doc_id")
    for run, rows, ends in (("run_0", docs, True), ("run_1", docs, True), ("run_1", docs.filter("doc_id % 3 = 0 AND cohort_id <> 'en'"), True), ("run_1", docs, False)):
        attempt = Attempt(spark, base, run)
        attempt.write(rows, "results")
        if ends:
            attempt.commit()
    return read_committed(spark, base, "results").select("run_id", "cohort_id", "doc_id")


@query("scores_appended_once", "eval_scores", "SELECT cohort_id, run_id AS version, doc_id, accuracy FROM eval_scores")
def scores_once_q(spark, sf):
    """Batches of scores of which some are appended again, one of them together with new runs."""
    path = scratch(spark, "scores")
    scores = eval_scores(spark, sf).select("cohort_id", F.col("run_id").alias("version"), "doc_id", "accuracy")
    first, second = scores.filter("version IN ('run_en', 'run_de')"), scores.filter("version <> 'run_en'")
    for batch in (first, first, second, second, first):
        append_scores(batch, path, "parquet", keys=("cohort_id", "version"))
    return spark.read.schema(scores.schema).parquet(path)


@query("results_by_cohort", "", "SELECT source AS cohort_id, concat('run_', lang) AS run_id, doc_id, n_chars FROM documents")
def results_by_cohort_q(spark, sf):
    base = scratch(spark, "results")
    docs = table(spark, sf, "documents").select(F.col("source").alias("cohort_id"), F.concat(F.lit("run_"), "lang").alias("run_id"), "doc_id", "n_chars")
    write_results(docs, base, "sizes")
    return spark.read.schema(docs.schema).json(f"{base}/sizes").select("cohort_id", "run_id", "doc_id", "n_chars")
