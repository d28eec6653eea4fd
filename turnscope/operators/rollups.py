"""Reports over the results of delegated subtasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.functions.text import summarize_output


def subtask_summaries(results: DataFrame) -> DataFrame:
    """Add the compressed ``summary`` of every result."""
    return results.withColumn("summary", summarize_output(F.col("task_id"), F.col("success"), F.col("output")))


def subtask_report(results: DataFrame, run: str = "run_id", position: str = "position") -> DataFrame:
    """The report as rows, one per result in the order of the run.

    A run may hold any number of results, so its report stays a table; writing it sorted by
    (run, position) gives the text.
    """
    icon = F.when(F.col("success"), "✅").otherwise("❌")
    return subtask_summaries(results).select(
        F.col(run).alias("run_id"),
        F.col(position).alias("position"),
        F.concat(F.lit("#### "), icon, F.lit(" Subtask `"), F.col("task_id").cast("string"), F.lit("`")).alias("heading"),
        "summary",
    )


def subtask_counts(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Results, successes and failures per run."""
    return results.groupBy(F.col(run).alias("run_id")).agg(
        F.count(F.lit(1)).alias("subtasks"),
        F.sum(F.col("success").cast("bigint")).alias("succeeded"),
        F.sum((~F.col("success")).cast("bigint")).alias("failed"),
    )
