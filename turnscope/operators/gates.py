"""Checks that pass or fail: leaked credentials, and durations that regress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscope import fixed
from turnscope.functions import text as X
from turnscope.operators.medians import exact_medians
from turnscope.operators.retrieval import file_lines

# --- credentials --------------------------------------------------------------------------------------


def secret_findings(
    files: DataFrame,
    path: str = "path",
    content: str = "content",
    exemptions: tuple[str, ...] = (fixed.FINDING_EXEMPTION,),
) -> DataFrame:
    """``file``, ``line``, ``pattern`` and ``masked`` of every credential shape; exempt lines are skipped."""
    shapes = {name: "(?U)" + p for name, p in fixed.FINDING_PATTERNS.items()}
    lines = file_lines(files, path, content)
    exempt = reduce(lambda a, b: a | b, [F.contains("text", F.lit(e)) for e in exemptions])
    # One pass decides about the many lines without anything to report.
    suspicious = lines.filter(F.col("text").rlike("|".join(f"(?:{p})" for p in shapes.values())) & ~exempt)
    found = F.array(
        *[
            F.struct(F.lit(name).alias("pattern"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("secrets"))
            for name, p in shapes.items()
        ]
    )
    rows = suspicious.select("path", "line_no", F.explode(found).alias("f"))
    rows = rows.select("path", "line_no", "f.pattern", F.explode("f.secrets").alias("secret"))
    return rows.select(
        F.col("path").alias("file"),
        F.col("line_no").alias("line"),
        "pattern",
        X.mask_secret(F.col("secret")).alias("masked"),
    )


def scan_report(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One message per violation: scratch paths, and credentials in files that are scanned."""
    p = X.normalized_path(F.col(path))
    visible = files.withColumn(path, p)
    scratch = visible.filter(X.is_disallowed_path(F.col(path))).select(
        F.concat(F.lit("Disallowed ephemeral scratch path staged: "), F.col(path)).alias("message")
    )
    found = secret_findings(visible.filter(X.is_scanned(F.col(path))), path, content)
    leaks = found.select(
        F.format_string(
            "Potential secret credential detected in %s:%d [%s]: %s", "file", "line", "pattern", "masked"
        ).alias("message")
    )
    return scratch.unionByName(leaks)


# --- durations ----------------------------------------------------------------------------------------


def valid_records(records: DataFrame, schema_version: int = 1) -> DataFrame:
    """Records of the known version with a finite positive duration and finite test times."""
    good = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    duration = F.col("duration_s")
    tests = F.coalesce(F.forall(F.map_values("tests"), lambda s: s.isNotNull() & good(s)), F.lit(True))
    return records.filter((F.col("schema") == schema_version) & (duration > 0) & good(duration) & tests)


def newest_records(records: DataFrame, keys: list[str], order: str, count: int, tie: str | None = None) -> DataFrame:
    """The newest ``count`` records per key; each task keeps only that many before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), *([F.desc(tie)] if tie else []))
    return records.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= count)


def main_artifacts(artifacts: DataFrame) -> DataFrame:
    """Unexpired artefacts of the main branch of the same repository."""
    same = F.col("head_repository_id") == F.col("repository_id")
    return artifacts.filter(~F.coalesce("expired", F.lit(False)) & (F.col("head_branch") == "main") & same)


def rolling_median(records: DataFrame, keys: list[str], order: str, count: int, tie: str | None = None) -> DataFrame:
    """Exact median of the newest ``count`` durations per key, and how many there were."""
    newest = newest_records(records, keys, order, count, tie)
    return newest.groupBy(*keys).agg(
        F.median("duration_s").alias("median_s"), F.count(F.lit(1)).alias("baseline_records")
    )


def timing_gate(
    current: DataFrame,
    baseline: DataFrame,
    keys: list[str],
    count: int = 5,
    tolerance: float = 0.5,
    min_delta: float = 30.0,
    ceiling: float = 300.0,
    accepted: Column | None = None,
) -> DataFrame:
    """Judge durations: ``status`` pass, warn or fail.

    Above the ceiling fails always. More than ``tolerance`` and ``min_delta`` over the median fails, or
    warns when accepted. With fewer than ``count`` baseline records only the ceiling counts.
    """
    # One row per job on the right: broadcast when its measured size allows, else split where a job is frequent.
    joined = current.join(baseline, keys, "left")
    c = F.col
    known = F.coalesce(c("baseline_records"), F.lit(0)) >= count
    delta = c("duration_s") - c("median_s")
    slow = known & (c("duration_s") > c("median_s") * (1 + tolerance)) & (delta > min_delta)
    soft = F.lit(False) if accepted is None else accepted
    over = c("duration_s") > ceiling
    return joined.select(
        *current.columns,
        F.coalesce("baseline_records", F.lit(0).cast("bigint")).alias("baseline_records"),
        F.when(known, c("median_s")).alias("median_s"),
        F.when(known, delta).alias("delta_s"),
        over.alias("over_ceiling"),
        (~known).alias("relative_skipped"),
        F.when(over, "fail").when(slow & ~soft, "fail").when(slow, "warn").otherwise("pass").alias("status"),
    )


def ceiling_gate(current: DataFrame, ceiling: float = 300.0) -> DataFrame:
    """The ceiling alone."""
    return current.withColumn("status", F.when(F.col("duration_s") > ceiling, "fail").otherwise("pass"))


def test_medians(records: DataFrame) -> DataFrame:
    """Median seconds per test over baseline records; a test may stand in all of them."""
    rows = records.select(F.explode("tests").alias("test", "seconds"))
    return exact_medians(rows, ["test"], "seconds").select("test", F.col("median").alias("median_s"))


def compare_tests(current: DataFrame, medians: DataFrame) -> DataFrame:
    """Current test times next to their baseline median, NULL for new tests."""
    return current.join(medians, "test", "left")


def test_offenders(
    current: DataFrame, medians: DataFrame, tolerance: float = 0.5, min_delta: float = 5.0, limit: int = 10
) -> DataFrame:
    """Tests that grew by more than ``tolerance`` and ``min_delta``, largest growth first."""
    delta = F.col("seconds") - F.col("median_s")
    grown = compare_tests(current, medians).filter(
        (F.col("seconds") > F.col("median_s") * (1 + tolerance)) & (delta > min_delta)
    )
    return grown.withColumn("delta_s", delta).orderBy(F.desc("delta_s"), "test").limit(limit)


def new_tests(current: DataFrame, medians: DataFrame) -> DataFrame:
    """How many current tests have no baseline."""
    return current.join(medians, "test", "left_anti").agg(F.count(F.lit(1)).alias("new_tests"))


def test_time_totals(cases: DataFrame) -> DataFrame:
    """Seconds per ``classname::name``; a missing time counts as 0."""
    name = F.concat(F.coalesce("classname", F.lit("")), F.lit("::"), F.coalesce("name", F.lit("")))
    return cases.groupBy(name.alias("test")).agg(
        F.sum(F.coalesce(F.col("time").try_cast("double"), F.lit(0.0))).alias("seconds")
    )
