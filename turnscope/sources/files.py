"""Text files, test reports, timing records and plan ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope import fixed
from turnscope.operators.gates import valid_records

TIMING_SCHEMA = (
    "workflow string, job string, os string, duration_s double, started_at double, finished_at double, "
    "sha string, run_id string, tests map<string,double>, schema int"
)
CASE_SCHEMA = "_classname string, _name string, _time string"
# Start tags of test cases; also whatever may hold text that looks like one. Values may hold ">".
CASE_TAG = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<testcase(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>"""


def is_indexed(path: Column) -> Column:
    """Whether a path (relative to the root) belongs to the index."""
    folders = "(^|/)(" + "|".join(f.replace(".", "\\.") for f in fixed.PRUNED_FOLDERS) + ")/"
    suffix = "(" + "|".join(s.replace(".", "\\.") for s in fixed.INDEXED_SUFFIXES) + ")$"
    return path.rlike(suffix) & ~path.rlike(folders)


def scan_text_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` relative to the root and ``content`` of the indexed files; undecodable bytes are left out."""
    globs = "{" + ",".join(f"*{s}" for s in fixed.INDEXED_SUFFIXES) + "}"
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", globs)
        .load(root)
    )
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    relative = F.regexp_replace(F.replace("path", F.lit(prefix), F.lit("")), "^(file|hdfs)://", "")
    text = F.col("content").cast("string")
    decoded = F.when(F.is_valid_utf8(text), text).otherwise(F.translate(F.make_valid_utf8(text), "\ufffd", ""))
    return raw.select(relative.alias("path"), decoded.alias("content")).filter(is_indexed(F.col("path")))


def parse_junit(documents: DataFrame, xml: str, *keep: str) -> DataFrame:
    """One row per test case, at any depth, of XML reports held in a column; a broken report has none."""
    broken = F.from_xml(F.col(xml), "_corrupt_record string")["_corrupt_record"]
    found = F.regexp_extract_all(F.col(xml), F.lit(CASE_TAG), F.lit(0))
    tags = F.filter(found, lambda t: t.startswith("<testcase"))
    rows = documents.where(broken.isNull()).select(*keep, F.explode(tags).alias("t"))
    case = F.from_xml(F.regexp_replace("t", "/?>$", "/>"), CASE_SCHEMA)
    return rows.select(*keep, case.alias("t")).select(
        *keep, F.col("t._classname").alias("classname"), F.col("t._name").alias("name"), F.col("t._time").alias("time")
    )


def scan_junit(spark: SparkSession, *paths: str) -> DataFrame:
    """Test cases at any depth of XML report files."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "testcase")
        .schema(CASE_SCHEMA)
        .load(list(paths) if len(paths) > 1 else paths[0])
    )
    return rows.select(
        F.col("_classname").alias("classname"), F.col("_name").alias("name"), F.col("_time").alias("time")
    )


def parse_timing_records(lines: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """Valid timing records of JSON texts; unknown keys are dropped, bad records skipped."""
    rows = lines.select(*keep, F.from_json(F.col(value), TIMING_SCHEMA).alias("r")).select(*keep, "r.*")
    return valid_records(rows)


def scan_timing_records(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(TIMING_SCHEMA).option("recursiveFileLookup", True).option("multiLine", True)
    return valid_records(reader.json(path))


def scan_ledger(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Plan forecasts (one JSON object per line) or knowledge documents (one per file)."""
    return spark.read.option("multiLine", multiline).json(path)
