"""Transaction logs: reading, typing and writing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from turnscope.functions import variants as V
from turnscope.functions.text import safe_id

BOM = "﻿"
BLANK = " \t\n\r\x0b\x0c" + BOM


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Keep the lines that hold one JSON object and add it as the variant ``tx``.

    Blank lines, unreadable lines and other JSON values are dropped.
    """
    v = F.col(value)
    clean = v.startswith("{") & v.endswith("}")
    text = F.when(clean, v).otherwise(F.btrim(v, F.lit(BLANK)))
    whole = F.when(clean | (text.startswith("{") & text.endswith("}")), V.parse(text))
    # Exploding an array of at most one element parses once; a filter on the parsed column would be
    # pushed below the projection and parse again.
    kept = [F.col(c) for c in lines.columns]
    return lines.select(*kept, F.explode(F.array_compact(F.array(whole))).alias("tx"))


def parse_arrays(files: DataFrame, value: str = "value") -> DataFrame:
    """One row per object of files that hold a JSON array; a broken array fails the query."""
    elements = files.select(
        *[c for c in files.columns if c != value],
        F.posexplode(F.variant_get(F.parse_json(F.btrim(F.col(value), F.lit(BLANK))), "$", "array<variant>")).alias(
            "line_no", "tx"
        ),
    )
    return elements.filter(V.is_object(F.col("tx"))).withColumn(value, F.to_json("tx"))


# Bits of an ordinal below the number of its file: a position inside the file.
FILE_BITS = 40
# File names are broadcast up to this many; a longer list is joined as any other table.
MANY_FILES = 100_000


def _lines(reader: DataFrameReader, paths: list[str]) -> DataFrame:
    """``file``, ``at`` and ``value`` of every line; ``at`` grows along the file.

    A line has one byte at least, so the first byte of its split plus the lines read before it in the task stay
    below the first byte of the next split: no pass over the log and no shuffle is needed to order it. (A full
    split is a task of its own; only the ends of files share a task.)
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + row).alias("at"), "value"
    )


def _wholes(reader: DataFrameReader, paths: list[str]) -> DataFrame:
    return reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def _array_files(lines: DataFrame) -> list[str]:
    """Names of the files whose first character that is not blank is a bracket: one row per file."""
    text = F.btrim("value", F.lit(BLANK))
    first = lines.select("file", "at", F.left(text, F.lit(1)).alias("first")).filter("first <> ''")
    heads = first.groupBy("file").agg(F.min_by("first", "at").alias("first"))
    return [r.file for r in heads.filter("first = '['").select("file").collect()]


def _numbered(found: DataFrame, names: list[str]) -> DataFrame:
    """``file`` and ``at`` -> ``ordinal``: files one after the other by name, positions inside."""
    spark = found.sparkSession
    if len(names) == 1:
        number = found.withColumn("no", F.lit(0).cast("bigint"))
    else:
        table = spark.createDataFrame([(n, i) for i, n in enumerate(sorted(names))], "file string, no bigint")
        number = found.join(F.broadcast(table) if len(names) <= MANY_FILES else table, "file", "left")
    # A file that was not there when the names were listed must not vanish.
    known = F.coalesce("no", F.raise_error(F.concat(F.lit("unlisted file "), "file")).cast("bigint"))
    ordinal = F.shiftleft(known, FILE_BITS) + F.col("at")
    return number.select(ordinal.alias("ordinal"), "value", "tx")


def _names(reader: DataFrameReader, paths: list[str]) -> dict[str, str]:
    """Name -> path of the files, without reading them; the driver lists them for every read."""
    found = reader.format("binaryFile").load(paths).select("_metadata.file_path", "path")
    return {r[0]: re.sub(r"([\[\]{}*?\\])", r"\\\1", r[1]) for r in found.collect()}


def _exploded(wholes: DataFrame) -> DataFrame:
    return parse_arrays(wholes).select("file", F.col("line_no").cast("bigint").alias("at"), "value", "tx")


def read_trace(
    spark: SparkSession, *paths: str, permissive: bool = False, arrays: bool | None = None
) -> DataFrame:
    """Transactions of JSON-lines files and JSON-array files: ``ordinal``, ``value`` and ``tx``.

    Each file is one or the other by its first character that is not blank; that test is one more pass over the
    text, which ``arrays=False`` (no file holds an array) or ``True`` (each does) saves. ``ordinal`` is a bigint
    that sorts as the records stand in the files, files by name. Without ``permissive`` an input with no
    transaction at all is an error.
    """
    where = list(paths)
    names = _names(spark.read, where)
    lists = set(_array_files(_lines(spark.read, where)) if arrays is None else names if arrays else ())
    rest = [path for name, path in names.items() if name not in lists]
    parts = []
    if rest:
        parts.append(parse_lines(_lines(spark.read, rest if lists else where)))
    if lists:
        parts.append(_exploded(_wholes(spark.read, [names[n] for n in lists] if rest else where)))
    if not parts:
        parts.append(parse_lines(_lines(spark.read, where)))
    found = _numbered(reduce(DataFrame.unionByName, parts), list(names))
    if not permissive and found.isEmpty():
        raise ValueError(f"no valid transaction records in {', '.join(paths)}")
    return found


def read_trace_dir(spark: SparkSession, folder: str) -> DataFrame:
    """``transactions.jsonl`` of a folder if there is one, else every ``*.jsonl`` and ``turn_*.json`` below it.

    Each ``*.jsonl`` holds lines or one array, see ``read_trace``; a broken array gives nothing here. A
    ``turn_*.json`` holds one object.
    """
    whole = f"{folder.rstrip('/')}/transactions.jsonl"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(whole)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return read_trace(spark, whole)

    def reader(names: str) -> DataFrameReader:
        options = {"recursiveFileLookup": "true", "ignoreCorruptFiles": "true", "pathGlobFilter": names}
        return spark.read.options(**options)

    logs, turns = _names(reader("*.jsonl"), [folder]), _names(reader("turn_*.json"), [folder])
    parts = []
    if logs:
        lists = set(_array_files(_lines(reader("*.jsonl"), [folder])))
        rest = [path for name, path in logs.items() if name not in lists]
        if rest:
            parts.append(parse_lines(_lines(reader("*.jsonl"), rest)))
        if lists:
            wholes = _wholes(reader("*.jsonl"), [logs[n] for n in lists])
            readable = wholes.filter(V.parse(F.btrim("value", F.lit(BLANK))).isNotNull())
            parts.append(_exploded(readable))
    if turns:
        single = _wholes(reader("turn_*.json"), [folder]).withColumn("at", F.lit(0).cast("bigint"))
        parts.append(parse_lines(single).select("file", "at", "value", "tx"))
    found = _numbered(reduce(DataFrame.unionByName, parts), [*logs, *turns]) if parts else None
    if found is None or found.isEmpty():
        raise ValueError(f"no valid transaction records in {folder}")
    return found


def read_wire_log(spark: SparkSession, *folders: str) -> DataFrame | None:
    """The log of the first folder that holds any transaction; None when none does."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/transactions.jsonl")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found = read_trace(spark, path.toString(), permissive=True)
            if not found.isEmpty():
                return found
    return None


def union_traces(*traces: DataFrame) -> DataFrame:
    """Transactions of several runs, one after the other."""
    out = traces[0]
    for more in traces[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def with_file_names(records: DataFrame) -> DataFrame:
    """Add the per-record name the log uses: ``turn_<turn>_<flow>.json`` with safe characters."""
    return records.withColumn(
        "file_name",
        F.concat(F.lit("turn_"), safe_id(F.col("turn_id")), F.lit("_"), safe_id(F.col("flow_id")), F.lit(".json")),
    )


def write_wire_log(records: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append records as JSON lines.

    One file per record is not reproduced: at scale it would make as many files as transactions. The
    name such a file would have can be kept as a column, see ``with_file_names``.
    """
    writer = records.write.mode("append").option("ignoreNullFields", "false")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A scorecard or telemetry row as JSON, ratios rounded half-even to two digits."""
    rounded = [
        F.bround(F.col(f.name), 2).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in report.schema
    ]
    report.select(*rounded).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
