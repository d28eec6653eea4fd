"""Shared helpers: tables in the cluster's folder, and words of a text as arrays of 64-bit hashes."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from turnscope.session import remove, write_once

# Functions travel to the executors with the plan, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, ``spark.checkpoint.dir``; only where a local session (tests) has none, an own one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    found = _OWN_FOLDERS.get(spark.sparkContext.applicationId)
    return found or _OWN_FOLDERS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="llm-tables-"))


# Rows sent to Python at once: texts may be long, and two workers share an executor's memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it: cuts the lineage and outlives any executor. Its shuffles are removed."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    table = write_once(df, path)
    table.stored_at = path
    return table


def released(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that no step to come reads."""
    for table in tables:
        remove(table.sparkSession, table.stored_at)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, kept for the words seen last; at most ``LIMIT`` of them."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Windows:
    """Hashes of all windows of a given length: a polynomial modulo 2^64 over word hashes, then mixed."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.power) < n:
            have = len(self.power)
            step, back = pow(self.BASE, have, 1 << 64), pow(self.BASE, -have, 1 << 64)
            self.power = np.concatenate([self.power, self.power * np.uint64(step)])
            self.inverse = np.concatenate([self.inverse, self.inverse * np.uint64(back)])

    def __call__(self, hashes: np.ndarray, length: int) -> np.ndarray:
        n = len(hashes) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        self._grow(len(hashes))
        total = np.cumsum(hashes * self.power[: len(hashes)], dtype=np.uint64)
        value = total[length - 1 :].copy()
        value[1:] -= total[: n - 1]
        return mixed(value * self.inverse[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
