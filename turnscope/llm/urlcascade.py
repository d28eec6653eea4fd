"""URL rules with exact membership by a cascade of Bloom filters, without joins."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.llm.support import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rules of the query.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


class Bloom:
    """A Bloom filter over 64-bit keys; ``level`` makes the levels of a cascade independent."""

    def __init__(self, n: int, rate: float, level: int) -> None:
        rate = min(max(rate, 1e-18), 0.5)
        self.size = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
        self.hashes = max(1, round(math.log2(1 / rate)))
        self.level = level
        self.bits = np.zeros((self.size + 63) // 64, np.uint64)

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        """Two hashes of the key give all places (Kirsch and Mitzenmacher)."""
        salt = np.uint64((self.level * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        one = _mix(keys ^ salt)
        two = _mix(one ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        return [(one + np.uint64(i) * two) % np.uint64(self.size) for i in range(self.hashes)]

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash(host: str, path: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}{path}".encode())


def member(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Exact for every key of the universe the cascade was built over.

    A key that passes level 1, 2, … and first fails at level k is listed if k is even: odd levels hold listed
    keys, even levels hold unlisted keys that passed. A key that passes all of them belongs to the last.
    """
    inside = np.full(len(keys), len(levels) % 2 == 1)
    passed = np.ones(len(keys), bool)
    for k, level in enumerate(levels):
        now = passed & level.has(keys)
        inside[passed & ~now] = k % 2 == 1
        passed = now
    return inside


def _probe(levels: list[Bloom]):
    """Keep the keys that pass every level."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            stay = reduce(lambda ok, level: ok & level.has(keys), levels, np.ones(len(keys), bool))
            yield pa.RecordBatch.from_arrays([pa.array(keys[stay].view(np.int64), pa.int64())], names=["key"])

    return probe


def _filled(like: Bloom):
    """Each task's keys as one filter: its words that are not zero."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(1, 0.5, like.level)
        own.size, own.hashes, own.bits = like.size, like.hashes, np.zeros_like(like.bits)
        for batch in batches:
            own.add(batch.column(0).to_numpy().view(np.uint64))
        at = np.flatnonzero(own.bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(own.bits[at].view(np.int64), pa.int64())], names=["at", "word"]
        )

    return fill


def _built(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """A filter over a table of keys; what reaches the driver is the filter's own words."""
    made = Bloom(n, rate, level)
    words = keys.mapInArrow(_filled(made), "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word"))
    for at, word in words.collect():
        made.bits[at] = np.uint64(word & ((1 << 64) - 1))
    return made


def cascade(listed: DataFrame, universe: DataFrame, most: int = 64) -> list[Bloom]:
    """Filters that tell listed keys from all other keys of ``universe``, both with one bigint column ``key``.

    Level 1 holds the listed keys; level 2 the keys of the universe that pass it and are not listed; level 3 the
    listed keys that pass level 2; and so on until a level lets nothing wrong through. The first level's
    rate is chosen so that about as many other keys pass as are listed, every later level halves the rest:
    the size depends on the number of listed keys and, by a logarithm, on the universe.
    """
    listed = stored(listed.distinct(), "cascade-listed")
    n, total = listed.count(), universe.count()
    if not n:
        return []
    first = _built(listed, n, max(n, 1) * math.sqrt(0.5) / max(total, 1), 1)
    levels = [first]
    passed = stored(universe.mapInArrow(_probe([first]), "key bigint").join(listed, "key", "left_anti"), "cascade-other")
    inside, other = listed, passed
    while len(levels) < most:
        wrong = other.count()
        if not wrong:
            return levels
        levels.append(_built(other, wrong, 0.5, len(levels) + 1))
        inside, other = other, stored(inside.mapInArrow(_probe([levels[-1]]), "key bigint"), "cascade-other")
    raise RuntimeError("the cascade does not settle: two keys of its universe have the same hash")


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _candidates(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    """(host suffix, path prefix) of every length a rule may have, the longest first."""
    names = host.split(".")
    hosts = [".".join(names[i:]) for i in range(len(names))] if host else []
    found = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return sorted(found, key=lambda x: -len(x[0]) - len(x[1]))


def _keys(lengths: list[int]):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update(_hash(*c) for c in _candidates(host, path, lengths))
            values = np.fromiter(seen, np.uint64, len(seen)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64())], names=["key"])

    return keys


def _judge(lengths: list[int], lists: list[tuple[str, list[Bloom]]], default: str):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules, verdicts, owner, names, keys = [], [], [], [], []
            for i, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                rules.append(None), verdicts.append(default)
                for c in _candidates(host, path, lengths):
                    owner.append(i), names.append("".join(c)), keys.append(_hash(*c))
            keys = np.array(keys, np.uint64)
            hits = [(verdict, member(levels, keys) if levels else np.zeros(len(keys), bool)) for verdict, levels in lists]
            for verdict, hit in hits:
                for k in np.flatnonzero(hit).tolist():
                    i = owner[k]
                    if rules[i] is None or len(names[k]) > len(rules[i]):
                        rules[i], verdicts[i] = names[k], verdict
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return judge


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Allow or block every URL by the longest rule for its host (or a parent domain) and the start of its path.

    ``pages(page_id, url)`` and ``rules(host, path, verdict)`` -> ``(page_id, host, path, rule, verdict)``, one row
    per page. The keys a URL could be listed under are its domain suffixes with the starts of its path in the
    lengths rules have; the keys of the corpus are the universe of one cascade for each verdict, so a lookup
    is exact for every URL and joins nothing. A URL under no rule gets ``default``. Null URLs and those without
    ``://`` have an empty host and path and no rule. A rule given with both verdicts blocks. Other columns
    are ignored; repeated pages are judged alike. Keys are 64-bit hashes.
    """
    wanted = rules.select("host", "path", "verdict").distinct()
    lengths = sorted(r[0] for r in wanted.select(F.length("path")).distinct().collect())
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.fillna("", ["host", "path"])
    universe = stored(
        parts.where("host <> ''").select("host", "path").mapInArrow(_keys(lengths), "key bigint").distinct(),
        "url-keys",
    )
    lists = []
    for verdict in ("block", "allow"):
        # The key of a rule: the same hash over host and path as for a URL.
        listed = wanted.where(F.col("verdict") == verdict).select("host", "path")
        lists.append((verdict, cascade(listed.mapInArrow(_rule_keys, "key bigint"), universe)))
    return parts.mapInArrow(_judge(lengths, lists, default), "page_id bigint, host string, path string, rule string, verdict string")


def _rule_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [_hash(h, p) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())], names=["key"])
