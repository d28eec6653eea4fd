"""Document fingerprints by a randomised edit embedding."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.support import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Samples of the embedding: from half of CELLS (a text just over a power of two) to all of them.
CELLS = 256
# The shared random walk repeats after so many steps.
PERIOD = 4096
SYMBOLS = 256
# Below so many unfinished texts the walk goes on text by text.
FEW = 48


class Embedding:
    """The walk: at output ``j`` the symbol ``x`` under the pointer is written, and the pointer moves on if the shared coin
    ``(x, j)`` says so. Texts that differ by few edits soon write the same symbols again at the same places.

    Instead of tossing a coin per output, ``run[x, j]`` holds how often symbol ``x`` is written when the pointer
    reaches it at output ``j``.
    """

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        coin = rng.integers(0, 2, (SYMBOLS, PERIOD), np.uint8)
        coin[:, ::16] = 1
        run = np.ones((SYMBOLS, PERIOD), np.uint8)
        twice = np.concatenate([coin, coin], axis=1)
        following = np.full(SYMBOLS, 2 * PERIOD)
        for j in range(2 * PERIOD - 1, -1, -1):
            following = np.where(twice[:, j] == 1, j, following)
            if j < PERIOD:
                run[:, j] = following - j + 1
        self.run = run.reshape(-1)
        self.runs = [bytes(r) for r in run]
        self.symbol_of = rng.integers(0, 1 << 62, 1, np.int64)[0] | 1
        self.seed = seed

    def symbols(self, text: str) -> np.ndarray:
        """Code points as 256 symbols, alike for all texts."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return ((points * np.uint64(self.symbol_of)) >> np.uint64(40)).astype(np.uint8)

    def walks(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Per text: how many outputs each of its symbols writes."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        start = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate([*texts, np.zeros(1, np.uint8)])
        out = np.zeros(len(flat), np.uint8)
        ends = np.sort(size)
        at, phase, i = start[:-1][order].copy(), np.zeros(len(texts), np.int64), 0
        live = len(texts)
        mask = PERIOD - 1
        while True:
            live = len(texts) - int(np.searchsorted(ends, i, side="right"))
            if live <= FEW:
                break
            # All texts that live until the next one ends move in step.
            until = int(ends[len(texts) - live])
            a, p = at[:live], phase[:live]
            for _ in range(i, until):
                r = self.run.take(flat.take(a).astype(np.int64) * PERIOD + p)
                out[a] = r
                p += r
                p &= mask
                a += 1
            i = until
        for k in range(live):
            a, p = int(at[k]), int(phase[k])
            end, runs = int(start[order[k] + 1]), self.runs
            wrote = bytearray(end - a)
            for j, x in enumerate(flat[a:end].tobytes()):
                r = runs[x][p]
                wrote[j] = r
                p = (p + r) & mask
            out[a:end] = np.frombuffer(wrote, np.uint8)
        return [out[start[k] : start[k + 1]] for k in range(len(texts))]

    def places(self, level: int) -> np.ndarray:
        """One output of every cell of 2^level; each level's are half of the level below."""
        place = np.arange(CELLS << 1, dtype=np.uint64)
        for down in range(level, 0, -1):
            bit = (place + np.uint64(down * 0x9E3779B97F4A7C15 + self.seed & (1 << 63) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            place = place * np.uint64(2) + ((bit ^ (bit >> np.uint64(29))) >> np.uint64(17) & np.uint64(1))
        return place.astype(np.int64)

    def prints(self, texts: list[str]) -> list[str]:
        """``LL`` (the level, two hexadecimal digits), then two digits for each sampled symbol."""
        symbols = [self.symbols(t) for t in texts]
        found = []
        for x, wrote in zip(symbols, self.walks(symbols)):
            level = level_of(len(x))
            ends = np.cumsum(wrote, dtype=np.int64)
            places = self.places(level)
            places = places[: np.searchsorted(places, ends[-1] if len(ends) else 0)][: 2 * CELLS]
            got = x[np.searchsorted(ends, places, side="right")]
            found.append(f"{level:02x}" + got.tobytes().hex())
        return found


def level_of(n_chars: int) -> int:
    """A text of n symbols writes about 2n outputs: the level at which these are at most CELLS cells."""
    return max(0, (max(2 * n_chars, 1) - 1).bit_length() - CELLS.bit_length() + 1)


def _samples(fingerprint: str) -> tuple[int, np.ndarray]:
    return int(fingerprint[:2], 16), np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)


def _coarser(embedding: Embedding, samples: np.ndarray, level: int, to: int) -> np.ndarray:
    """The samples of a higher level are among those of the lower."""
    if level == to:
        return samples
    cells = embedding.places(to) >> level
    return samples[cells[cells < len(samples)]]


def likeness(embedding: Embedding, one: str, two: str) -> float:
    """Part of equal samples, 0 to 1: 1 minus the sampled Hamming distance of the embeddings. 1 for two empty texts."""
    if one == two:
        return 1.0
    (la, a), (lb, b) = _samples(one), _samples(two)
    a, b = (_coarser(embedding, x, level, max(la, lb)) for x, level in ((a, la), (b, lb)))
    longer = max(len(a), len(b))
    n = min(len(a), len(b))
    return float((a[:n] == b[:n]).sum() / longer) if longer else 0.0


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]


def _chain(seed: int, chars: int):
    """Rows in order of (bucket, doc_id); the last row of each bucket is the next bucket's first, as a guard."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = Embedding(seed)
        held: list[tuple] = []
        size = 0
        last_print: dict = {}

        def flush(final: bool) -> pa.RecordBatch:
            # The row held last waits for its successor, unless nothing follows.
            rows = held if final else held[:-1]
            texts = [t for *_, t in held]
            following = [held[i + 1][3] if i + 1 < len(held) and held[i + 1][0] == r[0] and r[2] is not None else "" for i, r in enumerate(held)]
            changed = [edited(t, f) for t, f in zip(texts, following)][: len(rows)]
            prints = embedding.prints(texts + changed)
            own, other, empty = prints[: len(held)], prints[len(held) :], embedding.prints([""])[0]
            out = []
            for i, (bucket, guard, doc, text) in enumerate(rows):
                if guard:
                    continue
                follows = i + 1 < len(held) and held[i + 1][0] == bucket and doc is not None
                out.append((
                    doc, len(text), hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest(), own[i], other[i],
                    likeness(embedding, own[i], other[i]), likeness(embedding, own[i], own[i + 1] if follows else empty),
                ))
            del held[: len(rows)]
            columns = list(zip(*out)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2])],
                names=_COLUMNS,
            )

        for batch in batches:
            for bucket, guard, doc, text in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3).to_pylist()):
                held.append((bucket, guard, doc, text or ""))
                size += len(text or "")
                if size > chars:
                    yield flush(False)
                    size = sum(len(r[3]) for r in held)
        yield flush(True)

    return chain


def fingerprints(docs: DataFrame, buckets: int | None = None, seed: int = 11, chars: int = 1 << 23) -> DataFrame:
    """Fingerprint every whole text and the text edited with the next document's start (``edited``).

    ``docs(doc_id, text)`` -> ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``,
    one row per input row. A fingerprint samples the random walk embedding of the text (``Embedding``), in which edit distance
    becomes Hamming distance, at 128 to 256 places over its whole length; places of longer texts are among those of
    shorter ones, so any two fingerprints compare (``likeness``). Equal texts have equal fingerprints.

    The next document is the one of next larger ``doc_id``, after the last the first; rows that repeat a ``doc_id`` follow
    in the order of their texts. Null text is empty. A row without ``doc_id`` has no place in the order: nothing
    follows it and it follows nothing. Other columns are ignored. Texts are shuffled once, into ranges of ``doc_id``
    sorted inside; the first document of each range also goes to the range before as a guard.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)
    cuts = sorted({int(c) for c in cuts})
    # Place among the cuts: at most as many as there are partitions.
    place = F.aggregate(
        F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>"),
        F.lit(0), lambda n, c: n + (F.col("doc_id") >= c).cast("int"),
    )
    place = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).otherwise(place)
    first = {
        b: d for b, d in rows.where("doc_id IS NOT NULL").groupBy(place.alias("b")).agg(F.min("doc_id")).collect()
    }
    order = sorted(first)
    # Where the guard of a range's end starts the next range that has rows; the last ends with the first document.
    follows = {first[b]: order[i - 1] for i, b in enumerate(order)}
    guards = rows.where(F.col("doc_id").isin(list(follows)) if follows else F.lit(False))
    if follows:
        to = F.create_map(*[F.lit(x) for pair in follows.items() for x in pair])
        guards = guards.withColumn("bucket", F.element_at(to, F.col("doc_id")).cast("int"))
    else:
        guards = guards.withColumn("bucket", F.lit(0))
    both = rows.withColumn("bucket", place.cast("int")).withColumn("guard", F.lit(False)).unionByName(
        guards.withColumn("guard", F.lit(True))
    )
    last = F.when(F.col("guard"), 1).when(F.col("doc_id").isNull(), 2).otherwise(0)
    dealt = (
        both.repartition(max(parts, 1), "bucket")
        .sortWithinPartitions("bucket", last, "doc_id", "text")
        .select("bucket", "guard", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    )
    return dealt.mapInArrow(_chain(seed, chars), _OUT)


def bands(fingerprint: str, size: int = 8) -> list[str]:
    """Bit-sampled bands: ``size`` samples each, with the place and level."""
    level, body = fingerprint[:2], fingerprint[2:]
    return [f"{level}:{i}:{body[i : i + 2 * size]}" for i in range(0, len(body) - 2 * size + 1, 2 * size)]


def near_prints(prints: DataFrame, least: float = 0.8, size: int = 8) -> DataFrame:
    """Documents with alike fingerprints: ``prints(doc_id, fingerprint)`` -> links ``(a, b, likeness)`` per band.

    Equal fingerprints are one class, of its smallest ``doc_id``. Classes that share a band are compared with the smallest
    one of that band, and those under ``least`` drop out. So a band of many alike documents gives a star, not all pairs;
    documents without a common band, or alike only to others of a band than its smallest, are not linked by it.
    Texts whose lengths differ by a power of two have no common band. Null fingerprints link with nothing.
    """
    rows = prints.where("doc_id IS NOT NULL AND fingerprint IS NOT NULL")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    level, body = F.substring("fingerprint", 1, 2), F.expr("substring(fingerprint, 3)")
    count = F.floor(F.length(body) / (2 * size))
    one = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda i: F.concat_ws(":", level, i, F.substr(body, (i * 2 * size + 1).cast("int"), F.lit(2 * size))),
    )
    banded = classes.withColumn("band", F.explode(one))
    star = banded.groupBy("band").agg(F.min(F.struct("node", "fingerprint")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = banded.join(star, "band").where("node <> hub.node").select(
        F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.fingerprint").alias("x"), F.col("fingerprint").alias("y")
    ).distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = Embedding()
        for batch in batches:
            score = [likeness(embedding, x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "likeness"])

    near = pairs.mapInArrow(verify, "a bigint, b bigint, likeness double").where(F.col("likeness") >= least)
    copies = rows.join(classes, "fingerprint").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness"))
    return near.unionByName(copies)
