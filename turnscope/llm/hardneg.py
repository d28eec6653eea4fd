"""Hard negatives: rows of another label that score just below an anchor's positives."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnscope.llm.support import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES, NEGATIVES = 5, 3
# Negatives score between these hundredths of the positive's score.
LOW, HIGH = 50, 95
SCALE = 256
# Anchors and candidates of one product, and the sides below which Strassen's recursion multiplies directly.
ANCHORS, CANDIDATES, LEAF = 256, 1024, 16
# Bytes of candidates that a task holds while all anchors pass, and groups at least, so that a small table is spread too.
GROUP_BYTES, GROUPS = 32 << 20, 64
# Squared length a whole-number vector stays below: a hundred times any score then fits 64 bits.
LONGEST = 2.0**56
# Score of an empty place in a heap, below all scores.
NONE = -(1 << 62)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by Strassen's seven products, recursively; exact wherever the result fits 64 bits.

    Sides are padded with zeros to a multiple of two for each level. Sums between may wrap around 64 bits: they are
    exact modulo 2^64, and so is the result.
    """
    (m, k), n = a.shape, b.shape[1]
    levels = max(0, math.floor(math.log2(max(min(m, k, n), 1) / leaf)))
    step = 1 << levels
    pad = lambda x: np.pad(x, [(0, -s % step) for s in x.shape])
    return _strassen(pad(a), pad(b), levels)[:m, :n]


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if levels == 0:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    down = levels - 1
    p1 = _strassen(a11 + a22, b11 + b22, down)
    p2 = _strassen(a21 + a22, b11, down)
    p3 = _strassen(a11, b12 - b22, down)
    p4 = _strassen(a22, b21 - b11, down)
    p5 = _strassen(a11 + a12, b22, down)
    p6 = _strassen(a21 - a11, b11 + b12, down)
    p7 = _strassen(a12 - a22, b21 + b22, down)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])


class Heaps:
    """For each of ``n`` owners its best ``k`` (score, id): higher scores first, then smaller ids. Heaps can be merged."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def merge(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in (owner x some) scores and ids."""
        k = self.score.shape[1]
        score, ids = np.concatenate([self.score, score], axis=1), np.concatenate([self.id, ids], axis=1)
        best = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score, self.id = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)

    def push(self, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in a tile (owner x candidate), which is used up; ``ids`` ascend, so the first of equals is the smallest."""
        n, k = self.score.shape
        k = min(k, len(ids))
        best, owner = np.empty((n, k), np.int64), np.arange(n)
        top = np.empty((n, k), np.int64)
        for j in range(k):
            at = score.argmax(axis=1)
            best[:, j], top[:, j] = ids[at], score[owner, at]
            score[owner, at] = NONE
        self.merge(top, best)


def _vectors(lists: pa.ListArray) -> np.ndarray:
    """Vectors as one matrix; shorter ones end in zeros."""
    size = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    width = int(size.max()) if len(size) else 0
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _stacked(many: list[np.ndarray]) -> np.ndarray:
    width = max(m.shape[1] for m in many)
    return np.concatenate([_wide(m, width) for m in many])


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


_NEAR = ["near", "near_scores"]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor rows as tiles of ``ANCHORS`` rows at most and of about 8 MB."""
    for batch in batches:
        width = max((len(v) for v in batch.column("vector")), default=0)
        step = max(1, min(ANCHORS, (1 << 20) // max(width, 1)))
        for i in range(0, batch.num_rows, step):
            piece = batch.slice(i, step)
            columns = [piece.column(c).to_pylist() for c in ("vec_id", "label", "vector", *_NEAR)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([columns[0]], pa.list_(pa.int64())), pa.array([columns[1]], pa.list_(pa.int64())),
                 *[pa.array([c], pa.list_(pa.list_(pa.int64()))) for c in columns[2:]]],
                names=["ids", "labels", "vectors", *_NEAR],
            )


class Anchors:
    """Anchors that pass a group of candidates together, and the heaps they fill."""

    def __init__(self, pieces: list[pa.RecordBatch], k: int, find: bool, limits: tuple[int, int]) -> None:
        self.ids, self.labels = [_flat(pieces, c) for c in ("ids", "labels")]
        self.matrix = _stacked([_vectors(p.column("vectors").flatten()) for p in pieces])
        n = len(self.ids)
        if find:
            self.near = None
            self.heaps = [Heaps(n, k)]
            return
        near, scores = [[x for p in pieces for x in p.column(c).flatten().to_pylist()] for c in _NEAR]
        slots = max(map(len, near), default=0)
        self.near = np.zeros((n, slots), np.int64)
        self.near_scores = np.full((n, slots), NONE, np.int64)
        for i, (a, b) in enumerate(zip(near, scores)):
            self.near[i, : len(a)], self.near_scores[i, : len(b)] = a, b
        some = self.near_scores != NONE
        own = np.where(some, self.near_scores, 0)
        # 100 * score against low and high hundredths of the positive's, rounded to whole scores.
        self.low = np.where(some, -((-limits[0] * own) // 100), 1)
        self.high = np.where(some, (limits[1] * own) // 100, 0)
        self.heaps = [Heaps(n, k) for _ in range(slots)]

    def meet(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        width = max(matrix.shape[1], self.matrix.shape[1])
        score = strassen(_wide(self.matrix, width), np.ascontiguousarray(_wide(matrix, width).T))
        same = self.labels[:, None] == labels[None, :]
        if self.near is None:
            self.heaps[0].push(np.where(same & (self.ids[:, None] != ids[None, :]), score, NONE), ids)
            return
        score[same] = NONE
        for slot, heap in enumerate(self.heaps):
            inside = (score >= self.low[:, slot, None]) & (score <= self.high[:, slot, None])
            if inside.any():
                heap.push(np.where(inside, score, NONE), ids)

    def found(self) -> Iterator[pa.RecordBatch]:
        for slot, heap in enumerate(self.heaps):
            i, j = np.nonzero(heap.score != NONE)
            near = self.near[i, slot] if self.near is not None else self.ids[i]
            near_score = self.near_scores[i, slot] if self.near is not None else np.zeros(len(i), np.int64)
            columns = [self.ids[i], near, near_score, heap.id[i, j], heap.score[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_FOUND)


_FOUND = ["anchor_id", "near_id", "near_score", "found_id", "found_score"]


def _pass(k: int, find: bool, limits: tuple[int, int]):
    """Rows of a group, candidates first; then every anchor meets all of them, tile by tile."""

    def run(group: list[pa.RecordBatch], pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not group or not pieces:
            return
        ids, labels = [_flat(group, c) for c in ("ids", "labels")]
        order = np.argsort(ids)
        matrix = _stacked([_vectors(g.column("vectors").flatten()) for g in group])[order]
        ids, labels = ids[order], labels[order]
        step = max(64, min(CANDIDATES, (1 << 20) // max(matrix.shape[1], 1)))
        anchors = Anchors(pieces, k, find, limits)
        for i in range(0, len(ids), step):
            anchors.meet(ids[i : i + step], labels[i : i + step], matrix[i : i + step])
        yield from anchors.found()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, pieces = None, [], []
        for batch in batches:
            part, anchors = batch.column("part").to_numpy(), batch.column("anchors").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((part[1:] != part[:-1]) | anchors[1:] | anchors[:-1]) + 1
            for i, j in zip([0, *edges], [*edges, len(part)]):
                if i == j:
                    continue
                if part[i] != now:
                    yield from run(group, pieces)
                    now, group, pieces = part[i], [], []
                if not anchors[i]:
                    group.append(batch.slice(i, j - i))
                    continue
                pieces.append(batch.slice(i, j - i))
                if sum(len(p.column("ids")[0]) for p in pieces) >= ANCHORS:
                    yield from run(group, pieces)
                    pieces = []
        yield from run(group, pieces)

    return meet


def _flat(pieces: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).flatten().to_numpy() for p in pieces])


def whole_vectors(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """``rows(vec_id, label, embedding)`` -> ``(vec_id, label, vector)`` in whole numbers, one row for each ``vec_id`` that takes part."""
    kinds = {"vec_id": "bigint", "label": "bigint", "embedding": "array<double>"}
    able = rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]).dropna(subset=list(kinds))
    able = able.where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    long = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * scale).cast("double"), 2))
    able = able.where(long < LONGEST)
    vector = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    once = able.select("vec_id", F.struct("label", vector.alias("vector")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return once.select("vec_id", "row.label", "row.vector")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The heaps of all groups, merged."""
    first = Window.partitionBy(*keys).orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
) -> DataFrame:
    """For each anchor and each of its positives, the best rows of another label that score well below the positive.

    ``rows(vec_id, label, embedding)`` -> ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``. A component
    x counts as ``floor(scale * x)``; a score is the exact inner product. Higher scores come first, ties by smaller
    ``vec_id``. Positives are the anchor's first ``positives`` other rows of its label; negatives the first ``negatives`` of the rows
    of another label whose score is from ``low`` to ``high`` hundredths of the positive's (no score can be, where that is below 0).
    ``is_anchor`` is a condition on ``vec_id`` and ``label``.

    The stated anchors meet all rows, in blocks. Rows are dealt by hash to groups of bounded bytes; tiles of anchors are copied to each
    group and pass one after the other, so that a task holds one group and one tile. A tile's scores are one product
    by Strassen's method. Heaps of positives leave the task with at most ``positives`` rows an anchor and are merged by anchor;
    a second pass fills a heap for each window, and is merged in the same way. Nothing is dealt by label, so a frequent label
    is as even as any other.

    Rows with a null ``vec_id``, label or vector, or with a null or non-finite component take no part, nor do vectors whose squared length in
    whole numbers reaches 2^56, beyond which scores could leave 64 bits. Of rows that repeat a ``vec_id`` the one of
    smallest label, then vector takes part. Shorter vectors count as if they ended in zeros. An anchor without
    positives, or with no row in a window, has no row there. Other columns are ignored.
    """
    spark = rows.sparkSession
    able = stored(whole_vectors(rows, scale), "hardneg-rows")
    size = able.agg(F.sum(F.size("vector").cast("bigint") * 8 + 32)).first()[0] or 0
    parts = max(GROUPS, math.ceil(size / GROUP_BYTES))
    nothing = F.array().cast("array<array<bigint>>")
    candidates = able.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"),
        F.lit(False).alias("anchors"),
        F.array("vec_id").alias("ids"),
        F.array("label").alias("labels"),
        F.array("vector").alias("vectors"),
        nothing.alias("near"),
        nothing.alias("near_scores"),
    )
    tile = "ids array<bigint>, labels array<bigint>, vectors array<array<bigint>>, near array<array<bigint>>, near_scores array<array<bigint>>"
    shape = ", ".join(f"{c} bigint" for c in _FOUND)

    def passed(anchors: DataFrame, k: int, find: bool) -> DataFrame:
        tiles = anchors.mapInArrow(_pack, tile).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        tiles = tiles.withColumn("anchors", F.lit(True)).select(*candidates.columns)
        dealt = candidates.unionByName(tiles).repartition(parts, "part").sortWithinPartitions("part", "anchors")
        return dealt.mapInArrow(_pass(k, find, (low, high)), shape)

    anchors = able.where(is_anchor)
    none = F.array().cast("array<bigint>")
    first = passed(anchors.withColumns({"near": none, "near_scores": none}), positives, True)
    one = F.collect_list(F.struct("found_id", "found_score"))
    near = _best(first, ["anchor_id"], positives).groupBy(F.col("anchor_id").alias("vec_id")).agg(one.alias("best"))
    near = near.select("vec_id", F.col("best.found_id").alias("near"), F.col("best.found_score").alias("near_scores"))
    windows = stored(anchors.join(near, "vec_id"), "hardneg-windows")
    best = _best(passed(windows, negatives, False), ["anchor_id", "near_id"], negatives)
    return best.select(
        "anchor_id",
        F.col("near_id").alias("positive_id"),
        "rank",
        F.col("found_id").alias("negative_id"),
        F.col("near_score").alias("positive_score"),
        F.col("found_score").alias("negative_score"),
    )
