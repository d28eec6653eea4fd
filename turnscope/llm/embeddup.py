"""Embedding near-dedup by a forest of random projection trees."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.components import components
from turnscope.llm.support import mixed, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COSINE = 0.98
TREES = 4
# Members of a node that its tree is fitted on, chosen by hash: about so many, and no more than so many bytes.
FIT_ROWS = 20_000
FIT_BYTES = 64 << 20
LEAF = 384
# Directions a split chooses from; made from the seed where they are needed, so a tree is only numbers of directions and cuts.
WAYS = 256
# Half the overlap of the two sides of a split, as a part of the longest difference of linked unit vectors.
SPILL = 1 / 16
# Rows of a leaf that one task compares at once; larger leaves are split again, dense ones compared in pairs of blocks.
BLOCK = 2048
# Rows one task sorts into a tree: about so many, and no more than so many bytes.
PART_ROWS = 16_384
PART_BYTES = 64 << 20


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(
        zero_copy_only=False
    ).reshape(len(column), -1)


def _projected(unit: np.ndarray, seed: int) -> np.ndarray:
    """Products of unit vectors with all directions of their length."""
    ways = np.random.default_rng([seed, unit.shape[1]]).standard_normal((WAYS, unit.shape[1]))
    ways /= np.linalg.norm(ways, axis=1, keepdims=True)
    return unit @ ways.T


class Tree:
    """Splits of a node's members: number of the direction (-1: a leaf), cut, and the two sides."""

    def __init__(self) -> None:
        self.way: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []

    def grow(self, seen: np.ndarray, rows: np.ndarray, per_row: float, leaf: int, spill: float, rng) -> int:
        """Split at the median of a random direction while the node should hold more than ``leaf`` vectors.

        Where most of a node lies within the overlap of every direction tried, its vectors are near each other, and it
        stays a leaf however large it is.
        """
        at = len(self.way)
        self.way.append(-1)
        self.cut.append(0.0)
        self.left.append(0)
        self.right.append(0)
        if len(rows) * per_row <= leaf or len(rows) < 8:
            return at
        for way in rng.choice(seen.shape[1], 16 if at == 0 else 4, replace=False).tolist():
            here = seen[rows, way]
            cut = float(np.median(here))
            low, high = rows[here <= cut + spill], rows[here >= cut - spill]
            if max(len(low), len(high)) <= 0.75 * len(rows):
                self.way[at], self.cut[at] = way, cut
                self.left[at] = self.grow(seen, low, per_row, leaf, spill, rng)
                self.right[at] = self.grow(seen, high, per_row, leaf, spill, rng)
                break
        return at

    def leaves(self, seen: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves they fall into; a row near a cut goes to both sides."""
        rows, found = [], []
        todo = [(0, np.arange(len(seen)))]
        while todo:
            at, here = todo.pop()
            if self.way[at] < 0:
                rows.append(here)
                found.append(np.full(len(here), at))
                continue
            x = seen[here, self.way[at]]
            todo.append((self.left[at], here[x <= self.cut[at] + spill]))
            todo.append((self.right[at], here[x >= self.cut[at] - spill]))
        return np.concatenate(rows), np.concatenate(found)


# The node all vectors of a label and a length start in: it gets all trees, any other node is part of one.
ROOT = 0


def _fitted(trees: int, leaf: int, spill: float, seed: int):
    """A sample of one node's members -> its trees, one row each."""

    def fitted(key: tuple, table: pa.Table) -> pa.Table:
        node, total = key[2].as_py(), table.column("rows")[0].as_py()
        seen = _projected(_unit(_matrix(table.column("embedding"))), seed)
        grown = []
        for k in range(trees if node == ROOT else 1):
            tree = Tree()
            rng = np.random.default_rng([seed, k, node & (1 << 63) - 1])
            tree.grow(seen, np.arange(len(seen)), total / len(seen), leaf, spill, rng)
            grown.append(tree)
        n = len(grown)
        return pa.table({
            "dim": pa.array([key[0].as_py()] * n, pa.int32()), "label": pa.array([key[1].as_py()] * n, pa.string()),
            "leaf": pa.array([node] * n, pa.int64()), "rows": pa.array([total] * n, pa.int64()), "tree": pa.array(range(n), pa.int32()),
            "way": pa.array([t.way for t in grown], pa.list_(pa.int32())),
            "cut": pa.array([t.cut for t in grown], pa.list_(pa.float64())),
            "left": pa.array([t.left for t in grown], pa.list_(pa.int32())),
            "right": pa.array([t.right for t in grown], pa.list_(pa.int32())),
        })

    return fitted


def _named(node: int, tree: int, at: np.ndarray, dense: bool) -> np.ndarray:
    """Numbers of the leaves of a node's tree; an odd one is dense and is not split again."""
    if dense:
        return np.full(len(at), node | 1)
    key = np.uint64((node ^ (tree + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    return (mixed(mixed(np.full(len(at), key)) + at.astype(np.uint64)) & ~np.uint64(1)).astype(np.int64)


def _sorted_in(spill: float, seed: int):
    """Some members of a node, and the node's trees -> the leaves of each member."""

    def sorted_in(key: tuple, table: pa.Table, trees: pa.Table) -> pa.Table:
        node, ids = key[2].as_py(), table.column("id").to_numpy()
        if table.num_rows and trees.num_rows:
            seen = _projected(_unit(_matrix(table.column("embedding"))), seed)
            rows, leaves = [], []
            for t in trees.to_pylist():
                tree = Tree()
                tree.way, tree.cut, tree.left, tree.right = t["way"], t["cut"], t["left"], t["right"]
                found, at = tree.leaves(seen, spill)
                rows.append(found)
                leaves.append(_named(node, t["tree"], at, tree.way[0] < 0))
            rows, leaves = np.concatenate(rows), np.concatenate(leaves)
        else:  # no sample was drawn: the next round tries again
            rows, leaves = np.arange(len(ids)), np.full(len(ids), node)
        return pa.table({
            "id": pa.array(ids[rows], pa.int64()), "leaf": pa.array(np.full(len(rows), node), pa.int64()),
            "into": pa.array(leaves, pa.int64()),
        })

    return sorted_in


def forest_leaves(
    classes: DataFrame, trees: int, leaf: int, spill: float, limit: int, fit_rows: int, seed: int
) -> DataFrame:
    """``classes(id, label, dim, embedding)`` -> ``(id, label, dim, leaves)``: the leaves of each vector in all trees.

    Every round splits the nodes that hold more than ``limit`` vectors of one label and length. A node's tree is fitted in
    one task on a bounded sample of its own members; the members are sorted in by tasks of bounded size, however many the
    node has. A tree grows down to ``leaf`` vectors or to eight of its sample, so a round divides a node by up to
    some ``fit_rows / 8``, and there are few rounds. Dense nodes, which no direction halves, stay as they are.
    """
    keys = ["dim", "label", "leaf"]
    places = classes.select("id", "label", "dim", F.array(F.lit(ROOT).cast("bigint")).alias("leaves"))
    turn = 0
    while True:
        one = places.select("id", "label", "dim", F.explode("leaves").alias("leaf"))
        open_ = one.where(F.col("leaf") % 2 == 0)
        big = stored(open_.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > limit), "large-nodes")
        if big.isEmpty():
            return places
        if turn == 0:
            members = classes.select("id", "label", "dim", F.lit(ROOT).cast("bigint").alias("leaf"), "embedding").join(big, keys)
        else:
            members = stored(open_.join(big, keys).join(classes.select("id", "embedding"), "id"), "node-members")
        fit = F.least(F.lit(fit_rows), F.ceil(F.lit(FIT_BYTES / 8) / F.col("dim")))
        drawn = F.pmod(F.xxhash64("id", F.lit(seed + turn)), F.lit(1 << 30)) < fit / F.col("rows") * float(1 << 30)
        grown = stored(
            members.where(drawn).groupBy(*keys).applyInArrow(
                _fitted(trees, leaf, spill, seed),
                "dim int, label string, leaf bigint, rows bigint, tree int, way array<int>, cut array<double>, left array<int>, right array<int>",
            ),
            "node-trees",
        )
        part_rows = F.least(F.lit(PART_ROWS), F.ceil(F.lit(PART_BYTES / 8) / F.col("dim")))
        parts = F.ceil(F.col("rows") / part_rows)
        dealt = members.withColumn("part", F.pmod(F.xxhash64("id"), parts))
        offered = grown.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        into = dealt.groupBy(*keys, "part").cogroup(offered.groupBy(*keys, "part")).applyInArrow(
            _sorted_in(spill, seed), "id bigint, leaf bigint, into bigint"
        )
        moved = into.groupBy("id").agg(F.collect_list(F.struct("leaf", "into")).alias("moved"))
        was = F.transform("moved", lambda m: m["leaf"])
        stay = F.filter("leaves", lambda x: ~F.array_contains(was, x))
        new = F.array_sort(F.array_distinct(F.concat(stay, F.transform("moved", lambda m: m["into"]))))
        places = stored(
            places.join(moved, "id", "left").select(
                "id", "label", "dim", F.when(F.col("moved").isNull(), F.col("leaves")).otherwise(new).alias("leaves")
            ),
            "vector-leaves",
        )
        turn += 1


def _compare(cosine: float):
    """Rows of one leaf (or of two of its blocks) -> per node the copies of its links, and spanning links."""

    def compare(table: pa.Table) -> pa.Table:
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        leaf, block = table.column("leaf")[0].as_py(), table.column("block").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        unit = _unit(_matrix(table.column("embedding")))
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        if i != j:  # pairs inside a block are another group's
            near &= block[:, None] != block[None, :]
        # A pair that shares an earlier leaf is counted there.
        lists = table.column("leaves").combine_chunks()
        values, owner = lists.values.to_numpy(), np.repeat(np.arange(len(nodes)), np.diff(lists.offsets.to_numpy()))
        owner, values = owner[values < leaf], values[values < leaf]
        order = np.argsort(values, kind="stable")
        links = near.copy()
        for rows in np.split(owner[order], np.flatnonzero(np.diff(values[order])) + 1):
            if len(rows) > 1:
                near[np.ix_(rows, rows)] = False
        count = near @ copies
        a, b = [], []
        todo = np.ones(len(nodes), bool)
        for start in range(len(nodes)):
            if not todo[start]:
                continue
            todo[start], edge = False, np.array([start])
            while len(edge):
                edge = np.flatnonzero(links[edge].any(axis=0) & todo)
                todo[edge] = False
                a += [int(nodes[start])] * len(edge)
                b += nodes[edge].tolist()
        return pa.table({
            "a": pa.array([*nodes.tolist(), *a], pa.int64()),
            "b": pa.array([None] * len(nodes) + b, pa.int64()),
            "n": pa.array([*count.tolist(), *[0] * len(a)], pa.int64()),
        })

    return compare


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
    fit_rows: int = FIT_ROWS,
    block: int = BLOCK,
    seed: int = 7,
) -> DataFrame:
    """Link vectors of equal label with a cosine of at least ``cosine``, in double precision.

    ``vectors(vec_id, embedding, label)`` -> ``(vec_id, n_links, component_id, kept)``, one row per input row.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest ``vec_id`` that links reach.
    Null, empty or zero vectors, vectors with null or non-finite components, rows without label or ``vec_id`` and
    vectors of different lengths link with nothing.

    Equal vectors of a label are one node that stands for its copies. The vectors of each label and length are sorted
    into ``trees`` random projection trees (``forest_leaves``), those near a split into both sides, until a leaf
    holds at most ``block`` of them or is dense. Vectors of one leaf are compared by a matrix product in one
    task; a dense leaf over ``block`` rows is dealt into blocks, compared in pairs. No pair
    is ever a row: a task returns the number of links per vector, counting a pair only in the first leaf it
    shares, and a spanning set of its links. Recall is below 1 only for pairs separated in every tree.
    """
    spill = SPILL * math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = rows.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    ).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    able = able.withColumn("class", F.xxhash64("embedding"))
    classes = stored(
        able.groupBy("label", "class", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
        .select(
            F.monotonically_increasing_id().alias("id"), "node", "embedding", "label", "copies",
            F.size("embedding").alias("dim"),
        ),
        "vector-classes",
    )
    places = forest_leaves(classes, trees, leaf, spill, block, fit_rows, seed)
    routed = places.select("id", "leaves").join(classes, "id")
    spread = routed.select("*", F.explode("leaves").alias("leaf"))
    keys = ["dim", "label", "leaf"]
    of_leaf = places.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy(*keys)
    size = of_leaf.agg(F.ceil(F.count("*") / block).alias("n"), F.count("*").alias("rows")).where("rows > 1")
    dealt = spread.join(size.drop("rows"), keys).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        *keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "embedding", "copies", "leaves",
    )
    found = stored(
        pairs.groupBy(*keys, "i", "j").applyInArrow(_compare(cosine), "a bigint, b bigint, n bigint"), "vector-links"
    )
    count = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    # A vec_id with several vectors has several classes; each copy is joined to its own.
    mine = able.select("vec_id", "embedding", "label", "class").join(
        classes.select("embedding", "label", F.xxhash64("embedding").alias("class"), "node", "copies"),
        ["label", "class", "embedding"],
    )
    edges = found.where("b IS NOT NULL").select("a", "b").unionByName(
        mine.where("vec_id <> node").select(F.col("node").alias("a"), F.col("vec_id").alias("b"))
    )
    group = components(edges)
    per_vector = (
        mine.join(count, "node", "left").groupBy("vec_id")
        .agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .join(group, F.col("vec_id") == F.col("node"), "left").select("vec_id", "n_links", "component")
    )
    out = rows.select("vec_id").join(per_vector, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
