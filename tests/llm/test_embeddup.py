"""Recursive splits of the projection forest: leaves stay small however many vectors a label has, and links are found."""

import numpy as np
from pyspark.sql import functions as F

from turnscope.llm import embeddup

SMALL = {"leaf": 16, "fit_rows": 256, "block": 64}


def planted(n, dim, seed=5):
    """Unrelated vectors, each fourth with a near copy; one label holds all but a few of them."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    base[3::4] = base[2::4] + 0.1 * rng.standard_normal((len(base[3::4]), dim))
    return base


def frame(spark, vectors):
    rows = [(i, v.tolist(), int(i >= len(vectors) - 40)) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def leaves(spark, vectors, trees=4):
    classes = frame(spark, vectors).select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), "embedding"
    )
    spill = embeddup.SPILL * (2 - 2 * embeddup.COSINE) ** 0.5
    found = embeddup.forest_leaves(classes, trees, SMALL["leaf"], spill, SMALL["block"], SMALL["fit_rows"], 7)
    assert found.count() == len(vectors)
    sizes = found.select("label", F.explode("leaves").alias("leaf")).groupBy("label", "leaf").count()
    return np.array([r["count"] for r in sizes.collect()])


def test_leaves_stay_small(spark):
    work = {}
    for n in (2_000, 16_000):
        sizes = leaves(spark, planted(n, 32))
        assert sizes.max() <= SMALL["block"]
        work[n] = (sizes.astype(float) ** 2).sum() / n
    assert work[16_000] < 2 * work[2_000]


def test_recall_of_recursive_leaves(spark):
    vectors = planted(3_000, 32)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    label = np.arange(len(vectors)) >= len(vectors) - 40
    near = (unit @ unit.T >= embeddup.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = {r.vec_id: r for r in embeddup.near_vectors(frame(spark, vectors), **SMALL).collect()}
    links = near.sum(axis=1)
    assert len(found) == len(vectors) and links.sum() > 1_000
    assert all(found[i].n_links <= links[i] for i in found)
    assert sum(r.n_links for r in found.values()) >= 0.9 * links.sum()


def test_dense_node_stays_whole(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal(16) + 0.001 * rng.standard_normal((300, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = embeddup.near_vectors(table, **SMALL).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(299, 0)}


def test_rare_lengths_are_split_too(spark):
    rng = np.random.default_rng(4)
    rows = [(k * 200 + i, rng.standard_normal(k + 8).tolist(), 0) for k in range(18) for i in range(100)]
    rows += [(k * 200 + 100, rows[k * 100][1], 0) for k in range(18)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = {r.vec_id: r for r in embeddup.near_vectors(table, **SMALL).collect()}
    assert all(found[k * 200].n_links >= 1 and found[k * 200 + 100].component_id == k * 200 for k in range(18))
