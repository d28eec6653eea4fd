"""What the near copies leave on disk: shuffles and tables go when nothing reads them any more."""

import os
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from turnscope.llm import jaccard
from turnscope.llm.support import released, shared_folder, stored


def tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {x for x in os.listdir(folder)} if os.path.isdir(folder) else set()


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


@pytest.fixture
def copies(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices("abcdefghij", k=60)) for _ in range(30)]
    rows = [(i, texts[i % 30] + (" x" if i % 4 == 0 else "")) for i in range(90)] + [(None, texts[0]), (None, None), (3, texts[3]), (200, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_stored_leaves_no_shuffle(spark):
    before = shuffles(spark)
    table = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "disk-test")
    assert shuffles(spark) <= before and table.count() == 7
    name = table.stored_at.rpartition("/")[2]
    assert name in tables(spark)
    released(table)
    assert name not in tables(spark)


@pytest.mark.parametrize("region", [1024, 3])
def test_near_copies_leave_no_tables(spark, copies, region):
    had = tables(spark)
    found = jaccard.jaccard_components(copies, region=region)
    left = {re.sub("-[0-9a-f]{32}$", "", x) for x in tables(spark) - had}
    assert left == {"jaccard-sizes", "small-star"}
    assert found.count() == 94


def test_texts_without_copies_are_shuffled_once(spark, copies):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_copies(spark, copies, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search(r"Exchange hashpartitioning\([^)]*same#", plan)
        ids = [r.doc_id for r in kept.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == [*range(30), 200]
