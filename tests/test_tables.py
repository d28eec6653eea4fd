"""Tables that are changed in part: the bucketed store, the inverted index, medians of any group."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.operators import retrieval as R
from turnscope.operators.gates import test_medians as medians_of_tests
from turnscope.operators.medians import exact_medians
from turnscope.session import work_dir
from turnscope.sources import tables as T


def entry(key, at, n, hits=0):
    return (key, f"provider{n}", f"prompt{n}", f"response{n}", float(at), hits, ["a"], "s")


def files_of(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                bucket = next(p for p in folder.split("/") if p.startswith("bucket="))
                found.setdefault(bucket, set()).add(name)
    return found


def puts(spark, *rows):
    return spark.createDataFrame([r for r in rows], T.STORE_SCHEMA).drop("hit_count")


def test_one_put_rewrites_one_bucket(spark):
    path = work_dir(spark, "store")
    T.create_store(spark.createDataFrame([entry(f"k{i}", i, i, 3) for i in range(200)], T.STORE_SCHEMA), path, 16)
    before = files_of(path)
    assert len(before) == 16
    touched = T.merge_puts(spark, path, puts(spark, entry("k7", 900, 1000)), 16)
    after = files_of(path)
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == {f"bucket={touched[0]}"}
    rows = {r.key: r for r in T.read_buckets(spark, path).collect()}
    assert len(rows) == 200
    assert (rows["k7"].provider, rows["k7"].response_json, rows["k7"].created_at, rows["k7"].hit_count) == ("provider7", "response1000", 900.0, 3)
    # Again: nothing changes. A new key: one row more.
    T.merge_puts(spark, path, puts(spark, entry("k7", 900, 1000)), 16)
    assert {r.key: r for r in T.read_buckets(spark, path).collect()} == rows
    T.merge_puts(spark, path, puts(spark, entry("new", 901, 1001), entry("new", 902, 1002)), 16)
    assert T.read_buckets(spark, path).count() == 201
    assert T.merge_puts(spark, path, puts(spark), 16) == []


def test_sweep_rewrites_what_holds_a_dead_entry(spark):
    path = work_dir(spark, "store")
    T.create_store(spark.createDataFrame([entry(f"k{i}", 100 + i, i) for i in range(40)] + [entry("old", 5, 1)], T.STORE_SCHEMA), path, 64)
    before = files_of(path)
    touched = T.sweep(spark, path, 50.0, 64)
    assert len(touched) == 1
    after = files_of(path)
    assert all(after.get(b) == before[b] for b in before if b != f"bucket={touched[0]}")
    assert sorted(r.key for r in T.read_buckets(spark, path).collect()) == sorted(f"k{i}" for i in range(40))
    # Buckets that lose every entry go.
    T.sweep(spark, path, 120.0, 64)
    assert sorted(r.key for r in T.read_buckets(spark, path).collect()) == sorted(f"k{i}" for i in range(20, 40))
    assert T.sweep(spark, path, 120.0, 64) == []
    T.sweep(spark, path, 1e9, 64)
    assert files_of(path) == {}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    vocabulary = ["the", "Cache", "tokens", "x_1", "Straße", "a", "b", "cache-key", "cached"]
    rows = [(f"d/{i:03}.md", "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    return spark.createDataFrame([*rows, ("empty.md", ""), ("null.md", None)], "path string, content string").repartition(4)


@pytest.mark.parametrize("query", ["cache tokens", "the", "straße X_1", "nothing here", "", "  ", "cache cache CACHE"])
def test_index_answers_like_the_scan(spark, texts, index, query):
    found = R.indexed_search(spark, index, query, top_k=7, parts=32).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in R.keyword_search(texts, query, top_k=7).collect()]


@pytest.fixture(scope="module")
def index(spark, texts):
    path = work_dir(spark, "index")
    R.write_index(texts, path, parts=32, spread=3)
    return path


def test_index_reads_the_folders_of_the_query_only(spark, index):
    rows = R._postings(spark, index, ["cache", "tokens"], 32)
    own = {f"part={R._word_part(w, 32)}" for w in ("cache", "tokens")}
    # What the scan lists after partition pruning.
    read = {p for f in rows.inputFiles() for p in f.split("/") if p.startswith("part=")}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and own <= read
    assert {r.word for r in rows.collect()} <= {"cache", "tokens"}


@pytest.mark.parametrize("bins, held", [(1024, 1 << 16), (8, 16), (2, 2), (1024, 1)])
def test_medians_of_any_group(spark, bins, held):
    rng = random.Random(7)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 500, "mostly": [0.0] * 700 + [1e300, -1e300], "wide": [-1e308, 1e308, 5.0, 6.0],
        "many": [rng.gauss(0, 1) for _ in range(2001)], "even": [rng.expovariate(1e-6) for _ in range(1500)], None: [2.0, 9.0, 4.0],
        "halves": [1.0] * 50 + [2.0] * 50, "far": [k * 1e-9 for k in range(300)] + [1e9 + k for k in range(300)], "signs": [-0.0, 0.0],
    }
    rows = [(k, v, 1) for k, values in groups.items() for v in values]
    rows += [("one", None, 1), ("none", None, 1), ("none", float("nan"), 1), ("two", float("inf"), 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "test string, v double, extra int").repartition(5)
    found = {r.test: (r.median, r["values"]) for r in exact_medians(df, ["test"], "v", bins, held).collect()}
    assert found == {k: (statistics.median(v), len(v)) for k, v in groups.items()}
    alone = exact_medians(df, [], "v", bins, held).collect()
    every = [v for values in groups.values() for v in values]
    assert [tuple(r) for r in alone] == [(statistics.median(every), len(every))]


def test_one_test_in_all_records(spark):
    rows = [(i, {"hot": float(i % 977), f"t{i}": 1.0}) for i in range(20_000)]
    records = spark.createDataFrame(rows, "id int, tests map<string,double>")
    found = medians_of_tests(records)
    assert found.count() == 20_001
    assert found.filter("test = 'hot'").first().median_s == statistics.median(float(i % 977) for i in range(20_000))
    empty = exact_medians(spark.createDataFrame([], "a string, v double"), ["a"], "v")
    assert empty.count() == 0


def test_store_is_shuffled_once_into_its_buckets(spark):
    """Rows that are dealt to their buckets are added up there and written without another exchange."""
    none = spark.createDataFrame([], T.STORE_SCHEMA)
    puts = spark.createDataFrame([entry(f"k{i % 30}", i, i) for i in range(200)], T.STORE_SCHEMA).drop("hit_count")
    dealt = T.upsert(none, puts, 16)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    plain = {tuple(r) for r in T.upsert(none, puts).select("key", "created_at", "response_json").collect()}
    assert {tuple(r) for r in dealt.select("key", "created_at", "response_json").collect()} == plain and len(plain) == 30


def test_postings_of_a_file_are_made_in_its_row(spark):
    rows = spark.createDataFrame([("a", "x y\nY x x\n\nz_1 É"), ("b", ""), ("c", None)], "path string, content string")
    found = rows.select("path", F.explode(R._file_postings(X.lines(F.col("content")))).alias("p")).select("path", "p.*")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.word): r.lines for r in found.collect()} == {
        ("a", "x"): [1, 2], ("a", "y"): [1, 2], ("a", "z_1"): [4], ("a", "é"): [4],
    }
