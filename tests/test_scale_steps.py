"""Steps that must stay exact when one key holds much of the table."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from turnscope import fixed
from turnscope.functions import text as X
from turnscope.operators import matching as M
from turnscope.operators.ordered import dense_index, lookup_join, running_sum
from turnscope.operators.protocol import pair_tool_replies
from turnscope.operators.replay import replay
from turnscope.plans import registry
from turnscope.plans.catalog import QUERIES


def hot_rows(n=3000, seed=5):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 40)}", i, rng.randint(0, 9)) for i in range(n)]


def test_running_sum_and_index(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint").repartition(7)
    found = running_sum(dense_index(df, ["k"], "pos", "no", width=64), ["k"], "pos", {"s": F.col("v")}, width=100)
    sums, counts = Counter(), Counter()
    expected = {}
    for k, pos, v in rows:
        sums[k] += v
        expected[pos] = (counts[k], sums[k])
        counts[k] += 1
    assert {r.pos: (r.no, r.s) for r in found.collect()} == expected


def test_lookup_join_with_few_hot_keys(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    per_key = df.filter("k <> 'k7'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    found = lookup_join(df, per_key, ["k"], "n", ["pos"], count=2).collect()
    n, top = Counter(r[0] for r in rows), defaultdict(int)
    for k, _, v in rows:
        top[k] = max(top[k], v)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.top) == ((None, None) if r.k == "k7" else (n[r.k], top[r.k]))


def test_hot_and_null_keys_are_dealt(spark):
    rows = [("hot" if i % 2 else None, i) for i in range(4000)] + [(f"k{i}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, pos bigint")
    per_key = df.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    found = lookup_join(df, per_key, ["k"], "n", ["pos"], count=1)
    assert {(r.k, r.n) for r in found.select("k", "n").distinct().collect()} == {
        (None, None), ("hot", 2000), *[(f"k{i}", 1) for i in range(40)]
    }
    assert found.count() == len(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup_join(df, per_key, ["k"], "n", ["pos"], count=1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [line for line in plan.splitlines() if "SortMergeJoin" in line or "hashpartitioning" in line]
    assert any("SortMergeJoin" in line and "_salt" in line for line in shuffles), plan
    assert sum("hashpartitioning" in line and "_salt" in line for line in shuffles) == 2, plan


def test_index_without_keys_over_blocks(spark, monkeypatch):
    monkeypatch.setattr("turnscope.operators.ordered.BLOCK", 4)
    places = random.Random(3).sample(range(1 << 20), 500)
    df = spark.createDataFrame([(p,) for p in places], "pos bigint").repartition(5)
    found = dense_index(df, [], "pos", "no", width=1 << 10).collect()
    assert [r.pos for r in sorted(found, key=lambda r: r.no)] == sorted(places)
    assert sorted(r.no for r in found) == list(range(500))


def test_replay_against_a_walk(spark):
    rng = random.Random(11)
    rows, ttl = [], 50.0
    for i in range(900):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}"
        rows.append((key, float(rng.randint(0, 400)), i, rng.random() < 0.8))
    df = spark.createDataFrame(rows, "key string, at double, ordinal bigint, cacheable boolean")

    def walk(items, last):
        out = {}
        for key, at, ordinal, cacheable in sorted(items, key=lambda r: (r[1], r[2])):
            out[ordinal] = key in last and last[key] >= at - ttl
            if not out[ordinal] and cacheable:
                last[key] = at
        return out

    last = {}
    expected = walk([r for r in rows if r[1] < 200], last)
    first, state = replay(df.filter("at < 200"), ttl)
    assert {r.ordinal: r.hit for r in first.collect()} == expected
    assert {r.key: r.last_write for r in state.collect()} == last
    # A second batch goes on from the state of the first one.
    expected = walk([r for r in rows if r[1] >= 200], last)
    second, state = replay(df.filter("at >= 200"), ttl, state)
    assert {r.ordinal: r.hit for r in second.collect()} == expected
    assert {r.key: r.last_write for r in state.collect()} == last


def test_pairing_against_a_queue(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for p in range(60):
        waiting, made = defaultdict(list), Counter()
        for t in range(rng.randint(1, 10)):
            parts = [
                (rng.choice(["call", "reply"]), rng.choice("fg"), rng.choice([None, None, f"id{t}"])) for _ in range(3)
            ]
            for j, (kind, fn, given) in enumerate(parts):
                rows.append((p, t, j, kind, fn, given))
                if kind == "call":
                    if not given:
                        made[fn] += 1
                        given = f"call_{fn}" + (f"_{made[fn]}" if made[fn] > 1 else "")
                    waiting[fn].append(given)
                    expected[p, t, j] = given
            for j, (kind, fn, given) in enumerate(parts):
                if kind == "reply":
                    expected[p, t, j] = given or (waiting[fn].pop(0) if waiting[fn] else f"call_{fn}")
    schema = "payload_id int, turn_idx int, part_idx int, kind string, fn string, given_id string"
    found = pair_tool_replies(spark.createDataFrame(rows, schema)).collect()
    assert {(r.payload_id, r.turn_idx, r.part_idx): r.call_id for r in found} == expected


def prompt_rows(spark, rows):
    df = spark.createDataFrame(rows, "probe_id int, provider string, text string, system string, created_at double")
    shaped = df.withColumn("json", F.to_json(F.struct("system", "text"))).withColumn(
        "response_json", F.concat(F.lit("r"), "probe_id")
    )
    return M.prompt_entries(
        shaped, "json", "provider", "text", "system", "probe_id", "created_at", "response_json"
    )


def test_similar_matches_against_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    base = [rng.sample(words, 14) for _ in range(6)]
    rows = []
    for i in range(220):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice(words)
        if i % 40 == 0:
            text = []
        rows.append((i, "hot" if i % 4 else "p", " ".join(text), rng.choice(["a", "b"]), 1000.0 - i))
    entries = prompt_rows(spark, rows)
    stored = entries.filter("probe_id % 2 = 0")
    sets = {r[0]: set(r[2].split()) for r in rows}

    def best(limit):
        out = {}
        for i, provider, _, system, _ in rows:
            # Newest first is lowest id first here; everything older than the time to live is gone.
            fresh = [r for r in rows if r[0] % 2 == 0 and r[1] == provider and r[4] >= 1000.0 - 150.0][:limit]
            hits = [
                r[0]
                for r in fresh
                if r[3] == system and sets[i] and sets[r[0]]
                and len(sets[i] & sets[r[0]]) / len(sets[i] | sets[r[0]]) >= 0.85
            ]
            out[i] = f"r{hits[0]}" if hits else None
        return out

    found = M.similar_matches(entries, stored, 1000.0, 150.0, limit=12).collect()
    assert {r.probe_id: r.similar_response for r in found} == best(12)
    assert any(r.similar_response for r in found)
    wide = M.similar_matches_unbounded(entries, stored, 1000.0, 150.0).collect()
    assert {r.probe_id: r.similar_response for r in wide} == best(10_000)


def test_store_rules(spark):
    rows = [
        (1, "openai", "Fix the login page now please and thank you", "sys", 100.0),
        (2, "openai", "fix the login page now please and thank you twice", "sys", 101.0),
        (3, "openai", "fix the login page now please and thank you", "other", 101.0),
        (4, "openai", "Fix the login page now please and thank you", "sys", 101.0),
        (5, "openai", "", "sys", 101.0),
    ]
    entries = prompt_rows(spark, rows)
    stored = entries.filter("probe_id = 1")
    kinds = lambda now, ttl: {
        r.probe_id: r.hit_type for r in M.cache_lookup(entries, stored, now, ttl).collect()
    }
    assert kinds(110.0, 60.0) == {1: "EXACT", 2: "SEMANTIC", 3: "MISS", 4: "EXACT", 5: "MISS"}
    assert set(kinds(220.0, 60.0).values()) == {"MISS"}
    assert kinds(1e12, 0)[4] == "EXACT"


def test_words_are_unicode(spark):
    df = spark.createDataFrame([("Étion ÉTION naïve_1 x² — 中文",), ("Plain TEXT plain",)], "t string")
    found = [r.w for r in df.select(X.words(F.col("t")).alias("w")).collect()]
    assert found == [["étion", "naïve_1", "x²", "中文"], ["plain", "text"]]


def test_line_ends(spark):
    texts = ["a\r\nb\rc\n", "", "\n", "x\u2028y\x85z\x1cw", "no end", "a\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r.r for r in df.select("i", X.lines(F.col("t")).alias("r")).orderBy("i").collect()]
    assert found == [t.splitlines() for t in texts]


def events_table(spark, folder, count=2000):
    i = F.col("id")
    rows = spark.range(count).select(
        i.alias("event_id"),
        F.timestamp_micros(i * 7_000_000).alias("ts"),
        (i % 17).alias("user_id"),
        F.when(i % 3 == 0, "view").when(i % 3 == 1, "error").otherwise("click").alias("event_type"),
        (i % 500).cast("double").alias("value"),
        F.concat(F.lit('{"a":'), i, F.lit("}")).alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_throughput_rates_build_no_table_on_the_driver(spark, tmp_path):
    """The rows of both sides grow with the log, however small the file."""
    events_table(spark, tmp_path)
    found = QUERIES["throughput_rates"](spark, str(tmp_path))
    assert found.count() == 2000
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_redacted_headers_are_made_once(spark):
    """The masking of a value stands once in the plan, and the last of two names that differ by case wins."""
    rows = spark.createDataFrame([(1, {}), (2, {}), (3, None)], "id int, h map<string,string>")
    rows = rows.withColumn("h", F.when(F.col("id") == 1, F.expr("map('A', 'x', 'Token', 't', 'a', 'y')")).otherwise(F.col("h")))
    found = rows.select("id", X.redact_headers(F.col("h")).alias("h"))
    assert {r.id: r.h for r in found.collect()} == {1: {"token": "[REDACTED]", "a": "y"}, 2: {}, 3: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", [REDACTED_SECRET]") == len(fixed.SECRET_TEXT)


def test_spread_parts_are_bounded(spark, tmp_path, monkeypatch):
    """The parts of a table of short rows grow in number, not in size."""
    monkeypatch.setattr(registry, "ROWS", 100)
    events_table(spark, tmp_path, 5000)
    found = registry.table(spark, str(tmp_path), "events", spread=True)
    assert found.rdd.getNumPartitions() == 50
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 200


def test_unbounded_match_shuffles_rare_words_only(spark, monkeypatch):
    """A set finds its rare words in its row (no window over all its words), for any number of ranked words."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = rng.sample([f"w{k}" for k in range(40)], rng.randint(1, 25)) if i % 3 == 0 or not rows else rows[-1][2].split()[1:] + [f"w{i % 40}"]
        rows.append((i, "p", " ".join(words) or "w0", "sys", float(i)))
    entries = prompt_rows(spark, rows)
    sets = [set(r[2].split()) for r in rows]
    expected = {}
    for i, a in enumerate(sets):
        near = [j for j, b in enumerate(sets) if len(a & b) / len(a | b) >= M.SIMILARITY]
        expected[i] = max(near)
    for ranked in (1 << 16, 3, 0):
        monkeypatch.setattr(M, "RANKED", ranked)
        found = M.similar_matches_unbounded(entries, entries, 100.0, 0)
        assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
        answers = {r.probe_id: (r.similar_response, r.similarity) for r in found.collect()}
        assert answers.keys() == expected.keys()
        for i, j in expected.items():
            assert answers[i][0] == f"r{j}" and abs(answers[i][1] - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) < 1e-9
