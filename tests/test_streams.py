"""Streams whose rows come in any order, in one micro-batch and in several."""

import os
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from turnscope.session import work_dir
from turnscope.streaming import live
from turnscope.streaming.stateful import reassemble_tool_calls

SCHEMA = "flow_id bigint, event_no int, call_index int, name string, fragment string, finished boolean"


def calls_of(spark, batches):
    """The calls found when each list of rows is a micro-batch."""
    folder = work_dir(spark, "fragments")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    calls = reassemble_tool_calls(stream)
    query = (
        calls.writeStream.format("parquet")
        .option("path", folder + "/out")
        .option("checkpointLocation", folder + "/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = spark.read.schema(calls.schema).parquet(folder + "/out").collect()
    return sorted((r.flow_id, r.event_no, r.call_index, r.name, r.arguments) for r in found)


def test_shuffled_fragments_of_one_micro_batch(spark):
    n = 25_000
    text = '{"v":"' + "".join(chr(97 + k % 26) for k in range(n - 2)) + '"}'
    pieces = [text[:6], *text[6:-2], text[-2:]]
    rows = [(1, k, 0, "write" if k == 0 else "", piece, False) for k, piece in enumerate(pieces)]
    rows += [(1, n, -1, "", "", True), (2, 0, 0, "open", "never finished", False)]
    random.Random(5).shuffle(rows)
    assert calls_of(spark, [rows]) == [(1, n, 0, "write", text)]


def test_calls_over_several_micro_batches(spark):
    first = [(1, 1, 0, "a", '{"x":', False), (1, 2, 1, "b", "[bad", False)]
    second = [
        (1, 3, 0, "", "1}", False),
        (1, 4, -1, None, None, True),
        (1, 6, -1, "", "", True),
        (1, 5, 0, "c", "", False),
        (1, 7, 0, "d", "{}", False),
        (3, 1, -1, "", "", True),
    ]
    expected = [(1, 4, 0, "a", '{"x":1}'), (1, 4, 1, "b", '{"raw":"[bad"}'), (1, 6, 0, "c", "{}")]
    assert calls_of(spark, [first, second]) == expected
    assert calls_of(spark, [first + second + first[:1]]) == expected


def stream_of(spark, batches, schema, time):
    """A stream with one micro-batch for each list of rows; ``time`` is in seconds and becomes a timestamp."""
    folder = work_dir(spark, "in")
    for rows in batches:
        frame = spark.createDataFrame(rows, schema).withColumn(time, F.timestamp_seconds(time))
        frame.coalesce(1).write.mode("append").parquet(folder)
    found = spark.read.parquet(folder).schema
    return spark.readStream.schema(found).option("maxFilesPerTrigger", 1).parquet(folder)


def run_append(spark, rows):
    folder = work_dir(spark, "out")
    query = live.append_to(rows, folder + "/out", folder + "/checkpoint")
    query.awaitTermination()
    return folder + "/out", spark.read.schema(rows.schema).parquet(folder + "/out"), query


HOUR = 3600


def test_a_flow_over_three_hours_is_one_row(spark):
    steps = [(1, k * 600, 10) for k in range(19)]
    late = [(1, 600, 1), (3, 0, 5), (4, 3 * HOUR, 6)]
    batches = [steps[:6] + [(2, 50, 7)], steps[6:12][::-1], steps[12:] + late, [(9, 30 * HOUR, 1)], [(1, 30 * HOUR + 1, 2), (9, 60 * HOUR, 1)]]
    flows = live.flows(stream_of(spark, batches, "flow_id bigint, ts bigint, bytes bigint", "ts"), "1 hour", "6 hours")
    path, found, query = run_append(spark, flows)
    second = lambda n: F.unix_timestamp(n).alias(n)
    rows = sorted(map(tuple, found.select("flow_id", second("first_chunk"), second("last_chunk"), "bytes", "chunks").collect()))
    assert rows == [
        (1, 0, 3 * HOUR, 191, 20), (1, 30 * HOUR + 1, 30 * HOUR + 1, 2, 1), (2, 50, 50, 7, 1), (3, 0, 0, 5, 1),
        (4, 3 * HOUR, 3 * HOUR, 6, 1), (9, 30 * HOUR, 30 * HOUR, 1, 1),
    ]
    assert not [f for f in os.listdir(path) if f.startswith("version=")]
    # Only the flow that is still open is left in the state.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_entries_leave_the_state_when_they_expire(spark):
    put = lambda key, at, n: (key, f"p{n}", f"q{n}", f"r{n}", at)
    batches = [
        [put("a", 0, 1), put("b", 10, 2), put("c", 20, 3)],
        [put("a", 90, 5), put("a", 60, 4)],
        [put("b", 300, 6)],
        [put("b", 399, 8), put("b", 350, 7)],
        [put("d", 1000, 9)],
        [put("d", 1050, 10), put("e", 1060, 11)],
    ]
    schema = "key string, provider string, prompt_normalized string, response_json string, put_at bigint"
    entries = live.store_entries(stream_of(spark, batches, schema, "put_at"), "100 seconds", "10 seconds")
    _, found, query = run_append(spark, entries)
    columns = ["key", "provider", "prompt_normalized", "response_json", F.unix_timestamp("created_at"), "puts", F.unix_timestamp("expires_at")]
    assert sorted(map(tuple, found.select(*columns).collect())) == [
        ("a", "p1", "q1", "r5", 90, 3, 190),
        ("b", "p2", "q2", "r2", 10, 1, 110),
        ("b", "p6", "q6", "r8", 399, 3, 499),
        ("c", "p3", "q3", "r3", 20, 1, 120),
    ]
    # After eleven puts the state holds the two live entries and no dead one.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2


def test_unanswered_requests_become_failures(spark):
    asked = [[(1, 1, "openai", False), (2, 5, "openai", False), (3, 6, "unknown", False), (4, 7, "openai", True)], [(5, 9 * HOUR, "gemini", False)]]
    answered = [[(1, 9, 200), (2, 2 * HOUR, 200), (7, 1, 200)], [(5, 9 * HOUR + 2, 500)]]
    requests = stream_of(spark, asked, "flow_id bigint, asked_at bigint, provider string, cached boolean", "asked_at")
    replies = stream_of(spark, answered, "flow_id bigint, answered_at bigint, status int", "answered_at")
    _, done, _ = run_append(spark, live.correlate(requests, replies, unanswered=True))
    rows = sorted((r.flow_id, r.status, r.answered_at is None) for r in done.collect())
    # The reply to the second request came too late, the others are unknown, cached or never asked for.
    assert rows == [(1, 200, False), (2, None, True), (5, 500, False)]
    readings = live.exchange_readings(done.withColumn("input_tokens", F.lit(11)), "input_tokens")
    kinds = {r.ordinal: (r.kind, r.input_tokens, r.ttft_s) for r in readings.collect()}
    assert kinds == {1: ("response", 11, None), 2: ("failure", 0, None), 5: ("failure", 0, None)}


def test_only_the_newest_snapshots_stay(spark):
    batches = [[(k, k, 200)] for k in range(5)]
    rows = stream_of(spark, batches, "flow_id bigint, at bigint, status int", "at")
    path = work_dir(spark, "kpi")
    live.stream_kpi(live.exchange_readings(rows), path, path + "-checkpoint").awaitTermination()
    assert sorted(f for f in os.listdir(path) if "=" in f) == ["version=3", "version=4"]
    assert live.latest_snapshot(spark, path).first().total_requests == 5


def test_calls_that_end_in_their_batch_stay_out_of_the_state(spark, monkeypatch):
    """Only fragments that wait for a later batch are written to the state store; each access is a message to it."""
    from turnscope.streaming.stateful import ToolCalls

    class Pieces(dict):
        log = []

        def exists(self):
            return bool(self)

        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, place, piece):
            self.log.append(place)
            self[place] = piece

        def removeKey(self, place):
            del self[place]

    row = lambda *values: Row(**dict(zip(("flow_id", "event_no", "call_index", "name", "fragment", "finished"), values)))
    calls = ToolCalls(None)
    calls._pieces = pieces = Pieces()
    first = [row(1, 1, 0, "a", '{"x":', False), row(1, 2, 0, "", "1}", False), row(1, 3, -1, "", "", True), row(1, 4, 1, "b", "[", False)]
    found = [tuple(r) for r in calls.handleInputRows((1,), iter(first), None)]
    assert found == [(1, 3, 0, "a", '{"x":1}')] and pieces.log == [(4, 1)]
    found = [tuple(r) for r in calls.handleInputRows((1,), iter([row(1, 5, 1, None, "]", False), row(1, 6, -1, None, None, True)]), None)]
    assert found == [(1, 6, 1, "b", "[]")] and pieces.log == [(4, 1)] and not pieces
