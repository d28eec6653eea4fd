"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from turnscope.operators.gates import test_time_totals as time_totals
from turnscope.operators.retrieval import symbol_map
from turnscope.sources import files as S
from turnscope.sources import traces as T


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    if mode == "wb":
        path.write_bytes(text)
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def ids(df):
    rows = df.orderBy("ordinal").select(F.try_variant_get("tx", "$.id", "int").alias("id")).collect()
    return [r.id for r in rows]


def test_lines_keep_their_order(spark, tmp_path):
    good = [json.dumps({"id": i}) for i in range(500)]
    path = write(tmp_path / "t.jsonl", "﻿" + "\n".join(["", *good[:250], "  ", "{bad", "[1]", "3", *good[250:]]))
    assert ids(T.read_trace(spark, path)) == list(range(500))


def test_arrays(spark, tmp_path):
    path = write(tmp_path / "t.json", '﻿ \n[{"id": 1}, 5, {"id": 2}]')
    assert ids(T.read_trace(spark, path)) == [1, 2]
    broken = write(tmp_path / "b.json", '[{"id": 1}, ')
    with pytest.raises(Exception):
        T.read_trace(spark, broken).collect()


def test_each_file_is_tested(spark, tmp_path):
    lines = write(tmp_path / "a b.jsonl", "\n".join(["", '{"id": 1}', "[7]", '{"id": 2, "id": 3}']))
    array = write(tmp_path / "c.jsonl", '\n [{"id": 4},\n {"id": 5}]')
    more = write(tmp_path / "d.jsonl", '{"id": 6}\n')
    found = T.read_trace(spark, lines, array, more)
    assert found.schema["ordinal"].dataType.simpleString() == "bigint"
    assert ids(found) == [1, 3, 4, 5, 6]
    assert ids(T.read_trace(spark, array, arrays=True)) == [4, 5]
    assert ids(T.read_trace(spark, lines, more, arrays=False)) == [1, 3, 6]
    write(tmp_path / "e.jsonl", '[{"id": 8}, ')
    write(tmp_path / "turn_9.json", '{\n "id": 9}')
    assert ids(T.read_trace_dir(spark, str(tmp_path))) == [1, 3, 4, 5, 6, 9]


def test_order_over_many_splits(spark, tmp_path):
    text = "\n".join(json.dumps({"id": i, "pad": "x" * (i % 50)}) for i in range(5000))
    first, second = write(tmp_path / "a.jsonl", text), write(tmp_path / "b.jsonl", '{"id": 5000}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = T.read_trace(spark, second, first)
        assert found.rdd.getNumPartitions() > 8
        assert ids(found) == list(range(5001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_input_is_an_error(spark, tmp_path):
    path = write(tmp_path / "e.jsonl", "\n{bad\n")
    with pytest.raises(ValueError):
        T.read_trace(spark, path)
    assert T.read_trace(spark, path, permissive=True).count() == 0


def test_folders(spark, tmp_path):
    write(tmp_path / "a" / "x.jsonl", '{"id": 1}\n{"id": 2}\n')
    write(tmp_path / "a" / "sub" / "turn_3.json", '{\n "id": 3\n}')
    write(tmp_path / "a" / "other.json", '{"id": 4}')
    assert sorted(ids(T.read_trace_dir(spark, str(tmp_path / "a")))) == [1, 2, 3]
    write(tmp_path / "a" / "transactions.jsonl", '{"id": 9}\n')
    assert ids(T.read_trace_dir(spark, str(tmp_path / "a"))) == [9]
    assert ids(T.read_wire_log(spark, str(tmp_path / "none"), str(tmp_path / "a"))) == [9]
    assert T.read_wire_log(spark, str(tmp_path / "none")) is None


def test_text_files(spark, tmp_path):
    write(tmp_path / "src" / "m.py", "class A:\n    async def b(self): pass\n")
    write(tmp_path / "src" / "bad.py", "def broken(:\n")
    write(tmp_path / "build" / "x.py", "def no(): pass\n")
    write(tmp_path / "notes.md", b"caf\xe9 ok\n", "wb")
    write(tmp_path / "data.bin", "skip")
    found = S.scan_text_files(spark, str(tmp_path))
    rows = {r.path: r.content for r in found.collect()}
    assert set(rows) == {"src/m.py", "src/bad.py", "notes.md"}
    assert rows["notes.md"] == "caf ok\n"
    symbols = {(r.symbol, r.file, r.line, r.type) for r in symbol_map(found).collect()}
    assert symbols == {("A", "src/m.py", 1, "class"), ("b", "src/m.py", 2, "function")}


def test_junit(spark, tmp_path):
    xml = '<testsuites><testsuite><testcase classname="c" name="n" time="1.5"/><testcase classname="c" name="n" time="2"/>'
    xml += '<testcase name="solo"/></testsuite></testsuites>'
    cases = S.scan_junit(spark, write(tmp_path / "r.xml", xml))
    assert {r.test: r.seconds for r in time_totals(cases).collect()} == {"c::n": 3.5, "::solo": 0.0}


def test_junit_column_any_depth(spark):
    case = '<testcase classname="c" name="a &gt; b > d" time=\'1.5\'><failure message="x">no &lt;</failure></testcase>'
    odd = '<!-- <testcase name="no"/> --><system-out><![CDATA[<testcase name="no"/>]]></system-out><testcases name="no"/>'
    reports = [
        f"<testsuites><testsuite>{case}{odd}<testsuite><testcase\nname='deep'/></testsuite></testsuite></testsuites>",
        f'<?xml version="1.0"?><testsuite>{case}</testsuite>',
        "<testsuites/>",
        None,
        f"<testsuite>{case}",
        f"<testsuites><testsuite>{case}</testsuites>",
    ]
    found = S.parse_junit(spark.createDataFrame(list(enumerate(reports)), "i int, xml string"), "xml", "i")
    first = ("c", "a > b > d", "1.5")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(0, *first), (0, None, "deep", None), (1, *first)], key=str)


def test_timing_records(spark, tmp_path):
    good = {"workflow": "w", "job": "j", "os": "linux", "duration_s": 5.0, "tests": {"a": 1.0}, "schema": 1, "x": 0}
    variants = [good, {**good, "schema": 2}, {**good, "duration_s": 0}, {**good, "tests": {"a": None}}, {**good, "tests": {}}]
    for i, record in enumerate(variants):
        write(tmp_path / "t" / f"{i}.json", json.dumps(record, indent=1))
    assert S.scan_timing_records(spark, str(tmp_path / "t")).count() == 2


def test_ledger(spark, tmp_path):
    path = write(tmp_path / "plans.jsonl", '{"plan": "a", "ev": 1.5}\n{"plan": "b", "ev": 2.0, "note": "n"}\n')
    assert S.scan_ledger(spark, path).agg(F.sum("ev").alias("s")).first().s == 3.5


def test_log_round_trip(spark, tmp_path):
    records = spark.createDataFrame([("1/a", "f 1", None), ("2", "f2", 3)], "turn_id string, flow_id string, n int")
    named = T.with_file_names(records)
    assert [r.file_name for r in named.orderBy("turn_id").collect()] == ["turn_1_a_f_1.json", "turn_2_f2.json"]
    path = str(tmp_path / "log" / "transactions.jsonl")
    T.write_wire_log(records, path)
    T.write_wire_log(records, path)
    assert T.read_wire_log(spark, str(tmp_path / "log")).count() == 4
