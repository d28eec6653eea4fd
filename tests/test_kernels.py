"""JSON kernels and key parts on rows that no parser likes: no row may end a job."""

import json

import pytest
from pyspark.sql import functions as F

from turnscope.functions.kernels import estimate_chars, find_key, redact_payload, user_text
from turnscope.operators import conversation as C

DEEP = 20_000
SECRET = "sk-" + "ant-" + "a" * 30
RESULT = '{"type":"tool_result","content":"r"}'
FOUR = ",".join([RESULT] * 4)

BAD = [
    None,
    "",
    "null",
    "5",
    '"text"',
    "no json",
    "[" * DEEP + "]" * DEEP,
    '{"a":' * DEEP + "1" + "}" * DEEP,
    '{"text":"\\ud800 x"}',
    '{"messages":null}',
    '{"messages":"text"}',
    '{"messages":{"role":"user"}}',
    '{"messages":[null,5,"x",{"role":"user"}]}',
    f'{{"prompt":"x","items":[{FOUR}]}}',
    f'{{"prompt":"x","messages":null,"items":[{FOUR}]}}',
    f'{{"prompt":5,"messages":7,"items":[{FOUR}]}}',
    "{" + '"n":' + "9" * 5000 + "}",
]


@pytest.fixture(scope="module")
def bad(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(BAD)], "id int, j string").repartition(3)


def test_no_row_ends_a_job(bad):
    kernels = {
        "chars": estimate_chars(F.col("j")),
        "clean": redact_payload(F.col("j")),
        "found": find_key(F.col("j"), "text", "role"),
        "said": user_text(F.col("j"), 2),
    }
    for name, kernel in kernels.items():
        assert bad.select("id", kernel.alias(name)).count() == len(BAD)
        assert len(bad.select(kernel.alias(name)).collect()) == len(BAD)


def test_key_parts_of_bad_requests(bad):
    p = bad.withColumn("p", F.try_parse_json("j"))
    for provider in ("anthropic", "openai", "gemini"):
        rows = {r.id: r.k for r in p.select("id", C.cache_key_parts(F.col("p"), provider).alias("k")).collect()}
        assert len(rows) == len(BAD)
        # With three tool results and with four the answer is the same.
        assert [rows[i].user_text for i in (13, 14, 15)] == ["x", "x", ""]
        assert rows[10].user_text == "" and rows[9].user_text == ""


def test_chars_and_keys_of_bad_rows(bad):
    rows = {r.id: r for r in bad.select("id", estimate_chars(F.col("j")).alias("n"), find_key(F.col("j"), "text", "role").alias("f")).collect()}
    assert [rows[i].n for i in (0, 1, 2, 3, 4, 5, 6, 8)] == [0, 0, 0, 0, 4, 0, 0, 3]
    assert rows[8].f == '"\\ud800 x"' and rows[11].f == '"user"' and rows[6].f is None


def test_redaction_of_unreadable_text(spark):
    deep = '{"a":' * DEEP + f'{{"password":"p\\"w","n":"{SECRET}","token":5,"note":"kept"}}' + "}" * DEEP
    rows = [(0, deep), (1, f"not json {SECRET}"), (2, '{"a":"\\ud800 x","password":"\\udc00"}'), (3, "é"), (4, '{"b":"é"}'), (5, None)]
    df = spark.createDataFrame(rows, "id int, j string")
    found = {r.id: r.c for r in df.select("id", redact_payload(F.col("j")).alias("c")).collect()}
    assert found[0].endswith('{"password":"[REDACTED]","n":"[REDACTED_SECRET]","token":"[REDACTED]","note":"kept"}' + "}" * DEEP)
    assert found[1] == "not json [REDACTED_SECRET]"
    assert json.loads(found[2]) == {"a": "\ud800 x", "password": "[REDACTED]"} and found[2].encode()
    assert (found[3], found[4], found[5]) == ("é", '{"b": "é"}', None)


def test_texts_below_many_results(spark):
    block = {"type": "text", "text": "end"}
    for i in range(900):
        block = {"type": "tool_result", "text": f"t{i}", "content": [block, f"b{i}"]}
    request = {"messages": [{"role": "user", "content": [block, 5, ["x"], None]}, {"role": "user", "content": True}]}
    df = spark.createDataFrame([(json.dumps(request),)], "j string")
    expected = [*[f"t{i}" for i in reversed(range(900))], "end", *[f"b{i}" for i in range(900)], "true"]
    assert df.select(user_text(F.col("j"), 0).alias("t")).first().t == " ".join(expected)
