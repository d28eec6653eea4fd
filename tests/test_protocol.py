"""Requests converted inside the row, against a plain walk with a queue of open calls."""

import json
import random

from pyspark.sql import functions as F

from turnscope.operators.protocol import chat_messages, pair_tool_replies, tool_parts


def plain(request):
    open_calls, unnamed, out = [], {}, []
    for i, turn in enumerate(request["contents"]):
        if not isinstance(turn, dict):
            continue
        parts = turn.get("parts") or []
        texts = [p["text"] for p in parts if "text" in p]
        calls, answers = [], []
        for p in parts:
            if "functionCall" in p and "text" not in p:
                call = p["functionCall"]
                name = call.get("name", "")
                found = call.get("id")
                if not found:
                    unnamed[name] = unnamed.get(name, 0) + 1
                    found = f"call_{name}" + (f"_{unnamed[name]}" if unnamed[name] > 1 else "")
                open_calls.append((name, found))
                calls.append(found)
        for j, p in enumerate(parts):
            if "functionResponse" in p and "text" not in p and "functionCall" not in p:
                reply = p["functionResponse"]
                name, found = reply.get("name", ""), reply.get("id")
                if not found:
                    at = next((k for k, (n, _) in enumerate(open_calls) if n == name), None)
                    found = f"call_{name}" if at is None else open_calls.pop(at)[1]
                answers.append((i, j, "tool", reply["response"]["content"], found, None))
        role = "assistant" if turn.get("role") in ("model", "assistant") else "user"
        text = "\n".join(texts) if texts else None if calls else ""
        out += answers or [(i, 0, role, text, None, calls or None)]
    return out


def requests():
    rng = random.Random(8)
    call = lambda: {"functionCall": {"name": rng.choice("fg"), **({"id": f"i{rng.random()}"} if rng.random() < 0.3 else {})}}
    reply = lambda: {"functionResponse": {"name": rng.choice("fgh"), "response": {"content": "r"}, **({"id": "x"} if rng.random() < 0.2 else {})}}
    part = lambda: rng.choice([{"text": f"t{rng.random()}"}, call(), call(), reply(), reply()])
    turn = lambda: rng.choice([{"role": rng.choice(["model", "user", "x"]), "parts": [part() for _ in range(rng.randint(0, 6))]}] * 9 + ["no turn", {}])
    return [{"contents": [turn() for _ in range(rng.randint(0, 12))]} for _ in range(60)]


def frame(spark, given):
    rows = [(i, json.dumps(r)) for i, r in enumerate(given)]
    return spark.createDataFrame(rows, "payload_id int, p string").select("payload_id", F.try_parse_json("p").alias("payload"))


def test_conversion(spark):
    given = requests()
    found = {i: [] for i in range(len(given))}
    for r in chat_messages(frame(spark, given)).collect():
        ids = [c["id"] for c in json.loads(r.tool_calls)] if r.tool_calls else None
        found[r.payload_id].append((r.message_idx.turn_idx, r.message_idx.part_idx, r.role, r.content, r.tool_call_id, ids))
    assert found == {i: plain(r) for i, r in enumerate(given)}


def test_nothing_is_shuffled(spark):
    plan = chat_messages(frame(spark, requests()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_odd_requests(spark):
    odd = [{}, {"contents": None}, {"contents": "x"}, {"contents": [7, None]}, [1], {"contents": [{"parts": "x"}]}]
    rows = chat_messages(frame(spark, odd)).collect()
    assert [(r.payload_id, r.role, r.content) for r in rows] == [(5, "user", "")]


def test_tool_parts(spark):
    """Calls and replies as rows get the ids that the plain walk gives them, and calls without an id are numbered."""
    given = requests()
    calls, answers = {}, {}
    for r in pair_tool_replies(tool_parts(frame(spark, given))).collect():
        if r.kind == "call":
            calls.setdefault((r.payload_id, r.turn_idx), []).append((r.part_idx, r.call_id))
        else:
            answers[r.payload_id, r.turn_idx, r.part_idx] = r.call_id
    expected, asked = {}, {}
    for n, request in enumerate(given):
        open_calls, unnamed = [], {}
        for i, turn in enumerate(request["contents"]):
            parts = turn.get("parts", []) if isinstance(turn, dict) else []
            for j, p in enumerate(parts):
                if "functionCall" in p:
                    name, found = p["functionCall"]["name"], p["functionCall"].get("id")
                    if not found:
                        unnamed[name] = unnamed.get(name, 0) + 1
                        found = f"call_{name}" + (f"_{unnamed[name]}" if unnamed[name] > 1 else "")
                    open_calls.append((name, found))
                    asked.setdefault((n, i), []).append((j, found))
            for j, p in enumerate(parts):
                if "functionResponse" in p:
                    name, found = p["functionResponse"]["name"], p["functionResponse"].get("id")
                    if not found:
                        at = next((k for k, (f, _) in enumerate(open_calls) if f == name), None)
                        found = f"call_{name}" if at is None else open_calls.pop(at)[1]
                    expected[n, i, j] = found
    assert answers == expected
    assert {k: sorted(v) for k, v in calls.items()} == asked
