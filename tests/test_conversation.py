"""Cleaning of whole requests against the same rules in plain Python, and fixed examples."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from turnscope.functions import variants as V
from turnscope.functions.kernels import estimate_chars, find_key, redact_payload
from turnscope.operators import conversation as C
from turnscope.operators.conversation import CleanOptions

MARK = {"cache_control": {"type": "ephemeral"}}


class Slot:
    """A place in a turn whose text may be replaced."""

    def __init__(self, holder, field, limit, name, wrap=False):
        self.holder, self.field, self.limit, self.name, self.wrap = holder, field, limit, name, wrap

    @property
    def key(self):
        value = self.holder.get(self.field, {} if self.wrap else None)
        text = json.dumps(value, sort_keys=True) if isinstance(value, (dict, list)) else value
        return text if isinstance(text, str) and len(text) > self.limit else None

    def put(self, text):
        self.holder[self.field] = {"content": text} if self.wrap else text


def slots(provider, turn, t):
    if provider == "gemini":
        for part in turn.get("parts", []):
            if isinstance(part.get("functionResponse"), dict):
                yield Slot(part["functionResponse"], "response", 100, "", wrap=True)
            else:
                yield Slot(part, "text", 100, "")
    elif isinstance(turn.get("content"), str):
        tool = provider == "openai" and turn["role"] == "tool"
        yield Slot(turn, "content", 100 if tool else 200, f"turn_{t}")
    elif provider == "anthropic" and isinstance(turn.get("content"), list):
        for block in turn["content"]:
            if block.get("type") == "tool_result":
                yield Slot(block, "content", 100, block.get("tool_use_id", f"tool_result_{t}"))
            elif block.get("type") == "text":
                yield Slot(block, "text", 100, f"turn_{t}")


def stone(provider, turn, first):
    where, name = first
    if provider == "anthropic":
        return f"[Tool output omitted: identical output matches Turn {where} ({name})]"
    what = "Message content" if provider == "openai" and turn["role"] != "tool" else "Tool output"
    return f"[{what} omitted: identical output matches Turn {where}]"


def join_runs(turns):
    out = []
    for turn in turns:
        if not out or out[-1].get("role") != turn.get("role"):
            out.append(copy.deepcopy(turn))
            continue
        a, b = out[-1], turn
        if "parts" in a:
            a["parts"] = a["parts"] + b["parts"]
        elif isinstance(a["content"], list) or isinstance(b["content"], list):
            blocks = [x if isinstance(x, list) else [{"type": "text", "text": x}] for x in (a["content"], b["content"])]
            a["content"] = blocks[0] + blocks[1]
        else:
            a["content"] = a["content"] + "\n\n" + b["content"]
    return out


def expected_clean(payload, provider, max_turns, keep):
    new = copy.deepcopy(payload)
    name = "contents" if provider == "gemini" else "messages"
    turns, seen, omitted = new[name], {}, 0
    for t, turn in enumerate(turns):
        for slot in slots(provider, turn, t):
            key = slot.key
            if key is None:
                continue
            if key in seen and t < len(turns) - 2:
                slot.put(stone(provider, turn, seen[key]))
                omitted += 1
            else:
                seen.setdefault(key, (t, slot.name))

    def is_user(turn):
        content = turn.get("content")
        answers = isinstance(content, list) and any(b.get("type") == "tool_result" for b in content)
        return turn.get("role") == "user" and not (provider == "anthropic" and answers)

    n, gone = len(turns), 0
    if n > max_turns:
        users = [i for i in range(n) if is_user(turns[i])]
        if provider == "openai":
            prefix = 2 if turns[0]["role"] == "system" and turns[1]["role"] == "user" else 1
            target = max(prefix + 1, n - keep)
            order = [i for i in users if i >= target] + [i for i in reversed(users) if prefix < i < target]
        else:
            prefix, target = 1, n - keep
            order = [i for i in reversed(users) if 1 <= i <= target] + [i for i in users if i > max(target, 0)]
        if order and order[0] > prefix:
            gone = order[0] - prefix
            text = f"[Summary of omitted {gone} intermediate conversation turns]"
            note = (
                {"role": "model", "parts": [{"text": text}]}
                if provider == "gemini"
                else {"role": "assistant", "content": text}
            )
            turns = turns[:prefix] + [note] + turns[order[0] :]
        if gone or provider == "anthropic":
            turns = join_runs(turns)
    new[name] = turns
    injected = 0
    if provider == "anthropic":
        budget = 4 - json.dumps(new).count('"cache_control"')
        places = []
        if isinstance(new.get("system"), str):
            places.append((new, "system"))
        elif new.get("system"):
            places.append((new["system"], -1))
        if new.get("tools"):
            places.append((new["tools"], -1))
        if len(turns) >= 2:
            target = turns[-2]
            places.append((target, "content") if isinstance(target["content"], str) else (target["content"], -1))
        for holder, at in places:
            if budget <= 0 or (isinstance(holder, list) and (not holder or "cache_control" in holder[at])):
                continue
            if isinstance(holder, list):
                holder[at] = {**holder[at], **MARK}
            else:
                holder[at] = [{"type": "text", "text": holder[at], **MARK}]
            budget, injected = budget - 1, injected + 1
    return new, omitted, gone, injected


def random_payload(rng, provider):
    texts = [c * k for c in "abé" for k in (5, 60, 130, 240)] + ['q"\\\n' * 40]
    text = lambda: rng.choice(texts)
    n = rng.randint(1, 14)
    if provider == "gemini":

        def part():
            if rng.random() < 0.4:
                return {"functionResponse": {"name": "f", "response": {"out": text(), "code": 1}}}
            return {"text": text()}

        turns = [
            {"role": rng.choice(["user", "user", "model"]), "parts": [part() for _ in range(rng.randint(1, 3))]}
            for _ in range(n)
        ]
        return {"contents": turns}
    if provider == "openai":
        roles = ["system", "user"] if rng.random() < 0.5 else [rng.choice(["user", "assistant"])]
        roles += [rng.choice(["user", "assistant", "tool"]) for _ in range(n)]
        return {"model": "m", "messages": [{"role": r, "content": text()} for r in roles]}

    def block():
        pick = rng.random()
        if pick < 0.4:
            return {"type": "tool_result", "tool_use_id": f"t{rng.randint(0, 9)}", "content": text()}
        if pick < 0.5:
            return {"type": "tool_result", "tool_use_id": "l", "content": [{"type": "text", "text": text()}]}
        out = {"type": "text", "text": text()}
        return {**out, **MARK} if rng.random() < 0.15 else out

    turns = [
        {
            "role": rng.choice(["user", "user", "assistant"]),
            "content": text() if rng.random() < 0.5 else [block() for _ in range(rng.randint(1, 3))],
        }
        for _ in range(n)
    ]
    payload = {"messages": turns}
    if rng.random() < 0.7:
        payload["system"] = rng.choice(["short", [{"type": "text", "text": "s"}], []])
    if rng.random() < 0.5:
        payload["tools"] = [{"name": "x"}, {"name": "y", **(MARK if rng.random() < 0.3 else {})}]
    return payload


def test_clean_payload_matches_plain_rules(spark):
    rng = random.Random(7)
    rows = [(i, p, json.dumps(random_payload(rng, p))) for i in range(240) for p in ("anthropic", "openai", "gemini")]
    df = spark.createDataFrame(rows, "id int, provider string, j string").withColumn("p", V.parse(F.col("j")))
    options = CleanOptions(max_turns=6, keep_recent=3)
    found = C.clean_payload(df.repartition(8), "p", "provider", options).select("id", "provider", "j", "clean.*").collect()
    hits = 0
    for r in found:
        payload = json.loads(r.j)
        new, omitted, gone, injected = expected_clean(payload, r.provider, 6, 3)
        assert json.loads(r.cleaned) == new, (r.provider, r.id)
        assert (r.tool_outputs_omitted, r.turns_summarized, r.cache_control_injected) == (omitted, gone, injected)
        assert r.chars_saved == max(0, len(json.dumps(payload)) - len(json.dumps(new)))
        hits += omitted > 0 and gone > 0
    assert hits > 20


def test_dedup_can_be_switched_off(spark):
    payload = {"messages": [{"role": "user", "content": "x" * 300}] * 5}
    df = spark.createDataFrame([("anthropic", json.dumps(payload))], "provider string, j string")
    df = df.withColumn("p", V.parse(F.col("j")))
    options = CleanOptions(dedup=False, prompt_caching=False)
    row = C.clean_payload(df, "p", "provider", options).select("clean.*").first()
    assert json.loads(row.cleaned) == payload and row.tool_outputs_omitted == 0


def test_requests_without_turns_stay_as_they_are(spark):
    rows = [("openai", '{"messages":"text"}'), ("gemini", '{"prompt":"x"}'), ("anthropic", '{"a":1}')]
    df = spark.createDataFrame(rows, "provider string, j string").withColumn("p", V.parse(F.col("j")))
    for r in C.clean_payload(df, "p", "provider").select("j", "clean.*").collect():
        assert json.loads(r.cleaned) == json.loads(r.j) and r.chars_saved == 0


@pytest.mark.parametrize(
    "value, chars",
    [
        ({"system": "abc", "messages": [{"role": "user", "content": "hello"}]}, 8),
        ({"a": "xx", "b": ["yyy", {"text": "z", "other": "skipped"}], "n": 5}, 6),
        ({"messages": [], "a": "not counted"}, 0),
        ("text", 4),
        ([[[[[[[[[["too deep"]]]]]]]]]], 0),
    ],
)
def test_estimate_chars(spark, value, chars):
    df = spark.createDataFrame([(json.dumps(value),)], "j string")
    assert df.select(estimate_chars(F.col("j")).alias("n")).first().n == chars


def test_chars_of_requests(spark):
    rng = random.Random(3)
    rows = [(json.dumps(random_payload(rng, p)),) for _ in range(60) for p in ("anthropic", "openai", "gemini")]
    df = spark.createDataFrame(rows, "j string").withColumn("p", V.parse(F.col("j")))
    both = C.with_chars(df, "p", "j", "fast").withColumn("slow", estimate_chars(F.col("j")))
    assert both.filter("fast <> slow or fast is null").count() == 0


def test_json_kernels(spark):
    key = "sk-" + "ant-" + "a" * 30
    payload = {"password": {"deep": 1}, "list": [{"API_KEY": "x", "note": f"use {key}!"}], "n": 1, "ok": None}
    df = spark.createDataFrame([(json.dumps(payload),)], "j string")
    clean = json.loads(df.select(redact_payload(F.col("j")).alias("r")).first().r)
    assert clean == {
        "password": "[REDACTED]",
        "list": [{"API_KEY": "[REDACTED]", "note": "use [REDACTED_SECRET]!"}],
        "n": 1,
        "ok": None,
    }
    nested = {"z": {"q": 1, "want": None}, "y": [{"want": [2]}], "want": None}
    df = spark.createDataFrame([(json.dumps(nested),)], "j string")
    assert df.select(find_key(F.col("j"), "want").alias("r")).first().r == "[2]"


@pytest.mark.parametrize(
    "provider, payload, parts",
    [
        (
            "openai",
            {"messages": [{"role": "system", "content": " You are OpenAI. "}, {"role": "user", "content": "Hello world"}]},
            ("Hello world", "You are OpenAI."),
        ),
        (
            "gemini",
            {"contents": [{"parts": [{"text": "Hello Gemini"}]}], "systemInstruction": {"parts": [{"text": "Be helpful."}]}},
            ("Hello Gemini", "Be helpful."),
        ),
        (
            "anthropic",
            {
                "system": [{"type": "text", "text": "a"}, "b"],
                "messages": [
                    {"role": "user", "content": "dropped"},
                    {"role": "user", "content": [{"type": "tool_result", "content": [{"text": "x"}, "y"]}, {"text": "z"}]},
                    {"role": "assistant", "content": "no"},
                    {"role": "user", "content": {"text": "last"}},
                ],
            },
            ("x y z last", "a b"),
        ),
        ("anthropic", {"prompt": "p", "messages": []}, ("p", "")),
        ("openai", {"system": "top", "messages": [{"role": "user", "content": 5}]}, ("5", "top")),
        ("gemini", {"contents": [], "prompt": "p", "system_instruction": "  s "}, ("p", "s")),
    ],
)
def test_cache_key_parts(spark, provider, payload, parts):
    df = spark.createDataFrame([(json.dumps(payload),)], "j string").withColumn("p", V.parse(F.col("j")))
    row = df.select(C.cache_key_parts(F.col("p"), provider).alias("k")).first().k
    assert (row.user_text, row.system_text) == parts


@pytest.mark.parametrize("levels", [0, 3, 4, 7])
@pytest.mark.parametrize("single", [False, True])
def test_nested_tool_results_of_any_depth(spark, levels, single):
    block = {"type": "text", "text": "deep"}
    for i in range(levels):
        block = {"type": "tool_result", "text": f"level {i}", "content": block if single else [block, f"beside {i}"]}
    payload = {"messages": [{"role": "user", "content": [block]}], "system": "s"}
    df = spark.createDataFrame([(json.dumps(payload),)], "j string").select(F.parse_json("j").alias("p"))
    row = df.select(C.cache_key_parts(F.col("p"), F.lit("anthropic")).alias("k")).first().k
    up = [f"level {i}" for i in reversed(range(levels))]
    beside = [] if single else [f"beside {i}" for i in range(levels)]
    assert (row.user_text, row.system_text) == (" ".join([*up, "deep", *beside]), "s")
