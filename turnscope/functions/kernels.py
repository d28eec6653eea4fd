"""Arrow kernels for JSON of arbitrary depth, where expressions with a fixed shape cannot reach."""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from turnscope.fixed import SECRET_FIELD, SECRET_TEXT, SECRET_URL_PARAM, TEXT_KEYS

# Kernels travel to the executors with the plan, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# What ``_load`` gives for text that is no JSON or is nested deeper than the parser goes.
UNREADABLE = object()


def _load(text):
    try:
        return UNREADABLE if text is None else json.loads(text)
    except (ValueError, RecursionError):
        return UNREADABLE


def _dump(node):
    """JSON text that any sink can encode: half of a surrogate pair stays an escape. UNREADABLE if nested too deep to write."""
    try:
        text = json.dumps(node, ensure_ascii=False)
        text.encode()
    except UnicodeEncodeError:
        return json.dumps(node)
    except RecursionError:
        return UNREADABLE
    return text


def _chars(node, depth):
    if depth <= 0:
        return 0
    if isinstance(node, str):
        return len(node)
    if isinstance(node, dict):
        node = [node[k] for k in TEXT_KEYS if k in node] or (
            [] if any(k in node for k in TEXT_KEYS) else list(node.values())
        )
        return sum(_chars(v, depth - 1) for v in node)
    return sum(_chars(v, depth - 1) for v in node) if isinstance(node, list) else 0


def estimate_chars(json_text: Column, max_depth: int = 10) -> Column:
    """Characters of a request or reply: text-bearing keys if there are any, else every value; 0 for unreadable text."""

    @F.pandas_udf(LongType())
    def kernel(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _chars(_load(t), max_depth)).astype("int64")

    return kernel(json_text)


def _below(item):
    """Texts of a content item in order: its own, then those a tool result holds, however deep. No recursion."""
    found, waiting = [], [item]
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            found.append(item)
        if not isinstance(item, dict):
            continue
        if isinstance(item.get("text"), str):
            found.append(item["text"])
        if item.get("type") == "tool_result":
            held = item.get("content")
            waiting += reversed(held) if isinstance(held, list) else [held]
    return found


def user_text(json_text: Column, recent: int) -> Column:
    """Text of the last ``recent`` user turns (0: all) of a chat request, below tool results of any depth.

    NULL for what has no list of ``messages``, and for unreadable text.
    """

    def one(text):
        request = _load(text)
        turns = request.get("messages") if isinstance(request, dict) else None
        if not isinstance(turns, list):
            return None
        said, asked = [], [t for t in turns if isinstance(t, dict) and t.get("role") == "user"]
        for turn in asked[-recent if recent > 0 else None :]:
            content = turn.get("content")
            if isinstance(content, (bool, int, float)):
                said.append(json.dumps(content))
            for item in content if isinstance(content, list) else [content]:
                said += _below(item)
        prompt = request.get("prompt")
        found = " ".join(said) if said else prompt if isinstance(prompt, str) else ""
        # Half of a surrogate pair has no place in text.
        return found.encode("utf-8", "replace").decode()

    @F.pandas_udf(StringType())
    def kernel(requests: pd.Series) -> pd.Series:
        return requests.map(one)

    return kernel(json_text)


# A field of JSON text with a value that is a string or has no parts.
_FIELD = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:\s*)(?:"(?:[^"\\]|\\.)*"|[^\s"{}\[\],]+)')


def redact_payload(json_text: Column, max_depth: int = 50) -> Column:
    """Mask secret-named fields whole and credentials inside every string.

    Text that is no JSON, or is nested deeper than the parser goes, is masked as text: credentials anywhere, and the values of
    secret-named fields that are strings or plain.
    """
    field = re.compile("(?i)" + SECRET_FIELD)
    url = re.compile(SECRET_URL_PARAM)
    shapes = [re.compile(p) for p in SECRET_TEXT]

    def mask_text(text):
        text = url.sub(lambda m: m[1] + "[REDACTED]", text)
        for shape in shapes:
            text = shape.sub("[REDACTED_SECRET]", text)
        return text

    def mask(node, depth):
        if depth <= 0:
            return node
        if isinstance(node, str):
            return mask_text(node)
        if isinstance(node, dict):
            return {k: "[REDACTED]" if field.match(k.lower()) else mask(v, depth - 1) for k, v in node.items()}
        return [mask(v, depth - 1) for v in node] if isinstance(node, list) else node

    def by_pattern(text):
        hide = lambda m: f'"{m[1]}"{m[2]}"[REDACTED]"' if field.match(m[1].lower()) else m[0]
        return mask_text(_FIELD.sub(hide, text))

    def one(text):
        if text is None:
            return None
        node = _load(text)
        made = UNREADABLE if node is UNREADABLE else _dump(mask(node, max_depth))
        return by_pattern(text) if made is UNREADABLE else made

    @F.pandas_udf(StringType())
    def kernel(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return kernel(json_text)


def find_key(json_text: Column, *names: str, max_depth: int = 10) -> Column:
    """The first non-null value (as JSON text) of any named key, a node before its children; NULL in unreadable text."""

    def search(node, depth):
        if depth <= 0:
            return None
        if isinstance(node, dict):
            hits = (node[n] for n in names if node.get(n) is not None)
            here = next(hits, None)
            if here is not None:
                return here
            node = list(node.values())
        for child in node if isinstance(node, list) else ():
            if isinstance(child, (dict, list)):
                found = search(child, depth - 1)
                if found is not None:
                    return found
        return None

    def one(text):
        found = search(_load(text), max_depth)
        text = None if found is None else _dump(found)
        return None if text is UNREADABLE else text

    @F.pandas_udf(StringType())
    def kernel(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return kernel(json_text)
