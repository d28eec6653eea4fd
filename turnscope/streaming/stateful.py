"""Stateful stream operators: entries that expire, and tool calls that arrive in pieces."""

from __future__ import annotations

import json
import sys
from bisect import bisect_left

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CALL_SCHEMA = "flow_id bigint, event_no int, call_index int, name string, arguments string"


class ToolCalls(StatefulProcessor):
    """Joins the fragments of tool calls per flow and emits them when the flow finishes its calls.

    Rows: ``flow_id, event_no, call_index, name, fragment, finished``. State is one entry per fragment that waits for its finish, so the
    order of the batches of a micro-batch does not matter, and a fragment that comes twice before its finish counts once. A finish
    takes the fragments up to its own event. With ``idle_ms``, fragments that never see a finish leave after it.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self._idle_ms = idle_ms

    def init(self, handle) -> None:
        self._pieces = handle.getMapState(
            "pieces", "event_no int, call_index int", "name string, fragment string", self._idle_ms
        )

    def handleInputRows(self, key, rows, timerValues):
        fresh, ends = {}, set()
        for row in rows:
            if row.call_index is not None and row.call_index >= 0:
                fresh[row.event_no, row.call_index] = (row.name or "", row.fragment or "")
            if row.finished:
                ends.add(row.event_no)
        for end, index, name, arguments in self._whole(fresh, sorted(ends)):
            yield Row(flow_id=key[0], event_no=end, call_index=index, name=name, arguments=arguments)

    def _whole(self, fresh: dict, ends: list[int]) -> list[tuple[int, int, str, str]]:
        """The calls that end. Fragments that end with the batch they came in never enter the state, each access to which is
        a message to the state store."""
        known = dict(self._pieces.iterator()) if ends and self._pieces.exists() else {}
        calls: dict[tuple[int, int], tuple[list[str], list[str]]] = {}
        for place, piece in sorted((known | fresh).items()):
            k = bisect_left(ends, place[0])
            if k == len(ends):
                if place in fresh:
                    self._pieces.updateValue(place, piece)
                continue
            names, texts = calls.setdefault((ends[k], place[1]), ([], []))
            names.append(piece[0])
            texts.append(piece[1])
            if place in known:
                self._pieces.removeKey(place)
        found = []
        for (end, index), (names, texts) in sorted(calls.items()):
            name, text = next((n for n in reversed(names) if n), ""), "".join(texts)
            try:
                arguments = json.loads(text) if text else {}
            except ValueError:
                arguments = {"raw": text}
            if name:
                found.append((end, index, name, json.dumps(arguments, separators=(",", ":"))))
        return found

    def close(self) -> None:
        pass


def reassemble_tool_calls(fragments: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The complete tool calls of a fragment stream; needs the RocksDB state store.

    Fragments that wait longer than ``idle_ms`` for the end of their flow are dropped. A stream that runs on should
    set it; Spark then starts batches without new rows too, so a stream read to its end (``availableNow``) must not.
    """
    return fragments.groupBy("flow_id").transformWithState(
        statefulProcessor=ToolCalls(idle_ms),
        outputStructType=CALL_SCHEMA,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
