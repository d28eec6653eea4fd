"""Periodic runs of words, found by string synchronising sets."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.support import mixed, small_batches, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A run holds its period so many times at least; the argument of ``_scale`` rests on this value.
TIMES = 4
# Words of the shortest run that is reported.
LEAST = 6
# Periods that are compared directly; greater ones are proposed by synchronising positions.
SMALL = 3
# Words of several documents that are searched at once; a longer document is searched alone.
TOGETHER = 1 << 18

_K = np.uint64(0x9E3779B97F4A7C15)
_HIDDEN = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Numbers(dict):
    """Word -> its number, exact."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class _Found:
    """Runs as places of the joined documents; of equal stretches the smaller period counts."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.start = self.end = self.period = np.empty(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        long = end - start >= TIMES * period
        start, end, period = start[long], end[long], period[long]
        key = start * (self.size + 1) + end
        _, first = np.unique(key, return_index=True)
        first = first[~np.isin(key[first], self.start * (self.size + 1) + self.end)]
        self.start = np.concatenate([self.start, start[first]])
        self.end = np.concatenate([self.end, end[first]])
        self.period = np.concatenate([self.period, period[first]])

    def repeats(self, window: int, places: int) -> np.ndarray:
        """Which windows have a period of at most a quarter of their length: those inside a run of such a period."""
        hit = (TIMES * self.period <= window) & (self.end - self.start >= window) & (self.start < places)
        edge = np.zeros(places + 1, np.int64)
        np.add.at(edge, self.start[hit], 1)
        np.add.at(edge, np.minimum(self.end[hit] - window + 1, places), -1)
        return np.cumsum(edge[:-1]) > 0


def _small(text: np.ndarray, q: int, found: _Found) -> None:
    """All runs of period ``q`` by comparing the text with itself."""
    if len(text) <= q:
        return
    edge = np.diff(np.concatenate([[False], text[:-q] == text[q:], [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    found.add(start, stop + q, np.full(len(start), q))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling the covered width."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class _Common:
    """How far two places of the text agree, by binary search over hashes of prefixes."""

    def __init__(self, marks: np.ndarray) -> None:
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(marks), _K)]), dtype=np.uint64)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(marks * self.power[:-1], dtype=np.uint64)])

    def _search(self, agree, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = agree(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def stretch(self, a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch around ``a`` that keeps period ``d``."""
        total, shift = self.total, self.power[d]
        right = self._search(
            lambda n: (total[a + n] - total[a]) * shift == total[a + d + n] - total[a + d], len(total) - 1 - a - d
        )
        left = self._search(lambda n: (total[a] - total[a - n]) * shift == total[a + d] - total[a + d - n], a.copy())
        return a - left, a + d + right


def _checked(text: np.ndarray, a: int, d: int, start: int, end: int) -> tuple[int, int]:
    """The same stretch, word by word: hashes may find it too long, never too short."""
    if np.array_equal(text[start : end - d], text[start + d : end]):
        return start, end
    unlike = np.flatnonzero(text[start : end - d] != text[start + d : end]) + start
    after = unlike[unlike >= a]
    before = unlike[unlike < a]
    return (int(before[-1]) + 1 if len(before) else start), (int(after[0]) + d if len(after) else end)


def _scale(text: np.ndarray, common, name: np.ndarray, context: np.ndarray, tau: int, found: _Found) -> None:
    """All runs of period ``tau`` to ``2 * tau - 1``.

    A place is synchronising if, of the windows of ``tau`` words that begin in it and up to ``tau`` words later, the
    least hash stands first or last; windows with a period of at most ``tau / 4`` do not compete, since inside them places
    would crowd. Whether a place is one depends on the next ``2 * tau`` words only, its context. In a run
    of period q and at least 4 q words, one of the first ``tau`` places is one, and so is the place q words later, with the same
    context; no place between them has it, else the run had a smaller period. So neighbours of equal
    context propose every period of this scale. Runs that hide windows are known from smaller scales.
    """
    value = np.where(found.repeats(tau, len(name)), _HIDDEN, name)
    least = _smallest(value, tau + 1)
    n = min(len(least), len(context))
    least = least[:n]
    places = np.flatnonzero(((value[:n] == least) | (value[tau : tau + n] == least)) & (least != _HIDDEN))
    shown = context[places]
    order = np.argsort(shown, kind="stable")
    places, shown = places[order], shown[order]
    apart = places[1:] - places[:-1]
    hit = (shown[1:] == shown[:-1]) & (apart >= tau) & (apart < 2 * tau)
    if not hit.any():
        return
    a, d = places[:-1][hit], apart[hit]
    start, end = common().stretch(a, d)
    _, first = np.unique(np.stack([start, end, d]), axis=1, return_index=True)
    rows = [(*_checked(text, a[i], d[i], start[i], end[i]), d[i]) for i in first[end[first] - start[first] >= TIMES * d[first]]]
    if rows:
        rows.sort(key=lambda r: r[2])
        found.add(*[np.array(c, np.int64) for c in zip(*rows)])


def runs_of(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Of each document, given as numbers of words: (start, length, period) of all runs, in this order.

    All documents are one text with a mark of its own behind each, so that no run crosses a border; the longest
    come first, so that a scale works on the documents that can hold a run of it, a prefix.
    """
    size = np.array([len(x) for x in docs], np.int64)
    order = np.argsort(-size, kind="stable")
    text = np.concatenate([np.empty(0, np.int64), *[x for k in order for x in (docs[k], [-1 - int(k)])]]).astype(np.int64)
    offset = np.zeros(len(docs) + 1, np.int64)
    offset[1:] = np.cumsum(size[order] + 1)
    found = _Found(len(text))
    for q in range(1, SMALL + 1):
        _small(text, q, found)
    marks = mixed(text.view(np.uint64) * _K + np.uint64(1))
    kept: list[_Common] = []

    def common() -> _Common:
        if not kept:
            kept.append(_Common(marks))
        return kept[0]

    name, tau = marks, 1
    while True:
        able = int(offset[np.searchsorted(-size[order], -TIMES * tau, side="right")])
        name = name[: max(able - tau + 1, 0)]
        if len(name) <= tau:
            break
        context = mixed(name[:-tau] * _K + name[tau:])
        if tau > SMALL:
            _scale(text, common, name, context, tau, found)
        name, tau = context, 2 * tau
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    long = found.end - found.start >= LEAST
    start, end, period = found.start[long], found.end[long], found.period[long]
    whose = np.searchsorted(offset, start, side="right") - 1
    for k, s, n, q in sorted(zip(whose.tolist(), (start - offset[whose]).tolist(), (end - start).tolist(), period.tolist())):
        out[order[k]].append((s, n, q))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that holds its period most often, compared in whole numbers; the first of equals."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _run(run: tuple[int, int, int] | None) -> dict | None:
    return None if run is None else dict(zip(("start", "length", "period"), run))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(ids: pa.Array, held: list[list[bytes]]) -> pa.RecordBatch:
        numbers = _Numbers()
        runs = runs_of([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in held])
        left = [b" ".join(collapsed(w, r) if r else w).decode() for w, r in zip(held, runs)]
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(w) for w in held], pa.int64()),
                pa.array([[_run(x) for x in r] for r in runs], pa.list_(_RUN_ARROW)),
                pa.array([_run(strongest(r)) for r in runs], _RUN_ARROW),
                pa.array(left, pa.string()),
            ],
            names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )

    for batch in batches:
        held, first, size = [], 0, 0
        for i, text in enumerate(texts_of(batch.column(1))):
            words = (text or b"").split()
            if held and size + len(words) > TOGETHER:
                yield rows(batch.column(0).slice(first, len(held)), held)
                held, first, size = [], i, 0
            held.append(words)
            size += len(words)
        if held:
            yield rows(batch.column(0).slice(first, len(held)), held)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of words that repeat a period four times or more, and each text with one period of every run.

    ``docs(doc_id, text)`` -> ``(doc_id, n_words, runs, strongest, collapsed)``, one row per input row. A run is a stretch
    of consecutive words with smallest period q and at least ``max(6, 4 * q)`` words that no neighbouring word extends;
    ``runs`` has ``start`` (word number from 0), ``length`` and ``period`` of each, by start, then period. ``strongest`` is the run of
    greatest length / period (ties: smallest start, then period), null without a run. ``collapsed`` are the words that no run
    holds behind its first period, joined by one space. Words are runs of anything but ASCII white space.

    A document is searched where it is read: nothing is shuffled, and work and memory of a task follow its own texts.
    Periods up to three words come from comparing the text with itself. For each power of two ``tau`` from four on, string
    synchronising sets propose the periods from ``tau`` to ``2 * tau - 1`` (see ``_scale``); the stretch of a proposal is
    measured by hashes and checked word by word.

    Null or empty text has no words, no run and an empty ``collapsed``. Rows are judged alone: a repeated row shows the
    same result again, a null ``doc_id`` stays null. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _search, f"doc_id bigint, n_words bigint, runs array<{_RUN}>, strongest {_RUN}, collapsed string"
    )
