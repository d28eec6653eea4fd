"""Best-fit packing of token pieces into sequences of fixed length."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.support import small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 2048
# Open sequences of a task.
OPEN = 256
# Tasks of the first pass whose open sequences are packed together again.
MERGE = 32

# The tokenizer's split pattern, and characters for which its normalizer is str.lower.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "[\t-\r -~¡-įı-ʯ]*"


class WordTokens:
    """Token ids of a text as little-endian 32-bit integers, equal to ``Tokenizer.encode``.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words, which repeat:
    they are kept, for the words seen last. Texts with characters outside ``PLAIN`` or with the mark of a
    special token go to the tokenizer whole.
    """

    LIMIT = 300_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = re.compile(PLAIN)
        self.split = regex.compile(SPLIT)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.bytes_as = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.LIMIT:
                self.parts.clear()
            spelled = part.encode().decode("latin-1").translate(self.bytes_as)
            found = self.parts[part] = _little([t.id for t in self.model.tokenize(spelled)])
        return found

    def _word(self, word: str) -> bytes:
        parts = self.split.findall(word)
        return self._part(word) if len(parts) == 1 else b"".join(map(self._part, parts))

    def encode(self, text: str) -> bytes:
        if self.plain.fullmatch(text) is None or "<|" in text:
            return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words, known = text.lower().split(), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) >= self.LIMIT:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        return b"".join([known[w] for w in words])


def _little(ids: list[int]) -> bytes:
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


class OpenBins:
    """At most ``limit`` open sequences. Bit f of ``free`` is set while one with f free tokens is open.

    A piece goes to the open sequence with the least free space that holds it. When there are too many open
    ones, the fullest closes.
    """

    def __init__(self, length: int, limit: int) -> None:
        self.length, self.limit = length, limit
        self.free = 0
        self.by_free: dict[int, list[list]] = {}
        self.count = 0

    def _take(self, space: int) -> list:
        bins = self.by_free[space]
        found = bins.pop()
        if not bins:
            del self.by_free[space]
            self.free &= ~(1 << space)
        self.count -= 1
        return found

    def put(self, size: int, piece) -> list | None:
        """Place a piece; a sequence that closes by it comes back."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.length, []
        bin_.append(piece)
        space -= size
        if not space:
            return bin_
        self.by_free.setdefault(space, []).append(bin_)
        self.free |= 1 << space
        self.count += 1
        if self.count > self.limit:
            return self._take((self.free & -self.free).bit_length() - 1)
        return None

    def rest(self) -> Iterator[list]:
        while self.free:
            yield self._take((self.free & -self.free).bit_length() - 1)


_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, task int"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


class _Rows:
    """Output rows of one task; sequences are numbered by task and turn."""

    def __init__(self, high: int) -> None:
        self.task = TaskContext.get().partitionId()
        self.next = high << 62 | self.task << 40
        self.rows: list[tuple] = []

    def close(self, pieces: list, still_open: bool = False) -> None:
        offset = 0
        for doc, piece, start, length, crc in pieces:
            place = (None, None) if still_open else (self.next, offset)
            self.rows.append((doc, piece, start, length, crc, *place, self.task))
            offset += length
        if not still_open:
            self.next += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_TYPES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _pack_texts(tokenizer_path: str, length: int, limit: int, end: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins, out = WordTokens(tokenizer_path), OpenBins(length, limit), _Rows(0)
        tail = _little([end])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = (tokens.encode(text.as_py()) if text.is_valid else b"") + tail
                total = len(ids) // 4
                for k, start in enumerate(range(0, total, length)):
                    size = min(length, total - start)
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])
                    closed = bins.put(size, (doc, k, start, size, crc))
                    if closed:
                        out.close(closed)
            yield out.batch()
        for open_ in bins.rest():
            out.close(open_, still_open=True)
        yield out.batch()

    return pack


def _pack_rest(length: int, limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, out = OpenBins(length, limit), _Rows(1)
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                closed = bins.put(row[3], row)
                if closed:
                    out.close(closed)
            yield out.batch()
        for open_ in bins.rest():
            out.close(open_)
        yield out.batch()

    return pack


def packed(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, open_bins: int = OPEN, end: int = 0, merge: int = MERGE
) -> DataFrame:
    """Pack tokenized documents into sequences of at most ``length`` tokens.

    ``docs(doc_id, text)`` -> one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document
    is its ids and the id ``end``; only longer ones are cut, every ``length`` ids. Null text is empty: one
    piece with ``end``. Rows that repeat a ``doc_id`` (also a null one) are packed each. Other columns are ignored.

    Bounded-space best-fit: a task packs the documents in the order it reads them, with at most ``open_bins`` open
    sequences (``OpenBins``). What is still open when a task ends is packed once more, the pieces of ``merge`` tasks
    together, so that few sequences end half full. A task's memory is its open sequences and the word table.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    first = stored(rows.mapInArrow(_pack_texts(tokenizer_path, length, open_bins, end), _SCHEMA), "packing")
    rest = (
        first.where("sequence_id IS NULL")
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.floor(F.col("task") / merge).alias("group"))
        .repartition("group")
        .sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "ids_crc32")
        .mapInArrow(_pack_rest(length, open_bins), _SCHEMA)
    )
    return first.where("sequence_id IS NOT NULL").unionByName(rest).drop("task")
