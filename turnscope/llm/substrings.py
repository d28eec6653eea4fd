"""Substring dedup by level-wise doubling."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.support import WordHashes, Windows, small_batches, stored, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 50


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _running_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling the covered width."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _half(window: int) -> int:
    return (window + 1) // 2


def _keys(hashes: np.ndarray, windows: Windows, window: int) -> np.ndarray:
    """Per window of full length: the smallest hash of the half-length windows inside it.

    It depends on nothing but the words of the window, so equal windows have equal keys: a window can repeat
    only if its half-length key does.
    """
    half = _half(window)
    return _running_min(windows(hashes, half), window - half + 1)


def _scan(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, windows = WordHashes(), Windows()
        for batch in batches:
            n, seq, sha, keys = [], [], [], []
            for text in texts_of(batch.column(1)):
                words = (text or b"").split()
                joined = b" ".join(words)
                n.append(len(words))
                seq.append(hashlib.blake2b(joined, digest_size=16).digest())
                sha.append(hashlib.sha256(joined).hexdigest())
                keys.append(
                    _signed(np.unique(_keys(words_of.of(words), windows, window))) if len(words) >= window else None
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(seq, pa.binary()), pa.array(sha, pa.string()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "seq", "sha", "keys"],
            )

    return scan


def _extend(window: int):
    """Of documents with repeated half-length keys: the full windows that such a key may extend to."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, windows, pack = WordHashes(), Windows(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, seqs, blobs, starts, hashes = [], [], [], [], []
            for doc, text, seq, found in zip(
                batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3)
            ):
                words = (text or b"").split()
                joined = b" ".join(words)
                if hashlib.blake2b(joined, digest_size=16).digest() != seq:
                    continue  # another text under the same doc_id
                u = words_of.of(words)
                at = np.flatnonzero(np.isin(_signed(_keys(u, windows, window)), found.values.to_numpy()))
                ids.append(doc), seqs.append(seq), blobs.append(pack.compress(joined))
                starts.append(at.astype(np.int32)), hashes.append(_signed(windows(u, window)[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(seqs, pa.binary()), pa.array(blobs, pa.binary()),
                 pa.array(starts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "seq", "blob", "starts", "hashes"],
            )

    return extend


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, kept = [], []
            rows = zip(batch.column(2).to_pylist(), *[batch.column(k) for k in (3, 4, 5)])
            for blob, starts, hashes, again in rows:
                words = unpack.decompress(blob).split(b" ")
                edge = np.zeros(len(words) + 1, np.int32)
                at = starts.values.to_numpy()[np.isin(hashes.values.to_numpy(), again.values.to_numpy())]
                edge[at] += 1  # starts are distinct
                edge[at + window] -= 1
                stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                removed.append(len(words) - len(stay))
                kept.append(b" ".join([words[i] for i in stay.tolist()]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "seq", "n_removed", "kept"],
            )

    return cut


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word covered by a ``window``-word passage that also starts in a document of smaller id.

    ``docs(doc_id, text)`` -> ``(doc_id, n_words, n_removed, kept, whole_sha)``, one row per input row. ``kept``
    is the remaining words joined by one space; it is null where nothing goes (``whole_sha`` is the SHA-256
    of all words then) and empty where everything goes. Words are runs of anything but ASCII white space.

    Level-wise doubling: at half the length, every full window is represented by the smallest half-length hash
    inside it, which is one row per some 13 words; keys that occur in one document only are dropped. Only windows
    around the surviving keys are extended to the full length, hashed, and kept where they repeat. At the full
    length no candidate is left to extend, since longer repeats are unions of these windows. Documents with the
    same words are one candidate, of the smallest id; the others go whole.

    Null or empty text has no words. Rows without ``doc_id`` keep all words and are nobody's source. Rows
    that repeat a ``doc_id`` are one document: they do not remove each other's words. Other columns are ignored.
    Hashes have 64 bits for windows and 128 for whole texts.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seen = stored(
        docs.mapInArrow(
            _scan(window), "doc_id bigint, n_words bigint, seq binary, sha string, keys array<bigint>"
        ),
        "substr-keys",
    )
    able = seen.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    first = able.groupBy("seq").agg(F.min("doc_id").alias("first"))
    lead = able.join(first, "seq").where("doc_id = first").select("doc_id", "seq", "keys").dropDuplicates(["doc_id", "seq"])
    rows = lead.select("doc_id", "seq", F.explode("keys").alias("key"))
    again = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    found = rows.join(again.select("key"), "key").groupBy("doc_id", "seq").agg(F.collect_list("key").alias("keys"))
    near = stored(
        docs.join(found, "doc_id")
        .select("doc_id", "text", "seq", "keys")
        .mapInArrow(_extend(window), "doc_id bigint, seq binary, blob binary, starts array<int>, hashes array<bigint>"),
        "substr-windows",
    )
    # Once per document, however often a passage repeats inside it.
    full = near.select("doc_id", "seq", F.explode(F.array_distinct("hashes")).alias("hash"))
    earliest = full.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    hits = (
        full.join(earliest.select("hash", "low"), "hash")
        .where("doc_id > low")
        .groupBy("doc_id", "seq")
        .agg(F.collect_list("hash").alias("again"))
    )
    cut = (
        near.dropDuplicates(["doc_id", "seq"]).select("doc_id", "seq", "blob", "starts", "hashes")
        .join(hits, ["doc_id", "seq"])
        .mapInArrow(_cut(window), "doc_id bigint, seq binary, n_removed bigint, kept string")
    )
    marked = seen.drop("keys").join(first, "seq", "left")
    copy = (F.col("n_words") >= window) & (F.col("doc_id") > F.col("first"))
    return marked.join(cut, ["doc_id", "seq"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.col("sha").alias("whole_sha"),
    )
