"""Quality of whole documents by attention over their passages, learned from labels of documents."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscope.llm.support import small_batches, stored, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The sample the model is fitted on: documents of each label, chosen by hash, and passages of all of them.
FIT_DOCS, FIT_PASSAGES = 1500, 16_000
# Words of a passage; a text is cut into passages from its start, the last may be shorter.
PASSAGE = 128
# Hash buckets of words and of their shapes, and measures of a passage.
WORDS, SHAPES, MEASURES = 256, 256, 8
FEATURES = WORDS + SHAPES + MEASURES
# Width of a passage's representation and of the attention's gates.
HIDDEN, GATES = 32, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 128, 0.004, 1e-4, 13
# Passages that are encoded at once.
TOGETHER = 2048

_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


class _Vocabulary:
    """What is known of each word: its buckets, characters, letters in upper case, digits, other signs."""

    LIMIT = 1 << 17

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, int, int, int, int]] = []

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.rows) > self.LIMIT:
            self.place.clear(), self.rows.clear()
        for word in set(words).difference(self.place):
            self.place[word] = len(self.rows)
            self.rows.append(self._seen(word))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        known, at = np.unique(at, return_inverse=True)
        return np.array([self.rows[k] for k in known.tolist()], np.int64).reshape(-1, 6)[at]

    @staticmethod
    def _seen(word: bytes) -> tuple[int, int, int, int, int, int]:
        text = word.decode()
        case = lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a"
        shape = _DIGITS.sub("0", _LETTERS.sub(case, text))
        letters = sum(c.isalpha() for c in text)
        digits = sum(c.isdigit() for c in text)
        return (
            xxhash.xxh3_64_intdigest(text.lower()) % WORDS,
            xxhash.xxh3_64_intdigest(shape) % SHAPES,
            len(text),
            sum(c.isupper() for c in text),
            digits,
            len(text) - letters - digits,
        )


def passages(words: list[bytes], vocabulary: _Vocabulary) -> np.ndarray:
    """A document as (passages x features); a text without words is one passage of zeros.

    Features are the roots of the shares of word and shape buckets, and measures: shares of signs, upper case letters
    and digits among characters, of distinct words, of the most frequent word and of words that repeat the one before, length of
    the passage and of its words.
    """
    count = max(1, math.ceil(len(words) / PASSAGE))
    out = np.zeros((count, FEATURES), np.float32)
    if not words:
        return out
    seen = vocabulary.of(words)
    where = np.arange(len(words)) // PASSAGE
    size = np.bincount(where, minlength=count).astype(np.float64)
    for column, first, wide in ((0, 0, WORDS), (1, WORDS, SHAPES)):
        times = np.bincount(where * wide + seen[:, column], minlength=count * wide).reshape(count, wide)
        out[:, first : first + wide] = np.sqrt(times / size[:, None])
    chars = np.bincount(where, seen[:, 2], count)
    for k, column in enumerate((5, 3, 4)):
        out[:, WORDS + SHAPES + k] = np.bincount(where, seen[:, column], count) / chars
    number = {w: i for i, w in enumerate(set(words))}
    word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pair, times = np.unique(where * len(number) + word, return_counts=True)
    place = pair // len(number)
    most = np.zeros(count)
    np.maximum.at(most, place, times)
    again = np.bincount(where[1:], (word[1:] == word[:-1]) & (where[1:] == where[:-1]), count)
    out[:, -5] = np.bincount(place, minlength=count) / size
    out[:, -4] = most / size
    out[:, -3] = again / size
    out[:, -2] = size / PASSAGE
    out[:, -1] = np.minimum(chars / size / 20, 2)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Passages to representations, gated attention over them, and a logistic score of the weighted sum.

    ``h = tanh(x W + b)``; ``e = (tanh(h V + r) * sigmoid(h U + s)) w``; ``a = softmax(e)`` over a document; the score is
    ``sigmoid(c sum(a h) + d)``. ``e`` is bounded by the sum of ``|w|``, so sums of ``exp(e)`` need no rescaling and can be taken
    in any pieces.
    """

    NAMES = ("W", "b", "V", "r", "U", "s", "w", "c", "d")

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = weights

    @classmethod
    def new(cls, features: int = FEATURES, hidden: int = HIDDEN, gates: int = GATES, seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed)
        some = lambda n, *shape: rng.normal(0, 1 / math.sqrt(n), shape)
        return cls({
            "W": some(features / 30, features, hidden), "b": np.zeros(hidden), "V": some(hidden, hidden, gates), "r": np.zeros(gates),
            "U": some(hidden, hidden, gates), "s": np.zeros(gates), "w": some(gates, gates), "c": some(hidden, hidden), "d": np.zeros(1),
        })

    @classmethod
    def constant(cls, share: float) -> Model:
        """The same score for every document."""
        own = cls.new()
        own.weights["c"] = np.zeros(HIDDEN)
        own.weights["d"] = np.array([math.log(share / (1 - share))])
        return own

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representations of passages, and their unscaled attention ``exp(e)``."""
        k = self.weights
        h = np.tanh(x @ k["W"] + k["b"])
        return h, np.exp((np.tanh(h @ k["V"] + k["r"]) * _sigmoid(h @ k["U"] + k["s"])) @ k["w"])

    def score(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(z @ self.weights["c"] + self.weights["d"])

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Weighted log loss over documents whose passages start at ``first``, and its gradient."""
        k = self.weights
        whose = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        add = lambda v: np.add.reduceat(v, first, axis=0)
        h = np.tanh(x @ k["W"] + k["b"])
        t, g = np.tanh(h @ k["V"] + k["r"]), _sigmoid(h @ k["U"] + k["s"])
        raised = np.exp((t * g) @ k["w"])
        a = raised / add(raised)[whose]
        z = add(a[:, None] * h)
        p = self.score(z)
        loss = -(weight * np.log(np.where(label > 0, p, 1 - p) + 1e-12)).sum()
        do = weight * (p - label)
        dz = (do[:, None] * k["c"])[whose]
        da = (h * dz).sum(axis=1)
        de = a * (da - add(a * da)[whose])
        dq = de[:, None] * k["w"]
        dt, dg = dq * g * (1 - t * t), dq * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ k["V"].T + dg @ k["U"].T) * (1 - h * h)
        return loss, {
            "W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "r": dt.sum(axis=0), "U": h.T @ dg, "s": dg.sum(axis=0),
            "w": (t * g).T @ de, "c": z.T @ do, "d": do.sum(keepdims=True),
        }


def trained(bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> Model:
    """A model of documents given as passages, by small batches with adaptive steps in a fixed order."""
    model, rng = Model.new(), np.random.default_rng(SEED)
    slow = {n: np.zeros_like(w) for n, w in model.weights.items()}
    fast = {n: np.zeros_like(w) for n, w in model.weights.items()}
    step, steps = 0, EPOCHS * math.ceil(len(bags) / BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            first = np.cumsum([0, *[len(bags[k]) for k in own[:-1]]])
            x = np.concatenate([bags[k] for k in own]).astype(np.float64)
            _, slope = model.gradient(x, first, label[own], weight[own] / weight[own].sum())
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for n, g in slope.items():
                slow[n] += 0.1 * (g - slow[n])
                fast[n] += 0.001 * (g * g - fast[n])
                move = slow[n] / (1 - 0.9**step) / (np.sqrt(fast[n] / (1 - 0.999**step)) + 1e-8)
                model.weights[n] -= rate * (move + DECAY * model.weights[n])
    return model


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = _Vocabulary()
    for batch in batches:
        for i, text in enumerate(texts_of(batch.column(2))):
            x = passages((text or b"").split(), vocabulary).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(x)], pa.int64()), pa.array([x.tobytes()])],
                names=["doc_id", "quality", "n_passages", "passages"],
            )


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_passages: int = FIT_PASSAGES) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; the caller leaves out labels that must not teach.

    The sample is bounded: of each label the ``fit_docs`` documents of smallest hash that have a text, then as many of them in
    that order as have ``fit_passages`` passages together; a document that does not fit in is passed over. Documents count as if the
    sample had the labels' shares. Labels other than 0 and 1, without ``doc_id``, or that contradict each other teach nothing. Of
    rows that repeat a ``doc_id`` the smallest text teaches. Without both labels the score is constant: the share of
    label 1, one row of each added.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    known = known.agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most"))
    known = stored(known.where("quality = most").drop("most"), "mil-labels")
    count = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(count) < 2:
        return Model.constant((count.get(1, 0) + 1) / (sum(count.values()) + 2))
    rank = F.xxhash64("doc_id")
    picked = known.where("quality = 0").orderBy(rank, "doc_id").limit(fit_docs).unionByName(
        known.where("quality = 1").orderBy(rank, "doc_id").limit(fit_docs)
    )
    # At most 2 * fit_docs rows.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    made = stored(
        rows.mapInArrow(_encode, "doc_id bigint, quality int, n_passages bigint, passages binary"), "mil-passages"
    )
    taken, left = [], fit_passages
    for doc, n in made.orderBy(rank, "doc_id").select("doc_id", "n_passages").collect():
        if n <= left:
            taken.append(doc)
            left -= n
    found = made.join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in taken], "doc_id bigint")), "doc_id")
    found = sorted(found.collect(), key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["passages"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in found]
    label = np.array([r["quality"] for r in found], np.float64)
    if len(set(label)) < 2:
        return Model.constant((count[1] + 1) / (sum(count.values()) + 2))
    share = [count[k] / (label == k).sum() for k in (0, 1)]
    weight = np.where(label > 0, share[1], share[0])
    return trained(bags, label, weight / weight.mean())


class _Sums:
    """Attention sums of the documents of a batch, filled passage by passage."""

    def __init__(self, model: Model, docs: int) -> None:
        self.model = model
        self.total, self.z = np.zeros(docs), np.zeros((docs, HIDDEN))
        self.top, self.top_at, self.count = np.full(docs, -1.0), np.zeros(docs, np.int64), np.zeros(docs, np.int64)

    def add(self, x: np.ndarray, whose: np.ndarray, number: np.ndarray) -> None:
        """``whose`` ascends; ``number`` of a passage inside its document."""
        h, a = self.model.attend(x.astype(np.float64))
        first = np.flatnonzero(np.diff(whose, prepend=-1))
        own = whose[first]
        self.total[own] += np.add.reduceat(a, first)
        self.z[own] += np.add.reduceat(a[:, None] * h, first, axis=0)
        self.count[own] += np.diff(np.append(first, len(whose)))
        order = np.lexsort((number, -a, whose))
        best = order[np.flatnonzero(np.diff(whose[order], prepend=-1))]
        more = a[best] > self.top[whose[best]]
        self.top[whose[best[more]]], self.top_at[whose[best[more]]] = a[best[more]], number[best[more]]


def _score(weights: dict[str, np.ndarray]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, vocabulary = Model(weights), _Vocabulary()
        for batch in batches:
            sums, held, size = _Sums(model, batch.num_rows), [], 0

            def emptied() -> None:
                sums.add(*[np.concatenate(c) for c in zip(*held)])
                held.clear()

            for i, text in enumerate(texts_of(batch.column(1))):
                words = (text or b"").split()
                for k in range(0, max(len(words), 1), TOGETHER * PASSAGE):
                    x = passages(words[k : k + TOGETHER * PASSAGE], vocabulary)
                    held.append((x, np.full(len(x), i), np.arange(len(x)) + k // PASSAGE))
                    size += len(x)
                    if size >= TOGETHER:
                        emptied()
                        size = 0
            if held:
                emptied()
            p = model.score(sums.z / np.maximum(sums.total, 1e-300)[:, None])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (p, sums.count, sums.top_at, sums.top / np.maximum(sums.total, 1e-300)))],
                names=["doc_id", "score", "n_passages", "top_passage", "top_weight"],
            )

    return score


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text: ``docs(doc_id, text)`` -> ``(doc_id, score, n_passages, top_passage, top_weight)``, one row per input row.

    Every passage of a text is encoded; the score is that of the sum of their representations, weighted by the learned attention.
    ``score`` is 0 to 1, higher where label 1 is likelier. ``top_passage`` is the passage of most attention (from 0; ties: the first), with
    its share. A text is scored where it is read, some passages at a time: nothing is shuffled, and the model, which has a fixed
    size, travels with the task.

    Null and empty text are one empty passage. Rows are judged alone: repeated rows show the same score, a null ``doc_id`` stays
    null. Columns other than ``doc_id`` and ``text`` play no part.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _score(model.weights), "doc_id bigint, score double, n_passages bigint, top_passage bigint, top_weight double"
    )
