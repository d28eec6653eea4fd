"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscope.llm.support import small_batches, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The sample the model is fitted on: about so many documents of each language, dealt by hash.
FIT_DOCS = 3000
# Entries of the model: words and n-grams of each length, the most frequent first.
ENTRIES = 60_000
LONGEST = 4
UNKNOWN = "und"
# Cost (negative log10 frequency) of what a language was never seen with.
PENALTY = 7.0
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between two marks; single characters without them."""
    marked = f" {word} " if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, count), added up per batch."""
    for batch in batches:
        seen: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen.update((lang, w) for w in words_of(text or ""))
        keys = list(zip(*seen)) or [(), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(seen.values(), pa.int64())],
            names=["lang", "word", "n"],
        )


def _ngrams(longest: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, word, n in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                for size in range(1, longest + 1):
                    for g in grams(word, size):
                        seen[lang, size, g] += n
            keys = list(zip(*seen)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.string()),
                 pa.array(seen.values(), pa.int64())],
                names=["lang", "size", "item", "n"],
            )

    return split


class Model:
    """Costs of words and n-grams in every language; ``tables[0]`` holds words, ``tables[k]`` k-grams."""

    def __init__(self, langs: list[str], tables: list[dict[str, np.ndarray]]) -> None:
        self.langs, self.tables = langs, tables
        self.seen: dict[str, np.ndarray] = {}

    def cost(self, word: str) -> np.ndarray:
        """Of a word; an unknown one by the mean over its n-grams, of the greatest length at which any is known."""
        found = self.tables[0].get(word)
        if found is not None:
            return found
        found = self.seen.get(word)
        if found is None:
            found = self._backed_off(word)
            if len(self.seen) >= 300_000:
                self.seen.clear()
            self.seen[word] = found
        return found

    def _backed_off(self, word: str) -> np.ndarray:
        for size in range(len(self.tables) - 1, 0, -1):
            table = self.tables[size]
            known = [table[g] for g in grams(word, size) if g in table]
            if known:
                return np.mean(known, axis=0)
        return np.full(len(self.langs), PENALTY)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least mean cost, and its share of the probability that the costs stand for."""
        counts = Counter(words_of(text or ""))
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        n = np.fromiter(counts.values(), np.float64, len(counts))
        costs = np.stack([self.cost(w) for w in counts])
        mean = n @ costs / n.sum()
        best = int(np.argmin(mean))
        # Words of a text are far from independent: their evidence grows with the root of their number.
        share = 1 / np.exp((mean[best] - mean) * math.log(10) * math.sqrt(n.sum())).sum()
        return self.langs[best], float(share)


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, entries: int = ENTRIES, longest: int = LONGEST) -> Model:
    """A model from ``labelled(doc_id, text, lang)``; rows without lang or text teach nothing.

    Of each language about ``fit_docs`` documents are used (whole, chosen by a hash of doc_id and text at a rate from
    the language's count), and the ``entries`` most frequent words and n-grams of each length, so that the model has a
    fixed size however large the table is.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", "text")
    # One number for each language; the model has a column for each.
    per_lang = rows.groupBy("lang").agg(F.count("*").alias("docs")).collect()
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    docs = F.element_at(F.create_map(*[F.lit(x) for r in per_lang for x in r] or [F.lit(""), F.lit(0)]), F.col("lang"))
    picked = rows.where(chance * docs < fit_docs)
    words = stored(
        picked.select("lang", "text").mapInArrow(_count, "lang string, word string, n bigint")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "langid-words",
    )
    items = words.select("lang", F.lit(0).alias("size"), F.col("word").alias("item"), "n").unionByName(
        words.mapInArrow(_ngrams(longest), "lang string, size int, item string, n bigint")
    )
    items = stored(items.groupBy("size", "item", "lang").agg(F.sum("n").alias("n")), "langid-items")
    totals: dict[tuple[int, str], int] = {(r[0], r[1]): r[2] for r in items.groupBy("size", "lang").agg(F.sum("n")).collect()}
    langs = sorted({lang for _, lang in totals})
    place = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict[str, np.ndarray]] = []
    for size in range(longest + 1):
        most = (
            items.where(F.col("size") == size).groupBy("item")
            .agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
            .orderBy(F.desc("all"), "item").limit(entries)
        )
        table = {}
        for row in most.select("item", "by").toLocalIterator():
            cost = np.full(len(langs), PENALTY)
            for lang, n in row["by"]:
                cost[place[lang]] = min(PENALTY, -math.log10(n / totals[size, lang]))
            table[row["item"]] = cost
        tables.append(table)
    return Model(langs, tables)


def _predict(sent):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tables = sent.value
        own = Model(langs, [dict(zip(items, costs.astype(np.float64))) for items, costs in tables])
        for batch in batches:
            found = [own.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return predict


def held_out() -> Column:
    """Documents that never teach: crc32 of the decimal doc_id leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Predict the language of every whole text: ``docs`` -> its columns ``keep``, ``lang_pred``, ``score``.

    A known word counts with its log frequency in each language; an unknown word by the longest of its character
    n-grams that are known. The language with the least mean cost per word wins; ties go to the first by
    code point. ``score`` is its share of the probability, 0 to 1. A null text and one without letters are ``und`` with
    score 0. Columns but ``text`` play no part. The model has a fixed number of entries and is broadcast.
    """
    small_batches(docs.sparkSession)
    # Plain data travels, since executors may have no copy of the class.
    tables = [(list(t), np.array(list(t.values()), np.float32).reshape(len(t), len(model.langs))) for t in model.tables]
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, tables))
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(_predict(sent), f"{schema}, lang_pred string, score double")
