"""Periodic runs against a plain search of every period."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnscope.llm import periodic, queries


def plain_runs(words):
    """(start, length, period): every period tried at every place."""
    seen = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 4 * q:
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in seen.items() if e - s >= 6)


def plain_left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_with_runs(rng):
    k = rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(k) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 3)):
        period, times = rng.randint(1, 25), rng.randint(2, 8)
        block = [rng.randrange(k) for _ in range(period)] * times
        at = rng.randint(0, len(words))
        words[at:at] = block[: max(0, len(block) - rng.randint(0, period))]
    return words * rng.choice([1, 1, 1, 4, 5])


def test_runs_of_many_documents():
    rng = random.Random(5)
    for _ in range(25):
        docs = [words_with_runs(rng) for _ in range(rng.randint(0, 9))]
        assert periodic.runs_of([np.array(d, np.int64) for d in docs]) == [plain_runs(d) for d in docs]


def test_words_that_defeat_weak_hashes():
    odd = [bin(i).count("1") & 1 for i in range(2048)]
    text = odd * 4 + [7] + odd + [1 - x for x in odd]
    assert periodic.runs_of([np.array(text)]) == [plain_runs(text)]


def test_a_stretch_that_a_hash_made_too_long():
    text = np.array([1, 2, 3, 4] * 5 + [9, 9, 9])
    assert periodic._checked(text, 8, 4, 0, len(text)) == (0, 20)
    assert periodic._checked(text[::-1].copy(), 10, 4, 0, len(text)) == (3, 23)


SCHEMA = "doc_id bigint, text string, runs string, n_words string, start string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [" ".join(f"w{x}" for x in words_with_runs(rng)) for _ in range(40)]
    texts += [None, "", " \n\t", "one", "a " * 6, "a " * 5, "ü\x0bü\x0cü\rü ü\nü", "x x " * 40, "z" * 50_000]
    texts += [" ".join(f"v{i % 500}" for i in range(60_000)), "k " * 30_000]
    table = [(i, t, "x", "y", "z") for i, t in enumerate(texts)]
    return table + [table[3], (None, texts[0], None, None, None), (5, None, None, None, None)]


@pytest.mark.parametrize("together", [1 << 18, 50])
def test_documents(spark, rows, together, monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", together)
    found = periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    expected = Counter()
    for doc, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words) if len(words) < 5000 else [(0, len(words), 500 if words[0] == "v0" else 1)]
        expected[doc, len(words), str(runs), plain_left(words, runs)] += 1
    assert Counter((r.doc_id, r.n_words, str([tuple(x) for x in r.runs]), r.collapsed) for r in found) == expected
    for r in found:
        best = max(r.runs, key=lambda x: (x.length / x.period, -x.start), default=None)
        assert r.strongest == best
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planted_texts(spark, rows):
    import zlib

    given = spark.createDataFrame(rows, SCHEMA)
    found = Counter((r.doc_id, r.text) for r in queries.with_planted_runs(given.select("doc_id", "text")).collect())
    expected = Counter()
    for doc, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0:
            n, g = len(words), h // 10
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
            text = " ".join(words) if text is not None else ""
        expected[doc, text or None if text is None else text] += 1
    assert {(d, t or "") for d, t in found} == {(d, t or "") for d, t in expected}
    assert sum(found.values()) == len(rows)


def test_digests(spark, tmp_path, rows):
    given = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA).select("doc_id", "text")
    given.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).where(F.col("doc_id") != 5).collect()}
    for r in queries.with_planted_runs(given).where(F.col("doc_id") != 5).collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        if len(words) > 5000:
            continue
        runs = plain_runs(words)
        own = found[r.doc_id]
        assert own.n_runs == len(runs)
        assert own.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert own.collapsed_sha256 == hashlib.sha256(plain_left(words, runs).encode()).hexdigest()
        assert (own.exponent_milli is None) == (not runs)
        if runs:
            assert own.exponent_milli == 1000 * own.length // own.period
