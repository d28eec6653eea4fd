"""Each operator against brute force on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import datetime
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from turnscope.llm import editprint, embeddup, jaccard, langid, lmscore, mixing, ngrams, packing, pii, substrings, urlcascade
from turnscope.llm.components import components
from turnscope.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, region string, size string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    """Shared passages, near and exact copies, edge cases; a doc_id given twice, one missing."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "über", "naïve", "x,", "1984"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(120)
    found = [text(rng.randint(1, 90)) for _ in range(25)]
    found += [text(10) + " " + passage + "\t" + text(rng.randint(5, 40)) for _ in range(8)]
    for k in range(14):
        near = base.split()
        for _ in range(k):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        found.append(" ".join(near))
    found += [base, base.upper(), None, "", " \n", "one", "one", "a b c", "z" * 50_000, text(3000), passage + " " + passage, None]
    order = list(range(len(found)))
    rng.shuffle(order)
    table = [(i * 3, t) for i, t in zip(order, found)]
    table += [table[0], (None, base), (None, None), (6, "text under an id that is taken")]
    return [(d, t, rng.choice(["en", None]), rng.choice(["b", "a", None]), 1, 7, "x", "y") for d, t in table]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def closure(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    expected = closure(edges, {n for e in edges for n in e})
    assert all(found.get(n, n) == c for n, c in expected.items())


@pytest.mark.parametrize("region", [1024, 3])
def test_jaccard(docs, rows, empty, region):
    sets = defaultdict(list)
    for doc, text, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
        sets[doc].append(({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}) if w else set())
    pairs = [
        (a, b) for a, b in itertools.combinations([d for d in sets if d is not None], 2)
        for x in sets[a] for y in sets[b] if x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    group = closure(pairs, [d for d in sets if d is not None])
    found = jaccard.jaccard_components(docs, region=region).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter(
        (d, len(s), group.get(d)) for d, many in sets.items() for s in many
    )
    assert jaccard.jaccard_components(empty).count() == 0


def test_substrings(docs, rows, empty):
    first = {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - 49):
            if doc is not None:
                first[tuple(w[i : i + 50])] = min(doc, first.get(tuple(w[i : i + 50]), doc))
    expected = Counter()
    for doc, text, *_ in rows:
        w = words(text)
        gone = {j for i in range(len(w) - 49) if doc is not None and first[tuple(w[i : i + 50])] < doc for j in range(i, i + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected[doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    found = substrings.without_repeats(docs).withColumn("sha", F.when(F.col("kept").isNull(), F.col("whole_sha")).otherwise(F.sha2("kept", 256)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.sha) for r in found.collect()) == expected
    assert substrings.without_repeats(empty).count() == 0


def stupid_backoff(texts, order, backoff=0.4):
    """Score of each text, word by word: the longest n-gram seen, a factor for each word that it is shorter."""
    count = Counter()
    for w in texts:
        for k in range(1, order + 1):
            count.update((tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    total = sum(n for g, n in count.items() if len(g) == 1)
    scores = []
    for w in texts:
        score = 0.0
        for i in range(len(w)):
            grams = [tuple(w[i - k : i + 1]) for k in reversed(range(min(order, i + 1)))]
            back = next(j for j, g in enumerate(grams) if count[g])
            context = grams[back][:-1]
            score += math.log(count[grams[back]] / (count[context] if context else total)) + back * math.log(backoff)
        scores.append(score)
    return scores


@pytest.mark.parametrize("sizes", [{}, {"passes": 1, "hot": 0, "heavy": 0}, {"order": 1}, {"order": 3, "passes": 3, "hot": 5, "heavy": 9}, {"order": 4, "passes": 1}])
def test_lm_scores(docs, rows, empty, sizes):
    score, n = Counter(), Counter()
    texts = [words(text) for _, text, *_ in rows]
    for (doc, *_), w, own in zip(rows, texts, stupid_backoff(texts, sizes.get("order", 2))):
        n[doc] += len(w)
        score[doc] += own
    found = lmscore.lm_scores(docs, **sizes).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.log_score is None
        else:
            assert r.n_words == n[r.doc_id] and r.log_score == pytest.approx(score[r.doc_id], abs=1e-6)
    assert lmscore.lm_scores(empty).count() == 0


def test_lm_scores_explode_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "TOGETHER", 7)
    texts = ["a b a b a b", "", "a", "b a", "c " * 30, "a b c d e f g h i j k l m n o p"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: r.log_score for r in lmscore.lm_scores(df, order=3).collect()}
    expected = stupid_backoff([t.split() for t in texts], 3)
    assert all(found[i] == pytest.approx(s, abs=1e-9) for i, s in enumerate(expected))


def test_lm_scores_hot_pair(spark):
    """A pair that fills half the corpus."""
    rows = [(i, "x y " * 400 + f"w{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.log_score for r in lmscore.lm_scores(df, hot=4, heavy=1).collect()}
    expected = stupid_backoff([t.split() for _, t in rows], 2)
    assert all(found[i] == pytest.approx(s, abs=1e-6) for i, s in enumerate(expected))


@pytest.mark.parametrize("order, least", [(1, 1), (2, 1), (3, 1), (3, 2), (4, 3)])
def test_ngram_scores(docs, rows, empty, order, least):
    seen, score, n = Counter(), Counter(), Counter()
    for _, text, *_ in rows:
        w = words(text)
        seen.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(c for gram, c in seen.items() if len(gram) == 1)
    for doc, text, *_ in rows:
        w = words(text)
        n[doc] += len(w)
        for i in range(len(w)):
            k = longest = min(order, i + 1)
            while k > 1 and seen[tuple(w[i + 1 - k : i + 1])] < least:
                k -= 1
            context = seen[tuple(w[i + 1 - k : i])] if k > 1 else total
            score[doc] += (longest - k) * math.log(0.4) + math.log(seen[tuple(w[i + 1 - k : i + 1])] / context)
    found = ngrams.ngram_scores(docs, order=order, least=least, hot=5).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.log_score is None
        else:
            assert r.n_words == n[r.doc_id] and r.log_score == pytest.approx(score[r.doc_id], abs=1e-6)
    assert ngrams.ngram_scores(empty, order=order).count() == 0


def test_pair_seen_once_is_no_step_back(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a d")], "doc_id bigint, text string")
    found = {r.doc_id: r.log_score for r in ngrams.ngram_scores(docs, order=2).collect()}
    assert found == {1: pytest.approx(math.log(2 / 5 * 1 / 2 * 1)), 2: pytest.approx(math.log(2 / 5 * 1 / 2))}


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    strange = "ΟΔΥΣΣΕΥΣ İstanbul e\u0301 <|endoftext|> it's 42²\u00a0x\x1cy ﬁ 日本"
    more = docs.sparkSession.createDataFrame([(9000, strange)], "doc_id bigint, text string")
    expected = Counter()
    for doc, text in [(r[0], r[1]) for r in rows] + [(9000, strange)]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            expected[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    found = packing.packed(docs.select("doc_id", "text").unionByName(more), tokenizer_path(), length=256, open_bins=4).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts[:-1])] and sum(n for _, n in parts) <= 256
    assert len(bins) <= 1.1 * sum(r.length for r in found) / 256 + 4
    assert packing.packed(empty, tokenizer_path()).count() == 0


def test_open_bins_best_fit():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n, n) for n in (6, 7, 3)] == [None, None, [7, 3]]  # the least space that holds it
    assert bins.put(5, 5) is None and bins.put(8, 8) == [8]  # the fullest closes
    assert sorted(bins.rest()) == [[5], [6]]


def test_mixing(docs, rows, empty):
    found = mixing.mixed_copies(docs, group=7).collect()
    assert sorted((r.doc_id or -1, r.size, r.copies) for r in found) == sorted(
        (r.doc_id or -1, r.size, r.copies) for r in mixing.mixed_copies(docs, group=7).collect()
    )
    assert Counter((r.doc_id, r.size) for r in found) == Counter((d, len(words(t))) for d, t, *_ in rows)
    assert all(0 <= r.copies <= 2 and 0 <= r.rate <= 2 for r in found)
    size = Counter()
    for _, text, _, source, *_ in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, left, total = dict(zip(order, itertools.cycle((5, 2, 1)))), set(size), 1.5 * sum(size.values())
    target = {}
    while True:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * size[s]}
        target |= share
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            total -= target[s]
            left.discard(s)
    by = {r.source_size: r.target for r in found}
    assert by == pytest.approx({size[s]: t for s, t in target.items()})
    assert mixing.mixed_copies(empty).count() == 0


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mixed_copies(docs).groupBy("source_size", "target").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.sum(F.col("size") * F.col("rate")).alias("rated")
    )
    for r in got.collect():
        assert r.rated == pytest.approx(r.target, rel=1e-6) and r.taken == pytest.approx(r.target, rel=0.05)


def test_language(spark, docs, rows, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table.where(~langid.held_out()))
    found = langid.identified(table.where(langid.held_out()), model, ("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)
    odd = {r.text: r for r in langid.identified(docs.select("doc_id", "text"), model, ("doc_id", "text")).collect()}
    assert odd[None].lang_pred == odd[""].lang_pred == "und" and odd[None].score == 0
    assert langid.identified(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.identified(docs, nothing).collect()} == {"und"}


def test_language_backs_off():
    table = {g: np.array([c, 2.0]) for g, c in (("xy", 1.0), (" x", 3.0))}
    model = langid.Model(["a", "b"], [{"known": np.array([5.0, 1.0])}, {"x": np.array([0.5, 4.0])}, table])
    assert model.predict("Known!")[0] == "b"
    assert model.cost("xy").tolist() == [2.0, 2.0]  # the mean of the known bigrams
    assert model.cost("ax").tolist() == [0.5, 4.0]  # no bigram is known
    assert model.cost("q").tolist() == [langid.PENALTY] * 2


def test_fingerprints(docs, rows, empty):
    embedding = editprint.Embedding()
    chain = sorted(((d, t or "") for d, t, *_ in rows if d is not None))
    expected = Counter()
    for (doc, text), (_, following) in zip(chain, chain[1:] + chain[:1]):
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = embedding.prints([text, new, following])
        expected[
            doc, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b,
            editprint.likeness(embedding, a, b), editprint.likeness(embedding, a, c),
        ] += 1
    found = editprint.fingerprints(docs, buckets=6, chars=2000).collect()
    assert Counter(tuple(r) for r in found if r.doc_id is not None) == expected and len(found) == len(rows)
    assert editprint.fingerprints(empty).count() == 0


def test_fingerprint_likeness(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 2000, 9000)]
    near = [t[:100] + "QZ" + t[101:] for t in texts]
    embedding = editprint.Embedding()
    a, b = embedding.prints(texts), embedding.prints(near)
    assert all(editprint.likeness(embedding, x, y) > 0.6 for x, y in zip(a, b))
    assert editprint.likeness(embedding, a[1], embedding.prints([texts[2][:2100]])[0]) < 0.4
    table = spark.createDataFrame([*enumerate(a), (3, a[0]), (4, None)], "doc_id bigint, fingerprint string")
    assert {(r.a, r.b) for r in editprint.near_prints(table).collect()} == {(0, 3)}


def test_urls(spark):
    urls = [
        "http://A.Example.NET/en/x?y", "https://example.net/enx", "http://net/", "http://net", "ftp://x.org/fr/", "http://x.orgs/fr/",
        "http://www.example.com/de/1#a", "no scheme", None, "", "x://", "http://notexample.net/en/", "http://example.com?/de/", "a://b://c",
    ]
    rules = {("net", "/"): "block", ("example.net", "/en/"): "allow", ("example.com", "/de/"): "block", ("org", "/fr/"): "allow"}
    expected = {}
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if ("." + host).endswith("." + h) and path.startswith(p)]
        expected[i] = (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    table = spark.createDataFrame(urlcascade.RULES, "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlcascade.judged(pages, table).collect()}
    assert found == expected
    assert urlcascade.judged(pages.limit(0), table).count() == 0
    assert {r.verdict for r in urlcascade.judged(pages, table.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(50_000).select(F.xxhash64("id").alias("key"))
    listed = universe.where(F.pmod("key", F.lit(37)) == 0)
    levels = urlcascade.cascade(listed, universe)
    keys = np.array([r.key for r in universe.collect()], np.int64)
    assert (urlcascade.member(levels, keys.view(np.uint64)) == (keys % 37 == 0)).all()


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    vectors = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[0] + 0.02 * rng.standard_normal((60, 16)), base[:5], 2 * base[:3]])
    table = [(i, v.astype(float).tolist(), int(i % 2) if i >= 105 else 0) for i, v in enumerate(vectors)]
    table += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, vectors[0].tolist(), None),
              (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (None, vectors[0].tolist(), 0)]
    ok = {i: (np.array(v), label) for i, v, label in table if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = [
        (a, b) for a, b in itertools.combinations(ok, 2)
        if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0])
        and ok[a][0] @ ok[b][0] / np.linalg.norm(ok[a][0]) / np.linalg.norm(ok[b][0]) >= 0.98
    ]
    group, links = closure(pairs, [i for i, *_ in table]), Counter(itertools.chain(*pairs))
    frame = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int")
    for sizes in ({}, {"leaf": 8, "block": 5, "trees": 12}):
        found = {r.vec_id: r for r in embeddup.near_vectors(frame, **sizes).collect()}
        got = sum(r.n_links for r in found.values())
        assert got >= 0.9 * sum(links.values()) and all(found[i].n_links <= links[i] + (i == 0 or group[i] == 0) for i in ok)
        if not sizes:
            assert {i: r.component_id for i, r in found.items() if i is not None} == {i: c for i, c in group.items() if i is not None}
            assert all(found[i].n_links == links[i] for i in ok)
    assert embeddup.near_vectors(frame.limit(0)).count() == 0


def _luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark, empty):
    texts = [
        "card 4111111111111111 and 4111 1111 1111 1111, 4111111111111112 is none", "a.b@mail.example.com wrote A.B@mail.example.com",
        "on 2024-02-29, 29.02.2024 and 2023-02-29", "call +1 (583) 555-8469 or 583-555-8469 or (123) 555-8469",
        "ip 70.214.118.188 v 999.1.1.1 CC BY-NC 4.0.", "ssn 078-05-1120 not 666-05-1120", None, "", "clean text only", "4111111111111111",
    ]
    table = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, n_replaced int")
    found = {r.doc_id: r for r in pii.pseudonymised(table, "k").collect()}
    assert [found[i].n_replaced for i in range(len(texts))] == [2, 2, 2, 2, 1, 1, 0, 0, 0, 1]
    one, two, none = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", found[0].text)
    assert one == two.replace(" ", "") == found[9].text != "4111111111111111" and _luhn(one) and none == "4111111111111112"
    assert len(set(re.findall(r"\S+@\S+", found[1].text))) == 1 and "mail.example.com" not in found[1].text
    a, b, c = re.findall(r"[\d.-]{10}", found[2].text)
    assert datetime.date.fromisoformat(a) == datetime.datetime.strptime(b, "%d.%m.%Y").date() and c == "2023-02-29"
    phone = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}) or \(123\) 555-8469", found[3].text)[0]
    assert phone[:3] == phone[3:] != ("583", "555", "8469")
    assert "70.214.118.188" not in found[4].text and found[4].text.endswith("v 999.1.1.1 CC BY-NC 4.0.")
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} not 666-05-1120", found[5].text) and found[8].text == texts[8]
    assert pii.pseudonymised(table, "other").where("doc_id = 9").first().text != found[9].text
    domain = spark.range(189 * 773).select(pii.feistel(F.col("id"), 189, 773, "k", "date").alias("v"))
    assert domain.agg(F.countDistinct("v")).first()[0] == 189 * 773
    assert pii.pseudonymised(empty, "k").count() == 0
