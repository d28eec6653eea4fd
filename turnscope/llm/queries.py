"""One query for each operator, over its whole table, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnscope.functions.nested import bind
from turnscope.llm import editprint, embeddup, hardneg, jaccard, langid, lmscore, milquality, mixing, ngrams, packing, periodic, pii, substrings, urlcascade

TOKENIZER = "word_bpe_49k.json"
# A pair of words that occurs once says nothing of its own: op3_lm_score steps back from it, as its SQL does.
LEAST_PAIRS = 2
# The key of the pseudonyms; a real run names its own in this setting.
SECRET_SETTING, TEST_SECRET = "spark.turnscope.pii.secret", "only for tests"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def secret(spark: SparkSession) -> str:
    return spark.conf.get(SECRET_SETTING, TEST_SECRET)


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identified(docs, model)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mixed_copies(_documents(spark, folder))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate")


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lmscore.lm_scores(_documents(spark, folder), least=LEAST_PAIRS).withColumn("log_score", F.round("log_score", 5))


def op3_ngram_score(spark: SparkSession, folder: str) -> DataFrame:
    return ngrams.ngram_scores(_documents(spark, folder)).withColumn("log_score", F.round("log_score", 5))


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, folder))


def op5_edit_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return editprint.fingerprints(_documents(spark, folder))


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_documents(spark, folder), tokenizer_path())


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return urlcascade.judged(pages, spark.createDataFrame(urlcascade.RULES, "host string, path string, verdict string"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.without_repeats(_documents(spark, folder))
    sha = F.when(F.col("kept").isNull(), F.col("whole_sha")).otherwise(F.sha2("kept", 256))
    return kept.select("doc_id", "n_words", "n_removed", sha.alias("kept_sha256"))


def op9_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddup.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "text")
    return pii.pseudonymised(docs, secret(spark))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One text in ten, by crc32 of the decimal ``doc_id``, repeats some of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        text = F.array_join(F.transform(words, lambda _, i: F.get(words, place(i))), " ")
        return F.when(n > 0, text).otherwise(F.lit(""))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, bind(words, repeated)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(_documents(spark, folder).select("doc_id", "text")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("strongest.start").alias("start"),
        F.col("strongest.length").alias("length"),
        F.col("strongest.period").alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_quality_mil(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    found = milquality.quality_scores(docs, milquality.fit(docs, labels.where(~langid.held_out())))
    return found.select(
        "doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_passages", "top_passage", "top_weight",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_source_mix, op3_lm_score, op4_jaccard_join, op5_edit_fingerprint, op6_best_fit_packing,
        op7_url_filter, op8_substring_dedup, op9_embedding_dedup, op10_pii, op3_ngram_score, op11_periodic_runs,
        op12_hard_negatives, op13_quality_mil,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op3_lm_score": f"""
        WITH doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM doc),
        pair AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM word),
        one AS (SELECT w, count(*) AS n FROM word GROUP BY w),
        two AS (SELECT v, w, count(*) AS n FROM pair WHERE v IS NOT NULL GROUP BY v, w),
        cost AS (
            SELECT doc_id, CASE
                WHEN pair.v IS NULL THEN ln(b.n / (SELECT sum(n) FROM one))
                WHEN two.n >= 2 THEN ln(two.n / a.n)
                ELSE ln(0.4 * b.n / (SELECT sum(n) FROM one)) END AS s
            FROM pair JOIN one b ON b.w = pair.w LEFT JOIN one a ON a.w = pair.v
            LEFT JOIN two ON two.v = pair.v AND two.w = pair.w)
        SELECT doc_id, len(ws) AS n_words, round(coalesce(any_value(t.s), 0.0), 5) AS log_score
        FROM doc LEFT JOIN (SELECT doc_id, sum(s) AS s FROM cost GROUP BY doc_id) t USING (doc_id) GROUP BY doc_id, ws""",
    "op3_ngram_score": f"""
        WITH doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM doc),
        run AS (
            SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v,
                lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM word),
        one AS (SELECT w, count(*) AS n FROM run GROUP BY w),
        two AS (SELECT v, w, count(*) AS n FROM run WHERE v IS NOT NULL GROUP BY v, w),
        three AS (SELECT u, v, w, count(*) AS n FROM run WHERE u IS NOT NULL GROUP BY u, v, w),
        cost AS (
            SELECT run.doc_id, CASE
                WHEN three.n >= 1 THEN ln(three.n / uv.n)
                WHEN two.n >= 1 THEN ln(two.n / a.n) + CASE WHEN run.u IS NULL THEN 0 ELSE ln(0.4) END
                ELSE ln(b.n / (SELECT sum(n) FROM one))
                    + CASE WHEN run.u IS NOT NULL THEN 2 WHEN run.v IS NOT NULL THEN 1 ELSE 0 END * ln(0.4) END AS s
            FROM run JOIN one b ON b.w = run.w LEFT JOIN one a ON a.w = run.v
            LEFT JOIN two ON two.v = run.v AND two.w = run.w LEFT JOIN two uv ON uv.v = run.u AND uv.w = run.v
            LEFT JOIN three ON three.u = run.u AND three.v = run.v AND three.w = run.w)
        SELECT doc_id, len(ws) AS n_words, round(coalesce(any_value(t.s), 0.0), 5) AS log_score
        FROM doc LEFT JOIN (SELECT doc_id, sum(s) AS s FROM cost GROUP BY doc_id) t USING (doc_id) GROUP BY doc_id, ws""",
    "op4_jaccard_join": rf"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM doc),
        run AS (
            SELECT doc_id, i, n, string_agg(w, ' ') OVER
                (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM word),
        shingle AS (SELECT DISTINCT doc_id, s FROM run WHERE i <= greatest(n - 5, 0)),
        size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
        meet AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
            FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (
            SELECT a, b FROM meet JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
            WHERE 100 * m >= 80 * (x.n + y.n - m)),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM doc UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id
        FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id, n""",
    "op7_url_filter": rf"""
        WITH part AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        place AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM part),
        rules(h, p, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
        SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule,
            coalesce(max_by(verdict, length(h || p)), 'allow') AS verdict
        FROM place LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY page_id, host, path""",
    "op8_substring_dedup": f"""
        WITH doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM doc),
        run AS (
            SELECT doc_id, i, n, string_agg(w, ' ') OVER
                (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s FROM word),
        win AS (SELECT doc_id, i, hash(s) AS s FROM run WHERE i + 50 <= n),
        low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
        hit AS (SELECT doc_id, i FROM win JOIN low USING (s) WHERE doc_id > low),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
        kept AS (
            SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.i) AS kept, count(*) AS m
            FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (doc_id)""",
    "op9_embedding_dedup": """
        WITH RECURSIVE vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM vec UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other)
        SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, min(other) AS component_id,
            vec_id = min(other) AS kept
        FROM reach GROUP BY vec_id""",
    "op11_periodic_runs": f"""
        WITH given AS (
            SELECT doc_id, {_WORDS} AS ws, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                lambda crc, b: list_reduce(
                    list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                    lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h
            FROM documents),
        part AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, 3 + (h // 10) % 8 AS m FROM given),
        doc AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // m) ELSE i END + 1])
                ELSE ws END AS ws
            FROM part),
        word AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM doc),
        same AS (
            SELECT a.doc_id, a.i, b.i - a.i AS q FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.w = b.w
            WHERE b.i > a.i AND 4 * (b.i - a.i) <= a.n),
        island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
        stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM island GROUP BY doc_id, q, k),
        run AS (
            SELECT doc_id, s, len, min(q) AS q FROM stretch WHERE len >= 4 * q GROUP BY doc_id, s, len HAVING len >= 6),
        best AS (
            SELECT a.* FROM run a ANTI JOIN run b ON a.doc_id = b.doc_id AND (b.len * a.q > a.len * b.q
                OR b.len * a.q = a.len * b.q AND (b.s < a.s OR b.s = a.s AND b.q < a.q))),
        told AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs
            FROM run GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
        kept AS (
            SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.i) AS kept
            FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period,
            1000 * best.len // best.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
            sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM doc LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_hard_negatives": """
        WITH vec AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pair AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
            FROM vec a JOIN vec b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        near AS (
            SELECT a, b, score FROM pair WHERE same
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT near.a AS anchor_id, near.b AS positive_id,
            (row_number() OVER (PARTITION BY near.a, near.b ORDER BY pair.score DESC, pair.b))::INTEGER AS rank,
            pair.b AS negative_id, near.score AS positive_score, pair.score AS negative_score
        FROM near JOIN pair ON pair.a = near.a AND NOT same AND 50 * near.score <= 100 * pair.score AND 100 * pair.score <= 95 * near.score
        QUALIFY rank <= 3""",
}
