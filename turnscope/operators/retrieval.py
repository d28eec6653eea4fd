"""Search over text files, code symbols and memories."""

from __future__ import annotations

import ast
import re
import sys
import zlib
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.functions.nested import bind, indexes, part, total

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOL_SCHEMA = "symbol string, file string, line int, type string, seq int"


# --- words on lines -----------------------------------------------------------------------------------


def _query_words(query: str) -> list[str]:
    return sorted(set(re.findall(r"\w+", query.lower())))


def _has_word(low: Column, word: str) -> Column:
    # The plain search rules out most lines before the pattern looks at word borders.
    return F.contains(low, F.lit(word)) & low.rlike(f"(?<!{X.WORD}){word}(?!{X.WORD})")


def _overlap(low: Column, query: str) -> Column:
    return reduce(lambda a, b: a + b, [_has_word(low, w).cast("int") for w in _query_words(query)], F.lit(0))


def word_overlap(line: Column, query: str) -> Column:
    """How many distinct words of the query stand on a line."""
    return bind(F.lower(line), lambda low: _overlap(low, query))


def file_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per line: ``path``, ``line_no`` from 1, ``text``."""
    return files.select(F.col(path).alias("path"), F.posexplode(X.lines(F.col(content))).alias("line_no", "text")).withColumn(
        "line_no", F.col("line_no") + 1
    )


def first_matches(files: DataFrame, query: str, count: int = 3, path: str = "path", content: str = "content") -> DataFrame:
    """The first ``count`` matching lines of every file, as rows."""
    hits = file_lines(files, path, content).filter(word_overlap(F.col("text"), query) > 0)
    order = Window.partitionBy("path").orderBy("line_no")
    return hits.withColumn("match_no", F.row_number().over(order)).filter(F.col("match_no") <= count)


def score_files(files: DataFrame, query: str, matches: int = 3, path: str = "path", content: str = "content") -> DataFrame:
    """Files with any query word: ``score`` and the first matching lines (``line_no``, ``content``).

    A file is one row, so its lines are scored inside the row and nothing is shuffled.
    """
    words = _query_words(query)
    if not words:
        return files.limit(0).select(
            F.col(path).alias("path"),
            F.lit(0).cast("bigint").alias("score"),
            F.lit(None).cast("array<struct<line_no:int,content:string>>").alias("matches"),
        )
    possible = reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(content)), F.lit(w)) for w in words])

    def scored(rows: Column) -> Column:
        return F.struct(
            total(F.transform(rows, lambda r: r["hits"])).alias("score"),
            F.transform(
                F.slice(F.filter(rows, lambda r: r["hits"] > 0), 1, matches),
                lambda r: F.struct(r["line_no"].alias("line_no"), X.strip(r["text"]).alias("content")),
            ).alias("matches"),
        )

    rows = F.transform(
        X.lines(F.col(content)),
        lambda line, i: F.struct(
            (i + 1).alias("line_no"), line.alias("text"), word_overlap(line, query).alias("hits")
        ),
    )
    found = files.filter(possible)
    return (
        found.select(F.col(path).alias("path"), bind(rows, scored).alias("_s"))
        .select("path", "_s.score", "_s.matches")
        .filter("score > 0")
    )


def keyword_search(
    files: DataFrame, query: str, top_k: int = 5, matches: int = 3, path: str = "path", content: str = "content"
) -> DataFrame:
    """The best files for a query, equal scores in path order."""
    return score_files(files, query, matches, path, content).orderBy(F.desc("score"), "path").limit(top_k)


# --- inverted index -----------------------------------------------------------------------------------

# Folders of the postings, by hash of the word, and tasks that share the postings of a folder.
INDEX_PARTS, INDEX_SPREAD = 256, 16


def _word_part(word: str, parts: int) -> int:
    return zlib.crc32(word.encode()) % parts


def write_index(
    files: DataFrame, folder: str, path: str = "path", content: str = "content", parts: int = INDEX_PARTS, spread: int = INDEX_SPREAD
) -> None:
    """Write the postings of all files, a row for each word and file with the word's line numbers, and the files' lines.

    A file is one row, so its postings are made inside the row. They lie in ``parts`` folders by hash of the word; a word that
    stands in every file is dealt to ``spread`` tasks by file. Files are in order of path, so that the lines of a few are
    read by their row groups.
    """
    named = files.select(F.col(path).alias("path"), X.lines(F.col(content)).alias("lines")).where(F.size("lines") > 0)
    postings = named.select("path", F.explode(_file_postings(F.col("lines"))).alias("p")).select("p.word", "path", "p.lines")
    postings = postings.withColumn("part", F.crc32(F.col("word").cast("binary")) % parts)
    dealt = postings.repartition("part", F.pmod(F.xxhash64("path"), F.lit(spread))).sortWithinPartitions("part", "word")
    # Written once and read in small parts, so a denser codec pays.
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(f"{folder}/postings")
    ordered = named.repartitionByRange("path").sortWithinPartitions("path")
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/lines")


def _file_postings(rows: Column) -> Column:
    """The words of one file's lines, each with the numbers of its lines in order."""

    def places(line: Column, i: Column) -> Column:
        return F.transform(X.words(line), lambda w: F.struct(w.alias("word"), (i + 1).alias("line")))

    def cut(found: Column) -> Column:
        starts = F.filter(
            indexes(found), lambda i: (i == 0) | (F.get(found, i)["word"] != F.get(found, i - 1)["word"])
        )

        def posting(at: Column, start: Column, k: Column) -> Column:
            own = part(found, start, F.coalesce(F.get(at, k + 1), F.size(found)))
            return F.struct(F.get(found, start)["word"].alias("word"), F.transform(own, lambda x: x["line"]).alias("lines"))

        return bind(starts, lambda at: F.transform(at, lambda start, k: posting(at, start, k)))

    return bind(F.array_sort(F.flatten(F.transform(rows, places))), cut)


def _postings(spark: SparkSession, folder: str, words: list[str], parts: int) -> DataFrame:
    """Postings of some words; only their folders are read, and only the row groups that can hold them."""
    schema = "word string, path string, lines array<int>, part int"
    rows = spark.read.schema(schema).parquet(f"{folder}/postings")
    return rows.where(F.col("part").isin([_word_part(w, parts) for w in words]) & F.col("word").isin(words))


def indexed_search(
    spark: SparkSession, folder: str, query: str, top_k: int = 5, matches: int = 3, parts: int = INDEX_PARTS
) -> DataFrame:
    """``keyword_search`` by an index from ``write_index``: the same rows, from the query's postings and ``top_k`` files' lines."""
    words = _query_words(query)
    none = F.lit(None).cast("array<struct<line_no:int,content:string>>")
    nothing = spark.range(0).select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("score"), none.alias("matches"))
    if not words:
        return nothing
    found = _postings(spark, folder, words, parts).groupBy("path").agg(
        F.sum(F.size("lines").cast("bigint")).alias("score"), F.flatten(F.collect_list("lines")).alias("lines")
    )
    best = found.orderBy(F.desc("score"), "path").limit(top_k)
    first = F.slice(F.array_sort(F.array_distinct("lines")), 1, matches)
    # At most ``top_k`` rows with a few numbers each.
    top = best.select("path", "score", first.alias("line_no")).collect()
    if not top:
        return nothing
    wanted = spark.createDataFrame(top, best.select("path", "score", first.alias("line_no")).schema)
    lines = spark.read.schema("path string, lines array<string>").parquet(f"{folder}/lines")
    lines = lines.where(F.col("path").isin([r["path"] for r in top]))
    shown = wanted.join(lines, "path").select("path", "score", "lines", F.explode("line_no").alias("line_no"))
    shown = shown.withColumn("text", F.get("lines", F.col("line_no") - 1)).where(F.col("text").isNotNull())
    line = F.struct("line_no", X.strip(F.col("text")).alias("content"))
    return (
        shown.groupBy("path", "score").agg(F.sort_array(F.collect_list(line)).alias("matches"))
        .orderBy(F.desc("score"), "path")
    )


# --- symbols ------------------------------------------------------------------------------------------


def symbol_map(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Every function and class definition of the Python files; files that do not parse are skipped."""

    def extract(batches):
        for batch in batches:
            rows = []
            for file, source in zip(batch["path"], batch["content"]):
                try:
                    tree = ast.parse(source)
                except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError):
                    continue
                kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
                defined = [n for n in ast.walk(tree) if type(n) in kinds]
                rows += [(n.name, file, n.lineno, kinds[type(n)], i) for i, n in enumerate(defined)]
            yield pd.DataFrame(rows, columns=["symbol", "file", "line", "type", "seq"])

    sources = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return sources.filter(F.col("path").endswith(".py")).mapInPandas(extract, SYMBOL_SCHEMA)


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("symbol") == name)


def symbol_overview(symbols: DataFrame, count: int = 20, places: int = 2) -> DataFrame:
    """The first symbols of the alphabet, with the type of the first place and the first places."""
    first = symbols.select("symbol").distinct().orderBy("symbol").limit(count)
    order = Window.partitionBy("symbol").orderBy("file", "seq")
    ranked = (
        symbols.join(F.broadcast(first), "symbol", "left_semi")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= places)
    )
    return ranked.groupBy("symbol").agg(
        F.min_by("type", "_rank").alias("type"),
        F.expr("listagg(concat('`', file, ':', line, '`'), ', ') within group (order by _rank)").alias("places"),
    )


def context_bootstrap(
    symbols: DataFrame, files: DataFrame, query: str | None = None, path: str = "path", content: str = "content"
) -> DataFrame:
    """The symbol overview and the best snippets as one text (a report of fixed length)."""
    head = "### Codebase Symbol Map & Overview\n\n**Indexed Symbols:**"
    rows = symbol_overview(symbols).select(
        F.lit(0).alias("part"),
        F.lit(0).cast("bigint").alias("rank"),
        F.col("symbol").alias("name"),
        F.concat(F.lit("- `"), "symbol", F.lit("` ("), "type", F.lit("): "), "places").alias("line"),
    )
    if query:
        head_line = F.concat(F.lit("File: `"), "path", F.lit("` (score: "), "score", F.lit(")"))
        match = lambda m: F.concat(F.lit("\n  L"), m["line_no"], F.lit(": "), m["content"])
        best = keyword_search(files, query, 3, 3, path, content).select(
            F.lit(1).alias("part"),
            (-F.col("score")).alias("rank"),
            F.col("path").cast("string").alias("name"),
            F.concat(head_line, F.array_join(F.transform("matches", match), "")).alias("line"),
        )
        rows = rows.unionByName(best)
    body = lambda p: F.expr(
        f"coalesce(listagg(line, '\n') within group (order by rank, name) filter (where part = {p}), '')"
    )
    joined = rows.agg(body(0).alias("symbols"), body(1).alias("snippets"))
    newline = lambda c: F.when(F.col(c) != "", F.concat(F.lit("\n"), c)).otherwise("")
    parts = [F.lit(head), newline("symbols")]
    if query:
        parts += [F.lit("\n\n**Query Relevant Snippets:**"), newline("snippets")]
    return joined.select(F.concat(*parts).alias("context"))


# --- memories -----------------------------------------------------------------------------------------


def memory_filter(memories: DataFrame, topic: str | None = None, category: str | None = None) -> DataFrame:
    """Topic contains a text (letter case ignored), category is equal; both optional."""
    if topic:
        escaped = topic.replace("\\", "\\\\")
        memories = memories.filter(F.col("topic").ilike(f"%{escaped}%"))
    return memories.filter(F.col("category") == category) if category else memories


def recent_memories(
    memories: DataFrame, topic: str | None = None, category: str | None = None, limit: int = 10
) -> DataFrame:
    """The newest memories that pass the filter."""
    return memory_filter(memories, topic, category).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def memory_context(memories: DataFrame, title: str, topic: str | None = None, limit: int = 5) -> DataFrame:
    """The newest memories as one prompt section; '' when there are none."""
    line = F.concat(F.lit("- **["), F.upper("category"), F.lit("] ("), "topic", F.lit(")**: "), "content")
    picked = recent_memories(memories, topic, None, limit).withColumn("line", line)
    text = F.expr("listagg(line, '\n') within group (order by created_at desc, id desc)")
    return picked.agg(text.alias("body")).select(
        F.when(F.col("body").isNull(), F.lit("")).otherwise(F.concat(F.lit(f"### {title}\n\n"), "body")).alias("context")
    )
