"""Queries that search, check and report: retrieval, findings, durations, documented formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscope.functions import text as X
from turnscope.operators import gates as G
from turnscope.operators import retrieval as RT
from turnscope.operators import rollups
from turnscope.operators.medians import exact_medians
from turnscope.plans import documented as D
from turnscope.plans.record_queries import SECRETS_SQL, _fake
from turnscope.plans.registry import query, table
from turnscope.plans.views import FILES_SQL, files
from turnscope.session import work_dir
from turnscope.sources import files as readers
from turnscope.sources.files import is_indexed, parse_junit, parse_timing_records

# --- search -------------------------------------------------------------------------------------------

QUERY = "The license, of die LE"
WORDS = ("die", "le", "license", "of", "the")
HITS_SQL = " + ".join(
    f"case when list_contains(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+'), '{w}') then 1 else 0 end" for w in WORDS
)
SCORES_SQL = f"""{FILES_SQL},
hits as (select path, line_no, line, {HITS_SQL} as hits from file_lines),
scores as (select path, cast(sum(hits) as bigint) as score from hits group by path having sum(hits) > 0),
firsts as (select path, line_no, line from hits where hits > 0 qualify row_number() over (partition by path order by line_no) <= 3),
shown as (select path, string_agg('L' || line_no || ': ' || trim(line, ' ' || chr(9)), chr(10) order by line_no) as matches from firsts group by path)"""


def _shown(rows):
    line = lambda m: F.concat(F.lit("L"), m["line_no"], F.lit(": "), m["content"])
    return rows.select("path", "score", F.array_join(F.transform("matches", line), "\n").alias("matches"))


@query(
    "keyword_search",
    f"with {SCORES_SQL} select path, score, matches from scores join shown using (path) order by score desc, path limit 5",
)
def keyword_search(spark, folder):
    return _shown(RT.keyword_search(files(spark, folder), QUERY))


@query(
    "indexed_search",
    f"with {SCORES_SQL} select path, score, matches from scores join shown using (path) order by score desc, path limit 5",
)
def indexed_search(spark, folder):
    """The search by an inverted index that is written over all files first."""
    path = work_dir(spark, "index")
    RT.write_index(files(spark, folder), path)
    return _shown(RT.indexed_search(spark, path, QUERY))


@query("keyword_scores", f"with {SCORES_SQL} select path, score, matches from scores join shown using (path)")
def keyword_scores(spark, folder):
    return _shown(RT.score_files(files(spark, folder), QUERY))


@query(
    "word_overlap",
    f"with {SCORES_SQL} select hits, count(*) as lines from hits group by hits",
)
def word_overlap(spark, folder):
    lines = RT.file_lines(files(spark, folder))
    return lines.groupBy(RT.word_overlap(F.col("text"), QUERY).alias("hits")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "first_3_matches",
    f"""with {SCORES_SQL} select path, line_no, row_number() over (partition by path order by line_no) as match_no from firsts""",
)
def first_3_matches(spark, folder):
    return RT.first_matches(files(spark, folder), QUERY).select("path", "line_no", "match_no")


@query(
    "scan_text_files",
    f"""with {FILES_SQL}, named as (select path, case when doc_id % 5 = 0 then 'build/' when doc_id % 5 = 1 then 'src/rebuild/' else '' end || path as full_path,
      case doc_id % 3 when 0 then '.md' when 1 then '.txt' else '.py' end as suffix from files join documents on path = source || '/' || lpad(cast(doc_id as varchar), 9, '0') || '.md')
    select full_path || suffix as path from named where full_path not like 'build/%' and suffix <> '.txt'""",
)
def scan_text_files(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    i = F.col("doc_id")
    folder_name = F.when(i % 5 == 0, "build/").when(i % 5 == 1, "src/rebuild/").otherwise("")
    suffix = F.when(i % 3 == 0, ".md").when(i % 3 == 1, ".txt").otherwise(".py")
    path = F.concat(folder_name, "source", F.lit("/"), F.format_string("%09d", "doc_id"), F.lit(".md"), suffix)
    return d.select(path.alias("path")).filter(is_indexed(F.col("path")))


@query(
    "read_text_files",
    """select 'src/' || case when doc_id // 64 % 5 = 1 then 'rebuild/' else '' end || 'batch=' || doc_id // 64 || '/' as folder,
      string_agg(to_json({'doc_id': doc_id, 'text': text}), chr(10) order by doc_id, text) || chr(10) as content
    from documents where doc_id // 64 % 5 <> 0 group by doc_id // 64""",
)
def read_text_files(spark, folder):
    """All documents in files of 64, written and read back; those below ``build`` and the text files are not indexed."""
    root = work_dir(spark, "texts")
    d = table(spark, folder, "documents").select("doc_id", "text", F.expr("doc_id div 64").alias("batch"))
    kind = F.col("batch") % 5
    parts = {"build": kind == 0, "src/rebuild": kind == 1, "src": kind > 1}
    for where, chosen in parts.items():
        _by_batch(d.filter(chosen), "doc_id", "text").option("ignoreNullFields", False).json(f"{root}/{where}")
    _by_batch(d.select("text", "batch"), "text").text(f"{root}/src/plain")
    found = readers.scan_text_files(spark, root)
    return found.select(F.regexp_replace("path", "part-[^/]*[.]json$", "").alias("folder"), "content")


def _by_batch(rows, *order):
    """A writer of one file for each batch, lines in the given order."""
    return rows.repartition("batch").sortWithinPartitions("batch", *order).write.mode("append").partitionBy("batch")


def _lists(rows, value, number):
    """Records as texts of JSON arrays, 256 numbers to one."""
    batch = F.expr(f"{number} div 256").alias("batch")
    return rows.groupBy(batch).agg(F.concat(F.lit("["), F.listagg(value, F.lit(", ")), F.lit("]")).alias("value"))


def sources(spark, folder):
    """Every part as a small Python file; some of them do not parse."""
    p = table(spark, folder, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    key = F.col("p_partkey")
    text = F.concat(
        F.lit("import os\n\nclass C_"), name, F.lit(":\n    def size(self):\n        return "), F.col("p_size"),
        F.lit("\n\nasync def load_"), F.col("p_type"), F.lit("():\n    pass\n"),
        F.when(key % 10 == 0, "def broken(:\n").otherwise(""),
    )
    path = F.concat(F.lit("pkg/"), F.format_string("%09d", "p_partkey"), F.when(key % 7 == 0, ".md").otherwise(".py"))
    return p.select(path.alias("path"), text.alias("content"))


SYMBOLS_SQL = """
src as (
  select 'pkg/' || lpad(cast(p_partkey as varchar), 9, '0') || '.py' as file, replace(p_name, ' ', '_') as name, p_type
  from part where p_partkey % 10 <> 0 and p_partkey % 7 <> 0),
symbols as (
  select 'C_' || name as symbol, file, 3 as line, 'class' as type, 0 as seq from src
  union all select 'load_' || p_type, file, 7, 'function', 1 from src
  union all select 'size', file, 4, 'function', 2 from src)"""


@query("symbol_map", f"with {SYMBOLS_SQL} select symbol, file, line, type from symbols")
def symbol_map(spark, folder):
    return RT.symbol_map(sources(spark, folder)).drop("seq")


@query(
    "find_symbol",
    f"with {SYMBOLS_SQL} select symbol, file, line, type from symbols where symbol = 'size'",
)
def find_symbol(spark, folder):
    return RT.find_symbol(RT.symbol_map(sources(spark, folder)), "size").drop("seq")


OVERVIEW_SQL = f"""{SYMBOLS_SQL},
first as (select distinct symbol from symbols order by symbol limit 20),
ranked as (select *, row_number() over (partition by symbol order by file, seq) as r from symbols where symbol in (select symbol from first)),
overview as (select symbol, arg_min(type, r) as type, string_agg('`' || file || ':' || line || '`', ', ' order by r) filter (where r <= 2) as places
  from ranked group by symbol)"""


@query("symbol_overview", f"with {OVERVIEW_SQL} select * from overview")
def symbol_overview(spark, folder):
    return RT.symbol_overview(RT.symbol_map(sources(spark, folder)))


@query(
    "context_bootstrap",
    f"""with {OVERVIEW_SQL}, {SCORES_SQL},
    best as (select path, score, matches from scores join shown using (path) order by score desc, path limit 3),
    a as (select string_agg('- `' || symbol || '` (' || type || '): ' || places, chr(10) order by symbol) as body from overview),
    b as (select string_agg('File: `' || path || '` (score: ' || score || ')' || chr(10) || '  ' || replace(matches, chr(10), chr(10) || '  '), chr(10)
      order by score desc, path) as body from best)
    select '### Codebase Symbol Map & Overview' || chr(10) || chr(10) || '**Indexed Symbols:**' || chr(10) || a.body || chr(10) || chr(10) ||
      '**Query Relevant Snippets:**' || chr(10) || b.body as context from a, b""",
)
def context_bootstrap(spark, folder):
    return RT.context_bootstrap(RT.symbol_map(sources(spark, folder)), files(spark, folder), QUERY)


# --- credentials and paths ----------------------------------------------------------------------------


def leaking_files(spark, folder):
    """Documents with a fake credential after their first line; some lines are exempt."""
    d = table(spark, folder, "documents", spread=True)
    i = F.col("doc_id")
    extra = F.concat(F.lit("first\nkey "), _fake(i), F.when(i % 5 == 0, " pr-allow-secret").otherwise(""), F.lit("\n"))
    return d.select(
        F.concat(F.when(i % 4 == 0, "docs/").when(i % 4 == 1, "tmp/").otherwise("src/"), i, F.when(i % 6 == 0, ".log").otherwise(".py")).alias("path"),
        F.concat(extra, "text").alias("content"),
    )


NAMES = ("Anthropic API Key", "OpenAI API Key", "Google AI API Key", "GitHub PAT (classic)", "GitHub PAT (fine-grained)")
LEAKS_SQL = f"""
leaks as (
  select doc_id, {SECRETS_SQL} as secret,
    case when doc_id % 4 = 0 then 'docs/' when doc_id % 4 = 1 then 'tmp/' else 'src/' end || doc_id || case when doc_id % 6 = 0 then '.log' else '.py' end as file,
    case doc_id % 9 {" ".join(f"when {k} then '{n}'" for k, n in enumerate(NAMES))} end as pattern from documents),
found as (select file, 2 as line, pattern, left(secret, 4) || '...' || right(secret, 4) as masked from leaks where pattern is not null and doc_id % 5 <> 0)"""


@query("secret_findings", f"with {LEAKS_SQL} select * from found")
def secret_findings(spark, folder):
    return G.secret_findings(leaking_files(spark, folder))


@query(
    "path_policy",
    """select doc_id, doc_id % 4 = 1 or doc_id % 6 = 0 as disallowed, doc_id % 4 = 0 as exempt,
    doc_id % 4 <> 0 and not (doc_id % 7 = 0 and doc_id % 6 <> 0) as scanned from documents""",
)
def path_policy(spark, folder):
    i = F.col("doc_id")
    path = F.concat(
        F.when(i % 4 == 0, "./docs/").when(i % 4 == 1, "a/tmp/").otherwise("src/"),
        i,
        F.when(i % 6 == 0, ".log").when(i % 7 == 0, ".png").otherwise(".py"),
    )
    p = F.col("p")
    return (
        table(spark, folder, "documents", spread=True)
        .select("doc_id", path.alias("p"))
        .select(
            "doc_id",
            X.is_disallowed_path(p).alias("disallowed"),
            X.is_scan_exempt(p).alias("exempt"),
            X.is_scanned(p).alias("scanned"),
        )
    )


@query(
    "scan_report",
    f"""with {LEAKS_SQL} select 'Disallowed ephemeral scratch path staged: ' || file as message from leaks where file like 'tmp/%' or file like '%.log'
    union all select 'Potential secret credential detected in ' || file || ':' || line || ' [' || pattern || ']: ' || masked from found where file not like 'docs/%'""",
)
def scan_report(spark, folder):
    return G.scan_report(leaking_files(spark, folder))


# --- durations ----------------------------------------------------------------------------------------


def timing_lines(spark, folder):
    """Events as timing records; some of them are not valid."""
    e = table(spark, folder, "events", spread=True)
    i, v = F.col("event_id"), F.col("value")
    text = F.concat(
        F.lit('{"workflow":"w","job":"'), "event_type", F.lit('","os":"linux","duration_s":'),
        F.when(i % 10 == 7, '"fast"').otherwise(v.cast("string")),
        F.lit(',"finished_at":'), i, F.lit(',"tests":{"a::one":'), v / 2, F.lit(',"b::two":'), v / 4,
        F.lit(',"c::'), i % 40, F.lit('":'), v, F.lit('},"extra":1,"schema":'), F.when(i % 10 == 3, 2).otherwise(1), F.lit("}"),
    )
    return e.select("event_id", text.alias("value"))


TIMING_SQL = """
records as (
  select event_id, event_type as job, value as duration_s, event_id as finished_at, event_id % 40 as c from events
  where event_id % 10 not in (3, 7) and value > 0),
newest as (select *, row_number() over (partition by job order by finished_at desc) as recency from records),
medians as (select job, median(duration_s) as median_s, count(*) as baseline_records from newest where recency <= 5 group by job)"""


def _records(spark, folder):
    return parse_timing_records(timing_lines(spark, folder), "value", "event_id")


@query(
    "scan_timing_records",
    f"with {TIMING_SQL} select event_id, job, duration_s, duration_s / 2 as first_test from records",
)
def scan_timing_records(spark, folder):
    r = _records(spark, folder)
    return r.select("event_id", "job", "duration_s", F.col("tests")["a::one"].alias("first_test"))


@query(
    "read_timing_files",
    f"with {TIMING_SQL} select event_id, job, duration_s, duration_s / 2 as first_test from records",
)
def read_timing_files(spark, folder):
    """The records written as files that hold lists, and read back."""
    root = work_dir(spark, "timings")
    _by_batch(_lists(timing_lines(spark, folder), "value", "event_id"), "value").text(root)
    r = readers.scan_timing_records(spark, root)
    return r.select(
        F.col("finished_at").cast("bigint").alias("event_id"), "job", "duration_s", F.col("tests")["a::one"].alias("first_test")
    )


@query(
    "recent_n_baseline",
    f"with {TIMING_SQL} select job, event_id, cast(recency as integer) as recency from newest where recency <= 5",
)
def recent_n_baseline(spark, folder):
    return G.newest_records(_records(spark, folder), ["job", "os"], "finished_at", 5).select("job", "event_id", "recency")


@query(
    "exact_medians",
    """with m as (select event_type as kind, user_id % 3 = 0 as third, value from events union all
        select 'all', null, round(value) from events)
    select kind, third, median(value) as median, count(*) as "values" from m where value is not null group by all""",
)
def exact_medians_query(spark, folder):
    """Groups of very unlike sizes, with so few values held that the larger ones are cut into ranges again and again."""
    e = table(spark, folder, "events")
    rows = e.select(F.col("event_type").alias("kind"), (F.col("user_id") % 3 == 0).alias("third"), "value").unionByName(
        e.select(F.lit("all").alias("kind"), F.lit(None).cast("boolean").alias("third"), F.round("value").alias("value"))
    )
    return exact_medians(rows, ["kind", "third"], "value", bins=8, held=64)


@query("rolling_median", f"with {TIMING_SQL} select * from medians")
def rolling_median(spark, folder):
    return G.rolling_median(_records(spark, folder), ["job", "os"], "finished_at", 5).drop("os")


@query(
    "timing_gate",
    f"""with {TIMING_SQL}, judged as (
      select r.event_id, r.duration_s, r.duration_s - median_s as delta_s, r.duration_s > 300 as over_ceiling,
        r.duration_s > median_s * 1.5 and r.duration_s - median_s > 30 as slow, r.event_id % 2 = 0 as accepted from records r join medians using (job))
    select event_id, round_even(delta_s, 6) as delta_s, over_ceiling,
      case when over_ceiling then 'fail' when slow and not accepted then 'fail' when slow then 'warn' else 'pass' end as status from judged""",
)
def timing_gate(spark, folder):
    r = _records(spark, folder)
    baseline = G.rolling_median(r, ["job", "os"], "finished_at", 5)
    judged = G.timing_gate(r, baseline, ["job", "os"], accepted=F.col("event_id") % 2 == 0)
    return judged.select("event_id", F.bround("delta_s", 6).alias("delta_s"), "over_ceiling", "status")


@query(
    "timing_gate_short_baseline",
    f"""with {TIMING_SQL} select event_id, cast(null as double) as median_s, true as relative_skipped,
    case when duration_s > 100 then 'fail' else 'pass' end as status from records""",
)
def timing_gate_short_baseline(spark, folder):
    r = _records(spark, folder)
    baseline = G.rolling_median(r, ["job", "os"], "finished_at", 5)
    judged = G.timing_gate(r, baseline, ["job", "os"], count=6, ceiling=100.0)
    return judged.select("event_id", "median_s", "relative_skipped", "status")


@query(
    "ceiling_gate",
    f"with {TIMING_SQL} select job, case when duration_s > 300 then 'fail' else 'pass' end as status, count(*) as records from records group by all",
)
def ceiling_gate(spark, folder):
    return G.ceiling_gate(_records(spark, folder)).groupBy("job", "status").agg(F.count(F.lit(1)).alias("records"))


TESTS_SQL = f"""{TIMING_SQL},
base as (select * from newest where recency <= 8),
base_tests as (select 'a::one' as test, duration_s / 2 as seconds from base union all select 'b::two', duration_s / 4 from base
  union all select 'c::' || c, duration_s from base),
test_medians as (select test, median(seconds) as median_s from base_tests group by test),
now as (select 'c::' || (o_orderkey % 40) as test, cast(sum(o_totalprice) as double) / 1e6 as seconds from orders group by all
  union all select 'a::one', 9000.0 union all select 'd::' || r_regionkey, 1.0 from region)"""


def _tests(spark, folder):
    newest = G.newest_records(_records(spark, folder), ["job", "os"], "finished_at", 8)
    o = table(spark, folder, "orders")
    current = (
        o.groupBy(F.concat(F.lit("c::"), F.col("o_orderkey") % 40).alias("test"))
        .agg((F.sum("o_totalprice") / 1e6).alias("seconds"))
        .unionByName(table(spark, folder, "region").select(F.concat(F.lit("d::"), "r_regionkey").alias("test"), F.lit(1.0).alias("seconds")))
        .unionByName(o.agg(F.min(F.lit("a::one")).alias("test"), F.min(F.lit(9000.0)).alias("seconds")))
    )
    return current, G.test_medians(newest)


@query(
    "timing_baseline",
    f"with {TESTS_SQL} select test, round_even(seconds, 4) as seconds, round_even(median_s, 6) as median_s from now left join test_medians using (test)",
)
def timing_baseline(spark, folder):
    current, medians = _tests(spark, folder)
    return G.compare_tests(current, medians).select(
        "test", F.bround("seconds", 4).alias("seconds"), F.bround("median_s", 6).alias("median_s")
    )


@query(
    "test_offenders",
    f"""with {TESTS_SQL} select test, round_even(seconds - median_s, 4) as delta_s from now join test_medians using (test)
    where seconds > median_s * 1.5 and seconds - median_s > 5 order by seconds - median_s desc, test limit 10""",
)
def test_offenders(spark, folder):
    return G.test_offenders(*_tests(spark, folder)).select("test", F.bround("delta_s", 4).alias("delta_s"))


@query(
    "new_tests",
    f"with {TESTS_SQL} select count(*) as new_tests from now where test not in (select test from test_medians)",
)
def new_tests(spark, folder):
    return G.new_tests(*_tests(spark, folder))


@query(
    "newest_artifacts",
    """with m as (select event_id, event_type as job, row_number() over (partition by event_type order by event_id desc) as recency from events
      where event_id % 6 <> 0 and user_id % 2 = 0 and event_id % 5 <> 4)
    select job, event_id, cast(recency as integer) as recency from m where recency <= 3""",
)
def newest_artifacts(spark, folder):
    i = F.col("event_id")
    a = table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("job"),
        F.when(i % 6 == 0, True).when(i % 6 == 1, False).alias("expired"),
        F.when(F.col("user_id") % 2 == 0, "main").otherwise("topic").alias("head_branch"),
        F.lit(7).alias("repository_id"),
        F.when(i % 5 == 4, 8).otherwise(7).alias("head_repository_id"),
    )
    return G.newest_records(G.main_artifacts(a), ["job"], "event_id", 3).select("job", "event_id", "recency")


def junit_reports(spark, folder):
    e = table(spark, folder, "events", spread=True)
    i = F.col("event_id")
    xml = F.concat(
        F.lit('<testsuite name="s"><testcase classname="'), "event_type", F.lit('" name="t'), i % 20, F.lit('" time="'), i % 90,
        F.lit('.5"/>'), F.when(i % 3 == 0, "<testsuite>").otherwise(""), F.lit('<testcase classname="'), "event_type",
        F.lit('" name="bare"/>'), F.when(i % 3 == 0, "</testsuite>").otherwise(""), F.lit("</testsuite>"),
    )
    # Every third report has a root of suites and a suite in a suite, as a bare suite is only one of the usual forms.
    xml = F.when(i % 3 == 0, F.concat(F.lit("<testsuites>"), xml, F.lit("</testsuites>"))).otherwise(xml)
    return e.select("event_id", xml.alias("xml"))


@query(
    "scan_junit",
    """select event_id, event_type as classname, 't' || event_id % 20 as name, event_id % 90 || '.5' as time from events
    union all select event_id, event_type, 'bare', null from events""",
)
def scan_junit(spark, folder):
    return parse_junit(junit_reports(spark, folder), "xml", "event_id")


@query(
    "read_junit_files",
    """select event_type as classname, 't' || event_id % 20 as name, event_id % 90 || '.5' as time from events
    union all select event_type, 'bare', null from events""",
)
def read_junit_files(spark, folder):
    """The reports written to files, the suites of some to each, and read back."""
    root = work_dir(spark, "reports")
    suites = junit_reports(spark, folder).groupBy(F.expr("event_id div 256").alias("batch")).agg(F.listagg("xml").alias("xml"))
    report = F.concat(F.lit("<testsuites>"), "xml", F.lit("</testsuites>"))
    _by_batch(suites.select(report.alias("value"), "batch"), "value").text(root)
    return readers.scan_junit(spark, root)


@query(
    "test_time_totals",
    """select event_type || '::t' || event_id % 20 as test, sum(event_id % 90 + 0.5)::double as seconds from events group by all
    union all select distinct event_type || '::bare', 0.0::double from events""",
)
def test_time_totals(spark, folder):
    return G.test_time_totals(parse_junit(junit_reports(spark, folder), "xml"))


# --- subtasks -----------------------------------------------------------------------------------------


def subtasks(spark, folder):
    d = table(spark, folder, "documents", spread=True)
    return d.select(
        F.col("lang").alias("run_id"),
        F.col("doc_id").alias("position"),
        F.col("doc_id").alias("task_id"),
        (F.col("doc_id") % 3 != 0).alias("success"),
        F.col("text").alias("output"),
    )


SUBTASKS_SQL = """
l0 as (select doc_id, lang, text, string_split(text, chr(10)) as ls from documents),
l1 as (select *, case when text = '' then [] when ls[-1] = '' then ls[:-2] else ls end as rows from l0),
summaries as (
  select doc_id, lang, doc_id % 3 <> 0 as success, case when len(rows) <= 5 then trim(text, ' ' || chr(10) || chr(9))
    else '[Subtask ' || doc_id || case when doc_id % 3 <> 0 then ' SUCCESS' else ' FAILURE' end || ' | Total lines: ' || len(rows) || ']' || chr(10) ||
      'Start: ' || array_to_string(rows[1:3], chr(10)) || chr(10) || '...' || chr(10) || 'End: ' || array_to_string(rows[-3:], chr(10)) end as summary
  from l1)"""


@query("summarize_output", f"with {SUBTASKS_SQL} select doc_id as task_id, summary from summaries")
def summarize_output(spark, folder):
    return rollups.subtask_summaries(subtasks(spark, folder)).select("task_id", "summary")


@query(
    "subtask_report",
    f"""with {SUBTASKS_SQL} select lang as run_id, doc_id as position, '#### ' || case when success then '✅' else '❌' end || ' Subtask `' || doc_id || '`' as heading,
    summary from summaries""",
)
def subtask_report(spark, folder):
    return rollups.subtask_report(subtasks(spark, folder))


@query(
    "subtask_rollup",
    """select lang as run_id, count(*) as subtasks, count(*) filter (where doc_id % 3 <> 0) as succeeded,
    count(*) filter (where doc_id % 3 = 0) as failed from documents group by lang""",
)
def subtask_rollup(spark, folder):
    return rollups.subtask_counts(subtasks(spark, folder))


# --- documented formulas ------------------------------------------------------------------------------


@query(
    "cleaning_ratio",
    """select doc_id, round_even(case when n_chars = 0 then 0.0 else (n_chars - n_chars // 3) * 100.0 / n_chars end, 6) as ratio from documents""",
)
def cleaning_ratio(spark, folder):
    n = F.col("n_chars")
    return table(spark, folder, "documents", spread=True).select("doc_id", F.bround(D.cleaning_ratio(n, F.floor(n / 3)), 6).alias("ratio"))


@query(
    "tokens_avoided",
    """select user_id % 10 as session, cast(coalesce(sum(event_id % 100 + user_id) filter (where event_type = 'view'), 0) as bigint) as avoided from events group by 1""",
)
def tokens_avoided(spark, folder):
    e = table(spark, folder, "events")
    return e.groupBy((F.col("user_id") % 10).alias("session")).agg(
        D.tokens_avoided(F.col("event_type") == "view", F.col("event_id") % 100, F.col("user_id")).alias("avoided")
    )


@query(
    "prompt_cache_savings",
    """select event_id, cast(round(cast(event_id * 2.70 - user_id * 0.75 as decimal(18, 2)), 0) as double) / 1000000 as saved from events""",
)
def prompt_cache_savings(spark, folder):
    money = D.prompt_cache_savings(F.col("event_id"), F.col("user_id"), F.lit("3.00"), F.lit("0.30"), F.lit("3.75"))
    return table(spark, folder, "events").select("event_id", money.cast("double").alias("saved"))


@query(
    "trajectory_savings",
    """with s as (select conv_id, cast(sum(length(text)) as bigint) as before, cast(sum(length(text) // 2) as bigint) as after,
      max(length(text)) filter (where turn = 0) as b0, max(length(text) // 2) filter (where turn = 0) as a0 from conversations group by conv_id)
    select conv_id, round_even((b0 - a0) * 100.0 / b0, 6) as turn0_reduction, round_even((before - after) * 100.0 / before, 6) as net_savings from s""",
)
def trajectory_savings(spark, folder):
    n = F.length("text").cast("bigint")
    half = F.floor(n / 2)
    first = F.col("turn") == 0
    s = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.sum(n).alias("b"), F.sum(half).alias("a"), F.max(F.when(first, n)).alias("b0"), F.max(F.when(first, half)).alias("a0")
    )
    six = lambda x, y: F.bround(D.reduction_ratio(F.col(x), F.col(y)), 6)
    return s.select("conv_id", six("b0", "a0").alias("turn0_reduction"), six("b", "a").alias("net_savings"))


@query(
    "memory_roi",
    """select event_type, round_even(sum(event_id - user_id) / sum(user_id), 6) as roi from events group by event_type""",
)
def memory_roi(spark, folder):
    roi = D.memory_roi(F.col("event_id"), F.col("user_id"), F.col("user_id"))
    return table(spark, folder, "events").groupBy("event_type").agg(F.bround(roi, 6).alias("roi"))


@query(
    "tier_cost",
    """with u as (select case when l_quantity > 25 then 'T1' else 'T2' end as tier, cast(sum(l_partkey) as bigint) as tokens from lineitem group by 1)
    select tier, tokens, round_even(tokens / (select sum(tokens) from u) * 100, 2) as share_pct,
    cast(round(cast(tokens * case tier when 'T1' then 3.0 else 0.25 end as decimal(38, 6)) / 1000000, 4) as double) as cost from u""",
)
def tier_cost(spark, folder):
    usage = table(spark, folder, "lineitem").select(
        F.when(F.col("l_quantity") > 25, "T1").otherwise("T2").alias("tier"), F.col("l_partkey").alias("tokens")
    )
    prices = table(spark, folder, "region").filter("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, "T1").otherwise("T2").alias("tier"),
        F.when(F.col("r_regionkey") == 0, "3.00").otherwise("0.25").alias("price"),
    )
    t = D.tier_costs(usage, prices)
    return t.withColumn("cost", F.round("cost", 4).cast("double"))


@query(
    "compression_ratio",
    """select doc_id, round_even(length(text)::double / nullif(n_chars // 10, 0), 6) as ratio from documents""",
)
def compression_ratio(spark, folder):
    ratio = D.compression_ratio(F.length("text"), F.floor(F.col("n_chars") / 10))
    return table(spark, folder, "documents", spread=True).select("doc_id", F.bround(ratio, 6).alias("ratio"))


@query(
    "run_stats",
    """select user_id, count(*) as runs, round_even(case when count(*) >= 3 then avg(value) end, 6) as mean,
    round_even(case when count(*) >= 3 then stddev_samp(value) end, 6) as stddev from events group by user_id""",
)
def run_stats(spark, folder):
    r = table(spark, folder, "events").groupBy("user_id").agg(*D.run_stats(F.col("value")))
    return r.select("user_id", "runs", F.bround("mean", 6).alias("mean"), F.bround("stddev", 6).alias("stddev"))


@query(
    "context_slope",
    """select conv_id, round_even(regr_slope(length(text), turn), 6) as slope from conversations group by conv_id""",
)
def context_slope(spark, folder):
    slope = D.context_slope(F.length("text"), F.col("turn"))
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.bround(slope, 6).alias("slope"))


@query(
    "wire_overhead",
    """select page_id, length(html) - length(url) as bytes_saved, round_even(length(html)::double / length(url), 6) as compression,
    round_even(length(url) * 100.0 / length(html), 6) as overhead_pct from pages""",
)
def wire_overhead(spark, folder):
    r = table(spark, folder, "pages").select("page_id", *D.overhead(F.length("html"), F.length("url")))
    six = lambda n: F.bround(n, 6).alias(n)
    return r.select("page_id", F.col("bytes_saved").cast("bigint").alias("bytes_saved"), six("compression"), six("overhead_pct"))


@query(
    "expected_value",
    """select o_orderkey, round_even(0.9 * o_totalprice / 1000 + 0.5 * (o_custkey % 7) - 0.3 * (o_orderkey % 5) - 2.5, 6) as ev from orders""",
)
def expected_value(spark, folder):
    ev = D.expected_value(
        F.lit(0.9), F.col("o_totalprice") / 1000, F.col("o_custkey") % 7, F.col("o_orderkey") % 5, F.lit(2.5)
    )
    # Forecast rows come from orders: impact by price, learning and entropy by key.
    return table(spark, folder, "orders").select("o_orderkey", F.bround(ev, 6).alias("ev"))


@query(
    "calibration_error",
    """with f as (select o_orderkey, o_totalprice as predicted from orders), a as (select l_orderkey as o_orderkey, sum(l_extendedprice) as actual from lineitem group by 1)
    select o_orderkey, round_even(abs(predicted - actual), 4) as error,
    case when predicted - actual > 0 then 'overestimated' when predicted - actual < 0 then 'underestimated' else 'calibrated' end as bias
    from f join a using (o_orderkey)""",
)
def calibration_error(spark, folder):
    forecasts = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("predicted"))
    outcomes = (
        table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("actual"))
    )
    r = D.calibration_error(forecasts, outcomes, ["o_orderkey"])
    return r.select("o_orderkey", F.bround("error", 4).alias("error"), "bias")


@query(
    "evidence_score",
    """with s as (select l_suppkey, count(*) filter (where l_returnflag <> 'R') as s, count(*) as n from lineitem group by l_suppkey)
    select l_suppkey, round_even((s + 1) / (n + 2), 6) as posterior_mean,
    round_even((s / n + 3.8416 / (2 * n) - 1.96 * sqrt((s / n * (1 - s / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) as wilson_lower from s""",
)
def evidence_score(spark, folder):
    s = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") != "R").alias("s"), F.count(F.lit(1)).alias("n")
    )
    r = s.select("l_suppkey", *D.evidence_score(F.col("s"), F.col("n")))
    return r.select(
        "l_suppkey", F.bround("posterior_mean", 6).alias("posterior_mean"), F.bround("wilson_lower", 6).alias("wilson_lower")
    )


@query(
    "scan_ledger",
    """select 'P-' || o_orderkey as plan, round_even(0.9 * o_totalprice / 1000 - 2.5, 6) as ev, case when o_orderkey % 4 = 0 then 'note' end as note from orders""",
)
def scan_ledger(spark, folder):
    from turnscope.session import work_dir
    from turnscope.sources.files import scan_ledger as read

    # One forecast per order, written as a ledger of JSON lines and read back; null keys are left out.
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    path = work_dir(spark, "ledger")
    o.select(
        F.concat(F.lit("P-"), key).alias("plan"),
        F.lit(0.9).alias("probability"),
        (F.col("o_totalprice") / 1000).alias("impact"),
        F.lit(2.5).alias("cost"),
        F.when(key % 4 == 0, "note").alias("note"),
    ).write.json(path)
    ledger = read(spark, path)
    ev = D.expected_value(F.col("probability"), F.col("impact"), F.lit(0.0), F.lit(0.0), F.col("cost"))
    return ledger.select("plan", F.bround(ev, 6).alias("ev"), "note")
