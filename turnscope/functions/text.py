"""String, hash and pattern expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnscope import fixed
from turnscope.functions.nested import bind

# Line ends besides LF: the Unicode set, where CR LF is one.
ODD_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Word characters: letters, numbers of every kind, underscore.
WORD = "[\\p{L}\\p{N}_]"


def split_lines(text: Column) -> Column:
    """The pieces between line ends, with an empty last piece after a final one.

    Plain searches find out whether there is any line end but LF; the split itself is then on one
    character, which needs no pattern.
    """

    def cut(t: Column) -> Column:
        odd = reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in ODD_ENDS])
        even = F.translate(F.replace(t, F.lit("\r\n"), F.lit("\n")), ODD_ENDS, "\n" * len(ODD_ENDS))
        return F.split(F.when(odd, even).otherwise(t), "\n")

    return bind(text, cut)


def lines(text: Column) -> Column:
    """The lines of a text; no empty last line after a final line end, none at all for ''."""
    return bind(
        split_lines(text),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    """Trim white space of every kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+", ""), "(?U)[\\s\\x1c-\\x1f]+$", "")


def words(text: Column) -> Column:
    """Distinct lower-case word tokens."""

    def tokens(low: Column) -> Column:
        # The pattern for plain text is several times cheaper, and most text is plain.
        plain = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
        return F.when(is_ascii(low), plain).otherwise(F.regexp_extract_all(low, F.lit(WORD + "+"), F.lit(0)))

    return F.array_distinct(bind(F.lower(text), tokens))


def guarded_replace(text: Column, needles: tuple[str, ...], pattern: str, replacement: str) -> Column:
    """Replace a pattern in texts that contain one of the literals it cannot do without."""

    def step(t: Column) -> Column:
        possible = reduce(lambda a, b: a | b, [F.contains(t, F.lit(n)) for n in needles])
        return F.when(possible, F.regexp_replace(t, pattern, replacement)).otherwise(t)

    return bind(text, step)


def redact_text(text: Column) -> Column:
    """Mask URL secrets, then every credential shape."""
    masked = guarded_replace(text, ("=",), fixed.SECRET_URL_PARAM, "$1[REDACTED]")
    for needles, pattern in zip(fixed.SECRET_TEXT_LITERALS, fixed.SECRET_TEXT, strict=True):
        masked = guarded_replace(masked, needles, "(?U)" + pattern, "[REDACTED_SECRET]")
    return masked


def is_secret_header(name: Column, more: tuple[str, ...] = ()) -> Column:
    """Known names, names of a secret's shape, and ``more``: the lower-case names of a gateway's own key headers."""
    low = F.lower(name)
    return (
        low.isin(*fixed.SECRET_HEADERS, *more)
        | low.rlike(fixed.SECRET_FIELD)
        | F.contains(low, F.lit("token"))
        | F.contains(low, F.lit("secret"))
    )


def redact_headers(headers: Column, more: tuple[str, ...] = ()) -> Column:
    """Lower-case the names, mask secret values; the last of two equal names wins."""
    rows = F.transform(
        F.map_entries(headers),
        lambda e: F.struct(
            F.lower(e["key"]).alias("key"),
            F.when(is_secret_header(e["key"], more), F.lit("[REDACTED]")).otherwise(redact_text(e["value"])).alias("value"),
        ),
    )

    def last(rows: Column, names: Column) -> Column:
        return F.filter(rows, lambda r, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), r["key"]))

    # Bound, since a column that stands inside a lambda is made again for each element.
    return bind(rows, lambda r: bind(F.transform(r, lambda e: e["key"]), lambda names: F.map_from_entries(last(r, names))))


def mask_transients(text: Column) -> Column:
    """Replace timestamps, UUIDs and run numbers so that equal prompts compare equal."""
    text = guarded_replace(text, ("T",), "(?U)" + fixed.ISO_TIMESTAMP, "<TIMESTAMP>")
    text = guarded_replace(text, ("-",), fixed.UUID, "<UUID>")
    return guarded_replace(text, ("task-", "task_", "run-", "run_"), "(?U)" + fixed.RUN_ID, "task-<ID>")


def prompt_key(provider: Column, normalized: Column) -> Column:
    return F.sha2(F.concat_ws(":", provider, normalized), 256)


def system_digest(system: Column) -> Column:
    return F.substring(F.sha2(system, 256), 1, 32)


def content_digest(text: Column, minimum: int = 100) -> Column:
    return F.when(F.length(text) > minimum, F.sha2(text, 256))


def mask_secret(secret: Column) -> Column:
    return F.when(F.length(secret) <= 8, F.lit("****")).otherwise(
        F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4)))
    )


def safe_id(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), "[^a-zA-Z0-9_\\-]", "_")


def model_from_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "/models/([^/:]+)", 1), F.lit(""))


def summarize_output(task_id: Column, success: Column, output: Column, edge: int = 3) -> Column:
    """Long output becomes its first and last lines below a status line."""
    rows = lines(output)
    count = F.size(rows)
    return F.when(count <= 5, strip(output)).otherwise(
        F.concat(
            F.format_string(
                "[Subtask %s %s | Total lines: %d]\nStart: ",
                task_id.cast("string"),
                F.when(success, F.lit("SUCCESS")).otherwise(F.lit("FAILURE")),
                count,
            ),
            F.array_join(F.slice(rows, 1, edge), "\n"),
            F.lit("\n...\nEnd: "),
            F.array_join(F.slice(rows, F.greatest(count - edge + 1, F.lit(1)), F.lit(edge)), "\n"),
        )
    )


def normalized_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(\\./)+", "")


def is_disallowed_path(path: Column) -> Column:
    """Scratch files: a ``tmp`` or ``.index`` folder anywhere, ``*.tmp``, ``*.log``."""
    p = normalized_path(path)
    return p.rlike("(?s)(^|/)(tmp|\\.index)/") | p.isin("tmp", ".index") | p.rlike("(?s)\\.(tmp|log)$")


def is_scan_exempt(path: Column) -> Column:
    """Mock secrets are allowed in tests and documentation."""
    return normalized_path(path).rlike("(?s)^(tests/test_.*\\.py|docs/.*)$")


def is_scanned(path: Column) -> Column:
    """Files the finding scan reads: not exempt, not binary, not below an ignored folder."""
    p = normalized_path(path)
    ignored = "(^|/)(" + "|".join(f.replace(".", "\\.") for f in fixed.SCAN_IGNORED_FOLDERS) + ")(/|$)"
    binary = "(" + "|".join(s.replace(".", "\\.") for s in fixed.BINARY_SUFFIXES) + ")$"
    return ~is_scan_exempt(p) & ~p.rlike(binary) & ~p.rlike(ignored)


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two distinct-token arrays; 0 when both are empty."""
    common = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - common
    return F.when(total > 0, common / total).otherwise(F.lit(0.0))
