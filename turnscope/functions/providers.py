"""Which wire format a request uses, and what is known about its target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnscope import fixed
from turnscope.functions import variants as V
from turnscope.functions.formats import family


def host_of(url: Column) -> Column:
    """Lower-case host name; the text itself when it has none."""
    low = F.lower(url)
    full = F.when(F.contains(low, F.lit("://")), low).otherwise(F.concat(F.lit("https://"), low))
    authority = F.regexp_extract(full, "^[^:/?#]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":\\d*$", "")
    return F.when(host != "", host).otherwise(low)


def _any_part(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def provider_from_url(url: Column) -> Column:
    """anthropic, gemini or openai by URL; NULL when the URL says nothing."""
    low, host = F.lower(url), host_of(url)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.lit(None))
        .when(_any_part(low, ("anthropic", "v1/messages")), "anthropic")
        .when(
            host.rlike("(^|\\.)generativelanguage\\.googleapis\\.com$")
            | _any_part(low, ("gemini", "generatecontent")),
            "gemini",
        )
        .when(_any_part(low, fixed.CHAT_URL_PARTS), "openai")
    )


def provider_from_payload(payload: Column, gateway: bool = False) -> Column:
    """By the keys of the request object.

    ``gateway`` is the rule set used on the wire: it ignores the model name, and it tests
    ``messages``/``prompt`` before ``system``.
    """
    version = V.has(payload, "$['anthropic-version']") | V.has(payload, "$.anthropic_version")
    chat = V.has(payload, "$.messages") | V.has(payload, "$.prompt")
    if gateway:
        return (
            F.when(version, "anthropic")
            .when(V.has(payload, "$.contents"), "gemini")
            .when(chat, "openai")
            .when(V.has(payload, "$.system"), "anthropic")
        )
    named = F.contains(F.lower(V.string_or_null(payload, "$.model")), F.lit("claude"))
    return (
        F.when(version | F.coalesce(named, F.lit(False)), "anthropic")
        .when(V.has(payload, "$.contents"), "gemini")
        .when(V.has(payload, "$.system"), "anthropic")
        .when(chat, "openai")
    )


def detect_provider(url: Column, payload: Column | None = None, gateway: bool = False) -> Column:
    found = [provider_from_url(url)]
    if payload is not None:
        found.append(provider_from_payload(payload, gateway))
    return F.coalesce(*found, F.lit("unknown"))


def provider_impl(name: Column) -> Column:
    """The built-in format that handles a provider name; unknown names use the chat-completions one."""
    return family(name)


def is_local_target(host: Column, port: Column, provider: Column, declared: Column) -> Column:
    """A loopback host, a declared endpoint, or a vendor format sent to a host that is not the vendor's.

    ``declared`` is ``ARRAY<STRUCT<host: STRING, port: INT>>``.
    """
    low = F.lower(host)
    named = F.exists(declared, lambda t: t["host"] == low)
    by_port = F.exists(
        declared, lambda t: (t["port"] == port) & (t["host"].isin("localhost", "127.0.0.1", "::1") | (t["host"] == low))
    )
    foreign = (provider == "anthropic") & (low != "") & ~low.isin(*fixed.CLOUD_HOSTS_ANTHROPIC)
    gemini_cloud = reduce(lambda a, b: a | b, [F.endswith(low, F.lit(s)) for s in fixed.CLOUD_SUFFIXES_GEMINI])
    return F.coalesce(
        low.isin(*fixed.LOOPBACK_HOSTS)
        | named
        | by_port
        | foreign
        | ((provider == "gemini") & (low != "") & ~gemini_cloud),
        F.lit(False),
    )


def is_streaming_request(payload: Column, url: Column) -> Column:
    low = F.lower(url)
    flag = (F.schema_of_variant(V.at(payload, "$.stream")) == "BOOLEAN") & F.try_variant_get(
        payload, "$.stream", "boolean"
    )
    return F.coalesce(flag, F.lit(False)) | _any_part(low, ("streamgeneratecontent", "alt=sse"))


def is_cacheable(payload: Column, url: Column, status: Column, response: Column, provider: Column) -> Column:
    """A complete, successful answer of a known provider."""
    failed = V.has(response, "$.error") | F.coalesce(V.string_or_null(response, "$.type") == "error", F.lit(False))
    return ~is_streaming_request(payload, url) & (status == 200) & ~failed & (provider != "unknown")


def header(headers: Column, name: str) -> Column:
    """Header by case-insensitive name; an empty value counts as absent."""
    found = F.filter(F.map_entries(headers), lambda e: (F.lower(e["key"]) == name.lower()) & (e["value"] != ""))
    return F.get(found, F.lit(0))["value"]
