"""Wire formats: the five steps of each as Column builders, and which format handles a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from importlib import import_module
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnscope import fixed

Builder = Callable[..., Column]
# Unknown providers use this format.
DEFAULT = "openai"


@dataclass(frozen=True)
class ProviderFormat:
    """What is particular to a wire format. A step that is left out is the one of ``base``, a registered name.

    - ``clean(payload, options)``: a struct of ``cleaned`` (JSON text), ``tool_outputs_omitted``, ``turns_summarized`` and
      ``cache_control_injected``. The built-in formats have none: their requests share the steps of ``clean_payload``.
    - ``usage_from_object(response)``: ``usage.object_counts(...)`` of a response object.
    - ``usage_from_stream(events)``: ``usage.stream_counts(...)`` of the events of a stream.
    - ``stream_text(events)``: the reply of a stream.
    - ``key_parts(payload, recent)``: a struct of ``user_text`` and ``system_text``.

    Builders run while the plan is made; what they return is one branch of a condition on the provider.
    """

    base: str = DEFAULT
    clean: Builder | None = None
    usage_from_object: Builder | None = None
    usage_from_stream: Builder | None = None
    stream_text: Builder | None = None
    key_parts: Builder | None = None


_FORMATS: dict[str, ProviderFormat] = {n: ProviderFormat(base=n) for n in ("anthropic", "gemini", "openai")}
BUILT_IN = tuple(_FORMATS)


def _key(name: str | None) -> str:
    return (name or "").strip().lower()


def built_in(name: str, step: str) -> Callable[[Builder], Builder]:
    """Decorator of a built-in format's step."""

    def add(builder: Builder) -> Builder:
        _FORMATS[name] = replace(_FORMATS[name], **{step: builder})
        return builder

    return add


def register_provider(name: str, provider: ProviderFormat) -> None:
    """Handle a provider, in any case and with blanks around it, by ``provider``; an earlier registration is replaced."""
    base = _key(provider.base)
    if base not in _FORMATS or base == _key(name):
        raise ValueError(f"the base of {name!r} must be another registered provider, not {provider.base!r}")
    if _key(name) in BUILT_IN:
        raise ValueError(f"{name!r} is built in")
    _FORMATS[_key(name)] = replace(provider, base=base)


def unregister_provider(name: str) -> None:
    if _key(name) in BUILT_IN:
        raise ValueError(f"{name!r} is built in")
    _FORMATS.pop(_key(name), None)


@contextmanager
def registered(name: str, provider: ProviderFormat) -> Iterator[None]:
    """Register a provider for the plans that are made inside the block."""
    register_provider(name, provider)
    try:
        yield
    finally:
        unregister_provider(name)


def provider_format(name: str | None) -> ProviderFormat:
    """The format that handles a provider, with every step it has or takes from its bases."""
    for module in ("usage", "conversation"):
        import_module(f"turnscope.operators.{module}")
    found = _FORMATS.get(_key(name), _FORMATS[DEFAULT])
    steps: dict[str, Any] = {}
    at = found
    while True:
        steps = {k: v for k, v in vars(at).items() if v is not None} | steps
        if _FORMATS[at.base] is at:
            return ProviderFormat(**(steps | {"base": found.base}))
        at = _FORMATS[at.base]


def _groups(value: Callable[[str], Any]) -> dict[Any, list[str]]:
    found: dict[Any, list[str]] = {}
    for name in _FORMATS:
        found.setdefault(value(name), []).append(name)
    return found


def _choose(provider: Column, value: Callable[[str], Any], column: Callable[[Any], Column]) -> Column:
    """``column`` of what ``value`` gives for the row's provider; names of equal value are one branch."""
    key = F.lower(F.trim(F.coalesce(provider, F.lit(""))))
    chain = None
    for found, names in _groups(value).items():
        if found != value(DEFAULT):
            hit = key == names[0] if len(names) == 1 else key.isin(*names)
            chain = F.when(hit, column(found)) if chain is None else chain.when(hit, column(found))
    rest = column(value(DEFAULT))
    return rest if chain is None else chain.otherwise(rest)


def dispatch(provider: Column | str, step: str, *args: Any) -> Column:
    """A step of the format that handles the provider; given by name, the choice costs nothing at run time."""
    if isinstance(provider, str):
        return getattr(provider_format(provider), step)(*args)
    return _choose(provider, lambda name: getattr(provider_format(name), step), lambda builder: builder(*args))


def _family(name: str) -> str:
    at = _key(name) if _key(name) in _FORMATS else DEFAULT
    while at not in BUILT_IN:
        at = _FORMATS[at].base
    return at


def family(provider: Column | str) -> Column | str:
    """The built-in format that a provider's requests are shaped like."""
    return _family(provider) if isinstance(provider, str) else _choose(provider, _family, F.lit)


def own_cleaners() -> dict[str, Builder]:
    """Providers that clean their requests themselves."""
    return {name: clean for name in _FORMATS if (clean := provider_format(name).clean) is not None}


def has_streams(provider: Column | str) -> Column:
    """Whether the event streams of a provider are read."""
    names = sorted({*fixed.STREAM_PROVIDERS, *_FORMATS})
    return F.lower(F.trim(F.lit(provider) if isinstance(provider, str) else provider)).isin(*names)
