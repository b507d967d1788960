"""Settings of a job by dotted names, with defaults. They are driver-side and small."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

_NONE = object()


def get(settings: Mapping[str, Any], name: str, default: Any = None, defaults: Mapping[str, Any] | None = None) -> Any:
    """The value at a dotted name, in settings, else in defaults, else default."""
    for source in (settings, defaults or {}):
        value: Any = source
        for part in name.split("."):
            value = value.get(part, _NONE) if isinstance(value, Mapping) else _NONE
        if value is not _NONE:
            return value
    return default


def with_value(settings: Mapping[str, Any], name: str, value: Any) -> dict[str, Any]:
    """settings with another value at a dotted name; what is on the way and no mapping is replaced."""
    head, _, rest = name.partition(".")
    inner = settings.get(head)
    return {**settings, head: with_value(inner if isinstance(inner, Mapping) else {}, rest, value) if rest else value}


def without(settings: Mapping[str, Any], name: str) -> dict[str, Any]:
    """settings without a dotted name; unchanged where it isn't there."""
    head, _, rest = name.partition(".")
    if head not in settings:
        return dict(settings)
    if rest:
        inner = settings[head]
        return {**settings, head: without(inner, rest)} if isinstance(inner, Mapping) else dict(settings)
    return {k: v for k, v in settings.items() if k != head}
