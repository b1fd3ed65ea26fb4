"""Options in layers (defaults, a file, the environment, a call): one frozen mapping for the filters that take them."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType


def _over(low: object, high: object) -> object:
    if isinstance(low, Mapping) and isinstance(high, Mapping):
        return {k: _over(low[k], high[k]) if k in low and k in high else high.get(k, low.get(k)) for k in [*low, *(k for k in high if k not in low)]}
    return high


def _frozen(x: object) -> object:
    if isinstance(x, Mapping):
        return MappingProxyType({k: _frozen(v) for k, v in x.items()})
    return tuple(map(_frozen, x)) if isinstance(x, list | tuple) else x


def layered(*layers: Mapping | None) -> Mapping:
    """The layers as one, later ones before earlier ones: nested mappings are merged key by key, anything else (lists too) is replaced whole. None is
    no layer; a value of None is a value. Nothing of the result can be changed."""
    out: object = {}
    for layer in layers:
        out = _over(out, layer or {})
    return _frozen(out)  # type: ignore[return-value]


def from_environment(environment: Mapping[str, str], prefix: str) -> dict:
    """A layer from variables: PREFIX_FILTERS__EXTENSIONS=.java,.xml is {"filters": {"extensions": [".java", ".xml"]}}; a value with a comma is a list."""
    out: dict = {}
    for name, value in sorted(environment.items()):
        if name.startswith(f"{prefix}_"):
            at = out
            *path, last = name[len(prefix) + 1 :].lower().split("__")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = [x for x in value.split(",") if x] if "," in value else value
    return out
