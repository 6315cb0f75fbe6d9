"""Named, exchangeable parts (blockers, feature groups, models, rules) and settings that extend one another."""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy


class Registry(dict):
    """register(name) adds a part; asking for an unknown one names those there are."""

    def register(self, name: str) -> Callable:
        def add(part):
            if name in self:
                raise ValueError(f"{name} is taken")
            self[name] = part
            return part

        return add

    def __missing__(self, name):
        raise KeyError(f"{name}: expected one of {sorted(self)}")


def settings(named: dict[str, dict], name: str, **overrides) -> dict:
    """A named setting over those it ``extends``; dotted overrides reach inner values, ``_replace`` drops the inherited ones."""
    own = deepcopy(named[name])
    parent = own.pop("extends", None)
    base = settings(named, parent) if parent else {}
    out = _merged(base, own)
    for key, value in overrides.items():
        *path, last = key.replace("__", ".").split(".")
        inner = out
        for p in path:
            inner = inner.setdefault(p, {})
        inner[last] = value
    return out


def _merged(base: dict, own: dict) -> dict:
    if own.get("_replace"):
        return {k: v for k, v in own.items() if k != "_replace"}
    out = dict(base)
    for k, v in own.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
