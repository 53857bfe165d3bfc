"""Operators by kind and name. An operator is a function from DataFrames to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

_OPERATORS: dict[str, dict[str, Callable]] = {}


def operator(kind: str, *names: str) -> Callable[[Callable], Callable]:
    """Register a function under one or more names of a kind."""

    def keep(f: Callable) -> Callable:
        for name in names:
            _OPERATORS.setdefault(kind, {})[name] = f
        return f

    return keep


def get(kind: str, name: str) -> Callable:
    try:
        return _OPERATORS[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} {name!r}; there are {', '.join(names(kind)) or 'none'}") from None


def names(kind: str) -> list[str]:
    return sorted(_OPERATORS.get(kind, {}))
