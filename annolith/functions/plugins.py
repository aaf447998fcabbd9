"""Named plug-ins: sentence splitters, statistics, methods and judge callbacks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from .stats import STATISTICS
from .text import SPLITTERS


class Registry:
    """Plug-ins by name; a name is given once."""

    def __init__(self, kind: str, known: dict[str, Any] | None = None):
        self.kind, self.known = kind, dict(known or {})

    def register(self, name: str) -> Callable[[Any], Any]:
        def keep(plugin):
            if name in self.known:
                raise ValueError(f"a {self.kind} is named {name} already")
            self.known[name] = plugin
            return plugin

        return keep

    def get(self, name: str) -> Any:
        if name not in self.known:
            raise KeyError(f"no {self.kind} is named {name}; there are {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name]


splitters = Registry("splitter", SPLITTERS)
statistics = Registry("statistic", STATISTICS)
methods = Registry("method")


def missing_judge(*_: Any) -> Any:
    """The default of a judge callback: nothing is called on the user's behalf."""
    raise NotImplementedError("pass a describe or classify callback; none is called by default")


judges = Registry("judge", {"describe": missing_judge, "classify": missing_judge})
