"""Named, exchangeable parts: estimators, losses, scorers."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """A table of functions by name; a name can't be given to a second function."""

    def __init__(self, what: str):
        self.what, self.entries = what, {}

    def register(self, name: str) -> Callable:
        def add(fn):
            if self.entries.setdefault(name, fn) is not fn:
                raise ValueError(f"{self.what} {name!r} is registered already")
            return fn

        return add

    def get(self, name: str) -> Callable:
        if name not in self.entries:
            raise ValueError(f"no {self.what} {name!r}; there are {', '.join(sorted(self.entries))}")
        return self.entries[name]
