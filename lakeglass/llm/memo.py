"""A bounded memo for values computed per word."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any


#: Longer keys are computed every time, which bounds the bytes held.
LONGEST = 64


class Memo(dict):
    """Computes missing values; holds at most ``2 * limit`` of them in two generations.

    Texts of more than ``LONGEST`` characters are not kept, so an entry takes a few
    hundred bytes at most.

    When the young generation is full it becomes the old one; values asked for
    again move back.  Frequent words therefore stay while one-off words leave.
    """

    def __init__(self, make: Callable[[Any], Any], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if isinstance(key, str) and len(key) > LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self._keep(key, value)
        return value

    def values_of(self, keys: Iterable[str], make_all: Callable[[list[str]], Iterable[Any]], at_once: int) -> dict[str, Any]:
        """The values of ``keys`` (distinct); what is not held is computed so many at a time."""
        out, missing = {}, []
        for key in keys:
            value = self.get(key)
            if value is None and (value := self.old.get(key)) is not None:
                self._keep(key, value)
            if value is None:
                missing.append(key)
            else:
                out[key] = value
        for i in range(0, len(missing), at_once):
            some = missing[i : i + at_once]
            for key, value in zip(some, make_all(some), strict=True):
                out[key] = value
                if len(key) <= LONGEST:
                    self._keep(key, value)
        return out

    def _keep(self, key: Any, value: Any) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def forget(self) -> None:
        self.old = {}
        self.clear()
