"""One heavy object for each Python worker, kept from task to task."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_held: dict[Hashable, object] = {}


def keep(key: Hashable, make: Callable[[], T]) -> T:
    """The object made for ``key``. Another key drops what was held, so a worker that goes
    from one operator to the next never holds the vocabularies and caches of both."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]  # type: ignore[return-value]


def clear() -> None:
    """For tasks that keep nothing: drop what an earlier operator left in this worker."""
    _held.clear()
