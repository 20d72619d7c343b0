"""What a Python worker process keeps between tasks: the caches of one operator at a time.

Workers are used again by later stages. What one operator has cached there helps its next tasks, but would
stand beside what another operator needs; so it goes when another one begins, and freed memory goes back to
the system.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable

_kept: dict[Hashable, object] = {}
_owner = ""


def enter(operator: str) -> None:
    """To be called where a task of an operator begins."""
    global _owner
    if operator != _owner:
        _kept.clear()
        _owner = operator
        release()


def kept(operator: str, key: Hashable, make: Callable[[], object]) -> object:
    """The operator's object of that key, made once in a process while no other operator runs in it; two at most."""
    enter(operator)
    if key not in _kept:
        if len(_kept) > 1:
            _kept.pop(next(iter(_kept)))
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
