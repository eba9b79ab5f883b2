"""What a Python worker keeps from one task to the next.

Spark reuses workers over tasks and stages. What an operator remembers there would stay and add to the memory of the next
operator, so a worker keeps the tables of one operator only.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once and kept over the worker's tasks, until it is asked for another key."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Lets go of what earlier tasks left; work that keeps nothing itself calls it first."""
    _kept.clear()
