"""A timer of named phases, for the driver's part of a fit."""

from __future__ import annotations

import time
from contextlib import contextmanager

_spent: dict[str, list] = {}


@contextmanager
def phase(name: str):
    """Adds the block's seconds under ``name``."""
    began = time.perf_counter()
    try:
        yield
    finally:
        entry = _spent.setdefault(name, [0, 0.0])
        entry[0] += 1
        entry[1] += time.perf_counter() - began


def report(clear: bool = True) -> dict[str, tuple[int, float]]:
    """Calls and seconds by name."""
    out = {k: (n, s) for k, (n, s) in _spent.items()}
    if clear:
        _spent.clear()
    return out
