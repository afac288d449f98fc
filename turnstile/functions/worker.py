"""Per-process state for Python workers.

UDF code from this package is shipped by value, so module globals are copied
into every task.  Objects that are expensive to build (tokenizers, model
backends) are instead kept in one registry per Python worker process, looked
up at run time, so a reused worker builds each of them once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable


def worker_registry() -> dict:
    """The process-wide registry (created on first use in each worker)."""
    reg = getattr(sys, "_turnstile_worker_registry", None)
    if reg is None:
        reg = {}
        sys._turnstile_worker_registry = reg
    return reg


def get_or_build(key: str, factory: Callable[[], object]) -> object:
    """Return the cached object for ``key``, building it with ``factory`` once per process."""
    reg = worker_registry()
    obj = reg.get(key)
    if obj is None:
        obj = factory()
        reg[key] = obj
    return obj
