"""What a Python worker keeps from task to task, for one operator at a time.

Workers live longer than tasks and serve many operators. An operator that
keeps tables or remembered chunks says how to drop them; as soon as another
operator begins in the same worker they go, so that what several operators keep
doesn't add up.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: For glibc's mallopt: which settings, and the size from which a block is mapped on its own.
_TRIM, _MAP, _LARGE = -1, -3, 1 << 19

_owner: str | None = None
_drops: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def _thrifty() -> None:
    """Set once in a worker."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(_MAP, _LARGE)
        libc.mallopt(_TRIM, _LARGE)
        pa.set_memory_pool(pa.system_memory_pool())


def begin(owner: str, drop: Callable[[], None] | None = None) -> None:
    """``owner`` begins a task here. ``drop`` frees what it will keep."""
    global _owner
    if _owner != owner and _drops:
        for free in _drops.values():
            free()
        _drops.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _give_back()
    if _owner is None:
        _thrifty()
    _owner = owner
    if drop is not None:
        _drops[owner] = drop
