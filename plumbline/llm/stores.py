"""What Python workers keep from batch to batch, within bounds of memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa

#: About what an entry takes besides its characters: key, value and its place in the table.
ENTRY_BYTES = 220

_kept: dict[Any, Any] = {}


def give_back() -> None:
    """Free memory that this process no longer uses goes back to the system, which else keeps counting it as the worker's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """A worker's one kept object: another key's is dropped first, so workers that Spark uses again don't add up what the stages kept."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[key] = make()
    return _kept[key]


class Store:
    """Short strings and what was worked out for them, of ``most_bytes`` at most beside what one call of ``ready`` adds.

    Two generations: when the young one has half the bytes, it becomes the old one, and the old one goes. What is used again
    moves to the young one, so frequent strings stay.
    """

    def __init__(self, most_bytes: int, longest: int = 64):
        self.half, self.longest, self.size = most_bytes // 2, longest, 0
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def ready(self, keys: set[str], learn: Callable[[list[str]], Iterable[Any]]) -> Callable[[str], Any]:
        """The look-up of all ``keys``; ``learn`` gives those of the keys that are lacking. Keys over ``longest`` characters aren't kept."""
        if self.size > self.half:
            self.young, self.old, self.size = {}, self.young, 0
        young, old, lack = self.young, self.old, []
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
                self.size += ENTRY_BYTES + 2 * len(k)
            else:
                lack.append(k)
        long: dict[str, Any] = {}
        for k, x in zip(lack, learn(lack), strict=True) if lack else ():
            if len(k) > self.longest:
                long[k] = x
            else:
                young[k] = x
                self.size += ENTRY_BYTES + 2 * len(k)
        return young.__getitem__ if not long else lambda k: young[k] if k in young else long[k]
