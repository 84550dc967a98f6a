"""Bounded tables of remembered results, for workers."""

from __future__ import annotations

import ctypes
import gc
import weakref
from functools import lru_cache

import pyarrow as pa

#: Longer keys are worked out each time.
MEMO_CHARS = 48


class Memo(dict):
    """What ``make`` gives for a key, remembered for short keys.

    The first ``limit`` keys stay, as frequent ones come early; later ones share a table half
    that size which starts anew when full.  After ``ROUNDS`` such starts all is forgotten, so
    that a worker follows a change of language or source.
    """

    ROUNDS = 16

    def __init__(self, make, limit: int, fixed: list[str] = ()):
        super().__init__(dict.fromkeys(fixed, 1))
        _tables.append(weakref.ref(self))
        self.make, self.fixed, self.limit, self.late, self.starts = make, fixed, limit + len(fixed), {}, 0

    def __missing__(self, key: str):
        value = self.late.get(key)
        if value is None:
            value = self.make(key)
            if len(key) <= MEMO_CHARS:
                self._keep(key, value)
        return value

    def _keep(self, key: str, value) -> None:
        if len(self) < self.limit:
            self[key] = value
            return
        if len(self.late) >= self.limit // 2:
            self.late = {}
            self.starts += 1
            if self.starts % self.ROUNDS == 0:
                self.clear()
                self.update(dict.fromkeys(self.fixed, 1))
        self.late[key] = value

    def forget(self) -> None:
        self.late, self.starts = {}, 0
        self.clear()
        self.update(dict.fromkeys(self.fixed, 1))


class Recent(dict):
    """What ``make`` gives for a key, remembered for short keys that were asked for lately.

    Two generations of at most ``limit`` keys: when the young one is full it becomes the old one,
    whose keys come back as they are asked for.  So what is dropped at a time is what was not asked
    for during a whole generation, and frequent keys are never made again.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        _tables.append(weakref.ref(self))
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > MEMO_CHARS:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.old = {}
        self.clear()


_tables: list[weakref.ref] = []
_loaders: list = []
_operator: list[str] = [""]


def loaded(limit: int):
    """A cache of what a worker loads (vocabularies, models), emptied when it turns to another operator."""

    def keep(load):
        cached = lru_cache(maxsize=limit)(load)
        _loaders.append(cached.cache_clear)
        return cached

    return keep


def _give_back() -> None:
    """Freed memory goes back to the system, where the allocators let it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this platform
        return


def working_for(operator: str) -> None:
    """Called where an operator starts on a worker: what was kept for another one is dropped.

    A worker serves one stage after the other; so it holds the tables and models of one operator only.
    """
    if operator != _operator[0]:
        _operator[0] = operator
        _tables[:] = [ref for ref in _tables if ref() is not None]
        for ref in _tables:
            if (table := ref()) is not None:
                table.forget()
        for clear in _loaders:
            clear()
        _give_back()
