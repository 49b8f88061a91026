"""What Python workers remember between batches: one operator's memos at a time."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable

_CLEAR: dict[str, Callable[[], None]] = {}
#: Seconds between two returns of freed memory to the system.
TRIM_EVERY = 1.0
_trimmed = 0.0


def register(owner: str, clear: Callable[[], None]) -> None:
    _CLEAR[owner] = clear


def give_back() -> None:
    """Return what the allocator holds of freed memory, where the C library can: workers live on from stage to stage, and a batch's
    arrays would stay with them."""
    global _trimmed
    if time.monotonic() - _trimmed >= TRIM_EVERY:
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass
        _trimmed = time.monotonic()


def only(owner: str) -> None:
    """Empty the memos of all other operators: a worker that runs one stage after another holds those of the last."""
    for name, clear in _CLEAR.items():
        if name != owner:
            clear()
    give_back()


class Memo:
    """What was found for a key, in two generations: when the young one is full, it becomes the old one, and the old one goes.
    Keys that come again move back to the young one, so frequent ones stay."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def put(self, key, value):
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got
