"""Digests that one task begins and another goes on with."""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache

_ROOM = 512  # more than the largest context of these algorithms, 216 bytes


@cache
def _functions(algorithm: str) -> tuple | None:
    """Init, Update and Final of the library that hashlib itself calls; None where it has none."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        return tuple(getattr(library, f"{algorithm.upper()}_{step}") for step in ("Init", "Update", "Final"))
    except (ImportError, AttributeError, OSError):
        return None


def resumable(algorithm: str) -> bool:
    return _functions(algorithm) is not None


class Digest:
    """Like hashlib's, but ``state`` is all of it in bytes, for machines of one byte order. Their contexts hold no pointers."""

    def __init__(self, algorithm: str, state: bytes | None = None):
        begin, self._add, self._end = _functions(algorithm)
        self._size = hashlib.new(algorithm).digest_size
        self._context = ctypes.create_string_buffer(state or b"", _ROOM)
        if state is None:
            begin(self._context)

    @property
    def state(self) -> bytes:
        return self._context.raw

    def update(self, block: bytes) -> None:
        self._add(self._context, block, ctypes.c_size_t(len(block)))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(self._size)
        self._end(out, ctypes.create_string_buffer(self.state, _ROOM))
        return out.raw.hex()
