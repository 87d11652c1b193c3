"""SHA-256 whose state can be handed on from one task to the next."""

from __future__ import annotations

import ctypes
import ctypes.util

#: Bytes of the C library's ``SHA256_CTX``: eight words of state, two of length, a block of 64 bytes and two counters.
_STATE_BYTES = 112


def _library() -> ctypes.CDLL | None:
    """The crypto library that ``hashlib`` uses, else the system's; None where neither has the calls."""
    try:
        import _hashlib

        names = [getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")]
    except ImportError:
        names = [ctypes.util.find_library("crypto")]
    for name in names:
        try:
            library = ctypes.CDLL(name) if name else None
            if library and library.SHA256_Init and library.SHA256_Final:
                library.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
                return library
        except (OSError, AttributeError):
            continue
    return None


_LIBRARY = _library()


def resumable() -> bool:
    """Whether this machine can hand on a digest's state."""
    return _LIBRARY is not None


class Sha256:
    """A digest that goes on from the state of another one, or begins."""

    def __init__(self, state: bytes | None = None) -> None:
        self._held = ctypes.create_string_buffer(_STATE_BYTES)
        if state is None:
            _LIBRARY.SHA256_Init(self._held)
        else:
            self._held.raw = state

    def update(self, data: bytes) -> None:
        _LIBRARY.SHA256_Update(self._held, data, len(data))

    def state(self) -> bytes:
        return self._held.raw

    def hexdigest(self) -> str:
        out, held = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self._held.raw, _STATE_BYTES)
        _LIBRARY.SHA256_Final(out, held)
        return out.raw.hex()
