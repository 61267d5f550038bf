"""Vectorised hashing of byte buffers: words, shingles, windows and sliding minima."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the process and grown when needed."""
    have = _TABLES.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(1, U)
        step = base
        while len(out) < size:
            out = np.concatenate([out, out * U(step)])
            step = step * step % (1 << 64)
        _TABLES[name] = have = out
    return have[:n]


def byte_codes(fold_case: bool) -> np.ndarray:
    """A random 64-bit code for each byte; A-Z share those of a-z when ``fold_case``."""
    name = f'codes{fold_case}'
    if name not in _TABLES:
        codes = mix(np.arange(1, 257, dtype=U) * U(_BASE))
        if fold_case:
            codes[65:91] = codes[97:123]
        _TABLES[name] = codes
    return _TABLES[name]


def prefix_sums(data: np.ndarray, fold_case=False) -> np.ndarray:
    """Prefix sums of code[byte] * base**position, modulo 2**64 (n + 1 values)."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(byte_codes(fold_case)[data] * _powers('up', _BASE, len(data)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the bytes stand (length included)."""
    down = _powers('down', pow(_BASE, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words of each text as byte ranges of ``data``; ``first`` has
    n + 1 entries, the words of text i being first[i]:first[i + 1]."""
    solid = ~_SPACE[data]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    head[inner] = solid[inner]  # a text's first byte starts a word, its last one ends one
    tail[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ASCII letters and non-ASCII bytes inside each text."""
    solid = np.append(_LETTER[data], False)
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    tail = solid[:-1] & ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    head[inner] = solid[inner]
    tail[inner - 1] = solid[inner - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def sixteen(data: np.ndarray) -> np.ndarray:
    """Hash of every 16-byte string of ``data``, by start."""
    eight = np.ndarray((max(len(data) - 7, 0),), U, np.ascontiguousarray(data), strides=(1,)) if len(data) >= 8 else np.zeros(0, U)
    if len(data) < 16:
        return np.zeros(0, U)
    return mix(eight[:-8] * U(0x9FB21C651E98DF25) ^ (eight[8:] * U(0xA24BAED4963EE407) + U(0x165667B19E3779F9)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for every i, by doubling."""
    have = 1
    out = x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
