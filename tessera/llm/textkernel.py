"""Vectorised word splitting and hashing over UTF-8 bytes.

All functions work on a block of documents given as one byte array with
document bounds, so cost per word is a few numpy passes, not Python objects.
A-Z are lower-cased; no other case folding is done.
"""

from __future__ import annotations

import numpy as np

_ALL = np.arange(256)
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)
_LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)

#: Lanes (eight bytes of a word) handled at once, and the bits of a lane by its number of bytes.
_LANES = 1 << 17
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def words(raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray = NOT_SPACE):
    """Starts, ends and document index of each word; ``raw`` is lower-cased."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = kind[raw]
    edge = np.empty(len(raw), bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    cuts = bounds[(bounds > 0) & (bounds < len(raw))]
    first = inside & edge
    first[cuts] = inside[cuts]
    last = np.empty(len(raw), bool)
    last[-1] = inside[-1]
    last[:-1] = inside[:-1] & edge[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on as one number; zeros follow the end."""
    return np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


def _later_lanes(n: np.ndarray):
    """(word, byte in the word, bytes of the lane) of all lanes but each word's
    first, in spans of bounded size, however long a word is."""
    upto = np.cumsum((n - 1) >> 3)
    for a in range(0, int(upto[-1]) if len(upto) else 0, _LANES):
        lane = np.arange(a, min(a + _LANES, int(upto[-1])))
        w = np.searchsorted(upto, lane, "right")
        at = (lane - (upto[w] - ((n[w] - 1) >> 3)) + 1) * 8
        yield w, at, np.minimum(n[w] - at, 8)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes.

    Lanes are mixed with their place in the word and then summed, so neither
    repetition nor order within a long word can cancel out.
    """
    n, view = ends - starts, _lanes(raw)
    h = mix(view[starts] & _MASK[np.minimum(n, 8)])
    long = np.flatnonzero(n > 8)
    for w, at, size in _later_lanes(n[long]):
        v = mix(view[starts[long[w]] + at] & _MASK[size] ^ at.astype(np.uint64) * _P)
        first = np.flatnonzero(np.diff(w, prepend=-1))
        h[long[w[first]]] += np.add.reduceat(v, first)
    return mix(h + n.astype(np.uint64) * _P)


def piece_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each piece: up to seven bytes stand for themselves, others by their hash."""
    n = ends - starts
    key = _lanes(raw)[starts] & _MASK[np.minimum(n, 7)] | n.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(n > 7)
    key[long] = hash_words(raw, starts[long], ends[long])
    return key


def same_bytes(raw: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the ``n`` bytes from ``a`` on are those from ``b`` on, for all pairs."""
    view = _lanes(raw)
    if ((view[a] ^ view[b]) & _MASK[np.minimum(n, 8)]).any():
        return False
    long = np.flatnonzero(n > 8)
    return not any(((view[a[long[w]] + at] ^ view[b[long[w]] + at]) & _MASK[size]).any() for w, at, size in _later_lanes(n[long]))


def shingles(h: np.ndarray, counts: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles.

    A document with 1..k-1 words has its whole sequence as one shingle; one
    without words has none.  ``counts`` are words per document.
    """
    coef = [np.uint64(c) for c in (mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1))]
    n = max(0, len(h) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for i, c in enumerate(coef):
        rolled += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29))) * c
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(rolled[at : at + c - k + 1]))
        elif c:
            v = np.full(1, c, np.uint64)
            for i in range(c):
                v = mix(v * coef[0] + h[at + i : at + i + 1])
            out.append(v)
        else:
            out.append(rolled[:0])
        at += c
    return out
