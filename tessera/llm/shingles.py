"""Hashes of words and of word shingles, computed in numpy over the bytes of a text."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import SPACES

_U = np.uint64
_BASE, _MIX, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([c not in SPACES.encode() for c in range(256)], dtype=np.bool_)
_STEP = 1 << 16
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for base in (_BASE, _INVERSE):
            table = np.full(_STEP + 1, base, dtype=_U)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> _U(30))) * _MIX
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, in bytes."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = _IS_WORD[np.frombuffer(data, dtype=np.uint8)]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word of the whole text; A-Z lower-cased if asked.

    Words are polynomials in their bytes; the sums are taken over the whole text at once and shifted back to each
    word's start.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if lower:
        data = data.translate(_LOWER)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, dtype=_U)
    power, inverse = _power_tables()
    raw = np.frombuffer(data, dtype=np.uint8).astype(_U) + _U(1)
    if len(raw) <= _STEP:
        sums = np.zeros(len(raw) + 1, dtype=_U)
        np.cumsum(raw * power[: len(raw)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * inverse[starts])
    # A long text goes through in pieces that end between words; a longer word is hashed by itself.
    out = np.empty(len(starts), dtype=_U)
    k = 0
    while k < len(starts):
        begin = starts[k]
        last = max(int(np.searchsorted(ends, begin + _STEP, side="right")), k + 1)
        part = raw[begin : ends[last - 1]]
        if len(part) > _STEP:
            value = 0
            for at in range((len(part) - 1) // _STEP * _STEP, -1, -_STEP):
                piece = part[at : at + _STEP]
                value = (value * int(power[_STEP]) + int((piece * power[: len(piece)]).sum(dtype=_U))) & 0xFFFFFFFFFFFFFFFF
            out[k] = mixed(np.array([value], dtype=_U))[0]
        else:
            sums = np.zeros(len(part) + 1, dtype=_U)
            np.cumsum(part * power[: len(part)], out=sums[1:])
            s, e = starts[k:last] - begin, ends[k:last] - begin
            out[k:last] = mixed((sums[e] - sums[s]) * inverse[s])
        k = last
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` words in a row, in place; none where there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.full(n, size, dtype=_U)
    for k in range(size):
        out = out * _BASE + words[k : k + n]
    return mixed(out)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a text with fewer words gives its whole sequence as one."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(size, len(words))))
