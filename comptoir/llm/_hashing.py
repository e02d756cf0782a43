"""Hashes of words, word shingles and byte windows of one text, computed with numpy on its UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Bytes are summed modulo two primes, so strings of
two letters that cancel modulo a power of two (Thue-Morse strings) differ here. Two given words or shingles share a hash with a probability
of about 2^-62, any two of 10^8 with one of about 1 in 1000. Memory is some 100 bytes for each byte of the longest text, since one text is
worked on at a time.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Two primes: a hash modulo both is one modulo their product, of some 2^62, and products of two remainders fit into 64 bits.
_PRIMES = tuple(np.uint64(p) for p in ((1 << 31) - 1, (1 << 31) - 19))
_BASES = 1_160_269_981, 1_884_377_639
_S32 = np.uint64(32)

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2
_inverses: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _series(base: int, prime: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo ``prime``, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    width = 1
    while width < n:
        step = np.uint64(pow(base, width, int(prime)))
        out[width : 2 * width] = out[: min(width, n - width)] * step % prime
        width *= 2
    return out


def _tables(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Powers of the bases and of their inverses modulo the two primes, at least ``n`` of each."""
    global _powers, _inverses
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers = [_series(b, p, size) for b, p in zip(_BASES, _PRIMES, strict=True)]
        _inverses = [_series(pow(b, -1, int(p)), p, size) for b, p in zip(_BASES, _PRIMES, strict=True)]
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _S33)) * _M1
        h = (h ^ (h >> _S33)) * _M2
        return h ^ (h >> _S33)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Two rows S, one for each prime, with S[j] - S[i] = the sum of (symbol + 1) * base^position over positions i..j-1; symbols are below 2^32."""
    powers, _ = _tables(len(data) + 1)
    out = np.zeros((2, len(data) + 1), dtype=np.uint64)
    symbols = data.astype(np.uint64) + np.uint64(1)
    for row, power, prime in zip(out, powers, _PRIMES, strict=True):
        np.cumsum(symbols * power[: len(data)] % prime, out=row[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols start..end-1, the same wherever they stand."""
    _, inverses = _tables(sums.shape[1])
    one, two = ((row[end] - row[start]) % prime * inverse[start] % prime for row, inverse, prime in zip(sums, inverses, _PRIMES, strict=True))
    with np.errstate(over="ignore"):
        return mix((one << _S32 | two) + (end - start).astype(np.uint64) * _STEP)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, every byte from 128 on counting as one."""
    return _runs(_LETTER[data])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``."""
    return _runs(~_SPACE[data])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(mask) + 2, dtype=np.int8)
    inside[1:-1] = mask
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_hashes(text: str | None) -> np.ndarray:
    data = _LOWER[as_bytes(text)]
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    return range_hash(prefix_sums(data), start, end)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, in order; empty when there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = words[:count].copy()
        for i in range(1, n):
            h = h * _M1 + words[i : i + count]
    return mix(h)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; the whole sequence as one if there are fewer words; empty without words."""
    words = word_hashes(text)
    if 0 < len(words) < n:
        return ngram_hashes(np.concatenate([[np.uint64(len(words))], words]), len(words) + 1)
    return np.unique(ngram_hashes(words, n))


def set_key(values: np.ndarray) -> int:
    """A 63-bit key of a sorted set of hashes: equal sets share it."""
    with np.errstate(over="ignore"):
        total = mix(values + _STEP).sum(dtype=np.uint64) + np.bitwise_xor.reduce(mix(values ^ _BASE), initial=0) * _M2
    return int(mix(np.array([total + np.uint64(len(values))], dtype=np.uint64))[0] >> np.uint64(1))
