"""Byte-level word tables and polynomial hashes, vectorised over many texts at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

_fold = np.arange(256, dtype=np.uint8)
_fold[ord("A") : ord("Z") + 1] += 32
_is_word = np.zeros(256, bool)
_is_word[ord("0") : ord("9") + 1] = _is_word[ord("a") : ord("z") + 1] = True
_is_word[0x80:] = True
#: Byte -> lower-cased word byte, 0 between words. A word is ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
WORD = np.where(_is_word[_fold], _fold, 0).astype(np.uint8)
#: The same for words ``[^\x20\x09-\x0D]+``; a NUL byte is a letter of them, so 1 is added to every value later on.
SPACED = _fold.copy()
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True

#: Powers that a process keeps, and bytes hashed at a time; longer arrays of powers are made for one call.
BLOCK = 1 << 20
_KEPT = BLOCK + (1 << 12)
#: A prime, and a base of polynomials modulo it. Modulo 2**64 alone, some long texts of regular make (Thue-Morse strings) agree for any base.
PRIME = U64((1 << 31) - 1)
_BASE31 = 1_299_709_871
_INVERSE31 = pow(_BASE31, -1, int(PRIME))
_tables: dict[str, np.ndarray] = {}


def _geometric(base: U64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def _geometric31(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, out * U64(pow(base, len(out), int(PRIME))) % PRIME])
    return out[:n].astype(np.uint32)


def _powers(name: str, make, base, n: int) -> np.ndarray:
    if n > _KEPT:
        return make(base, n)
    if name not in _tables:
        _tables[name] = make(base, _KEPT)
    return _tables[name][:n]


def powers(n: int) -> np.ndarray:
    """The first n powers of the base modulo 2**64."""
    return _powers("base", _geometric, _BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _powers("inverse", _geometric, _INVERSE, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[i] the hash of the first i values; H[j] - H[i], times a power of the inverse, identifies a slice."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(len(values)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the slice stands. What it says to be equal has to be checked."""
    inverse = inverse_powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def prefix_check(values: np.ndarray) -> np.ndarray:
    """Like prefix_hash, modulo PRIME; sums are left unreduced, as they fit in 64 bits."""
    terms = (values.astype(U64) + U64(1)) * _powers("base31", _geometric31, _BASE31, len(values))
    if len(values) > 1 << 22:
        terms %= PRIME
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(terms, out=out[1:])
    return out


def slice_check(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """31 bits that tell slices apart independently of slice_hash."""
    return (prefix[end] - prefix[start]) % PRIME * _powers("inverse31", _geometric31, _INVERSE31, len(prefix))[start] % PRIME


def strong_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of the slices from both polynomials, for slices that are not compared afterwards; ascending slices are hashed BLOCK by BLOCK."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        base = start[i]
        own, a, b = values[base : end[j - 1]], start[i:j] - base, end[i:j] - base
        out[i:j] = mix(slice_hash(prefix_hash(own), a, b) ^ slice_check(prefix_check(own), a, b) * _M1)
        i = j
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts with a space after each, and the offset at which each begins."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b" ".join([*texts, b""]) if texts else b"", np.uint8), offsets


def words(texts: list[bytes], spaced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end (in the joined bytes) and text index of every word of all texts."""
    flat, offsets = joined(texts)
    if spaced:
        inside, values = ~SPACE_BYTES[flat], SPACED[flat]
    else:
        values = WORD[flat]
        inside = values != 0
    step = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets)))
    return strong_hash(values, start, end), start, end, owner


def portions(sizes, limit: int):
    """Slices of a list whose sizes add up to about limit; a larger single item stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def shingles(word_hash: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of every run of ``width`` words of one text; a text of fewer words, but not none, is one run."""
    n = len(word_hash)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(max(0, n - width + 1), U64)
    for k in range(width):
        out = (out ^ word_hash[k : k + len(out)]) * _M1
        out ^= out >> U64(32)
    whole = owner[: len(out)] == owner[width - 1 :] if len(out) else np.zeros(0, bool)
    out, own = out[whole], owner[: len(whole)][whole]
    count = np.bincount(owner)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = np.zeros(len(short), U64)
        for k in range(width - 1):
            on = count[short] > k
            extra[on] = (extra[on] ^ word_hash[first[on] + k]) * _M1
            extra ^= extra >> U64(32)
        out, own = np.concatenate([out, mix(extra + count[short].astype(U64))]), np.concatenate([own, short])
    return mix(out), own
