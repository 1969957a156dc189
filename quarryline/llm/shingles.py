"""Sets of word shingles, hashed for many texts at once.

A word's hash is a polynomial in its bytes modulo 2^64, with a random number for
each byte value and A-Z as a-z, mixed at the end; a shingle's hash follows from
those of its words.  Both are array operations over whole blocks of texts, and
no table of words is kept.  Two shingles share a hash with a probability of
about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that are worked on at once.
PIECE = 1 << 18

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_POWERS = np.full(PIECE, _BASE, np.uint64)
_POWERS[0] = 1
np.multiply.accumulate(_POWERS, out=_POWERS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomials and places of the words of ``PIECE`` bytes at most; a word ends where a text begins."""
    ink = ~_BLANK[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    first[begins] = ink[begins]
    at = np.flatnonzero(ink)
    if not len(at):
        return np.empty(0, np.uint64), at
    word = np.flatnonzero(first[at])
    place = np.arange(len(at)) - np.repeat(word, np.diff(np.append(word, len(at))))
    return np.add.reduceat(_BYTE[data[at]] * _POWERS[place], word), at[word]


def _long_words(text: bytes) -> np.ndarray:
    """Polynomials of a text of any length, piece by piece; a word may go on over several pieces."""
    done: list[np.ndarray] = []
    open_, size = np.empty(0, np.uint64), 0  # the word that the piece before ended in, and its bytes
    for begin in range(0, len(text), PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE, len(text) - begin), begin)
        h, at = _words(data, np.zeros(1, np.int64))
        if size and not _BLANK[data[0]]:
            h[:1] = open_ + h[:1] * np.uint64(pow(_BASE, size, 1 << 64))
        else:
            done.append(open_)
            size = 0
        if _BLANK[data[-1]]:
            open_, size = np.empty(0, np.uint64), 0
        else:
            size = len(data) - int(at[-1]) + (size if len(h) == 1 and at[0] == 0 else 0)
            h, open_ = h[:-1], h[-1:]
        done.append(h)
    return np.concatenate([*done, open_]) if done else open_


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def _folded(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix(out * _GOLD + words[i : i + n])
    return out


def _set(words: np.ndarray, k: int) -> np.ndarray:
    return _distinct(_folded(words, min(k, len(words)))) if len(words) else words


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+``.  With fewer than ``k`` words the whole
    sequence is the one shingle; without words there is none.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= PIECE:
            size += len(texts[end])
            end += 1
        if end == at:
            yield _set(mix(_long_words(texts[at])), k)
            at += 1
            continue
        border = np.cumsum([0, *map(len, texts[at:end])])
        words, places = _words(np.frombuffer(b"".join(texts[at:end]), np.uint8), border[:-1][border[:-1] < size])
        words = mix(words)
        runs = _folded(words, k) if len(words) >= k else words[:0]
        border = np.searchsorted(places, border)
        for a, b in zip(border[:-1], border[1:]):
            yield _distinct(runs[a : b - k + 1]) if b - a >= k else _set(words[a:b], k)
        at = end
