"""Distinct word shingles of whole texts as 64-bit hashes, vectorised over Arrow buffers.

Words are runs of bytes other than space and U+0009..U+000D, with A-Z lower-cased. A shingle is ``k`` consecutive
words; a text of fewer words is one shingle. Two different shingles get the same 64-bit hash with probability 2**-64.
"""

from __future__ import annotations

import numpy as np

from veilspark.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 19

_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    name = f"p{base}"
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        out = np.ones(size, np.uint64)
        filled, step = 1, base
        while filled < size:
            take = min(filled, size - filled)
            out[filled : filled + take] = out[:take] * np.uint64(step)
            filled, step = filled + take, step * step % (1 << 64)
        _tables[name] = have = out
    return have


def _byte_codes() -> np.ndarray:
    if "codes" not in _tables:
        codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
        _tables["codes"] = codes
        word = np.ones(256, bool)
        word[[9, 10, 11, 12, 13, 32]] = False
        _tables["word"] = word
    return _tables["codes"]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and for each text the index of its first word (one more entry at the end)."""
    codes, is_word = _byte_codes(), _tables["word"]
    found, starts_at = [], []
    at, total = 0, len(data)
    while at < total:
        stop = min(at + _SEGMENT, total)
        while stop < total:  # a segment ends at a separator or at a text's end, never inside a word
            seps = np.flatnonzero(~is_word[data[at:stop]])
            bound = int(ends[np.searchsorted(ends, stop, side="right") - 1])
            last = max(at + int(seps[-1]) + 1 if len(seps) else at, bound)
            if last > at:
                stop = last
                break
            stop = min(stop + _SEGMENT, total)
        part = data[at:stop]
        word = is_word[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        bounds = ends[np.searchsorted(ends, at) : np.searchsorted(ends, stop)] - at
        first[bounds] = word[bounds]
        start = np.flatnonzero(first)
        if len(start):
            final = word.copy()
            final[:-1] &= ~word[1:] | first[1:]
            end = np.flatnonzero(final) + 1
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(codes[part] * _powers(_BASE, len(part))[: len(part)], out=run[1:])
            h = (run[end] - run[start]) * _powers(_INVERSE, len(part))[start]
            found.append(mix64(h + (end - start).astype(np.uint64)))
            starts_at.append(start + at)
        at = stop
    words = np.concatenate(found) if found else np.zeros(0, np.uint64)
    starts = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return words, np.searchsorted(starts, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int = 5):
    """Yield for each text its distinct shingle hashes, ascending."""
    words, first = word_hashes(data, ends)
    n = len(words)
    if n >= k:
        rolled = words[: n - k + 1].copy()
        for i in range(1, k):
            rolled *= np.uint64(0xC2B2AE3D27D4EB4F)
            rolled += words[i : n - k + 1 + i]
        rolled = mix64(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out = np.sort(rolled[a : b - k + 1])
            yield out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) > 1 else out
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(0x165667B19E3779F9) + w
            yield mix64(np.array([h], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
