"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text hashed at once, but for a longer single word.
BLOCK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw``, A-Z lower-cased, and where they start. A word's hash is its part of one running polynomial."""
    data = np.frombuffer(raw, dtype=np.uint8)
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = max(2 * BLOCK, 1 << (len(data) + 1).bit_length())
    up, down = _powers(size)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
    return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64)), start


def parts_at_spaces(raw: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """``raw`` in parts of about ``size`` bytes that end at white space (a longer word stays whole)."""
    at = 0
    while len(raw) - at > size:
        end = SPACE.search(raw, at + size)
        if end is None:
            break
        yield raw[at : end.end()]
        at = end.end()
    yield raw[at:]


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of one text, read in parts."""
    return np.concatenate([_words(part)[0] for part in parts_at_spaces(raw)])


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    out = np.full(max(0, len(words) - k + 1), np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = mixed(out * _BASE + words[j : j + len(out)])
    return out


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of k words; with fewer words, of the whole sequence; none without words."""
    out: list[np.ndarray] = []
    block: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal held
        words, start = _words(b"\n".join(block))
        ends = np.cumsum([len(b) + 1 for b in block])
        bounds = np.concatenate([[0], np.searchsorted(start, ends)])
        all_shingles = _shingles(words, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(all_shingles[a : b - k + 1]))
            else:
                out.append(_shingles(words[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64))
        block.clear()
        held = 0

    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if len(raw) > BLOCK:
            if block:
                flush()
            words = word_hashes(raw)
            n = min(k, len(words))
            out.append(np.unique(_shingles(words, n)) if n else words)
            continue
        block.append(raw)
        held += len(raw) + 1
        if held >= BLOCK // 2:
            flush()
    if block:
        flush()
    return out
