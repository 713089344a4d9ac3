"""Array arithmetic over the code points of whole texts.

Texts are joined and viewed as one array of code points, so that word and
window hashes of thousands of texts come out of a few numpy passes instead of
a Python loop over characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_alnum: np.ndarray | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        base = np.full(size, _BASE)
        back = np.full(size, _BASE_INV)
        base[0] = back[0] = np.uint64(1)
        _powers, _inverse = np.cumprod(base), np.cumprod(back)
    return _powers, _inverse


def alnum_table() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(i).isalnum() for i in range(0x110000)), np.bool_, 0x110000)
    return _alnum


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins (one more entry than texts)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, bounds


def slabs(texts: list[str | None], chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``chars`` characters together, with the first one's index."""
    start, total, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and total + len(t) > chars:
            yield start, part
            start, total, part = i, 0, []
        part.append(t)
        total += len(t)
    if part:
        yield start, part


def composed_lower(text: str | None) -> str:
    return unicodedata.normalize("NFC", (text or "").lower())


def word_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, word hash) of every distinct word of every text, ordered by both.

    A word is a run of letters and digits; texts must already be in lower case.
    """
    cp, bounds = code_points(texts)
    if not len(cp):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = alnum_table()[cp]
    first = np.zeros(len(cp), np.bool_)
    first[bounds[:-1][bounds[:-1] < len(cp)]] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (first | ~before))
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    after_first = np.append(first[1:], True)
    after = np.append(inside[1:], False)
    end = np.flatnonzero(inside & (after_first | ~after)) + 1
    power, inverse = _power_tables(len(cp) + 1)
    term = np.append((cp.astype(np.uint64) + np.uint64(1)) * power[: len(cp)], np.uint64(0))
    edges = np.empty(2 * len(begin), np.int64)
    edges[::2], edges[1::2] = begin, end
    h = np.add.reduceat(term, edges)[::2] * inverse[begin]
    h = mix(h + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(bounds, begin, side="right") - 1
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
    return doc[new], h[new]


def window_hashes(cp: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` consecutive code points."""
    n = len(cp) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(cp) + 1)
    total = np.empty(len(cp) + 1, np.uint64)
    total[0] = 0
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * power[: len(cp)], out=total[1:])
    h = total[width:] - total[:n]
    h *= inverse[:n]
    return mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, from prefix and suffix minima of blocks."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, h.dtype)
    pad = -len(h) % width
    x = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, h.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.uint64)
