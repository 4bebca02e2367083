"""Content-defined anchors: which suffixes of a text a sparse suffix sort has to hold."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at each position.
GRAM = 32
_POSITION_BITS = 24


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit value of the GRAM bytes from each position, which depends on these bytes alone.  data: uint8."""
    x = data.astype(np.uint64)
    step, odd = 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        x = x[:-step] * np.uint64(odd) + (x[step:] ^ (x[step:] >> np.uint64(29)))
        odd = (odd * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64 | 1
        step *= 2
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def anchor_runs(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor, key): windows starting in first..last lie in one text and have their least gram at anchor.

    data holds texts one behind the other, ends[i] is the end of text i; at most 16 MB.  The choice (leftmost of the
    least values) depends on a window's bytes alone: equal windows have anchors at equal distances, with equal keys.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - window + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(data)
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    v = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    span, have = window - GRAM + 1, 1
    while have * 2 <= span:
        v, have = np.minimum(v[:-have], v[have:]), have * 2
    if have < span:
        v = np.minimum(v[: have - span], v[span - have :])
    at = (v & mask).astype(np.int64)
    # windows that reach over a text's end belong to no run
    whole = np.ones(n + 1, np.int8)
    whole[n] = 0
    for e in ends.tolist():
        whole[max(0, e - window + 1) : e] = 0
    whole = whole[:n].astype(bool)
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, n - 1)
    keep = whole[first]
    first, last = first[keep], last[keep]
    return first, last, at[first], h[at[first]]


def blocks(texts: list[bytes], window: int, size: int = 1 << 18, longest: int = 1 << 23):
    """Yield (bytes, ends, [(text number, its first byte's place in the text)]): texts joined to blocks of about ``size``.

    A text over ``longest`` bytes is cut into pieces that overlap by window - 1, so each of its windows is in one piece.
    """
    parts, owners, held = [], [], 0
    for i, t in enumerate(texts):
        if len(t) < window:
            continue
        for at in range(0, max(1, len(t) - window + 1), longest):
            piece = t if len(t) <= longest + window - 1 else t[at : at + longest + window - 1]
            parts.append(piece)
            owners.append((i, at))
            held += len(piece)
            if held >= size:
                yield b"".join(parts), np.cumsum([len(p) for p in parts]), owners
                parts, owners, held = [], [], 0
    if parts:
        yield b"".join(parts), np.cumsum([len(p) for p in parts]), owners
