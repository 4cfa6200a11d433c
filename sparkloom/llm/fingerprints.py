"""64-bit hashes of the words and bytes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from sparkloom.llm.common import stretches

U = np.uint64
#: Multiplier of the byte positions and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_powers: dict[int, np.ndarray] = {}
KEPT_POWERS = 1 << 20
#: Letters of text that are hashed at a time, unless one text is longer.
TOGETHER = 500_000


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; at most ``KEPT_POWERS`` of them stay in memory."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, min(KEPT_POWERS, 1 << max(16, n.bit_length()))), base, U)
        got[0] = 1
        with np.errstate(over="ignore"):
            got = np.multiply.accumulate(got)
        if len(got) <= KEPT_POWERS:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of letter * BASE^position: any substring's hash is a difference of two, moved back."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_LETTERS[data] * powers(BASE, len(data)), out=out[1:])
    return out


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every white-space separated word, lower case."""
    hashes, where = [], []
    for at, end in stretches(texts, TOGETHER):
        h, w = _hash_some(texts[at:end])
        hashes.append(h)
        where.append(w + at)
    return (np.concatenate(hashes), np.concatenate(where)) if hashes else (np.zeros(0, U), np.zeros(0, np.int64))


def _hash_some(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    sums = prefix_sums(data)
    hashes = mix((sums[ends] - sums[starts]) * powers(INVERSE, len(data))[starts] + (ends - starts).astype(U))
    upto = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.searchsorted(upto, starts, side="right")


def shingles(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every run of size words; a shorter text with words is one run itself."""
    words, where = hash_words(texts)
    n = len(words)
    if n == 0:
        return words, where
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    total = np.zeros(n, U)
    factor = powers(0xD1B54A32D192ED03, size + 1)
    left = np.repeat(first + count, count) - np.arange(n)  # words from here to the end of the text
    for k in range(size):
        take = np.flatnonzero(left > k)
        total[take] += words[take + k] * factor[k + 1]
    keep = (left >= size) | ((np.repeat(count, count) < size) & (np.repeat(first, count) == np.arange(n)))
    return mix(total[keep]), where[keep]
