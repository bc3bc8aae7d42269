"""Word-shingle sets and MinHash sketches of whole texts, in numpy.

A document is a sequence of words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased.  Its set holds the distinct
runs of ``width`` words; a text with fewer words than that has one element, the whole sequence; a text without
words, or a null, has the empty set.  Elements are kept as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Odd multipliers of the 64-bit mixing steps (fixed values).
MIX_A, MIX_B, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased text: bytes.lower() and bytes.split() treat exactly A-Z and \\x20, \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: A random 64-bit value per byte, and the odd base of the polynomial (fixed by the generator's seed).
TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``data`` and their first bytes' places, without a step per word.

    A word's hash is the polynomial of its bytes' values modulo 2**64, times the base's power that takes its place
    out, mixed.
    """
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], SPACE[raw], [True]))
    edge = space[1:] != space[:-1]
    starts, ends = np.flatnonzero(edge & space[:-1]), np.flatnonzero(edge & space[1:])
    with np.errstate(over="ignore"):
        powers = np.full(len(raw) + 1, BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(TABLE[raw] * powers[:-1], out=sums[1:])
        back = np.full(len(raw) + 1, pow(BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str | None], width: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    hashes, starts = word_hashes(b"\n".join(raw))
    begins = np.cumsum([0, *(len(x) + 1 for x in raw)])
    first = np.searchsorted(starts, begins)
    out = []
    with np.errstate(over="ignore"):
        grams = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
        for k in range(width):
            grams = mix(grams * GOLDEN + hashes[k : k + len(grams)])
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= width:
                own = np.sort(grams[lo : hi - width + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif hi > lo:
                whole = np.array([hi - lo], np.uint64)
                for x in hashes[lo:hi]:
                    whole = mix(whole * GOLDEN + x)
                out.append(whole)
            else:
                out.append(hashes[:0])
    return out


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """For non-empty sets, a row of n 32-bit minima each: hash k of an element is mix(element + k * GOLDEN)'s upper half."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), n), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n):
            x = (flat ^ (flat >> np.uint64(29))) * (np.uint64(2 * k + 3) * MIX_A + np.uint64(2 * k))
            x = (x ^ (x >> np.uint64(32))) * MIX_B
            out[:, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts)
    return out


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``most``; a larger row is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)
