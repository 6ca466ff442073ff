"""Sets of five-word shingles as sorted 64-bit hashes, and what is derived from one set."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
BINS, BANDS = 32, 8
# odd 64-bit multipliers, one for each place in a shingle
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                        0xA0761D6478BD642F], dtype=np.uint64)
EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(59))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(29))) * MULTIPLIERS[2]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Shingle sets of texts; hashes of words are remembered up to a bound."""

    def __init__(self, remember: int = 100_000):
        self.remember, self.known = remember, {}

    def set_of(self, raw: bytes) -> np.ndarray:
        """Sorted distinct hashes of the shingles of a UTF-8 text.

        On bytes, lower() changes A-Z and split() cuts at the six ASCII blanks: the contract's words.
        """
        words = raw.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        if len(h) < WORDS:
            return _mix((h * MULTIPLIERS[:len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
        n = len(h) - WORDS + 1
        x = h[:n] * MULTIPLIERS[0]
        for k in range(1, WORDS):
            x += _mix(h[k:k + n] + np.uint64(k)) * MULTIPLIERS[k]
        return np.unique(_mix(x))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def set_id(shingles: np.ndarray) -> int:
    """One 64-bit number for a whole set."""
    return signed(xxhash.xxh3_64_intdigest(shingles.tobytes()))


def bands(shingles: np.ndarray) -> list[int]:
    """Keys that similar sets are likely to share: hashes of four smallest-in-bin shingles each.

    An empty bin takes the next larger shingle, round the end if need be.
    """
    least = shingles[np.searchsorted(shingles, EDGES) % len(shingles)].reshape(BANDS, -1)
    return [signed(xxhash.xxh3_64_intdigest(row.tobytes(), seed=k)) for k, row in enumerate(least)]


def prefix_length(n: int, percent: int = 80) -> int:
    """So many first shingles, in any common order, that sets linked at ``percent`` share one of them."""
    return n - -(-percent * n // 100) + 1


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of at least four bits a shingle, as bytes: each bit is the parity of the shingles hashed to it.

    The number of bits is a power of two, so that a larger bitmap folds onto a smaller one.
    """
    size = max(64, 1 << int(4 * max(1, len(shingles)) - 1).bit_length())
    at = (shingles >> np.uint64(20)) & np.uint64(size - 1)
    odd = np.bincount(at.astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little")


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, at most the number of shingles that only one of the sets has."""
    if len(a) < len(b):
        a, b = b, a
    x = np.frombuffer(a, np.uint8)
    while len(x) > len(b):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int.from_bytes((x ^ np.frombuffer(b, np.uint8)).tobytes(), "little").bit_count()
