"""Sets of word shingles of texts, and their parity sketches, in numpy."""

from __future__ import annotations

import numpy as np

from lumiray.llm.common import hash_bytes, mix64

WORDS = 5
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_PART, _BIT, _VALUE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of five words, text by text and ascending, and how many each text has.

    A-Z are lower-cased; words are runs without ASCII blanks. One to four words are one shingle; a text
    without words has none."""
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(t.lower() + b"\n" for t in texts), dtype=np.uint8)
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    words = hash_bytes(data, starts, ends)
    of = np.repeat(np.arange(len(texts)), lengths)[starts]
    counts = np.bincount(of, minlength=len(texts))
    n = len(words)
    padded = np.append(words, np.zeros(WORDS, dtype=np.uint64))
    mixed = np.zeros(n, dtype=np.uint64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end of the text
    size = np.minimum(left, WORDS)
    for k in range(WORDS):
        mixed += np.where(size > k, padded[k : k + n] * _FACTORS[k], np.uint64(0))
    mixed = mix64(mixed ^ size.astype(np.uint64))
    first = np.arange(n) == np.repeat(np.cumsum(counts) - counts, counts)
    use = (left >= WORDS) | first
    return distinct(of[use], mixed[use], len(texts))


def distinct(of: np.ndarray, values: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[new], np.bincount(of[new], minlength=texts)


def _bounds() -> np.ndarray:
    """First sizes of the bands: each band's largest size is less than 4/3 of its smallest, plus one."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 4 // 3 + 1)
    return np.array(out, dtype=np.int64)


BOUNDS = _bounds()


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(BOUNDS, sizes, "right") - 1


def largest(band: np.ndarray) -> np.ndarray:
    """The largest size in a band."""
    return BOUNDS[band + 1] - 1


def least_shared(band: np.ndarray) -> np.ndarray:
    """How many keys two texts share at least if they may link in a band: one in 64 of its shingles, so that longer texts
    do not meet by chance."""
    return 1 + largest(band) // 64


def sketch_bits(band: np.ndarray) -> np.ndarray:
    """Bits of a band's parity sketches, about one for a shingle."""
    return (largest(band) + 63) // 64 * 64


def parity_sketches(values: np.ndarray, counts: np.ndarray, band: np.ndarray) -> list[bytes]:
    """A sketch for each text: every shingle flips one bit. Bits that differ between two sketches of a
    band are at most as many as shingles that only one of the texts has."""
    bits = sketch_bits(band)
    base = np.cumsum(bits) - bits
    at = np.repeat(base, counts) + (mix64(values * _BIT) % np.repeat(bits, counts).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    packed = np.packbits(parity).tobytes()
    return [packed[b // 8 : (b + s) // 8] for b, s in zip(base.tolist(), bits.tolist(), strict=True)]


def part_keys(values: np.ndarray, counts: np.ndarray, band: np.ndarray, bound: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of texts taking part in a band, and how many each has.

    The band's sketch has as many words as its largest size has shingles; a shingle is XORed into one
    word. A shingle that only one of two texts has spoils one word at most, so that of `bound` such
    shingles at least (words in use - bound) words stay equal. Of each text the first bound + `least_shared`
    words are keys, in an order that puts words first whose rarest shingle is rare (`weight` of a shingle), then
    goes by hash: two texts within the bound share at least `least_shared` of them. A text that uses fewer words
    than that gives as many first shingles as well, which two such texts share in the same way."""
    parts = np.maximum(largest(band), 64)
    of = np.repeat(np.arange(len(counts)), counts)
    part = (mix64(values * _PART) % np.repeat(parts, counts).astype(np.uint64)).astype(np.int64)
    order = np.argsort(of * int(parts.max(initial=1)) + part, kind="stable")
    of_, part_ = of[order], part[order]
    new = np.flatnonzero(np.append(True, (of_[1:] != of_[:-1]) | (part_[1:] != part_[:-1]))[: len(of_)])
    if not len(new):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(counts), dtype=np.int64)
    word = np.bitwise_xor.reduceat(mix64(values[order] * _VALUE), new)
    rare = np.minimum.reduceat(weight[order], new)
    who = of_[new]
    used = np.bincount(who, minlength=len(counts))
    place = mix64((np.repeat(band, used).astype(np.uint64) << np.uint64(44)) ^ part_[new].astype(np.uint64))
    keys, key_of = [mix64(word ^ place)], [who]
    weights = [rare]
    most = bound + least_shared(band)
    limit = np.minimum(most, used)
    keys, key_of = _first(keys[0], weights[0], who, limit)
    poor = used < most
    if poor.any():
        own = poor[of]
        mark = np.repeat(band, counts)[own].astype(np.uint64) + np.uint64(1 << 20)
        more, more_of = _first(mix64(values[own] ^ mix64(mark)), weight[own], of[own], most)
        keys, key_of = np.append(keys, more), np.append(key_of, more_of)
        order = np.argsort(key_of, kind="stable")
        keys, key_of = keys[order], key_of[order]
    return keys, np.bincount(key_of, minlength=len(counts))


def _first(keys: np.ndarray, weight: np.ndarray, of: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `limit` keys of each text by weight and key."""
    order = np.lexsort((keys, weight, of))
    of = of[order]
    counts = np.bincount(of, minlength=len(limit))
    rank = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    use = rank < limit[of]
    return keys[order][use], of[use]
