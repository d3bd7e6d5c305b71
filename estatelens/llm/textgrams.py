"""Words, lines and word n-grams of many texts at once, as 64-bit hashes in numpy.

Words are runs of anything but ASCII white space. A word's hash is a polynomial over its bytes, an n-gram's hash
a rolling polynomial over its words; both are taken modulo 2**64 and scrambled.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_random = np.random.default_rng(20240229)
BYTE_CODE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), from a table that grows as needed."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, codes: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """Hash of data[starts[k]:starts[k+1]] for each k, without the bytes marked in `skip`."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths) if starts[0] == 0 else None
    if place is None:
        data, skip = data[starts[0]:], skip[starts[0]:] if skip is not None else None
        starts = starts - starts[0]
        place = np.arange(len(data)) - np.repeat(starts, lengths)
    values = codes[data] * powers(BASE, int(lengths.max()))[place]
    if skip is not None:
        values[skip] = 0
    return np.add.reduceat(values, starts)


def sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[k]:bounds[k+1]]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Texts:
    """The words of a slice of texts.

    doc: text number of each word; first: number of the first word of each text (one more at the end);
    hashes: 64 bits a word; chars: code points a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.space = SPACE[data]
        begin = ~self.space
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin[1:] &= self.space[:-1] | edge[1:-1]
        self.starts = np.flatnonzero(begin)
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)
        self.hashes = scramble(run_hashes(data, self.starts, LOWER_CODE if lower else BYTE_CODE, self.space))
        self._prefix = None

    @property
    def chars(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.int64)
        point = ((self.data & 0xC0) != 0x80) & ~self.space
        return np.add.reduceat(point, self.starts, dtype=np.int64)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all n-word windows that lie in one text, and their hashes."""
        m = len(self.hashes)
        if self._prefix is None:
            self._prefix = np.zeros(m + 1, np.uint64)
            np.cumsum(self.hashes * powers(BASE, m), out=self._prefix[1:])
        if m < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.first[1:], self.counts)[:m - n + 1]
        at = np.flatnonzero(np.arange(n, m + 1) <= last)
        return at, scramble((self._prefix[at + n] - self._prefix[at]) * powers(BASE_INVERSE, m)[at])


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    coarse = np.zeros(1 << 18, bool)
    coarse[twice >> U(46)] = True
    out = coarse[keys >> U(46)]
    maybe = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(twice, keys[maybe]), len(twice) - 1)
    out[maybe] = twice[place] == keys[maybe]
    return out
