"""Periodic runs of words, by branching tandem repeats on an enhanced suffix array.

The words of many texts are numbered and laid end to end, each text closed by a number of its own, so that no repeat
crosses two texts. The suffix array comes from prefix doubling; the ranks of every round are kept and tell whether
two stretches of 2**k words are equal, which gives all longest common prefixes and all extensions to the left.
A bound between two neighbours of the suffix array with common prefix d cuts its LCP interval in two; for every suffix
i of the smaller side ISA[i + d] and ISA[i - d] tell whether a suffix at distance d lies on the other side. If so, the
two form a square of period d that cannot be rotated to the right. Rotated to the left as far as it goes, it is the
whole stretch of that period; squares of one stretch are merged into the run with the smallest period. The tree of
intervals is never built.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# A run has at least so many words, and at least so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
# Suffixes that one numpy step looks up.
STEP = 1 << 20
# Every so many documents by their checksum is made periodic before the search.
MADE_EVERY = 10


def suffix_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of all stretches of 1, 2, 4, ... numbers, until all differ; the last is the inverse suffix array.

    `codes` ends in a number that occurs once, and so does every text in it.
    """
    n = len(codes)

    def heads(keys: np.ndarray) -> np.ndarray:
        """First place of the group of equal keys that each place is in."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        return np.repeat(starts, np.diff(np.append(starts, len(keys))))

    order = np.argsort(codes, kind="stable")
    group = heads(codes[order])
    rank = np.empty(n, np.int32)
    rank[order] = group
    shared = np.bincount(group, minlength=n)
    levels, width = [rank], 1
    at = np.flatnonzero(shared[rank] > 1)
    while len(at):
        keys = rank[at].astype(np.int64) * n + rank[at + width]
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        old = rank[at]
        group = heads(keys)
        rank = rank.copy()
        rank[at] = old + (group - heads(old))
        levels.append(rank)
        width *= 2
        at = at[np.bincount(group, minlength=len(at))[group] > 1]
    return levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and at b, which differ."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    return length


def rotations(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers before a and before b (a < b) are equal."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        left, right = a - length - (1 << k), b - length - (1 << k)
        inside = left >= 0
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][left[inside]] == levels[k][right[inside]]
        length += same.astype(np.int64) << k
    return length


def interval_ends(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds p with lcp[p] > 0, between the places p - 1 and p, and the first and last place of what each cuts in two.

    That is p's LCP interval, without what equal bounds before p have cut off.
    """
    places = np.flatnonzero(lcp > 0)
    lows, highs = [0] * len(places), [0] * len(places)
    stack: list[tuple[int, int, int]] = []
    last = first = -2
    for k, (p, value) in enumerate(zip(places.tolist(), lcp[places].tolist(), strict=True)):
        if p != last + 1:
            for _, _, other in stack:
                highs[other] = last
            stack, first = [], p - 1
        while stack and stack[-1][0] > value:
            highs[stack.pop()[2]] = p - 1
        lows[k] = stack[-1][1] if stack else first
        stack.append((value, p, k))
        last = p
    for _, _, other in stack:
        highs[other] = last
    return places, np.array(lows, np.int64), np.array(highs, np.int64)


def branching_squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square that cannot be rotated to the right."""
    place = levels[-1].astype(np.int64)
    n = len(place)
    suffix = np.empty(n, np.int64)
    suffix[place] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_prefixes(levels, suffix[:-1], suffix[1:])
    at, low, high = interval_ends(lcp)
    left = at - low <= high - at + 1
    # The smaller side is [begin, begin + size), the other one [other, end].
    begin, size = np.where(left, low, at), np.where(left, at - low, high - at + 1)
    other, end, depth = np.where(left, at, low), np.where(left, high, at - 1), lcp[at]
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, total[a] + STEP, "right")) - 1)
        which = np.repeat(np.arange(a, b), size[a:b])
        own = suffix[begin[which] + np.arange(len(which)) - (total[which] - total[a])]
        for sign in (1, -1):
            far = own + sign * depth[which]
            inside = (far >= 0) & (far < n)
            found = place[np.where(inside, far, 0)]
            met = np.flatnonzero(inside & (found >= other[which]) & (found <= end[which]))
            starts.append(np.minimum(own[met], far[met]))
            periods.append(depth[which[met]])
        a = b
    return np.concatenate(starts), np.concatenate(periods)


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of `codes`, by start, then period."""
    levels = suffix_ranks(codes)
    start, period = branching_squares(levels)
    before = rotations(levels, start, start + period)
    start, length = start - before, 2 * period + before
    long = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
    start, length, period = start[long], length[long], period[long]
    # Squares of multiples of a period stretch as far as the run itself, which comes first here.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def made_periodic(doc_id: int | None, n: int) -> np.ndarray | None:
    """Numbers of the words that stand for the n words of a text, or None if they stay.

    Of every MADE_EVERY documents, by the checksum of the id, one is made periodic from some word on. A document
    without id stays.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(b"%d" % doc_id)
    if h % MADE_EVERY:
        return None
    g = h // MADE_EVERY
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def find_runs(ids: list[int | None], texts: list[bytes | None], rewrite: bool) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its words and the start, length and period of its runs."""
    numbers: dict[bytes, int] = {}
    words, sizes = [], []
    for doc_id, text in zip(ids, texts, strict=True):
        # bytes.split() cuts at exactly the white space of ASCII.
        own = (text or b"").split()
        at = made_periodic(doc_id, len(own)) if rewrite else None
        words.append(own if at is None else [own[k] for k in at.tolist()])
        sizes.append(len(own))
    ends = np.cumsum(np.array(sizes, np.int64) + 1)
    begins = ends - np.array(sizes, np.int64) - 1
    codes = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for own, begin in zip(words, begins.tolist(), strict=True):
        codes[begin:begin + len(own)] = [numbers.setdefault(w, len(numbers)) for w in own]
    codes[ends - 1] = len(numbers) + np.arange(len(ends))
    start, length, period = runs(codes)
    bounds = np.searchsorted(start, np.append(begins, len(codes)))
    for k, own in enumerate(words):
        low, high = bounds[k], bounds[k + 1]
        yield own, start[low:high] - begins[k], length[low:high], period[low:high]


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words joined by one space, of each run only the first period."""
    if len(start):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, rewrite: bool = False, texts: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and two checksums of every row of `docs`.

    A run is a stretch of consecutive words with smallest period q, of MIN_WORDS words and MIN_PERIODS periods at
    least, that keeps its period and cannot be longer. Of runs of equal length the one with the smallest start, then
    period, is the longest. runs_sha256 is of all runs as lines `start,length,period`, collapsed_sha256 of the text in
    which every run is cut to its first period. With `texts` that text follows as `collapsed`. With `rewrite` some
    documents are made periodic first (`made_periodic`).

    Null and empty texts have no words, so no runs and the checksums of nothing. Rows are judged one by one: repeated
    rows and rows without id give a row each (without id never made periodic), an empty table none. Other columns are
    not read. A text is in one task as a whole, whatever its length; texts are searched in slices of 2 MB.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            column = part.column("text").cast(pa.large_binary()).to_pylist()
            rows = []
            for doc_id, (words, start, length, period) in zip(ids, find_runs(ids, column, rewrite), strict=True):
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                # argmax takes the first of equal lengths, and runs lie by start, then period.
                best = int(length.argmax()) if len(start) else None
                longest = (None,) * 4 if best is None else (
                    int(start[best]), int(length[best]), int(period[best]), 1000 * int(length[best]) // int(period[best]))
                rest = collapsed(words, start, length, period)
                rows.append((doc_id, len(start), *longest, sha256(lines.encode()).hexdigest(), sha256(rest).hexdigest(), rest))
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
            columns = list(zip(*rows, strict=True))
            out = {name: pa.array(values, pa.int64()) for name, values in zip(names, columns, strict=False)}
            out |= {"runs_sha256": pa.array(columns[6]), "collapsed_sha256": pa.array(columns[7])}
            if texts:
                out["collapsed"] = pa.array(columns[8], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
        "collapsed_sha256 string" + (", collapsed string" if texts else ""))
