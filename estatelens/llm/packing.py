"""Packing token sequences by length patterns fitted with non-negative least squares.

Patterns are up to three lengths, in units of BIN tokens, that add up to a full sequence. Non-negative least squares
fits how often each pattern is used to the histogram of lengths; the counts are rounded down and filled with exact
lengths, the last one chosen to close the gap. What is left over goes, longest first, where it fits best. All of
this works on counts by length (at most SEQUENCE numbers), never on documents; documents then look up their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import discard, materialize
from .common import slices
from .ranking import ranked
from .tokens import BYTES, TOKEN_SLICE, encoder

SEQUENCE = 2048
BIN = 16
END = 0
PARTS = 128


def piece_bounds(n: int, size: int = SEQUENCE) -> list[int]:
    """Starts of the pieces of n tokens, and n; only the first piece may be shorter than `size`."""
    return [0, *range(n % size or size, n + 1, size)]


def pieces(docs: DataFrame, tokenizer: str = BYTES) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every whole text, with END behind its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part in slices(batches, "text", TOKEN_SLICE):
            at, piece, start, length, crc = [], [], [], [], []
            for k, found in enumerate(encode.batch(part.column("text"))):
                ids = np.frombuffer(found + END.to_bytes(2, "little"), "<u2").astype("<u4")
                bounds = piece_bounds(len(ids))
                for p, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    at.append(k), piece.append(p), start.append(low), length.append(high - low)
                    crc.append(zlib.crc32(ids[low:high]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").take(pa.array(at, pa.int64())), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets; the last feasible x if `rounds` are not enough.

    Any feasible x is good for packing: what it leaves over is packed as residue.
    """
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * max(1.0, b.max()):
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            part = a[:, at]
            try:
                trial = np.linalg.solve(part.T @ part, part.T @ b)
            except np.linalg.LinAlgError:
                trial = np.linalg.lstsq(part, b, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            bad = trial <= 0
            old = x[at]
            step = np.min(old[bad] / np.maximum(old[bad] - trial[bad], 1e-300))
            x[at] = old + step * (trial - old)
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
    return x


def patterns(bins: np.ndarray, whole: int) -> list[tuple[int, ...]]:
    """Descending tuples of up to three of `bins` that fill `whole`.

    A length lies half a bin below its bin's end on average, so two or three parts may name one bin more.
    """
    have, out = set(bins.tolist()), []
    for a in sorted(have, reverse=True):
        if a == whole:
            out.append((a,))
        for b in have:
            c = whole + 1 - a - b
            if b <= a and (c == 0 or c in have and c <= b):
                out.append((a, b, c) if c else (a, b))
    return out


class Plan:
    """Groups of sequences that are filled alike: [first sequence, count, space left, slots (length, first rank, offset)]."""

    def __init__(self, size: int):
        self.size, self.groups, self.sequences = size, [], 0
        self.by_space: list[list[list]] = [[] for _ in range(size + 1)]
        self.rank = np.zeros(size + 1, np.int64)

    def opened(self, count: int) -> list:
        group = [self.sequences, count, self.size, []]
        self.sequences += count
        return group

    def put(self, group: list, length: int, count: int) -> list | None:
        """Put one piece of `length` in the first `count` sequences of the group; what is left of the group."""
        first, n, space, slots = group
        rest = None
        if count < n:
            rest = [first + count, n - count, space, [(le, ra + count, of) for le, ra, of in slots]]
        group[1], group[2], group[3] = count, space - length, [*slots, (length, int(self.rank[length]), self.size - space)]
        self.rank[length] += count
        return rest

    def shelve(self, group: list) -> None:
        self.groups.append(group)
        self.by_space[group[2]].append(group)

    def place_best(self, length: int, count: int) -> None:
        """Put `count` pieces of one length, each where the least space remains, else in new sequences."""
        for space in range(length, self.size + 1):
            while count and self.by_space[space]:
                group = self.by_space[space].pop()
                take = min(count, group[1])
                if rest := self.put(group, length, take):
                    self.shelve(rest)
                self.by_space[group[2]].append(group)
                count -= take
        each = self.size // length
        for full, copies in ((count // each, each), (1 if count % each else 0, count % each)):
            if full:
                group = self.opened(full)
                for _ in range(copies):
                    self.put(group, length, full)
                self.shelve(group)

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        """(length, low rank, high rank, first sequence, offset) of every slot of every group."""
        return [(le, ra, ra + n, first, of) for first, n, _, slots in self.groups for le, ra, of in slots]


def plan_counts(counts: np.ndarray, size: int = SEQUENCE, unit: int = BIN) -> Plan:
    """The plan for counts[length] pieces of each length up to `size`."""
    plan, left = Plan(size), counts.astype(np.int64).copy()
    whole = size // unit
    bins = -(-np.arange(size + 1) // unit)
    totals = np.bincount(bins, left, whole + 1).astype(np.int64)
    used = np.flatnonzero(totals)
    forms = patterns(used[used > 0], whole)
    if forms:
        a = np.zeros((whole + 1, len(forms)))
        for k, form in enumerate(forms):
            for b in form:
                a[b, k] += 1
        fitted = np.floor(nnls(a, totals.astype(float)) + 1e-9).astype(np.int64)
        for k in np.argsort(-fitted, kind="stable"):
            # Least squares may ask for more than there is: no sequence is opened that its pattern cannot fill.
            enough = [left[(b - 1) * unit + 1:b * unit + 1].sum() // forms[k].count(b) for b in forms[k]]
            times = int(min(fitted[k], *enough))
            todo = [plan.opened(times)] if times else []
            for place, b in enumerate(forms[k]):
                after = []
                for group in todo:
                    while group:
                        # The last part closes the gap, with a length up to one bin off if need be.
                        last = place == len(forms[k]) - 1
                        low, high = max(1, (b - 1 - last) * unit + 1), group[2] if last else min(b * unit, group[2])
                        fits = np.flatnonzero(left[low:high + 1])
                        if not len(fits):
                            after.append(group)
                            break
                        length = low + int(fits[-1])
                        take = min(group[1], int(left[length]))
                        left[length] -= take
                        rest = plan.put(group, length, take)
                        after.append(group)
                        group = rest
                todo = after
            for group in todo:
                plan.shelve(group)
    for length in np.flatnonzero(left)[::-1]:
        plan.place_best(int(length), int(left[length]))
    return plan


def pack(docs: DataFrame, tokenizer: str = BYTES) -> DataFrame:
    """Every piece of every row of `docs` with sequence_id and offset (long).

    A null or empty text is one piece of one token. Repeated rows and null ids are packed like any other; other
    columns are not read; an empty table gives no rows. Pieces are written to a shared table of a few numbers each.
    """
    cut = materialize(pieces(docs, tokenizer))
    counts = np.zeros(SEQUENCE + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most SEQUENCE rows
        counts[row[0]] = row[1]
    # The number of slots depends on SEQUENCE alone, not on the number of documents.
    plan = plan_counts(counts)
    slots = docs.sparkSession.createDataFrame(
        plan.rows(), "slot_length long, low long, high long, first long, offset long")
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    numbered = ranked(cut, ["length"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)), order, "rank")
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return numbered.join(F.broadcast(slots), here).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
