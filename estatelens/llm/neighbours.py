"""Nearest neighbours by inner product, with collision-counting hashing.

Vectors are lifted so that the largest inner product is the least distance. In a block of candidates every vector is
projected on PROJECTIONS single directions, each kept as a sorted array. Around a query's own projections windows of
one width are opened; a candidate collides on a direction if it lies in that window. Virtual rehashing widens all
windows step by step, counting only what comes in new. Candidates that collide on THRESHOLD directions are verified
with their original vectors. A query is done when its k-th best is so near that vectors at its distance would have
been met at this width.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

K = 20
QUERY_EVERY = 20
PROJECTIONS = 64
# Collisions from which a candidate is verified, and the share of directions on which a vector at the k-th best
# distance should collide before the search stops: with 64 directions, 1.1 deviations over the threshold.
THRESHOLD = 42
STOP_Z = 1.08
WIDEN = 1.15
# Most rows of a block, which is smaller for long vectors (down to LONG_BLOCK rows, beyond BLOCK_NUMBERS numbers).
BLOCK, LONG_BLOCK, BLOCK_NUMBERS, QUERIES = 16384, 4096, 1 << 20, 1024
SAMPLE = 256
# Squared norms beyond these are brought to about 1 for the search, so that nothing overflows; scores are not.
TINY, HUGE = 1e-200, 1e200


def unit(values: np.ndarray) -> np.ndarray:
    """`values` times the power of two that brings the largest to at most 1."""
    return np.ldexp(values, -int(np.frexp(np.abs(values).max())[1]))


class Index:
    """Sorted projections of one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.largest, self.plain = ids[order], vectors[order], largest, TINY < largest < HUGE
        self.near = self.vectors
        if not self.plain:
            self.near = unit(self.vectors)
            self.largest = largest = float((self.near ** 2).sum(1).max())
        lift = np.sqrt(np.maximum(largest - (self.near ** 2).sum(1), 0))
        self.lifted = np.column_stack([self.near, lift])
        self.directions = directions(self.lifted.shape[1])
        places = self.lifted @ self.directions.T
        self.order = np.argsort(places, axis=0, kind="stable").T.copy()
        # All sorted arrays in one, each moved behind the one before, so that one search finds all window ends.
        self.span = 4 * math.sqrt(largest) + 1
        self.flat = (np.take_along_axis(places.T, self.order, 1) + self.span * np.arange(PROJECTIONS)[:, None]).ravel()
        self.flat_order = self.order.ravel()
        # Used by every search again, as fresh memory of this size costs more than what is done in it.
        self.entries, self.rows = np.empty(self.flat_order.shape, self.flat_order.dtype), np.empty_like(self.near)

    def search(self, own: int, query: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Up to k (vec_id, score), best first, ties to the smaller id; rows with the query's own id are left out."""
        n, d = len(self.ids), self.lifted.shape[1]
        # The length of the query leaves the order as it is.
        original, query = query, query if self.plain and TINY < float(query @ query) < HUGE else unit(query)
        lifted = np.append(query, 0.0)
        # Lifting the query to the candidates' sphere leaves the order as it is; distances need its own norm.
        centre = self.directions @ lifted + self.span * np.arange(PROJECTIONS)
        norm = float(query @ query)

        def distance(score: float) -> float:
            return math.sqrt(max(norm + self.largest - 2 * score, 0))

        sample = self.near[::max(1, n // SAMPLE)] @ query
        # Steps begin below the best of the sample; those below its share of the k best are skipped, as a single near
        # copy says nothing of how far the k-th is.
        at = max(len(sample) - 1 - k * len(sample) // n, 0)
        reach = math.sqrt(d) / STOP_Z
        width, first = (max(0.8 * distance(float(s)) / reach, 1e-9) for s in (sample.max(), np.partition(sample, at)[at]))
        width *= WIDEN ** math.floor(math.log(first / width) / math.log(WIDEN))
        widest = distance(-math.sqrt(norm * self.largest))
        bounds = np.arange(PROJECTIONS + 1) * n
        low = high = None
        checked = np.zeros(n, bool)
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0)]
        # Products of matrices may differ by so much from the sums that rank in the end.
        slack = 4 * d * np.finfo(float).eps * math.sqrt(norm * self.largest)
        while True:
            a = np.maximum(np.searchsorted(self.flat, centre - width, "left"), bounds[:-1])
            b = np.minimum(np.searchsorted(self.flat, centre + width, "right"), bounds[1:])
            if low is None:
                # Where the first windows hold most of the block, what lies outside is counted and taken off.
                a, b = np.minimum(a, bounds[1:]), np.maximum(b, bounds[:-1])
                if 2 * int((b - a).sum()) > len(self.flat):
                    counts = PROJECTIONS - self.met(zip(bounds[:-1].tolist(), a.tolist())) - self.met(zip(b.tolist(), bounds[1:].tolist()))
                else:
                    counts = self.met(zip(a.tolist(), b.tolist()))
            else:
                a, b = np.minimum(a, low), np.maximum(b, high)
                counts += self.met([*zip(a.tolist(), low.tolist()), *zip(high.tolist(), b.tolist())])
            low, high = a, b
            ready = np.flatnonzero((counts >= THRESHOLD) & ~checked)
            checked[ready] = True
            ready = ready[self.ids[ready] != own]
            found_at.append(ready)
            found.append(np.take(self.near, ready, axis=0, out=self.rows[:len(ready)], mode="clip") @ query)
            scores = np.concatenate(found)
            last = float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -math.inf
            if width >= widest or distance(last) <= width * reach:
                return self.ranked(np.concatenate(found_at)[scores >= last - slack], original, query, k)
            width *= WIDEN

    def met(self, stretches) -> np.ndarray:
        """How often each row lies in the given stretches of the sorted arrays."""
        parts = [self.flat_order[x:y] for x, y in stretches]
        size = sum(map(len, parts))
        return np.bincount(np.concatenate(parts, out=self.entries[:size]), minlength=len(self.ids))

    def ranked(self, rows: np.ndarray, original: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of `rows` with their scores."""
        rows = np.sort(rows)
        # The sum over a row is taken in the same order wherever the row lies, so equal vectors tie exactly.
        scores = (self.near[rows] * query).sum(1)
        best = np.lexsort((rows, -scores))[:k]
        if query is original and self.plain:
            return self.ids[rows[best]], scores[best]
        with np.errstate(over="ignore", invalid="ignore"):
            return self.ids[rows[best]], (self.vectors[rows[best]] * original).sum(1)


def directions(d: int) -> np.ndarray:
    """PROJECTIONS directions: orthonormal bases, as many as it takes."""
    rng = np.random.default_rng(d)
    bases = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-PROJECTIONS // d))]
    return np.concatenate(bases)[:PROJECTIONS]


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of up to k neighbours of each query.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows with another vec_id. Rows without
    vec_id, and vectors that are null, zero or hold null or non-finite components take no part. Vectors meet those of
    their own dimension. Rows that repeat a vec_id are candidates each, and queries each with the same result
    once. Scores that overflow are infinite or NaN, which ranks last. Other columns are not read; an empty table gives no rows. Candidates are dealt to blocks of about BLOCK rows
    and queries to blocks of about QUERIES; each pair of blocks is one task's work. Nothing reaches the driver.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(
        "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(vector, x -> x <> 0)")
    facts = rows.groupBy(F.size("vector").alias("d")).agg(
        F.count("*").alias("n"), F.max(F.expr("aggregate(vector, 0D, (s, x) -> s + x * x)")).alias("largest"))
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(LONG_BLOCK), F.floor(BLOCK_NUMBERS / F.col("d"))))
    facts = facts.select("d", "largest", F.ceil(F.col("n") / size).alias("blocks"), F.ceil(F.col("n") / (every * QUERIES)).alias("parts"))
    # One row a dimension.
    rows = rows.withColumn("d", F.size("vector")).join(F.broadcast(facts), "d")
    own = F.xxhash64("vec_id")
    asked = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "d"]).withColumn(
        "part", F.pmod(own, "parts")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    # The sides share a join, so their columns need identities of their own.
    asked, held = (side.select(*(F.col(c).alias(c) for c in ("d", "block", "part", "vec_id", "vector", "largest"))) for side in (asked, held))

    def meet(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            index = Index(candidates["vec_id"].to_numpy(), np.stack(candidates["vector"].to_numpy()), float(candidates["largest"].iloc[0]))
            for query, vector in zip(queries["vec_id"].to_numpy(), queries["vector"], strict=True):
                ids, scores = index.search(query, vector, k)
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    met = asked.groupBy("d", "block", "part").cogroup(held.groupBy("d", "block", "part")).applyInPandas(
        meet, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return met.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
