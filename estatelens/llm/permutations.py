"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of vectors gives the pivots. Every vector is described by its PREFIX nearest pivots, in order. Each
pivot has an inverted list of the vectors that name it; vectors of one label that share SHARED pivots or more are
candidates and are verified by cosine on the vectors themselves. A pair is judged once, in the list of the smallest
pivot that both name. A list that is too long for one block is split by a second pivot; a pair then is judged in the
list of the two smallest pivots that both name.

Equal vectors of one label form one class first, so copies cost nothing more. What is still too long is dealt to blocks,
and a task compares one block with another; what leaves it is one row for each vector with links: how many, and one link
into the block's own component. Links are never written as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..scratch import discard, materialize
from .components import components

SIMILAR = 0.93
# Nearest pivots that describe a vector, and how many of them two candidates share.
PREFIX, SHARED = 8, 2
# Pivots: so many times the root of the vectors of the largest label, at most MAX_PIVOTS; none nearer to another than APART.
# All pivots of a dimension have at most MAX_VALUES components, which bounds what is collected and broadcast.
PER_ROOT, MIN_PIVOTS, MAX_PIVOTS, MAX_VALUES = 4, 64, 16_384, 1 << 22
APART = 0.75
# Vectors of one block of a list, and cosines with pivots that one numpy step computes.
BLOCK, STEP = 1024, 1 << 22
# One pair of blocks of one list; `of` is a hash of the label.
KEY = ["d", "of", "pivot", "second", "low", "high"]


def usable(vector: Column) -> Column:
    return (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix of doubles."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def coded(rows: DataFrame) -> DataFrame:
    """`rows` (vec_id, label, vector) with node: 128 bits of label and vector, null if the row links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            labels, vectors = part.column("label").to_pylist(), part.column("vector")
            lengths = vectors.value_lengths().to_pylist()
            # Adding 0 makes one of the two zeros.
            flat = (vectors.flatten().to_numpy(zero_copy_only=False) + 0.0).astype(np.float64)
            nodes, at = [], 0
            for label, n in zip(labels, lengths, strict=True):
                nodes.append(None if n is None else blake2b(flat[at:at + n].tobytes() + repr(label).encode(), digest_size=16).digest())
                at += n or 0
            yield part.append_column("node", pa.array(nodes, pa.binary()))

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("node", T.BinaryType())]))


def thinned(vectors: np.ndarray, most: int) -> np.ndarray:
    """The first vectors that are not nearer than APART to one taken before, at most `most`."""
    taken = np.empty((0, vectors.shape[1]))
    for low in range(0, len(vectors), 256):
        part = vectors[low:low + 256]
        free = (part @ taken.T < APART).all(1) if len(taken) else np.ones(len(part), bool)
        part = part[free]
        near = np.tril(part @ part.T >= APART, -1)
        keep = np.ones(len(part), bool)
        for k in range(len(part)):
            keep[k] = not (near[k] & keep).any()
        taken = np.concatenate([taken, part[keep]])[:most]
    return taken


def choose_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each dimension: the classes with the smallest codes, which are random.

    Twice as many vectors as pivots wanted reach the driver, so at most 2 * MAX_PIVOTS of a dimension.
    """
    sizes = classes.groupBy("d", "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n"))
    pivots = {}
    for d, n in sizes.collect():
        most = min(max(MIN_PIVOTS, math.ceil(PER_ROOT * math.sqrt(n))), MAX_PIVOTS, max(1, MAX_VALUES // d))
        sample = classes.filter(F.col("d") == d).select("node", "vector").orderBy("node").limit(2 * most).toArrow()
        pivots[d] = thinned(unit(matrix(sample.column("vector").combine_chunks())), most)
    return pivots


def described(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """`classes` with `near`: the numbers of the nearest pivots, nearest first."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        places = -(vectors @ pivots.T)
        first = np.argpartition(places, min(PREFIX, len(pivots)) - 1, axis=1)[:, :PREFIX]
        first.sort(axis=1)
        return np.take_along_axis(first, np.argsort(np.take_along_axis(places, first, 1), axis=1, kind="stable"), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            dims = part.column("d").to_numpy()
            near: list = [None] * len(dims)
            for d in np.unique(dims).tolist():
                at, pivots = np.flatnonzero(dims == d), shared.value[d]
                rows = max(1, STEP // len(pivots))
                for low in range(0, len(at), rows):
                    own = at[low:low + rows]
                    found = nearest(unit(matrix(part.column("vector").take(pa.array(own)))), pivots)
                    for k, row in zip(own.tolist(), found.tolist(), strict=True):
                        near[k] = row
            yield part.append_column("near", pa.array(near, pa.list_(pa.int32())))

    return classes.mapInArrow(run, T.StructType([*classes.schema, T.StructField("near", T.ArrayType(T.IntegerType()))]))


def shared_counts(a: np.ndarray, b: np.ndarray, pivot: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of rows of `a` and `b` (pivot numbers): how many pivots they share, and whether these are judged here.

    Here is where `pivot` is the smallest of them and `second`, unless it is -1, the next.
    """
    counts = np.zeros((len(a), len(b)), np.int8)
    first = np.ones((len(a), len(b)), bool)
    for x in a.T:
        lower = (x < pivot) | (x > pivot) & (x < second)
        for y in b.T:
            same = x[:, None] == y[None, :]
            counts += same
            if lower.any():
                first &= ~(same & lower[:, None])
    return counts, first


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each of n by the links a[k], b[k]."""
    roots = np.arange(n)
    while True:
        after = roots.copy()
        np.minimum.at(after, a, roots[b])
        np.minimum.at(after, b, roots[a])
        after = after[after]
        if (after == roots).all():
            return roots
        roots = after


def compared(nodes: np.ndarray, sizes: np.ndarray, vectors: np.ndarray, near: np.ndarray, side: np.ndarray, pivot: int, second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, links and root of every member of one pair of blocks that has a link.

    side 0 and 1 are two blocks and only pairs across count; side 2 is a block that meets itself.
    """
    left, right = (np.flatnonzero(side == 2),) * 2 if (side == 2).any() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    counts, first = shared_counts(near[left], near[right], pivot, second)
    candidates = (counts >= min(SHARED, near.shape[1])) & first
    if left is right:
        candidates = np.triu(candidates, 1)
    a, b = np.nonzero(candidates)
    if len(a) > candidates.size // 16:
        linked = (vectors[left] @ vectors[right].T)[a, b] >= SIMILAR
    else:
        linked = np.einsum("ij,ij->i", vectors[left[a]], vectors[right[b]]) >= SIMILAR
    a, b = left[a[linked]], right[b[linked]]
    n = len(nodes)
    links = np.bincount(a, sizes[b], n) + np.bincount(b, sizes[a], n)
    roots = local_roots(n, a, b)
    met = np.flatnonzero(links > 0)
    return nodes[met], links[met].astype(np.int64), nodes[roots[met]]


def verified(lists: DataFrame) -> DataFrame:
    """node, links, root of the members of each pair of blocks, from rows that lie together by KEY."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held).combine_chunks()
            if part.num_rows > 1:
                columns = {c: part.column(c).combine_chunks() for c in ("vector", "near", "node")}
                nodes = np.array(columns["node"].to_pylist(), object)
                found = compared(nodes, part.column("size").to_numpy(), unit(matrix(columns["vector"])),
                                 matrix(columns["near"]).astype(np.int32), part.column("side").to_numpy(),
                                 part.column("pivot")[0].as_py(), part.column("second")[0].as_py())
                if len(found[0]):
                    yield pa.RecordBatch.from_pydict({
                        "node": pa.array(found[0], pa.binary()), "links": pa.array(found[1]), "root": pa.array(found[2], pa.binary())})
            held.clear()

        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in KEY], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if held and last != keys[begin].tolist():
                    yield from close()
                held.append(batch.slice(begin, end - begin))
                last = keys[begin].tolist()
        if held:
            yield from close()

    return lists.mapInArrow(run, "node binary, links long, root binary")


def inverted(classes: DataFrame) -> DataFrame:
    """One row for each class, list that it is in, and pair of blocks of that list that its own block is in."""
    entries = classes.withColumn("pivot", F.explode("near"))
    lengths = entries.groupBy("d", "label", "pivot").agg(F.count("*").alias("n")).filter("n > 1")
    entries = entries.join(lengths, ["d", "label", "pivot"])
    long = F.col("n") > BLOCK
    entries = entries.withColumn("second", F.explode(F.when(long, F.filter("near", lambda x: x > F.col("pivot"))).otherwise(F.array(F.lit(-1))))).drop("n")
    key = ["d", "label", "pivot", "second"]
    blocks = entries.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).drop("n")
    rows = entries.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("node", "size", "vector", "near", "d", F.xxhash64("label").alias("of"), "pivot", "second",
                       F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                       F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    return rows.repartition(*KEY).sortWithinPartitions(*KEY)


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors` (vec_id, embedding, label).

    Rows with equal labels and a cosine of SIMILAR or more, in double precision, are linked; n_links counts the other
    rows a row is linked with, copies included. component_id is the smallest vec_id reachable, kept tells whether it
    is the row's own. Rows without label, and vectors that are null, empty, zero or hold null or non-finite components
    link with nothing. Vectors of different lengths never link. Rows that repeat a vec_id are rows of their own and
    link like others. A row without vec_id takes part; component_id is null if no row of its component has one. Other
    columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").alias("vector"))
    rows = rows.withColumn("vector", F.when(F.col("label").isNotNull() & usable(F.col("vector")), F.col("vector")))
    rows = coded(rows)
    classes = materialize(rows.filter("node is not null").groupBy("node").agg(
        F.count("*").alias("size"), F.min("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("vector").alias("vector")
    ).withColumn("d", F.size("vector")))
    near = materialize(described(classes, choose_pivots(classes)))
    met = materialize(verified(inverted(near)))
    labels = components(met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = classes.select("node", "size", "vec_id").join(links, "node", "left").join(labels, "node", "left").select(
        "node", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    lowest = found.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    found = materialize(found.join(lowest, "comp").select("node", "n_links", "component_id"))
    discard(near, met, classes)
    return rows.select("vec_id", "node").join(found, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.expr("vec_id <=> component_id"))


SQL = f"""
WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
   AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   WHERE list_cosine_similarity(a.v, b.v) >= {SIMILAR}),
 counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
 reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.vec_id),
 found AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN found USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
