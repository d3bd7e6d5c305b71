"""Matrices of sums that may be wider than one process holds: numpy arrays up to BLOCK columns, tables of blocks beyond.

The functions here take either form and mean the same by it. A table has rows (i, j, values) with the bytes of a block of
BLOCK x BLOCK numbers (less at the edges); blocks that are missing are 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import discard, materialize

# Columns of one block, and parts of a block that one task adds up at a time.
BLOCK = 512
FAN_IN = 16

# Directions of less than this share of the largest variance count as dependent on others.
TOLERANCE = 1e-10

SCHEMA = "i int, j int, values binary"
PARTS = "i int, j int, part long, values binary"


@dataclass
class Blocks:
    """A matrix of `rows` x `cols` numbers in blocks of `size`; no block is there twice."""

    table: DataFrame
    rows: int
    cols: int
    size: int

    @property
    def T(self) -> "Blocks":
        return Blocks(_mapped(self, lambda i, j, x: (j, i, x.T)), self.cols, self.rows, self.size)

    def __add__(self, other: "Blocks") -> "Blocks":
        both = self.table.withColumn("part", F.lit(0).cast("long")).unionByName(other.table.withColumn("part", F.lit(1).cast("long")))
        return self._like(materialize(summed(both, 2)))

    def __sub__(self, other: "Blocks") -> "Blocks":
        return self + other * -1.0

    def __mul__(self, factor: float) -> "Blocks":
        return self._like(_mapped(self, lambda i, j, x: (i, j, x * factor)))

    def __matmul__(self, other):
        if isinstance(other, np.ndarray):
            return self._times_vector(other)
        left = self.table.select("i", F.col("j").alias("part"), F.col("values").alias("a"))
        right = other.table.select(F.col("i").alias("part"), "j", F.col("values").alias("b"))
        inner, columns = (self.rows, self.cols, self.size), other.cols

        def products(batches):
            rows, cols, size = inner
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    a = _read(r["a"], r["i"], r["part"], rows, cols, size)
                    out.append((r["i"], r["j"], r["part"], (a @ _read(r["b"], r["part"], r["j"], cols, columns, size)).tobytes()))
                yield _batch(out, ["i", "j", "part", "values"])

        parts = left.join(right, "part").select("i", "j", F.col("part").cast("long").alias("part"), "a", "b").mapInArrow(products, PARTS)
        return Blocks(materialize(summed(parts, _count(self.cols, self.size))), self.rows, other.cols, self.size)

    def _times_vector(self, vector: np.ndarray) -> np.ndarray:
        shape = (self.rows, self.cols, self.size)

        def pieces(batches):
            rows, cols, size = shape
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    x = _read(r["values"], r["i"], r["j"], rows, cols, size)
                    out.append((r["i"], (x @ vector[r["j"] * size:][:x.shape[1]]).tobytes()))
                yield _batch(out, ["i", "values"])

        total = np.zeros(self.rows)
        for r in self.table.mapInArrow(pieces, "i int, values binary").toLocalIterator():
            piece = np.frombuffer(r["values"])
            total[r["i"] * self.size:][:len(piece)] += piece
        return total

    def _like(self, table: DataFrame) -> "Blocks":
        return Blocks(table, self.rows, self.cols, self.size)


def _count(length: int, size: int) -> int:
    return -(-length // size)


def _read(values: bytes, i: int, j: int, rows: int, cols: int, size: int) -> np.ndarray:
    return np.frombuffer(values).reshape(min(size, rows - i * size), min(size, cols - j * size))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"i": pa.int32(), "j": pa.int32(), "part": pa.int64(), "values": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[c]) for k, c in enumerate(names)], names)


def _mapped(m: Blocks, change) -> DataFrame:
    """The table with `change(i, j, block)` in place of each block."""
    rows, cols, size = m.rows, m.cols, m.size

    def over(batches):
        for batch in batches:
            out = [change(r["i"], r["j"], _read(r["values"], r["i"], r["j"], rows, cols, size)) for r in batch.to_pylist()]
            yield _batch([(i, j, x.tobytes()) for i, j, x in out], ["i", "j", "values"])

    return m.table.mapInArrow(over, SCHEMA)


def summed(parts: DataFrame, count: int) -> DataFrame:
    """Blocks from their parts (i, j, part, values), numbered below `count`; FAN_IN parts meet in a task at a time."""
    def add(table: pa.Table) -> pa.Table:
        total = None
        for values in table["values"]:
            x = np.frombuffer(values.as_buffer())
            total = x.copy() if total is None else total + x
        own = [table[c][0].as_py() for c in ("i", "j", "part")]
        return pa.Table.from_batches([_batch([(*own, total.tobytes())], ["i", "j", "part", "values"])])

    while True:
        count = -(-count // FAN_IN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(count).cast("long"))).groupBy("i", "j", "part").applyInArrow(add, PARTS)
        if count <= 1:
            return parts.drop("part")


def symmetric(upper: DataFrame, width: int, size: int):
    """The matrix whose blocks on and above the diagonal are given; one block comes to the driver."""
    if width <= size:
        return np.frombuffer(upper.first()["values"]).reshape(width, width).copy()
    return _mirrored(materialize(upper), width, size)


def _mirrored(upper: DataFrame, width: int, size: int) -> Blocks:
    lower = Blocks(upper.where("i < j"), width, width, size).T.table
    return Blocks(materialize(upper.unionByName(lower)), width, width, size)


def plus_outer(m, a: np.ndarray, b: np.ndarray):
    """m + a b'."""
    if isinstance(m, np.ndarray):
        return m + np.outer(a, b)
    size = m.size
    whole = _grid(m.table.sparkSession, _count(m.rows, size), _count(m.cols, size)).mapInArrow(_outers(a, b, size), SCHEMA)
    return m + m._like(whole)


def _grid(spark, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("i"), F.pmod("id", F.lit(cols)).cast("int").alias("j"))


def _outers(a: np.ndarray, b: np.ndarray, size: int):
    def over(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.outer(a[r["i"] * size:][:size], b[r["j"] * size:][:size])
                yield _batch([(r["i"], r["j"], x.tobytes())], ["i", "j", "values"])

    return over


def replaced(m, corner: np.ndarray):
    """m with `corner` in place of its first rows and columns and 1 on the rest of its diagonal."""
    p = len(corner)
    size = len(m) if isinstance(m, np.ndarray) else m.size

    def change(i, j, x):
        own = corner[i * size:(i + 1) * size, j * size:(j + 1) * size]
        x = x.copy()
        x[:own.shape[0], :own.shape[1]] = own
        if i == j:
            rest = np.arange(max(p - i * size, 0), len(x))
            x[rest, rest] = 1.0
        return i, j, x

    return change(0, 0, m)[2] if isinstance(m, np.ndarray) else m._like(_mapped(m, change))


def diagonal(m) -> np.ndarray:
    if isinstance(m, np.ndarray):
        return np.diag(m).copy()
    out, shape = np.zeros(m.rows), (m.rows, m.cols, m.size)

    def own(batches):
        for batch in batches:
            yield _batch([(r["i"], np.diag(_read(r["values"], r["i"], r["j"], *shape)).tobytes()) for r in batch.to_pylist()], ["i", "values"])

    for r in m.table.where("i = j").mapInArrow(own, "i int, values binary").toLocalIterator():
        piece = np.frombuffer(r["values"])
        out[r["i"] * m.size:][:len(piece)] = piece
    return out


def inverse(m) -> tuple:
    """(inverse, null, rank) of a symmetric matrix without negative eigenvalues.

    Of a singular one the inverse is a reflexive generalised inverse, and the columns of `null` span what it takes to 0;
    `null` is None if there are none. The diagonal is about 1, see TOLERANCE.
    """
    if isinstance(m, np.ndarray):
        if not len(m):
            return m, None, 0
        values, vectors = np.linalg.eigh(m)
        keep = values > TOLERANCE * max(values.max(), 1.0)
        found = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
        return found, None if keep.all() else vectors[:, ~keep], int(keep.sum())
    return _inverse_by_blocks(m)


def _inverse_by_blocks(m: Blocks) -> tuple:
    """Gauss-Jordan elimination, one block of columns a round, on the blocks on and above the diagonal.

    A round writes the blocks anew: A - C P C' beside the block whose inverse P is taken, C P in its row and column
    and -P in its place. What P leaves out is null: z there, -C z in the blocks before.
    """
    spark, size, n = m.table.sparkSession, m.size, _count(m.rows, m.size)
    zeros = np.zeros(m.rows)
    table = (m._like(m.table) + m._like(_grid(spark, n, n).mapInArrow(_outers(zeros, zeros, size), SCHEMA))).table.where("i <= j")
    table, rank, columns, nulls = materialize(table), 0, 0, []
    shape = (m.rows, m.cols, size)

    for k in range(n):
        pivot = table.where((F.col("i") == k) & (F.col("j") == k)).first()
        found, null, own = inverse(_read(pivot["values"], k, k, *shape))
        rank += own
        # The pivot's column of blocks, those of its row turned.
        panel = materialize(Blocks(table.where((F.col("j") == k) & (F.col("i") < k)), *shape).table.unionByName(
            Blocks(table.where((F.col("i") == k) & (F.col("j") > k)), *shape).T.table))
        if null is not None:
            nulls.append((panel, null, k, columns))
            columns += null.shape[1]
        left = panel.select("i", F.col("values").alias("a"))
        right = panel.select(F.col("i").alias("j"), F.col("values").alias("b"))
        rest = table.where((F.col("i") != k) & (F.col("j") != k)).join(left, "i").join(right, "j").select("i", "j", "values", "a", "b")

        def eliminate(batches, k=k, found=found):
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    i, j = r["i"], r["j"]
                    a, b = (_read(r[c], t, k, *shape) for c, t in (("a", i), ("b", j)))
                    out.append((i, j, (_read(r["values"], i, j, *shape) - a @ found @ b.T).tobytes()))
                yield _batch(out, ["i", "j", "values"])

        def side(batches, k=k, found=found):
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    x = _read(r["values"], r["i"], k, *shape) @ found
                    out.append((r["i"], k, x.tobytes()) if r["i"] < k else (k, r["i"], x.T.tobytes()))
                yield _batch(out, ["i", "j", "values"])

        centre = spark.createDataFrame([(k, k, bytearray((-found).tobytes()))], SCHEMA)
        after = materialize(rest.mapInArrow(eliminate, SCHEMA).unionByName(panel.mapInArrow(side, SCHEMA)).unionByName(centre))
        if null is None:
            discard(panel)
        discard(table)
        table = after
    found = _mirrored((m._like(table) * -1.0).table, m.rows, size)
    return found, _null_blocks(nulls, m, columns) if nulls else None, rank


def _null_blocks(nulls: list[tuple], m: Blocks, columns: int) -> Blocks:
    """What the rounds left out, side by side: (panel, z, k, first column) of each of them."""
    shape, size, parts = (m.rows, m.cols, m.size), m.size, []

    def pieces(i, x, first, part):
        for j in range(first // size, (first + x.shape[1] - 1) // size + 1):
            block = np.zeros((x.shape[0], min(size, columns - j * size)))
            low, high = max(first, j * size), min(first + x.shape[1], (j + 1) * size)
            block[:, low - j * size:high - j * size] = x[:, low - first:high - first]
            yield i, j, part, block.tobytes()

    for part, (panel, z, k, first) in enumerate(nulls):
        def before(batches, z=z, k=k, first=first, part=part):
            for batch in batches:
                out = [p for r in batch.to_pylist() for p in pieces(r["i"], -_read(r["values"], r["i"], k, *shape) @ z, first, part)]
                yield _batch(out, ["i", "j", "part", "values"])

        parts.append(panel.where(F.col("i") < k).mapInArrow(before, PARTS))
        own = [(i, j, n, bytearray(x)) for i, j, n, x in pieces(k, z, first, part)]
        parts.append(panel.sparkSession.createDataFrame(own, PARTS))
    found = materialize(summed(reduce(DataFrame.unionByName, parts), len(nulls)))
    discard(*[panel for panel, *_ in nulls])
    return Blocks(found, m.rows, columns, size)
