"""Weighted cross-product sums (XᵀWX, XᵀWy) as Spark jobs, and the small solves on them.

Every linear model here is fitted from these sums: tasks turn their rows into
p x p partial sums, Spark adds them up by (group, i, j), and only those sums are
solved. Rows of a group are dealt over several tasks, so a hot group is never
gathered in one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import materialize

# Rows of one group handled by one task at a time, numbers in one dense slice of them, and the widest design that is
# solved with an indicator for every level; `absorb` takes wider categories out.
ROWS_PER_CHUNK = 50_000
SLICE_NUMBERS = 1_000_000
MAX_TERMS = 4_000


@dataclass(frozen=True)
class Design:
    """Columns of a linear model: constant, numeric columns, indicator columns of categories."""

    numeric: tuple[str, ...]
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    drop_first: bool = False
    shift: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    y_shift: float = 0.0
    # Values in place of nulls.
    fills: dict[str, float | str] = field(default_factory=dict)

    @property
    def terms(self) -> list[tuple[str, str | None]]:
        out: list[tuple[str, str | None]] = [("Intercept", None)]
        out += [(c, None) for c in self.numeric]
        for name, levels in self.categories.items():
            out += [(name, level) for level in levels[1 if self.drop_first else 0:]]
        return out

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categories]

    def matrix(self, frame: pd.DataFrame) -> np.ndarray:
        """Dense rows of the design for one batch."""
        n = len(frame)
        x = np.zeros((n, len(self.terms)))
        x[:, 0] = 1.0
        for k, c in enumerate(self.numeric, start=1):
            x[:, k] = (frame[c].to_numpy(dtype=float) - self.shift.get(c, 0.0)) / self.scale.get(c, 1.0)
        at = 1 + len(self.numeric)
        skip = 1 if self.drop_first else 0
        for c, levels in self.categories.items():
            codes = pd.Categorical(frame[c], categories=list(levels)).codes.astype(int) - skip
            rows = np.flatnonzero(codes >= 0)
            x[rows, at + codes[rows]] = 1.0
            at += len(levels) - skip
        return x


def is_wide(df: DataFrame, fields: list[str]) -> bool:
    """Whether the categories have more levels than a dense design holds."""
    return bool(fields) and _levels(df, fields).limit(MAX_TERMS + 1).count() > MAX_TERMS


def _levels(df: DataFrame, fields: list[str]) -> DataFrame:
    narrow = df.select(*[F.col(c).cast("string").alias(c) for c in fields])
    return narrow.unpivot([], list(fields), "field", "level").where(F.col("level").isNotNull()).distinct()


def levels_of(df: DataFrame, fields: list[str]) -> dict[str, tuple[str, ...]]:
    """Sorted category levels; more than a dense design holds are an error (see `is_wide`)."""
    if not fields:
        return {}
    rows = _levels(df, fields).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} category levels in {fields}")
    return {c: tuple(sorted(r.level for r in rows if r.field == c)) for c in fields}


def make_design(df: DataFrame, numeric: list[str], fields: list[str], y: str, drop_first: bool = False) -> Design:
    """A design whose numeric columns are centred and scaled over `df`."""
    stats = df.agg(
        F.avg(y).alias("y"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numeric)],
    ).first()
    return Design(
        numeric=tuple(numeric),
        categories=levels_of(df, fields),
        drop_first=drop_first,
        shift={c: float(stats[f"m{i}"] or 0.0) for i, c in enumerate(numeric)},
        scale={c: float(stats[f"s{i}"] or 0.0) or 1.0 for i, c in enumerate(numeric)},
        y_shift=float(stats["y"] or 0.0),
    )


def _slices(design: Design, frame: pd.DataFrame):
    """The rows in pieces whose dense form has a bounded number of cells, whatever the width."""
    step = max(1, SLICE_NUMBERS // (len(design.terms) + 1))
    for low in range(0, len(frame), step):
        yield frame.iloc[low:low + step]


def _partial(design: Design, y: str, weight: str | None, frame: pd.DataFrame) -> np.ndarray:
    size = len(design.terms) + 1
    total = np.zeros((size, size))
    for part in _slices(design, frame):
        xy = np.column_stack([design.matrix(part), part[y].to_numpy(dtype=float) - design.y_shift])
        total += xy.T @ (xy * part[weight].to_numpy(dtype=float)[:, None] if weight else xy)
    return total


def _packed(sums: np.ndarray, n: int) -> pd.DataFrame:
    """Upper triangle by rows, and the row count as row -1."""
    rows = [[float(n)]] + [sums[i, i:].tolist() for i in range(len(sums))]
    return pd.DataFrame({"i": range(-1, len(sums)), "values": rows})


def chunk_sizes(df: DataFrame, by: list[str], rows_per_chunk: int | None = None) -> DataFrame:
    """How many chunks the rows of each group are dealt over: (by, __chunks)."""
    return materialize(as_chunks(df.groupBy(*by).agg(F.count("*").alias("n")), by, "n", rows_per_chunk))


def as_chunks(counts: DataFrame, by: list[str], n: str, rows_per_chunk: int | None = None) -> DataFrame:
    """The same from a table of group sizes that is already at hand."""
    return counts.select(*by, F.ceil(F.col(n) / (rows_per_chunk or ROWS_PER_CHUNK)).alias("__chunks"))


def chunked(df: DataFrame, by: list[str], sizes: DataFrame) -> DataFrame:
    """Add `__chunk`: deals the rows of each group over its chunks by a hash of what they hold.

    The number does not depend on the order of rows, so a task that runs again deals alike.
    """
    return (
        df.withColumn("__code", F.xxhash64(*[F.col(c) for c in df.columns])).join(sizes, by)
        .withColumn("__chunk", F.pmod("__code", "__chunks"))
        .drop("__chunks", "__code")
    )


def gram(
    df: DataFrame, design: Design, y: str, weight: str | None = None, by: list[str] = (),
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Sums of w·a·b over all pairs of [terms, y] per group: rows (by, i, j, s), i <= j.

    The number of rows of the group is stored at i = -1. `sizes` saves a count where
    the group sizes are known (see `as_chunks`).
    """
    by = list(by)
    if len(design.terms) > MAX_TERMS:
        raise ValueError(f"{len(design.terms)} terms exceed {MAX_TERMS}")
    needed = list(dict.fromkeys([*by, *design.columns, y, *([weight] if weight else [])]))
    rows = df.select(*needed)

    if not by:
        packed = _packed_by_task(rows, design, y, weight, None)
    else:
        rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in design.fills.items() if c in rows.columns})
        schema = T.StructType([f for f in rows.schema if f.name in by])
        schema = schema.add("i", T.IntegerType()).add("values", T.ArrayType(T.DoubleType()))

        def per_chunk(frame: pd.DataFrame) -> pd.DataFrame:
            out = _packed(_partial(design, y, weight, frame), len(frame))
            for k, c in enumerate(by):
                out.insert(k, c, [frame[c].iloc[0]] * len(out))
            return out

        packed = chunked(rows, by, sizes or chunk_sizes(rows, by)).groupBy(*by, "__chunk").applyInPandas(per_chunk, schema)

    return _cells(packed, by)


def few_grams(df: DataFrame, design: Design, y: str, by: str, weight: str | None = None) -> DataFrame:
    """The same for a handful of groups: each task adds up all of them, and no row is shuffled."""
    if len(design.terms) > MAX_TERMS:
        raise ValueError(f"{len(design.terms)} terms exceed {MAX_TERMS}")
    rows = df.select(*dict.fromkeys([by, *design.columns, y, *([weight] if weight else [])]))
    return _cells(_packed_by_task(rows, design, y, weight, by), [by])


def _packed_by_task(rows: DataFrame, design: Design, y: str, weight: str | None, by: str | None) -> DataFrame:
    """Sums of each task, by the values of `by` if given; rows go to numpy in Arrow batches.

    Nulls are filled there, as a projection of so many columns is too long for the JVM to compile.
    """
    def over_batches(batches):
        totals, kind = {}, None
        for batch in batches:
            columns = [x.fill_null(design.fills[c]) if c in design.fills else x for c, x in zip(batch.schema.names, batch.columns)]
            frame = pa.RecordBatch.from_arrays(columns, batch.schema.names).to_pandas(use_threads=False)
            kind = batch.schema.field(by).type if by else None
            for key, part in frame.groupby(by) if by else ((None, frame),):
                total, n = totals.get(key, (0.0, 0))
                totals[key] = total + _partial(design, y, weight, part), n + len(part)
        for key, (total, n) in totals.items():
            out = pa.RecordBatch.from_pandas(_packed(total, n).astype({"i": "int32"}), preserve_index=False)
            keys = [pa.array([key] * len(out), kind)] if by else []
            yield pa.RecordBatch.from_arrays([*keys, *out.columns], [*([by] if by else []), "i", "values"])

    schema = T.StructType([f for f in rows.schema if f.name == by])
    rows = rows.select(*[F.col(c).cast("double").alias(c) if c in design.numeric and c != by else c for c in rows.columns])
    return rows.mapInArrow(over_batches, schema.add("i", T.IntegerType()).add("values", T.ArrayType(T.DoubleType())))


def _cells(packed: DataFrame, by: list[str]) -> DataFrame:
    cells = packed.select(*by, "i", F.posexplode("values").alias("k", "v"))
    j = F.when(F.col("i") >= 0, F.col("i") + F.col("k")).otherwise(0)
    return cells.select(*by, "i", j.cast("int").alias("j"), "v").groupBy(*by, "i", "j").agg(F.sum("v").alias("s"))


@dataclass
class Sums:
    """Cross-product sums of one group in matrix form."""

    n: int
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @classmethod
    def from_cells(cls, frame: pd.DataFrame) -> "Sums":
        count = frame["i"] < 0
        n = int(round(frame.loc[count, "s"].sum()))
        cells = frame.loc[~count]
        size = int(cells["j"].max()) + 1
        m = np.zeros((size, size))
        i, j, s = (cells[c].to_numpy() for c in ("i", "j", "s"))
        m[i, j] = s
        m[j, i] = s
        return cls(n, m[:-1, :-1], m[:-1, -1], float(m[-1, -1]))

    def take(self, index) -> "Sums":
        """The same sums for some of the terms."""
        index = np.asarray(index, dtype=int)
        return Sums(self.n, self.xx[np.ix_(index, index)], self.xy[index], self.yy)

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(self.n + other.n, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy)

    def __sub__(self, other: "Sums") -> "Sums":
        return Sums(self.n - other.n, self.xx - other.xx, self.xy - other.xy, self.yy - other.yy)

    def centred(self) -> "Sums":
        """Sums about the weighted means, without the constant (term 0)."""
        total, x, y = self.xx[0, 0], self.xx[0, 1:], self.xy[0]
        return Sums(
            self.n, self.xx[1:, 1:] - np.outer(x, x) / total, self.xy[1:] - x * y / total,
            self.yy - y * y / total,
        )


def collect_sums(cells: DataFrame, by: str | None = None):
    """Gram rows to the driver: p x p numbers per group, for at most a few groups."""
    frame = cells.toPandas()
    if by is None:
        return Sums.from_cells(frame)
    return {key: Sums.from_cells(part) for key, part in frame.groupby(by)}


def solve(sums: Sums, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray, int]:
    """Least-squares coefficients, inverse of XᵀWX (pseudo-inverse if singular) and its rank."""
    d = np.sqrt(np.clip(np.diag(sums.xx), 0.0, None))
    live = d > 0
    d = np.where(live, d, 1.0)
    values, vectors = np.linalg.eigh(sums.xx / np.outer(d, d))
    keep = values > tolerance * max(values.max(), 1.0)
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T / np.outer(d, d)
    return inverse @ sums.xy, inverse, int(keep.sum())


def residual_sum(sums: Sums, beta: np.ndarray) -> float:
    return max(float(sums.yy - 2 * beta @ sums.xy + beta @ sums.xx @ beta), 0.0)


def total_sum(sums: Sums) -> float:
    """Weighted sum of squares of y about its weighted mean; term 0 is the constant."""
    return float(sums.yy - sums.xy[0] ** 2 / sums.xx[0, 0])


def score_sums(
    df: DataFrame, design: Design, y: str, weight: str, by: list[str], solutions: DataFrame,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Second pass for robust errors: rows (by, specification, k, s).

    For each solution (by, specification, beta, picked, centre, level) of a group, s is
    the sum over its rows of (w·e·aₖ·(x − centre))², with e = y − level − x·beta and aₖ
    the k-th picked row of the inverse.
    """
    rows = df.select(*dict.fromkeys([*by, *design.columns, y, weight]))
    sizes = sizes or chunk_sizes(rows, by)
    spread = solutions.join(sizes, by).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1))
    ).drop("__chunks")
    schema = T.StructType([f for f in rows.schema if f.name in by])
    schema = schema.add("specification", T.StringType()).add("k", T.IntegerType()).add("s", T.DoubleType())

    def per_chunk(frame: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame) and len(fits):
            key = [frame[c].iloc[0] for c in by]
            for part in _slices(design, frame):
                x = design.matrix(part)
                target = part[y].to_numpy(dtype=float) - design.y_shift
                w = part[weight].to_numpy(dtype=float)
                for fit in fits.itertuples(index=False):
                    e = target - fit.level - x @ np.asarray(fit.beta, dtype=float)
                    centred = x - np.asarray(fit.centre, dtype=float)
                    for k, row in enumerate(fit.picked):
                        u = w * e * (centred @ np.asarray(row, dtype=float))
                        out.append((*key, fit.specification, k, float(u @ u)))
        return pd.DataFrame(out, columns=[*by, "specification", "k", "s"])

    parts = (
        chunked(rows, by, sizes).groupBy(*by, "__chunk")
        .cogroup(spread.groupBy(*by, "__chunk")).applyInPandas(per_chunk, schema)
    )
    return parts.groupBy(*by, "specification", "k").agg(F.sum("s").alias("s"))


def meat(
    df: DataFrame, design: Design, y: str, weight: str, by: list[str], solutions: DataFrame, sizes: DataFrame | None = None
) -> DataFrame:
    """Second pass for full robust covariances: rows (by, specification, i, j, s), i <= j.

    For each solution (by, specification, terms, beta, centre, level) of a group they are the sums of u u' over its
    rows, with e = y - level - x beta on the terms of the solution and u = w e (x - centre, 1); the last row and
    column are those of the 1.
    """
    rows = df.select(*dict.fromkeys([*by, *design.columns, y, weight]))
    sizes = sizes or chunk_sizes(rows, by)
    spread = solutions.join(sizes, by).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1))
    ).drop("__chunks")
    schema = T.StructType([f for f in rows.schema if f.name in by])
    schema = schema.add("specification", T.StringType()).add("i", T.IntegerType()).add("values", T.ArrayType(T.DoubleType()))

    def per_chunk(frame: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame) and len(fits):
            key = [frame[c].iloc[0] for c in by]
            totals = [0.0] * len(fits)
            for part in _slices(design, frame):
                x = design.matrix(part)
                target = part[y].to_numpy(dtype=float) - design.y_shift
                w = part[weight].to_numpy(dtype=float)
                for k, fit in enumerate(fits.itertuples(index=False)):
                    own = x[:, np.asarray(fit.terms, dtype=int)]
                    e = w * (target - fit.level - own @ np.asarray(fit.beta, dtype=float))
                    u = np.column_stack([own - np.asarray(fit.centre, dtype=float), np.ones(len(e))]) * e[:, None]
                    totals[k] = totals[k] + u.T @ u
            for total, fit in zip(totals, fits.itertuples(index=False)):
                out += [(*key, fit.specification, i, total[i, i:].tolist()) for i in range(len(total))]
        return pd.DataFrame(out, columns=[*by, "specification", "i", "values"])

    parts = (
        chunked(rows, by, sizes).groupBy(*by, "__chunk")
        .cogroup(spread.groupBy(*by, "__chunk")).applyInPandas(per_chunk, schema)
    )
    cells = parts.select(*by, "specification", "i", F.posexplode("values").alias("k", "v"))
    return cells.groupBy(*by, "specification", "i", (F.col("i") + F.col("k")).alias("j")).agg(F.sum("v").alias("s"))


def symmetric(frame: pd.DataFrame) -> np.ndarray:
    """The full matrix of rows i, j, s with i <= j."""
    size = int(frame["j"].max()) + 1
    m = np.zeros((size, size))
    i, j, s = (frame[c].to_numpy() for c in ("i", "j", "s"))
    m[i, j] = s
    m[j, i] = s
    return m
