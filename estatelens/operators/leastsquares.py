"""Least squares with a term for every level of any number of categories, by one method at all sizes.

The category of most levels, with the constant, is solved for level by level: what the means of its levels explain is taken
out of the sums, which leaves the system of the other columns. That is solved as a matrix of `blocks`, and the effect and
error of each level follow from its own means. Singular designs get the coefficients of least length for columns of unit
length, as by a pseudo-inverse of the whole design.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tails import student_quantile_975, student_two_sided
from ..scratch import discard, materialize
from . import blocks as B
from .gram import SLICE_NUMBERS, Design, Sums, chunk_sizes, chunked, collect_sums, gram, make_design

TABLE = "term string, coef double, std_err double, t double, p_value double, ci_low double, ci_high double"

# Sparse rows that one task adds up at a time; those of levels are long.
CELLS_PER_CHUNK, LEVELS_PER_CHUNK = 50_000, 5_000

# Levels whose sums, and rows or cells whose numbers, a task holds before it writes them.
LEVELS_AT_ONCE, CELLS_AT_ONCE = 50_000, 200_000

# Tables of up to this many terms are brought into the order of the design, longer ones stay as the tasks wrote them.
ORDERED_TERMS = 4_000


@dataclass
class Parts:
    """A design cut in two: the levels of one category, and all other columns, of unit length each.

    `vectors` and `levels` have sparse rows of places k and values v with a weight w and a mean y: `levels` the means of the
    other columns by level of the category taken out, `vectors` what adds up to the products of those columns (see
    `solve`). The numeric columns come first; `others` has key, level, place and norm of the rest.
    """

    design: Design
    sums: Sums
    norms: np.ndarray
    width: int
    vectors: DataFrame
    levels: DataFrame
    others: DataFrame | None
    own: str


@dataclass
class Fit:
    """Coefficients `beta` of the other columns, and what errors are made of, in units of the residual variance.

    `form` is the matrix of the errors of levels, `linear` what belongs to the first level alone, `spread` the variances of
    `beta` and `constant` that of the constant where the numeric columns are 0. The `first_` values are the first level's.
    """

    beta: np.ndarray
    form: np.ndarray | B.Blocks
    linear: np.ndarray
    spread: np.ndarray
    constant: float
    variance: float
    free: int
    levels: int
    first: str
    first_w: float
    first_y: float
    first_mean: np.ndarray


def cut(rows: DataFrame, numeric: list[str], fields: list[str], y: str) -> Parts:
    design = make_design(rows, numeric, [], y)
    sums = collect_sums(gram(rows, design, y))
    p = len(numeric)
    norms = np.sqrt(np.clip(np.diag(sums.xx)[1:], 0.0, None))
    norms[norms == 0] = 1.0
    # Without categories the constant is the only level.
    keys = [f"f{i}" for i in range(len(fields))] or ["f0"]
    level = [F.col(c).cast("string").alias(k) for c, k in zip(fields, keys)] or [F.lit("").alias("f0")]
    means = [f"m{k}" for k in range(p)]
    narrow = rows.select(*level, F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(m) for c, m in zip(numeric, means)])
    shift, unit = [design.y_shift, *(design.shift[c] for c in numeric)], [1.0, *(design.scale[c] * d for c, d in zip(numeric, norms))]
    found = materialize(narrow.mapInArrow(_by_level(keys, shift, unit), "key string, level string, cell array<string>, totals array<double>"))
    totals = found.where("key is not null").groupBy("key", "level").agg(*[F.sum(F.get("totals", F.lit(k))).alias(c) for k, c in enumerate(("w", "y", *means))])
    totals = materialize(totals.select("key", "level", "w", *[(F.col(c) / F.col("w")).alias(c) for c in ("y", *means)]))

    sizes = {r.key: r["count"] for r in totals.groupBy("key").count().collect()}
    own, width = max(keys, key=sizes.get), p
    rest = [k for k in keys if k != own]
    numbers, values = F.array(*[F.lit(k) for k in range(p)]).cast("array<int>"), F.array(*means).cast("array<double>")
    own_levels = totals.where(F.col("key") == own).drop("key")
    if not rest:
        levels = materialize(own_levels.select("level", "w", "y", numbers.alias("k"), values.alias("v")))
        discard(found, totals)
        return Parts(design, sums, norms, width, levels, levels, None, own)

    starts = []
    for k in rest:
        starts += [F.lit(k), F.lit(width)]
        width += sizes[k] - 1
    at = F.row_number().over(Window.partitionBy("key").orderBy("level")) - 2
    others = materialize(totals.where(F.col("key") != own).withColumn("at", at).where("at >= 0").withColumns({
        "place": (F.element_at(F.create_map(*starts), F.col("key")) + F.col("at")).cast("int"), "norm": F.sqrt("w")}))
    # Products with numeric columns are sums by level, those of two categories are counts of cells.
    by_level = others.select("w", "y", F.concat(numbers, F.array("place")).alias("k"), F.concat(values, F.array(1 / F.col("norm"))).alias("v"))
    cells = found.where("key is null").groupBy(*[F.get("cell", F.lit(i)).alias(k) for i, k in enumerate(keys)]).agg(F.sum(F.get("totals", F.lit(0))).alias("w"))
    for k in rest:
        places = others.where(F.col("key") == k).select(F.col("level").alias(k), F.struct("place", (1 / F.col("norm")).alias("value")).alias(f"o_{k}"))
        cells = cells.join(places, k, "left")
    entries = F.filter(F.array(*[f"o_{k}" for k in rest]), lambda e: e.isNotNull())
    cells = materialize(cells.select(F.col(own).alias("level"), "w", entries.alias("o")))
    shares = cells.select("level", "w", F.inline("o")).groupBy("level", "place").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    shares = shares.groupBy("level").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("o"))
    levels = own_levels.join(shares, "level", "left").withColumn("o", F.coalesce("o", F.array().cast("array<struct<place int, value double>>")))
    levels = materialize(levels.select("level", "w", "y", F.concat(numbers, F.transform("o", lambda e: e["place"])).alias("k"),
                                       F.concat(values, F.transform("o", lambda e: e["value"] / F.col("w"))).alias("v")))
    vectors = materialize(by_level.unionByName(cells.select(
        "w", F.lit(0.0).alias("y"), F.transform("o", lambda e: e["place"]).alias("k"), F.transform("o", lambda e: e["value"]).alias("v"))))
    discard(found, cells, totals)
    return Parts(design, sums, norms, width, vectors, levels, others, own)


def _by_level(keys: list[str], shift: list[float], unit: list[float]):
    """Of a task's rows, (key, level, totals) with their number and sums of y and the scaled numeric columns, and (cell, totals) with
    the number of each combination of levels."""
    shift, unit, size = np.array(shift), np.array(unit), len(shift) + 1
    names = ["key", "level", "cell", "totals"]

    def lists(values, length):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, length, dtype=np.int32)), values)

    def counted(tables):
        """Cells with their numbers, each once."""
        return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])

    def cells_written(cells):
        for batch in cells.combine_chunks().to_batches():
            levels = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys]).ravel()
            none = pa.nulls(len(batch), pa.string())
            yield pa.RecordBatch.from_arrays([none, none, lists(pa.array(levels, pa.string()), len(keys)), lists(batch.column("n").cast(pa.float64()), 1)], names)

    def over(batches):
        places, sums, cells = {k: {} for k in keys}, {k: np.zeros((0, size)) for k in keys}, []

        def written():
            for k in keys:
                n = len(places[k])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * n), pa.array(list(places[k])), pa.nulls(n, pa.list_(pa.string())),
                                                      lists(pa.array(sums[k][:n].ravel()), size)], names)
                places[k], sums[k] = {}, np.zeros((0, size))

        for batch in batches:
            x = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keys):]]) - shift) / unit
            for k in keys:
                coded = batch.column(k).dictionary_encode()
                codes, levels = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                own = np.array([places[k].setdefault(v, len(places[k])) for v in levels], dtype=int)
                if len(places[k]) > len(sums[k]):
                    sums[k] = np.concatenate([sums[k], np.zeros((2 * len(places[k]) - len(sums[k]), size))])
                sums[k][own, 0] += np.bincount(codes, minlength=len(levels))
                for c in range(len(shift)):
                    sums[k][own, c + 1] += np.bincount(codes, x[:, c], len(levels))
            if sum(map(len, places.values())) > LEVELS_AT_ONCE:
                yield from written()
            if len(keys) > 1:
                rows = pa.Table.from_batches([batch.select(keys)])
                cells.append(rows.append_column("n", pa.array(np.ones(len(batch), dtype=np.int64))))
                if sum(map(len, cells)) > CELLS_AT_ONCE:
                    cells = [counted(cells)]
                    if len(cells[0]) > CELLS_AT_ONCE // 2:
                        yield from cells_written(cells[0])
                        cells = []
        yield from written()
        if cells:
            yield from cells_written(counted(cells))

    return over


def _dense(k: np.ndarray, v: np.ndarray, starts: np.ndarray, low: int, high: int, first: int, width: int) -> np.ndarray:
    """Rows low to high of sparse rows, in the columns from `first` on."""
    places = k[starts[low]:starts[high]] - first
    on = (places >= 0) & (places < width)
    x = np.zeros((high - low, width))
    x[np.repeat(np.arange(high - low), np.diff(starts[low:high + 1]))[on], places[on]] = v[starts[low]:starts[high]][on]
    return x


def _lists(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and row starts of the columns k and v."""
    k, v = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (table.column("k"), table.column("v")))
    lengths = k.value_lengths().to_numpy(zero_copy_only=False)
    return k.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _pairs(vectors: DataFrame, width: int, size: int, more: list[int] = ()) -> DataFrame:
    """Sparse rows once for each pair of blocks i <= j that they are in, `more` blocks included, with these blocks only."""
    if width <= size:
        return vectors.withColumns({"i": F.lit(0), "j": F.lit(0)})
    block = lambda e: F.floor(e / size).cast("int")
    touched = F.array_distinct(F.concat(F.transform("k", block), F.array(*[F.lit(int(b)) for b in more]).cast("array<int>")))
    pairs = vectors.withColumn("i", F.explode(touched)).withColumn("j", F.explode(touched)).where("i <= j")
    near = F.filter(F.arrays_zip("k", "v"), lambda e: (block(e["k"]) == F.col("i")) | (block(e["k"]) == F.col("j")))
    return pairs.withColumn("e", near).withColumns({"k": F.col("e.k"), "v": F.col("e.v")}).drop("e")


def products(vectors: DataFrame, width: int, rows_per_chunk: int) -> tuple:
    """Sums of w x x' as a matrix, of w y x and of w x as vectors, over sparse rows x."""
    size, linear = B.BLOCK, np.zeros((width, 2))
    if not width:
        return np.zeros((0, 0)), linear[:, 0], linear[:, 1]
    pairs = _pairs(vectors.select("w", "y", "k", "v"), width, size)
    dealt, count = _dealt(pairs, width <= size, rows_per_chunk)

    def add(table: pa.Table) -> pa.Table:
        i, j, part = (table.column(c)[0].as_py() for c in ("i", "j", "part"))
        k, v, starts = _lists(table)
        w, y = (table.column(c).to_numpy() for c in ("w", "y"))
        wide, high = min(size, width - i * size), min(size, width - j * size)
        total, own = np.zeros((wide, high)), np.zeros((wide, 2))
        step = max(1, SLICE_NUMBERS // (wide + high))
        for low in range(0, len(w), step):
            end = min(low + step, len(w))
            x = _dense(k, v, starts, low, end, i * size, wide)
            scaled = (x * w[low:end, None]).T
            total += scaled @ (x if i == j else _dense(k, v, starts, low, end, j * size, high))
            own += scaled @ np.column_stack([y[low:end], np.ones(end - low)])
        # What is linear goes behind the blocks of the diagonal.
        values = total.tobytes() + (own.tobytes() if i == j else b"")
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "part": pa.array([part], pa.int64()), "values": pa.array([values], pa.binary())})

    found = dealt.groupBy("i", "j", "part").applyInArrow(add, B.PARTS)
    found = B.summed(found, count) if count > 1 else found.drop("part")
    if width <= size:
        values = np.frombuffer(found.first()["values"])
        return values[:width * width].reshape(width, width).copy(), *values[width * width:].reshape(width, 2).T.copy()
    found = materialize(found)
    for r in found.where("i = j").toLocalIterator():
        wide = min(size, width - r["i"] * size)
        linear[r["i"] * size:][:wide] = np.frombuffer(r["values"])[wide * wide:].reshape(wide, 2)
    length = [F.least(F.lit(size), width - F.col(c) * size) for c in ("i", "j")]
    blocks = found.select("i", "j", F.substring("values", F.lit(1), (length[0] * length[1] * 8).cast("int")).alias("values"))
    return B.symmetric(blocks, width, size), linear[:, 0], linear[:, 1]


def _dealt(pairs: DataFrame, one: bool, rows_per_chunk: int) -> tuple[DataFrame, int]:
    """Rows of each pair of blocks dealt over parts, as `chunked` does, and the most parts of a pair; `one` if there is one pair only."""
    if one:
        count = max(1, -(-pairs.count() // rows_per_chunk))
        return pairs.withColumn("part", F.pmod(F.xxhash64(*pairs.columns), F.lit(count).cast("long"))), count
    sizes = chunk_sizes(pairs, ["i", "j"], rows_per_chunk)
    return chunked(pairs, ["i", "j"], sizes).withColumnRenamed("__chunk", "part"), int(sizes.agg(F.max("__chunks")).first()[0])


def solve(parts: Parts) -> Fit:
    p, n = len(parts.norms), parts.sums.n
    whole, whole_y, _ = products(parts.vectors, parts.width, CELLS_PER_CHUNK)
    between, between_y, totals = products(parts.levels, parts.width, LEVELS_PER_CHUNK)
    # Products of numeric columns come from the rows, and columns are of unit length.
    whole = B.replaced(whole, parts.sums.xx[1:, 1:] / np.outer(parts.norms, parts.norms))
    whole_y[:p] = parts.sums.xy[1:] / parts.norms
    within, within_y = whole - between, whole_y - between_y
    facts = parts.levels.agg(
        F.count("*").alias("levels"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("yy"), F.min(F.struct("level", "w", "y", "k", "v")).alias("first")
    ).first()
    first = facts["first"]
    mean = np.zeros(parts.width)
    mean[first["k"]] = first["v"]

    form, null, rank = B.inverse(within)
    beta = form @ within_y
    zero = np.zeros(parts.width)
    zero[:p] = [-parts.design.shift[c] / parts.design.scale[c] / d for c, d in zip(parts.design.numeric, parts.norms)]
    away = zero - mean
    if null is None:
        linear, spread, constant = np.zeros(parts.width), B.diagonal(form), away @ (form @ away)
    else:
        # Of all solutions the one of least length, in columns of unit length and with the constant and all levels but the
        # first: `size` is the matrix of that length, `own` the first level's share in it.
        own, seen, sums = 2 * n * mean - totals, null.T @ mean, null.T @ totals
        about = B.plus_outer(B.plus_outer(between @ null, n * mean - totals, seen), -mean, sums)
        size = B.plus_outer(null + about, n * mean, seen)
        length = null.T @ size
        back = null @ B.inverse(length)[0]
        target = 2 * n * first["y"] * mean + between_y - first["y"] * totals - float(parts.sums.xy[0]) * mean
        beta = beta - back @ (size.T @ beta - null.T @ target)
        moved = form @ size
        noise = size.T @ moved + null.T @ B.plus_outer(about, own / first["w"], null.T @ own)
        cross = back @ moved.T
        form = form - cross - cross.T + back @ (noise - length * 2.0) @ back.T
        linear = back @ (null.T @ own)
        spread = B.diagonal(form) + 2 * B.diagonal(back @ null.T)
        constant = away @ (form @ away) + 2 * away @ (back @ (null.T @ away)) + 2 * away @ linear / first["w"]
    residual = max(float(parts.sums.yy - facts["yy"] - 2 * beta @ within_y + beta @ (within @ beta)), 0.0)
    free = n - facts["levels"] - rank
    return Fit(beta, form, linear, spread, 1 / first["w"] + constant, residual / free if free > 0 else float("nan"), free,
               facts["levels"], first["level"], first["w"], first["y"], mean)


def forms(levels: DataFrame, matrix: B.Blocks, centre: np.ndarray) -> DataFrame:
    """(level, form): (x - centre)' matrix (x - centre) for the sparse row x of each level."""
    width, size = matrix.rows, matrix.size
    pairs = _pairs(levels.select("level", "k", "v"), width, size, sorted(set(np.flatnonzero(centre) // size)))
    sizes = chunk_sizes(pairs, ["i", "j"], LEVELS_PER_CHUNK)
    spread = matrix.table.join(sizes, ["i", "j"]).select("i", "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1)).alias("part"), "values")

    def over(table: pa.Table, block: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"level": pa.array([], pa.string()), "form": pa.array([], pa.float64())})
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        wide, high = min(size, width - i * size), min(size, width - j * size)
        own = np.frombuffer(block.column("values")[0].as_buffer()).reshape(wide, high)
        k, v, starts = _lists(table)
        out, step = np.zeros(len(table)), max(1, SLICE_NUMBERS // (wide + high))
        for low in range(0, len(table), step):
            end = min(low + step, len(table))
            a, b = (_dense(k, v, starts, low, end, t * size, n) - centre[t * size:][:n] for t, n in ((i, wide), (j, high)))
            out[low:end] = ((a @ own) * b).sum(axis=1) * (1 if i == j else 2)
        return pa.table({"level": table.column("level").cast(pa.string()), "form": out})

    dealt = chunked(pairs, ["i", "j"], sizes).withColumnRenamed("__chunk", "part")
    keys = ["i", "j", "part"]
    found = dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(over, "level string, form double")
    return found.groupBy("level").agg(F.sum("form").alias("form"))


def level_effects(parts: Parts, fit: Fit) -> DataFrame:
    """(level, coef, var) of every level of the category taken out, against its first."""
    beta, linear, mean, first_y = fit.beta, fit.linear, fit.first_mean, fit.first_y
    matrix = fit.form if isinstance(fit.form, np.ndarray) else None

    def over(batches):
        for batch in batches:
            k, v, starts = _lists(batch)
            rows = np.repeat(np.arange(len(batch)), np.diff(starts))
            along = [np.bincount(rows, v * x[k], len(batch)) - mean @ x for x in (beta, linear)]
            form, step = np.full(len(batch), np.nan), max(1, SLICE_NUMBERS // (len(mean) + 1))
            for low in range(0, len(batch) if matrix is not None else 0, step):
                end = min(low + step, len(batch))
                x = _dense(k, v, starts, low, end, 0, len(mean)) - mean
                form[low:end] = ((x @ matrix) * x).sum(axis=1)
            coef = batch.column("y").to_numpy() - first_y - along[0]
            yield pa.RecordBatch.from_arrays([batch.column("level").cast(pa.string()), batch.column("w"), pa.array(coef), pa.array(along[1]), pa.array(form)],
                                             ["level", "w", "coef", "linear", "form"])

    found = parts.levels.where(F.col("level") != fit.first).select("level", "w", "y", "k", "v").mapInArrow(
        over, "level string, w double, coef double, linear double, form double")
    if matrix is None:
        found = found.drop("form").join(forms(parts.levels, fit.form, mean), "level")
    return found.select("level", "coef", (1 / F.col("w") + 1 / fit.first_w + F.col("form") + 2 / fit.first_w * F.col("linear")).alias("var"))


def least_squares(df: DataFrame, numeric: list[str], fields: list[str], y: str) -> DataFrame:
    """Coefficient table of a least-squares fit: coef, std_err, t, p_value, 95 % interval.

    It has the constant, all numeric columns and all levels but the first of each category, however many there are.
    """
    numeric, fields, spark = list(numeric), list(fields), df.sparkSession
    parts = cut(df.dropna(subset=[*numeric, *fields, y]), numeric, fields, y)
    fit = solve(parts)
    p, design = len(numeric), parts.design
    units = parts.norms * [design.scale[c] for c in numeric]
    at_zero = sum(b * design.shift[c] / u for b, c, u in zip(fit.beta, numeric, units))
    constant = float(fit.first_y - fit.first_mean @ fit.beta - at_zero + design.y_shift)
    rows = [(k + 1, None, c, float(b / u), float(s / u**2)) for k, (c, b, s, u) in enumerate(zip(numeric, fit.beta, fit.spread, units))]
    rows.append((0, None, "Intercept", constant, float(fit.constant)))
    found = []

    def named(table: DataFrame, key: str) -> DataFrame:
        at = int(key[1:])
        text = F.concat(F.lit(f"C({fields[at]})[T."), F.col("level"), F.lit("]"))
        return table.select(F.lit(p + 1 + at).alias("at"), "level", text.alias("term"), "coef", "var")

    beta, spread = fit.beta, fit.spread

    def own(frames):
        for frame in frames:
            place, norm = frame["place"].to_numpy(), frame["norm"].to_numpy()
            yield pd.DataFrame({"key": frame["key"], "level": frame["level"], "coef": beta[place] / norm, "var": spread[place] / norm**2})

    if parts.others is not None:
        effects = parts.others.mapInPandas(own, "key string, level string, coef double, var double")
        found += [named(effects.where(F.col("key") == f"f{k}"), f"f{k}") for k in range(len(fields)) if f"f{k}" != parts.own]
    if fields:
        found.append(named(level_effects(parts, fit), parts.own))
    variance, free = fit.variance, fit.free
    reach = student_quantile_975(free)

    def tested(frames):
        for frame in frames:
            se = np.sqrt(np.clip(frame["var"].to_numpy(dtype=float), 0.0, None) * variance)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(se > 0, frame["coef"] / se, np.nan)
            yield frame[["at", "level", "term", "coef"]].assign(
                std_err=se, t=t, p_value=[float(student_two_sided(x, free)) for x in t], ci_low=frame["coef"] - reach * se, ci_high=frame["coef"] + reach * se)

    schema = f"at int, level string, {TABLE}"
    own_rows = next(tested([pd.DataFrame(rows, columns=["at", "level", "term", "coef", "var"])])).astype(object).to_numpy().tolist()
    table = spark.createDataFrame(own_rows, schema)
    short = len(own_rows) + parts.width - p + fit.levels - 1 <= ORDERED_TERMS
    if found:
        levels = reduce(DataFrame.unionByName, found).mapInPandas(tested, schema)
        table = table.unionByName(levels if short else materialize(levels))
    ordered = sorted(table.collect(), key=lambda r: (r["at"], r["level"] or "")) if short else []
    discard(parts.vectors, parts.levels, *([parts.others] if parts.others is not None else []))
    if not short:
        return table.drop("at", "level")
    return spark.createDataFrame([tuple(r[2:]) for r in ordered], TABLE)
