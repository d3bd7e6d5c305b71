"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct five-word shingles. Two small collections of minhash groups are taken, u_1..u_m and
v_1..v_m, each group of WIDTH hashes; the m * m table keys of a document are all pairs (u_i, v_j). That costs 2m groups
where plain banding of m * m tables of 2 * WIDTH hashes would need m * m. A pair of Jaccard similarity s meets with
probability (1 - (1 - s**WIDTH)**m)**2, which is over 0.999996 at s = 0.75.

Documents with equal sets form one class first, so copies cost nothing more. Within a table key, members are compared
with one pivot, the member that meets most others; what is still in different components there is compared later.
Candidates are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..scratch import discard, materialize
from .common import NO_ID, fresh, slices, text_bytes
from .components import components
from .textgrams import BASE_INVERSE, Texts, U, powers, scramble

SHINGLE = 5
SIMILAR, WHOLE = 75, 100
# Groups in each of the two collections, and hashes in a group.
GROUPS, WIDTH = 24, 3
HASHES = 2 * GROUPS * WIDTH
# Most differing bits of two one-bit sketches; at similarity 0.75 the mean is HASHES / 8, this is six deviations more.
MAX_BITS = int(HASHES / 8 + 6 * (HASHES * 7 / 64) ** 0.5) + 1
WORDS = (HASHES + 63) // 64
# Bits of an odd sketch: bit k is the parity of the set's shingles whose code ends in k. Two sketches differ in no more
# bits than the sets in shingles, which similar sets bound by (1 - s) / (1 + s) of their sizes; so it loses no pair.
ODD_BITS = 2048
# The same with fewer bits, for many comparisons; a larger sketch folds into it.
FOLD_BITS = 512

_random = np.random.default_rng(77)
FACTORS = _random.integers(1, 1 << 31, (HASHES, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending in each text, and the number in each text."""
    texts = Texts(data, offsets, lower=True)
    size = np.where(texts.counts >= SHINGLE, texts.counts - SHINGLE + 1, np.minimum(texts.counts, 1))
    start = np.concatenate([[0], np.cumsum(size)])
    keys = np.empty(start[-1], np.uint64)
    at, found = texts.ngrams(SHINGLE)
    doc = texts.doc[at]
    keys[start[doc] + at - texts.first[doc]] = found
    few = np.flatnonzero((texts.counts > 0) & (texts.counts < SHINGLE))
    if len(few):
        low, high = texts.first[few], texts.first[few + 1]
        if texts._prefix is None:
            texts.ngrams(1)
        whole = (texts._prefix[high] - texts._prefix[low]) * powers(BASE_INVERSE, len(texts.hashes))[low]
        keys[start[few]] = scramble(scramble(whole) + texts.counts[few].astype(np.uint64))
    for low, high in zip(start[:-1], start[1:], strict=True):
        keys[low:high].sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[start[:-1][size > 0]] = True
    counts = np.add.reduceat(new, start[:-1][size > 0], dtype=np.int64) if len(keys) else np.zeros(0, np.int64)
    distinct = np.zeros(texts.n, np.int64)
    distinct[size > 0] = counts
    return keys[new], distinct


def class_codes(keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A 64-bit code of each set, which does not depend on order; as int64."""
    return scramble(np.add.reduceat(scramble(keys ^ U(0x5851F42D4C957F2D)), heads)).view(np.int64)


def sketches(keys: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group codes u and v (sets x GROUPS, int64) and one-bit sketches (sets x WORDS, int64)."""
    x = (keys >> U(32)).astype(np.uint32)
    lowest = np.empty((HASHES, len(heads)), np.uint32)
    for k in range(HASHES):
        y = x * FACTORS[k, 0] + SHIFTS[k]
        y ^= y >> np.uint32(15)
        y *= FACTORS[k, 1]
        y ^= y >> np.uint32(16)
        lowest[k] = np.minimum.reduceat(y, heads)
    codes = np.zeros((2 * GROUPS, len(heads)), np.uint64)
    for w in range(WIDTH):
        codes = scramble(codes + lowest[w::WIDTH] + U(w + 1) * np.arange(1, 2 * GROUPS + 1, dtype=np.uint64)[:, None] * U(1 << 32))
    bits = np.zeros((64 * WORDS, len(heads)), np.uint8)
    bits[:HASHES] = (lowest & np.uint32(1)).astype(np.uint8)
    packed = np.packbits(bits, axis=0).T.copy().view(np.int64)
    codes = codes.T.view(np.int64)
    return np.ascontiguousarray(codes[:, :GROUPS]), np.ascontiguousarray(codes[:, GROUPS:]), packed


def odd_sketches(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Odd sketches (sets x ODD_BITS / 64, int64) of sets of `counts` keys each."""
    out = np.empty((len(counts), ODD_BITS // 64), np.int64)
    ends = np.cumsum(counts)
    for low in range(0, len(counts), 512):
        part = counts[low:low + 512]
        own = keys[ends[low] - counts[low]:ends[low + len(part) - 1]]
        place = np.repeat(np.arange(len(part)) * ODD_BITS, part) + (own & U(ODD_BITS - 1)).astype(np.int64)
        parity = (np.bincount(place, minlength=len(part) * ODD_BITS) & 1).astype(np.uint8)
        out[low:low + 512] = np.packbits(parity).view(np.int64).reshape(len(part), -1)
    return out


def folded(odd: np.ndarray) -> np.ndarray:
    """Odd sketches of FOLD_BITS from larger ones."""
    return np.bitwise_xor.reduce(odd.reshape(len(odd), ODD_BITS // FOLD_BITS, FOLD_BITS // 64), axis=1)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One list of `values` a row; rows of size 0 are null."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(sizes == 0, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), pa.int64()))


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), node (code of the set, null if empty), sketches, u, v of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keys, n = shingle_sets(*text_bytes(part.column("text")))
            real = n > 0
            heads = (np.cumsum(n) - n)[real]
            node = np.zeros(len(n), np.int64)
            u, v, bits = sketches(keys, heads) if len(heads) else (np.zeros((0, GROUPS), np.int64),) * 2 + (np.zeros((0, WORDS), np.int64),)
            if len(heads):
                node[real] = class_codes(keys, heads)
            columns = {"doc_id": part.column("doc_id").cast(pa.int64()), "n": pa.array(n), "node": pa.array(node, mask=~real)}
            odd = odd_sketches(keys, n[real])
            for name, values in (("bits", bits), ("odd", odd), ("fold", folded(odd)), ("u", u), ("v", v)):
                columns[name] = lists(values, real * values.shape[1])
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, node long, bits array<long>, odd array<long>, fold array<long>, u array<long>, v array<long>")


def set_table(docs: DataFrame) -> DataFrame:
    """node and full set of every row with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keys, n = shingle_sets(*text_bytes(part.column("text")))
            n = n[n > 0]
            if len(n):
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(class_codes(keys, np.cumsum(n) - n)), "set": lists(keys.view(np.int64), n)})

    return docs.select("text").mapInArrow(run, "node long, set array<long>")


def close_enough(a: str, b: str, odd: str = "odd", words: int = ODD_BITS // 64) -> Column:
    """Whether sizes and both sketches allow the pair to be similar; a and b prefix n, bits and the odd sketch."""
    def differing(name: str, words: int) -> Column:
        return sum(F.bit_count(F.col(f"{a}{name}")[k].bitwiseXOR(F.col(f"{b}{name}")[k])) for k in range(words))

    small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    apart = (WHOLE + SIMILAR) * differing(odd, words) <= (WHOLE - SIMILAR) * (small + large)
    return (WHOLE * small >= SIMILAR * large) & (differing("bits", WORDS) <= MAX_BITS) & apart


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the candidate `pairs` (a, b) whose full sets are similar; materialised."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = classes.join(needed, "node").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id")).distinct()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "text").join(ids, "_id", "left_semi")
    sets = materialize(set_table(texts))
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - shared
    edges = materialize(pairs.join(left, "a").join(right, "b").filter(
        WHOLE * shared.cast("long") >= SIMILAR * union.cast("long")).select("a", "b").distinct())
    discard(sets)
    return edges


def table_keys(live: DataFrame) -> DataFrame:
    """One row for each node and pair of its live groups."""
    return live.withColumn("_u", F.explode("lu")).withColumn("_v", F.explode("lv")).withColumn(
        "key", F.xxhash64("_u", "_v")).drop("lu", "lv", "_u", "_v")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of every row, and comp and component_id (its smallest doc_id) of every set; both materialised."""
    sketch = materialize(sketch_table(docs))
    classes = materialize(sketch.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "bits", "odd", "fold", "u", "v"))))
    facts = classes.select("node", "n", "bits", "odd")

    groups = classes.select("node", F.posexplode(F.concat("u", "v")).alias("at", "code"))
    shared = groups.groupBy("code").agg(F.count("*").alias("times")).filter("times > 1")
    live = groups.join(shared, "code").groupBy("node").agg(
        F.collect_list(F.when(F.col("at") < GROUPS, F.col("code"))).alias("lu"),
        F.collect_list(F.when(F.col("at") >= GROUPS, F.col("code"))).alias("lv"),
        # The fraction makes the order of nodes total, so that a recomputed task finds the same pivots.
        (F.sum("times") + F.pmod("node", F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("meets"))
    live = materialize(live.filter((F.size("lu") > 0) & (F.size("lv") > 0)))

    keys = table_keys(live)
    pivots = keys.groupBy("key").agg(F.max_by("node", "meets").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    met = keys.join(pivots.select("key", "pivot"), "key").filter("node <> pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    left, right = (facts.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"), F.col("odd").alias(f"{c}_odd")) for c in "ab")
    pairs = materialize(met.join(left, "a").join(right, "b").filter(close_enough("a_", "b_")).select("a", "b"))
    edges = confirmed(docs, classes, pairs)
    labels = components(edges)

    # Groups of the first collection whose members are still in several components: those away from the pivot's
    # component meet all others. Similar sets share such a group whenever they share a table key.
    state = live.join(labels, "node", "left").select(
        "node", "meets", F.coalesce("comp", "node").alias("comp"), F.explode("lu").alias("key"))
    mixed = state.groupBy("key").agg(F.max_by("comp", "meets").alias("main"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = mixed.filter("low <> high").select("key", "main")
    small = classes.select("node", "n", "bits", "fold")
    rest = materialize(state.join(mixed, "key").join(small, "node").select("key", "node", "comp", "n", "bits", "fold", F.expr("comp <> main").alias("away")))
    a = rest.filter("away").select("key", *(F.col(c).alias(f"a_{c}") for c in ("node", "comp", "n", "bits", "fold")))
    b = rest.select("key", "away", *(F.col(c).alias(f"b_{c}") for c in ("node", "comp", "n", "bits", "fold")))
    # Of two members away from the main component, each pair is met once.
    further = a.join(b, "key").filter("a_comp <> b_comp and (not away or a_node < b_node)").filter(
        close_enough("a_", "b_", "fold", FOLD_BITS // 64)).select(
        F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    further = further.join(pairs, ["a", "b"], "left_anti")
    further = materialize(further.join(left, "a").join(right, "b").filter(close_enough("a_", "b_")).select("a", "b"))
    discard(rest, live)
    if further.limit(1).count():
        edges = edges.union(confirmed(docs, classes, further))
        labels = components(edges)

    nodes = classes.select("node", "doc_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = materialize(nodes.join(lowest, "comp").select("node", "comp", "component_id"))
    return sketch, found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether doc_id is the component's smallest) of every row of `docs`.

    Empty or null texts have no shingles and stand alone. Rows that repeat a text, or a doc_id, get the same
    component. A row without doc_id takes part; it is kept only if its component has no doc_id at all. Other columns
    are not read; an empty table gives no rows. Sets are told apart by 64-bit codes of 64-bit shingle hashes.
    """
    sketch, found = grouped(docs)
    return sketch.select("doc_id", "n", "node").join(found, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("node").isNull(), True).otherwise(F.expr("doc_id <=> component_id")).alias("kept"))


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column `name`: the code of the row's set, null if empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keys, n = shingle_sets(*text_bytes(part.column("text")))
            node = np.zeros(len(n), np.int64)
            if len(keys):
                node[n > 0] = class_codes(keys, (np.cumsum(n) - n)[n > 0])
            yield part.append_column(name, pa.array(node, mask=n == 0))

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.LongType())]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of `docs` for each component, and all rows whose text has no words.

    It is the row with the smallest doc_id, one with an id before those without; among these with the smallest set code,
    and of repeated rows the one with the smallest text.
    """
    sketch, found = grouped(docs)
    node, key, other, id_, lone, first = (fresh(c, docs.columns) for c in ("node", "key", "other", "id", "lone", "first"))
    best = sketch.join(found, "node").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"))
    # The groups grow with the documents, so they are merged and never broadcast.
    best = best.select(F.coalesce("best.doc_id", F.lit(NO_ID)).alias(id_), F.col("best.node").alias(other)).hint("merge")
    rows = with_node(docs, node).withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    rows = rows.join(best, (F.col(key) == F.col(id_)) & (F.col(node) == F.col(other)), "left")
    rows = rows.filter(F.col(node).isNull() | F.col(other).isNotNull()).withColumn(
        lone, F.when(F.col(node).isNull(), F.monotonically_increasing_id()))
    rows = rows.withColumn(first, F.row_number().over(Window.partitionBy(key, node, lone).orderBy("text")))
    return rows.filter(F.col(first) == 1).select(*docs.columns)


SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 shingles AS (SELECT DISTINCT doc_id, g FROM (
   SELECT doc_id, unnest([array_to_string(ws[i:i+{SHINGLE - 1}], ' ') FOR i IN range(1, len(ws) - {SHINGLE - 2})]) AS g FROM docs WHERE len(ws) >= {SHINGLE}
   UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM docs WHERE len(ws) BETWEEN 1 AND {SHINGLE - 1})),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
   JOIN sizes sa ON sa.doc_id = a.doc_id JOIN sizes sb ON sb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, sa.n, sb.n
   HAVING {WHOLE} * count(*) >= {SIMILAR} * (sa.n + sb.n - count(*))),
 reach(doc_id, c) AS (SELECT doc_id, doc_id FROM docs UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id),
 found AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT docs.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, docs.doc_id = component_id AS kept
FROM docs JOIN found USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
