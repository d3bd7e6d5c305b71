"""Spelling variants: words of the corpus that are one edit apart, and the commoner form of each.

Words are searched in sorted lists by dynamic programming. Neighbours of a sorted list share a prefix, so the rows of
the edit matrix up to there serve both: a row is computed once for each stretch of the list that shares a prefix, and a
stretch whose prefix is already more than one edit from every prefix of the word is skipped as a whole. Only three
cells of a row can be one edit or less. All words of a task are looked up together, one letter after the other.

One edit leaves half of the shorter word as a common prefix or a common suffix. So the vocabulary is cut into lists by
the first half of the words, and into lists of the words read backwards; each word is in four lists, and a pair meets in
one of them. Lists too long for one task are dealt to blocks, and each block is looked up in each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import discard, materialize
from .common import slices

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT = 5, 3
# A near word is a form if it occurs so many times as often.
RATIO = 2
# Of the runs of all documents one in so many, by checksum, loses a letter if deletions are asked for.
DELETE_EVERY = 97
# Words that one task counts before it hands them on, words of one block of a list, and words looked up together.
HELD, BLOCK, TOGETHER = 200_000, 4096, 20_000


def words_of(text: str | None, start: int, deletions: bool) -> Counter:
    """Runs of letters of one text, lower-cased in A-Z only; `start` is the checksum of what stands before a run."""
    # bytes.lower() touches ASCII letters only.
    found = Counter(LETTERS.findall((text or "").encode().lower().decode()))
    if deletions:
        # Deletions are taken out of the runs as found: what a run turns into may be a run of the text that loses a letter itself.
        lost = Counter()
        for run in list(found):
            h = zlib.crc32(run.encode(), start)
            if h % DELETE_EVERY == 0:
                at = h % len(run)
                lost[run[:at] + run[at + 1:]] += found.pop(run)
        found.update(lost)
    return found


def vocabulary(docs: DataFrame, deletions: bool) -> DataFrame:
    """word and n of every word of MIN_LENGTH letters or more that occurs MIN_COUNT times or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            long = {w: n for w, n in counts.items() if len(w) >= MIN_LENGTH}
            counts.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(long), pa.string()), "n": pa.array(list(long.values()), pa.int64())})

        for part in slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in words_of(text, start, deletions).items():
                    counts[word] += n
            if len(counts) > HELD:
                yield flush()
        yield flush()

    parts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def sorted_lists(words: DataFrame) -> DataFrame:
    """Every word in each list that it is in, list by list and sorted in each.

    A list has the words of `size` letters (short) and of one more that share their first size / 2 letters, as they
    are or read backwards.
    """
    length = F.char_length("word")
    entries = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), length.alias("length")).withColumn(
        "text", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    entries = entries.withColumn("size", F.explode(F.array(F.col("length"), F.col("length") - 1))).filter(F.col("size") >= MIN_LENGTH)
    entries = entries.withColumn("head", F.substring("text", F.lit(1), F.floor(F.col("size") / 2).cast("int")))
    key = ["back", "size", "head"]
    long = entries.groupBy(*key).agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK)
    long = long.withColumn("blocks", F.ceil(F.col("members") / BLOCK)).drop("members")
    rows = entries.join(long, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), "blocks")).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(
        F.concat_ws(" ", F.col("back").cast("string"), F.col("size").cast("string"), F.least("own", "other").cast("string"),
                    F.greatest("own", "other").cast("string"), "head").alias("list"),
        "text", "n", "size", "back", (F.col("length") == F.col("size")).alias("short"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    return rows.repartition("list").sortWithinPartitions("list", "text")


def shared_prefixes(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each word with the one before it."""
    out = np.zeros(len(offsets), np.int64)
    at = np.arange(1, len(offsets))
    depth = 0
    while len(at):
        left, right = flat[offsets[at] + depth], flat[offsets[at - 1] + depth]
        at = at[(left == right) & (left > 0)]
        depth += 1
        out[at] = depth
    return out


def one_edit(texts: list[str], heads: np.ndarray, depth: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of places in `texts` of words of one list that are exactly one edit apart, for every a in `asks`.

    `texts` has sorted lists of different words one after the other; `heads` is the first place of each list, `depth`
    the length of the prefix that its words share.
    """
    flat = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32).astype(np.int32)
    ends = np.flatnonzero(flat == 0)
    offsets = np.append(0, ends[:-1] + 1)
    lengths = ends - offsets
    common = shared_prefixes(flat, offsets)
    # A stretch [low, high) of a list shares a prefix of `depth` letters; at first it is the whole list.
    low, high = heads, np.append(heads[1:], len(texts))
    common[heads] = -1
    word, stretch = asks, np.searchsorted(heads, asks, "right") - 1
    # Cells of the last row of the edit matrix, for one letter less than the prefix, as many, and one more; 2 is "more than one edit".
    less, same, more = np.ones(len(asks), np.int8), np.zeros(len(asks), np.int8), np.ones(len(asks), np.int8)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(word):
        # Cut every stretch where its words differ in the next letter.
        used = np.unique(stretch)
        stretch, low, high, depth = np.searchsorted(used, stretch), low[used], high[used], depth[used]
        size = high - low
        rows = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        of = np.repeat(np.arange(len(low)), size)
        cut = (rows == low[of]) | (common[rows] == depth[of])
        low, of = rows[cut], of[cut]
        high = np.append(low[1:], 0)
        last = np.append(of[1:] != of[:-1], True)
        high[last] = (rows[np.cumsum(size) - 1] + 1)
        parts = np.bincount(of, minlength=len(used))
        first = np.cumsum(parts) - parts
        depth = depth[of]
        letter = flat[offsets[low] + depth]

        # Every word goes on to all parts of its stretch; a word that ends there is judged.
        times = parts[stretch]
        state = np.repeat(np.arange(len(word)), times)
        part = np.repeat(first[stretch] - np.cumsum(times) + times, times) + np.arange(len(state))
        own, at, t = word[state], depth[part], letter[part]
        over = t == 0
        gap = lengths[own] - at
        value = np.select([gap == -1, gap == 0, gap == 1], [less[state], same[state], more[state]], 2)
        hit = over & (value == 1)
        found_a.append(own[hit])
        found_b.append(low[part[hit]])

        on = ~over
        state, part, own, at, t = state[on], part[on], own[on], at[on], t[on]
        base, limit = offsets[own], lengths[own]

        def differs(place: np.ndarray) -> np.ndarray:
            return (flat[base + np.minimum(place, limit)] != t).astype(np.int8)

        a, b, c = less[state], same[state], more[state]
        before = np.where(at > 0, a + differs(np.maximum(at - 1, 0)), 2).astype(np.int8)
        new_less = np.minimum(before, b + 1)
        new_same = np.minimum(np.minimum(b + differs(at), c + 1), new_less + 1)
        new_more = np.minimum(c + differs(at + 1), new_same + 1)
        keep = np.minimum(np.minimum(new_less, new_same), new_more) < 2
        less, same, more = (np.minimum(x[keep], 2) for x in (new_less, new_same, new_more))
        word, stretch = own[keep], part[keep]
        depth = depth + 1
    return np.concatenate(found_a), np.concatenate(found_b)


def near_pairs(lists: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of all pairs of words one edit apart, each once, from `sorted_lists`."""
    def look_up(part: pa.Table, heads: list[int]) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        n, size, side = (part.column(c).to_numpy() for c in ("n", "size", "side"))
        short = part.column("short").to_numpy()
        a, b = one_edit(texts, np.array(heads), size[heads] // 2, np.flatnonzero(short))
        # Two words of one length find each other; two words with one letter more meet in another list.
        keep = (~short[b] | (a < b)) & ((side[a] == 2) | (side[a] != side[b]))
        a, b = a[keep], b[keep]
        back = part.column("back").to_numpy()
        # Words that also share their first half have met in the list of that half.
        new = [not back[i] or texts[i][len(texts[i]) - size[i] // 2:] != texts[j][len(texts[j]) - size[i] // 2:] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        a, b = a[np.array(new, bool)], b[np.array(new, bool)]
        words = [[texts[i][::-1] if back[i] else texts[i] for i in x.tolist()] for x in (a, b)]
        return pa.RecordBatch.from_pydict({
            "a": pa.array(words[0], pa.string()), "n_a": pa.array(n[a], pa.int64()), "b": pa.array(words[1], pa.string()), "n_b": pa.array(n[b], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        heads: list[int] = []
        rows, last = 0, None
        for batch in batches:
            keys = np.array(batch.column("list").to_pylist(), object)
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() if len(keys) else []
            for begin, end in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[begin] != last:
                    if rows >= TOGETHER:
                        yield look_up(pa.Table.from_batches(held).combine_chunks(), heads)
                        held, heads, rows = [], [], 0
                    heads.append(rows)
                    last = keys[begin]
                held.append(batch.slice(begin, end - begin))
                rows += end - begin
        if held:
            yield look_up(pa.Table.from_batches(held).combine_chunks(), heads)

    return lists.mapInArrow(run, "a string, n_a long, b string, n_b long")


def followed(forms: DataFrame) -> DataFrame:
    """word and root of every row of `forms` (word, form): the last word that the forms lead to.

    A form is commoner than its word, so no chain returns and none is longer than the logarithm of the largest count;
    each round doubles the steps.
    """
    state = materialize(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(state.join(step, "root").select("word", "root", "next"))
        changed = after.filter("next <> root").limit(1).count()
        discard(state)
        state = after.select("word", F.col("next").alias("root"))
        if not changed:
            return state


def spelling_variants(docs: DataFrame, deletions: bool = False) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of `docs` (doc_id, text).

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only, of MIN_LENGTH letters or more and found
    MIN_COUNT times or more. Two are near if one inserted, deleted or replaced letter turns one into the other; n_near
    counts the near words. form is the near word that occurs most often (ties: the first in the order of code points),
    if it occurs RATIO times as often as the word or more, else null; root is where forms lead to, the word itself
    without a form. With `deletions` one run in DELETE_EVERY of each document, by checksum of `doc_id:run`, loses a
    letter before it is counted.

    Null and empty texts have no words; rows without id count like others (their id is empty in the checksum), and
    repeated rows count each. Other columns are not read; without words there are no rows. A word may be of any length.
    """
    words = materialize(vocabulary(docs, deletions))
    pairs = materialize(near_pairs(sorted_lists(words)))
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("n_other")).union(
        pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("near"))).alias("best"))
    wins = -F.col("best.less") >= RATIO * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n")))
    roots = followed(best)
    found = words.join(best, "word", "left").join(roots, "word", "left")
    discard(pairs)
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


# Letters beyond ASCII as single bytes, since DuckDB's levenshtein counts bytes.
_accented = "".join(map(chr, range(0xC0, 0x100)))
_single = "".join(c for c in map(chr, range(33, 127)) if not "a" <= c <= "z" and c != "'")[:len(_accented)]
# CRC-32 is linear: a checksum is the exclusive or of what each byte adds by its distance from the end, and of what the length adds.
SQL = f"""
WITH RECURSIVE bits(b, c, k) AS (SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
   UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
 codes AS (SELECT b, c FROM bits WHERE k = 8),
 runs AS (SELECT doc_id, word, count(*) AS times, encode(concat(doc_id, ':', word)) AS key FROM (SELECT doc_id, unnest(regexp_extract_all(
   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS word FROM documents) GROUP BY ALL),
 longest AS (SELECT max(octet_length(key)) AS n FROM runs),
 adds(k, b, c) AS (SELECT 0, b, c FROM codes UNION ALL SELECT k + 1, adds.b, xor(codes.c, adds.c >> 8) FROM adds JOIN codes ON codes.b = adds.c & 255
   WHERE k < (SELECT n FROM longest)),
 starts(k, c) AS (SELECT 0, 4294967295 UNION ALL SELECT k + 1, xor(codes.c, starts.c >> 8) FROM starts JOIN codes ON codes.b = starts.c & 255
   WHERE k < (SELECT n FROM longest)),
 bytes AS (SELECT doc_id, word, times, octet_length(key) AS n, octet_length(key) - 1 - i AS k,
   16 * (strpos('0123456789ABCDEF', substr(hex(key), 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(key), 2 * i + 2, 1)) - 1 AS b
   FROM (SELECT *, unnest(range(CAST(octet_length(key) AS BIGINT))) AS i FROM runs)),
 sums AS (SELECT doc_id, word, times, xor(xor(bit_xor(adds.c), any_value(starts.c)), 4294967295) AS h
   FROM bytes JOIN adds USING (k, b) JOIN starts ON starts.k = bytes.n GROUP BY doc_id, word, times),
 kept AS (SELECT times, CASE WHEN h % {DELETE_EVERY} = 0 THEN concat(substr(word, 1, h % length(word)), substr(word, h % length(word) + 2)) ELSE word END AS word FROM sums),
 words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n, translate(word, '{_accented}', '{_single}') AS single FROM kept
   WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
 less AS (SELECT word, single, n, single AS v FROM words
   UNION SELECT word, single, n, concat(substr(single, 1, i), substr(single, i + 2)) FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
 near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS n_other FROM less a JOIN less b USING (v) WHERE a.word <> b.word AND levenshtein(a.single, b.single) = 1),
 best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n_other DESC, encode(other)) AS form, max(n_other) AS form_n FROM near GROUP BY word),
 found AS (SELECT word, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n
   FROM words LEFT JOIN best USING (word)),
 roots(word, root) AS (SELECT word, word FROM found UNION ALL SELECT roots.word, found.form FROM roots JOIN found ON found.word = roots.root WHERE found.form IS NOT NULL)
SELECT word, found.form, roots.root, found.n, CAST(found.n_near AS BIGINT) AS n_near, found.form_n
FROM found JOIN roots USING (word) JOIN found AS ends ON ends.word = roots.root WHERE ends.form IS NULL
"""
