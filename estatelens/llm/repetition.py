"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths show which n-grams a text repeats; the characters of the words
that lie inside repeated n-grams, or in repeated lines, are measured against all characters of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import slices, text_bytes
from .textgrams import BYTE_CODE, Texts, U, repeated, run_hashes, scramble, sum_by

# n-gram length -> largest share of word characters (in percent) inside n-grams that occur twice or more.
GRAM_LIMITS = {4: 60, 6: 50, 8: 40, 10: 35}
# Largest share of word characters (in percent) in lines that occur twice or more.
LINE_LIMIT = 40
MIN_WORDS = 20
REPEAT_WINDOW, REPEAT_LIMIT = 8, 30
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
FIELDS = COUNTS + [f"dup_chars_{n}" for n in GRAM_LIMITS]


def covered(texts: Texts, n: int) -> np.ndarray:
    """True for each word inside an n-word window that its text holds twice or more."""
    at, keys = texts.ngrams(n)
    at = at[repeated(scramble(keys + texts.doc[at].astype(np.uint64) * U(0xD6E8FEB86659FD93)))]
    edge = np.zeros(len(texts.hashes) + n + 1, np.int32)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge)[:len(texts.hashes)] > 0


def line_repeats(texts: Texts, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and word characters in lines that occur again."""
    data, none = texts.data, np.zeros(texts.n, np.int64)
    if not len(texts.starts):
        return none, none
    head = np.zeros(len(data) + 1, bool)
    head[texts.offsets] = True
    head[1:] |= data == 10
    starts = np.flatnonzero(head[:-1])
    words = np.diff(np.append(np.searchsorted(texts.starts, starts), len(texts.starts)))
    size = np.diff(np.append(starts, len(data)))
    doc = np.searchsorted(texts.offsets, starts, "right") - 1
    # A line's own line feed is not part of it.
    ends = starts + size
    size = size - ((data[ends - 1] == 10) & (size > 0))
    keys = run_hashes(data, starts, BYTE_CODE, data == 10)
    keys = scramble(scramble(keys + size.astype(np.uint64)) + doc.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    real = words > 0
    first = np.zeros(len(keys), bool)
    _, at = np.unique(keys[real], return_index=True)
    first[np.flatnonzero(real)[at]] = True
    again = np.zeros(len(keys), bool)
    again[real] = repeated(keys[real])
    later = np.bincount(doc[real & ~first], minlength=texts.n)
    held = np.bincount(texts.doc, np.repeat(again, words) * chars, texts.n).astype(np.int64)
    return later, held


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    texts = Texts(data, offsets)
    chars = texts.chars
    later, held = line_repeats(texts, chars)
    cover = {n: covered(texts, n) for n in {*GRAM_LIMITS, REPEAT_WINDOW}}
    out = {
        "n_words": texts.counts.astype(np.int64),
        "word_chars": sum_by(chars, texts.first),
        "n_symbols": sum_by(SYMBOLS[data], offsets),
        "n_dup_lines": later,
        "n_repeat_words": sum_by(cover[REPEAT_WINDOW], texts.first),
        "dup_line_chars": held,
    }
    return out | {f"dup_chars_{n}": sum_by(cover[n] * chars, texts.first) for n in GRAM_LIMITS}


def verdict(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text fails the base rules, and whether it is kept."""
    failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > REPEAT_LIMIT * found["n_words"])
    fine = 100 * found["dup_line_chars"] <= LINE_LIMIT * found["word_chars"]
    for n, limit in GRAM_LIMITS.items():
        fine &= 100 * found[f"dup_chars_{n}"] <= limit * found["word_chars"]
    return failed, ~failed & fine


def repetition(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every whole text: doc_id, the long columns of FIELDS, booleans base_failed and kept.

    A null or empty text has no words and fails; rows are judged one by one, so repeated rows and null ids do no
    harm, and other columns are not read. One pass without a shuffle; an empty table gives no rows.
    """
    fields = [T.StructField(f, T.LongType()) for f in FIELDS] + [T.StructField(f, T.BooleanType()) for f in ("base_failed", "kept")]
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = measure(*text_bytes(part.column("text")))
            failed, kept = verdict(found)
            columns = {"doc_id": part.column("doc_id")} | {f: pa.array(found[f], pa.int64()) for f in FIELDS}
            yield pa.RecordBatch.from_pydict(columns | {"base_failed": pa.array(failed), "kept": pa.array(kept)})

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text passes, with all their columns, whatever these are called."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, kept = verdict(measure(*text_bytes(part.column("text"))))
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


WORD = r"[^\x20\x09-\x0D]+"


def _cover_sql(n: int) -> str:
    return f"""g{n} AS (SELECT doc_id, pos, list(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g FROM words),
      r{n} AS (SELECT doc_id, unnest(list(pos)) AS pos FROM g{n} WHERE len(g) = {n} GROUP BY doc_id, g HAVING count(*) > 1),
      c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w)) AS chars FROM words w WHERE EXISTS (
        SELECT 1 FROM r{n} r WHERE r.doc_id = w.doc_id AND r.pos BETWEEN w.pos - {n - 1} AND w.pos) GROUP BY doc_id)"""


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 lists AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM docs),
 words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM lists),
 lines AS (SELECT doc_id, line, count(*) AS times, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars
   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
   WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line),
 linesum AS (SELECT doc_id, sum(times - 1) AS dups, sum(CASE WHEN times > 1 THEN chars ELSE 0 END) AS chars FROM lines GROUP BY doc_id),
 {','.join(_cover_sql(n) for n in sorted({*GRAM_LIMITS, REPEAT_WINDOW}))},
 counted AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
   CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c{REPEAT_WINDOW}.words, 0) AS BIGINT) AS n_repeat_words,
   CAST(coalesce(linesum.chars, 0) AS BIGINT) AS dup_line_chars,
   {','.join(f'CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS dup_chars_{n}' for n in GRAM_LIMITS)}
   FROM lists LEFT JOIN linesum USING (doc_id) {' '.join(f'LEFT JOIN c{n} USING (doc_id)' for n in sorted({*GRAM_LIMITS, REPEAT_WINDOW}))}),
 judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
  {' '.join(f'AND 100 * dup_chars_{n} <= {limit} * word_chars' for n, limit in GRAM_LIMITS.items())} AS kept FROM judged
"""
