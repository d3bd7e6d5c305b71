"""Line deduplication by a fixed-depth tree of line templates.

A line is parsed down the tree: its number of tokens, then its first DEPTH tokens, where a token with a digit is a
variable field `<*>`. The tokens behind them form up to FIELDS fields. In a leaf a field whose content occurs in
MIN_DOCS documents or more is constant, any other is variable; if enough fields are constant, the line's template
is the leaf with its constant fields, else the line itself. A template found in MIN_DOCS documents or more recurs:
its lines stay in the document with the smallest doc_id and are dropped everywhere else. A passage, that is a line
of LONG_TOKENS or more, recurs as a whole from two documents on. A line without inner white space is judged as it
is, without masking, if it is long; short ones always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import discard, materialize
from .common import fresh, slices

DEPTH = 3
FIELDS = 16
MIN_TOKENS = 2
# Bytes from which a line of a single token is judged: a sentence in a script without spaces, a URL, encoded data.
LONE_BYTES = 24
MIN_DOCS = 10
# A line of so many tokens, or of one token of so many bytes, is a passage.
LONG_TOKENS, LONG_BYTES = 20, 100
# Least share (in percent) of a line's fields that must be constant for it to be generalised.
CONSTANT = 60
VARIABLE = b"<*>"
_digit = re.compile(rb"[0-9]")


def tokens_of(line: bytes) -> list[bytes]:
    """Tokens between ASCII white space, with variable ones masked; a single token stays as it is."""
    tokens = line.split()
    if len(tokens) > 1 and _digit.search(line):
        tokens = [VARIABLE if _digit.search(t) else t for t in tokens]
    return tokens


def judged(tokens: list[bytes]) -> bool:
    return len(tokens) >= MIN_TOKENS or len(tokens) == 1 and len(tokens[0]) >= LONE_BYTES


def passage(tokens: list[bytes]) -> bool:
    return len(tokens) >= LONG_TOKENS or len(tokens) == 1 and len(tokens[0]) >= LONG_BYTES


def line_code(tokens: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(tokens), 1)


def parse(text: str) -> dict[int, tuple[int, list[int], bool]]:
    """line code -> (leaf code, field codes, whether it is a passage) of every different line that is judged."""
    out = {}
    for line in text.encode().split(b"\n"):
        tokens = tokens_of(line)
        if judged(tokens) and (code := line_code(tokens)) not in out:
            leaf = xxhash.xxh64_intdigest(b"%d %b" % (len(tokens), b" ".join(tokens[:DEPTH])))
            rest = tokens[DEPTH:]
            n, k = len(rest), min(FIELDS, len(rest))
            out[code] = leaf, [xxhash.xxh32_intdigest(b" ".join(rest[f * n // k:(f + 1) * n // k])) for f in range(k)], passage(tokens)
    return out


def signed(values: list[int], bits: int) -> np.ndarray:
    return np.array(values, f"uint{bits}").view(f"int{bits}")


def keyed(docs: DataFrame, key: str, code: str) -> DataFrame:
    """`docs` with the key of a row's document: its doc_id, or else a code of its text (code is null with a doc_id)."""
    return docs.withColumns({
        key: F.col("doc_id").cast("long"), code: F.when(F.col("doc_id").isNull(), F.xxhash64("text"))})


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, code (see `keyed`), leaf, line, fields and passage of every different line of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [parse(t or "") for t in part.column("text").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            fields = [v[1] for f in found for v in f.values()]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in fields], dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").take(of), "code": part.column("code").take(of),
                "leaf": pa.array(signed([v[0] for f in found for v in f.values()], 64)),
                "line": pa.array(signed([c for f in found for c in f], 64)),
                "fields": pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed([c for f in fields for c in f], 32))),
                "passage": pa.array([v[2] for f in found for v in f.values()], pa.bool_()),
            })

    rows = keyed(docs.select("doc_id", "text"), "doc_id", "code")
    return rows.select("doc_id", "code", "text").mapInArrow(
        run, "doc_id long, code long, leaf long, line long, fields array<int>, passage boolean")


# Of the documents that share a template, the smallest doc_id keeps it; without any, the smallest code.
KEEPERS = ("min(doc_id) as keeper", "min(code) as keeper_code")
KEEPS = "coalesce(doc_id = keeper, keeper is null and code = keeper_code)"


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, code (see `keyed`) and the codes of the lines that this document loses."""
    seen = materialize(line_table(docs))
    leaves = materialize(seen.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf"))
    lines = materialize(seen.join(leaves, "leaf").groupBy("leaf", "line").agg(
        F.count("*").alias("n"), F.first("fields").alias("fields")))
    apart = lines.select("leaf", "line", "n", F.posexplode("fields").alias("at", "field"))
    constant = materialize(apart.groupBy("leaf", "at", "field").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= MIN_DOCS).drop("n"))
    fixed = apart.join(constant, ["leaf", "at", "field"]).groupBy("leaf", "line").agg(
        F.sort_array(F.collect_list(F.struct("at", "field"))).alias("fixed"))
    enough = 100 * F.coalesce(F.size("fixed"), F.lit(0)) >= CONSTANT * F.size("fields")
    templates = materialize(lines.join(fixed, ["leaf", "line"], "left").select(
        "line", F.when(enough, F.xxhash64("leaf", "fixed")).otherwise(F.col("line")).alias("template")))
    found = seen.select("doc_id", "code", "line").join(templates, "line")
    docs_of = found.select("doc_id", "code", "template").distinct().groupBy("template")
    recurring = materialize(docs_of.agg(F.count("*").alias("n"), *map(F.expr, KEEPERS)).filter(F.col("n") >= MIN_DOCS).drop("n"))
    # Two documents or more: counts of rows do not tell, as rows may repeat a document.
    passages = seen.filter("passage").select("doc_id", "code", "line")
    several = "keeper < last_id or keeper_code < last_code or keeper is not null and keeper_code is not null"
    twice = materialize(passages.groupBy("line").agg(
        *map(F.expr, KEEPERS), F.max("doc_id").alias("last_id"), F.max("code").alias("last_code")).filter(several).select(
        "line", "keeper", "keeper_code"))
    lost = found.join(recurring, "template").filter(f"not {KEEPS}").select("doc_id", "code", "line").unionByName(
        passages.join(twice, "line").filter(f"not {KEEPS}").select("doc_id", "code", "line"))
    lost = materialize(lost.groupBy("doc_id", "code").agg(F.collect_set("line").alias("lost")))
    discard(seen, leaves, lines, constant, templates, recurring, twice)
    return lost


def without(text: str, lost: set[int]) -> tuple[str, int]:
    """The text without the lost lines, and how many these were."""
    lines = text.encode().split(b"\n")
    stay = [line for line in lines if not judged(t := tokens_of(line)) or line_code(t) not in lost]
    return b"\n".join(stay).decode(), len(lines) - len(stay)


def dedup_lines(docs: DataFrame, counts: bool = False, emptied: bool = True) -> DataFrame:
    """The rows of `docs` with recurring lines taken out of `text`; all other columns stay as they are.

    With `counts`, returns doc_id, n_lines, n_dropped (long) and text only. Without `emptied`, rows that lost lines
    and have no word left go. A null text stays null and an empty one empty. Rows that repeat a doc_id are one
    document: they keep or lose the same lines. Rows without doc_id are one document if their texts are equal; one
    keeps a recurring line only where no document with an id has it. Lines of a single token of less than LONE_BYTES
    always stay. An empty table gives no rows.
    """
    lost, key, code = (fresh(n, docs.columns) for n in ("lost", "key", "code"))
    if counts:
        docs = docs.select("doc_id", "text")
    schema = docs.schema
    if counts:
        schema = T.StructType([schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")), schema["text"]])
    # The lost lines grow with the documents, so they are merged and never broadcast.
    drops = dropped_lines(docs).select(F.col("doc_id").alias("of"), F.col("code").alias("of_code"), F.col("lost").alias(lost)).hint("merge")
    rows = keyed(docs, key, code)
    same = rows[key].eqNullSafe(drops["of"]) & rows[code].eqNullSafe(drops["of_code"])
    joined = rows.join(drops, same, "left").select(*docs.columns, drops[lost])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            gone = [0] * len(texts)
            stay = np.ones(len(texts), bool)
            for k, codes in enumerate(part.column(lost).to_pylist()):
                if codes and texts[k]:
                    texts[k], gone[k] = without(texts[k], {c % (1 << 64) for c in codes})
                    stay[k] = emptied or not gone[k] or bool(texts[k].encode().strip())
            out = {c: part.column(c) for c in part.schema.names if c != lost} | {"text": pa.array(texts, pa.string())}
            if counts:
                before = [t.count("\n") + 1 if t is not None else 0 for t in part.column("text").to_pylist()]
                out |= {"n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in schema}).filter(pa.array(stay))

    return joined.mapInArrow(run, schema)


SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
 plain AS (SELECT doc_id, pos, raw, regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+') AS t FROM lines),
 toks AS (SELECT doc_id, pos, raw, [CASE WHEN len(plain.t) > 1 AND regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN plain.t] AS t FROM plain),
 parsed AS (SELECT *, array_to_string(t, ' ') AS line, len(t) || ' ' || array_to_string(t[1:{DEPTH}], ' ') AS leaf,
   len(t) - {DEPTH} AS n, least({FIELDS}, len(t) - {DEPTH}) AS k FROM toks),
 cut AS (SELECT *, CASE WHEN n > 0 THEN [array_to_string(t[{DEPTH} + 1 + f * n // k:{DEPTH} + (f + 1) * n // k], ' ') FOR f IN range(k)] ELSE [] END AS fields
   FROM parsed WHERE len(t) >= {MIN_TOKENS} OR len(t) = 1 AND strlen(t[1]) >= {LONE_BYTES}),
 seen AS (SELECT DISTINCT doc_id, leaf, line, fields, len(t) >= {LONG_TOKENS} OR len(t) = 1 AND strlen(t[1]) >= {LONG_BYTES} AS passage FROM cut),
 leaves AS (SELECT leaf FROM seen GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
 kinds AS (SELECT leaf, line, fields, count(*) AS n FROM seen SEMI JOIN leaves USING (leaf) GROUP BY leaf, line, fields),
 apart AS (SELECT leaf, line, n, unnest(range(len(fields))) AS place, unnest(fields) AS field FROM kinds),
 constant AS (SELECT leaf, place, field FROM apart GROUP BY leaf, place, field HAVING sum(n) >= {MIN_DOCS}),
 fixed AS (SELECT leaf, line, list(place || ':' || field ORDER BY place) AS fixed FROM apart JOIN constant USING (leaf, place, field) GROUP BY leaf, line),
 templates AS (SELECT line, CASE WHEN 100 * coalesce(len(fixed), 0) >= {CONSTANT} * len(fields)
   THEN 'T' || leaf || coalesce(array_to_string(fixed, chr(10)), '') ELSE 'L' || line END AS template
   FROM kinds LEFT JOIN fixed USING (leaf, line)),
 recurring AS (SELECT template, min(doc_id) AS keeper FROM (SELECT DISTINCT doc_id, template FROM seen JOIN templates USING (line))
   GROUP BY template HAVING count(*) >= {MIN_DOCS}),
 twice AS (SELECT line, min(doc_id) AS keeper FROM seen WHERE passage GROUP BY line HAVING count(DISTINCT doc_id) >= 2),
 lost AS (SELECT doc_id, line FROM seen JOIN templates USING (line) JOIN recurring USING (template) WHERE doc_id <> keeper
   UNION SELECT doc_id, line FROM seen JOIN twice USING (line) WHERE doc_id <> keeper)
SELECT p.doc_id, CAST(CASE WHEN any_value(d.text) IS NULL THEN 0 ELSE count(*) END AS BIGINT) AS n_lines,
 CAST(count(lost.line) AS BIGINT) AS n_dropped,
 CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(p.raw, chr(10) ORDER BY p.pos) FILTER (WHERE lost.line IS NULL), '') END AS text
FROM parsed p JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN lost ON lost.doc_id = p.doc_id AND lost.line = p.line GROUP BY p.doc_id
"""
