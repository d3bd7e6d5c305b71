"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text holds all its substrings. A text is parsed into the longest
phrases that occur there; the language that needs the fewest phrases a character wins. Many blocks of text walk through
an automaton in step, as one numpy lookup a character.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import slices

# The labelled sample: pieces of this many characters, and characters in all, dealt evenly to the languages.
PIECE, SAMPLE = 800, 240_000
# Alphabets of up to this many symbols have dense transitions, larger ones hashed; both tell all letters apart.
DENSE = 64
# Symbols after which a long text is cut; each block is parsed on its own.
BLOCK = 512
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
OTHER, SPACE = 0, 1
_letter = np.frombuffer(bytes(chr(c).isalpha() for c in range(0xD800)), bool)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def labelled_sample(docs: DataFrame) -> dict[str, list[str]]:
    """Pieces of text for each language, from documents outside the held-out fold; at most SAMPLE characters in all.

    Documents are drawn by the hash of their id; the piece starts at a place that the hash gives.
    """
    use = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    draw = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    use = use.withColumn("draw", draw).withColumn("start", F.pmod("draw", F.greatest(F.lit(1), F.char_length("text") - PIECE)))
    use = use.select("lang", "draw", F.expr(f"substring(text, cast(start as int) + 1, {PIECE})").alias("piece"))
    # Only the first rows of a language leave each task.
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "piece"))
    rows = use.withColumn("first", first).filter(F.col("first") <= SAMPLE // PIECE).collect()
    found: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r["first"])):
        found.setdefault(row.lang, []).append(row.piece)
    most = max(1, SAMPLE // PIECE // max(1, len(found)))
    return {lang: pieces[:most] for lang, pieces in found.items()}


def transitions(codes: np.ndarray) -> list[dict[int, int]]:
    """Symbol -> next state for each state of the suffix automaton of `codes`; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def automaton(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions (states x symbols, 0 for none; state 0 is the start) of the suffix automaton of `codes`."""
    step = transitions(codes)
    table = np.zeros((len(step), symbols), np.int32)
    for state, steps in enumerate(step):
        for c, to in steps.items():
            table[state, c] = to
    return table


class Dense:
    """Transitions of an automaton as one table."""

    def __init__(self, codes: np.ndarray, symbols: int):
        table = automaton(codes, symbols)
        self.flat, self.root, self.symbols = table.ravel(), table[0], symbols

    def after(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.flat[state * np.int64(self.symbols) + c]


class Hashed:
    """The same with memory for the transitions there are only: open addressing by state and symbol."""

    def __init__(self, codes: np.ndarray, symbols: int):
        step = transitions(codes)
        sizes = [len(s) for s in step]
        keys = np.repeat(np.arange(len(step), dtype=np.int64) * symbols, sizes) + np.array([c for s in step for c in s], np.int64)
        ends = np.array([to for s in step for to in s.values()], np.int32)
        self.symbols, self.bits = symbols, max(4, (4 * len(keys)).bit_length())
        self.keys, self.ends = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        place, left = self.place(keys), np.arange(len(keys))
        while len(left):
            # Of all that want a free place the last gets it; the others go on to the next one.
            free = left[self.keys[place[left]] < 0]
            self.keys[place[free]] = keys[free]
            left = left[self.keys[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
        self.ends[place] = ends
        self.root = np.zeros(symbols, np.int32)
        self.root[list(step[0])] = list(step[0].values())

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def after(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        keys = state * np.int64(self.symbols) + c
        place = self.place(keys)
        have = self.keys[place]
        out = np.where(have == keys, self.ends[place], 0)
        left = np.flatnonzero((have != keys) & (have >= 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            have = self.keys[place[left]]
            hit = have == keys[left]
            out[left[hit]] = self.ends[place[left[hit]]]
            left = left[~hit & (have >= 0)]
        return out


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, sample: dict[str, list[str]]):
        self.languages = sorted(sample)
        clean = {lang: ["".join(ch if ch.isalpha() else " " for ch in p.lower()) for p in pieces] for lang, pieces in sample.items()}
        counts = Counter(ch for pieces in clean.values() for p in pieces for ch in p if ch != " ")
        # Every letter of the sample has a code; only letters that it lacks match nothing.
        letters = [ch for ch, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.code = np.full(0x110000, OTHER, np.int32)
        self.code[:0xD800][~_letter] = SPACE
        for k, ch in enumerate(letters):
            self.code[ord(ch)] = k + 2
        self.symbols = len(letters) + 3
        self.automata, weights = [], []
        for lang in self.languages:
            # Pieces are kept apart by a symbol that no text has.
            codes = [np.append(self.codes(p)[0], self.symbols - 1) for p in clean[lang]]
            codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            # Longest matches in a sample of m symbols grow as log m, so phrases are counted in units of 1 / log m.
            weights.append(np.log(2 + len(codes)))
            self.automata.append((Dense if self.symbols <= DENSE else Hashed)(codes, self.symbols))

        self.weights = np.array(weights)

    def codes(self, *texts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, with runs of non-letters as one space; the texts' bounds; whether each has a letter."""
        points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
        points = np.concatenate(points) if points else np.zeros(0, np.uint32)
        codes = self.code[points]
        high = np.flatnonzero(points >= 0xD800)
        if len(high):
            kinds, where = np.unique(points[high], return_inverse=True)
            real = np.array([chr(c).isalpha() for c in kinds.tolist()])
            codes[high[~real[where]]] = SPACE
        letters = np.concatenate([[0], np.cumsum(codes != SPACE)])[bounds]
        stay = codes != SPACE
        stay[1:] |= codes[:-1] != SPACE
        # A text does not begin with a space, whatever text comes before it.
        heads = bounds[:-1][np.diff(bounds) > 0]
        stay[heads] = codes[heads] != SPACE
        return codes[stay].astype(np.int64), np.concatenate([[0], np.cumsum(stay)])[bounds], np.diff(letters) > 0

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (texts x languages), symbols and whether there is a letter, for each text."""
        codes, bounds, letter = self.codes(*texts)
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(texts)), blocks)
        starts = bounds[:-1][doc] + BLOCK * (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        lengths = np.minimum(BLOCK, bounds[1:][doc] - starts)
        order = np.argsort(-lengths, kind="stable")
        doc, starts, lengths = doc[order], starts[order], lengths[order]
        going = np.searchsorted(-lengths, -np.arange(1, BLOCK + 1), "right")
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for k, held in enumerate(self.automata):
            root = held.root
            state, count = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
            for t in range(int(lengths[0]) if len(lengths) else 0):
                n = going[t]
                c = codes[starts[:n] + t]
                now = state[:n]
                after = held.after(now, c)
                over = after == 0
                count[:n] += over | (now == 0)
                state[:n] = np.where(over, root[c], after)
            out[:, k] = np.bincount(doc, count, len(texts))
        return out, sizes, letter


_models: dict[int, Model] = {}


def model_of(sample: dict[str, list[str]]) -> Model:
    """The model of a sample, built once in a Python worker."""
    key = hash(tuple((lang, tuple(pieces)) for lang, pieces in sorted(sample.items())))
    if key not in _models:
        _models.clear()
        _models[key] = Model(sample)
    return _models[key]


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Learns from text and lang of documents outside the held-out fold; a text's own lang, source and id are no input of
    its prediction. The language that needs the fewest phrases wins, each counted by the logarithm of the language's
    sample, so that uneven samples compete alike. Score is the runner-up's share of these counts of the best two languages, 1 if there is one language.
    A text that is null or without a letter, or any text if nothing could be learned, is `und` with score 0. A null
    doc_id is not held out, and not learned from. Ties go to the first language by name. Repeated rows and other
    columns do no harm; an empty table gives no rows. Only the sample reaches the driver.
    """
    sample = labelled_sample(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(sample)
        for part in slices(batches, "text"):
            counts, sizes, letter = model.phrases([t or "" for t in part.column("text").to_pylist()])
            pred, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            if model.languages:
                needed = counts * model.weights
                best = needed.argmin(1)
                low = needed[np.arange(len(best)), best]
                rest = needed.copy()
                rest[np.arange(len(best)), best] = np.inf
                second = rest.min(1)
                score = np.where(letter, second / np.maximum(low + second, 1), 0.0) if len(model.languages) > 1 else letter * 1.0
                pred = [model.languages[b] if has else UNKNOWN for b, has in zip(best.tolist(), letter.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
