"""Token ids of whole texts with public tokenizers, through a bounded cache of chunk encodings.

Both tokenizers split text at white space before anything else, so the ids of a text are those of its white-space
chunks in a row. Each different chunk is encoded by the library once and then looked up; texts with white space that
a cut could treat differently are cut by the tokenizer's own rule, or encoded as a whole. Arrow cuts the texts of a slice
and finds its different chunks, so only these are looked up in Python.
"""

from __future__ import annotations

import re
from struct import Struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import text_bytes

BYTES = "byte_bpe_50k.json"
WORDS = "word_bpe_49k.json"
# Chunks of one generation, looked at before each slice; a Python worker keeps this one and the one before.
CACHE = 150_000
# Bytes of text whose chunks are looked up together.
TOKEN_SLICE = 4 << 20

_white = r"\t-\r \x85\xa0  -     　"
# Runs of white space that more than one rule of the byte tokenizer touches.
# It begins with a space of its own, so that the search goes from space to space.
_runs = re.compile(r" (?: |(?<=\s )\s)")
_spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# What `_runs` finds, for Arrow, whose \s is another and which cannot look behind.
_arrow_runs = f"  |[{_spaces}] [{_spaces}]"
_byte_chunks = re.compile(rf" ?[^{_white}]+|[{_white}]+(?![^{_white}])|[{_white}]+")
# Characters on which definitions of white space differ, or that change at composition across a cut.
_odd = re.compile("[\x1c-\x1f\x85᠎​﻿]")


# Punctuation that never joins the letters before it, in either tokenizer.
_tail = ".,;:!?*#$%&|)"
# Bytes as the characters that stand for them in byte-level vocabularies: printable ones as they are, others from 256 on.
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
_rest = [b for b in range(256) if b not in set(_plain)]
BYTE_CHARS = {b: chr(b) for b in _plain} | {b: chr(256 + k) for k, b in enumerate(_rest)}


_packers = [Struct(f"<{n}H").pack for n in range(32)]


def packed(ids: list[int]) -> bytes:
    n = len(ids)
    return _packers[n](*ids) if n < len(_packers) else Struct(f"<{n}H").pack(*ids)


class Chunks(dict):
    """chunk -> its ids as little-endian 16-bit numbers; `lead` is put before a chunk to encode it.

    `tails` holds the encodings of punctuation that ends a word. Chunks of the generation before, in `old`, are
    taken over when they are met again.
    """

    def __init__(self, tokenizer: Tokenizer, lower: bool, lead: str = "", tails: Chunks | None = None):
        super().__init__()
        self.tokenize, self.lower, self.lead = tokenizer.model.tokenize, lower, lead
        self.space = BYTE_CHARS[32] if lead else ""
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.tails = self if tails is None else tails
        self.lines = not lower
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        """Begin a new generation."""
        self.old = dict(self)
        self.clear()

    def ids(self, chunk: str) -> bytes:
        """Ids by the library's own steps: normalise, cut, and look each part up in the model."""
        if chunk.isascii() and chunk.isalpha():
            return packed([t.id for t in self.tokenize(self.space + (chunk.lower() if self.lower else chunk))])
        if chunk.isalpha() and (not self.lower or max(chunk) < "\u0250" and "\u0130" not in chunk):
            word = (chunk.lower() if self.lower else chunk).encode().decode("latin-1").translate(BYTE_CHARS)
            return packed([t.id for t in self.tokenize(self.space + word)])
        text = self.lead + chunk
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return packed([t.id for part, _ in self.pre_tokenizer.pre_tokenize_str(text) for t in self.tokenize(part)])

    def __missing__(self, chunk: str) -> bytes:
        out = self.old.get(chunk)
        if out is None and chunk.isalpha():
            out = self.ids(chunk)
        elif out is None:
            end = len(chunk.rstrip(_tail))
            line = chunk.find("\n")
            if line > 0 and self.tails.lines:
                # What stands on either side of a line feed is met again more often than the whole.
                out = self[chunk[:line]] + b"".join(map(self.tails.__getitem__, _byte_chunks.findall(chunk, line)))
            elif 0 < end < len(chunk) and chunk[end - 1].isalpha() and chunk[end - 1].lower().isalpha():
                out = self[chunk[:end]] + self.tails[chunk[end:]]
            else:
                out = self.ids(chunk)
        self[chunk] = out
        return out


class Encoder:
    def __init__(self, name: str):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{name}: ids do not fit in 16 bits")
        self.tokenizer = tokenizer
        # Strings that stand for a token of their own wherever they are; texts with one are encoded as a whole.
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.by_bytes = name == BYTES
        # What a text has that is not cut at white space alone.
        self.apart = "|".join([_arrow_runs if self.by_bytes else _odd.pattern, *map(re.escape, self.special)])
        self.exact = Chunks(tokenizer, not self.by_bytes)
        self.spaced = Chunks(tokenizer, not self.by_bytes, " ", self.exact)

    def turn(self) -> None:
        if len(self.exact) + len(self.spaced) > CACHE:
            self.exact.turn()
            self.spaced.turn()

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each of `texts`, null as empty: what a call gives, with each different chunk looked up once."""
        texts = texts.fill_null("")
        apart = pc.match_substring_regex(texts, self.apart)
        whole = iter([self(t) for t in texts.filter(apart).to_pylist()])
        self.turn()
        cut = texts.filter(pc.invert(apart))
        cut = pc.split_pattern(cut, " ") if self.by_bytes else pc.utf8_split_whitespace(cut)
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at, bounds = coded.indices.to_numpy(), cut.offsets.to_numpy()
        if self.by_bytes:
            # A text's first chunk has no space before it: chunks that are first get a second number.
            rest = np.ones(len(at), bool)
            rest[bounds[:-1]] = False
            used = np.zeros(len(chunks), bool)
            used[at[rest]] = True
            first, number = np.unique(at[~rest], return_inverse=True)
            later = np.flatnonzero(used)
            place = np.cumsum(used) - 1
            at = place[at]
            at[~rest] = len(later) + number
            ids = list(map(self.spaced.__getitem__, chunks if used.all() else [chunks[k] for k in later.tolist()]))
            ids += [self.exact[chunks[k]] if chunks[k] else b"" for k in first.tolist()]
        else:
            ids = list(map(self.exact.__getitem__, chunks))
        data, offsets = text_bytes(pa.array(ids, pa.large_binary()).take(pa.array(at)))
        ends = offsets[bounds].tolist() if len(at) else [0] * len(bounds)
        plain = iter([data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)])
        return [next(whole if a else plain) for a in apart.to_pylist()]

    def __call__(self, text: str) -> bytes:
        """Ids of `text` as little-endian 16-bit numbers."""
        self.turn()
        if not text:
            return b""
        if any(s in text for s in self.special):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not self.by_bytes:
            if _odd.search(text):
                return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            return b"".join(map(self.exact.__getitem__, text.split()))
        if _runs.search(text):
            return b"".join(map(self.exact.__getitem__, _byte_chunks.findall(text)))
        chunks = text.split(" ")
        return (self.exact[chunks[0]] if chunks[0] else b"") + b"".join(map(self.spaced.__getitem__, chunks[1:]))


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder for each tokenizer in a Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
