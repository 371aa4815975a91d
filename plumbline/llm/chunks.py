"""Chunk-wise encoding shared by the tokenizer operators.

A text is cut where ASCII white space makes a boundary of pre-tokens certain, each distinct chunk is
encoded once by the tokenizers library and kept in a bounded cache, and a document's ids are gathered
from it; they are those of the whole text. Memory is bounded by BLOCK_CHARS of text, CACHE_CHARS of chunks, and the ids of one document.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BLOCK_CHARS = 1 << 20
CACHE_CHARS = 4 << 20
WS = r" \t\n\r\f\v"
#: Words without the white space around them, for tokenizers that drop it.
WORDS = re.compile(rf"[^{WS}]+")
#: Letters and digits in every version of Unicode that stay such in lower case.
ALNUM = re.compile("[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
MARKS = ".,;:!?"
# How tokenizer files write the forms whose chunks are known.
WORD_FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
BYTE_FORM = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
#: What Arrow takes for ASCII white space, and tokenizers don't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space beyond ASCII, or nearly: runs that mix it with the above are not cut.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  　﻿]")
_CUT = re.compile(rf"[^{WS}] (?=[^{WS}])")


def lowered(text: str) -> str:
    """The text in lower case, where a tokenizer that normalises to NFC and lower case can't tell the difference; else the text."""
    if text.isascii():
        return text if "<|" in text else text.lower()
    if "<|" in text or "\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
        return text
    low = text.lower()
    return low if unicodedata.is_normalized("NFC", low) else text


def slices(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before a lone space between two words."""
    at = 0
    while len(text) - at > 2 * size and (m := _CUT.search(text, at + size)):
        yield text[at : m.end() - 1]
        at = m.end() - 1
    yield text[at:]


class Ragged:
    """Growing flat array of runs, addressed by run number."""

    def __init__(self) -> None:
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.len = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.n = 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(lengths) > len(self.start):
            self.start, self.len = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.len))
        self.start[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.len[self.n : self.n + len(lengths)] = lengths
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += len(lengths)

    def gather(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs one after another, and the length of each."""
        n = self.len[runs]
        end = np.cumsum(n)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[runs] - (end - n), n)
        return self.flat[at], n


def has_form(path: str, form: dict) -> bool:
    """Whether a tokenizer file normalises and parts texts in the given form."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    return all(known.get(k) == v for k, v in form.items())


Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


def encode_chunks(tok, chunks: list[str], offsets: bool) -> Encoded:
    """All chunks in one call: ids, number of ids by chunk, first character of each id within its chunk."""
    e = tok.encode(chunks, is_pretokenized=True, add_special_tokens=False)
    n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(chunks))
    starts = np.array([a for a, _ in e.offsets] if offsets else [], np.uint32)
    return np.array(e.ids, np.uint32), n, starts


class Cache:
    """The ids of chunks, and the first character of each id, as ``encode`` gives them (in the manner of ``encode_chunks``)."""

    def __init__(self, encode) -> None:
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.chars = Ragged(), Ragged(), 0
        self.uses = np.zeros(1 << 14, np.int32)

    def _learn(self, new: list[str]) -> None:
        ids, n, starts = self.encode(new)
        self.ids.add(ids, n)
        self.starts.add(starts, n if len(starts) else n[:0])
        self._name(new)

    def _name(self, new: list[str]) -> None:
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.chars += sum(map(len, new))

    def _shrink(self) -> None:
        """Keep only chunks that came up in several blocks."""
        words = [*self.number]
        again = np.flatnonzero(self.uses[: len(words)] > 1)
        ids, starts = self.ids, self.starts
        self._clear()
        if len(again) < len(words) // 2:
            flat, n = ids.gather(again)
            self.ids.add(flat, n)
            if starts.n:
                self.starts.add(*starts.gather(again))
            self._name([words[i] for i in again])

    def _joint(self, new: list[str]) -> list[tuple[str, str]]:
        """New chunks that are encoded in two parts, and the first of these."""
        return []

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        if self.chars > CACHE_CHARS:
            self._shrink()
        known = self.number
        out = np.fromiter(map(known.get, chunks, itertools.repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [*dict.fromkeys(chunks[i] for i in missing)]
            joint = self._joint(new)
            pairs = [x for w, h in joint for x in (h, w[len(h) :])]
            single = {*new}.difference(w for w, _ in joint).union(pairs) if joint else new
            if fresh := [w for w in single if w not in known]:
                self._learn(fresh)
            if joint:
                ids, n = self.ids.gather(np.fromiter(map(known.__getitem__, pairs), np.int64, len(pairs)))
                self.ids.add(ids, n.reshape(-1, 2).sum(1))
                self._name([w for w, _ in joint])
            out[missing] = [known[chunks[i]] for i in missing]
        while len(known) > len(self.uses):
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.uses[out] += 1
        return out


class WordEncoder(Cache):
    """Chunks are what ASCII white space parts; it is dropped, and closing marks after a letter or digit are encoded apart from their word.

    For tokenizers that normalise to NFC and lower case, part words at white space and marks, and have the marks as pre-tokens of their own.
    """

    def _joint(self, new: list[str]) -> list[tuple[str, str]]:
        return [(w, h) for w in new if w[-1:] in MARKS and (h := w.rstrip(MARKS)) and ALNUM.match(h[-1])]

    def _alone(self, text: str) -> np.ndarray:
        out = []
        for part in slices(text):
            runs = self._numbers(WORDS.findall(part))  # may rebuild the cache, so it comes first
            out.append(self.ids.gather(runs)[0])
        return np.concatenate(out)

    def documents(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; a null one has none."""
        held: list[str] = []
        chars = 0
        for t in texts:
            t = lowered(t or "")
            alone = len(t) > BLOCK_CHARS or SEPARATORS.search(t) is not None
            if alone or chars > 4 * BLOCK_CHARS:
                yield from self._together(held)
                held, chars = [], 0
            if alone:
                yield self._alone(t)
            else:
                held.append(t)
                chars += len(t)
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = split.values.dictionary_encode()
        runs = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids, n = self.ids.gather(runs)
        yield from np.split(ids, np.append(0, np.cumsum(n))[split.offsets.to_numpy()[1:-1]])


class WholeEncoder:
    """Whole texts, one by one: for tokenizers of any form."""

    def __init__(self, tok) -> None:
        self.tok = tok

    def documents(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        for t in texts:
            yield np.array(self.tok.encode(t or "", add_special_tokens=False).ids, np.uint32)


_IS_SPACE = np.isin(np.arange(256), [*b" \t\n\r\f\v"])


def spaced(texts: pa.Array, uncut: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of texts without nulls, from their bytes: (chunks, number of chunks by text, characters by chunk).

    A chunk is a word with the one space before it; a run of white space short of its last character before a word; that character, if it
    is no space; or a run at the end. Texts marked ``uncut`` are one chunk each.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.empty(0, np.uint8)
    edge = edge - edge[0]
    first, last = edge[:-1][np.diff(edge) > 0], edge[1:][np.diff(edge) > 0] - 1
    blank = _IS_SPACE[data]
    after_blank, before_word = np.zeros(len(data), bool), np.zeros(len(data), bool)
    after_blank[1:] = blank[:-1]
    after_blank[first] = False
    before_word[:-1] = ~blank[1:]
    before_word[last] = False
    begins = blank & (~after_blank | before_word)
    begins[1:] |= ~blank[1:] & after_blank[1:] & (data[:-1] != 32)
    begins[np.repeat(uncut, np.diff(edge))] = False
    begins[first] = True
    at = np.flatnonzero(begins)
    made = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
    chars = np.add.reduceat((data & 0xC0) != 0x80, at, dtype=np.int64) if len(at) else at
    return made, np.diff(np.searchsorted(at, edge)), chars


class SpacedEncoder(Cache):
    """Chunks as ``spaced`` gives them, for tokenizers of the byte-level scheme; texts with white space beyond ASCII are one chunk each.

    Without ``cut``, all texts are.
    """

    def __init__(self, encode, cut: bool = True) -> None:
        super().__init__(encode)
        self.cut = cut

    def _whole(self, texts: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(texts, ODD_SPACE.pattern).to_numpy(zero_copy_only=False) if self.cut else np.ones(len(texts), bool)

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        made, n, chars = spaced(texts, self._whole(texts))
        coded = made.dictionary_encode()
        return self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()], n, chars

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        """(first row, texts) of blocks of about BLOCK_CHARS bytes; nulls become empty."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(texts):
            return
        block = np.cumsum(size) // (2 * BLOCK_CHARS)
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(texts)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield a, texts.slice(a, b - a)

    def encoded(self, texts: pa.Array, starts: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Block by block: the ids of all texts, the number of ids by text, and with ``starts`` the character of its text that each id begins in."""
        for _, own in self.batches(texts):
            parts, text_of = own, np.arange(len(own))
            if pc.max(pc.binary_length(own)).as_py() > 8 * BLOCK_CHARS:  # very long texts in parts, so that masks of them stay small
                cut = [[t] if odd else [*slices(t)] for t, odd in zip(own.to_pylist(), self._whole(own), strict=True)]
                parts, text_of = pa.array([x for c in cut for x in c], pa.large_string()), np.repeat(text_of, [*map(len, cut)])
            ids, n, first = [], np.zeros(len(own), np.int64), []
            base, now = 0, -1
            for k in range(0, len(parts), 1 if parts is not own else max(1, len(parts))):
                piece = parts.slice(k, 1) if parts is not own else parts
                runs, chunks, chars = self._chunks(piece)
                x, size = self.ids.gather(runs)
                ends = np.append(0, np.cumsum(size))[np.cumsum(chunks)]
                n += np.bincount(text_of[k : k + len(piece)], np.diff(ends, prepend=0), len(own)).astype(np.int64)
                ids.append(x)
                if starts:
                    edge = np.append(0, np.cumsum(chars))
                    begin = edge[:-1] - np.repeat(edge[np.cumsum(chunks) - chunks], chunks)
                    base = base if text_of[k] == now else 0
                    first.append(self.starts.gather(runs)[0].astype(np.int64) + np.repeat(begin, size) + base)
                    now, base = text_of[k], base + int(edge[-1])
            yield np.concatenate(ids), n, np.concatenate(first) if starts else np.empty(0, np.int64)
