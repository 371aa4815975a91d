"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file's byte strings become strings of the 256 printable stand-in characters of the byte-level
scheme (byte-to-character mapping), a tokenizers BPE model is made from them, and documents are
encoded chunk by chunk, with the character each id begins in as its offset. Decoding looks ids up in the reversed byte table; a
character that is split over ids is whole again in the joined bytes, and each of its ids has that character's offset. That the
model gives the ids of the rank file's own library is held by the tests, not checked as it runs.

Defined cases: a null text is empty and has no ids; an empty table gives an empty result; repeated rows each get a row; a very long
text is encoded whole, in parts that are cut where no token can cross; other columns pass through ``encode_column``, where those
named like its results are replaced, and are dropped by ``round_trip``; bytes that are no UTF-8 (ids cut within a
character) decode to U+FFFD in ``decode_text``, and exactly in ``decode_bytes``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from plumbline.llm.batches import sliced
from plumbline.llm.chunks import SpacedEncoder, encode_chunks

#: Fixed value: what the byte-level scheme of the tokenizers library cuts by.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _model(path: str, pattern: str = BYTE_LEVEL):
    """(tokenizers' tokenizer that cuts by ``pattern``, bytes of all ids one after another, place of each id's first byte and of the end) of a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    chars = byte_characters()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [
        (shown[t[:k]], shown[t[k:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        for k in range(1, len(t))
        if ranks.get(t[:k], 1 << 31) < ranks[t] and ranks.get(t[k:], 1 << 31) < ranks[t]
    ]
    tok = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges))
    tok.encode_special_tokens = True
    mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=pattern == BYTE_LEVEL)
    tok.pre_tokenizer = mapped if pattern == BYTE_LEVEL else pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), mapped])
    back = {c: b for b, c in enumerate(chars)}
    table = [b""] * (max(ranks.values()) + 1)
    for s, i in tok.get_vocab().items():
        table[i] = bytes(back[c] for c in s)
    return tok, np.frombuffer(b"".join(table), np.uint8), np.append(0, np.cumsum([*map(len, table)]))


@functools.cache
def encoder(path: str, pattern: str, offsets: bool = False) -> SpacedEncoder:
    tok = _model(path, pattern)[0]
    # By another pattern, white space may not part pre-tokens: each text is one chunk.
    return SpacedEncoder(lambda chunks: encode_chunks(tok, chunks, offsets), cut=pattern == BYTE_LEVEL)


def encode_column(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", offsets: str | None = None) -> DataFrame:
    """``df`` with its text's ids as ``array<int>`` and, under the name ``offsets``, the character that each begins in."""
    added = [out, offsets] if offsets else [out]
    own = df.drop(*added)
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern, bool(offsets))
        for b in sliced(batches):
            at = 0
            for ids, n, first in enc.encoded(b.column(b.schema.get_field_index(text_col)), bool(offsets)):
                edges = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                made = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in ((ids, first) if offsets else (ids,))]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).slice(at, len(n)) for c in names), *made], [*names, *added])
                at += len(n)

    return own.mapInArrow(run, StructType([*own.schema.fields, *(StructField(c, ArrayType(IntegerType())) for c in added)]))


def decode_bytes(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes (uint8) that ids stand for."""
    _, flat, edge = _model(path)
    n = edge[ids + 1] - edge[ids]
    end = np.cumsum(n)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(edge[ids] - (end - n), n)]


def decode_text(ids: list[int], path: str) -> str:
    return decode_bytes(np.array(ids, np.int64), path).tobytes().decode("utf-8", "replace")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        edge = _model(path)[2]
        digests = lambda data, ends: [hashlib.sha256(data[a:b]).hexdigest() for a, b in itertools.pairwise([0, *ends.tolist()])]
        for b in sliced(batches):
            at = 0
            for ids, n, _ in enc.encoded(b.column(1)):
                ends = np.cumsum(n)
                size = np.append(0, np.cumsum(edge[ids.astype(np.int64) + 1] - edge[ids]))
                coded = digests(ids.astype("<u4").data.cast("B"), 4 * ends)
                decoded = digests(decode_bytes(ids.astype(np.int64), path).data, size[ends])
                cols = [b.column(0).slice(at, len(n)), pa.array(n), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(n)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
