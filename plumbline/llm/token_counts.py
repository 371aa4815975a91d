"""Token counts of fields and sections from one encoding of the whole document.

A document is encoded once, as a whole: its ids and their character offsets are those of the tokenizer over the whole text. They are
gathered from cached encodings of its chunks, which are cut only where no token can cross (``chunks``). Each token's first character is
looked up among the sections' character intervals (a sorted interval join, for all documents of a batch at once). Rule for
tokens that cross a boundary: a token counts for the section that holds its first character. A section's separator
belongs to the section that it ends.

Defined cases: a null or empty text has one empty section (number 0) with no tokens; repeated rows, and null ids, each give their
sections; an empty table gives an empty result; a very long text is encoded whole, in parts that are cut where no token can
cross; a section within a multi-byte character's tokens can't arise, as boundaries lie between characters; other columns, those named
like the results included, are dropped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.batches import sliced
from plumbline.llm.chunks import BYTE_FORM, SpacedEncoder, encode_chunks, has_form


@functools.cache
def encoder(path: str) -> SpacedEncoder:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True

    return SpacedEncoder(lambda chunks: encode_chunks(tok, chunks, offsets=True), cut=has_form(path, BYTE_FORM))


COLUMNS = ("section", "start", "end", "n_tokens")


def _attribute(df: DataFrame, path: str, id_col: str, ends_of) -> DataFrame:
    """df has (id, text[, more]); ``ends_of(texts, more)`` gives each text's length, and the ends of its sections as (text number, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in sliced(batches):
            at = 0
            for _, n, first in enc.encoded(b.column(1), starts=True):
                rows = b.slice(at, len(n))
                at += len(n)
                length, who, end = ends_of(pc.fill_null(rows.column(1), ""), rows.column(2) if rows.num_columns > 2 else None)
                # Texts lie one after another on one line, each a place longer than it is, so that one search serves all.
                place = np.cumsum(length + 1) - length - 1
                new = np.append(True, who[1:] != who[:-1])[: len(who)]
                start = np.where(new, 0, np.append(0, end[:-1])[: len(end)])
                token = np.repeat(place, n) + first
                found = np.searchsorted(token, place[who] + start, "left")
                till = np.append(found[1:], len(token))[: len(found)]
                section = np.arange(len(who)) - np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))
                out = [pa.array(x, pa.int64()) for x in (section, start, end, till - found)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(who)), *out], [id_col, *COLUMNS])

    kind = df.schema[id_col].dataType.simpleString()
    return df.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in COLUMNS))


def section_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """Per document and section (the text between separators, in order): section, start, end, n_tokens."""

    def ends_of(texts: pa.Array, _) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = pc.split_pattern(texts, separator)
        n = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        who = np.repeat(np.arange(len(n)), n)
        size = pc.utf8_length(parts.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.cumsum(n) - 1
        step = size + len(separator)
        step[last] -= len(separator)
        total = np.append(0, np.cumsum(step))
        end = total[1:] - np.repeat(total[last + 1 - n], n)
        keep = np.ones(len(who), bool)
        keep[last[(n > 1) & (size[last] == 0)]] = False  # nothing follows the last separator
        return end[last], who[keep], end[keep]

    return _attribute(df.select(id_col, text_col), path, id_col, ends_of)


def field_counts(df: DataFrame, path: str, fields: list[str], id_col: str = "doc_id") -> DataFrame:
    """Per row and named field, the fields being joined to one document by line ends; each line end belongs to the field before it."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    joined = df.select(id_col, F.concat_ws("\n", *texts).alias("_joined"), F.array(*map(F.length, texts)).alias("_lengths"))

    def ends_of(_, lengths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum(lengths.flatten().to_numpy().reshape(-1, len(fields)).astype(np.int64) + 1, 1)
        ends[:, -1] -= 1
        return ends[:, -1], np.repeat(np.arange(len(ends)), len(fields)), ends.ravel()

    counts = _attribute(joined, path, id_col, ends_of)
    return counts.withColumn("field", F.get(F.array(*map(F.lit, fields)), F.col("section").cast("int")))
