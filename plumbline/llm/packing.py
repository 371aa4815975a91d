"""Cost-balanced packing of documents into sequences.

A document's ids are cut into whole sequences of ``capacity`` and a rest. Rests go, in descending
length, to the sequence of lowest estimated cost (``linear * n + quadratic * n ** 2`` summed over its pieces,
as attention stays within a piece) that has room; a rest that fits nowhere whole is cut at the sequence of lowest
cost that has any room. Packing runs in groups of about ``group_tokens`` ids, where the number of sequences is exact:
as many full ones as the group's ids allow, and what remains in sequences of powers of two, which need no padding.
Groups follow the rows of a task, so nothing is shuffled, and a repeated task makes the same pieces; which documents share a
sequence, and sequence ids, depend on how the input is partitioned.

Defined cases: a null text is empty (its document is the end id alone); a null id's document is packed like any other; repeated rows are
packed as documents of their own; a very long text fills whole sequences by itself, and its rest is packed; columns that clash with
the results, and all others, are dropped; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.llm.batches import sliced
from plumbline.llm.chunks import WORD_FORM, WholeEncoder, WordEncoder, encode_chunks, has_form

#: (document, start in it, length, sequence, offset there)
Piece = tuple[int, int, int, int, int]


@functools.cache
def encoder(path: str) -> WordEncoder | WholeEncoder:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    if not has_form(path, WORD_FORM):
        return WholeEncoder(tok)
    return WordEncoder(lambda chunks: encode_chunks(tok, chunks, offsets=False))


def pack(lengths: list[int], capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096) -> list[Piece]:
    """Pieces of one group; sequences are numbered from 0."""
    out: list[Piece] = []
    n, total = 0, sum(lengths)
    rests: list[tuple[int, int, int]] = []
    for d, m in enumerate(lengths):
        for k in range(m // capacity):
            out.append((d, k * capacity, capacity, n, 0))
            n += 1
        if r := m % capacity:
            rests.append((r, d, m - r))
    left = total - n * capacity
    sizes = [capacity] * (left // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if left % capacity >> b & 1]
    free, used = np.array(sizes, np.int64), np.zeros(len(sizes), np.int64)
    cost = np.zeros(len(sizes))
    rests.sort(key=lambda x: (-x[0], x[1]))
    for r, d, at in rests:
        while r:
            room = np.flatnonzero(free >= r)
            if not len(room):
                room = np.flatnonzero(free)
            s = int(room[np.argmin(cost[room])])
            m = min(r, int(free[s]))
            out.append((d, at, m, n + s, int(used[s])))
            free[s] -= m
            used[s] += m
            cost[s] += linear * m + quadratic * m * m
            at, r = at + m, r - m
    return out


def pack_documents(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    capacity: int = 4096,
    group_tokens: int = 1 << 21,
    assign: Callable[..., list[Piece]] = pack,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        ids: list[np.ndarray] = []
        keys: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, ids, keys, held
            pieces = assign([len(x) for x in ids], capacity)
            crc = [zlib.crc32(ids[d][a : a + m].tobytes()) for d, a, m, _, _ in pieces]
            d, start, length, seq, offset = np.array(pieces, np.int64).reshape(-1, 5).T
            cols = [start, length, crc, [len(ids[k]) for k in d], seq + sequence, offset]
            doc = pa.array(keys, id_type).take(pa.array(d))
            sequence += int(seq.max()) + 1
            ids, keys, held = [], [], 0
            return pa.RecordBatch.from_arrays([doc, *(pa.array(c, pa.int64()) for c in cols)], names)

        id_type = None
        waiting: deque = deque()

        def texts() -> Iterator[str | None]:
            nonlocal id_type
            for b in sliced(batches):
                id_type = b.schema.field(0).type
                waiting.extend(b.column(0).to_pylist())
                yield from b.column(1).to_pylist()

        for x in enc.documents(texts()):
            ids.append(np.append(x, np.uint32(end_id)).astype("<u4"))
            keys.append(waiting.popleft())
            held += len(x) + 1
            if held >= group_tokens:
                yield flush()
        if ids:
            yield flush()

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))
