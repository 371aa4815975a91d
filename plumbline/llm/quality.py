"""Quality rules by line sequence labelling.

Each line with a word is described by a few measures (share of symbols, capitals and digits, words that repeat,
closing punctuation, length, whether it repeats an earlier line). A linear-chain conditional random field with
the states content and boilerplate labels the lines: Viterbi decoding marks each, and the share of word
characters in content lines decides retention.

Labels tell of documents, not of lines, so line labels are found first (``line_labels``): a line model is fitted to its document's
label and fitted again to its own posteriors, with the document's label as a constraint on the share, as at least half of a
good document's word characters stay content and half of a bad one's boilerplate. The field is then trained on
the documents' label sequences and on splices of runs from several of them, so that it has seen labels change within a text.

Base rules stand before it: fewer than ``min_words`` words, or more than 30 % of words in 8-word windows
that occur twice or more in the text, and the document is dropped.

Texts are measured in numpy over the code points of blocks of about ``BLOCK`` characters; a longer text is a block of its own, so that
memory grows with the longest text, at some 50 bytes a character.

Defined cases: a null or empty text, or one without words, has no lines and is dropped by the base rules; an empty table gives an empty
result; where no labelled rows of both kinds exist, the verdict is the base rules' alone; repeated rows each get a row; ties between
states go to content, and a content share equal to the least one is kept; columns that clash with the added ones are replaced by
those; other extra columns are dropped by ``judge`` and ``line_states`` and kept by ``judge_column``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from plumbline.llm.batches import sliced
from plumbline.llm.chunks import SEPARATORS
from plumbline.session import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
N_FEATURES = 10
BLOCK = 1 << 20
CONTENT, BOILERPLATE = 0, 1
_SPACE, _SYMBOL, _UPPER, _ALPHA, _DIGIT, _CRY, _CLOSE = (1 << b for b in range(7))


@dataclass(frozen=True)
class Crf:
    #: [features, 2] emissions, [2, 2] transitions, [2] first state.
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Lines:
    """The lines with a word of several texts, in order: text number, line number in it, character span there, word characters, features."""

    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    chars: np.ndarray
    x: np.ndarray


def _kind(c: str) -> int:
    marks = (c in " \t\n\x0b\x0c\r", c in SYMBOLS, c.isupper(), c.isalpha(), c.isdigit(), c in "!?", c in '.!?"»”')
    return sum(1 << b for b, m in enumerate(marks) if m)


@functools.cache
def _kinds() -> np.ndarray:
    return np.array([_kind(chr(c)) for c in range(1 << 16)], np.uint8)


def _flags(codes: np.ndarray) -> np.ndarray:
    """The marks of each code point; those beyond the basic plane are few and looked up one by one."""
    out = _kinds()[codes & 0xFFFF]
    far = np.flatnonzero(codes >> 16)
    if len(far):
        seen, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([_kind(chr(c)) for c in seen], np.uint8)[at]
    return out


def repeated_windows(word: np.ndarray, owner: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """For each of ``n`` texts, its words that lie in some window of ``window`` words (a power of two) that occurs twice or more in it."""
    if len(word) <= window:
        return np.zeros(n, np.int64)
    x = np.unique(owner * (int(word.max()) + 1) + word, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < window:  # windows of twice the span are pairs of numbered windows; one across texts equals no other
        x = np.unique(x[:-span] * len(word) + x[span:], return_inverse=True)[1].astype(np.int64)
        span *= 2
    again = np.flatnonzero(np.bincount(x)[x] > 1)
    mark = np.zeros(len(word) + 1, np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + window, -1)
    return np.bincount(owner[np.cumsum(mark)[:-1] > 0], minlength=n)


def _numbered(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _word_numbers(text: str) -> np.ndarray:
    """Each word's number, equal for equal words."""
    if SEPARATORS.search(text):  # white space to Arrow, but not here
        return _numbered(pa.array(WORD.findall(text), pa.string()))
    words = pc.ascii_split_whitespace(pa.array([text], pa.string())).values
    return _numbered(words.filter(pc.greater(pc.binary_length(words), 0)))


def _block(texts: list[str]) -> tuple[np.ndarray, Lines]:
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    flag = _flags(codes)
    breaks = np.flatnonzero(codes == 10)
    start, end = np.append(0, breaks + 1), np.append(breaks, len(codes))
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(length + 1) - length - 1
    owner = np.searchsorted(first, start, "right") - 1

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:], dtype=np.int32)
        return (total[end] - total[start]).astype(np.int64)

    inside = (flag & _SPACE) == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    chars, n = count(inside), count(begins)
    symbols = count(flag & _SYMBOL > 0)
    word = _word_numbers(joined)
    line = np.repeat(np.arange(len(start)), n)
    of = lambda values: np.bincount(owner, values, minlength=len(texts)).astype(np.int64)

    some = np.flatnonzero(n)
    own_line = _numbered(pa.array(joined.split("\n"), pa.string()))[some]
    earliest = np.unique(owner[some] * len(start) + own_line, return_index=True)[1]
    again = np.ones(len(some), bool)
    again[earliest] = False
    dup = np.bincount(owner[some], again, minlength=len(texts)).astype(np.int64)
    base = np.stack([of(n), of(chars), of(symbols), dup, repeated_windows(word, owner[line], len(texts))], 1)

    kinds = np.unique(line * (int(word.max()) + 1 if len(word) else 1) + word)
    distinct = np.bincount(kinds // (int(word.max()) + 1), minlength=len(start)) if len(word) else np.zeros(len(start))
    same = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    pairs = np.bincount(line[1:][same], minlength=len(start))
    ends = np.flatnonzero(last)[np.cumsum(n)[some] - 1] if len(some) else some
    size, words = np.maximum(chars, 1)[some], np.maximum(n, 1)[some]
    x = np.empty((len(some), N_FEATURES))
    x[:, 0] = 1.0
    x[:, 1] = np.minimum(1.0, 10 * symbols[some] / size)
    x[:, 2] = count(flag & _UPPER > 0)[some] / np.maximum(count(flag & _ALPHA > 0)[some], 1)
    x[:, 3] = np.minimum(1.0, 5 * count(flag & _DIGIT > 0)[some] / size)
    x[:, 4] = 1 - distinct[some] / words
    x[:, 5] = pairs[some] / np.maximum(words - 1, 1)
    x[:, 6] = np.minimum(1.0, 5 * count(flag & _CRY > 0)[some] / words)
    x[:, 7] = flag[ends] & _CLOSE > 0
    x[:, 8] = np.minimum(1.0, words / 20)
    x[:, 9] = again
    of_text = owner[some]
    top = np.searchsorted(owner, np.arange(len(texts)))
    return base, Lines(of_text, some - top[of_text], start[some] - first[of_text], end[some] - first[of_text], chars[some], x)


def measure(texts: list[str | None]) -> tuple[np.ndarray, Lines]:
    """[texts, 5] counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the lines with a word."""
    bases, lines, held, size, done = [np.zeros((0, 5), np.int64)], [], [], 0, 0

    def flush() -> None:
        nonlocal held, size, done
        if held:
            base, own = _block(held)
            bases.append(base)
            lines.append(Lines(own.text + done, own.number, own.start, own.end, own.chars, own.x))
            done, held, size = done + len(held), [], 0

    for t in texts:
        t = t or ""
        if size + len(t) > BLOCK:
            flush()
        held.append(t)
        size += len(t)
    flush()
    none = Lines(*(np.empty(0, np.int64) for _ in range(5)), np.empty((0, N_FEATURES)))
    parts = [none, *lines]
    return np.concatenate(bases), Lines(*(np.concatenate([getattr(p, k) for p in parts]) for k in Lines.__dataclass_fields__))


def viterbi(x: np.ndarray, owner: np.ndarray, n: int, m: Crf) -> np.ndarray:
    """The likeliest states of the lines of ``n`` texts, all texts a line at a time; ``owner`` never falls. Ties go to content."""
    e = x @ m.emit
    length = np.bincount(owner, minlength=n)
    order = np.argsort(-length, kind="stable")  # the first ``live[t]`` texts have a line t
    first = (np.cumsum(length) - length)[order]
    live = len(length) - np.cumsum(np.bincount(length))
    back = np.zeros((len(e), 2), np.int8)
    path = np.zeros(len(e), np.int64)
    if not len(e):
        return path
    s = np.zeros((n, 2))
    s[: live[0]] = e[first[: live[0]]] + m.first
    for t in range(1, int(length.max())):
        k = live[t]
        at = first[:k] + t
        stay, change = s[:k, :1] + m.move[0], s[:k, 1:] + m.move[1]
        back[at] = change > stay
        s[:k] = np.maximum(stay, change) + e[at]
    state = (s[:, 1] > s[:, 0]).astype(np.int64)
    for t in range(int(length.max()) - 1, -1, -1):
        at = first[: live[t]] + t
        path[at] = state[: live[t]]
        state[: live[t]] = back[at, state[: live[t]]]
        # texts that end before t keep the state of their own last line until then
    return path


def content_shares(lines: Lines, n: int, m: Crf) -> np.ndarray:
    """The share of word characters in content lines by text; 0 without words."""
    state = viterbi(lines.x, lines.text, n, m)
    good = np.bincount(lines.text, lines.chars * (state == CONTENT), minlength=n)
    return good / np.maximum(np.bincount(lines.text, lines.chars, minlength=n), 1)


def line_labels(x: np.ndarray, chars: np.ndarray, owner: np.ndarray, bad: np.ndarray, rounds: int = 8, steps: int = 60, l2: float = 1e-3) -> np.ndarray:
    """A label of each line from its document's (``bad``): posteriors of a line model that is fitted anew to them each round.

    At least half of a document's word characters bear the document's label: those of the lines that are likeliest to.
    """
    y = bad[owner].astype(np.float64)
    target = y.copy()
    w = np.zeros(x.shape[1])
    half = np.bincount(owner, chars) / 2
    for _ in range(rounds):
        weight = np.where(target > 0.5, 0.5 / max(1.0, (target > 0.5).sum()), 0.5 / max(1.0, (target <= 0.5).sum()))
        mom, var = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - target)) + l2 * w
            mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g * g
            w = w - 0.3 * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        order = np.lexsort((np.where(y == 1, -p, p), owner))  # by document, the lines likeliest to bear its label first
        before = np.cumsum(chars[order]) - chars[order]
        start = np.searchsorted(owner[order], np.arange(len(half)))
        pinned = np.zeros(len(x), bool)
        pinned[order] = before - before[np.minimum(start, len(x) - 1)][owner[order]] < half[owner[order]]
        target = np.where(pinned, y, p)
    return (target > 0.5).astype(np.int64)


Sequence = tuple[np.ndarray, np.ndarray]


def splices(texts: list[Sequence], seed: int = 11, longest: int = 6) -> list[Sequence]:
    """As many sequences as there are texts, each of two to five runs of equally labelled lines from texts drawn at random, labels taking turns."""
    runs: tuple[list, list] = ([], [])
    for x, z in texts:
        edges = [0, *(np.flatnonzero(z[1:] != z[:-1]) + 1), len(z)]
        for a, b in zip(edges, edges[1:], strict=False):
            runs[z[a]].append((x, a, b))
    if not runs[0] or not runs[1]:
        return []
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(len(texts)):
        c, xs, zs = int(rng.integers(2)), [], []
        for _ in range(int(rng.integers(2, 6))):
            x, a, b = runs[c][int(rng.integers(len(runs[c])))]
            a = int(rng.integers(a, b))
            b = min(b, a + int(rng.integers(1, longest + 1)))
            xs.append(x[a:b])
            zs.append(np.full(b - a, c))
            c = 1 - c
        out.append((np.concatenate(xs), np.concatenate(zs)))
    return out


def train(texts: list[Sequence], steps: int = 120, l2: float = 1e-3, most_lines: int = 32) -> Crf:
    """The field that makes the label sequences likeliest, by Adam on forward-backward gradients.

    Long texts give several training sequences of ``most_lines`` lines; classes weigh the same.
    """
    seqs = [(x[a : a + most_lines], z[a : a + most_lines]) for x, z in texts for a in range(0, len(x), most_lines)]
    seqs.sort(key=lambda s: -len(s[0]))  # the first ``live[t]`` sequences have a line t
    length = np.array([len(x) for x, _ in seqs])
    top, n = int(length.max()), len(seqs)
    x, z = np.zeros((n, top, N_FEATURES)), np.zeros((n, top), np.int64)
    for i, (rows, states) in enumerate(seqs):
        x[i, : len(rows)], z[i, : len(rows)] = rows, states
    live = [int((length > t).sum()) for t in range(top + 1)]
    on = np.arange(top) < length[:, None]
    share = [max(1, int((on & (z == c)).sum())) for c in (0, 1)]
    # A sequence weighs by its lines, and a line by how rare its class is.
    weight = (on * np.where(z == 1, 0.5 / share[1], 0.5 / share[0])).sum(1) / length
    gold = np.eye(2)[z].transpose(1, 0, 2)
    theta = np.zeros(N_FEATURES * 2 + 6)
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emit, move, first = theta[: N_FEATURES * 2].reshape(N_FEATURES, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        e = (x @ emit).transpose(1, 0, 2)
        alpha, beta = np.zeros((top, n, 2)), np.zeros((top, n, 2))
        alpha[0] = e[0] + first
        for t in range(1, top):
            k = live[t]
            from_0, from_1 = (alpha[t - 1, :k, s, None] + move[s] for s in (0, 1))
            alpha[t, :k] = np.logaddexp(from_0, from_1) + e[t, :k]
        for t in range(top - 2, -1, -1):
            k = live[t + 1]
            to = e[t + 1, :k] + beta[t + 1, :k]
            beta[t, :k] = np.logaddexp(to[:, :1] + move[:, 0], to[:, 1:] + move[:, 1])
        end = alpha[length - 1, np.arange(n)]
        total = np.logaddexp(end[:, 0], end[:, 1])
        p = np.exp(np.where(on.T[:, :, None], alpha + beta - total[None, :, None], -np.inf))
        diff = np.where(on.T[:, :, None], p - gold, 0.0) * weight[None, :, None]
        g_emit = np.einsum("stf,tsc->fc", x, diff, optimize=True)
        g_move = np.zeros((2, 2))
        for t in range(1, top):
            k = live[t]
            pair = np.exp(alpha[t - 1, :k, :, None] + move + (e[t, :k] + beta[t, :k])[:, None, :] - total[:k, None, None])
            g_move += np.einsum("sab,s->ab", pair - gold[t - 1, :k, :, None] * gold[t, :k, None, :], weight[:k])
        g = np.concatenate([g_emit.ravel(), g_move.ravel(), diff[0].sum(0)]) + l2 * theta
        mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g * g
        theta = theta - 0.1 * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[: N_FEATURES * 2].reshape(N_FEATURES, 2), theta[-6:-2].reshape(2, 2), theta[-2:])


def learn(texts: list[tuple[np.ndarray, np.ndarray, int]]) -> Crf | None:
    """The field of (features, word characters, bad or not) by document; None unless both kinds are there."""
    texts = [t for t in texts if len(t[0])]
    if len({bad for _, _, bad in texts}) < 2:
        return None
    owner = np.repeat(np.arange(len(texts)), [len(x) for x, _, _ in texts])
    z = line_labels(np.concatenate([x for x, _, _ in texts]), np.concatenate([c for _, c, _ in texts]), owner, np.array([bad for _, _, bad in texts]))
    at = np.cumsum([len(x) for x, _, _ in texts])[:-1]
    own = [(x, s) for (x, _, _), s in zip(texts, np.split(z, at), strict=True)]
    return train(own + splices(own))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", max_lines: int = 128
) -> Crf | None:
    """The field learned from at most ``max_rows`` labelled texts of each kind, in order of a hash of their id.

    A text of more than ``max_lines`` lines gives a run of so many, from a place that follows from its size; so the driver holds at most
    2 * max_rows * max_lines lines of N_FEATURES numbers.
    """
    known = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q"))
    order = F.xxhash64("_id")
    chosen = known.filter("q = 1").orderBy(order, "_id").limit(max_rows).unionByName(known.filter("q = 0").orderBy(order, "_id").limit(max_rows))
    source = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    # At most 2 * max_rows ids.
    sample = cut(source.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", F.col("q").cast("int").alias("q")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            _, own = measure(b.column(0).to_pylist())
            x, c = [], []
            for k in range(b.num_rows):
                at, to = np.searchsorted(own.text, (k, k + 1))
                if to - at > max_lines:
                    at += int(own.chars[at:to].sum()) % (to - at - max_lines + 1)
                    to = at + max_lines
                x.append(own.x[at:to].astype(np.float32).ravel())
                c.append(own.chars[at:to])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float32())), pa.array(c, pa.list_(pa.int64()))], ["q", "x", "c"])

    data = sample.mapInArrow(rows, "q int, x array<float>, c array<bigint>").toPandas()
    texts = [(np.asarray(x, np.float64).reshape(-1, N_FEATURES), np.asarray(c, np.int64), 1 - q) for q, x, c in zip(data["q"], data["x"], data["c"], strict=True)]
    # Which row comes first must not depend on the tasks' order.
    return learn(sorted(texts, key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes())))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "kept", "content_share")


def verdicts(texts: list[str | None], model: Crf | None, min_words: int = 20, least_share: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, kept and content share (0 where the base rules failed) of each text."""
    base, lines = measure(texts)
    failed = (base[:, 0] < min_words) | (100 * base[:, 4] > 30 * base[:, 0])
    share = content_shares(lines, len(texts), model) if model else np.ones(len(texts))
    share[failed] = 0.0
    return base, failed, ~failed & (share >= least_share), share


def judge_column(df: DataFrame, model: Crf | None, text_col: str = "text", min_words: int = 20, least_share: float = 0.5) -> DataFrame:
    """``df`` with the base counts, base_failed, content_share and kept."""
    own_columns = df.drop(*ADDED)
    names = own_columns.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            base, failed, kept, share = verdicts(b.column(b.schema.get_field_index(text_col)).to_pylist(), model, min_words, least_share)
            own = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, base.T), pa.array(failed), pa.array(kept), pa.array(share)], [*names, *ADDED])

    kinds = [*[LongType()] * len(BASE), BooleanType(), BooleanType(), DoubleType()]
    return own_columns.mapInArrow(run, StructType([*own_columns.schema.fields, *map(StructField, ADDED, kinds)]))


def judge(df: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    return judge_column(df.select(id_col, text_col), model, text_col, **how).drop(text_col)


def line_states(df: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line with a word: id, line (number from 0), start, end (characters) and whether it is boilerplate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            _, own = measure(b.column(1).to_pylist())
            state = viterbi(own.x, own.text, b.num_rows, model)
            cols = [b.column(0).take(pa.array(own.text)), *map(pa.array, (own.number, own.start, own.end)), pa.array(state == BOILERPLATE)]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "line", "start", "end", "boilerplate"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, line bigint, start bigint, end bigint, boilerplate boolean")
