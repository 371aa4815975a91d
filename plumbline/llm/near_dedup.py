"""Near-duplicate documents by Order MinHash over five-word shingles.

Shingles are labelled by their occurrence, so that repeats count. For each of many hash orders, the ``kept`` (2) smallest
labelled shingles of a text are taken and put back into text order; two texts agree in such a sample with a
probability that falls with their edit distance, not only with what they share. ``rows`` samples make a band key.

1. Texts with equal words are one node, with the smallest id as its representative.
2. In each bucket of equal band keys the most central member (most co-members over all its buckets) leads, and the others are
   compared with it: as many pairs as members, never all pairs.
3. A pair is a link if a banded alignment of both shingle sequences matches at least ``similarity`` of
   their union, in order. Links give components.
4. Exactness beyond the leader: a leader's followers that fall into several components meet again. Up to ``BLOCK`` followers do so in one
   block. Of larger groups, those that share a first shingle: within the group, a text's shingles are put in one order for all,
   those that the leader lacks first, and two texts of the wanted similarity share one of their first
   ``n - ceil(similarity * n) + 1``; they meet in blocks of at most ``BLOCK`` texts a side. Those of different components that
   could be similar enough by counts of shared shingles are aligned. So no link between two followers of a leader is lost, and in
   large groups, texts that share with each other only what they share with the leader never meet.
5. Every document gets the class of its node: connected components over all links.

Work is linear in the members of buckets, but for step 4, which grows with the pairs of components that share such a rare shingle.

Defined cases: null and empty texts, or ones without words, are one class; a text of one to four words is one shingle; a very long text
is one like any other (its sketch is made a bounded number of hash orders at a time); where the smallest id of a class repeats, exactly
one of its rows is kept; a null id is never smallest unless all are null; an empty table gives an empty result; columns that clash with
the added ones are replaced by those.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from plumbline.llm.batches import sliced
from plumbline.session import cut, discard, stored

SHINGLE = 5
BLOCK = 256
#: Shingles kept by a task for texts that come again.
KEPT = 1 << 21
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_words: dict[str, int] = {}


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def digest_of(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def labelled(words: list[str]) -> np.ndarray:
    """The text's shingles in order, as 64-bit labels that tell repeats apart; all are distinct."""
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > 200_000:
        _words.clear()
    for w in set(words):
        if w not in _words:
            _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        s = s * _M1 + h[i : len(h) - n + 1 + i]
    s ^= s >> np.uint64(29)
    s *= _M2
    order = np.argsort(s, kind="stable")
    r = s[order]
    new = np.append(True, r[1:] != r[:-1])
    if not new.all():
        start = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        s[order] = r + (np.arange(len(r)) - start).astype(np.uint64) * _M1
    return s


def sketch(s: np.ndarray, bands: int, rows: int, kept: int = 2) -> np.ndarray:
    """One key by band (none without shingles)."""
    if not len(s):
        return np.empty(0, np.int64)
    rng = np.random.default_rng(20250101)
    mult = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    mask = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    out = np.zeros((bands * rows, kept), np.uint64)
    step = max(1, (1 << 20) // len(s))
    for a in range(0, len(mult), step):
        v = (s ^ mask[a : a + step, None]) * mult[a : a + step, None]
        at = np.empty((len(v), min(kept, len(s))), np.int64)
        for k in range(at.shape[1]):
            at[:, k] = v.argmin(1)
            v[np.arange(len(v)), at[:, k]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at.sort(1)  # text order
        out[a : a + step, : at.shape[1]] = s[at]
    out = out.reshape(bands, rows * kept)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _M2
    for c in range(out.shape[1]):
        key = (key ^ out[:, c]) * _M1
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Matches of the best in-order alignment over the union, within the band that ``least`` allows; 0 if surely below."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    order = np.argsort(b)
    at = np.searchsorted(b, a, sorter=order)
    at[at == m] = 0
    j = order[at]
    i = np.flatnonzero(b[j] == a)
    j = j[i]
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    j = j[np.abs(i - j) <= band]
    need = least * (n + m) / (1 + least)
    if len(j) < need - 1e-9:
        return 0.0
    if (np.diff(j) > 0).all():
        hits = len(j)
    else:  # labels are distinct, so the longest common subsequence is the longest rise
        tails = np.empty(len(j), np.int64)
        hits = 0
        for x in j:
            k = int(np.searchsorted(tails[:hits], x))
            tails[k] = x
            hits = max(hits, k + 1)
    return hits / (n + m - hits)


def first_shingles(a: np.ndarray, leader: np.ndarray, least: float) -> np.ndarray:
    """The prefix of ``a`` that shares a shingle with that of every text of similarity ``least``, those that the (sorted) leader lacks first."""
    size = len(a) - int(np.ceil(least * len(a) - 1e-9)) + 1
    at = np.searchsorted(leader, a)
    at[at == len(leader)] = 0
    common = leader[at] == a
    return np.concatenate([np.sort(a[~common]), np.sort(a[common])])[:size]


def _shingles_cache():
    kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
    size = 0

    def get(node: bytes, text: str) -> np.ndarray:
        nonlocal size
        if node not in kept:
            kept[node] = labelled(words_of(text))
            size += len(kept[node])
            while size > KEPT and len(kept) > 1:
                size -= len(kept.popitem(last=False)[1])
        kept.move_to_end(node)
        return kept[node]

    return get


def _sketches(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int, carry: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            node, keys = [], []
            for t in b.column(1).to_pylist():
                w = words_of(t)
                node.append(digest_of(w))
                keys.append(sketch(labelled(w), bands, rows))
            made = [b.column(0), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*made, *b.columns[2:]], ["id", "node", "keys", *carried])

    carried = [f"carry_{c}" for c in carry]
    kinds = [df.schema[id_col].dataType, BinaryType(), ArrayType(LongType()), *(df.schema[c].dataType for c in carry)]
    schema = StructType([*map(StructField, ["id", "node", "keys", *carried], kinds)])
    made = df.select(id_col, text_col, *carry).mapInArrow(run, schema)
    return cut(made.withColumn("row", F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each connected component of the links (u, v)."""
    # Written tables throughout: a node with very many links is a hot key, and joins on it must be open to splitting.
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "near-edges")
    label = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("comp")), "near-label")
    while True:
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        lower = label.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = stored(lower.join(jump, "comp", "left").select("node", F.coalesce(F.least("comp", "far"), "comp").alias("comp"), "was"), "near-label")
        discard(label)
        if new.filter("comp != was").isEmpty():
            return new.drop("was")
        label = new


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after links (u, v) between components, a node without links being its own."""
    joined = components(links)
    whole = comp.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    loose = joined.join(comp.select("node"), "node", "left_anti").select("node", "comp")
    return stored(whole.select("node", F.coalesce("top", "comp").alias("comp")).unionByName(loose), "near-comp")


def leaders(rows: DataFrame) -> DataFrame:
    """(key, leader): the most central node of each bucket, from (key, node, n), n being the bucket's size."""
    central = rows.groupBy("node").agg(F.sum("n").alias("score"))
    best = rows.join(central, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("best"))
    return best.select("key", F.col("best.node").alias("leader"))


def placed(rows: DataFrame, comp: DataFrame, node: str = "node", out: str = "comp") -> DataFrame:
    """``rows`` with the component of ``node``, itself where it has no link."""
    own = comp.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return rows.join(own, F.col(node) == F.col("_node"), "left").withColumn(out, F.coalesce("_comp", node)).drop("_node", "_comp")


def classes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
    bands: int = 20,
    rows: int = 2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``df``: id, class_id (its class's smallest id), class_size, kept (one row by class), and the columns in ``carry``."""
    sk = _sketches(df, id_col, text_col, bands, rows, carry)
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    nodes = stored(sk.groupBy("node").agg(F.min(first).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")), "near-nodes")

    # Tables that are joined on keys or leaders are written: a checkpoint would keep its partitioning, and a hot key one task.
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(keyed.join(shared, "key"), "near-members")
    star = stored(members.join(leaders(members), "key").filter("node != leader").select("leader", "node").distinct(), "near-star")

    wanted = star.select("node").union(star.select(F.col("leader").alias("node"))).distinct()
    wanted = wanted.join(nodes.select("node", F.col("rep.id").alias("rep_id")), "node")
    texts = cut(_texts(df, wanted, id_col, text_col))  # stays dealt by node, which is no hot key: joins on it move only the other side

    checked = _align(star, texts, similarity)
    comp = components(checked.filter("linked").select(F.col("leader").alias("u"), F.col("node").alias("v")))
    comp = merged(comp, _beyond_leaders(checked, comp, texts, similarity))

    known = nodes.drop("keys").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = stored(known.groupBy("comp").agg(F.min("rep").alias("best"), F.sum("copies").alias("class_size")), "near-best")
    found = known.select("node", "comp").join(best, "comp").drop("comp")
    return sk.drop("keys").join(found, "node").select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("class_id"),
        "class_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        *(F.col(f"carry_{c}").alias(c) for c in carry),
    )


def _texts(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes, from their representatives' rows."""
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    found = source.join(wanted, F.col("_id").eqNullSafe(F.col("rep_id"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):  # ids may repeat, and then with other texts
            ok = [digest_of(words_of(t)) == n for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return found.mapInArrow(run, "node binary, text string").groupBy("node").agg(F.min("text").alias("text"))


def _dealt(rows: DataFrame, texts: DataFrame, *order: str) -> DataFrame:
    """Rows with a ``block`` and a ``node``, and the node's text, dealt by block and sorted by block and ``order``."""
    return rows.join(texts, "node").repartition("block").sortWithinPartitions("block", *order)


def _align(star: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(leader, node, linked, rare): whether a pair is a link, and the node's first shingles in the leader's order.

    A leader's followers are dealt into blocks, each with the leader's text: as many texts move as there are pairs and blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, lead, ordered = None, np.empty(0, np.uint64), np.empty(0, np.uint64)
        for b in sliced(batches):
            found: list[tuple] = []
            for _, own, node, text in zip(*(c.to_pylist() for c in b.select(["block", "leader", "node", "text"]).columns), strict=True):
                x = labelled(words_of(text))
                if own is None:  # the block's leader comes first
                    leader, lead, ordered = node, x, np.sort(x)
                else:
                    found.append((own, node, aligned_similarity(lead, x, similarity) >= similarity, first_shingles(x, ordered, similarity).view(np.int64)))
                    assert own == leader
            cols = [[*c] for c in zip(*found, strict=True)] or [[]] * 4
            kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["leader", "node", "linked", "rare"])

    parts = stored(star.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "near-parts")
    followers = star.join(parts, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("parts")).alias("i"))
    block = F.xxhash64("leader", "i").alias("block")
    heads = parts.select("leader", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("i"))
    rows = followers.select(block, "leader", "node").unionByName(heads.select(block, F.lit(None).cast("binary").alias("leader"), F.col("leader").alias("node")))
    dealt = _dealt(rows, texts, "leader", "node")  # nulls first
    return stored(dealt.mapInArrow(run, "leader binary, node binary, linked boolean, rare array<bigint>"), "near-checked")


def _beyond_leaders(checked: DataFrame, comp: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between components among the followers of one leader."""
    followers = placed(placed(checked.drop("linked"), comp), comp, "leader", "head")
    followers = stored(followers.select("leader", "node", "rare", F.xxhash64("comp").alias("c"), (F.col("comp") != F.col("head")).alias("stray")), "near-followers")
    several = followers.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.max("stray").alias("any")).filter("any AND n > 1").select("leader", "n")
    followers = stored(followers.join(several, "leader").drop("stray"), "near-followers")

    # Groups of one block meet as they are; larger ones in buckets of their first shingles that several components have.
    few = followers.filter(F.col("n") <= BLOCK).select(F.xxhash64("leader").alias("key"), "node", "c")
    rows = followers.filter(F.col("n") > BLOCK).select("node", "c", F.explode("rare").alias("x"), "leader").select(F.xxhash64("leader", "x").alias("key"), "node", "c")
    keys = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("key")
    rows = stored(rows.join(keys, "key").unionByName(few).distinct(), "near-meeting")

    # Of buckets with the same members, one; members of a bucket's largest component need not meet one another.
    by_comp = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("who"))
    split = by_comp.groupBy("key").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n"), F.sum("who").alias("who"))
    split = split.groupBy("n", "who", "most").agg(F.min("key").alias("key"))
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    split = stored(split.select("key", F.col("most.c").alias("head"), parts(F.col("n")).alias("nb"), parts(F.col("n") - F.col("most.n")).alias("ns")), "near-split")
    part = stored(rows.join(split, "key").withColumn("h", F.xxhash64("node")), "near-part")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod("h", F.col(n).cast("bigint")).cast("int")
    left = part.filter("c != head").select("key", "node", "c", place("ns").alias("i"), each("nb").alias("j"), F.lit(True).alias("probe"))
    right = part.select("key", "node", "c", each("ns").alias("i"), place("nb").alias("j"), F.lit(False).alias("probe"))
    met = left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("block"), "probe", "node", "c")
    found = _dealt(met, texts, "probe", "node").mapInArrow(lambda batches: _blocks(batches, similarity), "u binary, v binary")
    ends = placed(placed(stored(found, "near-found"), comp, "u", "cu"), comp, "v", "cv")
    return ends.select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()


def _blocks(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (node, node) of sorted blocks, each of which may go on in the next batch."""
    get = _shingles_cache()
    now, held = None, ([], [])

    def links() -> pa.RecordBatch:
        u, v = zip(*found, strict=True) if (found := block_links(held[1], held[0], similarity)) else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    for b in sliced(batches):
        for block, probe, node, c, text in zip(*(x.to_pylist() for x in b.select(["block", "probe", "node", "c", "text"]).columns), strict=True):
            if block != now:
                if held[1]:
                    yield links()
                now, held = block, ([], [])
            held[probe].append((node, c, get(node, text)))
    if held[1]:
        yield links()


Member = tuple[bytes, int, np.ndarray]


def block_links(probes: list[Member], rest: list[Member], similarity: float, width: int = 4096) -> list[tuple[bytes, bytes]]:
    """Links between (node, component, shingles) of different components, one for each pair of components that met."""
    if not probes or not rest:
        return []
    a, b = [m[2] for m in probes], [m[2] for m in rest]
    na, nb = np.array([*map(len, a)]), np.array([*map(len, b)])
    could = np.minimum(na[:, None], nb) >= similarity * np.maximum(na[:, None], nb) - 1e-6
    could &= np.array([m[1] for m in probes])[:, None] != np.array([m[1] for m in rest])
    if could.sum() > len(a) + len(b):
        fa, fb = np.concatenate(a), np.concatenate(b)
        both = np.intersect1d(fa, fb)
        who_a, who_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
        common = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, len(both), width):
            part = both[at : at + width]
            ma, mb = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
            for m, f, who in ((ma, fa, who_a), (mb, fb, who_b)):
                k = np.searchsorted(part, f)
                k[k == len(part)] = 0
                ok = part[k] == f
                m[who[ok], k[ok]] = 1
            common += ma @ mb.T
        could &= common >= similarity * (na[:, None] + nb[None, :] - common) - 1e-6
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    out = []
    for i, j in np.argwhere(could):
        u, v = root(probes[i][1]), root(rest[j][1])
        if u != v and aligned_similarity(a[i], b[j], similarity) >= similarity:
            up[u] = v
            out.append((probes[i][0], rest[j][0]))
    return out
