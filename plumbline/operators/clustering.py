"""Density clustering of vector tables of any number of rows.

The mutual-reachability tree needs all distances: vectors are dealt into blocks of about ``BLOCK_ROWS`` by a hash of their
id, and each pair of blocks is one group, once for core distances and once for the least tree of its edges. The least tree
of the trees' edges is the least tree of all edges. The work grows with the square of the rows; the tree's n - 1 edges
are condensed by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut

BLOCK = 512
BLOCK_ROWS = 4096
TILE = 2048
FAN_IN = 8


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest point, the point itself counting as the first; in row blocks."""
    sq = (x * x).sum(1)
    out = np.empty(len(x))
    for a in range(0, len(x), BLOCK):
        d = sq[a : a + BLOCK, None] + sq - 2 * x[a : a + BLOCK] @ x.T
        out[a : a + BLOCK] = np.sqrt(np.maximum(np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1], 0))
    return out


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (a, b, mutual reachability) by Prim, holding one row of distances at a time."""
    n, sq = len(x), (x * x).sum(1)
    best, frm, free = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    at, edges = 0, np.empty((max(0, n - 1), 3))
    for i in range(n - 1):
        free[at] = False
        d = np.maximum(np.sqrt(np.maximum(sq + sq[at] - 2 * x @ x[at], 0)), np.maximum(core, core[at]))
        closer = free & (d < best)
        best[closer], frm[closer] = d[closer], at
        at = int(np.where(free, best, np.inf).argmin())
        edges[i] = frm[at], at, best[at]
    return edges[np.argsort(edges[:, 2], kind="stable")]


def condense(edges: np.ndarray, n: int, least: int) -> list[tuple[int, int, float, int]]:
    """(parent, child, lambda, size): clusters are numbered from n (the root) on; smaller numbers are points."""
    left, right, dist, size = {}, {}, {}, np.ones(2 * n, np.int64)
    top = np.arange(2 * n)

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k, (a, b, d) in enumerate(edges):
        u, v, new = find(int(a)), find(int(b)), n + k
        left[new], right[new], dist[new] = u, v, d
        size[new] = size[u] + size[v]
        top[u] = top[v] = new

    def points(node):
        stack = [node]
        while stack:
            m = stack.pop()
            if m < n:
                yield m
            else:
                stack += (left[m], right[m])

    out, labels = [], n + 1
    stack = [(2 * n - 2, n)] if n > 1 else []
    while stack:
        node, cluster = stack.pop()
        lam = 1 / dist[node] if dist[node] > 0 else np.inf
        kids = (left[node], right[node])
        big = [k for k in kids if size[k] >= least and k >= n]
        split = sum(size[k] >= least for k in kids) == 2
        for k in kids:
            if size[k] < least:
                out += [(cluster, p, lam, 1) for p in points(k)]
            elif split:
                out.append((cluster, labels, lam, int(size[k])))
                if k in big:
                    stack.append((k, labels))
                else:
                    out.append((labels, k, np.inf, 1))
                labels += 1
            else:
                stack.append((k, cluster)) if k >= n else out.append((cluster, k, lam, 1))
    return out


def select(tree: list[tuple[int, int, float, int]], n: int, single: bool = False, method: str = "eom", epsilon: float = 0.0) -> np.ndarray:
    """Labels by excess of mass (``eom``) or of the tree's leaves (``leaf``); -1 is noise. The root counts as a cluster only if ``single``.

    Chosen clusters that were born nearer than ``epsilon`` give way to their first ancestor that wasn't, short of the root.
    """
    if not tree:
        return np.full(n, -1)
    birth, stable, kids = {n: 0.0}, {}, {}
    for p, c, lam, _ in tree:
        if c >= n:
            birth[c] = lam
            kids.setdefault(p, []).append(c)
    for p, _, lam, s in tree:
        gain = min(lam, 1e12) - min(birth[p], 1e12)
        stable[p] = stable.get(p, 0.0) + gain * s
    chosen: set[int] = {c for c in birth if not kids.get(c) and (c != n or single)} if method == "leaf" else set()
    for c in sorted(birth, reverse=True) if method == "eom" else ():  # children have larger numbers
        below = sum(stable.get(k, 0.0) for k in kids.get(c, []))
        if (c == n and not single) or (kids.get(c) and below > stable.get(c, 0.0)):
            stable[c] = below
        else:
            stack = list(kids.get(c, []))
            while stack:
                k = stack.pop()
                chosen.discard(k)
                stack += kids.get(k, [])
            chosen.add(c)
    owner = {c: p for p, c, _, _ in tree}
    if epsilon and chosen != {n}:
        raised = set()
        for c in chosen:
            while birth[c] and 1 / birth[c] < epsilon and (owner[c] != n or single):
                c = owner[c]
            raised.add(c)
        inner = lambda c: c != n and (owner[c] in raised or inner(owner[c]))
        chosen = {c for c in raised if not inner(c)}
    number = {c: i for i, c in enumerate(sorted(chosen))}
    out = np.full(n, -1)
    for i in range(n):
        c = owner.get(i)
        while c is not None and c not in number:
            c = owner.get(c)
        if c is not None:
            out[i] = number[c]
    return out


def hdbscan_labels(x: np.ndarray, min_cluster_size: int = 5, min_samples: int = 5, single: bool = False, method: str = "eom", epsilon: float = 0.0) -> np.ndarray:
    if len(x) < 2:
        return np.full(len(x), -1)
    edges = spanning_tree(x, core_distances(x, min_samples))
    return select(condense(edges, len(x), min_cluster_size), len(x), single, method, epsilon)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x @ y.T
    d *= -2
    d += (x * x).sum(1)[:, None]
    d += (y * y).sum(1)
    return d


def least(d: np.ndarray, k: int) -> np.ndarray:
    """The k smallest values of each row; infinite where a row has fewer."""
    if d.shape[1] < k:
        d = np.pad(d, ((0, 0), (0, k - d.shape[1])), constant_values=np.inf)
    return np.partition(d, k - 1, axis=1)[:, :k]


def tiles(n: int) -> list[slice]:
    return [slice(a, min(a + TILE, n)) for a in range(0, n, TILE)]


def tree_between(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the least tree of all edges between rows and columns, by Prim."""
    n, m = d.shape
    lines, sides = (d, np.ascontiguousarray(d.T)), (slice(n, n + m), slice(0, n))
    best, frm, free = np.full(n + m, np.inf), np.zeros(n + m, np.int64), np.ones(n + m, bool)
    at, a, b, w = 0, np.empty(n + m - 1, np.int64), np.empty(n + m - 1, np.int64), np.empty(n + m - 1)
    for i in range(n + m - 1):
        free[at], best[at] = False, np.inf
        far = at >= n
        row, side = lines[far][at - n * far], sides[far]
        closer = (row < best[side]) & free[side]
        np.copyto(best[side], row, where=closer)
        np.copyto(frm[side], at, where=closer)
        at = int(best.argmin())
        a[i], b[i], w[i] = frm[at], at, best[at]
    return np.minimum(a, b), np.maximum(a, b) - n, w


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least forest of an edge list in ascending order, ties by the numbers of the ends; by Boruvka."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a, w))
    a, b, w = a[order], b[order], w[order]
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    part, kept, left = np.arange(len(ends)), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        u, v = part[at[left]], part[at[len(a) + left]]
        out = u != v
        left, u, v = left[out], u[out], v[out]
        if not len(left):
            return a[kept], b[kept], w[kept]
        first = np.full(len(ends), len(a))
        np.minimum.at(first, u, left)
        np.minimum.at(first, v, left)
        roots = np.flatnonzero(first < len(a))
        edge = first[roots]
        kept[edge] = True
        up = np.arange(len(ends))
        up[roots] = part[at[edge]] + part[at[len(a) + edge]] - roots
        tops = roots[(up[up[roots]] == roots) & (roots < up[roots])]  # of two parts that chose each other
        up[tops] = tops
        while not np.array_equal(up, higher := up[up]):
            up = higher
        part = up[part]


def hdbscan(
    df: DataFrame,
    id_col: str,
    vec: str = "v",
    min_cluster_size: int = 5,
    min_samples: int = 5,
    block_rows: int = BLOCK_ROWS,
    single: bool = False,
    method: str = "eom",
    epsilon: float = 0.0,
) -> DataFrame:
    """(id, cluster_label) of all vectors, as ``hdbscan_labels`` gives them but for the order of equal distances."""
    n = df.count()
    if n < 2:
        return df.select(id_col, F.lit(-1).alias("cluster_label"))
    p, k = -(-n // block_rows), min(min_samples, n)
    rows = df.select(F.pmod(F.xxhash64(id_col), F.lit(p)).cast("int").alias("block"), F.struct(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).alias("m"))
    packed = rows.groupBy("block").agg(F.sort_array(F.collect_list("m")).alias("m"))
    blocks = cut(packed.select("block", F.col("m.id").alias("ids"), F.flatten("m.v").alias("x")))

    def paired(table: DataFrame):
        """Every two blocks, and every block by itself, as one group."""
        both = table.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(p - 1))))
        pair = F.least("block", "other").cast("bigint") * p + F.greatest("block", "other")
        return both.withColumn("pair", pair).drop("other").repartition(min(p * (p + 1) // 2, 4096), "pair").groupBy("pair")

    def sides(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
        """(block, vectors, core distances) of a pair in order; of a block by itself once; none if one of two is empty."""
        i, j = divmod(int(pdf["pair"].iloc[0]), p)
        if i != j and len(pdf) < 2:
            return []
        pdf = pdf.sort_values("block")
        return [(int(r.block), np.asarray(r.x, np.float64).reshape(r.n, -1), np.asarray(r.core, np.float64) if "core" in pdf else None) for r in pdf.itertuples()]

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = sides(pdf), []
        for i, x, _ in s:
            y = next((y for j, y, _ in s if j != i), x)
            out.append((i, np.concatenate([least(squares(x[t], y), k) for t in tiles(len(x))]).ravel()))
        return pd.DataFrame(out, columns=["block", "near"])

    def core(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.concatenate([np.asarray(r).reshape(-1, k) for r in pdf["near"]], axis=1)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "core": [np.sqrt(np.maximum(least(d, k).max(1), 0))]})

    def packed_edges(group: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"pair": [group], "a": [a.tobytes()], "b": [b.tobytes()], "w": [w.tobytes()]})

    def unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate([np.frombuffer(r, t) for r in pdf[c]]) for c, t in (("a", np.int64), ("b", np.int64), ("w", np.float64)))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        s, found = sides(pdf), []
        if not s:
            return packed_edges(0, *np.empty((3, 0))).iloc[:0]
        (i, x, cx), (j, y, cy) = s[0], s[-1]
        for t in tiles(len(x)):
            if i == j:
                e = spanning_tree(x[t], cx[t])
                found.append(((i << 32) + t.start + e[:, 0].astype(np.int64), (i << 32) + t.start + e[:, 1].astype(np.int64), e[:, 2]))
            for u in tiles(len(y)):
                if i != j or t.start < u.start:
                    d = np.sqrt(np.maximum(squares(x[t], y[u]), 0))
                    a, b, w = tree_between(np.maximum(np.maximum(d, cx[t, None]), cy[u]))
                    found.append(((i << 32) + t.start + a, (j << 32) + u.start + b, w))
        return packed_edges(int(pdf["pair"].iloc[0]), *forest(*map(np.concatenate, zip(*found, strict=True))))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return packed_edges(int(pdf["pair"].iloc[0]), *forest(*unpacked(pdf)))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, w = unpacked(pdf)
        points, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        labels = select(condense(np.stack([at[: len(a)], at[len(a) :], w], axis=1), len(points), min_cluster_size), len(points), single, method, epsilon)
        block = points >> 32
        return pd.DataFrame([(int(i), labels[block == i]) for i in np.unique(block)], columns=["block", "labels"])

    sized = blocks.select("block", F.size("ids").alias("n"), "x")
    cores = paired(sized).applyInPandas(near, "block int, near array<double>").groupBy("block").applyInPandas(core, "block int, core array<double>")
    edges = paired(sized.join(cores, "block")).applyInPandas(tree, kind := "pair bigint, a binary, b binary, w binary")
    groups = p * p
    while groups > 1:
        groups = -(-groups // FAN_IN)
        edges = edges.withColumn("pair", F.floor(F.col("pair") / FAN_IN)).groupBy("pair").applyInPandas(merge, kind)
    labels = edges.groupBy("pair").applyInPandas(label, "block int, labels array<int>")
    both = blocks.select("block", "ids").join(labels, "block").select(F.explode(F.arrays_zip("ids", "labels")).alias("r"))
    return both.select(F.col("r.ids").alias(id_col), F.col("r.labels").alias("cluster_label"))


def hdbscan_of_sample(df: DataFrame, id_col: str, vec: str = "v", sample_rows: int = 100_000, **how) -> DataFrame:
    """(id, cluster_label, distance): clusters of a sample of about ``sample_rows`` vectors, drawn by a hash of the id; all others get the nearest centroid's.

    For tables whose pairs are too many. Sampled noise stays noise; others have no noise. Without a cluster, all are noise.
    """
    from plumbline.operators.vectors import centroid_distances, centroids

    n = df.count()
    rows = df.select(id_col, F.col(vec).cast("array<double>").alias(vec))
    drawn = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(min(1.0, sample_rows / max(1, n)) * (1 << 20))
    labels = cut(hdbscan(rows.filter(drawn), id_col, vec, **how).join(rows.select(id_col, vec), id_col))
    clusters = centroids(labels.filter("cluster_label <> -1"), "cluster_label", vec)
    inside = centroid_distances(labels, "cluster_label", vec).select(id_col, "cluster_label", F.col("distance_to_centroid").alias("distance"))
    near = assign_nearest(rows.filter(~drawn | F.col(id_col).isNull()), clusters, id_col, vec)
    return inside.unionByName(near.withColumn("cluster_label", F.coalesce("cluster_label", F.lit(-1))))


def assign_nearest(df: DataFrame, centroids: DataFrame, id_col: str, vec: str = "v") -> DataFrame:
    """(id, cluster_label, distance) of the nearest centroid (few rows: one by cluster); ties: the smaller label."""
    from plumbline.operators.vectors import distance

    all_c = centroids.agg(F.collect_list(F.struct("cluster_label", "centroid")).alias("cs"))
    near = F.array_min(F.transform("cs", lambda c: F.struct(distance(F.col(vec), c["centroid"]).alias("d"), c["cluster_label"].alias("l"))))
    return df.crossJoin(F.broadcast(all_c)).select(id_col, near.alias("n")).select(id_col, F.col("n.l").alias("cluster_label"), F.col("n.d").alias("distance"))
