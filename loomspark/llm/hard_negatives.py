"""Hard negatives by branch and bound over ball trees.

Rows are dealt into blocks; every block of rows meets every block of anchors in a task, which builds a
ball tree over its rows and descends it for all its anchors together. A node is split by label first,
then at the median of its widest coordinate. Its ball bounds the inner products inside from above
(center * anchor + radius * |anchor|) and below; a node goes for an anchor if all of it lies above or
below the window of scores, or strictly beneath the anchor's current k-th score (an equal score may
win by its identifier), or has no label that counts. Leaves are scored exactly, in integers. A window
over (anchor, window) merges what the blocks found, k rows from each at most.

Rows without an identifier, a label or a vector, or with a component that is null or not finite, take
no part; of rows that repeat an identifier the least (label, vector) counts. Vectors of other lengths
than the anchor's are not compared with it. Scores must fit a long. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.storage import written

#: Rows of a block, anchors of a block, rows of a leaf.
BLOCK, ANCHORS, LEAF = 16_384, 2048, 64
#: Integers that floating point adds exactly.
EXACT = 2.0**53
LEAST = np.iinfo(np.int64).min


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale))))


def prepared(embeddings: DataFrame, label: Column, scale: float = 256.0) -> DataFrame:
    """(id, label, v) of the rows that take part; label is the column to compare by."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), quantised(F.col("embedding"), scale).alias("v"))
    return rows.filter("id is not null and label is not null and v is not null").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


class Tree:
    """Nodes as arrays: rows lo to hi of the permuted table, center, radius, least and largest label, children (0: a leaf)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self.children: list[tuple[int, int]] = []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, above, side = todo.pop()
            k = len(self.nodes)
            if above >= 0:
                self.children[above] = (k, self.children[above][1]) if side == 0 else (self.children[above][0], k)
            x = self.rows[lo:hi].astype(np.float64)
            center = x.mean(0)
            self.nodes.append((lo, hi, center, float(np.sqrt(((x - center) ** 2).sum(1).max())), int(self.labels[lo]), int(self.labels[hi - 1])))
            self.children.append((0, 0))
            if hi - lo > LEAF:
                cut = self._split(lo, hi)
                todo += [(lo, cut, k, 0), (cut, hi, k, 1)]

    def _split(self, lo: int, hi: int) -> int:
        labels, middle = self.labels[lo:hi], (lo + hi) // 2
        if labels[0] != labels[-1]:  # rows are in order of labels: cut where a label ends, next to the middle
            ends = lo + 1 + np.flatnonzero(np.diff(labels))
            return int(ends[np.abs(ends - middle).argmin()])
        x = self.rows[lo:hi]
        order = np.argsort(x[:, (x.max(0) - x.min(0)).argmax()], kind="stable")
        for a in (self.ids, self.labels, self.rows):
            a[lo:hi] = a[lo:hi][order]
        return middle


def search(tree: Tree, k: int, same: bool, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of the first k rows of each anchor with the same (or another) label and a score from lo to hi, and the rows scored.

    Missing ones have the least integer as score.
    """
    n = len(ids)
    best, who, scored = np.full((n, k), LEAST), np.full((n, k), np.iinfo(np.int64).max), 0
    exact = float(np.abs(tree.rows).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] < EXACT
    q, rows = (x.astype(np.float64) if exact else x for x in (vectors, tree.rows))
    floats = vectors.astype(np.float64)
    norm = np.sqrt((floats**2).sum(1))
    def fits(node: int, a: np.ndarray) -> np.ndarray:
        least, most = tree.nodes[node][4:]
        return (labels[a] >= least) & (labels[a] <= most) if same else (labels[a] != least) | (labels[a] != most)

    def score(node: int, a: np.ndarray) -> None:
        at, end = tree.nodes[node][:2]
        s = (q[a] @ rows[at:end].T).astype(np.int64)
        other = (tree.labels[at:end][None, :] == labels[a][:, None]) != same
        s[other | (s < np.maximum(lo[a], best[a, -1])[:, None]) | (s > hi[a][:, None]) | (tree.ids[at:end][None, :] == ids[a][:, None])] = LEAST
        new = (s > LEAST).any(1)
        a, s = a[new], s[new]
        if len(a):
            s, w = np.concatenate([best[a], s], 1), np.concatenate([who[a], np.broadcast_to(tree.ids[at:end], (len(a), end - at))], 1)
            first = np.lexsort((w, -(s + 1)))[:, :k]
            best[a], who[a] = np.take_along_axis(s, first, 1), np.take_along_axis(w, first, 1)

    # down to one leaf each, towards the larger center, for a first k-th score
    seen, todo = np.full(n, -1), [(0, np.arange(n))]
    while todo:
        node, a = todo.pop()
        left, right = tree.children[node]
        if left:
            nearer = floats[a] @ (tree.nodes[left][2] - tree.nodes[right][2]) > 0
            nearer = np.where(fits(left, a) & fits(right, a), nearer, fits(left, a))
            todo += [(child, group) for child, group in ((left, a[nearer]), (right, a[~nearer])) if len(group)]
        else:
            scored += len(a) * (tree.nodes[node][1] - tree.nodes[node][0])
            seen[a] = node
            score(node, a)
    todo = [(0, np.arange(n))]
    while todo:
        node, a = todo.pop()
        at, end, center, radius = tree.nodes[node][:4]
        a = a[fits(node, a)]
        middle, reach = floats[a] @ center, radius * norm[a]
        slack = 1e-9 * (np.abs(middle) + reach + norm[a] * np.sqrt((center**2).sum())) + 1e-3
        a = a[(middle + reach + slack >= np.maximum(lo[a], best[a, -1])) & (middle - reach - slack <= hi[a])]
        if not len(a):
            continue
        left, right = tree.children[node]
        if left:
            # the child that is nearer to most anchors comes last on the stack, so first
            nearer = np.count_nonzero(floats[a] @ (tree.nodes[left][2] - tree.nodes[right][2]) > 0) * 2 > len(a)
            todo += [(right, a), (left, a)] if nearer else [(left, a), (right, a)]
        elif len(a := a[seen[a] != node]):
            scored += len(a) * (end - at)
            score(node, a)
    return best, who, scored


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors of a block of rows whose vectors have one length, by id."""
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("id").to_numpy(), t.column("label").to_numpy(), flat.reshape(t.num_rows, -1)


def _tile(k: int, same: bool, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    names = ("anchor_id", "lo", "hi", "id", "score")
    if not rows.num_rows or not anchors.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    ids, labels, vectors = _arrays(anchors)
    lo, hi = (anchors.column(c).to_numpy() for c in ("lo", "hi"))
    best, who, _ = search(Tree(*_arrays(rows)), k, same, ids, labels, vectors, lo, hi)
    at, place = np.nonzero(best > LEAST)
    return pa.table(dict(zip(names, (ids[at], lo[at], hi[at], who[at, place], best[at, place]), strict=True)))


def first_rows(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, lo, hi, id, score, rank) of the first k rows (score descending, id) for each row of anchors(id, label, v, lo, hi)."""
    n, m = rows.count(), anchors.count()
    row_blocks, anchor_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // ANCHORS))
    block = lambda of, count: F.pmod(F.xxhash64(*of), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    keys = ["size", "row_block", "anchor_block"]
    left = rows.select("id", "label", "v", F.size("v").alias("size"), block(["id"], row_blocks).alias("row_block"), every(anchor_blocks).alias("anchor_block"))
    right = anchors.select(*[F.col(c).alias(c) for c in ("id", "label", "v", "lo", "hi")], F.size("v").alias("size"), block(["id", "lo", "hi"], anchor_blocks).alias("anchor_block"), every(row_blocks).alias("row_block"))
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(partial(_tile, k, same), "anchor_id long, lo long, hi long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "lo", "hi").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(id, label, v) for anchors, some of them.

    An anchor's positives are its first other rows of the same label; a positive's negatives the first rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    rows = written(rows, "vectors")
    asked = written(rows.join(anchors.select("id"), "id", "left_semi"), "anchors")
    everything = asked.withColumns({"lo": F.lit(LEAST + 1).cast("long"), "hi": F.lit(-(LEAST + 1)).cast("long")})
    near = written(first_rows(rows, everything, positives, True).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # least and largest integer score in the window; exact, as integers
    window = near.withColumns({"lo": F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, 100)) div 100)"), "hi": F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")})
    window = written(window.filter("lo <= hi"), "windows")
    wanted = asked.join(window.select(F.col("anchor_id").alias("id"), "lo", "hi").distinct(), "id")
    far = first_rows(rows, wanted, negatives, False)
    return window.join(far, ["anchor_id", "lo", "hi"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
