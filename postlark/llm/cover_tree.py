"""Cover trees over integer vectors and dual-tree search for the largest inner products.

A node covers a run of vectors within its radius around its centre; children are grown
by taking the farthest vector as the next centre until half the radius covers all or a
node has ``CHILDREN``. No two vectors of nodes ``q`` and ``d`` have an inner product over
``<cq, cd> + |cq| rd + |cd| rq + rq rd``, so a pair of nodes whose bound is below the
worst kth score of all queries under ``q`` is skipped.
"""

from dataclasses import dataclass

import numpy as np

LEAF, CHILDREN = 64, 8


@dataclass
class Node:
    start: int
    stop: int
    centre: np.ndarray
    norm: float
    radius: float
    children: list


def build(vectors: np.ndarray) -> tuple[np.ndarray, Node | None]:
    """An order of the vectors in which every node is a run, and the root."""
    order = np.arange(len(vectors))
    if not len(order):
        return order, None

    def grow(start: int, stop: int) -> Node:
        own = vectors[order[start:stop]]
        centre = own.mean(axis=0)
        far = np.sqrt(((own - centre) ** 2).sum(axis=1))
        radius = float(far.max())
        node = Node(start, stop, centre, float(np.sqrt(centre @ centre)), radius, [])
        if stop - start <= LEAF or radius == 0:
            return node
        nearest, owner = far, np.full(len(own), -1)
        for child in range(CHILDREN):
            pick = int(nearest.argmax())
            gap = np.sqrt(((own - own[pick]) ** 2).sum(axis=1))
            closer = gap < nearest if child else np.ones(len(own), bool)
            owner[closer], nearest = child, np.where(closer, gap, nearest)
            if nearest.max() <= radius / 2:
                break
        sort = np.argsort(owner, kind="stable")
        order[start:stop] = order[start:stop][sort]
        sizes = np.bincount(owner)
        sizes = sizes[sizes > 0]
        if len(sizes) > 1:
            ends = start + np.cumsum(sizes)
            node.children = [grow(int(e - n), int(e)) for e, n in zip(ends, sizes)]
        return node

    return order, grow(0, len(order))


def bound(cq, nq, rq, cd, nd, rd):
    """The largest inner product two nodes can have, a little more for rounding."""
    most = cq @ cd + nq * rd + nd * rq + rq * rd
    return most + 1e-6 * (1 + abs(most))


class Best:
    """The k best of each query: higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]
        self.kth = least.astype(np.float64).copy()

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of one query, none worse than its kth so far."""
        if len(scores) > 4 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
            if len(scores) > 4 * self.k:
                first = np.lexsort((ids, -scores))[: self.k]
                scores, ids = scores[first], ids[first]
        both = self.rows[query] + [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())]
        self.rows[query] = sorted(both)[: self.k]
        if len(self.rows[query]) == self.k:
            self.kth[query] = max(self.kth[query], -self.rows[query][-1][0])


def search(queries, query_keys, query_root, data, data_keys, data_ids, data_root, best: Best) -> int:
    """Fill ``best``; vectors are in tree order, keys tell which row is the query's own.

    Returns how many pairs of leaves were compared.
    """
    compared = 0
    stack = [(0.0, query_root, data_root)] if query_root and data_root else []
    while stack:
        most, q, d = stack.pop()
        if most < best.kth[q.start : q.stop].min() and q is not query_root:
            continue
        if not q.children and not d.children:
            compared += 1
            scores = queries[q.start : q.stop] @ data[d.start : d.stop].T
            own = query_keys[q.start : q.stop, None] == data_keys[None, d.start : d.stop]
            fit = (scores >= best.kth[q.start : q.stop, None]) & ~own
            for i in np.flatnonzero(fit.any(axis=1)).tolist():
                chosen = fit[i]
                best.offer(q.start + i, scores[i, chosen], data_ids[d.start : d.stop][chosen])
            continue
        # The wider node is split; the most promising pair is looked at first.
        if q.children and (not d.children or q.radius > d.radius):
            pairs = [(child, d) for child in q.children]
        else:
            pairs = [(q, child) for child in d.children]
        found = []
        for a, b in pairs:
            most = bound(a.centre, a.norm, a.radius, b.centre, b.norm, b.radius)
            if most >= best.kth[a.start : a.stop].min():
                found.append((float(most), a, b))
        stack += sorted(found, key=lambda pair: pair[0])
    return compared
