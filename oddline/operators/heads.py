"""Neighbours in a block whose rows share the first values of their vectors.

Rows of the hybrid detector are the vector of a text, the head, followed by a few numbers of
the record, the tail.  Masked texts repeat, whole rows hardly ever do.  So heads are compared
once per pair of different heads, and the rows of a head are cut by their tails into leaves,
which are visited only if head and tails together allow a neighbour there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

LEAF_ROWS = 32
FEW = 64  # rows per query that may be left by a bound from other blocks
DENSE = 8  # queries that ask for more than one row in so many are compared with all
PAIRS = 500_000  # pairs of a row and a leaf, or of two rows, expanded at once
KERNEL_VALUES = 500_000  # products at once, few enough to stay in a cache
NEAR_HEADS = 8  # heads of a block, or as many as neighbours, that give a query without a bound its first one
NEAR_ROWS = 64  # their rows, from the nearest head on; no further head is taken then
# Distances this close are ties and are ordered by id.
TIE_DECIMALS = 9


def exact_distances(q: np.ndarray, c: np.ndarray, at: np.ndarray, hit: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs ``(at, hit)``, piecewise: many ties are many pairs."""
    out = np.empty(len(at))
    for start in range(0, len(at), 65_536):
        part = slice(start, start + 65_536)
        if metric == "inner_product":
            out[part] = (q[at[part]] * c[hit[part]]).sum(1)
        else:
            difference = q[at[part]] - c[hit[part]]
            out[part] = (difference * difference).sum(1)
    return np.sqrt(out) if metric == "euclidean" else out


def kth_bound(cost: np.ndarray, k: int, groups: int = 256) -> np.ndarray:
    """At least the k-th smallest value of each row.

    The k-th smallest of the minima of column groups: each of those k groups
    holds a value that is no larger.  Much cheaper than selecting in full.
    """
    n = cost.shape[1]
    if n < 4 * groups or k >= groups:
        return np.partition(cost, k - 1, axis=1)[:, k - 1]
    per_group = n // groups
    minima = cost[:, : per_group * groups].reshape(len(cost), per_group, groups).min(axis=1)
    return np.partition(minima, k - 1, axis=1)[:, k - 1]


def nearest_in_block(
    query_keys, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, metric: str, worst: np.ndarray | None = None
) -> pd.DataFrame:
    """The k best of one corpus block for each row of one query block, or fewer:
    rows beyond ``worst``, the k-th best distance of a query so far, may be left out.

    A matrix product in single precision narrows the candidates; every candidate
    that its rounding leaves in question gets its distance from direct
    subtraction in double precision.
    """
    k = min(k, len(c))
    by_id = np.argsort(ids, kind="stable")
    ids, c = ids[by_id], c[by_id]
    # cost = -2 q.c + |c|^2 (or -q.c): the order of the distances of one query.
    # Distances do not change with the origin; near the middle of the block the
    # numbers, and so their rounding, are small.
    origin = 0.0 if metric == "inner_product" else c.mean(0)
    near_q, near_c = q - origin, c - origin
    q_squares, c_squares = (near_q * near_q).sum(1), (near_c * near_c).sum(1)
    if metric == "inner_product":
        left, right = -near_q, near_c
    else:
        left = np.hstack([-2.0 * near_q, np.ones((len(q), 1))])
        right = np.hstack([near_c, c_squares[:, None]])
    left, right = left.astype(np.float32), np.ascontiguousarray(right.T, dtype=np.float32)
    rounding = 4.0 * (q.shape[1] + 4) * 2.0**-24 * (q_squares + c_squares.max())
    so_far = None
    if worst is not None:  # as costs
        so_far = -worst if metric == "inner_product" else (worst**2 if metric == "euclidean" else worst) - q_squares

    def limit_of(bound: np.ndarray, rows: slice) -> np.ndarray:
        # Values this much above the bound may still belong to the k best.
        square = bound if metric == "inner_product" else bound + q_squares[rows]
        tie = 4.0 * 10.0**-TIE_DECIMALS * (1.0 + np.abs(square))
        if metric == "euclidean":
            tie = tie * (1.0 + 2.0 * np.sqrt(np.abs(square)))
        return np.nextafter((bound + tie + rounding[rows]).astype(np.float32), np.float32(np.inf))

    keys_found, ids_found, exact_found = [], [], []
    step = max(1, KERNEL_VALUES // len(c))
    for start in range(0, len(q), step):
        rows = slice(start, start + step)
        cost = left[rows] @ right
        hits = None
        if so_far is not None and np.isfinite(so_far[rows]).all():
            hits = np.flatnonzero(cost <= limit_of(so_far[rows], rows)[:, None])
        if hits is None or len(hits) > FEW * len(cost):
            bound = kth_bound(cost, k).astype(np.float64)
            if so_far is not None:
                bound = np.minimum(bound, so_far[rows])
            hits = np.flatnonzero(cost <= limit_of(bound, rows)[:, None])
        at, hit = np.divmod(hits, len(c))
        exact = exact_distances(q, c, start + at, hit, metric)
        ranking = -exact if metric == "inner_product" else exact
        order = np.lexsort((hit, np.round(ranking, TIE_DECIMALS), at))
        at, hit, exact = at[order], hit[order], exact[order]
        first = np.searchsorted(at, np.arange(len(cost)))
        keep = np.arange(len(at)) - first[at] < k
        keys_found.append(query_keys[rows][at[keep]])
        ids_found.append(ids[hit[keep]])
        exact_found.append(exact[keep])
    found = map(np.concatenate, (keys_found, ids_found, exact_found))
    return pd.DataFrame(dict(zip(("vec_key", "neighbor_id", "distance"), found)))


def heads_of(x: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray]:
    """The different heads, and the number of each row's head."""
    head = np.ascontiguousarray(x[:, : x.shape[1] - tail], dtype=np.float64)
    if not head.shape[1]:
        return head[:1], np.zeros(len(x), np.int64)
    _, first, of = np.unique(head.view(f"V{8 * head.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return head[first], of.ravel()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``i`` and position of everything in the ranges that start at ``starts[i]``."""
    at = np.repeat(np.arange(len(sizes)), sizes)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of entries whose sizes add up to ``most``, or of one entry."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(start, stop)
        start = stop


class _Leaves:
    """Rows of a block by head and tail, cut into leaves of one head that lie between ``low`` and ``high``."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, tail: int):
        self.heads, of = heads_of(c, tail)
        tails = c[:, c.shape[1] - tail :]
        order = np.lexsort((*tails.T[::-1], of))
        self.ids, self.rows, self.tails = ids[order], c[order], tails[order]
        self.id_rank = np.empty(len(ids), np.int64)
        self.id_rank[np.argsort(self.ids, kind="stable")] = np.arange(len(ids))
        self.n = n = np.bincount(of, minlength=len(self.heads))
        self.cuts = -(-n // LEAF_ROWS)
        self.first = np.cumsum(self.cuts) - self.cuts
        head, leaf = _spread(self.first, self.cuts)
        start, place = np.cumsum(n) - n, leaf - self.first[head]
        self.start = start[head] + place * n[head] // self.cuts[head]
        self.size = start[head] + (place + 1) * n[head] // self.cuts[head] - self.start
        self.low = np.minimum.reduceat(self.tails, self.start, axis=0)
        self.high = np.maximum.reduceat(self.tails, self.start, axis=0)
        self.spans = np.minimum.reduceat(self.low, self.first, axis=0), np.maximum.reduceat(self.high, self.first, axis=0)

    def away(self, tails: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Squared distance of each tail to what its leaf spans."""
        outside = np.maximum(np.maximum(self.low[leaf] - tails, tails - self.high[leaf]), 0.0)
        return (outside * outside).sum(1)

    def between(self, tails: np.ndarray, row: np.ndarray) -> np.ndarray:
        difference = tails - self.tails[row]
        return (difference * difference).sum(1)

    def kth(self, apart: np.ndarray, tails: np.ndarray, k: int) -> np.ndarray:
        """At least the squared distance, less the head's square, to the k-th nearest row for queries of one head.

        Of the rows of the heads nearest by ``apart`` and by what their tails span; inf where those are fewer than k.
        """
        first = self.start[self.first]
        spans = self.spans
        gap = np.maximum(np.maximum(spans[0] - tails.max(0), tails.min(0) - spans[1]), 0.0)
        cost = apart + (gap * gap).sum(1)
        few = min(len(cost), max(k, NEAR_HEADS))
        near = np.argpartition(cost, few - 1)[:few]
        near = near[np.argsort(cost[near], kind="stable")]
        n = self.n[near]
        near = near[np.cumsum(n) - n < max(k, NEAR_ROWS)]
        of, rows = _spread(first[near], self.n[near])
        if len(rows) < k:
            return np.full(len(tails), np.inf)
        out, own, base = np.empty(len(tails)), self.tails[rows], apart[near][of].astype(np.float64)
        step = max(1, KERNEL_VALUES // len(rows))
        for start in range(0, len(tails), step):
            part = slice(start, start + step)
            squares = base[None, :] + ((tails[part, None, :] - own[None, :, :]) ** 2).sum(2)
            out[part] = np.partition(squares, k - 1, axis=1)[:, k - 1]
        return out


def nearest_by_head(
    keys, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, metric: str, tail: int, worst: np.ndarray | None = None
) -> pd.DataFrame:
    """The k best rows of one block for each query, or fewer: rows beyond ``worst`` may be left out.

    ``tail`` values at the end of a vector are the tail.  As in a search without heads, single
    precision narrows the pairs of heads, and what its rounding leaves in question gets its distance
    from direct subtraction.  Where rows of the block share heads, queries without a bound get one from
    the heads nearest to them.  Queries that have none, or so far from all rows that it leaves much of
    the block, are searched without heads.
    """
    block = _Leaves(ids, c, tail)
    heads, of = heads_of(q, tail)
    by_head = np.argsort(of, kind="stable")
    n_rows = np.bincount(of, minlength=len(heads))
    starts = np.cumsum(n_rows) - n_rows
    tails = q[:, q.shape[1] - tail :]
    origin = block.heads.mean(0)
    near_q, near_c = heads - origin, block.heads - origin
    q_squares, c_squares = (near_q * near_q).sum(1), (near_c * near_c).sum(1)
    left = np.hstack([-2.0 * near_q, np.ones((len(heads), 1))]).astype(np.float32)
    right = np.ascontiguousarray(np.hstack([near_c, c_squares[:, None]]).T, dtype=np.float32)
    rounding = 4.0 * (q.shape[1] + 4) * 2.0**-24 * (q_squares + c_squares.max())
    square = np.full(len(q), np.inf) if worst is None else (worst**2 if metric == "euclidean" else worst.copy())
    found, dense = [], []
    step = max(1, KERNEL_VALUES // len(block.heads))
    shared = 2 * len(block.heads) <= len(c)
    for start in range(0, len(heads), step):
        part = slice(start, min(start + step, len(heads)))
        apart = left[part] @ right  # squared distances of heads less the query's square
        rows = by_head[starts[start] : starts[start] + n_rows[part].sum()]
        if shared and not np.isfinite(square[rows]).all():
            for head, some in enumerate(np.split(rows, starts[start + 1 : start + len(apart)] - starts[start])):
                some = some[~np.isfinite(square[some])]
                if len(some):
                    base = q_squares[start + head] + rounding[start + head]
                    square[some] = np.maximum(block.kth(apart[head], tails[some], k) + base, 0.0)
        own = square[rows]
        tie = 4.0 * 10.0**-TIE_DECIMALS * (1.0 + own)
        if metric == "euclidean":
            tie = tie * (1.0 + 2.0 * np.sqrt(own))
        limit = own + tie + rounding[of[rows]] - q_squares[of[rows]]  # for ``apart`` and tails together
        begin = starts[part] - starts[start]
        most = np.nextafter(np.maximum.reduceat(limit, begin).astype(np.float32), np.float32(np.inf))
        a, head = np.divmod(np.flatnonzero(apart <= most[:, None]), len(block.heads))
        much = np.bincount(a, block.n[head], len(apart)) * DENSE > len(c)
        dense.append(rows[much[of[rows] - start]])
        a, head = a[~much[a]], head[~much[a]]
        row, hit = _within(apart, a, head, begin, n_rows[part], tails[rows], limit, block)
        row = rows[row]
        exact = exact_distances(q, block.rows, row, hit, metric)
        order = np.lexsort((block.id_rank[hit], np.round(exact, TIE_DECIMALS), row))
        row, hit, exact = row[order], hit[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((keys[row[keep]], block.ids[hit[keep]], exact[keep]))
    some = np.concatenate(dense)
    whole = pd.DataFrame(dict(zip(("vec_key", "neighbor_id", "distance"), map(np.concatenate, zip(*found)))))
    if not len(some):
        return whole
    so_far = np.sqrt(square[some]) if metric == "euclidean" else square[some]
    return pd.concat([whole, nearest_in_block(keys[some], q[some], ids, c, k, metric, so_far)], ignore_index=True)


def _within(
    apart: np.ndarray, a: np.ndarray, head: np.ndarray, begin: np.ndarray, n_rows: np.ndarray, tails: np.ndarray,
    limit: np.ndarray, block: _Leaves,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query row and a row of the block within the row's limit, of the pairs of heads ``(a, head)``."""
    rows_found, hits_found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for piece in _pieces(n_rows[a] * block.cuts[head], PAIRS):
        pair, row = _spread(begin[a[piece]], n_rows[a[piece]])
        own, gap = head[piece][pair], apart[a[piece], head[piece]].astype(np.float64)[pair]
        kept = gap <= limit[row]
        row, own, gap = row[kept], own[kept], gap[kept]
        pair, leaf = _spread(block.first[own], block.cuts[own])
        kept = gap[pair] + block.away(tails[row[pair]], leaf) <= limit[row[pair]]
        pair, leaf = pair[kept], leaf[kept]
        for some in _pieces(block.size[leaf], PAIRS):
            at, hit = _spread(block.start[leaf[some]], block.size[leaf[some]])
            of = pair[some][at]
            kept = gap[of] + block.between(tails[row[of]], hit) <= limit[row[of]]
            rows_found.append(row[of[kept]])
            hits_found.append(hit[kept])
    return np.concatenate(rows_found), np.concatenate(hits_found)


# --- which blocks --------------------------------------------------------------------


@dataclass(frozen=True)
class HeldHeads:
    """The heads of every block of a corpus, for tasks that find the blocks a query asks.

    All in single precision: bounds are rounded to the safe side.
    """

    origin: np.ndarray
    right: np.ndarray  # heads from the origin, and their squares, by columns
    low: np.ndarray  # of the tails of the head's rows in the block, by columns
    high: np.ndarray
    block: np.ndarray
    small: np.ndarray  # positions of heads in blocks of fewer than k rows; none if all are

    @staticmethod
    def of(heads: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, small: np.ndarray) -> HeldHeads:
        origin = heads.mean(0)
        near = heads - origin
        right = np.ascontiguousarray(np.hstack([near, (near * near).sum(1)[:, None]]).T, dtype=np.float32)
        low, high = np.ascontiguousarray(_under(low).T), np.ascontiguousarray(-_under(-high).T)
        return HeldHeads(origin, right, low, high, block, np.zeros(0, int) if small.all() else np.flatnonzero(small))

    def _meet(self, x: np.ndarray, tail: int) -> Iterator[tuple]:
        """For each different head of ``x``: its rows, its square, what rounding leaves in question, and of every
        held head the squared distance less that square, without and with what the tails are apart at least."""
        heads, of = heads_of(x, tail)
        by_head = np.argsort(of, kind="stable")
        n = np.bincount(of, minlength=len(heads))
        ends = np.cumsum(n)
        tails = x[by_head, x.shape[1] - tail :]
        low = _under(np.minimum.reduceat(tails, ends - n, axis=0))
        high = -_under(-np.maximum.reduceat(tails, ends - n, axis=0))
        near = heads - self.origin
        squares = (near * near).sum(1)
        rounding = 4.0 * (x.shape[1] + 6) * 2.0**-24 * (squares + float(self.right[-1].max()))
        left = np.hstack([-2.0 * near, np.ones((len(near), 1))]).astype(np.float32)
        step = max(1, 8 * KERNEL_VALUES // len(self.block))
        whole, over, under = (np.empty(len(self.block), np.float32) for _ in range(3))
        for start in range(0, len(heads), step):
            product = left[start : start + step] @ self.right
            for i, apart in enumerate(product, start):
                np.copyto(whole, apart)
                for t in range(tail):
                    np.subtract(self.low[t], high[i, t], out=over)
                    np.subtract(low[i, t], self.high[t], out=under)
                    np.maximum(over, under, out=over)
                    np.maximum(over, np.float32(0), out=over)
                    np.multiply(over, over, out=over)
                    np.add(whole, over, out=whole)
                yield by_head[ends[i] - n[i] : ends[i]], squares[i], rounding[i], apart, whole

    def nearest(self, x: np.ndarray, tail: int) -> np.ndarray:
        """For each row the block of a head that can be nearest to it."""
        out = np.empty(len(x), np.int32)
        for rows, _, _, _, whole in self._meet(x, tail):
            whole[self.small] = np.inf
            out[rows] = self.block[whole.argmin()]
        return out

    def within(self, x: np.ndarray, tail: int, worst: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and a block that can hold a row at most ``worst`` from it, by row."""
        own = worst**2 if metric == "euclidean" else worst
        tie = 4.0 * 10.0**-TIE_DECIMALS * (1.0 + own)
        if metric == "euclidean":
            tie = tie * (1.0 + 2.0 * np.sqrt(own))
        tails = x[:, x.shape[1] - tail :]
        many = int(self.block.max()) + 1
        found = [np.zeros(0, np.int64)]
        for rows, square, rounding, apart, whole in self._meet(x, tail):
            # Rounded for ``apart``, and for sums of it and some numbers that are no larger than the limit.
            limit = (own[rows] + tie[rows]) * (1.0 + 2.0**-20) + 2 * rounding - square
            most = np.nextafter(np.float32(limit.max()), np.float32(np.inf))
            e = np.flatnonzero(whole <= most)
            if len(rows) == 1:
                found.append(rows[0] * many + np.unique(self.block[e]))
                continue
            step = max(1, PAIRS // max(1, len(e)))
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                cost = np.repeat(apart[None, e].astype(np.float64), len(some), axis=0)
                for t in range(tail):
                    value = tails[some, t][:, None]
                    outside = np.maximum(np.maximum(self.low[t][e] - value, value - self.high[t][e]), 0.0)
                    cost += outside * outside
                at, hit = np.nonzero(cost <= limit[start : start + step, None])
                found.append(np.unique(some[at] * many + self.block[e[hit]]))
        return np.divmod(np.unique(np.concatenate(found)), many)


def _under(x: np.ndarray) -> np.ndarray:
    """Single precision, not above ``x``."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))
