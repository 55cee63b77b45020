"""Exact nearest rows within one task: a balanced k-d tree whose leaves are compared as matrices.

Where boxes tell nothing apart, all rows are compared by products in single precision, which leave out only pairs that
are too far apart for sure; what they leave is compared in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Rows of a leaf, queries searched at a time, and values that a step may hold.
LEAF = 256
QUERIES = 4_096
BLOCK = 2_000_000
#: Distances are whole multiples of 1 / QUANTUM.
QUANTUM = 1e6
#: Beyond this size squares might overflow, and rows are compared one by one.
HUGE = 1e100
#: Queries and references of one product where all rows are compared.
FLAT_QUERIES, FLAT_ROWS = 512, 1_024
#: Single precision is taken where its error is at most this share of a query's bound, and squares stay below COARSE.
COARSE_ERROR, COARSE = 0.05, 1e30


def quantised(squares: np.ndarray) -> np.ndarray:
    return np.floor(np.sqrt(squares) * QUANTUM + 0.5) / QUANTUM


def distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    total = np.zeros((len(q), len(r)))
    for i in range(q.shape[1]):
        gap = q[:, i, None] - r[None, :, i]
        total += gap * gap
    return np.sqrt(total)


def pair_squares(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Squared distances row by row, summed in the order of ``distances``: the same to the last bit."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        gap = q[:, i] - r[:, i]
        total += gap * gap
    return total


def first_of_each(row: np.ndarray, col: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` first of each row by distance and column, rows ascending."""
    order = np.lexsort((col, d, row))
    row, col, d = row[order], col[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], col[keep], d[keep]


def slack(dims: int, size: np.ndarray, kind: type = float) -> np.ndarray:
    """What a square taken from norms and a product may be wrong by, ``size`` being the sum of the squared norms."""
    return 16.0 * (dims + 8) * float(np.finfo(kind).eps) * size


def set_cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is set in a mask that is mostly empty: eight cells are passed over at a time."""
    if mask.shape[1] % 8:
        return np.nonzero(mask)
    flat = mask.reshape(-1)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[flat[at]], mask.shape[1])


def reach(squares: np.ndarray) -> np.ndarray:
    """Squared distances up to which a row may still round to the same distance."""
    return (np.sqrt(squares) + 2.0 / QUANTUM) ** 2


class Tree:
    """References, ids ascending, in the leaves of a k-d tree split at positions ``n * i >> level``.

    Of rows with one vector only the first by id can be among the nearest: as many as ``copies`` ids are kept.
    Rows with a value that is no finite number are no one's neighbours.
    """

    def __init__(self, rid: np.ndarray, x: np.ndarray, copies: int, leaf: int = LEAF):
        self.rid, self.dims = rid, x.shape[1]
        at = np.flatnonzero(np.isfinite(x).all(axis=1))
        at = at[self._first_copies(x[at], at, copies)]
        self.middle = x[at].mean(axis=0) if len(at) else np.zeros(self.dims)
        n = len(at)
        self.levels = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
        self.cut = np.zeros(1 << self.levels)
        self.axis = np.zeros(1 << self.levels, np.int64)
        for level in range(self.levels):
            for i in range(1 << level):
                lo, hi, mid = n * i >> level, n * (i + 1) >> level, n * (2 * i + 1) >> level + 1
                part = x[at[lo:hi]]
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                order = np.argpartition(part[:, axis], mid - lo)
                at[lo:hi] = at[lo:hi][order]
                self.axis[(1 << level) + i], self.cut[(1 << level) + i] = axis, part[order[mid - lo], axis]
        leaves = 1 << self.levels
        self.starts = np.array([n * i >> self.levels for i in range(leaves + 1)])
        self.at, self.x = at, x[at]
        centred = self.x - self.middle
        self.norms = (centred * centred).sum(axis=1)
        self.factors = np.c_[-2.0 * centred, self.norms]  # a row times (query, 1) is the square less the query's norm
        self.columns: dict[type, np.ndarray] = {}
        self.low, self.high = np.zeros((2 * leaves, self.dims)), np.zeros((2 * leaves, self.dims))
        if n:
            self.low[leaves:], self.high[leaves:] = (f.reduceat(self.x, self.starts[:-1], axis=0) for f in (np.minimum, np.maximum))
        for i in range(leaves - 1, 0, -1):
            self.low[i] = np.minimum(self.low[2 * i], self.low[2 * i + 1])
            self.high[i] = np.maximum(self.high[2 * i], self.high[2 * i + 1])

    def _first_copies(self, x: np.ndarray, at: np.ndarray, copies: int) -> np.ndarray:
        lines = np.random.default_rng(7).normal(size=self.dims)
        mark = np.zeros(len(x))
        for i in range(self.dims):
            mark += x[:, i] * lines[i]
        order = np.argsort(mark, kind="stable")
        ids = pd.factorize(self.rid)[0][at[order]] if len(x) else np.zeros(0, np.int64)
        same = (mark[order][1:] == mark[order][:-1])
        same[same] = (x[order[1:][same]] == x[order[:-1][same]]).all(axis=1)
        same = np.r_[False, same][:len(x)]
        step = np.cumsum(~same | (ids != np.r_[-2, ids[:-1]][:len(ids)]))  # counts the different ids of each vector
        first = np.maximum.accumulate(np.where(~same, step, 0)) if len(x) else step
        return np.sort(order[step - first < copies])

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf that each row would lie in."""
        node = np.ones(len(q), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (q[np.arange(len(q)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.levels)

    def visits(self, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves whose box reaches within the squared distance ``limit`` of each row."""
        return box_visits(q, limit, self.low, self.high, self.levels)

    def _leaf(self, leaf: int, ones: np.ndarray) -> np.ndarray:
        """Squares of centred rows, with a one after each, to the references of a leaf, less the rows' own norms."""
        return ones @ self.factors[self.starts[leaf]:self.starts[leaf + 1]].T

    def nearest(self, qid: np.ndarray, q: np.ndarray, k: int, exclude_self: bool,
                limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, reference row, distance) of the ``k`` nearest, quantised, ties to the smaller reference row.

        ``limit`` are squared distances beyond which a query's neighbours need not be told.
        """
        own = None
        if exclude_self:
            of = pd.factorize(np.concatenate([np.asarray(self.rid, object), np.asarray(qid, object)]))[0]
            own = np.where(of[len(self.rid):] < 0, -2, of[len(self.rid):]), of[:len(self.rid)][self.at]
        limit = np.full(len(q), np.inf) if limit is None else limit
        usable = np.flatnonzero(np.isfinite(q).all(axis=1))
        out = []
        if len(self.at) and len(usable):
            if max(np.abs(q[usable]).max(), np.abs(self.x).max()) > HUGE:
                return self._plainly(q, k, own, usable)
            size = self.norms.max()
            flat = self.levels == 0
            # queries that lie together are searched together
            usable = usable[np.argsort(self.home(q[usable]), kind="stable")]
            for lo in range(0, len(usable), QUERIES):
                rows = usable[lo:lo + QUERIES]
                codes = None if own is None else (own[0][rows], own[1])
                some = slice(None, None, max(1, len(rows) // 64))
                ones = np.c_[q[rows] - self.middle, np.ones(len(rows))]
                norms = (ones * ones).sum(axis=1) - 1.0
                bound = np.minimum(limit[rows], self._bounds(q[rows], ones, norms, size, k, codes))
                flat = flat or len(self.visits(q[rows][some], bound[some])[0]) * 2 > len(rows[some]) << self.levels
                row, col, d = self._search(q[rows], ones, norms, size, bound, k, codes, flat)
                out.append((rows[row], col, d))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, col, d = (np.concatenate(v) for v in zip(*out))
        order = np.argsort(row, kind="stable")
        return row[order], col[order], d[order]

    def _plainly(self, q, k, own, usable):
        out = []
        step = max(1, BLOCK // len(self.at))
        for lo in range(0, len(usable), step):
            rows = usable[lo:lo + step]
            with np.errstate(over="ignore"):
                d = np.floor(distances(q[rows], self.x) * QUANTUM + 0.5) / QUANTUM
            if own is not None:
                d[own[0][rows, None] == own[1][None, :]] = np.inf
            row, col = np.nonzero(np.isfinite(d))
            row, col, d = first_of_each(row, self.at[col], d[row, col], k)
            out.append((rows[row], col, d))
        return tuple(np.concatenate(v) for v in zip(*out))

    def _bounds(self, q, ones, norms, size, k, codes):
        """Squared distances within which each row has its ``k`` nearest, by the leaf it lies in."""
        bound = np.full(len(q), np.inf)
        home = self.home(q)
        order = np.argsort(home, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            leaf = home[rows[0]]
            found = self._leaf(leaf, ones[rows]) + norms[rows, None]
            if codes is not None:
                found[codes[0][rows, None] == codes[1][None, self.starts[leaf]:self.starts[leaf + 1]]] = np.inf
            if found.shape[1] >= k:
                bound[rows] = np.partition(found, k - 1, axis=1)[:, k - 1]
        return reach(np.maximum(bound, 0.0) + slack(self.dims, norms + size))

    def _search(self, q, ones, norms, size, bound, k, codes, flat):
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, n = [], 0

        def settled():
            row, col = (np.concatenate(v) for v in zip(*held))
            d = quantised(pair_squares(q[row], self.x[col]))
            row, col, d = first_of_each(*(np.concatenate(v) for v in zip(best, (row, self.at[col], d))), k)
            last = np.flatnonzero(np.bincount(row, minlength=len(q)) >= k)
            bound[last] = np.minimum(bound[last], reach(d[np.searchsorted(row, last, side="right") - 1] ** 2))
            return row, col, d

        # both read the bounds as they are when the next pairs are asked for
        for row, col in self._products(ones, norms, size, bound) if flat else self._visited(q, ones, norms, size, bound):
            if codes is not None:
                other = codes[0][row] != codes[1][col]
                row, col = row[other], col[other]
            held.append((row, col))
            n += len(row)
            if n > 8 * len(q) + 4_096:
                best, held, n = settled(), [], 0
        return settled() if held else best

    def _visited(self, q, ones, norms, size, bound):
        """(row, place) of the pairs that may be within the rows' bounds, leaf by leaf of those whose box reaches there."""
        wrong = slack(self.dims, norms + size) - norms
        row, leaf = self.visits(q, bound)
        order = np.argsort(leaf, kind="stable")
        row, leaf = row[order], leaf[order]
        ends = np.flatnonzero(np.diff(leaf)) + 1
        for at, rows in zip(leaf[np.r_[0, ends]] if len(leaf) else (), np.split(row, ends)):
            near, col = np.nonzero(self._leaf(at, ones[rows]) <= (bound + wrong)[rows, None])
            yield rows[near], col + self.starts[at]

    def _products(self, ones, norms, size, bound):
        """(row, place) of the pairs that may be within the rows' bounds, from products of all rows."""
        rough = slack(self.dims, norms + size, np.float32)
        coarse = (rough <= COARSE_ERROR * bound) & (norms + size < COARSE)
        for kind, rows in ((np.float32, np.flatnonzero(coarse)), (np.float64, np.flatnonzero(~coarse))):
            if not len(rows):
                continue
            left, right = ones[rows].astype(kind), self._columns(kind)
            wrong = slack(self.dims, norms[rows] + size, kind) - norms[rows]
            for lo in range(0, len(self.at), FLAT_ROWS):
                part = right[:, lo:lo + FLAT_ROWS]
                for first in range(0, len(rows), FLAT_QUERIES):
                    some = slice(first, first + FLAT_QUERIES)
                    cut = (bound[rows[some]] + wrong[some]).astype(kind)
                    row, col = set_cells(left[some] @ part <= cut[:, None])
                    yield rows[first + row], col + lo

    def _columns(self, kind: type) -> np.ndarray:
        """The factors as columns, made once for each precision."""
        if kind not in self.columns:
            self.columns[kind] = np.ascontiguousarray(self.factors.T, dtype=kind)
        return self.columns[kind]


def box_visits(q: np.ndarray, limit: np.ndarray, low: np.ndarray, high: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the boxes of a binary tree (node 1 above 2 and 3, and so on) within the squares ``limit``."""
    row, node = np.arange(len(q)), np.ones(len(q), np.int64)
    for level in range(levels + 1):
        keep = []
        for lo in range(0, len(row), max(1, BLOCK // q.shape[1])):
            some = slice(lo, lo + max(1, BLOCK // q.shape[1]))
            x = q[row[some]]
            gap = np.maximum(np.maximum(low[node[some]] - x, x - high[node[some]]), 0.0)
            keep.append((gap * gap).sum(axis=1) <= limit[row[some]])
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        row, node = row[keep], node[keep]
        if level < levels:
            row, node = np.repeat(row, 2), (2 * node[:, None] + np.arange(2)).ravel()
    return row, node - (1 << levels)
