"""Routers decide which cells a row is stored in, and which cells a query looks at, in which order.

A router is fitted on the driver from a bounded sample; it is small and goes
to the executors with the plan. ``assign`` gives (row, cell, primary) for a
block of rows, ``probe`` gives (query, cell) for a block of queries.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

from ..functions.blocks import distances, unit
from ..functions.codecs import orthogonal


class OneCell:
    """All rows in one cell."""

    copies, cells = 1, 1
    SEARCH = ()

    def fit(self, x, n, metric, seed=42):
        return self

    def centre(self, cell):
        return None

    def assign(self, x):
        return np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)

    def everywhere(self, n):
        return True

    def wider(self, k, n, params: dict) -> dict:
        """The width that is given or usual, doubled, up to one at which all is looked at."""
        return {}

    def probe(self, q, k, sizes):
        return np.arange(len(q)), np.zeros(len(q), np.int64)


@dataclass
class KMeansParams:
    """How centroids are trained: most rounds, the first centroids ("draws": by squared distance to those drawn, "parallel": several a round, "rows": rows at random; draws up to 200 centroids and
    parallel beyond where None), and whether small cells (under ``threshold`` of the mean) are pulled toward rows of large ones."""

    rounds: int = 30
    init: str | None = None
    balance: bool = False
    threshold: float = 0.25
    pull: float = 5.0


def seeds(x: np.ndarray, k: int, rng, init: str | None = None) -> np.ndarray:
    """First centroids."""
    init = init or ("draws" if k <= 200 else "parallel")
    if init not in ("draws", "parallel", "rows"):
        raise ValueError(f"unknown way to choose first centroids: {init!r}")
    if init == "rows" or k >= len(x):
        return x[rng.choice(len(x), min(k, len(x)), replace=False)]
    if init == "parallel":
        return parallel_seeds(x, k, rng)
    return drawn_seeds(x, np.ones(len(x)), k, rng)


def drawn_seeds(x: np.ndarray, weight: np.ndarray, k: int, rng) -> np.ndarray:
    """Rows drawn by weight times squared distance to those already drawn."""
    out = [x[rng.choice(len(x), p=weight / weight.sum())]]
    near = distances("euclidean", x, out[0][None])[:, 0]
    while len(out) < k:
        cost = near * weight
        out.append(x[rng.choice(len(x), p=cost / cost.sum()) if cost.sum() > 0 else rng.integers(len(x))])
        near = np.minimum(near, distances("euclidean", x, out[-1][None])[:, 0])
    return np.array(out)


def parallel_seeds(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Rounds that draw about 2 k / rounds rows at once by squared distance; these, weighed by the rows that are nearest to each, are drawn from again."""
    rounds = max(1, int(math.log(k)) + 1)
    few = x[rng.integers(len(x))][None]
    near = distances("euclidean", x, few)[:, 0]
    for _ in range(rounds):
        total = near.sum()
        if total <= 0:
            break
        new = x[rng.random(len(x)) < 2.0 * k / rounds * near / total]
        for i in range(0, len(new), 256):
            near = np.minimum(near, distances("euclidean", x, new[i : i + 256]).min(1))
        few = np.concatenate([few, new])
    if len(few) < k:
        few = np.concatenate([few, x[rng.choice(len(x), k - len(few), replace=False)]])
    own = nearest_cell(x.astype(np.float32), few)
    return drawn_seeds(few, np.bincount(own, minlength=len(few)) + 1e-9, k, rng)


def kmeans(x: np.ndarray, k: int, rounds: int = 30, seed: int = 42, balance: bool = False, threshold: float = 0.25, pull: float = 5.0, init: str | None = None) -> np.ndarray:
    """Lloyd's rounds over a sample. balance: cells under ``threshold`` of the mean size move toward rows of large cells, by a weight that falls with ``pull`` and their size."""
    if k > len(x):
        raise ValueError(f"{k} centroids of {len(x)} rows")
    x, rng = np.asarray(x, np.float64), np.random.default_rng(seed)
    c, near = seeds(x, k, rng, init).astype(np.float64), x.astype(np.float32)
    still = 1e-4 * np.sqrt(x.var(0).sum()) + 1e-12  # centroids that move less than this no longer change cells to speak of
    for i in range(rounds):
        own = nearest_cell(near, c)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        small = np.flatnonzero(count < (threshold * len(x) / k if balance and i < rounds - 5 else 1))
        if len(small):
            donors = rng.choice(len(x), len(small), p=count[own] / count[own].sum())
            weight = np.minimum(count[small], pull)[:, None] if balance else np.zeros((len(small), 1))
            new[small] = (weight * new[small] + x[donors]) / (weight + 1)
        moved = np.sqrt(((new - c) ** 2).sum(1)).max()
        c = new
        if moved <= still:
            break
    return c


def nearest_cell(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each 32-bit row, in blocks; a row's own norm doesn't matter for that."""
    wide, norms = (-2 * c.T).astype(np.float32), (c * c).sum(1).astype(np.float32)
    step = max(1, 4_000_000 // len(c))
    return np.concatenate([(x[i : i + step] @ wide + norms).argmin(1) for i in range(0, len(x), step)])


def probe_rule(order: np.ndarray, sizes: np.ndarray, nprobe: int, k: int) -> np.ndarray:
    """Which of each query's cells, nearest first, are looked at: ``nprobe``, and more until they hold k rows."""
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    return (np.arange(order.shape[1]) < max(nprobe, 1)) | (before < k)


class Centroids:
    """k-means cells; a row belongs to the nearest centroid."""

    copies = 1
    SEARCH = ("nprobe",)

    def __init__(self, nlist: int | None = None, params: KMeansParams | None = None, centroids=None):
        self.nlist, self.params, self.fixed = nlist, params or KMeansParams(), centroids
        self.table = None

    @property
    def cells(self):
        return len(self.table)

    @staticmethod
    def sample_size(n: int, nlist: int) -> int:
        return min(256 * nlist, 250_000, n)

    def lists(self, n: int) -> int:
        return max(1, min(n, self.nlist or math.isqrt(n)))

    def fit(self, x, n, metric, seed=42):
        if metric == "manhattan":
            raise ValueError("k-means cells need Euclidean or cosine distance")
        self.metric = metric
        self.table = np.asarray(self.fixed, np.float64) if self.fixed is not None else kmeans(self.ready(x), min(self.lists(n), len(x)), seed=seed, **vars(self.params))
        return self

    def ready(self, x):
        x = np.asarray(x, np.float64)
        return unit(x) if self.metric == "cosine" else x

    def centre(self, cell):
        return self.table[cell]

    def far(self, x):
        return distances("cosine" if self.metric == "cosine" else "euclidean", x, self.table)

    def assign(self, x):
        return np.arange(len(x)), self.far(x).argmin(1), np.ones(len(x), bool)

    def assign_top(self, x, m: int):
        """(row, cell, rank) of the m nearest cells of each row."""
        order = np.argsort(self.far(x), axis=1, kind="stable")[:, :m]
        return np.repeat(np.arange(len(x)), order.shape[1]), order.ravel(), np.tile(np.arange(order.shape[1]), len(x))

    def everywhere(self, n, nprobe: int | None = None) -> bool:
        """Whether every query looks at every cell of an index of n rows."""
        return (nprobe or 0) >= self.cells

    def wider(self, k, n, params: dict) -> dict:
        return {"nprobe": min(2 * (params.get("nprobe") or max(1, math.isqrt(self.cells))), self.cells)}

    def probe(self, q, k, sizes, nprobe: int | None = None):
        nprobe = min(nprobe or max(1, math.isqrt(self.cells)), self.cells)
        order = np.argsort(self.far(q), axis=1, kind="stable")
        keep = probe_rule(order, sizes, nprobe, k)
        return np.nonzero(keep)[0], order[keep]


def second_cell(x: np.ndarray, table: np.ndarray, first: np.ndarray, rule: str, weight: float) -> np.ndarray:
    """Where a row's second copy goes, never its first cell.

    nearest: the next nearest centroid; shifted: the one nearest to (1 + weight) x - weight c; orthogonal: the one with the
    smallest |r'|^2 + weight (r' . r / |r|)^2, r and r' being residuals to the first and the second centroid.
    """
    weight = max(weight, 0.0)
    if len(table) < 2:
        return first
    if rule == "shifted":
        cost = distances("euclidean", (1 + weight) * x - weight * table[first], table)
    else:
        cost = distances("euclidean", x, table)
        if rule == "orthogonal":
            r = unit(x - table[first])
            cost = cost + weight * ((x * r).sum(1)[:, None] - r @ table.T) ** 2
    cost[np.arange(len(x)), first] = np.inf
    return cost.argmin(1)


class Spilled(Centroids):
    """Each row in its nearest cell and, as a second copy, in one chosen by a rule."""

    copies = 2

    def __init__(self, nlist=None, rule: str | None = None, weight: float | None = None, **more):
        super().__init__(nlist, **more)
        self.rule, self.weight = rule, weight

    def fit(self, x, n, metric, seed=42):
        super().fit(x, n, metric, seed)
        self.rule = self.rule or ("orthogonal" if metric == "cosine" else "shifted")
        self.weight = self.weight if self.weight is not None else {"orthogonal": 1.0, "shifted": 0.5}.get(self.rule, 0.0)
        return self

    def assign(self, x):
        first = self.far(x).argmin(1)
        y = self.ready(x)
        second = second_cell(y, unit(self.table) if self.metric == "cosine" else self.table, first, self.rule, self.weight)
        n, other = np.arange(len(x)), second != first
        return np.r_[n, n[other]], np.r_[first, second[other]], np.r_[np.ones(len(x), bool), np.zeros(other.sum(), bool)]


class Hashes:
    """Multi-probe hashing: in each table orthogonalised projections are cut at quantiles of a sample into slots; the packed slots are the code.

    A query looks at its own code, then at codes with one slot moved by one, nearest boundary first, then at pairs of such moves.
    """

    SEARCH = ("n_probe", "max_candidates")

    def __init__(self, tables: int = 8, bits: int = 12, slot_bits: int | None = None):
        if not 1 <= bits <= 20:
            raise ValueError("1 to 20 bits")
        self.copies, self.bits, self.slot_bits = tables, bits, slot_bits

    @property
    def cells(self):
        return self.copies << self.bits

    def centre(self, cell):
        return None

    def fit(self, x, n, metric, seed=42):
        self.metric = metric
        self.slot_bits = min(self.slot_bits or (1 if metric == "cosine" else 2), self.bits)
        self.width = max(1, self.bits // self.slot_bits)
        d, rng, slots = x.shape[1], np.random.default_rng(seed), 1 << self.slot_bits
        self.axes, self.bounds = [], []
        y = self.ready(x[:20_000])
        for _ in range(self.copies):
            made = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(-(-self.width // d))]
            self.axes.append(np.concatenate(made, 1)[:, : self.width])
            p = np.sort(y @ self.axes[-1], axis=0)
            self.bounds.append(p[[min(len(p) - 1, b * len(p) // slots) for b in range(1, slots)]])  # order statistics of the sample
        return self

    def ready(self, x):
        x = np.asarray(x, np.float64)
        return unit(x) if self.metric == "cosine" else x

    def slots(self, x, t):
        p = self.ready(x) @ self.axes[t]
        return p, (p[:, :, None] >= self.bounds[t].T[None]).sum(2)

    def pack(self, slots, t):
        code = np.zeros(slots.shape[:-1], np.int64)
        for j in range(self.width):
            code = code << self.slot_bits | slots[..., j]
        return code + (t << self.bits)

    def assign(self, x):
        cells = [self.pack(self.slots(x, t)[1], t) for t in range(self.copies)]
        n = np.arange(len(x))
        return np.tile(n, self.copies), np.concatenate(cells), np.repeat(np.arange(self.copies) == 0, len(x))

    def moved(self, q, t):
        """(queries x codes) of a table in the order in which they are looked at: the own code, one slot moved by one, nearest boundary first, then pairs of such moves by the sum of their gaps; -1 where there are no more."""
        p, slot = self.slots(q, t)
        n, last = len(q), (1 << self.slot_bits) - 1
        bounds = self.bounds[t]
        place, every = np.arange(self.width), np.arange(n)[:, None]
        down = np.where(slot > 0, np.abs(p - bounds[np.maximum(slot - 1, 0), place]), np.inf)
        up = np.where(slot < last, np.abs(bounds[np.minimum(slot, last - 1), place] - p), np.inf)
        step = np.int64(1) << self.slot_bits * (self.width - 1 - place)
        gap, delta, dim = np.concatenate([down, up], 1), np.r_[-step, step], np.r_[place, place]
        order = np.argsort(gap, axis=1, kind="stable")
        gap, delta, dim = gap[every, order], delta[order], dim[order]
        a, b = np.triu_indices(gap.shape[1], 1)
        both = np.where(dim[:, a] != dim[:, b], gap[:, a] + gap[:, b], np.inf)
        pairs = np.argsort(both, axis=1, kind="stable")
        own = self.pack(slot, t)[:, None]
        one = np.where(np.isfinite(gap), own + delta, -1)
        two = np.where(np.isfinite(both), own + delta[:, a] + delta[:, b], -1)[every, pairs]
        return np.concatenate([own, one, two], 1)

    def everywhere(self, n, n_probe: int = 8, max_candidates: int | None = None) -> bool:
        return False

    def wider(self, k, n, params: dict) -> dict:
        return {"n_probe": min(2 * params.get("n_probe", 8), 1 + 2 * self.width**2)}

    def probe(self, q, k, sizes, n_probe: int = 8, max_candidates: int | None = None):
        """Of each table the own code and ``n_probe`` more, and further ones until one table's cells, whose rows all differ, hold k rows; where all that can be
        reached hold fewer, the fullest cells of the first table as well. max_candidates: no further cells once these many rows were met."""
        known, count = sizes
        rows, cells = [], []
        for i in range(0, len(q), 1024):
            part = q[i : i + 1024]
            codes = np.stack([self.moved(part, t) for t in range(self.copies)], 2)  # queries, order, tables
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            held = np.where(known[at] == codes, count[at], 0)
            before = held.cumsum(1) - held
            rank = (codes >= 0).cumsum(1) - 1
            keep = (rank <= n_probe) | (before.max(2, keepdims=True) < k)
            if max_candidates:
                met = (held * keep).reshape(len(part), -1).cumsum(1).reshape(held.shape) - held * keep
                keep &= met < max_candidates
            keep &= held > 0
            r, level, t = np.nonzero(keep)
            rows.append(i + r)
            cells.append(codes[r, level, t])
            for short in np.flatnonzero((held * keep).sum(1).max(1) < k) if not max_candidates else ():
                own = np.flatnonzero(known >> self.bits == 0)
                own = own[np.argsort(-count[own], kind="stable")]
                more = known[own[: 1 + int(np.searchsorted(count[own].cumsum(), 2 * k))]]
                more = np.setdiff1d(more, codes[short][keep[short]])
                rows.append(np.full(len(more), i + short))
                cells.append(more)
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(rows, kind="stable")
        return rows[order], cells[order]


class Forest:
    """Trees of splits grown on a sample; a leaf is a cell, and every tree holds every row.

    kind "hyperplane": the plane between two random rows (through the origin for cosine, else their bisector); kind "kd": a sampled median
    of one of the dimensions of largest spread; kind "ball": the two sides of a far pair, with a radius.
    """

    SEARCH = ("budget",)

    def __init__(self, kind: str = "hyperplane", trees: int = 25, leaf: int = 64):
        self.kind, self.copies, self.leaf = kind, 1 if kind == "ball" else trees, leaf

    @property
    def cells(self):
        return sum(t["leaves"] for t in self.trees)

    def centre(self, cell):
        return None

    def ready(self, x):
        x = np.asarray(x, np.float64)
        return unit(x) if self.metric == "cosine" else x

    def fit(self, x, n, metric, seed=42):
        if metric == "manhattan" and self.kind != "kd":
            raise ValueError("this tree needs Euclidean or cosine distance")
        self.metric, self.n = metric, n
        y, self.trees, base = self.ready(x), [], 0
        leaf = max(2, int(self.leaf * len(y) / max(n, 1))) if n > len(y) else self.leaf
        for t in range(self.copies):
            tree = self.grow(y, np.random.default_rng(seed + t), leaf, base)
            base += tree["leaves"]
            self.trees.append(tree)
        return self

    def grow(self, y, rng, leaf, base):
        """Nodes as arrays: normal and offset of the split, two children; a child below zero is the leaf -1 - child. Balls also have centre and radius."""
        normals, offsets, children, balls = [], [], [], []
        leaves = 0
        todo = [(np.arange(len(y)), None, 0)]
        root = None
        while todo:
            own, parent, side = todo.pop()
            split = self.split(y[own], rng) if len(own) > leaf else None
            if split is None:
                number = -1 - (base + leaves)
                leaves += 1
            else:
                normal, offset = split
                left = y[own] @ normal < offset
                number = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                todo += [(own[left], number, 0), (own[~left], number, 1)]
            if self.kind == "ball":
                middle = y[own].mean(0)
                balls.append((number, middle, np.sqrt(((y[own] - middle) ** 2).sum(1).max())))
            if parent is None:
                root = number
            else:
                children[parent][side] = number
        d = y.shape[1]
        out = {"root": root, "leaves": leaves, "normals": np.array(normals).reshape(-1, d), "offsets": np.array(offsets, float), "children": np.array(children, np.int64).reshape(-1, 2)}
        if self.kind == "ball":
            out |= {"ball_node": np.array([b[0] for b in balls]), "ball_centre": np.array([b[1] for b in balls]), "ball_radius": np.array([b[2] for b in balls])}
        return out

    def split(self, x, rng):
        for _ in range(10):
            if self.kind == "kd":
                some = x[rng.choice(len(x), min(128, len(x)), replace=False)]
                spread = np.argsort(-(some.max(0) - some.min(0)), kind="stable")[:3]
                j = rng.choice(spread)
                normal = np.zeros(x.shape[1])
                normal[j], offset = 1.0, float(np.median(some[:, j]))
            else:
                a = x[rng.integers(len(x))]
                b = x[((x - a) ** 2).sum(1).argmax()] if self.kind == "ball" else x[rng.integers(len(x))]
                normal = b - a
                offset = 0.0 if self.metric == "cosine" and self.kind != "ball" else float(normal @ (a + b) / 2)
                if not np.any(normal):
                    continue
            share = (x @ normal < offset).mean()
            if (0.05 if self.kind != "ball" else 0.01) <= share <= (0.95 if self.kind != "ball" else 0.99):
                return normal, offset
        return None

    def descend(self, y, tree):
        at = np.full(len(y), tree["root"])
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = (y[inner] * tree["normals"][node]).sum(1) >= tree["offsets"][node]
            at[inner] = tree["children"][node, right.astype(int)]
        return -1 - at

    def assign(self, x):
        y = self.ready(x)
        cells = [self.descend(y, t) for t in self.trees]
        return np.tile(np.arange(len(x)), self.copies), np.concatenate(cells), np.repeat(np.arange(self.copies) == 0, len(x))

    def everywhere(self, n, budget: int | None = None) -> bool:
        return (budget or 0) >= n * self.copies

    def usual(self, k: int) -> int:
        return max(k, self.n // 20) if self.kind == "ball" else k * self.copies * 20

    def wider(self, k, n, params: dict) -> dict:
        return {"budget": min(2 * (params.get("budget") or self.usual(k)), n * self.copies)}

    def probe(self, q, k, sizes, budget: int | None = None):
        """Leaves by growing distance to the splits passed on the wrong side (balls: to the ball less its radius), until ``budget`` rows were met."""
        sizes = dict(zip(sizes[0].tolist(), sizes[1].tolist()))
        budget = budget or self.usual(k)
        rows, cells, y = [], [], self.ready(q)
        balls = [dict(zip(t["ball_node"].tolist(), zip(t["ball_centre"], t["ball_radius"]))) for t in self.trees] if self.kind == "ball" else None
        for i, x in enumerate(y):
            heap = [(0.0, t, tree["root"]) for t, tree in enumerate(self.trees)]
            heapq.heapify(heap)
            met = 0
            while heap and met < budget:
                far, t, node = heapq.heappop(heap)
                tree = self.trees[t]
                while node >= 0:
                    a, b = tree["children"][node].tolist()
                    if balls:
                        near = [max(0.0, float(np.linalg.norm(x - balls[t][c][0]) - balls[t][c][1])) for c in (a, b)]
                        side = int(near[1] < near[0] or near[0] == near[1] and x @ tree["normals"][node] >= tree["offsets"][node])
                        cost = max(far, near[1 - side])
                    else:
                        gap = float(x @ tree["normals"][node] - tree["offsets"][node])
                        side, cost = int(gap >= 0), max(far, abs(gap))
                    heapq.heappush(heap, (cost, t, (b, a)[side]))
                    node = (a, b)[side]
                if size := sizes.get(-1 - node, 0):
                    rows.append(i)
                    cells.append(-1 - node)
                    met += size
        return np.array(rows, np.int64), np.array(cells, np.int64)


ROUTERS = {"OneCell": OneCell, "Centroids": Centroids, "Spilled": Spilled, "Hashes": Hashes, "Forest": Forest}
__all__ = ["ROUTERS", "Centroids", "Forest", "Hashes", "KMeansParams", "OneCell", "Spilled", "kmeans", "orthogonal", "probe_rule", "second_cell"]
