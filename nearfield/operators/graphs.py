"""Graph indices: NN-Descent, HNSW, NSG, Vamana, relative-neighbour descent and detour-pruned graphs, built shard by shard.

Rows are dealt to shards by k-means centroids, each to its ``OVERLAP`` nearest
ones, so that neighbours share a shard; shards over twice the rows that they have on average are cut
by a hash of the id. A shard's vectors and graph are one row of the index: arrays in npz form. A query
goes to the shards of its nearest centroids and meets them in a co-group, in blocks of bounded
size; nothing of the queries or the index passes through the driver, and work doesn't grow with the number of shards.
Within a shard a block of queries walks together: one step of all beams is a few numpy calls. Graphs that need each row's nearest ones as
candidates get them from products of blocks, and lists are pruned for blocks of rows together.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import distances, matrix, merge_top, nearest, unit
from ..functions.vectors import parse_metric
from ..sources import persist
from ..sources.tables import materialise
from .cells import as_vectors, sample
from .routers import Centroids, Forest, KMeansParams
from .topk import top_k

SHARD_ROWS, OVERLAP = 20_000, 2
#: Queries that walk together, and those that meet a shard in one task: at least, at most.
QUERY_BLOCK, LEAST_MET, MOST_MET = 512, 128, 20_000
#: Distances of rows to all of a shard that are held at once while candidates are chosen.
HELD_CELLS = 8_000_000
#: Numbers of a block of rows and candidates that stay in the processor's cache.
CACHED = 262_144
_SHARD = "shard bigint, n bigint, payload binary"


# distances of rows to lists of rows


def gathered(metric: str, q: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distance of q[i] to x[at[i, j]]; places below zero are infinitely far."""
    step = max(1, CACHED // max(1, at.shape[1] * x.shape[1]))
    if len(at) > step:
        return np.concatenate([gathered(metric, q[i : i + step], x, at[i : i + step]) for i in range(0, len(at), step)])
    v = x[np.maximum(at, 0)]
    if metric == "cosine":  # both are unit vectors, or zero
        out = 1 - np.einsum("id,ijd->ij", q, v)
    elif metric == "manhattan":
        out = np.abs(v - q[:, None]).sum(2)
    else:
        out = ((v - q[:, None]) ** 2).sum(2)
    return np.where(at < 0, np.inf, out)


def beam(metric: str, q: np.ndarray, x: np.ndarray, graph: np.ndarray, seeds: np.ndarray, ef: int, width: int | None = None, expand: int = 1, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the ef nearest that a best-first walk from the seeds finds, for a block of queries together.

    expand: rows whose neighbours are looked at in a step, the nearest first; rounds: most steps.
    """
    n = len(q)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, len(x)), bool)
    seeds = np.broadcast_to(seeds, (n, seeds.shape[-1]))
    ids = np.full((n, ef), -1)
    dist = np.full((n, ef), np.inf)
    open_ = np.zeros((n, ef), bool)

    def take(new, far):
        nonlocal ids, dist, open_
        every, all_far = np.concatenate([ids, new], 1), np.concatenate([dist, far], 1)
        go = np.concatenate([open_, np.isfinite(far)], 1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :ef]
        ids, dist, open_ = every[rows, order], all_far[rows, order], go[rows, order]

    def fresh(at):
        at = np.sort(np.where(at >= 0, at, -1), axis=1)
        at[:, 1:][at[:, 1:] == at[:, :-1]] = -1
        at = np.where((at >= 0) & ~seen[rows, np.maximum(at, 0)], at, -1)
        r, c = np.nonzero(at >= 0)
        seen[r, at[r, c]] = True
        return at

    first = fresh(np.array(seeds))
    take(first, gathered(metric, q, x, first))
    step = 0
    while open_.any() and (rounds is None or step < rounds):
        step += 1
        at = np.argsort(~open_, axis=1, kind="stable")[:, :expand]  # lists are in order
        go = open_[rows, at]
        open_[rows, at] = False
        near = graph[ids[rows, at]][:, :, :width]
        new = fresh(np.where(go[:, :, None], near, -1).reshape(n, -1))
        if (new >= 0).any():
            keep = (new >= 0).any(0)
            take(new[:, keep], gathered(metric, q, x, new[:, keep]))
    return ids, dist


def reachable(graph: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which rows a walk from the seeds that drops nothing meets."""
    seen = np.zeros(len(graph), bool)
    edge = np.unique(seeds[seeds >= 0])
    while len(edge):
        seen[edge] = True
        near = graph[edge].ravel()
        edge = np.unique(near[near >= 0])
        edge = edge[~seen[edge]]
    return seen


def reaching(graph: np.ndarray, seed: int) -> np.ndarray:
    """Which rows lead to the seed."""
    seen, count = np.arange(len(graph)) == seed, 0
    while seen.sum() > count:
        count = seen.sum()
        seen |= (seen[graph] & (graph >= 0)).any(1)
    return seen


def whole_beam(metric: str, q: np.ndarray, x: np.ndarray, graph: np.ndarray, seeds: np.ndarray, ids: np.ndarray, k: int, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the k nearest that a beam as wide as the shard finds, which drops nothing: of all rows that the seeds reach. known: keeps what seeds reach."""
    firsts, which = np.unique(np.sort(np.broadcast_to(seeds, (len(q), seeds.shape[-1])), axis=1), axis=0, return_inverse=True)
    groups: dict[bytes, list[int]] = {}
    for i, first in enumerate(firsts):
        if (key := first.tobytes()) not in known:
            one = len(first) == 1
            same = next((bits for back, bits in known.get("circles", ()) if one and back[first[0]]), None)  # a row that is reached and leads back reaches the same
            if same is None:
                met = reachable(graph, first)
                same = np.packbits(met).tobytes()
                if one:
                    known.setdefault("circles", []).append((met & reaching(graph, int(first[0])), same))
            known[key] = same
        groups.setdefault(known[key], []).append(i)
    out = []
    for bits, own in groups.items():
        met = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(x)))
        rows = np.flatnonzero(np.isin(which.ravel(), own))
        r, found, far = nearest(metric, q[rows], x[met], ids[met], k)
        out.append((rows[r], found, far))
    return tuple(np.concatenate(v) for v in zip(*out))


# pieces of construction


def neighbours(metric: str, x: np.ndarray, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest others of each row, by products of blocks; by NN-Descent for Manhattan distance, which has none."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.full((n, 1), -1), np.full((n, 1), np.inf)
    if metric == "manhattan" and n > 2_000:
        return nn_descent(metric, x, k, seed=seed)[:2]
    out, far = np.empty((n, k), np.int64), np.empty((n, k))
    y = x.astype(np.float32)
    half = (y * y).sum(1) / 2
    step = max(1, min(1024, HELD_CELLS // n))
    for i in range(0, n, step):
        rows = np.arange(i, min(i + step, n))
        d = distances(metric, x[rows], x) if metric == "manhattan" else (0 if metric == "cosine" else half) - y[rows] @ y.T
        d[np.arange(len(rows)), rows] = np.inf
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        exact = gathered(metric, x[rows], x, at)
        order = np.argsort(exact, axis=1, kind="stable")
        out[rows], far[rows] = np.take_along_axis(at, order, 1), np.take_along_axis(exact, order, 1)
    return out, far


def pruned(metric: str, x: np.ndarray, cand: np.ndarray, far: np.ndarray, most: int, alpha: float = 1.0, hiders: bool = False):
    """Of each row's candidates, nearest first and padded with -1, those that no kept one is closer to (times alpha) than the row is; at most ``most``, padded.

    hiders: gives (kept or not, the place among the candidates of the one that hides a candidate, or -1) in place of the lists.
    """
    n, width = cand.shape
    out, keeps, hides = np.full((n, most), -1), np.zeros((n, width), bool), np.full((n, width), -1)
    some = cand[:, ::-1] >= 0
    sizes = np.where(some.any(1), width - some.argmax(1), 1)
    order = np.argsort(sizes, kind="stable")
    sizes, first = sizes[order], 0
    while first < n:  # blocks of lists that are about as long, since each is compared as wide as its longest
        wide = int(sizes[first] * 1.25) + 1
        last = min(first + max(1, 4 * CACHED // (wide * max(wide, x.shape[1]))), int(np.searchsorted(sizes, wide, "right")))
        rows, w = order[first:last], int(sizes[last - 1])
        first = last
        own, limit = cand[rows, :w], far[rows, :w]
        v = x[np.maximum(own, 0)].astype(np.float32)
        if metric == "manhattan":
            between = np.abs(v[:, :, None] - v[:, None]).sum(3)
        else:
            between = v @ v.transpose(0, 2, 1)
            if metric == "cosine":
                between = 1 - between
            else:
                norm = np.einsum("ijj->ij", between)
                between = norm[:, :, None] + norm[:, None] - 2 * between
        alive, count = own >= 0, np.zeros(len(own), int)
        keep, hide = np.zeros(own.shape, bool), np.full(own.shape, -1)
        for j in range(w):
            go = alive[:, j] & (count < most)
            keep[:, j] = go
            count += go
            gone = go[:, None] & alive & (alpha * between[:, j] <= limit)
            gone[:, : j + 1] = False
            if hiders:
                hide[gone] = j
            alive &= ~gone
        keeps[rows, :w], hides[rows, :w] = keep, hide
    if hiders:
        return keeps, hides
    order = np.argsort(~keeps, axis=1, kind="stable")[:, :most]
    kept = np.where(np.take_along_axis(keeps, order, 1), np.take_along_axis(cand, order, 1), -1)
    out[:, : kept.shape[1]] = kept
    return out


def both_ways(metric: str, x: np.ndarray, graph: np.ndarray, most: int, alpha: float, rng) -> np.ndarray:
    """A pruned graph with the edges back, pruned again."""
    every = np.concatenate([graph, reverse(graph, most, rng)], 1)
    return pruned(metric, x, *knn_rows(metric, x, every, every.shape[1]), most, alpha)


def padded(lists: list, width: int | None = None) -> np.ndarray:
    width = width or max((len(x) for x in lists), default=1) or 1
    out = np.full((len(lists), width), -1)
    for i, x in enumerate(lists):
        out[i, : min(len(x), width)] = x[:width]
    return out


def random_graph(n: int, k: int, rng) -> np.ndarray:
    k = min(k, n - 1)
    if k < 1:
        return np.full((n, 1), -1)
    out = rng.integers(0, n - 1, (n, k))
    return out + (out >= np.arange(n)[:, None])


def knn_rows(metric: str, x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest different places of each row's candidates."""
    at = np.sort(at, axis=1)
    at[:, 1:][at[:, 1:] == at[:, :-1]] = -1
    at[at == np.arange(len(at))[:, None]] = -1
    far = np.concatenate([gathered(metric, x[i : i + 512], x, at[i : i + 512]) for i in range(0, len(at), 512)])
    order = np.argsort(far, axis=1, kind="stable")[:, :k]
    rows = np.arange(len(at))[:, None]
    return at[rows, order], far[rows, order]


def reverse(graph: np.ndarray, most: int, rng) -> np.ndarray:
    """Up to ``most`` of the rows that point at each row, drawn by random priority."""
    n = len(graph)
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.lexsort((rng.random(len(dst)), dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst, "left")
    out = np.full((n, most), -1)
    keep = place < most
    out[dst[keep], place[keep]] = src[keep]
    return out


def forest_seeds(metric: str, x: np.ndarray, trees: int, k: int, seed: int) -> np.ndarray:
    """Each row's companions in the leaves of a small forest."""
    n, found = len(x), []
    if metric == "manhattan":
        forest = Forest("kd", trees, max(k, 16)).fit(x, n, metric, seed)
    else:
        forest = Forest("hyperplane", trees, max(k, 16)).fit(x, n, metric, seed)
    rng = np.random.default_rng(seed)
    for t in forest.trees:
        leaf = forest.descend(forest.ready(x), t)
        order = np.argsort(leaf, kind="stable")
        start = np.searchsorted(leaf[order], leaf, "left")
        size = np.searchsorted(leaf[order], leaf, "right") - start
        found.append(order[start[:, None] + rng.integers(0, 1 << 30, (n, k)) % size[:, None]])
    return np.concatenate(found, 1)


def nn_descent(metric: str, x: np.ndarray, k: int = 30, trees: int | None = None, rounds: int | None = None, delta: float = 0.001, seed: int = 42, candidates: int = 60) -> tuple[np.ndarray, np.ndarray, bool]:
    """(graph, distances, converged): rows look among the neighbours of their neighbours and of those that point at them, until hardly any list changes."""
    n, rng = len(x), np.random.default_rng(seed)
    k, most = min(k, max(n - 1, 1)), min(k, candidates)
    if n < 2:
        return np.full((n, 1), -1), np.full((n, 1), np.inf), True
    trees = trees if trees is not None else min(32, 5 + round(n**0.25))
    start = np.concatenate([forest_seeds(metric, x, trees, min(k, 16), seed), random_graph(n, k, rng)], 1)
    graph, far = knn_rows(metric, x, start, k)
    fresh = graph >= 0
    for _ in range(rounds or max(5, round(math.log2(n)))):
        pick = np.argsort(np.where(graph >= 0, rng.random(graph.shape), 2), axis=1)[:, :most]
        rows = np.arange(n)[:, None]
        forward = graph[rows, pick]
        new = np.where(fresh[rows, pick], forward, -1)
        fresh[rows, pick] = False
        both = np.concatenate([forward, reverse(forward, most, rng)], 1)
        arms = np.concatenate([new, reverse(new, most, rng)], 1)
        # what a row's neighbours know: their new neighbours for all of them, and all neighbours for new ones
        step = max(8, 2 * most // 3)
        a = both[rows, rng.integers(0, both.shape[1], (n, step))]
        b = arms[rows, rng.integers(0, arms.shape[1], (n, step))]
        col = rng.integers(0, 1 << 30, (n, step, 4))
        hop_a = np.where(a[:, :, None] >= 0, arms[np.maximum(a, 0)[:, :, None], col % arms.shape[1]], -1)
        hop_b = np.where(b[:, :, None] >= 0, both[np.maximum(b, 0)[:, :, None], col % both.shape[1]], -1)
        better, nearer = knn_rows(metric, x, np.concatenate([graph, arms, hop_a.reshape(n, -1), hop_b.reshape(n, -1)], 1), k)
        changed = ~(better[:, :, None] == graph[:, None, :]).any(2) & (better >= 0)
        kept_fresh = (better[:, :, None] == np.where(fresh, graph, -2)[:, None, :]).any(2)
        graph, far, fresh = better, nearer, changed | kept_fresh
        if changed.sum() <= delta * n * most:
            return graph, far, True
    return graph, far, False


def medoid(metric: str, x: np.ndarray) -> int:
    return int(distances("cosine" if metric == "cosine" else "euclidean", x.mean(0)[None], x)[0].argmin())


def strided(n: int) -> np.ndarray:
    m = min(n, max(64, min(512, math.isqrt(n))))
    return np.unique(np.linspace(0, n - 1, m).astype(np.int64))


def reached(lists: list[list[int]], root: int) -> np.ndarray:
    seen = np.zeros(len(lists), bool)
    seen[root], stack = True, [root]
    while stack:
        for v in lists[stack.pop()]:
            if v >= 0 and not seen[v]:
                seen[v] = True
                stack.append(v)
    return seen


def connected(metric, x, lists: list[list[int]], root: int) -> None:
    """Links every row that the root can't reach to a near one that it can; the cap on degrees doesn't hold for these edges."""
    seen = reached(lists, root)
    while not seen.all():
        lost, known = np.flatnonzero(~seen), np.flatnonzero(seen)
        node = int(lost[0])
        near = int(known[distances(metric, x[node][None], x[known])[0].argmin()])
        lists[near].append(node)
        stack = [node]
        seen[node] = True
        while stack:
            for v in lists[stack.pop()]:
                if not seen[v]:
                    seen[v] = True
                    stack.append(v)


# one builder a method: (metric, x, params, seed) -> arrays; the graph is padded with -1


def build_nndescent(metric, x, p, seed):
    k = p.get("k", 30)
    graph, far, converged = nn_descent(metric, x, k, p.get("trees"), p.get("rounds"), p.get("delta", 0.001), seed)
    if p.get("prune", 0.0) > 0:
        rng = np.random.default_rng(seed)
        graph = padded([diversified(metric, x, i, graph[i][graph[i] >= 0], far[i][graph[i] >= 0], p["prune"], rng) for i in range(len(x))], graph.shape[1])
    back = reverse(graph, min(k, 16), np.random.default_rng(seed))
    return {"graph": np.concatenate([graph, back], 1), "knn": graph, "converged": np.array(converged), "seeds": strided(len(x))}


def diversified(metric, x, node, cand, far, chance, rng) -> list[int]:
    """A list without those that a nearer kept one occludes (each dropped by chance), filled up again to its length."""
    between = distances(metric, x[cand], x[cand])
    kept, dropped = [], []
    for i in range(len(cand)):
        hidden = any(between[i, j] < far[i] for j in kept)
        (dropped if hidden and rng.random() < chance else kept).append(i)
    return cand[kept + dropped].tolist()


def as_lists(graph: np.ndarray) -> list[list[int]]:
    return [row[row >= 0].tolist() for row in graph]


def build_hnsw(metric, x, p, seed):
    """Layers of falling size; in each, a row's candidates are its nearest ones there (up to ef_construction, and three times the degree), pruned, with the edges back."""
    m, ef = p.get("m", 16), p.get("ef_construction", 200)
    n, rng = len(x), np.random.default_rng(seed)
    level = np.minimum(np.floor(-np.log(np.maximum(rng.random(n), 1e-300)) / math.log(m)).astype(int), 15)
    out = {"levels": np.array(level.max() if n else 0)}
    entry = int(level.argmax())
    for layer in range(int(out["levels"]), -1, -1):
        nodes, degree = np.flatnonzero(level >= layer), 2 * m if layer == 0 else m
        own = x[nodes]
        graph = pruned(metric, own, *neighbours(metric, own, min(ef, 3 * degree), seed), degree)
        graph = both_ways(metric, own, graph, degree, 1.0, rng)
        lists = as_lists(graph)
        connected(metric, own, lists, int(np.searchsorted(nodes, entry)))
        graph = padded(lists)
        whole = np.full((n, graph.shape[1]), -1)
        whole[nodes] = np.where(graph >= 0, nodes[np.maximum(graph, 0)], -1)
        out[f"layer{layer}"] = whole
    return out | {"graph": out.pop("layer0"), "entry": np.array(entry), "seeds": np.array([entry])}


def build_vamana(metric, x, p, seed):
    """Candidates are the nearest ``l_build`` rows and some at random, which give the long edges; two passes of pruning, the second with a wider alpha over what the first kept as well."""
    r, ef = p.get("r", 32), p.get("l_build", 75)
    root, rng = medoid(metric, x), np.random.default_rng(seed)
    cand = np.concatenate([neighbours(metric, x, ef, seed)[0], random_graph(len(x), min(r, 16), rng)], 1)
    graph = None
    for alpha in (p.get("alpha1", 1.0), p.get("alpha2", 1.2)):
        alpha = alpha**2 if metric == "euclidean" else alpha
        every = cand if graph is None else np.concatenate([cand, graph], 1)
        graph = both_ways(metric, x, pruned(metric, x, *knn_rows(metric, x, every, every.shape[1]), r, alpha), r, alpha, rng)
    lists = as_lists(graph)
    connected(metric, x, lists, root)
    return {"graph": padded(lists), "seeds": np.unique(np.r_[root, strided(len(x))[:16]])}


def build_nsg(metric, x, p, seed):
    """Candidates are the kNN lists and what a walk over them from the medoid finds (with no lists given: the nearest ``l_build`` rows), at most ``c``."""
    r, l_build, knn_k, c = p.get("r", 32), p.get("l_build", 100), p.get("knn_k", 64), p.get("c", 500)
    root, n = medoid(metric, x), len(x)
    if "knn" in p:
        graph = p["knn"]
        found = np.concatenate([beam(metric, x[i : i + 256], x, graph, np.r_[root, strided(n)], min(l_build, n), expand=4)[0] for i in range(0, n, 256)])
        cand = np.concatenate([graph, found], 1)
    else:
        cand = neighbours(metric, x, max(knn_k, l_build), seed)[0]
        graph = cand[:, :knn_k]
    near, far = knn_rows(metric, x, cand.copy(), min(c, cand.shape[1]))
    lists = as_lists(both_ways(metric, x, pruned(metric, x, near, far, r), r, 1.0, np.random.default_rng(seed)))
    for node in range(n):  # places that are left over
        for other in graph[node][graph[node] >= 0].tolist():
            if len(lists[node]) >= r:
                break
            if other not in lists[node]:
                lists[node].append(other)
    connected(metric, x, lists, root)
    return {"graph": padded(lists), "seeds": np.unique(np.r_[root, strided(n)])}


def gathered_lists(n: int, src: np.ndarray, dst: np.ndarray, most: int, metric: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest different ends of each row's edges, in order and padded."""
    keep = (src != dst) & (dst >= 0)
    pairs = np.unique(src[keep] * n + dst[keep])
    src, dst = pairs // n, pairs % n
    far = np.concatenate([gathered(metric, x[src[i : i + 65_536]], x, dst[i : i + 65_536, None])[:, 0] for i in range(0, len(src), 65_536)]) if len(src) else np.zeros(0)
    order = np.lexsort((far, src))
    src, dst, far = src[order], dst[order], far[order]
    place = np.arange(len(src)) - np.searchsorted(src, src, "left")
    own = place < most
    graph, out = np.full((n, most), -1), np.full((n, most), np.inf)
    graph[src[own], place[own]], out[src[own], place[own]] = dst[own], far[own]
    wide = max(1, int((graph >= 0).sum(1).max()))
    return graph[:, :wide], out[:, :wide]


def build_rnn(metric, x, p, seed):
    """Relative-neighbour descent: an edge that a nearer neighbour occludes moves to that neighbour; reverse edges join between the outer rounds."""
    s, r, t1, t2 = p.get("s", 20), p.get("r", 96), p.get("t1", 4), p.get("t2", 15)
    n, rng = len(x), np.random.default_rng(seed)
    start = random_graph(n, s, rng)
    src, dst = np.repeat(np.arange(n), start.shape[1]), start.ravel()
    for outer in range(t1):
        for _ in range(t2):
            graph, far = gathered_lists(n, src, dst, r, metric, x)
            keeps, hides = pruned(metric, x, graph, far, r, hiders=True)
            a, i = np.nonzero(hides >= 0)
            k, j = np.nonzero(keeps)
            src, dst = np.r_[k, graph[a, hides[a, i]]], np.r_[graph[k, j], graph[a, i]]
            if len(a) <= 0.001 * n * s:
                break
        if outer < t1 - 1:
            src, dst = np.r_[src, dst], np.r_[dst, src]
    graph = gathered_lists(n, src, dst, r, metric, x)[0]
    back = reverse(graph, s, rng)
    final = [list(dict.fromkeys([c for c in (*a.tolist(), *b.tolist()) if c >= 0])) for a, b in zip(graph, back)]
    connected(metric, x, final, 0)
    return {"graph": padded(final), "seeds": strided(n)}


def build_detour(metric, x, p, seed):
    """A kNN graph of one and a half times the degree, cut to the edges with the fewest two-hop detours; half the places are for reverse edges."""
    d = p.get("degree", 32)
    graph, far, _ = nn_descent(metric, x, min(len(x) - 1, d * 3 // 2) or 1, rounds=p.get("rounds", 15), seed=seed)
    if p.get("refine"):
        graph, far = two_hop(metric, x, graph)
    n, width = graph.shape
    detours = np.zeros(graph.shape, int)
    for i in range(width):  # rank-based: a -> graph[a, i] -> b, both hops of smaller rank than a -> b
        via = graph[graph[:, i]]
        for j in range(i + 1, width):
            detours[:, j] += (via[:, :j] == graph[:, j, None]).any(1)
    order = np.argsort(np.where(graph >= 0, detours, 1 << 30), axis=1, kind="stable")[:, :d]
    kept = graph[np.arange(n)[:, None], order]
    back = reverse(kept, max(1, d // 2), np.random.default_rng(seed))
    lists = [list(dict.fromkeys([c for c in (*a[: d // 2].tolist(), *b.tolist(), *a[d // 2 :].tolist()) if c >= 0 and c != i]))[:d] for i, (a, b) in enumerate(zip(kept, back))]
    connected(metric, x, lists, 0)
    return {"graph": padded(lists), "knn": graph, "seeds": strided(n)}


def two_hop(metric, x, graph):
    """Each list refined among its neighbours' neighbours."""
    hops = np.where(graph[:, :, None] >= 0, graph[np.maximum(graph, 0)], -1).reshape(len(x), -1)
    return knn_rows(metric, x, np.concatenate([graph, hops], 1), graph.shape[1])


BUILDERS = {"nndescent": build_nndescent, "hnsw": build_hnsw, "vamana": build_vamana, "nsg": build_nsg, "rnn_descent": build_rnn, "cagra": build_detour}
#: Beam width where none is given, for k.
DEFAULT_EF = {"nndescent": lambda k: min(max(2 * k, 50), 200), "hnsw": lambda k: 100, "vamana": lambda k: 75, "nsg": lambda k: 100, "rnn_descent": lambda k: 100, "cagra": lambda k: max(64, 2 * k)}
#: Neighbours in the kNN lists of methods that keep them, for the parameters.
KNN_WIDTH = {"nndescent": lambda p: p.get("k", 30), "cagra": lambda p: p.get("degree", 32) * 3 // 2}


def descend(metric, q, x, arrays) -> np.ndarray:
    """Entry points of a layered graph: one greedy walk a layer from the top."""
    at = np.full((len(q), 1), int(arrays["entry"]))
    for layer in range(int(arrays["levels"]), 0, -1):
        at = beam(metric, q, x, arrays[f"layer{layer}"], at, 1)[0]
    return at


#: Parameters that a method's builder takes.
BUILD = {"nndescent": "k delta prune rounds trees", "hnsw": "m ef_construction", "vamana": "r l_build alpha1 alpha2", "nsg": "r l_build c knn_k", "rnn_descent": "s r t1 t2", "cagra": "degree rounds refine"}


def dealt(vectors: DataFrame, n: int, metric: str, shard_rows: int, overlap: int, seed: int) -> tuple[DataFrame, np.ndarray | None, dict[int, int]]:
    """(id, vec, shard) of rows in all their shards, the centroids, and the salts of cells that are cut into several shards. A shard's number is its cell * 2^20 + salt."""
    if n <= shard_rows:
        return vectors.withColumn("shard", F.lit(0).cast("bigint")), None, {}
    count, kind = -(-n // shard_rows), "cosine" if metric == "cosine" else "euclidean"
    router = Centroids(count, KMeansParams(rounds=15, balance=True)).fit(sample(vectors, min(n, 250_000, max(256 * count, 2_000)), seed, n), n, kind, seed)
    element = vectors.schema["vec"].dataType.simpleString()

    def join(batches):
        for b in batches:
            if b.num_rows:
                row, cell, _ = router.assign_top(np.asarray(matrix(b.column(1)), np.float64), overlap)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(cell)], names=["id", "vec", "cell"])

    joined = materialise(vectors.mapInArrow(join, f"id bigint, vec {element}, cell bigint"))
    sizes = {r[0]: r[1] for r in joined.groupBy("cell").count().collect()}  # rows / shard_rows of them
    most = 2 * overlap * shard_rows
    salts = {c: -(-m // most) for c, m in sizes.items() if m > most}
    hot = joined.sparkSession.createDataFrame(sorted(salts.items()), "cell bigint, salts bigint")
    salt = F.pmod(F.xxhash64("id", F.lit(seed)), F.coalesce("salts", F.lit(1)))
    return joined.join(F.broadcast(hot), "cell", "left").select("id", "vec", (F.shiftleft("cell", 20) + salt).alias("shard")), router.table, salts


class GraphIndex:
    def __init__(self, kind, metric, shards, vectors, n, dim, element, params, centroids=None, salts=None):
        self.kind, self.metric, self.shards, self.vectors, self.n, self.dim, self.element, self.params = kind, metric, shards, vectors, n, dim, element, params
        self.centroids, self.salts = centroids, salts or {}
        self.distance_kind = {"euclidean": "squared_l2", "cosine": "one_minus_cosine", "manhattan": "l1"}[metric]
        self.shard_count = max(1, shards.count())

    @classmethod
    def build(cls, base: DataFrame, kind: str, metric: str = "euclidean", id_col: str = "id", vec_col: str = "vec", seed: int = 42, shard_rows: int = SHARD_ROWS, overlap: int = OVERLAP, **params) -> GraphIndex:
        metric = parse_metric(metric)
        if unknown := params.keys() - set(BUILD[kind].split()):
            raise TypeError(f"unknown parameters: {', '.join(sorted(unknown))}")
        params = {name: value for name, value in params.items() if value is not None}
        vectors = as_vectors(base, id_col, vec_col)
        element = vectors.schema["vec"].dataType.elementType.simpleString()
        n = vectors.count()
        if not n:
            raise ValueError("no vectors to index")
        dim = vectors.select(F.size("vec")).first()[0]
        build = BUILDERS[kind]

        def grow(table):
            order = np.argsort(table.column("id").to_numpy(), kind="stable")
            ids, raw = table.column("id").to_numpy()[order], np.asarray(matrix(table.column("vec"), dim), np.float64)[order]
            x = unit(raw) if metric == "cosine" else raw
            out = io.BytesIO()
            np.savez_compressed(out, ids=ids, x=raw.astype("<f8" if element == "double" else "<f4"), **build(metric, x, params, seed))
            return pa.table({"shard": table.column("shard")[:1], "n": pa.array([len(ids)], pa.int64()), "payload": pa.array([out.getvalue()], pa.binary())})

        rows, centroids, salts = dealt(vectors, n, metric, shard_rows, overlap, seed)
        return cls(kind, metric, materialise(rows.groupBy("shard").applyInArrow(grow, _SHARD)), vectors, n, dim, element, params, centroids, salts)

    def nsg(self, seed: int = 42, **params) -> GraphIndex:
        """An NSG index over the kNN lists that this index holds."""
        metric = self.metric

        def grow(batches):
            for b in batches:
                for shard, n, payload in zip(*(c.to_pylist() for c in b.columns)):
                    data = np.load(io.BytesIO(payload), allow_pickle=False)
                    raw = data["x"].astype(np.float64)
                    out = io.BytesIO()
                    np.savez_compressed(out, ids=data["ids"], x=data["x"], **build_nsg(metric, unit(raw) if metric == "cosine" else raw, params | {"knn": data["knn"]}, seed))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["shard", "n", "payload"])

        return GraphIndex("nsg", metric, materialise(self.shards.mapInArrow(grow, _SHARD)), self.vectors, self.n, self.dim, self.element, params, self.centroids, self.salts)

    def query(
        self, queries: DataFrame, k: int = 15, id_col: str = "id", vec_col: str = "vec", ef: int | None = None, return_dist: bool = True, width: int | None = None, nprobe: int | None = None,
        beam_width: int | None = None, max_beam_iters: int | None = None, n_entry_points: int | None = None, expand_per_iter: int | None = None,
    ) -> DataFrame:
        """(qid, rk, id, distance): the k nearest that beams of ``ef`` (or ``beam_width``) find in the shards of the ``nprobe`` nearest centroids.

        max_beam_iters: most steps of a walk; n_entry_points: rows that it starts from; expand_per_iter: rows whose neighbours a step looks at.
        """
        if k < 1:
            raise ValueError("k must be 1 or more")
        q = as_vectors(queries, id_col, vec_col)
        ef = max(k, ef or beam_width or DEFAULT_EF[self.kind](k))
        if ef >= self.n and nprobe is None and self.centroids is not None:  # a beam as wide as the index looks at every shard
            nprobe = len(self.centroids)
        found = self.walked(q, k, ef, width, nprobe, max_beam_iters, n_entry_points, expand_per_iter or 3)
        out = top_k(found, k, self.centroids is not None)
        return out if return_dist else out.drop("distance")

    def routed(self, q: DataFrame, nprobe: int | None) -> DataFrame:
        """(qid, vec, shard) of queries at all shards that they look at."""
        dim = self.dim
        if self.centroids is None:
            def checked(batches):
                for b in batches:
                    if b.num_rows:
                        matrix(b.column(1), dim)
                    yield b

            return q.mapInArrow(checked, q.schema).select(F.col("id").alias("qid"), "vec", F.lit(0).cast("bigint").alias("shard"))
        router, salts = Centroids(centroids=self.centroids), self.salts
        router.fit(None, 0, "cosine" if self.metric == "cosine" else "euclidean")
        probe = min(nprobe or 2 + math.isqrt(router.cells), router.cells)
        element = q.schema["vec"].dataType.simpleString()

        def route(batches):
            for b in batches:
                if b.num_rows:
                    row, cell, _ = router.assign_top(np.asarray(matrix(b.column(1), dim), np.float64), probe)
                    times = np.array([salts.get(c, 1) for c in cell.tolist()])
                    salt = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
                    row, shard = np.repeat(row, times), (np.repeat(cell, times) << 20) + salt
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(shard)], names=["qid", "vec", "shard"])

        return q.mapInArrow(route, f"qid bigint, vec {element}, shard bigint")

    def walked(self, q: DataFrame, k: int, ef: int, width: int | None, nprobe: int | None, rounds: int | None, entries: int | None, expand: int) -> DataFrame:
        """Queries and shards met by shard; a shard that very many queries look at is met in several blocks of them."""
        spark, metric = q.sparkSession, self.metric
        asked = materialise(self.routed(q, nprobe))
        looks = {r[0]: r[1] for r in asked.groupBy("shard").count().collect()}  # a number for each shard
        size = min(MOST_MET, max(LEAST_MET, sum(looks.values()) // max(1, 2 * spark.sparkContext.defaultParallelism)))
        turns = spark.createDataFrame([(s, -(-m // size)) for s, m in sorted(looks.items())], "shard bigint, turns bigint")
        left = asked.join(F.broadcast(turns), "shard").withColumn("turn", F.pmod(F.xxhash64("qid"), F.col("turns")))
        right = self.shards.join(F.broadcast(turns), "shard").select("shard", "payload", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)).alias("turn"))

        def search(a, b):
            if not a.num_rows or not b.num_rows:
                return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            data = np.load(io.BytesIO(b.column("payload")[0].as_py()), allow_pickle=False)
            arrays = {name: data[name] for name in data.files}
            qid, q, raw = a.column("qid").to_numpy(), np.asarray(matrix(a.column("vec")), np.float64), arrays["x"].astype(np.float64)
            x, y = (unit(raw), unit(q)) if metric == "cosine" else (raw, q)
            out, known = ([], [], []), {}
            for i in range(0, len(q), QUERY_BLOCK):
                own = y[i : i + QUERY_BLOCK]
                if entries:
                    start = np.unique(np.linspace(0, len(x) - 1, min(entries, len(x))).astype(np.int64))
                else:
                    start = descend(metric, own, x, arrays) if "entry" in arrays else arrays["seeds"]
                if ef >= len(x) and rounds is None and width is None:
                    r, found, far = whole_beam(metric, own, x, arrays["graph"], start, arrays["ids"], k, known)
                    for o, v in zip(out, (i + r, found, far)):
                        o.append(v)
                    continue
                at, far = beam(metric, own, x, arrays["graph"], start, min(ef, len(x)), width, expand, rounds)
                r, c = np.nonzero(np.isfinite(far))
                for o, v in zip(out, merge_top(i + r, arrays["ids"][at[r, c]], far[r, c], k)):
                    o.append(v)
            r, ids, far = (np.concatenate(v) for v in out)
            return pa.table({"qid": pa.array(qid[r], pa.int64()), "id": pa.array(ids, pa.int64()), "distance": pa.array(np.maximum(far, 0), pa.float64())})

        keys = ["shard", "turn"]
        return left.select("qid", "vec", *keys).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "qid bigint, id bigint, distance double")

    def wider(self, k: int, params: dict) -> dict:
        """Search parameters of twice the width: of the beam, and of the shards that are looked at."""
        ef = next((name for name in ("ef", "beam_width") if params.get(name)), "ef")
        out = params | {ef: min(2 * (params.get(ef) or DEFAULT_EF[self.kind](k)), self.n)}
        if self.centroids is not None:
            cells = len(self.centroids)
            out["nprobe"] = min(2 * (params.get("nprobe") or 2 + math.isqrt(cells)), cells)
        return out

    def self_knn(self, k: int = 15, **params) -> DataFrame:
        return self.query(self.vectors, k, **params)

    def graph(self) -> DataFrame:
        """The edges (src, dst, distance) of the graph that was built, shard by shard: the kNN lists where the method keeps them."""
        metric = self.metric

        def edges(batches):
            for b in batches:
                for payload in b.column(0).to_pylist():
                    data = np.load(io.BytesIO(payload), allow_pickle=False)
                    g, ids, x = data["knn"] if "knn" in data.files else data["graph"], data["ids"], data["x"].astype(np.float64)
                    x = unit(x) if metric == "cosine" else x
                    for i in range(0, len(g), 2048):
                        r, c = np.nonzero(g[i : i + 2048] >= 0)
                        at = g[i + r, c]
                        far = gathered(metric, x[i + r], x, at[:, None])[:, 0]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i + r]), pa.array(ids[at]), pa.array(far)], names=["src", "dst", "distance"])

        return self.shards.select("payload").mapInArrow(edges, "src bigint, dst bigint, distance double")

    def knn_lists(self) -> DataFrame:
        """The kNN graph (src, dst, distance) of all rows. The lists that a shard keeps know its own rows only, so with several shards every row is
        searched in those of its nearest centroids, and the k nearest of what was found and of all its shards' lists stay; pruned lists are filled up again by this."""
        if self.shard_count == 1 or self.kind not in KNN_WIDTH:
            return self.graph()
        k = KNN_WIDTH[self.kind](self.params)
        found = self.self_knn(k + 1).where("qid <> id").select(F.col("qid").alias("src"), F.col("id").alias("dst"), "distance")
        return merge_graphs(self.graph(), found, k).drop("rk")

    def converged(self) -> bool:
        """Whether NN-Descent stopped by itself in every shard."""

        def flags(batches):
            for b in batches:
                got = [bool(d["converged"]) for d in (np.load(io.BytesIO(p), allow_pickle=False) for p in b.column(0).to_pylist()) if "converged" in d.files]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.bool_())], names=["done"])

        return bool(self.shards.select("payload").mapInArrow(flags, "done boolean").agg(F.coalesce(F.min("done"), F.lit(True))).first()[0])

    def save(self, path: str) -> None:
        state = {"metric": self.metric, "n": self.n, "dim": self.dim, "params": self.params, "centroids": self.centroids, "salts": self.salts}
        persist.save(self.shards.sparkSession, path, self.kind, self.element, persist.freeze(state, {}), {"shards": self.shards, "vectors": self.vectors})

    @classmethod
    def load(cls, spark, path: str, kind: str | None = None, element: str | None = None) -> GraphIndex:
        kind, element, raw, parts = persist.load(spark, path, kind, element)
        s = persist.thaw(raw, {})
        return cls(kind, s["metric"], parts["shards"], parts["vectors"], s["n"], s["dim"], element, s["params"], s["centroids"], s["salts"])


# graphs over tables


def clustered_knn_graph(base: DataFrame, k: int = 15, metric: str = "euclidean", id_col: str = "id", vec_col: str = "vec", cells: int | None = None, overlap: int = 2, seed: int = 42, cell_rows: int = SHARD_ROWS) -> DataFrame:
    """A kNN graph (src, rk, dst, distance) of all rows: every row joins its ``overlap`` nearest balanced cells, each cell's rows find their
    neighbours among themselves, and the lists are merged by id. Cells over ``cell_rows`` are met in blocks."""
    metric = parse_metric(metric)
    vectors = as_vectors(base, id_col, vec_col)
    n = vectors.count()
    count = cells or max(1, -(-n // (cell_rows // 4)))
    router = Centroids(count, KMeansParams(balance=True))
    router.fit(sample(vectors, max(min(n, 250_000) // 10 if n > 10_000 else n, min(n, 16 * count)), seed, n), n, metric, seed)
    turns = max(1, -(-(overlap * n) // count // cell_rows))

    def join(batches):
        for b in batches:
            if b.num_rows:
                row, cell, _ = router.assign_top(np.asarray(matrix(b.column(1)), np.float64), overlap)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *(c.take(pa.array(row)) for c in b.columns)], names=["cell", "id", "vec"])

    element = vectors.schema["vec"].dataType.simpleString()
    joined = materialise(vectors.mapInArrow(join, f"cell bigint, id bigint, vec {element}"))
    # a block of queries for each turn meets a block of rows for each salt
    block = F.pmod(F.xxhash64("id"), F.lit(turns))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(turns - 1).cast("bigint")))
    left = joined.withColumn("turn", block).withColumn("salt", every)
    right = joined.withColumn("salt", block).withColumn("turn", every)

    def meet(a, b):
        ids, other = a.column("id").to_numpy(), b.column("id").to_numpy()
        row, found, far = nearest(metric, np.asarray(matrix(a.column("vec")), np.float64), np.asarray(matrix(b.column("vec")), np.float64), other, k + 1)
        keep = ids[row] != found
        return pa.table({"qid": pa.array(ids[row][keep]), "id": pa.array(found[keep]), "distance": pa.array(far[keep])})

    keys = ["cell", "salt", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "qid bigint, id bigint, distance double")
    return top_k(found, k, unique=True).select(F.col("qid").alias("src"), "rk", F.col("id").alias("dst"), "distance")


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")


def merge_graphs(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The k nearest different neighbours of each row in either graph: (src, rk, dst, distance)."""
    both = a.select("src", "dst", "distance").unionByName(b.select("src", "dst", "distance"))
    found = both.select(F.col("src").alias("qid"), F.col("dst").alias("id"), "distance")
    return top_k(found, k, unique=True).select(F.col("qid").alias("src"), "rk", F.col("id").alias("dst"), "distance")


def two_hop_edges(edges: DataFrame) -> DataFrame:
    """Pairs (src, dst) at two steps that aren't the row itself: candidates of a refinement. Lists have k rows each, so a row makes at most k^2."""
    a, b = edges.select("src", F.col("dst").alias("via")), edges.select(F.col("src").alias("via"), "dst")
    return a.join(b, "via").where("src <> dst").select("src", "dst").distinct()


def refine(edges: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """One round of a local join over tables: two-hop pairs are scored and merged into the graph."""
    from ..functions.vectors import distance

    v = as_vectors(base, id_col, vec_col)
    pairs = two_hop_edges(edges).join(v.select(F.col("id").alias("src"), F.col("vec").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("vec").alias("b")), "dst")
    return merge_graphs(edges, pairs.select("src", "dst", distance(parse_metric(metric))("a", "b").alias("distance")), k)
