"""Codes of vectors: each codec turns rows into fixed-width bytes and scores blocks of queries against codes.

A codec is fitted once on a bounded sample (SQ8 on maxima of all rows), is small, and
travels to the executors with the plan. ``score`` returns one row per query; a
smaller score is nearer. ``distance_kind`` says what a score is.
"""

from __future__ import annotations

import numpy as np

from .blocks import distances, pairs, unit


def orthogonal(d: int, seed: int) -> np.ndarray:
    """A random rotation: QR of a Gaussian matrix, signs fixed by the diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def lloyd(x: np.ndarray, k: int, rounds: int = 25, seed: int = 42) -> np.ndarray:
    """k-means centroids of a sample by Lloyd's rounds; an empty cell takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        dist = distances("euclidean", x, c)
        own = dist.argmin(1)
        count = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            new[empty] = x[np.argsort(-dist.min(1), kind="stable")[: len(empty)]]
        if np.allclose(new, c):
            break
        c = new
    return c


def products(metric: str, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(block, offsets, room): distances less an offset for each query from one product in 32 bits, and how far rounding may take them."""
    error = 4 * (v.shape[1] + 8) * 6e-8
    if metric == "cosine":
        return -unit(np.asarray(q, np.float64)).astype(np.float32) @ unit(v).T.astype(np.float32), np.ones(len(q)), error
    norms, own = (v * v).sum(1), (np.asarray(q, np.float64) ** 2).sum(1)
    wide = np.concatenate([-2 * np.asarray(q, np.float32), np.ones((len(q), 1), np.float32)], 1)
    return wide @ np.concatenate([v, norms[:, None]], 1).T, own, error * float(own.max() + norms.max())


class Raw:
    """The vectors themselves, in 32 or 64 bits."""

    residual = False

    def __init__(self, metric: str, dtype: str = "<f4"):
        self.metric, self.dtype = metric, dtype
        self.distance_kind = {"euclidean": "squared_l2", "cosine": "one_minus_cosine", "manhattan": "l1"}[metric]

    def fit(self, x, seed=42):
        return self

    def encode(self, x, centre=None):
        return np.ascontiguousarray(x, self.dtype).view(np.uint8).reshape(len(x), -1)

    def decode(self, codes, centre=None):
        return np.ascontiguousarray(codes).view(self.dtype).reshape(len(codes), -1)

    def score(self, q, codes, centre=None):
        """Distances of a block, in 32-bit products where rows have 32 bits; ``room`` bounds their error and ``exact`` mends it."""
        v = self.decode(codes)
        if self.dtype != "<f4" or self.metric == "manhattan":
            return distances(self.metric, q, v)
        q = np.asarray(q, np.float32)
        if self.metric == "cosine":
            out = unit(q) @ unit(v).T
            return np.subtract(1, out, out=out)
        out = q @ v.T
        out *= -2
        out += (v * v).sum(1)
        out += (q * q).sum(1)[:, None]
        return out

    def partial(self, q, codes, centre=None):
        """``products`` of 32-bit rows; None for room where distances are in doubles."""
        v = self.decode(codes)
        if self.dtype != "<f4" or self.metric == "manhattan":
            return distances(self.metric, q, v), np.zeros(len(q)), None
        return products(self.metric, q, v)

    def exact(self, q, codes, centre=None):
        return pairs(self.metric, q, self.decode(codes))


class BFloat16:
    """Floats cut to 16 bits, rounded to nearest even; scores in 32-bit floats of the decoded rows."""

    residual = False

    def __init__(self, metric: str):
        if metric == "manhattan":
            raise ValueError("no Manhattan distance over compressed vectors")
        self.metric = metric
        self.distance_kind = {"euclidean": "squared_l2", "cosine": "one_minus_cosine"}[metric]

    def fit(self, x, seed=42):
        return self

    @staticmethod
    def round(x) -> np.ndarray:
        bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
        up = (bits + (0x7FFF + ((bits >> 16) & 1)).astype(np.uint32)) >> 16
        return np.where(np.isnan(x), (bits >> 16) | 0x40, up).astype("<u2")

    def encode(self, x, centre=None):
        return self.round(x).view(np.uint8).reshape(len(x), -1)

    def decode(self, codes, centre=None):
        return (np.ascontiguousarray(codes).view("<u2").astype(np.uint32) << 16).view(np.float32).reshape(len(codes), -1)

    def score(self, q, codes, centre=None):
        return distances(self.metric, q, self.decode(codes)).astype(np.float32)

    def partial(self, q, codes, centre=None):
        return products(self.metric, q, self.decode(codes))

    def exact(self, q, codes, centre=None):
        return pairs(self.metric, q, self.decode(codes)).astype(np.float32)


class SQ8:
    """Signed bytes with a symmetric scale for each dimension, max(abs) / 128; distances are those of the whole-number codes."""

    residual = False

    def __init__(self, metric: str):
        if metric == "manhattan":
            raise ValueError("no Manhattan distance over compressed vectors")
        self.metric, self.scale = metric, None
        self.distance_kind = {"euclidean": "squared_l2_of_codes", "cosine": "one_minus_cosine_of_codes"}[metric]

    def fit(self, x, seed=42):
        return self.fit_maxima(np.abs(self.ready(x)).max(0))

    def fit_maxima(self, most):
        self.scale = np.where(np.asarray(most) > 0, np.asarray(most, np.float64) / 128, 1.0)
        return self

    def ready(self, x):
        x = np.asarray(x, np.float64)
        return unit(x) if self.metric == "cosine" else x

    def whole(self, x) -> np.ndarray:
        """Codes, halves rounded away from zero."""
        y = self.ready(x) / self.scale
        return np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -128, 127).astype(np.int8)

    def encode(self, x, centre=None):
        return self.whole(x).view(np.uint8)

    def decode(self, codes, centre=None):
        return codes.view(np.int8) * self.scale

    def score(self, q, codes, centre=None):
        return distances(self.metric, self.whole(q), codes.view(np.int8))

    def partial(self, q, codes, centre=None):
        """Whole numbers below 2^24 are exact in 32 bits, so squared distances of up to 340 dimensions have no error."""
        whole, v = self.whole(q).astype(np.float32), codes.view(np.int8).astype(np.float32)
        out, own, room = products(self.metric, whole, v)
        return out, own, (0.0 if self.metric == "euclidean" and v.shape[1] <= 340 else room)

    def exact(self, q, codes, centre=None):
        return pairs(self.metric, self.whole(q), codes.view(np.int8))


class PQ:
    """Product quantisation: m sub-spaces of up to 256 centroids; scores are sums of table look-ups (squared L2, of unit vectors for cosine).

    residual: what is coded is the row less its cell's centroid.
    """

    LEAST_DIM = 32

    def __init__(self, metric: str, m: int = 8, centroids: int = 256, residual: bool = True, rotations: int = 0):
        if metric == "manhattan":
            raise ValueError("no Manhattan distance over compressed vectors")
        self.metric, self.m, self.k, self.residual, self.rotations = metric, m, centroids, residual, rotations
        self.books = self.turn = None
        self.distance_kind = "adc_squared_l2"

    def ready(self, x):
        x = np.asarray(x, np.float64)
        return unit(x) if self.metric == "cosine" else x

    def fit(self, x, seed=42):
        """x: rows ready to be coded (residuals, if these are coded). With rotations, a rotation is learned in turns with the books: each turn solves the orthogonal Procrustes problem for the rows and their reconstructions."""
        n, d = x.shape
        if d < self.LEAST_DIM or d % self.m or n < self.k:
            raise ValueError(f"product quantisation needs {self.LEAST_DIM} dimensions or more, a multiple of m = {self.m}, and {self.k} rows or more; there are {d} and {n}")
        self.turn = orthogonal(d, seed) if self.rotations else None
        for _ in range(self.rotations):
            y = x[:50_000] @ self.turn
            self.books = self.train(y, seed)
            u, _, vt = np.linalg.svd(x[:50_000].T @ self.rebuilt(self.codes(y)))
            self.turn = u @ vt
        self.books = self.train(x if self.turn is None else x @ self.turn, seed)
        return self

    def train(self, y, seed):
        return [lloyd(part, self.k, seed=seed + j) for j, part in enumerate(np.split(y, self.m, axis=1))]

    def codes(self, y):
        return np.stack([distances("euclidean", part, book).argmin(1) for part, book in zip(np.split(y, self.m, axis=1), self.books)], 1).astype(np.uint8)

    def rebuilt(self, codes):
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)

    def turned(self, x, centre):
        y = self.ready(x)
        if self.residual and centre is not None:
            y = y - centre
        return y if self.turn is None else y @ self.turn

    def encode(self, x, centre=None):
        return self.codes(self.turned(x, centre))

    def decode(self, codes, centre=None):
        y = self.rebuilt(codes)
        y = y if self.turn is None else y @ self.turn.T
        return y + centre if self.residual and centre is not None else y

    def score(self, q, codes, centre=None):
        y = self.turned(q, centre)
        out = np.zeros((len(q), len(codes)))
        for j, (part, book) in enumerate(zip(np.split(y, self.m, axis=1), self.books)):
            out += np.take(distances("euclidean", part, book), codes[:, j], axis=1)
        return out

    def partial(self, q, codes, centre=None):
        """A sum of look-ups is the distance to the row that the codes rebuild, so one product gives a block of them."""
        return products("euclidean", self.turned(q, centre), self.rebuilt(codes).astype(np.float32))

    def exact(self, q, codes, centre=None):
        return pairs("euclidean", self.turned(q, centre), self.rebuilt(codes))


def OPQ(metric: str, m: int = 8, centroids: int = 256, residual: bool = True, rotations: int = 3) -> PQ:
    """Product quantisation after a learned rotation."""
    return PQ(metric, m, centroids, residual, rotations)


def parse_binariser(name: str) -> str:
    found = {"pca": "pca", "pca_hashing": "pca", "random": "random", "random_projections": "random", "sign": "sign", "sign_based": "sign"}.get(name.lower())
    if not found:
        raise ValueError(f"unknown binariser {name!r}")
    return found


class Binary:
    """Sign bits: of centred random projections, of principal components (padded with random directions), or of the coordinates.

    score: Hamming distance; with ``asymmetric`` the negated dot product of the query with codes of -1 and 1.
    residual (coordinates only): rows and queries are coded less the centroid of the cell that is looked at, for cosine as unit vectors.
    """

    def __init__(self, metric: str, bits: int = 256, init: str = "random", asymmetric: bool = False, residual: bool = False):
        if residual and parse_binariser(init) != "sign":
            raise ValueError("projections have a frame of their own: residuals are coded by sign only")
        self.residual = residual
        self.metric, self.bits, self.init, self.asymmetric = metric, bits, parse_binariser(init), asymmetric
        self.mean = self.axes = None
        self.distance_kind = "negative_asymmetric_dot" if asymmetric else "hamming"

    def ready(self, x):
        x = np.asarray(x, np.float64)
        return unit(x) if self.metric == "cosine" else x

    def fit(self, x, seed=42):
        x = self.ready(x)
        d = x.shape[1]
        self.mean = x.mean(0)
        if self.init == "sign":
            self.bits, self.axes = d, None
            self.mean = np.zeros(d)
            return self
        rng = np.random.default_rng(seed)
        axes = np.zeros((d, 0))
        if self.init == "pca":
            axes = np.linalg.svd(x - self.mean, full_matrices=False)[2].T[:, : self.bits]
        while axes.shape[1] < self.bits:
            axes = np.c_[axes, np.linalg.qr(rng.standard_normal((d, d)))[0]]
        self.axes = axes[:, : self.bits]
        return self

    def project(self, x, centre=None):
        y = self.ready(x) - (self.mean if centre is None else centre)
        return y if self.axes is None else y @ self.axes

    def encode(self, x, centre=None):
        return np.packbits(self.project(x, centre) >= 0, axis=1)

    def score(self, q, codes, centre=None):
        if self.asymmetric:
            return -(self.project(q, centre) @ (2.0 * np.unpackbits(codes, axis=1)[:, : self.bits] - 1).T)
        return hamming_block(self.encode(q, centre), codes)


def hamming_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs of two blocks of byte rows, eight bytes at a time."""
    a, b = (np.ascontiguousarray(np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))).view(np.uint64) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.float32)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return out


class RaBitQ:
    """One bit a dimension of the rotated unit residual, with the distance to the centroid and a correction.

    The estimate takes the query's residual quantised to 4 bits; the score is an estimated, unsquared L2 distance (of unit vectors for cosine).
    """

    residual = True

    def __init__(self, metric: str):
        if metric == "manhattan":
            raise ValueError("no Manhattan distance over compressed vectors")
        self.metric, self.turn = metric, None
        self.distance_kind = "estimated_l2"

    def ready(self, x):
        x = np.asarray(x, np.float64)
        return unit(x) if self.metric == "cosine" else x

    def fit(self, x, seed=42):
        self.turn = orthogonal(x.shape[1], seed)
        return self

    def encode(self, x, centre=None):
        r = self.ready(x) - (0 if centre is None else centre)
        far = np.linalg.norm(r, axis=1)
        o = (r / np.where(far > 0, far, 1)[:, None]) @ self.turn
        fits = np.abs(o).sum(1) / np.sqrt(o.shape[1])
        side = np.stack([far, np.where(fits > 0, fits, 1)], 1).astype("<f4")
        return np.concatenate([np.packbits(o >= 0, axis=1), side.view(np.uint8).reshape(len(x), -1)], 1)

    def score(self, q, codes, centre=None):
        d = len(self.turn)
        side = np.ascontiguousarray(codes[:, -8:]).view("<f4").astype(np.float64)
        signs = (2.0 * np.unpackbits(codes[:, :-8], axis=1)[:, :d] - 1) / np.sqrt(d)
        r = self.ready(q) - (0 if centre is None else centre)
        far = np.linalg.norm(r, axis=1)
        y = (r / np.where(far > 0, far, 1)[:, None]) @ self.turn
        low = y.min(1, keepdims=True)
        step = np.maximum(y.max(1, keepdims=True) - low, 1e-12) / 15
        y = np.floor((y - low) / step + 0.5) * step + low
        cosine = np.clip((y @ signs.T) / side[:, 1], -1, 1)
        return np.sqrt(np.maximum(far[:, None] ** 2 + side[:, 0] ** 2 - 2 * far[:, None] * side[:, 0] * cosine, 0))


def max_lloyd_levels(d: int, bits: int, rounds: int = 200) -> np.ndarray:
    """Levels of the best scalar quantiser for a coordinate of a random unit vector in d dimensions, whose density is (1 - t^2)^((d - 3) / 2), by Lloyd-Max rounds on a fine grid."""
    width = min(1.0, 6 / np.sqrt(d))
    t = np.linspace(-width, width, 20_001)
    p = (1 - np.minimum(t * t, 1 - 1e-12)) ** ((d - 3) / 2)
    p /= p.sum()
    levels = np.quantile(np.repeat(t, np.maximum(1, (p * 200_000).astype(int))), (np.arange(2**bits) + 0.5) / 2**bits)
    for _ in range(rounds):
        cell = np.searchsorted((levels[1:] + levels[:-1]) / 2, t)
        weight = np.bincount(cell, p, len(levels))
        new = np.where(weight > 0, np.bincount(cell, p * t, len(levels)) / np.maximum(weight, 1e-300), levels)
        if np.abs(new - levels).max() < 1e-9:
            break
        levels = new
    return (levels - levels[::-1]) / 2


class TurboQuant:
    """2 to 4 bits a dimension of the rotated unit vector by a fixed scalar codebook, with the norm and a correction of the inner product.

    score: estimated squared L2, or 1 - estimated cosine.
    """

    residual = False

    def __init__(self, metric: str, bits: int = 4):
        if metric == "manhattan":
            raise ValueError("no Manhattan distance over compressed vectors")
        if bits not in (2, 3, 4):
            raise ValueError("2, 3 or 4 bits")
        self.metric, self.bits, self.turn = metric, bits, None
        self.distance_kind = {"euclidean": "estimated_squared_l2", "cosine": "estimated_one_minus_cosine"}[metric]

    def fit(self, x, seed=42):
        d = x.shape[1]
        if d % 8:
            raise ValueError("the dimension must be a multiple of 8")
        self.turn, self.levels = orthogonal(d, seed), max_lloyd_levels(d, self.bits)
        return self

    def encode(self, x, centre=None):
        x = np.asarray(x, np.float64)
        norm = np.linalg.norm(x, axis=1)
        u = unit(x) @ self.turn
        code = np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, u).astype(np.uint8)
        inner = (u * self.levels[code]).sum(1)
        side = np.stack([norm, 1 / np.where(inner > 0, inner, 1)], 1).astype("<f4")
        planes = [np.packbits(code >> b & 1, axis=1) for b in range(self.bits)]
        return np.concatenate([*planes, side.view(np.uint8).reshape(len(x), -1)], 1)

    def unpacked(self, codes) -> tuple[np.ndarray, np.ndarray]:
        """The level of each coordinate, and the norm and correction of each row."""
        w = len(self.turn) // 8
        code = sum(np.unpackbits(codes[:, b * w : (b + 1) * w], axis=1).astype(np.int64) << b for b in range(self.bits))
        return code, np.ascontiguousarray(codes[:, -8:]).view("<f4").astype(np.float64)

    def decode(self, codes, centre=None):
        """Rows rebuilt: the levels turned back, with their correction, times the norm."""
        code, side = self.unpacked(codes)
        return (self.levels[code] @ self.turn.T) * (side[:, 1] * side[:, 0])[:, None]

    def score(self, q, codes, centre=None):
        q = np.asarray(q, np.float64)
        code, side = self.unpacked(codes)
        cosine = (unit(q) @ self.turn) @ self.levels[code].T * side[:, 1]
        if self.metric == "cosine":
            zero = (np.linalg.norm(q, axis=1) == 0)[:, None] | (side[:, 0] == 0)
            return np.where(zero, 1.0, 1 - cosine)
        norm = np.linalg.norm(q, axis=1)[:, None]
        return np.maximum(norm**2 + side[:, 0] ** 2 - 2 * norm * side[:, 0] * cosine, 0)


CODECS = {"raw": Raw, "bf16": BFloat16, "sq8": SQ8, "pq": PQ, "opq": OPQ, "binary": Binary, "rabitq": RaBitQ, "turboquant": TurboQuant}
