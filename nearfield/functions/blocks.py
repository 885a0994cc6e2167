"""Distances and top-k of blocks of vectors in numpy, and Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Distances that a block holds at once.
BLOCK_CELLS = 1_000_000


def matrix(column, dim: int | None = None) -> np.ndarray:
    """An Arrow column of equally long lists, or of equally long binaries, as rows of a matrix. Null rows or elements, NaN, and rows of other lengths raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, dim or 0), np.uint8 if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else np.float64)
    if column.null_count:
        raise ValueError("a vector is null")
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        raw = b"".join(column.to_pylist())
        return np.frombuffer(raw, np.uint8).reshape(n, -1)
    values, ends = column.flatten(), column.offsets.to_numpy()
    size = np.diff(ends)
    if (size != size[0]).any() or dim is not None and size[0] != dim:
        raise ValueError(f"vectors differ in length: {sorted(set(size.tolist()))[:5]}" + (f" where {dim} is wanted" if dim is not None else ""))
    if values.null_count:
        raise ValueError("a vector has a null element")
    out = values.to_numpy(zero_copy_only=False).reshape(n, -1)
    if out.dtype.kind == "f" and np.isnan(out).any():
        raise ValueError("a vector has a NaN element")
    return out


def lists(rows: np.ndarray, kind=None) -> pa.ListArray:
    """Rows of a matrix as an Arrow column of lists."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(rows.ravel(), kind))


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column of binaries."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows, np.uint8).tobytes())])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; zero rows stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def distances(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All distances of two blocks: squared Euclidean, 1 - cosine (1 for a zero norm), or Manhattan."""
    q, v = np.asarray(q, np.float64), np.asarray(v, np.float64)
    if metric == "manhattan":
        out = np.empty((len(q), len(v)))
        step = max(1, BLOCK_CELLS // max(1, v.size))
        for i in range(0, len(q), step):
            out[i : i + step] = np.abs(q[i : i + step, None] - v[None]).sum(2)
        return out
    if metric == "cosine":
        return 1 - unit(q) @ unit(v).T
    return np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * q @ v.T, 0)


def pairs(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows standing side by side, without the cancellation that products of blocks have."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    if metric == "manhattan":
        return np.abs(a - b).sum(1)
    if metric == "cosine":
        norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
        return np.where(norms > 0, 1 - (a * b).sum(1) / np.where(norms > 0, norms, 1), 1.0)
    diff = a - b
    return np.einsum("ij,ij->i", diff, diff)


#: Pairs whose distances are taken again together, so that their rows stay in the processor's cache.
PAIRS = 4_096


def near(dist: np.ndarray, ids: np.ndarray, k: int, exact=None, bound: np.ndarray | None = None, room: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, distance, what a row's k-th distance in the block doesn't exceed) of all that may be among the k nearest of each row, rows in order.

    exact(rows, cols) gives the distances again where those of the block are rounded by up to ``room``; infinite ones are left out.
    bound: what a row's k-th distance is already known not to exceed; where all rows have one, nothing has to be selected.
    """
    n, m = dist.shape
    if bound is not None and np.isfinite(bound).all():
        last = bound
    else:
        last = np.partition(dist, min(k, m) - 1, axis=1)[:, min(k, m) - 1].astype(np.float64)
        last = last if bound is None or m < k else np.minimum(last, bound)
    slack = 1e-7 * np.maximum(1, np.abs(np.where(np.isfinite(last), last, 0)))
    slack = slack if room is None else slack + room
    rows, cols = np.divmod(np.flatnonzero(dist <= (last + slack)[:, None].astype(dist.dtype)), m)
    if exact and len(rows):
        value = np.concatenate([exact(rows[i : i + PAIRS], cols[i : i + PAIRS]) for i in range(0, len(rows), PAIRS)]).astype(np.float64)
    else:
        value = dist[rows, cols].astype(np.float64)
    some = np.isfinite(value) & np.isfinite(dist[rows, cols])
    if not some.all():
        rows, cols, value = rows[some], cols[some], value[some]
    return rows, ids[cols], value, last + slack if m >= k else np.full(n, np.inf)


def top(dist: np.ndarray, ids: np.ndarray, k: int, exact=None, bound: np.ndarray | None = None, room: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, distance) of the k nearest of each row, by distance and then id; ties at the k-th place are all looked at."""
    if not dist.size:
        return np.zeros(0, np.int64), ids[:0], np.zeros(0)
    rows, found, value, _ = near(dist, ids, k, exact, bound, room)
    order = np.lexsort((found, value, rows))
    rows, found, value = rows[order], found[order], value[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[keep], found[keep], value[keep]


def nearest(metric: str, q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int):
    """(row, id, distance) of the k nearest of v for each row of q, block by block."""
    out, step = [], max(1, BLOCK_CELLS // max(1, len(v)))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        rows, found, value = top(distances(metric, part, v), ids, k, lambda r, c, part=part: pairs(metric, part[r], v[c]))
        out.append((rows + i, found, value))
    if not out:
        return np.zeros(0, np.int64), ids[:0], np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def merge_top(qid: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int, unique: bool = False):
    """The k nearest of each query among found ones; unique: an id counts once for a query."""
    if unique and len(qid):
        order = np.lexsort((value, ids, qid))
        qid, ids, value = qid[order], ids[order], value[order]
        new = np.r_[True, (qid[1:] != qid[:-1]) | (ids[1:] != ids[:-1])]
        qid, ids, value = qid[new], ids[new], value[new]
    order = np.lexsort((ids, value, qid))
    qid, ids, value = qid[order], ids[order], value[order]
    keep = np.arange(len(qid)) - np.searchsorted(qid, qid, "left") < k
    return qid[keep], ids[keep], value[keep]
