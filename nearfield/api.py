"""The public functions: one build function for each engine, and query, self-query, save and load for all.

Vectors are a DataFrame with an id column and an array column. Results are
(qid, rk, id, distance); what ``distance`` means is ``index.distance_kind``.
The accelerator variants name the same logical operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions import codecs as C
from .functions.vectors import parse_metric
from .operators import routers as R
from .operators.cells import CellIndex
from .operators.graphs import GraphIndex, clustered_knn_graph
from .operators.kmeans import assign, train_centroids  # noqa: F401 - part of the API
from .operators.kmknn import KMkNN
from .operators.routers import KMeansParams
from .sources import persist


def _cells(base, kind, metric, router=None, codec=None, id_col="id", vec_col="vec", seed=42, **defaults):
    metric = parse_metric(metric)
    return CellIndex.build(base, kind, metric, router, codec(metric) if codec else None, id_col, vec_col, seed, defaults)


def build_exhaustive_index(base: DataFrame, metric: str = "euclidean", **more) -> CellIndex:
    return _cells(base, "exhaustive", metric, **more)


def build_kmknn_index(base: DataFrame, metric: str = "euclidean", nlist: int | None = None, k_means_params: KMeansParams | None = None, **more) -> KMkNN:
    return KMkNN.build(base, metric, nlist, k_means_params, **more)


def build_annoy_index(base: DataFrame, metric: str = "euclidean", n_trees: int = 25, **more) -> CellIndex:
    return _cells(base, "annoy", metric, R.Forest("hyperplane", n_trees), **more)


def build_balltree_index(base: DataFrame, metric: str = "euclidean", **more) -> CellIndex:
    return _cells(base, "ball_tree", metric, R.Forest("ball"), **more)


def build_kd_tree_index(base: DataFrame, metric: str = "euclidean", n_trees: int = 25, **more) -> CellIndex:
    return _cells(base, "kd_forest", metric, R.Forest("kd", n_trees), **more)


def build_lsh_index(base: DataFrame, metric: str = "euclidean", num_tables: int = 8, bits_per_hash: int = 12, slot_bits: int | None = None, **more) -> CellIndex:
    if parse_metric(metric) == "manhattan":
        raise ValueError("hashing needs Euclidean or cosine distance")
    return _cells(base, "lsh", metric, R.Hashes(num_tables, bits_per_hash, slot_bits), **more)


def build_ivf_index(base: DataFrame, nlist: int | None = None, metric: str = "euclidean", k_means_params: KMeansParams | None = None, **more) -> CellIndex:
    return _cells(base, "ivf", metric, R.Centroids(nlist, k_means_params), **more)


def build_soar_index(base: DataFrame, nlist: int | None = None, rule: str | None = None, weight: float | None = None, metric: str = "euclidean", k_means_params: KMeansParams | None = None, **more) -> CellIndex:
    """rule: nearest, shifted (weight mu), or orthogonal (weight lambda)."""
    return _cells(base, "soar", metric, R.Spilled(nlist, rule, weight, params=k_means_params), **more)


def build_exhaustive_bf16_index(base, metric="euclidean", **more):
    return _cells(base, "exhaustive_bf16", metric, None, C.BFloat16, **more)


def build_ivf_bf16_index(base, nlist=None, metric="euclidean", k_means_params=None, **more):
    return _cells(base, "ivf_bf16", metric, R.Centroids(nlist, k_means_params), C.BFloat16, **more)


def build_exhaustive_sq8_index(base, metric="euclidean", **more):
    return _cells(base, "exhaustive_sq8", metric, None, C.SQ8, **more)


def build_ivf_sq8_index(base, nlist=None, metric="euclidean", k_means_params=None, **more):
    return _cells(base, "ivf_sq8", metric, R.Centroids(nlist, k_means_params), C.SQ8, **more)


def build_exhaustive_pq_index(base, m=8, n_pq_centroids=256, metric="euclidean", **more):
    return _cells(base, "exhaustive_pq", metric, None, lambda d: C.PQ(d, m, n_pq_centroids, residual=False), **more)


def build_exhaustive_opq_index(base, m=8, n_pq_centroids=256, opq_iter=3, metric="euclidean", **more):
    return _cells(base, "exhaustive_opq", metric, None, lambda d: C.OPQ(d, m, n_pq_centroids, False, opq_iter), **more)


def build_ivf_pq_index(base, nlist=None, m=8, n_pq_centroids=256, metric="euclidean", k_means_params=None, **more):
    return _cells(base, "ivf_pq", metric, R.Centroids(nlist, k_means_params), lambda d: C.PQ(d, m, n_pq_centroids), **more)


def build_ivf_opq_index(base, nlist=None, m=8, n_opq_centroids=256, opq_iter=3, metric="euclidean", k_means_params=None, **more):
    return _cells(base, "ivf_opq", metric, R.Centroids(nlist, k_means_params), lambda d: C.OPQ(d, m, n_opq_centroids, True, opq_iter), **more)


def build_soar_pq_index(base, nlist=None, m=8, rule=None, weight=None, n_pq_centroids=256, metric="euclidean", k_means_params=None, **more):
    return _cells(base, "soar_pq", metric, R.Spilled(nlist, rule, weight, params=k_means_params), lambda d: C.PQ(d, m, n_pq_centroids), **more)


def build_soar_opq_index(base, nlist=None, m=8, rule=None, weight=None, n_opq_centroids=256, opq_iter=3, metric="euclidean", k_means_params=None, **more):
    return _cells(base, "soar_opq", metric, R.Spilled(nlist, rule, weight, params=k_means_params), lambda d: C.OPQ(d, m, n_opq_centroids, True, opq_iter), **more)


def build_exhaustive_index_binary(base, n_bits=256, binary_init="random", metric="cosine", asymmetric=False, **more):
    return _cells(base, "exhaustive_binary", metric, None, lambda d: C.Binary(d, n_bits, binary_init, asymmetric), **more)


def build_ivf_index_binary(base, n_bits=256, nlist=None, binary_init="random", metric="euclidean", asymmetric=False, residual=False, k_means_params=None, **more):
    """residual: rows, and queries anew for each cell that is looked at, are coded less its centroid (binary_init "sign" only)."""
    if parse_metric(metric) == "manhattan":
        raise ValueError("no Manhattan distance over compressed vectors")
    return _cells(base, "ivf_binary", metric, R.Centroids(nlist, k_means_params), lambda d: C.Binary(d, n_bits, binary_init, asymmetric, residual), **more)


def build_exhaustive_index_rabitq(base, n_clust=None, metric="euclidean", **more):
    """Clustered in half as many cells as an inverted file has; a fifth of them is looked at, and more where these hold fewer than k rows."""
    n = n_clust or max(1, -(-int(base.count() ** 0.5) // 2))
    return _cells(base, "exhaustive_rabitq", metric, R.Centroids(n), C.RaBitQ, nprobe=max(1, -(-n // 5)), **more)


def build_ivf_index_rabitq(base, nlist=None, metric="euclidean", **more):
    return _cells(base, "ivf_rabitq", metric, R.Centroids(nlist), C.RaBitQ, **more)


def build_exhaustive_index_turboquant(base, bits=4, metric="euclidean", **more):
    return _cells(base, "exhaustive_tq", metric, None, lambda d: C.TurboQuant(d, bits), **more)


def build_ivf_index_turboquant(base, nlist=None, bits=4, metric="euclidean", **more):
    return _cells(base, "ivf_tq", metric, R.Centroids(nlist), lambda d: C.TurboQuant(d, bits), **more)


def build_hnsw_index(base, m=16, ef_construction=200, metric="euclidean", **more) -> GraphIndex:
    return GraphIndex.build(base, "hnsw", metric, m=m, ef_construction=ef_construction, **more)


def build_nndescent_index(base, metric="euclidean", delta=0.001, diversify_prob=0.0, k=30, max_iter=None, n_tree=None, **more) -> GraphIndex:
    return GraphIndex.build(base, "nndescent", metric, k=k, delta=delta, prune=diversify_prob, rounds=max_iter, trees=n_tree, **more)


def build_vamana_index(base, r=32, l_build=75, alpha_pass1=1.0, alpha_pass2=1.2, metric="euclidean", **more) -> GraphIndex:
    return GraphIndex.build(base, "vamana", metric, r=r, l_build=l_build, alpha1=alpha_pass1, alpha2=alpha_pass2, **more)


def build_nsg_index(base, r=32, l_build=100, c=500, knn_k=64, metric="euclidean", **more) -> GraphIndex:
    return GraphIndex.build(base, "nsg", metric, r=r, l_build=l_build, c=c, knn_k=knn_k, **more)


def build_nsg_from_knn_index(knn: GraphIndex, r=32, l_build=100, c=500, seed=42) -> GraphIndex:
    return knn.nsg(seed, r=r, l_build=l_build, c=c)


def build_rnn_descent_index(base, s=20, r=96, t1=4, t2=15, metric="euclidean", **more) -> GraphIndex:
    return GraphIndex.build(base, "rnn_descent", metric, s=s, r=r, t1=t1, t2=t2, **more)


def build_nndescent_index_gpu(base, metric="euclidean", k=32, max_iters=15, refine_knn=0, **more) -> GraphIndex:
    if parse_metric(metric) == "manhattan":
        raise ValueError("this graph needs Euclidean or cosine distance")
    return GraphIndex.build(base, "cagra", metric, degree=k, rounds=max_iters, refine=refine_knn, **more)


def build_knn_graph(base, metric="euclidean", k=15, **more) -> DataFrame:
    """A kNN graph (src, rk, dst, distance) over the whole table, without an index to search."""
    return clustered_knn_graph(base, k, metric, **more)


build_exhaustive_index_gpu, build_ivf_index_gpu = build_exhaustive_index, build_ivf_index
build_knn_graph_gpu = build_clustered_knn_graph_gpu = build_clustered_knn_graph = build_knn_graph
build_nsg_from_gpu_knn = build_nsg_from_knn_index


def extract_nndescent_knn(index: GraphIndex, return_dist: bool = True) -> DataFrame:
    """The kNN graph (src, dst, distance) of all indexed rows, across shards."""
    graph = index.knn_lists()
    return graph if return_dist else graph.drop("distance")


extract_nndescent_knn_gpu = extract_nndescent_knn


def query(index, queries: DataFrame, k: int = 15, **params) -> DataFrame:
    return index.query(queries, k, **params)


def query_self(index, k: int = 15, **params) -> DataFrame:
    return index.self_knn(k, **params)


def save_index(index, path: str) -> None:
    index.save(path)


def save_store(index: CellIndex, path: str) -> None:
    """The vectors that an index re-ranks by, at a place of their own; ``index.with_store(path)`` reads them from there."""
    index.save_store(path)


def load_index(spark: SparkSession, path: str, kind: str | None = None, element: str | None = None):
    """The index saved at a path; raises a subclass of ``persist.IndexFormatError`` that says what is wrong with it."""
    found = persist.load(spark, path, kind, element)[0]
    cls = GraphIndex if found in ("hnsw", "nndescent", "vamana", "nsg", "rnn_descent", "cagra") else KMkNN if found == "kmknn" else CellIndex
    return cls.load(spark, path, found, element)


#: The engines' names; each has query_<name> or query_<name>_index, and a self form.
ENGINES = (
    "exhaustive kmknn annoy balltree kd_tree lsh ivf soar hnsw nndescent vamana nsg rnn_descent exhaustive_bf16 exhaustive_sq8 exhaustive_pq exhaustive_opq ivf_bf16 ivf_sq8 ivf_pq ivf_opq soar_pq soar_opq exhaustive_index_gpu ivf_index_gpu nndescent_index_gpu"
    " exhaustive_index_binary ivf_index_binary exhaustive_index_rabitq ivf_index_rabitq exhaustive_index_turboquant ivf_index_turboquant"
).split()
for _name in ENGINES:
    _query = f"query_{_name}" if "_index" in _name else f"query_{_name}_index"
    globals()[_query] = query
    globals()[f"{_query}_self"] = globals()[f"query_{_name}_self"] = query_self
