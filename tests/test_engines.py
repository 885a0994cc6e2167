"""Every engine: finds rows themselves, keeps order, clamps k, is exact where it looks at everything, and survives saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import api
from nearfield.operators import evaluate, graphs
from nearfield.operators import routers as R
from nearfield.sources import persist
from nearfield.sources.synthetic import FAMILIES, noised_queries, vectors
from nearfield.sources.tables import materialise, shared_dir

N, D, K = 400, 32, 8


@pytest.fixture(scope="module")
def base(spark):
    return materialise(vectors(spark, "gaussian", N, D, 8).select("id", "vec"))


@pytest.fixture(scope="module")
def truth(base):
    x = np.array([r.vec for r in base.orderBy("id").collect()], float)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    return np.argsort(d, axis=1, kind="stable")[:, :K]


def recalled(found, truth, k=K):
    p = found.toPandas()
    assert not p.duplicated(["qid", "id"]).any()
    assert (p.sort_values(["qid", "rk"]).groupby("qid").distance.diff().dropna() >= -1e-9).all()
    return np.mean([i in truth[q, :k] for q, i in zip(p.qid, p.id)]) * len(p) / (N * k)


EXACT = {
    "exhaustive": (api.build_exhaustive_index, {}, {}),
    "exhaustive_cogroup": (api.build_exhaustive_index, {}, {"plan": "cogroup"}),
    "kmknn": (api.build_kmknn_index, {}, {}),
    "ivf": (api.build_ivf_index, {"nlist": 9}, {"nprobe": 9}),
    "ivf_cogroup": (api.build_ivf_index, {"nlist": 9}, {"nprobe": 9, "plan": "cogroup"}),
    "soar": (api.build_soar_index, {"nlist": 9}, {"nprobe": 9}),
    "annoy": (api.build_annoy_index, {"n_trees": 3}, {"budget": 10**9}),
    "kd_tree": (api.build_kd_tree_index, {"n_trees": 3}, {"budget": 10**9}),
    "balltree": (api.build_balltree_index, {}, {"budget": 10**9}),
    "lsh": (api.build_lsh_index, {"num_tables": 1, "bits_per_hash": 2, "slot_bits": 1}, {"n_probe": 3}),
}


@pytest.mark.parametrize("name", EXACT)
def test_exact_where_everything_is_looked_at(base, truth, name):
    build, params, how = EXACT[name]
    assert recalled(build(base, **params).self_knn(K, **how), truth) == 1.0


APPROXIMATE = {
    "annoy": (api.build_annoy_index, {}, {}, 0.9),
    "kd_tree": (api.build_kd_tree_index, {}, {}, 0.85),
    "lsh": (api.build_lsh_index, {"num_tables": 8, "bits_per_hash": 6}, {"n_probe": 12}, 0.8),
    "ivf": (api.build_ivf_index, {}, {}, 0.7),
    "soar": (api.build_soar_index, {}, {}, 0.7),
    "hnsw": (api.build_hnsw_index, {}, {}, 0.95),
    "nndescent": (api.build_nndescent_index, {}, {}, 0.95),
    "vamana": (api.build_vamana_index, {}, {}, 0.95),
    "nsg": (api.build_nsg_index, {}, {}, 0.95),
    "rnn_descent": (api.build_rnn_descent_index, {"t2": 5}, {}, 0.9),
    "cagra": (api.build_nndescent_index_gpu, {}, {}, 0.9),
    "bf16": (api.build_exhaustive_bf16_index, {}, {}, 0.9),
    "ivf_bf16": (api.build_ivf_bf16_index, {"nlist": 9}, {"nprobe": 9}, 0.9),
    "sq8": (api.build_exhaustive_sq8_index, {}, {}, 0.6),
    "ivf_sq8": (api.build_ivf_sq8_index, {"nlist": 9}, {"nprobe": 9}, 0.6),
    "pq": (api.build_exhaustive_pq_index, {"m": 16, "n_pq_centroids": 64}, {}, 0.3),
    "opq": (api.build_exhaustive_opq_index, {"m": 16, "n_pq_centroids": 64}, {}, 0.3),
    "ivf_pq": (api.build_ivf_pq_index, {"nlist": 9, "m": 16, "n_pq_centroids": 64}, {"nprobe": 9}, 0.3),
    "ivf_opq": (api.build_ivf_opq_index, {"nlist": 9, "m": 16, "n_opq_centroids": 64}, {"nprobe": 9}, 0.3),
    "soar_pq": (api.build_soar_pq_index, {"nlist": 9, "m": 16, "n_pq_centroids": 64}, {"nprobe": 9}, 0.3),
    "soar_opq": (api.build_soar_opq_index, {"nlist": 9, "m": 16, "n_opq_centroids": 64}, {"nprobe": 9}, 0.3),
    "binary": (api.build_exhaustive_index_binary, {"metric": "euclidean"}, {"rerank": True}, 0.8),
    "ivf_binary": (api.build_ivf_index_binary, {"binary_init": "pca"}, {"rerank": True, "nprobe": 20}, 0.8),
    "rabitq": (api.build_exhaustive_index_rabitq, {}, {}, 0.6),
    "ivf_rabitq": (api.build_ivf_index_rabitq, {}, {"nprobe": 20}, 0.95),
    "turboquant": (api.build_exhaustive_index_turboquant, {}, {}, 0.95),
    "ivf_turboquant": (api.build_ivf_index_turboquant, {"bits": 2}, {"nprobe": 20}, 0.95),
}


@pytest.mark.parametrize("name", APPROXIMATE)
def test_recall(base, truth, name):
    build, params, how, least = APPROXIMATE[name]
    assert recalled(build(base, **params).self_knn(K, **how), truth) >= least


def test_k_beyond_n_external_queries_and_errors(base):
    few = base.where("id < 5")
    index = api.build_exhaustive_index(few)
    assert index.self_knn(50).count() == 25
    assert set(index.query(noised_queries(few), 2, return_dist=False).columns) == {"qid", "rk", "id"}
    assert index.query(few.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        index.self_knn(0)
    with pytest.raises(ValueError):
        api.build_exhaustive_index(few.limit(0))
    for build in (api.build_ivf_index, api.build_annoy_index, api.build_lsh_index, api.build_kmknn_index, api.build_exhaustive_sq8_index):
        with pytest.raises(ValueError):
            build(base, metric="manhattan")


def test_probe_rule_grows_until_k_rows():
    keep = R.probe_rule(np.array([[0, 1, 2], [2, 1, 0]]), np.array([1, 2, 50]), 1, 3)
    assert keep.tolist() == [[True, True, False], [True, False, False]]


def test_kmeans_over_the_table_is_a_fixed_point(base):
    c = api.train_centroids(base, 6)
    x = np.array([r.vec for r in base.collect()], float)
    own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(c, [x[own == i].mean(0) for i in range(6)], atol=1e-3)
    assert api.assign(base, c, top=2).count() == 2 * N
    with pytest.raises(ValueError):
        api.train_centroids(base, N + 1)


def test_second_cell_is_another_one():
    x = np.random.default_rng(0).standard_normal((200, 8))
    table = R.kmeans(x, 7)
    first = ((x[:, None] - table[None]) ** 2).sum(2).argmin(1)
    for rule in ("nearest", "shifted", "orthogonal"):
        assert (R.second_cell(x, table, first, rule, 0.5) != first).all()
    assert (R.second_cell(x, table, first, "shifted", -1.0) == R.second_cell(x, table, first, "nearest", 0)).all()


def test_shards_and_metrics_of_graphs(base):
    index = api.build_hnsw_index(base, metric="cosine", shard_rows=150)
    assert index.shards.count() >= 3
    recall, _ratio = evaluate.validate(index, K)
    assert recall > 0.95
    assert evaluate.validate(api.build_nndescent_index(base, metric="manhattan"), K)[0] > 0.9


@pytest.mark.parametrize("build", [api.build_nndescent_index, api.build_nndescent_index_gpu])
def test_extracted_lists_cross_shards(base, truth, build):
    index = build(base, k=K + 2, shard_rows=100)
    assert index.shard_count >= 4
    p = api.extract_nndescent_knn(index).toPandas()
    width = K + 2 if build is api.build_nndescent_index else (K + 2) * 3 // 2
    assert not p.duplicated(["src", "dst"]).any() and (p.src != p.dst).all() and (p.groupby("src").size() == width).all() and p.src.nunique() == N
    found = set(zip(p.src, p.dst))
    recall = np.mean([(q, i) in found for q in range(N) for i in truth[q, 1:]])
    assert recall > 0.95


GRAPHS = (api.build_hnsw_index, api.build_nndescent_index, api.build_vamana_index, api.build_nsg_index, api.build_rnn_descent_index, api.build_nndescent_index_gpu)


@pytest.mark.parametrize("build", GRAPHS)
def test_recall_over_many_shards(base, truth, build):
    index = build(base, shard_rows=60)
    assert index.shard_count >= 7
    assert recalled(index.self_knn(K), truth) > 0.93
    assert recalled(index.self_knn(K, nprobe=100), truth) > 0.97


def test_a_hot_centroid_is_several_shards(spark, base):
    """A third of all rows are one vector."""
    one = base.where("id = 5").first().vec
    same = base.where("id < 200").select((F.col("id") + 10_000).alias("id"), F.array(*[F.lit(float(x)).cast("float") for x in one]).alias("vec"))
    index = api.build_nndescent_index(materialise(base.union(same)), k=10, shard_rows=40)
    assert index.salts and index.shards.agg(F.max("n")).first()[0] <= 2 * 2 * 40 * 1.5
    found = index.query(base.where("id = 5"), 5).toPandas()
    assert len(found) == 5 and (found.distance < 1e-9).all()


def test_search_parameters_of_the_accelerated_graph(base, truth):
    index = api.build_nndescent_index_gpu(base)
    full = recalled(index.self_knn(K, beam_width=64, max_beam_iters=192, n_entry_points=8, expand_per_iter=3), truth)
    short = recalled(index.self_knn(K, beam_width=K, max_beam_iters=1, n_entry_points=8, expand_per_iter=1), truth)
    assert full > 0.9 > short


def test_knn_graph_merge_and_refine(base, truth):
    g = api.build_knn_graph(base, k=K, cells=4)
    p = g.toPandas()
    assert (p.groupby("src").size() == K).all() and not (p.src == p.dst).any()
    better = graphs.refine(g, base, K).toPandas()
    hits = lambda q: np.mean([d in truth[s] for s, d in zip(q.src, q.dst)])
    assert hits(better) >= hits(p)


def test_saving_and_what_can_be_wrong(spark, base):
    for index, how in ((api.build_soar_opq_index(base, nlist=6, m=16, n_opq_centroids=32), {}), (api.build_annoy_index(base, n_trees=3), {}), (api.build_hnsw_index(base), {}), (api.build_kmknn_index(base), {})):
        path = shared_dir(spark)
        api.save_index(index, path)
        again = api.load_index(spark, path)
        assert again.kind == index.kind
        assert again.self_knn(3, **how).exceptAll(index.self_knn(3, **how)).count() == 0
    with pytest.raises(persist.NotAnIndexError):
        api.load_index(spark, shared_dir(spark))
    with pytest.raises(persist.KindError):
        api.load_index(spark, path, "ivf")
    with pytest.raises(persist.ElementTypeError):
        api.load_index(spark, path, element="double")
    home = spark.read.parquet(f"{path}/manifest").first().home
    spark.read.parquet(f"{path}/{home}/rows").limit(7).coalesce(1).write.parquet(f"{path}/{home}/more")
    with pytest.raises(persist.TrailingError):
        api.load_index(spark, path)
    m = spark.read.parquet(f"{path}/manifest")
    materialise(m.withColumn("format_version", F.lit(99))).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(persist.VersionError):
        api.load_index(spark, path)
    path = shared_dir(spark)
    api.save_index(api.build_ivf_index(base, 6), path)
    again = api.load_index(spark, path)
    api.save_index(again, path)  # onto the place it is read from
    assert api.load_index(spark, path).self_knn(3, nprobe=6).count() == 3 * N
    home = spark.read.parquet(f"{path}/manifest").first().home
    materialise(spark.read.parquet(f"{path}/{home}/rows").limit(100)).write.mode("overwrite").parquet(f"{path}/{home}/rows")
    with pytest.raises(persist.TruncatedError):
        api.load_index(spark, path)


def test_rerank_stores(spark, base):
    index = api.build_exhaustive_index_binary(base, metric="euclidean")
    path = shared_dir(spark)
    api.save_store(index, path)
    want = {(r.qid, r.id) for r in index.self_knn(5, rerank=True).collect()}
    assert {(r.qid, r.id) for r in index.with_store(path).self_knn(5, rerank=True).collect()} == want
    with pytest.raises(persist.TruncatedError):
        api.build_exhaustive_index_binary(base.where("id > 5"), metric="euclidean").with_store(path)
    with pytest.raises(persist.KindError):
        api.load_index(spark, path, "ivf")


@pytest.mark.parametrize("bad", ["null", "short", "nan", "element"])
def test_bad_vectors_raise_when_built_and_when_asked(spark, base, bad):
    wrong = {"null": "NULL", "short": "slice(vec, 1, 31)", "nan": "transform(vec, x -> float('nan'))", "element": "transform(vec, x -> CAST(NULL AS FLOAT))"}[bad]
    mixed = base.selectExpr("id", f"CASE WHEN id = 37 THEN {wrong} ELSE vec END AS vec")
    with pytest.raises(Exception, match="vector"):
        api.build_exhaustive_index(mixed)
    with pytest.raises(Exception, match="vector"):
        api.build_exhaustive_index(base).query(mixed, 3).count()
    with pytest.raises(TypeError):
        api.build_exhaustive_index(base.selectExpr("id", "CAST(vec AS array<string>) AS vec"))


def test_unknown_parameters_raise(base):
    for build, how in ((api.build_ivf_index, {"nprob": 9}), (api.build_exhaustive_index, {"nprobe": 2}), (api.build_lsh_index, {"typo": 1}), (api.build_hnsw_index, {"typo": 1}), (api.build_annoy_index, {"n_probe": 1})):
        with pytest.raises(TypeError):
            build(base).self_knn(3, **how)
    with pytest.raises(TypeError):
        api.build_hnsw_index(base, typo=1)


@pytest.mark.parametrize("init", ["draws", "parallel", "rows"])
def test_ways_to_train_centroids(base, truth, init):
    params = api.KMeansParams(rounds=12, init=init, balance=True)
    assert recalled(api.build_ivf_index(base, 9, k_means_params=params).self_knn(K, nprobe=9), truth) == 1.0
    x = np.array([r.vec for r in base.collect()], float)
    c = R.kmeans(x, 9, init=init)
    assert c.shape == (9, D) and ((x[:, None] - c[None]) ** 2).sum(2).min(1).mean() < 0.6 * x.var(0).sum()


def test_hashing_always_finds_k(base):
    for how in ({}, {"n_probe": 0}):
        found = api.build_lsh_index(base, num_tables=2, bits_per_hash=16).self_knn(K, **how).toPandas()
        assert (found.groupby("qid").size() == K).all() and found.qid.nunique() == N


def test_residual_sign_codes(base, truth):
    assert recalled(api.build_ivf_index_binary(base, binary_init="sign", residual=True, nlist=9).self_knn(K, nprobe=9, rerank=True), truth) > 0.8
    with pytest.raises(ValueError):
        api.build_ivf_index_binary(base, residual=True)


@pytest.mark.parametrize("family", FAMILIES)
def test_synthetic_rows_depend_on_seed_and_id_only(spark, family):
    a, b = vectors(spark, family, 60, 24, partitions=3), vectors(spark, family, 60, 24, partitions=5)
    assert a.exceptAll(b).count() == 0
    assert vectors(spark, family, 60, 24, seed=1).exceptAll(a).count() == 60


def test_queries_as_a_stream(spark, base, tmp_path):
    from nearfield.streaming import stream_queries

    base.where("id < 20").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    index = api.build_exhaustive_index(base)
    stream_queries(stream, index, lambda found, n: found.write.mode("append").parquet(out), 4, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 80


def test_every_engine_has_its_query_names():
    for name in api.ENGINES:
        query = f"query_{name}" if "_index" in name else f"query_{name}_index"
        assert callable(getattr(api, query)) and callable(getattr(api, f"query_{name}_self"))


def test_a_scan_is_told_which_cells_to_read(spark, base):
    index = api.build_ivf_index(base, 40)
    found = index.query(base.where("id = 3"), 5, nprobe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [Or(" in plan or "EqualTo(cell" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
