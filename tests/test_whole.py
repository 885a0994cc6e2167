"""Searches that look at everything do so without lists of pairs, cells or steps, and searches that state a recall reach it."""

from pathlib import Path

import numpy as np
import pytest

from nearfield import api
from nearfield.operators import cells, evaluate, graphs, kmeans
from nearfield.plans import queries as plans
from nearfield.sources.tables import materialise

DATA = Path("/root/testdata/sf0.001")


def same(a, b):
    a, b = (x.toPandas().sort_values(["qid", "rk"]).reset_index(drop=True) for x in (a, b))
    return len(a) == len(b) and all((a[c].values == b[c].values).all() for c in ("qid", "rk", "id", "distance"))


EVERY = """bf16_rerank_all
opq_rerank_all
pq_rerank_all
turboquant_rerank_all
ivf_pq_rerank_all
rabitq_rerank_all
soar_pq_rerank_all
""".split()


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", EVERY)
def test_all_rows_are_scored_again_without_pairs(spark, name):
    found = plans.QUERIES[name](spark, str(DATA))
    assert "Join" not in found._jdf.queryExecution().toString()
    assert same(found, plans.flat_l2(spark, str(DATA)))


BEAMS = """cagra
hnsw
nsg
rnn_descent
vamana
""".split()


@pytest.mark.parametrize("kind", BEAMS)
def test_a_beam_as_wide_as_the_shard_meets_what_the_walk_meets(kind):
    rng = np.random.default_rng(5)
    x, ids = rng.standard_normal((300, 16)), np.arange(300) * 3
    arrays = graphs.BUILDERS[kind]("euclidean", x, {}, 42)
    graph = arrays["graph"].copy()
    graph[:40] = -1  # rows that lead nowhere
    q = rng.standard_normal((20, 16))
    seeds = graphs.descend("euclidean", q, x, arrays) if "entry" in arrays else arrays["seeds"]
    at, far = graphs.beam("euclidean", q, x, graph, seeds, len(x))
    r, c = np.nonzero(np.isfinite(far))
    want = graphs.merge_top(r, ids[at[r, c]], far[r, c], 7)
    got = graphs.merge_top(*graphs.whole_beam("euclidean", q, x, graph, seeds, ids, 7, {}), 7)
    assert all(np.allclose(a, b) for a, b in zip(got, want))


def test_centroids_come_to_rest_within_the_rounds(spark):
    """Plain rounds need 56 for these rows."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2_000, 8))
    e = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vec array<double>")
    c = kmeans.train_centroids(e, 6, rounds=35)
    own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert np.abs(np.stack([x[own == j].mean(0) for j in range(6)]) - c).max() < 1e-4


NARROW = {
    "recall_annoy": (api.build_annoy_index, {"n_trees": 3}, {"budget": 30}),
    "recall_ball_tree": (api.build_balltree_index, {}, {"budget": 30}),
    "recall_binary_random": (api.build_exhaustive_index_binary, {"metric": "euclidean", "n_bits": 16}, {"rerank": True, "rerank_factor": 1}),
    "recall_binary_pca": (api.build_exhaustive_index_binary, {"metric": "euclidean", "binary_init": "pca", "n_bits": 16}, {"rerank": True, "rerank_factor": 1}),
    "recall_hnsw_shards": (api.build_hnsw_index, {"shard_rows": 100}, {"nprobe": 1}),
}


@pytest.mark.parametrize("name", NARROW)
def test_widths_grow_until_nine_in_ten_are_found(spark, name):
    build, more, params = NARROW[name]
    x = np.random.default_rng(3).standard_normal((400, 32))
    e = materialise(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vec array<double>"))
    index, asked = build(e, **more), e.where("id % 50 = 0")
    truth = api.build_exhaustive_index(e).query(asked, 10)
    recalled = lambda how: plans.hits(index.query(asked, 10, **how), truth).where("recalled").count()
    assert recalled(params) < asked.count()
    assert recalled(evaluate.widened(index, 10, 0.9, **params)) == asked.count()


SOME = """rerank_exact
rerank_from_store
""".split()


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_some_rows_are_scored_again_without_pairs(spark, name, monkeypatch):
    """With few candidates held at once, so that there are many blocks of queries."""
    want = plans.QUERIES[name](spark, str(DATA))
    assert "Join" not in want._jdf.queryExecution().toString()
    want = materialise(want)
    monkeypatch.setattr(cells, "HELD", 700)
    assert same(plans.QUERIES[name](spark, str(DATA)), want)


def test_candidates_are_chosen_in_blocks_of_bounded_size(monkeypatch):
    x, rows = np.random.default_rng(5).standard_normal((3_000, 16)), []
    want = graphs.neighbours("euclidean", x, 20)
    plain = np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda d, *a, **b: rows.append(d.size) or plain(d, *a, **b))
    monkeypatch.setattr(graphs, "HELD_CELLS", 100_000, raising=False)
    got = graphs.neighbours("euclidean", x, 20)
    assert max(rows) <= 100_000
    assert (got[0] == want[0]).all() and np.allclose(got[1], want[1])


def test_short_lists_are_pruned_without_the_longest_ones_width(monkeypatch):
    """rnn_descent_full_beam: most lists of its rounds have a fifth of the longest one's length."""
    rng = np.random.default_rng(5)
    x, cells = rng.standard_normal((500, 8)), []
    cand = np.stack([rng.permutation(500)[:60] for _ in range(500)])
    cand[np.arange(60) >= rng.integers(0, 5, 500)[:, None]] = -1
    cand[7] = rng.permutation(500)[:60]
    cand, far = graphs.knn_rows("euclidean", x, cand, 60)
    plain = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, *a, **b: (how == "ijj->ij" and cells.append(a[0].size)) or plain(how, *a, **b))
    got, (keeps, hides) = graphs.pruned("euclidean", x, cand, far, 5), graphs.pruned("euclidean", x, cand, far, 5, hiders=True)
    assert 0 < sum(cells) <= 2 * (60 * 60 + 500 * 5 * 5)
    for i in range(500):
        kept, hidden = [], {}
        for j in np.flatnonzero(cand[i] >= 0):
            if j in hidden or len(kept) == 5:
                continue
            kept.append(j)
            hidden |= {m: j for m in range(j + 1, 60) if cand[i, m] >= 0 and m not in hidden and ((x[cand[i, m]] - x[cand[i, j]]) ** 2).sum() <= far[i, m]}
        assert got[i][got[i] >= 0].tolist() == cand[i, kept].tolist() and np.flatnonzero(keeps[i]).tolist() == kept
        assert {m: hides[i, m] for m in np.flatnonzero(hides[i] >= 0)} == hidden


def test_distances_of_lists_are_taken_in_small_blocks(monkeypatch):
    """recall_cagra: NN-Descent looks at some hundred candidates a row in each round."""
    rng = np.random.default_rng(5)
    q, x, at, sizes = rng.standard_normal((300, 16)), rng.standard_normal((400, 16)), rng.integers(-1, 400, (300, 50)), []
    want = np.where(at < 0, np.inf, 1 - (q[:, None] * x[at]).sum(2))
    plain = np.einsum
    monkeypatch.setattr(graphs, "CACHED", 20_000, raising=False)
    monkeypatch.setattr(np, "einsum", lambda how, *a, **b: sizes.append(a[1].size) or plain(how, *a, **b))
    assert np.allclose(graphs.gathered("cosine", q, x, at), want) and max(sizes) <= 20_000


CELLS = {
    "recall_cagra": (api.build_nndescent_index_gpu, {"shard_rows": 100}, {"nprobe": 1}),
    "recall_ivf": (api.build_ivf_index, {"nlist": 16}, {"nprobe": 1}),
    "recall_ivf_balanced": (api.build_ivf_index, {"nlist": 16, "k_means_params": api.KMeansParams(balance=True, init="parallel")}, {"nprobe": 1}),
    "recall_ivf_bf16": (api.build_ivf_bf16_index, {"nlist": 16}, {"nprobe": 1, "rerank": True, "rerank_factor": 1}),
    "recall_ivf_binary": (api.build_ivf_index_binary, {"nlist": 16, "n_bits": 16}, {"nprobe": 4, "rerank": True, "rerank_factor": 1}),
    "recall_ivf_opq": (api.build_ivf_opq_index, {"nlist": 16, "m": 8, "n_opq_centroids": 16}, {"nprobe": 4, "rerank": True, "rerank_factor": 1}),
    "recall_ivf_pq": (api.build_ivf_pq_index, {"nlist": 16, "m": 8, "n_pq_centroids": 16}, {"nprobe": 4, "rerank": True, "rerank_factor": 1}),
}


@pytest.mark.parametrize("name", CELLS)
def test_cells_and_shards_grow_until_nine_in_ten_are_found(spark, name):
    build, more, params = CELLS[name]
    x = np.random.default_rng(4).standard_normal((400, 32))
    e = materialise(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vec array<double>"))
    index, asked = build(e, **more), e.where("id % 50 = 0")
    truth = api.build_exhaustive_index(e).query(asked, 10)
    recalled = lambda how: plans.hits(index.query(asked, 10, **how), truth).where("recalled").count()
    assert recalled(params) < asked.count()
    assert recalled(evaluate.widened(index, 10, 0.9, **params)) == asked.count()


BETWEEN = {name: CELLS[name][:2] + (more,) for name, more in {
    "recall_ivf": {"nprobe": 1},
    "recall_ivf_balanced": {"nprobe": 1},
    "recall_ivf_bf16": {"nprobe": 1, "rerank": True, "rerank_factor": 4},
    "recall_ivf_binary": {"nprobe": 1, "rerank": True, "rerank_factor": 4},
    "recall_ivf_opq": {"nprobe": 1, "rerank": True, "rerank_factor": 4},
    "recall_ivf_pq": {"nprobe": 1, "rerank": True, "rerank_factor": 4},
}.items()}


@pytest.mark.parametrize("name", BETWEEN)
def test_a_row_unlike_those_measured_asks_again(spark, tmp_path, name):
    """Row 0 lies between sixteen far groups, so its neighbours are in more cells than any other row's."""
    build, more, params = BETWEEN[name]
    rng = np.random.default_rng(4)
    x = np.repeat(np.eye(32)[:16] * 10, 25, axis=0)[rng.permutation(400)] + rng.standard_normal((400, 32))
    x[0] = 0.6
    e = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = plans._recall(build, params, **more)(spark, str(tmp_path)).collect()
    assert sorted(r.qid for r in got) == list(range(0, 400, 50)) and all(r.recalled for r in got)


RESIDUAL = {
    "recall_ivf_opq": (api.build_ivf_opq_index, {"m": 8, "n_opq_centroids": 16}),
    "recall_ivf_pq": (api.build_ivf_pq_index, {"m": 8, "n_pq_centroids": 16}),
}


@pytest.mark.parametrize("name", RESIDUAL)
def test_rows_of_all_cells_are_scored_again_without_pairs(spark, name):
    """Codes of residuals, 40 candidates a query."""
    build, more = RESIDUAL[name]
    x = np.random.default_rng(4).standard_normal((400, 32))
    e = materialise(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, vec array<double>"))
    index = build(e, nlist=16, **more)
    found = index.query(e, 10, nprobe=16, rerank=True, rerank_factor=4)
    assert "Join" not in found._jdf.queryExecution().toString()
    codes, got = {}, {}
    for r in index.query(e, 40, nprobe=16).collect():
        codes.setdefault(r.qid, []).append(r.id)
    for r in found.orderBy("rk").collect():
        got.setdefault(r.qid, []).append(r.id)
    for q, ids in codes.items():
        assert got[q] == sorted(ids, key=lambda i: (((x[i] - x[q]) ** 2).sum(), i))[:10]
