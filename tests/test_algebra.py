import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from one_task_leiden import leiden
from pyspark.sql import functions as F

from lattica.operators import cluster, communities, deconvolve, descent, factorize, graphs, impute, linalg, metrics, mixture, nearest, preprocess, register, row_solve
from lattica.plans import tables


def vec_table(spark, x, **more):
    rows = [(i, [float(v) for v in r], *(str(m[i]) for m in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "obs_id long, vec array<double>" + "".join(f", {k} string" for k in more))


def test_gram_and_components(spark):
    x = np.random.default_rng(0).standard_normal((50, 6))
    df = vec_table(spark, x).repartition(3)
    assert np.allclose(linalg.gram(df, "vec"), x.T @ x)
    pc, load, _ = linalg.principal_components(df, 3, vec="vec", out="pc")
    got = np.array([r.pc for r in pc.orderBy("obs_id").collect()])
    u, s, vh = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]))
    assert np.allclose(load.T @ load, np.eye(3))


@pytest.mark.parametrize("centered", [True, False])
def test_components_of_wide_rows(spark, centered):
    """More features than rows and a slowly falling spectrum, a table of rank 3, equal values, zeros: as a dense decomposition."""
    rng = np.random.default_rng(5)
    flat = rng.standard_normal((70, 400)) * np.linspace(1, 0.5, 400) + 2
    low = rng.standard_normal((40, 3)) @ rng.standard_normal((3, 90))
    twins = np.tile(np.linalg.qr(rng.standard_normal((30, 30)))[0], (2, 1))
    for x, n in ((flat, 6), (low, 3), (low, 8), (twins, 4), (np.zeros((5, 20)), 2)):
        df = vec_table(spark, x).repartition(3)
        pc, load, variance = linalg.principal_components(df, n, centered, vec="vec", out="pc", gram_features=0)
        u, s, vh = np.linalg.svd(x - x.mean(0) * centered, full_matrices=False)
        assert np.allclose(variance, s[:n] ** 2 / (len(x) - 1), atol=1e-8 * max(1, s[0] ** 2)) and np.allclose(load.T @ load, np.eye(n))
        got = np.array([r.pc for r in pc.orderBy("obs_id").collect()])
        assert np.allclose((got**2).sum(0), s[:n] ** 2, atol=1e-8 * max(1, s[0] ** 2))
        if x is flat:
            assert np.allclose(np.abs(got), np.abs(u[:, :n] * s[:n]), atol=1e-6)


def test_polar_factors_are_orthonormal_and_partition_free(spark):
    m = np.random.default_rng(1).standard_normal((40, 4))
    df = vec_table(spark, m, slice=["a"] * 40)
    u, _, vh = np.linalg.svd(m, full_matrices=False)
    for n in (1, 5):
        t = linalg.polar_factors(df.repartition(n), "vec", "slice", 4)["a"]
        assert np.allclose(m @ t, u @ vh)


def test_solve_spd_ladder():
    a = np.array([[1.0, 1.0], [1.0, 1.0]])
    assert np.allclose(a @ linalg.solve_spd(a, np.array([[1.0], [1.0]])), 1, atol=1e-5)


def test_columns_solver_equals_dense():
    rng = np.random.default_rng(2)
    n, gamma, rho = 12, 0.5, 1.0
    a = np.triu(rng.random((n, n)) < 0.3, 1).astype(float)
    a += a.T
    lap = np.diag(a.sum(1)) - a
    src, dst = np.nonzero(lap)
    lam, rhs = rng.random(5), rng.standard_normal((n, 5))
    y, first = row_solve.solve_columns(row_solve.RowGraph(n, src, dst, lap[src, dst]), rho + 2 * gamma * lam, gamma, rhs, np.zeros((n, 5)))
    assert np.allclose(first, rhs)
    for j in range(5):
        assert np.allclose(y[:, j], np.linalg.solve((rho + 2 * gamma * lam[j]) * np.eye(n) + 2 * gamma * lap, rhs[:, j]), atol=1e-6)


def dense_fit(xs, ls, lg, rank, gamma, iters, rho, seed):
    """The sweep of factorize.fit with whole matrices."""
    rng = np.random.default_rng(seed)
    n, g = sum(map(len, xs)), xs[0].shape[1]
    x, cut = np.concatenate(xs), np.cumsum([0] + [len(x) for x in xs])
    b = rng.standard_normal((g, rank))
    norm = np.linalg.norm(b, axis=0)
    b, h, w = b / norm, np.eye(rank), [norm.copy() for _ in xs]
    m = np.stack([np.random.default_rng([seed, i]).standard_normal(rank) for i in range(n)])

    def polar(m):
        u, _, vh = np.linalg.svd(m, full_matrices=False)
        return u @ vh

    q = [polar(m[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    y, u, out = np.zeros((n, g)), np.zeros((n, g)), []
    big = np.kron(rho * np.eye(n) + 2 * gamma * ls, np.eye(g)) + 2 * gamma * np.kron(np.eye(n), lg)
    for _ in range(iters):
        s = np.concatenate([(q[k] @ h * w[k]) @ b.T for k in range(len(xs))])
        y = np.linalg.solve(big, (rho * (s - u)).ravel()).reshape(n, g)
        out.append(np.linalg.norm(y - s) / np.linalg.norm(y))
        t = x + rho / 2 * (y + u)
        ts = [t[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        q = [polar(ts[k] @ ((h * w[k]) @ b.T).T) for k in range(len(xs))]
        sh = sum((b * w[k]).T @ (b * w[k]) for k in range(len(xs)))
        h = np.linalg.solve(sh + 1e-8 * np.eye(rank), sum(q[k].T @ ts[k] @ (b * w[k]) for k in range(len(xs))).T / (1 + rho / 2)).T
        for k in range(len(xs)):
            f = q[k] @ h
            w[k] = np.linalg.solve((1 + rho / 2) * (b.T @ b) * (f.T @ f) + 1e-8 * np.eye(rank), np.diag(f.T @ ts[k] @ b))
        c = np.concatenate([q[k] @ h * w[k] for k in range(len(xs))])
        b = np.linalg.solve(c.T @ c + 1e-8 * np.eye(rank), (t.T @ c).T / (1 + rho / 2)).T
        norm = np.linalg.norm(b, axis=0)
        b, w = b / norm, [v * norm for v in w]
        u = u + y - np.concatenate([(q[k] @ h * w[k]) @ b.T for k in range(len(xs))])
    return b, w, out


@pytest.mark.parametrize("cut", ["tiles", "hashed", "one"])
def test_solver_in_blocks_equals_dense(spark, cut):
    """A lattice with some long edges, in tiles with halo rows, in blocks that share nearly all rows, and in one."""
    rng = np.random.default_rng(12)
    side, c = 24, 5
    n = side * side
    at = np.arange(n).reshape(side, side)
    a = np.zeros((n, n))
    for i, j in ((at[1:], at[:-1]), (at[:, 1:], at[:, :-1])):
        a[i.ravel(), j.ravel()] = a[j.ravel(), i.ravel()] = rng.random(i.size)
    for _ in range(10):
        i, j = rng.integers(0, n, 2)
        a[i, j] = a[j, i] = 0.5
    np.fill_diagonal(a, 0)
    lap = np.diag(a.sum(1)) - a
    shift, gamma = 1 + rng.random(c), 0.5
    r, z = rng.standard_normal((2, n, c))
    gid = rng.permutation(n)
    rows = spark.createDataFrame([(int(gid[i]), int(i), r[i].tolist(), z[i].tolist()) for i in range(n)], "gid long, obs_id long, r array<double>, z array<double>").repartition(3)
    points = spark.createDataFrame([(int(at[i, j]), float(i), float(j)) for i in range(side) for j in range(side)], "obs_id long, x double, y double")
    edges = tables.written(spark.createDataFrame([(int(gid[i]), int(gid[j]), float(lap[i, j])) for i, j in zip(*np.nonzero(lap), strict=True)], "i long, j long, w double"), "edges")
    own, k = row_solve.tiles(rows, points if cut == "tiles" else None, n, n if cut == "one" else 64)
    own = tables.written(own, "rows")
    assert k == own.select("block").distinct().count() and (k == 1) == (cut == "one")
    blocks = row_solve.cut_blocks(own, edges, k)
    assert (blocks.members is None) == (cut == "one") and (cut != "tiles" or blocks.most < n / 2)
    got = {x.gid: x.z for x in row_solve.solve(blocks, own.select("gid", "block", "r", "z"), shift, gamma).collect()}
    y = np.array([got[g] for g in gid.tolist()])
    want = np.stack([np.linalg.solve(shift[j] * np.eye(n) + 2 * gamma * lap, r[:, j]) for j in range(c)], 1)
    assert len(got) == n and np.abs(y - want).max() < 1e-7


@pytest.mark.parametrize("block_rows", [None, 6])
def test_factorization_equals_dense(spark, block_rows):
    rng = np.random.default_rng(3)
    xs = [rng.random((12, 3)) @ rng.random((3, 7)) + 0.01 * rng.random((12, 7)), rng.random((9, 3)) @ rng.random((3, 7))]
    n = 21
    a = np.triu(rng.random((n, n)) < 0.2, 1).astype(float)
    a += a.T
    ls = np.diag(a.sum(1)) - a
    c = np.triu(rng.random((7, 7)) < 0.4, 1).astype(float)
    c += c.T
    lg = np.diag(c.sum(1)) - c
    rows = [("s0" if i < 12 else "s1", i, [float(v) for v in np.concatenate(xs)[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "slice string, obs_id long, x array<double>").repartition(3)
    lap = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "src long, dst long, w double")
    f = factorize.fit(df, lap(ls), lap(lg), rank=3, gamma=0.3, iters=2, seed=5, block_rows=block_rows)
    # rows are numbered by a hash: bring the dense run into the same order
    gid = {r.obs_id: r.gid for r in f.rows.collect()}
    order = sorted(range(n), key=lambda i: gid[i])
    x = np.concatenate(xs)[order]
    b, w, res = dense_fit([x[:12], x[12:]], ls[np.ix_(order, order)], lg, 3, 0.3, 2, 1.0, 5)
    assert np.allclose(f.b, b, atol=1e-5) and np.allclose(f.w["s1"], w[1], atol=1e-5)
    assert np.allclose(f.residuals, res, atol=1e-6)
    q = {r.gid: np.array(r.q) for r in f.rows.collect()}
    gap = [x[i] - (q[i] @ f.h * f.w["s0" if i < 12 else "s1"]) @ f.b.T for i in range(n)]
    assert abs(f.objective[-1] - 0.5 * np.sum(np.square(gap))) < 1e-6
    e = factorize.embeddings(f).collect()
    assert len(e) == n and all(abs(np.linalg.norm(r.unit) - 1) < 1e-5 for r in e)


def test_optimality_sees_a_wrong_step(spark):
    rng = np.random.default_rng(6)
    x = rng.random((30, 2)) @ rng.random((2, 6)) + 0.1 * rng.random((30, 6))
    df = spark.createDataFrame([("a" if i < 18 else "b", i, x[i].tolist()) for i in range(30)], "slice string, obs_id long, x array<double>")
    lap = lambda n: spark.createDataFrame([(i, j, 2.0 if i == j else -1.0) for i in range(n) for j in (i, (i + 1) % n, (i - 1) % n)], "src long, dst long, w double")
    f = factorize.fit(df, lap(30), lap(6), rank=2, iters=3)
    part = lambda: {(r.part, r.of): r.residual for r in factorize.optimality(f, lap(6)).collect()}
    right = part()
    assert len(right) == 2 * 6 + 2 * 2 and not any(right.values())
    f.b = f.b * 1.01
    f.rows = f.rows.withColumn("q", F.transform("q", lambda v: v * 0.99))
    f.state = f.state.withColumn("y", F.transform("y", lambda v: v * 1.01))
    wrong = part()
    assert min(v for (p, _), v in wrong.items() if p != "nearest") > 1e-4


@pytest.mark.parametrize("k", [3, 7, 200])
def test_nearest_by_path_equals_dijkstra(spark, k):
    """Random graphs with a hub, zero lengths, ties and parts that don't meet."""
    rng = np.random.default_rng(k)
    n, d = 60, {}
    for i in range(n):
        for j in rng.integers(0, n, 3):
            if i != j and (i < 50) == (j < 50):
                d[i, int(j)] = d[int(j), i] = float(rng.choice([0.0, 1.0, 1.0, 2.5, rng.random()]))
    for i in range(1, 50):
        d[0, i] = d[i, 0] = 4.0
    far = np.full((n, n), np.inf)
    np.fill_diagonal(far, 0)
    for (i, j), w in d.items():
        far[i, j] = w
    for m in range(n):
        far = np.minimum(far, far[:, m : m + 1] + far[m : m + 1])
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in d.items()], "src long, dst long, d double")
    got: dict = {}
    for r in metrics.nearest_by_path(edges, k).collect():
        got.setdefault(r.src, []).append((round(r.d, 9), r.dst))
    for i in {i for i, _ in d}:
        want = sorted((round(float(far[i, j]), 9), j) for j in range(n) if np.isfinite(far[i, j]))[:k]
        assert [x for x, _ in sorted(got[i])] == [x for x, _ in want]
        edge = want[-1][0]
        assert {j for x, j in got[i] if x < edge} == {j for x, j in want if x < edge}


def test_slice_smaller_than_rank_is_an_error(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 2.0])], "slice string, obs_id long, x array<double>")
    e = spark.createDataFrame([], "src long, dst long, w double")
    with pytest.raises(ValueError, match="rows at least"):
        factorize.fit(df, e, e, rank=2)


def test_knn_against_brute_force(spark):
    x = np.random.default_rng(4).standard_normal((60, 5))
    df = vec_table(spark, x)
    got = {(r.src, r.rank): r.dst for r in graphs.knn(df, df, 4, "cosine", exclude_self=True, block_rows=17).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(-s[i], kind="stable")[:4])}


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_knn_by_pivots_against_brute_force(spark, metric):
    """More rows than a block: clustered ones, a hot vector, a zero vector, and left rows that aren't right ones."""
    rng = np.random.default_rng(31)
    x = np.concatenate([rng.standard_normal((60, 5)) + c for c in rng.standard_normal((5, 5)) * 20] + [np.tile(rng.standard_normal(5), (90, 1)), np.zeros((1, 5))])
    q = np.concatenate([x[::9], rng.standard_normal((30, 5)) * 20])
    right = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "obs_id long, vec array<double>").repartition(3)
    left = spark.createDataFrame([(9 * i if 9 * i < len(x) else 10_000 + i, [float(v) for v in r]) for i, r in enumerate(q)], "obs_id long, vec array<double>")
    ids = [9 * i if 9 * i < len(x) else 10_000 + i for i in range(len(q))]
    unit = (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)) if metric == "cosine" else lambda m: m
    s = unit(q) @ unit(x).T if metric != "euclidean" else -np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    got: dict = {}
    for r in graphs.knn(left, right, 6, metric, exclude_self=True, block_rows=40).collect():
        got.setdefault(r.src, {})[r.rank] = r
    for i, me in enumerate(ids):
        if me < len(x):
            s[i, me] = -np.inf
        want = np.sort(s[i])[::-1][:6]
        mine = [got[me][k] for k in range(1, 7)]
        assert np.allclose([r.score for r in mine], want, atol=1e-7) and np.allclose([s[i, r.dst] for r in mine], want, atol=1e-7) and len({r.dst for r in mine}) == 6


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_by_descent_recall(spark, metric):
    """Clusters that no block holds whole, unclustered rows, and a hot vector."""
    rng = np.random.default_rng(8)
    x = np.concatenate([*(rng.standard_normal((300, 12)) + c for c in rng.standard_normal((4, 12)) * 4), rng.standard_normal((900, 12)), np.tile(rng.standard_normal(12), (200, 1))])
    df = vec_table(spark, x).repartition(3)
    got: dict = {}
    for r in graphs.knn_by_descent(df, 8, metric).collect():
        got.setdefault(r.src, {})[r.rank] = r
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T if metric == "cosine" else -np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    np.fill_diagonal(s, -np.inf)
    hits = 0
    for i in range(len(x)):
        mine = [got[i][k] for k in range(1, 9)]
        assert len({r.dst for r in mine}) == 8 and all(abs(r.score - s[i, r.dst]) < 1e-6 for r in mine)
        hits += sum(r.score >= np.sort(s[i])[-8] - 1e-6 for r in mine)
    assert hits >= 0.95 * 8 * len(x)


def test_knn_by_descent_odd_input(spark):
    """No row, one row, fewer than k others, nulls, and a metric that descent can't take."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [float("nan"), 1.0]), (5, [0.0, 1.0])], "obs_id long, vec array<double>")
    assert graphs.knn_by_descent(df.where("obs_id = 9"), 3).count() == 0
    assert graphs.knn_by_descent(df.where("obs_id = 1"), 3).count() == 0
    assert {(r.src, r.rank, r.dst) for r in graphs.knn_by_descent(df, 3).collect()} == {(1, 1, 2), (1, 2, 5), (2, 1, 1), (2, 2, 5), (5, 1, 2), (5, 2, 1)}
    assert {(r.src, r.dst) for r in graphs.mutual_knn(df, 1, approximate=True).collect()} == {(1, 2), (2, 1)}
    with pytest.raises(ValueError, match="descent"):
        graphs.knn_by_descent(df, 3, "dot")


def test_knn_odd_input(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0])], "obs_id long, vec array<double>")
    got = sorted((r.src, r.dst) for r in graphs.knn(df, df, 5, exclude_self=True).collect())
    assert got == [(1, 2), (2, 1)]
    assert graphs.mutual_knn(df, 5).count() == 2


def test_radius_graph_edge_cases(spark):
    p = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 0.0, 0.0), ("a", 3, 3.0, 4.0), ("b", 4, 0.0, 0.0)], "slice string, obs_id long, x double, y double")
    assert sorted((r.src, r.dst) for r in graphs.radius_graph(p, 0.0).collect()) == [(1, 2), (2, 1)]
    assert graphs.radius_graph(p, 5.0).count() == 6
    assert graphs.radius_graph(p.where("slice = 'b'"), 5.0).count() == 0
    lap = graphs.laplacian(graphs.radius_graph(p, 5.0))
    assert all(abs(r["sum(w)"]) < 1e-12 for r in lap.groupBy("src").sum("w").collect())


def test_interaction_graph_case_and_threshold(spark):
    ppi = spark.createDataFrame([("a", "B", 700), ("b", "a", 800), ("a", "a", 900), ("a", "c", 10), ("a", "zz", 900)], "gene1 string, gene2 string, combined_score int")
    genes = spark.createDataFrame([(0, "A"), (1, "b"), (2, "C")], "gene_id int, gene string")
    assert sorted((r.src, r.dst) for r in graphs.interaction_graph(ppi, genes, 650).collect()) == [(0, 1), (1, 0)]
    assert graphs.interaction_graph(ppi, genes, 650, "keep").count() == 0


def test_spatial_neighbors_fewer_than_k(spark):
    p = spark.createDataFrame([("a", i, float(i * i), 0.0) for i in range(4)] + [("b", 9, 0.0, 0.0)], "slice string, obs_id long, x double, y double")
    assert graphs.spatial_neighbors(p, 6).count() == 12
    assert sorted((r.src, r.dst) for r in graphs.spatial_neighbors(p, 1).collect()) == [(0, 1), (1, 0), (2, 1), (3, 2)]


def test_no_common_gene_is_an_error(spark):
    var = spark.createDataFrame([("a", "x", 0, True), ("b", "y", 0, True)], "slice string, gene string, position int, highly_variable boolean")
    with pytest.raises(ValueError, match="no feature"):
        preprocess.align_genes(var)


def test_quality_control_edges(spark):
    e = spark.createDataFrame([("a", 1, "g", 0.5), ("a", 2, "g", 5.0), ("a", 3, "g", 5.0), ("a", 4, "h", 9.0)], "slice string, obs_id long, gene string, value double")
    assert {r.obs_id for r in preprocess.quality_control(e, 1, 2).collect()} == {2, 3}


def test_draws_with_fewer_labels_than_types(spark):
    cells = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(9)] + [(99, None)], "obs_id long, label string")
    for method in ("celltype", "cell"):
        d = mixture.draw_cells(cells, 50, 2, 15, 5, method)
        n = {r.spot: r["count"] for r in d.groupBy("spot").count().collect()}
        assert len(n) == 50 and all(2 <= v <= 15 for v in n.values())
        assert d.where("obs_id = 99").count() == 0
        assert sorted(map(tuple, d.collect())) == sorted(map(tuple, mixture.draw_cells(cells.repartition(7), 50, 2, 15, 5, method).collect()))
        f = mixture.pseudo_fractions(d).groupBy("spot").sum("value").collect()
        assert all(abs(r["sum(value)"] - 1) < 1e-9 for r in f)


def test_mixture_finds_blobs(spark):
    rng = np.random.default_rng(6)
    truth = np.repeat([0, 1, 2], 60)
    x = rng.standard_normal((180, 3)) + np.array([[0, 0, 0], [9, 0, 0], [0, 9, 9]])[truth]
    obs = cluster.tied_mixture(vec_table(spark, x), 3).collect()
    pairs = {(truth[r.obs_id], r.cluster) for r in obs}
    assert len(pairs) == 3


def community_tables(spark, pairs, n, slices=("a",)):
    rows = [(c, int(i), int(j), float(w)) for c in slices for i, j, w in pairs] + [(c, int(j), int(i), float(w)) for c in slices for i, j, w in pairs]
    return spark.createDataFrame(rows, "slice string, src long, dst long, w double"), spark.createDataFrame([(c, i) for c in slices for i in range(n)], "slice string, obs_id long")


def test_communities_are_cliques_whatever_the_partitions(spark):
    """Three cliques in a ring, an isolated node, two slices at once."""
    pairs = [(8 * c + i, 8 * c + j, 1.0) for c in range(3) for i in range(8) for j in range(i)] + [(8 * c, (8 * c + 9) % 24, 1.0) for c in range(3)]
    edges, nodes = community_tables(spark, pairs, 25, ("a", "b"))
    want = None
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = sorted(map(tuple, cluster.cluster_graph(edges.repartition(n), nodes.repartition(n)).select("slice", "obs_id", "cluster").collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert want in (None, got)
        want = got
    for s in "ab":
        label = {i: c for x, i, c in got if x == s}
        assert len(label) == 25 and len(set(label.values())) == 4 and all(len({label[8 * c + i] for i in range(8)}) == 1 for c in range(3)) and label[24] == 3


def test_communities_are_as_good_as_in_one_task(spark):
    """A neighbour graph of overlapping groups: modularity, connected communities, no node that would gain by a move."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((40, 4)) + 3 * rng.standard_normal(4) for _ in range(7)])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(d, axis=1)[:, 1:9]
    w = {tuple(sorted((i, int(j)))): float(np.exp(-d[i, j] / 4)) for i in range(len(x)) for j in near[i]}
    pairs = [(i, j, v) for (i, j), v in w.items()]
    edges, nodes = community_tables(spark, pairs, len(x))
    found = tables.written(cluster.cluster_graph(edges, nodes), "found")
    a = np.array([(i, j) for i, j, _ in pairs] + [(j, i) for i, j, _ in pairs])
    one = leiden(len(x), a[:, 0], a[:, 1], np.array([v for _, _, v in pairs] * 2))
    other = spark.createDataFrame([("a", i, int(c)) for i, c in enumerate(one)], "slice string, obs_id long, cluster int")
    q, q1 = (communities.modularity(edges, f).first().modularity for f in (found, other))
    assert q >= 0.98 * q1 and communities.improving_moves(edges, found).count() == 0
    assert communities.improving_moves(edges, other.withColumn("cluster", F.col("obs_id").cast("int"))).count() > 100
    label = {r.obs_id: r.cluster for r in found.collect()}
    for c in set(label.values()):
        own = {i for i in label if label[i] == c}
        reach, todo = set(), [min(own)]
        while todo:
            i = todo.pop()
            reach.add(i)
            todo += [j for p in w for i2, j in (p, p[::-1]) if i2 == i and j in own and j not in reach]
        assert reach == own


def test_leiden_in_one_task_finds_cliques():
    a = np.array([(8 * c + i, 8 * c + j) for c in range(3) for i in range(8) for j in range(8) if i != j])
    assert len(set(zip(leiden(24, a[:, 0], a[:, 1], np.ones(len(a))).tolist(), np.arange(24) // 8, strict=True))) == 3


def test_booster_and_lle(spark):
    rng = np.random.default_rng(7)
    x = rng.random((300, 3))
    y = np.where(x[:, 0] > 0.5, 1.0, 0.0) + x[:, 1]
    model = deconvolve.Booster(iters=80).fit(x, y)
    assert np.abs(model.predict(x) - y).mean() < 0.08
    ps = vec_table(spark, x[:50])
    comp = spark.createDataFrame([(i, t, float(v)) for i in range(50) for t, v in (("a", x[i, 0]), ("b", 1 - x[i, 0]))], "obs_id long, cell_type string, value double")
    out = deconvolve.deconvolve_lle(ps, ps, comp, k=5)
    assert all(abs(r["sum(value)"] - 1) < 1e-5 for r in out.groupBy("obs_id").sum("value").collect())
    with pytest.raises(ValueError, match="unknown method"):
        deconvolve.deconvolve(ps, ps, comp, "x")


def test_clr_softmax_round_trip(spark):
    comp = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.8), (2, "a", 0.0), (2, "b", 1.0)], "obs_id long, cell_type string, value double")
    back = {(r.obs_id, r.cell_type): r.value for r in deconvolve.softmax(deconvolve.clr_transform(comp)).collect()}
    for (o, t), v in {(1, "a"): 0.2, (1, "b"): 0.8, (2, "a"): 0.0, (2, "b"): 1.0}.items():
        assert abs(back[o, t] - (v + 1e-4) / (1 + 2e-4)) < 1e-6


def test_metrics_edges(spark):
    o = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, None, "y")], "obs_id long, t string, p string")
    assert metrics.adjusted_rand_index(o, "t", "p").first().ari == 1.0
    t = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", float("nan")), (2, "b", 1.0)], "obs_id long, cell_type string, value double")
    pair = metrics.paired(t, t)
    assert {r.obs_id for r in pair.collect()} == {1}
    assert abs(metrics.jsd_per_spot(pair).first().jsd) < 1e-9
    lone = spark.createDataFrame([(i, "only") for i in range(5)], "obs_id long, label string")
    lisi = spark.createDataFrame([(i, 1.0) for i in range(5)], "obs_id long, lisi double")
    assert {r.lisi for r in metrics.scale_lisi(lisi, lone).collect()} == {1.0}


def test_graph_neighbors_against_dijkstra(spark):
    x = np.random.default_rng(8).standard_normal((40, 2))
    df = vec_table(spark, x)
    got: dict = {}
    for r in metrics.graph_neighbors(df, 3, 7).collect():
        got.setdefault(r.src, set()).add(r.dst)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    w = np.full((40, 40), np.inf)
    for i in range(40):
        for j in np.argsort(d[i])[1:4]:
            w[i, j] = w[j, i] = d[i, j]
    np.fill_diagonal(w, 0)
    for k in range(40):
        w = np.minimum(w, w[:, k, None] + w[None, k, :])
    for i in range(40):
        near = [j for j in np.argsort(w[i], kind="stable") if j != i and w[i, j] < np.inf][:7]
        assert got.get(i, set()) == set(near)


def test_registration_recovers_a_turn(spark):
    rng = np.random.default_rng(9)
    a = rng.random((40, 2)) * 10
    turn = np.array([[0.8, -0.6], [0.6, 0.8]])
    b = a @ turn.T + [3, 1]
    v = np.abs(rng.standard_normal((40, 6)))
    rows = [("s0", i, *map(float, a[i]), [float(x) for x in v[i]]) for i in range(40)] + [("s1", 100 + i, *map(float, b[i]), [float(x) for x in v[i]]) for i in range(40)]
    df = spark.createDataFrame(rows, "slice string, obs_id long, x double, y double, vec array<double>")
    out = {r.obs_id: (r.px, r.py) for r in register.stack_slices(df.select("slice", "obs_id", "x", "y"), register.align_pairs(df)).collect()}
    assert max(np.hypot(out[i][0] - out[100 + i][0], out[i][1] - out[100 + i][1]) for i in range(40)) < 0.5


def test_registration_of_more_spots_than_cells(spark):
    """Cell means first, then single spots: a turn and shift are found to 1e-3, with smooth noisy expression and without a tenth of
    the copied spots."""
    rng = np.random.default_rng(15)
    a = rng.random((1500, 2)) * [80, 50]
    turn = np.array([[0.6, -0.8], [0.8, 0.6]])
    b = a @ turn.T + [30, -12]
    v = np.stack([1 + np.sin(a[:, 0] / 15), 1 + np.cos(a[:, 1] / 12), a[:, 0] / 40, a[:, 1] / 25, 1 + np.sin((a[:, 0] + a[:, 1]) / 20), *(0.1 * rng.random((2, 1500)))], 1)
    rows = [("s0", i, *a[i].tolist(), v[i].tolist()) for i in range(1500)] + [("s1", 10_000 + i, *b[i].tolist(), v[i].tolist()) for i in range(1500) if i % 10]
    df = spark.createDataFrame(rows, "slice string, obs_id long, x double, y double, vec array<double>")
    out = {r.obs_id: (r.px, r.py) for r in register.register(df, cells=300).collect()}
    assert len(out) == len(rows) and max(np.hypot(out[i][0] - out[10_000 + i][0], out[i][1] - out[10_000 + i][1]) for i in range(1500) if i % 10) < 1e-3


def test_loess_does_not_depend_on_order_and_takes_ties():
    rng = np.random.default_rng(21)
    x = np.round(rng.random(90), 1)
    y = 2 + x - 3 * x * x
    for order in (np.arange(90), rng.permutation(90)):
        assert np.allclose(preprocess.loess(x[order], y[order]), y[order], atol=1e-6)
    y = rng.random(90)
    fit, order = preprocess.loess(x, y), rng.permutation(90)
    assert np.allclose(preprocess.loess(x[order], y[order]), fit[order], atol=1e-9)
    x = np.sort(rng.random(1000))
    assert np.allclose(preprocess.loess(x, np.sin(x), 0.2), np.sin(x), atol=1e-3)


def test_imputer_gradient_by_differences():
    rng = np.random.default_rng(10)
    x, y = rng.random((4, 3, 5)), rng.random((4, 3))
    adj = rng.random((5, 5))
    shared = np.array([0, 2, 4])
    model = impute.GraphImputer(3, layers=2, hidden=4, seed=1)
    _, g = model.gradient(x, adj, y, shared, 0.5)
    for name, p in model.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        keep, h = p[at], 1e-6
        p[at] = keep + h
        up = impute.shared_loss(model.forward(x, adj)[:, shared], y, 0.5)[0]
        p[at] = keep - h
        down = impute.shared_loss(model.forward(x, adj)[:, shared], y, 0.5)[0]
        p[at] = keep
        assert abs((up - down) / (2 * h) - g[name][at]) < 1e-5, name


def test_imputer_gradient_with_dropout():
    rng = np.random.default_rng(12)
    x, y, adj, shared = rng.random((4, 3, 5)), rng.random((4, 3)), rng.random((5, 5)), np.array([0, 2, 4])
    model = impute.GraphImputer(3, layers=2, hidden=4, seed=1)
    drop = lambda: (0.3, np.random.default_rng(5))
    _, g = model.gradient(x, adj, y, shared, 0.5, None, drop())
    for name, p in model.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        keep, h, loss = p[at], 1e-6, []
        for v in (keep + h, keep - h):
            p[at] = v
            loss.append(impute.shared_loss(model.forward(x, adj, None, None, drop())[:, shared], y, 0.5)[0])
        p[at] = keep
        assert abs((loss[0] - loss[1]) / (2 * h) - g[name][at]) < 1e-5, name


def test_sparse_feature_graph_equals_dense(monkeypatch):
    """Products, and a model's loss and gradient, also where runs of one feature are cut and features have no edges."""
    rng = np.random.default_rng(12)
    adj = rng.random((9, 9)) * (rng.random((9, 9)) < 0.5)
    adj[4], adj[:, 7] = 0, 0
    src, dst = np.nonzero(adj)
    graph = impute.SparseGraph(src, dst, adj[src, dst], 9)
    x, y = rng.standard_normal((5, 3, 9)), rng.standard_normal((5, 4))
    model = impute.GraphImputer(3, layers=2, hidden=4)
    want = model.gradient(x, adj, y, np.arange(4), 0.5)
    for room in (1, 40, 1 << 22):
        monkeypatch.setattr(impute.SparseGraph, "ROOM", room)
        h = x.transpose(2, 0, 1)
        assert np.allclose(impute.mixed(graph, h), np.einsum("ij,jbk->ibk", adj, h))
        assert np.allclose(impute.mixed(graph.T, h), np.einsum("ji,jbk->ibk", adj, h))
        loss, g = model.gradient(x, graph, y, np.arange(4), 0.5)
        assert np.isclose(loss, want[0]) and all(np.allclose(g[n], want[1][n]) for n in g)
    assert not impute.SparseGraph(src[:0], dst[:0], adj[0, :0], 9).times(x.transpose(2, 0, 1)).any()


def test_imputer_with_many_features(spark):
    """30,000 features, whose dense graph would take 7 GB."""
    rng = np.random.default_rng(13)
    n = 30_000
    ids = F.col("id")
    edges = spark.range(n).select(ids.alias("src"), F.explode(F.array((ids + 1) % n, (ids * 7 + 3) % n)).alias("dst"), F.lit(1.0).alias("w")).where("src <> dst")
    graph = impute.feature_adjacency(edges, n)
    tensor = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((4, 2 * n)).tolist())], "obs_id long, f array<double>")
    truth = spark.createDataFrame([(i, v) for i, v in enumerate(rng.standard_normal((4, 50)).tolist())], "obs_id long, y array<double>")
    model, losses = impute.fit_imputer(tensor, truth, graph, list(range(50)), 2, epochs=3, hidden=4)
    assert len(losses) == 3 and losses[2] < losses[0]
    out = impute.predict_imputer(tensor, model, graph, [f"g{i}" for i in range(n)])
    assert out.count() == 4 * n


def test_imputer_learns(spark):
    rng = np.random.default_rng(11)
    base = rng.random((64, 6))
    f = np.stack([base + 0.05 * rng.standard_normal((64, 6)) for _ in range(3)], 1)
    t = spark.createDataFrame([(i, [float(v) for v in f[i].ravel()]) for i in range(64)], "obs_id long, f array<double>")
    y = spark.createDataFrame([(i, [float(v) for v in base[i, :4]]) for i in range(64)], "obs_id long, y array<double>")
    adj = np.full((6, 6), 1 / 6)
    model, losses = impute.fit_imputer(t, y, adj, [0, 1, 2, 3], 3, epochs=12, lr=0.02, hidden=8)
    assert losses[-1] < losses[0]
    assert impute.predict_imputer(t, model, adj, list("abcdef")).count() == 64 * 6
    _, shuffled = impute.fit_imputer(t, y, adj, [0, 1, 2, 3], 3, epochs=6, lr=0.02, hidden=8, mini_batches=4, dropout=0.1)
    assert len(losses) == 12 and len(shuffled) == 6 and shuffled[-1] < shuffled[0]
    with pytest.raises(ValueError):
        impute.fit_imputer(t, y, adj, [0], 3, spatial=t.withColumnRenamed("f", "s"), mini_batches=2)


def test_workflows_end_to_end(spark):
    from lattica.model import Bundle
    from lattica.plans import fixtures as fx
    from lattica.plans.facade import Study

    d = "/root/testdata/sf0.01"
    e, c = fx.expr(spark, d), fx.cells(spark, d)
    two = Bundle(e.where("slice IN ('s0', 's1')"), c.where("slice IN ('s0', 's1')"))
    ppi = fx.interactions(spark, d)
    s = Study(spark).load(two, n_top=40).align_genes().build_slices().build_spatial_graph(30.0, 10.0).build_gene_graph(ppi, 3).fit(rank=4, iters=1).attach_embeddings()
    assert s.cluster_mixture(3, per_slice=False).clusters.count() == s.rows.count()
    s = Study(spark).load(Bundle(e.where("slice = 's0'"), c.where("slice = 's0'")), n_top=40).load_reference(Bundle(e.where("slice = 's1'"), c.where("slice = 's1'")))
    s.generate_pseudo_spots(60).prepare_pseudo(40).align_genes(use_hvg=False).build_slices().build_joint_embedding(40, 8).build_reference_graph(30.0, 5).build_gene_graph(ppi, 3)
    s.fit(rank=4, iters=1).attach_embeddings().deconvolve("lle", k=5)
    both, cut = s.smooth_deconvolution()
    assert both.count() == s.estimate.count() and cut.count() > 0
    with pytest.raises(RuntimeError, match="comes first"):
        Study(spark).fit()


def test_imputation_workflow(spark):
    from pyspark.sql import functions as F

    from lattica.model import Bundle
    from lattica.plans import fixtures as fx
    from lattica.plans.facade import Study

    d = "/root/testdata/sf0.001"
    e, c = fx.expr(spark, d).where("gene < 'Brand#2'"), fx.cells(spark, d)
    held = e.select("gene").distinct().orderBy("gene").limit(3)
    seen = e.join(F.broadcast(held), "gene", "left_anti")
    s = Study(spark).load(Bundle(seen.where("obs_id % 2 = 0"), c.where("obs_id % 2 = 0")), n_top=500).load_reference(Bundle(e.where("obs_id % 2 = 1"), c.where("obs_id % 2 = 1")))
    s.st.expr = s.st.expr.withColumn("slice", F.lit("st"))
    s.st.obs, s.st.counts = s.st.obs.withColumn("slice", F.lit("st")), s.st.counts.withColumn("slice", F.lit("st"))
    s.generate_pseudo_spots(40)
    full = s.pseudo.expr
    s.pseudo.expr = full.join(F.broadcast(held), "gene", "left_anti")
    s.prepare_pseudo(500)
    s.var = s.var.withColumn("slice", F.when(F.col("slice") == "pseudo", "pseudo").otherwise("st")).dropDuplicates(["slice", "gene"])
    s.align_genes(use_hvg=False).build_slices().build_joint_embedding(30, 5).build_reference_graph(200.0, 4)
    s.build_gene_graph(fx.interactions(spark, d), 1).fit(rank=3, iters=1).attach_embeddings()
    s.build_imputation_graph(full.join(F.broadcast(held), "gene", "left_semi"), knn_k=3, k_gnn=4, radius=300.0).fit_imputer(epochs=2, hidden=4)
    out = s.predict_imputation(alpha=0.9)
    assert out.count() == s.st.obs.count() * len(s.impute_genes) and len(s.impute_genes) == s.n_shared + 3
    s.release()


def test_pivot_search_ships_a_row_once_a_shelf_and_scores_in_pieces(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16))
    x[300:] = x[:300]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obs_id long, vec array<double>")
    asked, deal = [], Classic.repartitionById
    monkeypatch.setattr(Classic, "repartitionById", lambda self, *a: (asked.append(self.where("side = 1").count()), deal(self, *a))[1])
    got = {(r.src, r["rank"]): r.dst for r in graphs.knn(rows, rows, 5, "euclidean", exclude_self=True, block_rows=10).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {(i, n + 1): int(j) for i in range(600) for n, j in enumerate(np.lexsort((np.arange(600), d[i].round(9)))[:5])}
    assert asked[0] == 600 and asked[1] <= 600
    assert nearest.together(65_536) * 65_536 <= 1 << 21
    s = rng.integers(0, 40, (7, 1000)).astype(float)
    i, j = nearest.best(s, 6, np.full(7, -np.inf))
    assert [sorted(j[i == a]) for a in range(7)] == [sorted(np.argsort(-s[a], kind="stable")[:6]) for a in range(7)]


def test_leading_vectors_make_their_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    x = np.random.default_rng(3).standard_normal((200, 40))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").mapInArrow(count, "x array<double>")
    values, _ = linalg.leading(rows, "x", np.zeros(40), 3)
    assert np.allclose(values, np.linalg.eigvalsh(x.T @ x)[::-1][:3]) and made.value == 200


def test_radius_laplacian_and_adjacency_shuffle_no_edges(spark):
    rng = np.random.default_rng(8)
    p = spark.createDataFrame([(f"s{i % 3}", i, *map(float, rng.integers(0, 30, 2))) for i in range(300)], "slice string, obs_id long, x double, y double").selectExpr("*", "x AS px", "y AS py")

    def rows(df):
        return sorted((r.src, r.dst, round(r.w, 9)) for r in df.collect())

    twice = p.union(p.where("obs_id < 40"))  # ids that repeat
    for points in (p, twice):
        lap = graphs.laplacian(graphs.radius_graph(points, 6.0))
        assert rows(graphs.radius_laplacian(points, 6.0)) == rows(lap)
        assert rows(graphs.radius_laplacian(points, 6.0, normalized=True)) == rows(graphs.normalize_laplacian(lap))
        assert rows(graphs.radius_adjacency(points, 6.0)) == rows(graphs.row_normalize(graphs.radius_graph(points, 6.0)))
        assert rows(graphs.radius_laplacian(points, 6.0, 3.0)) == rows(graphs.laplacian(graphs.spatial_graph(points, 6.0, 3.0)))
    for df in (graphs.radius_laplacian(p, 6.0, 3.0), graphs.radius_laplacian(p, 6.0, normalized=True), graphs.radius_adjacency(p, 6.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" not in plan and "Window" not in plan and plan.count("Join") <= 7


def test_radius_products_equal_those_over_edges(spark, monkeypatch):
    monkeypatch.setattr(graphs, "PIECE", 64)
    rng = np.random.default_rng(9)
    p = spark.createDataFrame([(f"s{i % 3}", i, *map(float, rng.integers(-20, 60, 2))) for i in range(300)], "slice string, obs_id long, x double, y double")
    twice = p.union(p.where("obs_id < 40"))  # ids that repeat
    v = p.selectExpr("obs_id", "explode(array('a', 'b', concat('g', cast(obs_id % 7 AS string)))) AS key", "cast(obs_id % 5 AS double) AS value").where("obs_id % 4 > 0")
    cells = lambda df: sorted((r.obs_id, r.key, round(r.value, 9)) for r in df.collect())
    for points in (p, twice):
        assert cells(graphs.radius_multiply(points, 6.0, v)) == cells(graphs.multiply(graphs.radius_graph(points, 6.0), v))
        t = v.where("key = 'a'")
        assert cells(graphs.radius_smooth(points, 6.0, t)) == cells(graphs.smooth(graphs.radius_graph(points, 6.0), t))


def test_row_graph_takes_neighbours_together():
    """Most entries of a graph of points in the plane lie in dense pieces; products equal those of the whole matrix."""
    rng = np.random.default_rng(3)
    at = rng.uniform(0, 12, (900, 2))
    near = ((at[:, None] - at[None]) ** 2).sum(2) <= 1
    np.fill_diagonal(near, False)
    near[5] = near[:, 5] = False
    for w in (1.0, 0.3, 300.0):
        lap = np.diag(near.sum(1) * w) - near * w
        src, dst = np.nonzero(lap)
        mix = rng.permutation(len(src))
        graph = row_solve.RowGraph(900, src[mix], dst[mix], lap[src, dst][mix])
        y = rng.standard_normal((4, 900))
        np.testing.assert_allclose(graph.times(y), y @ lap, atol=1e-9 * w)
        assert sum(np.count_nonzero(d) for _, _, d in graph.pieces) > 0.9 * near.sum()
        assert (graph.pieces[0][2].dtype == np.int8) == (w == 1.0)
    src, dst = rng.integers(0, 4000, (2, 8000))  # nothing near: entries stay
    graph = row_solve.RowGraph(4000, src, dst, np.ones(8000))
    want = np.zeros((2, 4000))
    y = rng.standard_normal((2, 4000))
    np.add.at(want.T, src, y.T[dst])
    np.testing.assert_allclose(graph.times(y), want, atol=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_search_in_single_precision_is_exact(monkeypatch, metric):
    """The k best equal those of all scores in double precision, where single precision can't tell rows apart too; only then are
    all scores found."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((3000, 16))
    close = base[:1] + 1e-9 * rng.standard_normal((300, 16))
    full, calls = nearest.scores, []
    monkeypatch.setattr(nearest, "scores", lambda *a: calls.append(1) or full(*a))
    for rows in (base, np.concatenate([base, close]), base + 1e5, np.concatenate([base, np.zeros((5, 16))]), base[:7], base * 1e25):
        rows = nearest.scaled(rows, metric)
        ids = np.arange(len(rows))
        q = rows[:40]
        table = nearest.Table(rows, metric, 1)
        calls.clear()
        i, j, s = table.nearest(q, 5, np.full(len(q), -np.inf), lambda i, j: ids[i] != ids[j])
        assert bool(calls) == (np.abs(rows).max() > 1e20)
        want = -np.sqrt(((q[:, None] - rows[None]) ** 2).sum(2)) if metric == "euclidean" else np.einsum("ik,jk->ij", q, rows)
        want[ids[: len(q), None] == ids[None]] = -np.inf
        top = -np.sort(-want, axis=1)[:, :5]
        atol = (1e-6 if calls else 1e-9) * max(1.0, np.abs(top).max())
        assert (np.bincount(i) == 5).all()
        np.testing.assert_allclose(s.reshape(-1, 5), top, rtol=0, atol=atol)
        np.testing.assert_allclose(want[i, j], s, rtol=0, atol=atol)


def test_dense_rows_are_filled_in_arrays(spark):
    """Equal to a dense table, repeated cells added up, null as 0; no map is searched for each feature."""
    cells = [("a", 1, "g0", 2.0), ("a", 1, "g2", 1.5), ("a", 1, "g0", 1.0), ("b", 2, "g1", None), ("b", 3, "g1", -1.0), ("b", 4, "other", 1.0)]
    genes = spark.createDataFrame([(0, "g0"), (1, "g1"), (2, "g2")], "gene_id int, gene string")
    out = preprocess.dense_rows(spark.createDataFrame(cells, "slice string, obs_id long, gene string, value double"), genes)
    assert {tuple(r)[:2]: r.x for r in out.collect()} == {("a", 1): [3.0, 0.0, 1.5], ("b", 2): [0.0, 0.0, 0.0], ("b", 3): [0.0, -1.0, 0.0]}
    assert "map_from_entries" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_reference_graph_carries_degrees(spark, monkeypatch):
    """Equal to the Laplacian of all edges, which is made only where pairs could be of both kinds."""
    rng = np.random.default_rng(8)
    n = 60
    emb = spark.createDataFrame([(i, rng.standard_normal(4).tolist(), "st" if i % 2 else "ps") for i in range(n)], "obs_id long, vec array<double>, domain string").cache()
    rows = lambda df: {(r.src, r.dst): round(r.w, 9) for r in df.collect()}
    full, calls = graphs.laplacian, []
    monkeypatch.setattr(graphs, "laplacian", lambda e: calls.append(1) or full(e))
    for step, general in ((2, False), (1, True)):
        points = spark.createDataFrame([("st", i, float(i * 7 % 10), float(i * 3 % 11)) for i in range(1, n, step)], "slice string, obs_id long, x double, y double").cache()
        dom = {r.obs_id: r.domain for r in emb.collect()}
        mutual = [(r.src, r.dst, r.w) for r in graphs.mutual_knn(emb, 5).collect() if dom[r.src] != "st" or dom[r.dst] != "st"]
        both = graphs.radius_graph(points, 2.5).unionAll(spark.createDataFrame(mutual, "src long, dst long, w double"))
        want = rows(graphs.normalize_laplacian(full(both)))
        calls.clear()
        assert rows(graphs.reference_graph(points, emb, 2.5, 5)) == want and bool(calls) == general


def test_imputer_trains_in_single_precision():
    """No step of the gradient falls back to double precision, and it is that of double precision to 4 digits."""
    rng = np.random.default_rng(6)
    net, x, y = impute.GraphImputer(3, 2, 8), rng.standard_normal((10, 3, 6)), rng.standard_normal((10, 4))
    adj = rng.random((6, 6)) * (rng.random((6, 6)) < 0.5)
    src, dst = np.nonzero(adj)
    sparse = impute.SparseGraph(src, dst, adj[src, dst], 6)
    loss, g = net.gradient(x, adj, y, np.arange(4), 0.5)
    for graph in (adj.astype(np.float32), sparse.single()):
        few, own = net.single().gradient(x.astype(np.float32), graph, y, np.arange(4), 0.5)
        assert abs(few - loss) < 1e-4 * abs(loss) and all(v.dtype == np.float32 for v in own.values())
        for n, v in own.items():
            np.testing.assert_allclose(v, g[n], rtol=0, atol=1e-4 * max(1e-3, np.abs(g[n]).max()))


def test_local_weights_hold_a_few_rows_at_once():
    """A batch of 10,000 rows takes no more memory than its first rows, and its result is that of the rows one by one."""
    rng = np.random.default_rng(3)
    n, k, d, types = 10_000, 10, 64, 4
    counts = np.where(np.arange(n) % 7, k, k - 3)
    lists = lambda x: pa.array([v.ravel() for v in x], pa.list_(pa.float64()))
    x, v, y = rng.standard_normal((n, d)), [rng.standard_normal((m, d)) for m in counts], [rng.random((m, types)) for m in counts]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists(x), lists(v), lists(y), pa.array(counts)], names=["obs_id", "x", "v", "y", "k"])
    got = {}
    tracemalloc.start()
    for out in deconvolve.mixed([batch], types, 1e-3):
        got |= dict(zip(out.column("obs_id").to_pylist(), out.column("y").to_pylist(), strict=True))
        if len(got) < 500:
            first = tracemalloc.get_traced_memory()[1]
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n and held < first + 16e6  # the results themselves are 4 MB
    for i in (0, 1, 7, n - 1):
        alone = next(deconvolve.mixed([batch.slice(i, 1)], types, 1e-3)).column("y")[0].as_py()
        assert np.allclose(got[i], alone, rtol=0, atol=1e-12)


def test_a_round_of_moves_shuffles_an_edge_twice(spark):
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges, nodes = community_tables(spark, [(0, 1, 1.0), (1, 2, 1.0)], 4)
        every, base, scale = communities._numbered(edges, nodes)
        g = communities.Graph(communities._with_degrees(every, base), scale, 1.0, 0)
        labels = tables.written(base.selectExpr("sl", "u", "d", "u AS c"), "labels")
        plan = communities.best_moves(g, labels)._jdf.queryExecution().executedPlan()
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)

    def exchanges(node, above=0):
        """How many exchanges lie over each scan of the edges."""
        above += node.nodeName() == "Exchange"
        below = [node.children().apply(i) for i in range(node.children().size())]
        if not below:
            return [above] if "w#" in node.output().mkString(",") else []
        return [n for b in below for n in exchanges(b, above)]

    assert exchanges(plan) == [2]


def test_fuzzy_weights_are_those_of_single_rows():
    def one(d, k):  # a row by itself
        rho, lo, hi, goal, sigma = min(d[d > 0], default=0.0), 0.0, np.inf, np.log2(max(2, k)), 1.0
        for _ in range(64):
            total = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
            if abs(total - goal) < 1e-5:
                break
            if total > goal:
                hi, sigma = sigma, (lo + sigma) / 2
            else:
                lo, sigma = sigma, sigma * 2 if hi == np.inf else (sigma + hi) / 2
        return np.exp(-np.maximum(d - rho, 0) / max(sigma, 1e-3 * max(d.mean(), 1e-12)))

    rng = np.random.default_rng(4)
    for k in (1, 3, 10):
        d = np.sort(rng.random((300, k)) * 10.0 ** rng.integers(-3, 3, (300, 1)), 1)
        d[:20, : (k + 1) // 2] = 0
        d[20:25] = 0
        assert np.allclose(cluster.fuzzy_weights(d, 10), [one(r, 10) for r in d], rtol=1e-12, atol=0)


def test_communities_of_many_slices_do_not_meet(spark):
    """The same graph in two slices, ids shared: each slice has the communities that it has by itself, also a slice without a name."""
    pairs = [(i, j, 1.0) for b in (0, 6) for i in range(b, b + 6) for j in range(i + 1, b + 6)] + [(0, 6, 1.0)]
    edges, nodes = community_tables(spark, pairs, 13, ("a", "b"))
    unnamed = lambda df: df.unionByName(df.where("slice = 'a'").withColumn("slice", F.lit(None).cast("string")))
    found = communities.communities(unnamed(edges), unnamed(nodes)).toPandas()
    for _, own in found.groupby("slice", dropna=False):
        c = own.sort_values("obs_id")["cluster"].tolist()
        assert len(c) == 13 and len(set(c[:6])) == len(set(c[6:12])) == 1 and sorted({c[0], c[6], c[12]}) == [0, 1, 2]
    assert found["slice"].nunique(dropna=False) == 3


def test_a_node_without_an_id_keeps_its_row(spark):
    pairs = [(i, j, 1.0) for b in (0, 5) for i in range(b, b + 5) for j in range(i + 1, b + 5)] + [(0, 5, 0.5)]
    edges, nodes = community_tables(spark, pairs, 11)
    blank = lambda c: F.when(F.col(c) != 3, F.col(c)).alias(c)
    found = communities.communities(edges.select("slice", blank("src"), blank("dst"), "w"), nodes.select("slice", blank("obs_id"))).toPandas()
    at = {None if c != c else int(c): k for c, k in zip(found["obs_id"], found["cluster"], strict=True)}
    assert len(found) == 11 and at[None] == at[0] == at[4] and at[5] == at[9] and len({at[0], at[5], at[10]}) == 3


@pytest.mark.parametrize("block_rows", [None, 40])
def test_disks_equal_the_laplacian_of_edges(spark, block_rows):
    """Two slices in one plane; some rows have no point, some points are no rows but count in degrees. No edge is listed."""
    rng = np.random.default_rng(40)
    n = 150
    at = rng.integers(0, 40, (n, 2)).astype(float)
    points = spark.createDataFrame([("a" if i % 3 else "b", i, float(at[i, 0]), float(at[i, 1])) for i in range(n) if i % 29], "slice string, obs_id long, x double, y double").withColumns({"px": F.col("x"), "py": F.col("y")})
    rows = tables.written(spark.createDataFrame([(i, i, rng.standard_normal(4).tolist(), rng.standard_normal(4).tolist()) for i in range(n) if i % 11], "obs_id long, gid long, r array<double>, z array<double>").repartition(3), "rows")
    own, k = row_solve.tiles(rows, points, n, block_rows)
    own = tables.written(own, "rows")
    disks = graphs.row_graph(points, 4.0, 2.0)
    assert isinstance(disks, row_solve.Disks)
    blocks = row_solve.cut_disks(own, disks, k, 1)
    assert (blocks.members is None) == (block_rows is None) and blocks.n == k
    edges = graphs.radius_laplacian(points, 4.0, 2.0).collect()
    lap = np.zeros((n, n))
    for e in edges:
        lap[e.src, e.dst] += e.w
    keep = [i for i in range(n) if i % 11]
    lap = lap[np.ix_(keep, keep)]
    held = {x.gid: x for x in rows.collect()}
    r, z = (np.array([held[i][c] for i in keep]) for c in ("r", "z"))
    got = {x.gid: x.z for x in row_solve.multiply(blocks, own.select("gid", "block", F.col("z").alias("y")), 4).collect()}
    assert np.abs(np.array([got[i] for i in keep]) - lap @ z).max() < 1e-9
    shift = np.array([0.05, 1.0, 3.0, 150.0])
    got = {x.gid: x.z for x in row_solve.solve(blocks, own.select("gid", "block", "r", "z"), shift, 0.5).collect()}
    want = np.stack([np.linalg.solve(shift[j] * np.eye(len(keep)) + lap, r[:, j]) for j in range(4)], 1)
    assert len(got) == len(keep) and np.abs(np.array([got[i] for i in keep]) - want).max() < 1e-6 * np.abs(want).max()


@pytest.mark.parametrize("many", [False, True])
def test_disk_graph_in_bits_and_runs_equals_pairs(many, monkeypatch):
    """Points in a lattice, some on one place, some far off, and given ones, whose rows are not in the matrix."""
    rng = np.random.default_rng(41)
    monkeypatch.setattr(row_solve.DiskGraph, "MANY", 0 if many else 1e9)
    monkeypatch.setattr(row_solve.DiskGraph, "BYTES", 0 if many else 1 << 26)
    x, y = rng.integers(0, 30, (2, 400)).astype(float)
    x[:50], y[:50], x[50] = 3.0, 4.0, 9000.0
    s, solved = rng.integers(-1, 3, 400), rng.random(400) < 0.8
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= np.where(s[:, None] == s, 25.0, 9.0)
    near &= (s[:, None] >= 0) & (s >= 0)
    np.fill_diagonal(near, False)
    lap = (np.diag(near.sum(1)) - near) * solved[:, None]
    g = row_solve.DiskGraph(x, y, s, 5.0, 3.0, solved)
    v = rng.standard_normal((3, 400))
    assert np.abs(g.times(v[:, g.order])[:, g.back] - v @ lap.T).max() < 1e-9


def test_descent_ships_only_what_can_meet(spark, monkeypatch):
    """Nodes without a fresh member take no part in a round; vectors of single precision travel as such; results stay whole."""
    x = np.random.default_rng(42).standard_normal((900, 6)).astype(np.float32).astype(float)
    seen, meet = [], descent._meet

    def spied(metric):
        run = meet(metric)

        def checked(batches):
            def look():
                for batch in batches:
                    kind = batch.column("m").type.value_type
                    assert kind.field("vec").type.value_type == pa.float32()
                    assert all(any(m["fresh"] for m in node) for node in batch.column("m").to_pylist())
                    yield batch

            yield from run(look())

        seen.append(1)
        return checked

    monkeypatch.setattr(descent, "_meet", spied)
    got: dict = {}
    for r in graphs.knn_by_descent(vec_table(spark, x), 5).collect():
        got.setdefault(r.src, {})[r.dst] = r.score
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    best = np.argsort(-s, axis=1)[:, :5]
    assert len(seen) > 1 and all(abs(v - s[i, j]) < 1e-12 for i, own in got.items() for j, v in own.items())
    assert sum(j in got[i] for i in range(900) for j in best[i].tolist()) >= 0.99 * 4500


def test_points_take_fewer_products_and_their_graph_is_made_once(monkeypatch):
    """What is smooth over the plane is solved for on coarse cells; sweeps and groups of columns share a worker's graph."""
    rng = np.random.default_rng(43)
    x, y = rng.random((2, 3000)) * 80
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 25.0
    np.fill_diagonal(near, False)
    lap = np.diag(near.sum(1)) - near.astype(float)
    src, dst = np.nonzero(lap)
    shift, rhs = np.array([0.05, 2.0]), rng.standard_normal((3000, 2)) + 5
    counts, found = [], []
    for graph in (row_solve.RowGraph(3000, src, dst, lap[src, dst]), row_solve.DiskGraph(x, y, np.zeros(3000, int), 5.0, 0.0)):
        times, calls = graph.times, []
        monkeypatch.setattr(graph, "times", lambda v, times=times, calls=calls: calls.append(1) or times(v))
        found.append(row_solve.solve_columns(graph, shift, 0.5, rhs, np.zeros((3000, 2)))[0])
        counts.append(len(calls))
    assert np.abs(found[0] - found[1]).max() < 1e-5 and counts[1] < counts[0] / 2
    row = {"block": 0, "gids": np.arange(3000).tobytes(), "hops": np.zeros(3000, np.int8).tobytes(), "a": x.tobytes(), "b": y.tobytes(), "c": np.zeros(3000, np.int32).tobytes()}
    assert row_solve._unpacked(row, "one", (5.0, 0.0))[3] is row_solve._unpacked(row, "one", (5.0, 0.0))[3]
    assert row_solve._unpacked(row, "two", (5.0, 0.0))[3] is row_solve._unpacked(row, "two", (5.0, 0.0))[3]
