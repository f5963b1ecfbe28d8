import pytest
from compare import connection, same

from lattica.operators import factorize, graphs, impute
from lattica.plans import fixtures as fx
from lattica.plans.queries import QUERIES, SQL, entry

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(D)


#: Slow ones whose operators have tests of their own, on fixtures, in test_algebra.
SLOW = {"leiden_local_optimum", "factorize_optimality", "register_turned_copy"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, D), con, SQL[name])


@pytest.mark.parametrize("name", ["joint_pca", "ridge_factors", "lle_deconvolve"])
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_reading_some_slices_prunes_the_others(spark):
    plan = QUERIES["bundle_slices"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slice" in plan or "PartitionFilters: [slice" in plan


def test_entry(spark):
    assert entry(spark, D).count() > 0


def test_register_slices_returns_every_spot(spark):
    assert QUERIES["register_slices"](spark, D).count() == spark.read.parquet(f"{D}/embeddings.parquet").count() > 200


def test_factorize_embedding_takes_all_slices_and_genes_at_the_defaults(spark, monkeypatch):
    asked = {}

    def fit(rows, row_laplacian, gene_laplacian, **options):
        asked.update(rows=rows, options=options)

    monkeypatch.setattr(factorize, "fit", fit)
    monkeypatch.setattr(factorize, "embeddings", lambda f: f)
    QUERIES["factorize_embedding"](spark, D)
    e = fx.expr(spark, D).select("slice", "obs_id", "gene").toPandas()
    common = e.groupby("gene")["slice"].nunique()
    common = set(common[common == e["slice"].nunique()].index)
    got = asked["rows"].selectExpr("slice", "obs_id", "size(x) AS n").toPandas()
    assert asked["options"] == {} and set(got["n"]) == {len(common)}
    assert set(zip(got["slice"], got["obs_id"], strict=True)) == set(zip(e["slice"], e["obs_id"], strict=True))


def test_graph_imputer_uses_all_components(spark, monkeypatch):
    asked, fit = {}, impute.fit_imputer

    def fewer(tensor, truth, adj, shared, k, **options):
        asked.update(adj=adj, shared=shared, options=options)
        return fit(tensor, truth, adj, shared, k, **{**options, "epochs": 1})  # the test trains one epoch only

    monkeypatch.setattr(impute, "fit_imputer", fewer)
    got = QUERIES["graph_imputer"](spark, D)
    e = fx.emb(spark, D)
    n = len(e.first()["vec"])
    assert got.count() == e.where("dom = 1").count() * n
    assert asked["adj"].shape == (n, n) and (asked["adj"] > 0).any(1).all()
    assert asked["shared"] == list(range(n)) and asked["options"] == {}


def test_f1_lisi_searches_once(spark, monkeypatch):
    knn, calls = graphs.knn, []
    monkeypatch.setattr(graphs, "knn", lambda *a, **k: calls.append(1) or knn(*a, **k))
    assert QUERIES["f1_lisi"](spark, D).count() > 0 and len(calls) == 1


@pytest.mark.parametrize("name", ["densify_slices", "feature_neighbor_means"])
def test_counts_are_found_once(spark, name):
    assert "l_orderkey" not in QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
