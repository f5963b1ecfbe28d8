"""The three workflows as chains of operators. A Study holds DataFrames; every step returns the study itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.model import Bundle
from lattica.operators import cluster, deconvolve, factorize, graphs, impute, mixture, preprocess, register
from lattica.operators.linalg import principal_components
from lattica.plans.tables import written
from lattica.sources import readers

#: Ids of pseudo-spots start here, so that they never meet ids of spots.
PSEUDO = 1 << 40


class Study:
    """Integration of slices (load, align, graphs, fit, cluster), composition estimation from labelled single cells, and
    imputation. Spots without counts are dropped before graphs and slices alike, so that their rows always agree."""

    def __init__(self, spark: SparkSession, seed: int = 0):
        self.spark, self.seed = spark, seed
        self.emb: DataFrame | None = None

    def _need(self, **steps) -> None:
        for what, value in steps.items():
            if value is None:
                raise RuntimeError(f"{what} comes first")

    # --- data
    def load(self, source: Bundle | dict[str, str], n_top: int = 7500, flavor: str = "seurat_v3", domain: str | None = None) -> Study:
        """Spots: quality control, feature selection, normalisation; spots without a domain go after that."""
        b = source if isinstance(source, Bundle) else readers.load_slices(self.spark, source)
        b, self.var = self._prepare(b, n_top, flavor)
        self.st = readers.drop_unlabelled(b, domain) if domain else b
        return self

    def _prepare(self, b: Bundle, n_top: int, flavor: str) -> tuple[Bundle, DataFrame]:
        counts = written(preprocess.quality_control(b.expr), "counts")
        ids = counts.select("slice", "obs_id").distinct()
        obs = b.obs.join(ids, ["slice", "obs_id"], "left_semi")
        norm = preprocess.log1p(preprocess.normalize_total(counts))
        var = None
        for r in obs.select("slice").distinct().orderBy("slice").collect():
            one, own = (counts if flavor == "seurat_v3" else norm).where(F.col("slice") == r[0]), obs.where(F.col("slice") == r[0])
            h = {"seurat_v3": preprocess.hvg_counts, "seurat": preprocess.hvg_dispersion, "cell_ranger": preprocess.hvg_percentiles}[flavor](one, own, n_top)
            h = h.select(F.lit(r[0]).alias("slice"), "gene", (F.row_number().over(Window.orderBy("gene")) - 1).alias("position"), "highly_variable")
            var = h if var is None else var.unionAll(h)
        return Bundle(norm, obs, counts=counts), written(var, "var")

    def load_reference(self, cells: Bundle, label: str = "label") -> Study:
        """Labelled single cells; rows with a null label are never drawn."""
        self.cells, self.label = cells, label
        self.labels = readers.label_dictionary(cells.obs, label)
        return self

    def generate_pseudo_spots(self, spots: int = 5000, low: int = 2, high: int = 15, max_types: int = 3, method: str = "celltype") -> Study:
        self._need(load_reference=getattr(self, "cells", None))
        draws = written(mixture.draw_cells(self.cells.obs, spots, low, high, max_types, method, self.seed, self.label), "draws")
        shift = (F.col("spot") + F.lit(PSEUDO)).alias("obs_id")
        counts = mixture.pseudo_counts(draws, self.cells.expr).select(F.lit("pseudo").alias("slice"), shift, "gene", "value")
        self.comp = written(mixture.pseudo_fractions(draws).select(shift, "cell_type", "value"), "comp")
        self.pseudo = Bundle(written(counts, "pseudo"), self.comp.select(F.lit("pseudo").alias("slice"), "obs_id").distinct())
        return self

    def prepare_pseudo(self, n_top: int = 7500, flavor: str = "seurat_v3") -> Study:
        self._need(generate_pseudo_spots=getattr(self, "pseudo", None))
        self.ps, var = self._prepare(self.pseudo, n_top, flavor)
        self.var = self.var.unionByName(var)
        return self

    def align_genes(self, use_hvg: bool = True) -> Study:
        self.genes = written(preprocess.align_genes(self.var, use_hvg), "genes")
        return self

    def build_slices(self) -> Study:
        """Dense rows over the aligned features; an observation without any of them gets zeros."""
        self._need(align_genes=getattr(self, "genes", None))
        expr, obs = self.st.expr, self.st.obs.select("slice", "obs_id")
        if getattr(self, "ps", None) is not None:
            expr, obs = expr.unionByName(self.ps.expr.select(*expr.columns)), obs.unionAll(self.ps.obs.select("slice", "obs_id"))
        g = self.genes.count()
        rows = obs.join(preprocess.dense_rows(expr, self.genes), ["slice", "obs_id"], "left")
        self.rows = written(rows.select("slice", "obs_id", F.coalesce("x", F.array_repeat(F.lit(0.0), g)).alias("x")), "slices")
        return self

    # --- graphs
    def align_coordinates(self, alpha: float = 0.1) -> Study:
        self._need(build_slices=getattr(self, "rows", None))
        at = self.st.obs.select("slice", "obs_id", "x", "y")
        rows = at.join(self.rows.select("slice", "obs_id", F.col("x").alias("vec")), ["slice", "obs_id"])
        placed = register.register(rows, alpha)
        self.st.obs = written(self.st.obs.drop("px", "py").join(placed.select("obs_id", "px", "py"), "obs_id"), "aligned")
        return self

    def build_spatial_graph(self, radius_intra: float, radius_inter: float) -> Study:
        points = self.st.obs if "px" in self.st.obs.columns else self.st.obs.withColumns({"px": F.col("x"), "py": F.col("y")})
        self.row_graph = written(graphs.laplacian(graphs.spatial_graph(points, radius_intra, radius_inter)), "row-graph")
        return self

    def build_joint_embedding(self, n_top: int = 7500, n_pcs: int = 50) -> Study:
        """Principal components of spots and pseudo-spots together, over features selected by both."""
        both = preprocess.concat_domains({"st": self.st.counts, "ps": self.ps.counts}).withColumn("slice", F.col("domain"))
        obs = self.st.obs.select(F.lit("st").alias("slice"), "obs_id").unionAll(self.ps.obs.select(F.lit("ps").alias("slice"), "obs_id"))
        top = preprocess.hvg_counts(both, obs, n_top).where("highly_variable")
        genes = top.select((F.row_number().over(Window.orderBy("gene")) - 1).cast("int").alias("gene_id"), "gene")
        norm = preprocess.log1p(preprocess.normalize_total(both))
        rows = preprocess.dense_rows(norm, genes)
        vec, _, _ = principal_components(rows, min(n_pcs, max(1, genes.count() - 1)))
        self.joint = written(vec.select("obs_id", F.col("slice").alias("domain"), "vec"), "joint")
        return self

    def build_reference_graph(self, radius: float, k: int = 20, metric: str = "cosine") -> Study:
        self._need(build_joint_embedding=getattr(self, "joint", None))
        self.row_graph = written(graphs.reference_graph(self.st.obs, self.joint, radius, k, metric), "row-graph")
        return self

    def build_gene_graph(self, interactions: DataFrame, threshold: int = 650, case: str = "upper") -> Study:
        self._need(align_genes=getattr(self, "genes", None))
        self.gene_graph = graphs.laplacian(graphs.interaction_graph(interactions, self.genes, threshold, case))
        return self

    # --- factorization
    def fit(self, rank: int = 30, gamma: float = 0.5, iters: int = 50, rho: float = 1.0, tol: float = 1e-5) -> Study:
        self._need(build_slices=getattr(self, "rows", None), row_graph=getattr(self, "row_graph", None), build_gene_graph=getattr(self, "gene_graph", None))
        self.factors = factorize.fit(self.rows, self.row_graph, self.gene_graph, rank, gamma, iters, rho, tol, self.seed)
        return self

    def attach_embeddings(self) -> Study:
        self._need(fit=getattr(self, "factors", None))
        self.emb = written(factorize.embeddings(self.factors), "embeddings")
        return self

    def _part(self, pseudo: bool) -> DataFrame:
        self._need(attach_embeddings=self.emb)
        return self.emb.where((F.col("slice") == "pseudo") if pseudo else (F.col("slice") != "pseudo"))

    # --- results
    def cluster_leiden(self, n_neighbors: int = 10, resolution: float = 1.0, per_slice: bool = True) -> Study:
        self.clusters = cluster.cluster_leiden(self._part(False).select("slice", "obs_id", "vec"), n_neighbors, resolution, per_slice, self.seed)
        return self

    def cluster_mixture(self, k: int, per_slice: bool = True) -> Study:
        self.clusters = cluster.cluster_mixture(self._part(False).select("slice", "obs_id", "vec"), k, per_slice)
        return self

    def deconvolve(self, method: str = "gbdt", k: int = 30, **options) -> Study:
        st, ps = (self._part(p).select("obs_id", F.col("unit").alias("vec")) for p in (False, True))
        self.estimate = written(deconvolve.deconvolve(st, ps, self.comp, method, k, **options), "estimate")
        return self

    def smooth_deconvolution(self, n_neighbors: int = 6, **options) -> tuple[DataFrame, DataFrame]:
        self._need(deconvolve=getattr(self, "estimate", None))
        edges = graphs.spatial_neighbors(self.st.obs, n_neighbors)
        return deconvolve.sharpen_and_smooth(self.estimate, edges, **options)

    def build_imputation_graph(self, unshared: DataFrame, lam: float = 1.0, knn_k: int = 20, k_gnn: int = 50, radius: float | None = None) -> Study:
        """unshared: slice, obs_id, gene, value of the pseudo-spots' normalised unshared features."""
        names = [r[0] for r in unshared.select("gene").distinct().orderBy("gene").collect()]
        shared = [r[0] for r in self.genes.orderBy("gene_id").select("gene").collect()]
        table = self.spark.createDataFrame([(i, g) for i, g in enumerate(names)], "gene_id int, gene string")
        dense = preprocess.dense_rows(unshared, table)
        ids = self.rows.where("slice = 'pseudo'").select("obs_id", F.col("x").alias("shared"))
        full = ids.join(dense.select("obs_id", "x"), "obs_id", "left").withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), len(names))))
        st, ps = self._part(False), self._part(True)
        edges, near, self.unshared_factors = impute.imputation_graph(st, ps, self.factors.b, full.select("obs_id", "x"), lam, knn_k, k_gnn)
        self.impute_genes, self.n_shared, self.k_gnn = [*shared, *names], len(shared), k_gnn
        self.neighbors = written(near, "neighbors")
        self.adjacency = impute.feature_adjacency(edges, len(self.impute_genes))
        self.tensor = written(impute.neighbor_tensor(self.neighbors, full.select("obs_id", F.concat("shared", "x").alias("x")), k_gnn), "tensor")
        self.spatial = written(impute.spatial_mean(self.tensor, graphs.radius_graph(self.st.obs, radius)), "spatial") if radius is not None else None
        return self

    def fit_imputer(self, epochs: int = 50, lr: float = 1e-3, decay: float = 1e-2, layers: int = 1, hidden: int = 128, sim_weight: float = 0.5, **options) -> Study:
        self._need(build_imputation_graph=getattr(self, "tensor", None))
        truth = self.rows.where("slice <> 'pseudo'").select("obs_id", F.col("x").alias("y"))
        self.imputer, self.losses = impute.fit_imputer(self.tensor, truth, self.adjacency, list(range(self.n_shared)), self.k_gnn, epochs, lr, decay, layers, hidden, sim_weight, spatial=self.spatial, seed=self.seed, **options)
        return self

    def predict_imputation(self, alpha: float = 1.0) -> DataFrame:
        """(obs_id, gene, value); alpha < 1 blends in the neighbours' mean."""
        self._need(fit_imputer=getattr(self, "imputer", None))
        out = impute.predict_imputer(self.tensor, self.imputer, self.adjacency, self.impute_genes, self.spatial)
        if alpha == 1.0:
            return out
        g, k, names = len(self.impute_genes), self.k_gnn, F.array(*(F.lit(x) for x in self.impute_genes))
        mean = F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, m: s + F.get("f", (m * g + i).cast("int"))) / k)
        rows = self.tensor.select("obs_id", F.explode(F.arrays_zip(names.alias("gene"), mean.alias("value"))).alias("z")).select("obs_id", "z.gene", "z.value")
        return impute.blend(out, rows, alpha)

    def release(self) -> None:
        """Forget intermediate tables; the files in the shared folder stay for the cluster's cleaning."""
        for name in list(vars(self)):
            if name not in ("spark", "seed"):
                delattr(self, name)
        self.emb = None


def factor_matrix(factors: factorize.Factors) -> np.ndarray:
    """Feature factors B, one row a feature."""
    return factors.b
