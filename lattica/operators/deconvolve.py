"""Composition estimation from pseudo-spots, and its post-processing. Compositions are long: obs_id, cell_type, value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.columns import scrub
from lattica.operators.graphs import knn, smooth
from lattica.operators.linalg import column, vectors

#: Rows of the pseudo-spot table that a boosting task may hold.
MAX_TRAINING_ROWS = 200_000
#: Numbers of neighbours' vectors, or of their compositions, that are held at once.
ROOM = 1 << 18


def wide_rows(comp: DataFrame, types: list[str]) -> DataFrame:
    """(obs_id, y array<double>) in the order of types, absent ones 0, repeated ones added up."""
    m = comp.where("cell_type IS NOT NULL").groupBy("obs_id", "cell_type").agg(F.sum("value").alias("value")).groupBy("obs_id").agg(F.map_from_entries(F.collect_list(F.struct("cell_type", "value"))).alias("m"))
    return m.select("obs_id", F.array(*(F.coalesce(F.col("m")[t], F.lit(0.0)) for t in types)).alias("y"))


def long_rows(rows: DataFrame, types: list[str]) -> DataFrame:
    named = F.explode(F.arrays_zip(F.array(*(F.lit(t) for t in types)).alias("cell_type"), F.col("y").alias("value")))
    return rows.select("obs_id", named.alias("z")).select("obs_id", F.col("z.cell_type").alias("cell_type"), F.col("z.value").alias("value"))


def mixed(batches, n_types: int, reg: float):
    """Compositions (obs_id, y) of rows obs_id, x, and the vectors v and compositions y of their k neighbours. A few rows are solved at
    once, as many as ROOM numbers make, whatever the length of a batch."""
    for batch in batches:
        widest = max([1, *(pc.max(pc.list_value_length(batch.column(c))).as_py() or 1 for c in ("v", "y"))])
        step = max(1, ROOM // widest)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            counts = part.column("k").to_numpy()
            for m in np.unique(counts).tolist():
                own = part.filter(pa.array(counts == m))
                x = column(own, "x")
                z = column(own, "v").reshape(len(x), m, -1) - x[:, None, :]
                y = column(own, "y").reshape(len(x), m, n_types)
                c = z @ z.transpose(0, 2, 1)
                c[:, np.arange(m), np.arange(m)] += (reg * np.trace(c, axis1=1, axis2=2) / m + 1e-8)[:, None]
                w = np.linalg.solve(c, np.ones((len(x), m, 1)))[:, :, 0]
                w /= w.sum(1, keepdims=True) + 1e-8
                w = np.maximum(w, 0)
                w /= w.sum(1, keepdims=True) + 1e-8
                out = np.maximum((w[:, :, None] * y).sum(1), 0)
                out /= out.sum(1, keepdims=True) + 1e-8
                yield pa.RecordBatch.from_arrays([own.column("obs_id"), vectors(out)], names=["obs_id", "y"])


def deconvolve_lle(st: DataFrame, ps: DataFrame, comp: DataFrame, k: int = 30, reg: float = 1e-3) -> DataFrame:
    """Mixing weights that rebuild each spot's embedding from its k nearest pseudo-spots (cosine), applied to their
    compositions. st, ps: obs_id, vec; comp: of the pseudo-spots. The neighbours' rows are joined, not broadcast."""
    types = [r[0] for r in comp.select("cell_type").distinct().orderBy("cell_type").collect()]
    n = knn(st, ps, k, "cosine").select("src", "dst", "rank")
    right = ps.select(F.col("obs_id").alias("dst"), F.col("vec").cast("array<double>").alias("v")).join(wide_rows(comp, types).select(F.col("obs_id").alias("dst"), "y"), "dst")
    near = n.join(right, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "v", "y"))).alias("near"))
    rows = near.join(st.select(F.col("obs_id").alias("src"), F.col("vec").cast("array<double>").alias("x")), "src")
    rows = rows.select(F.col("src").alias("obs_id"), "x", F.flatten(F.col("near.v")).alias("v"), F.flatten(F.col("near.y")).alias("y"), F.size("near").alias("k"))
    n_types = len(types)
    kind = st.schema["obs_id"].dataType.simpleString()
    return long_rows(rows.mapInArrow(lambda batches: mixed(batches, n_types, reg), f"obs_id {kind}, y array<double>"), types)


def clr_transform(comp: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Centred log-ratios of rows clipped at 0 and normalised. comp must list every type of an observation."""
    w = Window.partitionBy("obs_id")
    v = F.greatest(F.col("value"), F.lit(0.0))
    p = comp.withColumn("value", v / (F.sum(v).over(w) + F.lit(1e-8)))
    z = F.log(F.col("value") + F.lit(eps))
    return p.withColumn("value", z - F.avg(z).over(w))


def softmax(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("obs_id")
    e = rows.withColumn("value", F.exp(F.col("value") - F.max("value").over(w)))
    return e.withColumn("value", F.col("value") / (F.sum("value").over(w) + F.lit(1e-8)))


class Booster:
    """Least-squares boosting of histogram trees, each grown leaf by leaf where the gain is greatest."""

    def __init__(self, iters: int = 400, rate: float = 0.05, depth: int = 6, leaves: int = 31, l2: float = 1e-3, least: int = 20, bins: int = 255):
        self.iters, self.rate, self.depth, self.leaves, self.l2, self.least, self.bins = iters, rate, depth, leaves, l2, least, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        self.base, self.trees = float(y.mean()) if len(y) else 0.0, []
        left = y - self.base
        for _ in range(self.iters):
            tree, step = self.tree(b, left)
            if tree is None:
                break
            self.trees.append(tree)
            left = left - step
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1).astype(np.int64)

    def split(self, b: np.ndarray, g: np.ndarray, rows: np.ndarray):
        n, width = len(rows), self.bins + 1
        if n < 2 * self.least:
            return None
        f = b.shape[1]
        at = (b[rows] + np.arange(f) * width).ravel()
        s = np.bincount(at, np.repeat(g[rows], f), f * width).reshape(f, width).cumsum(1)[:, :-1]
        c = np.bincount(at, minlength=f * width).reshape(f, width).cumsum(1)[:, :-1]
        total = g[rows].sum()
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = s**2 / (c + self.l2) + (total - s) ** 2 / (n - c + self.l2) - total**2 / (n + self.l2)
        gain[(c < self.least) | (n - c < self.least)] = -np.inf
        i = int(gain.argmax())
        if not gain.flat[i] > 1e-12:
            return None
        feature, cut = divmod(i, width - 1)
        return gain.flat[i], feature, cut

    def tree(self, b: np.ndarray, g: np.ndarray):
        nodes: list = [None]  # (feature, cut, left, right) or a value
        open_ = [(0, np.arange(len(g)), 0, self.split(b, g, np.arange(len(g))))]
        if open_[0][3] is None:
            return None, None
        step = np.zeros(len(g))
        n = 1
        while n < self.leaves and any(o[3] is not None for o in open_):
            i = max(range(len(open_)), key=lambda i: open_[i][3][0] if open_[i][3] is not None else -np.inf)
            at, rows, deep, (_, feature, cut) = open_.pop(i)
            low = b[rows, feature] <= cut
            nodes[at] = (feature, cut, len(nodes), len(nodes) + 1)
            for own in (rows[low], rows[~low]):
                nodes.append(None)
                open_.append((len(nodes) - 1, own, deep + 1, self.split(b, g, own) if deep + 1 < self.depth else None))
            n += 1
        for at, rows, _, _ in open_:
            nodes[at] = self.rate * g[rows].sum() / (len(rows) + self.l2)
            step[rows] = nodes[at]
        return nodes, step

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        for nodes in self.trees:
            todo = [(0, np.arange(len(x)))]
            while todo:
                at, rows = todo.pop()
                if isinstance(nodes[at], tuple):
                    f, cut, lo, hi = nodes[at]
                    low = b[rows, f] <= cut
                    todo += [(lo, rows[low]), (hi, rows[~low])]
                else:
                    out[rows] += nodes[at]
        return out


def deconvolve_boosted(st: DataFrame, ps: DataFrame, comp: DataFrame, eps: float = 1e-4, **options) -> DataFrame:
    """One boosted model a cell type on centred log-ratios of the pseudo-spots' compositions, then a softmax. The types
    train side by side, a task each, on the pseudo-spot table, whose size is a parameter of the run and is checked; the table is
    shuffled to them, not collected."""
    types = [r[0] for r in comp.select("cell_type").distinct().orderBy("cell_type").collect()]
    full = long_rows(wide_rows(comp, types), types)
    target = wide_rows(clr_transform(full, eps), types)
    train = ps.select("obs_id", F.col("vec").cast("array<double>").alias("vec")).join(target, "obs_id")
    n = train.count()
    if n > MAX_TRAINING_ROWS:
        raise ValueError(f"{n} pseudo-spots are too many for one training task")
    spark = st.sparkSession
    each = train.select("obs_id", "vec", F.posexplode("y").alias("i", "y"))

    def learn(t: pa.Table) -> pa.Table:
        import pickle

        t = t.sort_by("obs_id").combine_chunks()
        model = Booster(**options).fit(column(t.select(["vec"]).to_batches()[0], "vec"), t.column("y").to_numpy())
        return pa.table({"i": pa.array([t.column("i")[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    import pickle

    models = {r.i: pickle.loads(bytes(r.model)) for r in each.groupBy("i").applyInArrow(learn, "i int, model binary").collect()}
    shared = spark.sparkContext.broadcast([models[i] for i in range(len(types))])

    def predict(batches):
        for batch in batches:
            if batch.num_rows:
                v = column(batch, "vec")
                yield pa.RecordBatch.from_arrays([batch.column("obs_id"), vectors(np.stack([m.predict(v) for m in shared.value], 1))], names=["obs_id", "y"])

    kind = st.schema["obs_id"].dataType.simpleString()
    rows = st.select("obs_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(predict, f"obs_id {kind}, y array<double>")
    return softmax(long_rows(rows, types))


def deconvolve(st: DataFrame, ps: DataFrame, comp: DataFrame, method: str = "gbdt", k: int = 30, **options) -> DataFrame:
    if method == "lle":
        return deconvolve_lle(st, ps, comp, k, **options)
    if method == "gbdt":
        return deconvolve_boosted(st, ps, comp, **options)
    raise ValueError(f"unknown method {method!r}; there are 'gbdt' and 'lle'")


def sharpen(comp: DataFrame, p_lo: float = 0.0, p_hi: float = 99.9, mode: str = "keep", gamma: float = 2.0) -> DataFrame:
    """(obs_id, cell_type, value, lo, hi): per type, values outside the percentiles become 0 (`keep`) or the nearest of
    them (`winsor`), then clipped at 0 and raised to gamma. Values that are null or not finite count as 0."""
    if mode not in ("keep", "winsor"):
        raise ValueError(f"unknown mode {mode!r}")
    v = comp.withColumn("value", scrub(F.col("value")))
    cut = v.groupBy("cell_type").agg(F.percentile("value", p_lo / 100).alias("lo"), F.percentile("value", p_hi / 100).alias("hi"))
    x = F.col("value")
    kept = F.when((x >= F.col("lo")) & (x <= F.col("hi")), x).otherwise(0.0) if mode == "keep" else F.least(F.greatest(x, F.col("lo")), F.col("hi"))
    y = F.pow(F.greatest(kept, F.lit(0.0)), F.lit(gamma)) if gamma != 1.0 else F.greatest(kept, F.lit(0.0))
    return v.join(cut, "cell_type").select("obs_id", "cell_type", y.alias("value"), "lo", "hi")


def sharpen_and_smooth(comp: DataFrame, edges: DataFrame, types: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(long table obs_id, cell_type, sharp, smooth; cutoffs cell_type, lo, hi) in one grouped pass over all types. Types
    that comp lacks are skipped."""
    own = comp.where(F.col("cell_type").isin(types)) if types is not None else comp
    s = sharpen(own, **options)
    flat = smooth(edges, s.select("obs_id", F.col("cell_type").alias("key"), "value"))
    both = s.select("obs_id", "cell_type", F.col("value").alias("sharp")).join(flat.select("obs_id", F.col("key").alias("cell_type"), F.col("value").alias("smooth")), ["obs_id", "cell_type"])
    return both, s.select("cell_type", "lo", "hi").distinct()


def pivoted(comp: DataFrame, types: list[str]) -> DataFrame:
    """One column a type."""
    return comp.groupBy("obs_id").pivot("cell_type", types).agg(F.first("value"))
