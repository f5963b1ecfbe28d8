"""Links by cosine against brute force, recall at the threshold, crowded filters, odd rows."""

import numpy as np
import pytest
from compare import connection, same
from conftest import D

from lattica.llm import cap_filters as cf


def family(rng, n, dim, spread):
    c = rng.standard_normal(dim)
    return c / np.linalg.norm(c) + spread * rng.standard_normal((n, dim)) / np.sqrt(dim)


def brute(rows, cosine=0.9):
    """rows: (vec_id, list or None) -> sorted (vec_id, n_links, component, kept)."""
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.asarray(v, float) / max(abs(np.asarray(v, float))) if s else None for (_, v), s in zip(rows, sound, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(least.get(find(i), v), v)
    return sorted(((v, n[i], c := least.get(find(i)), v is not None and v == c) for i, (v, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("block", [1024, 40])
def test_families_equal_brute_force(spark, monkeypatch, block):
    """Families of near copies, chains, copies and single vectors; with small blocks the crowded filters are cut."""
    monkeypatch.setattr(cf, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = [*family(rng, 150, 32, 0.1), *family(rng, 30, 32, 0.25), *family(rng, 10, 32, 0.02), *rng.standard_normal((200, 32))]
    a, b = rng.standard_normal((2, 32))
    x += [a * np.cos(t) + b * np.sin(t) for t in np.linspace(0, 1.5, 12)]  # a chain: only neighbours are linked
    x += [x[0], x[0], x[0], x[200] * 3, x[-1]]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    got = rows_of(cf.similar_vectors(table(spark, rows).repartition(5), miss=1e-7))
    assert got == brute(rows) and len({r[2] for r in got}) < len(rows) - 150


def test_recall_at_the_threshold():
    """Random pairs at exactly 0.9 among as many vectors as fill 0.1 GB of documents, and at 0.95."""
    rng = np.random.default_rng(8)
    for cosine, least in ((0.9, 0.995), (0.95, 0.998)):
        u = rng.standard_normal((3000, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        v = rng.standard_normal((3000, 64))
        v -= (v * u).sum(1, keepdims=True) * u
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        v = cosine * u + np.sqrt(1 - cosine**2) * v
        for n in (10_000, 1_000_000):
            code = cf.Code(64, n, 0.9, 1e-4)
            lists = []
            for x in (u, v):
                row, c = code.decode(x)
                by = np.argsort(row, kind="stable")
                row, c = row[by], c[by]
                lists.append([set(c[i:j].tolist()) for i, j in zip(*(np.searchsorted(row, np.arange(3000) + k) for k in (0, 1)), strict=True)])
            found = np.mean([bool(a & b) for a, b in zip(*lists, strict=True)])
            assert found >= least, (cosine, n, found)
            assert np.mean([len(x) for x in lists[0]]) < 60


def test_decoding_lists_exactly_what_reaches_the_bound():
    rng = np.random.default_rng(2)
    for dim, n in ((64, 5000), (16, 300_000), (3, 50)):
        code = cf.Code(dim, n, 0.9, 1e-2)
        u = rng.standard_normal((60, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        z = np.zeros((60, code.dim))
        z[:, :dim] = u
        s = []
        for turn, words in zip(code.turns, code.words, strict=True):
            own = np.zeros((60, 1))
            for w, a, b in zip(words, code.cuts[:-1], code.cuts[1:], strict=True):
                own = (own[:, :, None] + (z @ turn)[:, None, a:b] @ w[None]).reshape(60, -1)
            s.append(own)
        s = np.concatenate(s, 1)
        row, c = code.decode(u)
        assert set(zip(row.tolist(), c.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(s >= code.bound)), strict=True))


def test_recall_on_the_query_table(spark):
    """The whole table with planted partners at 0.9 and above for a tenth of its rows."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    rng = np.random.default_rng(4)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in e]
    for i in range(0, len(rows), 10):
        u = np.array(rows[i][1])
        v = rng.standard_normal(len(u))
        v -= v @ u / (u @ u) * u
        c = rng.uniform(0.901, 0.97)
        rows.append((10_000 + i, (c * u / np.linalg.norm(u) + np.sqrt(1 - c * c) * v / np.linalg.norm(v)).tolist()))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(zip([i for i, _ in rows], ((x @ x.T >= 0.9).sum(1) - 1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in cf.similar_vectors(table(spark, rows)).collect()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.98 * sum(want.values()) > 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [1.0, inf]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (8, [2.0, 4.0]), (None, [1.0, 2.0]), (None, [-5.0, 1.0]), (9, [1.0, 2.0, 0.0]), (10, [1e300, 2e300]), (11, [1e-300, 2e-300]), (12, [3.0]), (13, [0.5]), (14, [-1.0]), (None, None)]
    for kind in ("double", "float"):
        fit = [(i, None if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows if kind == "double" or i not in (10, 11)]
        df = table(spark, fit, kind).withColumn("cls", cf.F.lit("x")).withColumn("n_links", cf.F.lit("x"))
        assert rows_of(cf.similar_vectors(df)) == brute(fit)
    assert cf.similar_vectors(df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    from lattica.llm.queries import QUERIES, SQL

    for d in (D, "/root/testdata/sf0.01"):
        same(QUERIES["op11_cap_filters"](spark, d), connection(d), SQL["op11_cap_filters"])
