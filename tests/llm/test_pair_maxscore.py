"""Ranked search against brute force, and what the pair bounds are worth."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import connection, same
from conftest import D

from lattica.llm import pair_maxscore as pm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {x for x in items if x[1]}:
        scores = []
        for (i, b), size in zip(bags, sizes, strict=True):
            if size:
                m = 100 - 50 + (50 * size * n) // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if b[t])
                if s > 0:
                    scores.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def both(spark):
    docs, items = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "benchmark"))
    return docs, items, brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_ranking_equals_brute_force(both):
    docs, items, want = both
    got = rows_of(pm.ranked_search(docs, items))
    assert len(got) > 1000 and got == want


def test_ranking_of_many_small_shards_and_query_groups(both, monkeypatch):
    docs, items, want = both
    monkeypatch.setattr(pm, "SHARD", 20_000)
    monkeypatch.setattr(pm, "QUERIES", 23)
    monkeypatch.setattr(pm, "FIRST", 3)
    assert rows_of(pm.ranked_search(docs.repartition(5), items)) == want


def test_query_equals_sql(spark):
    from lattica.llm.queries import QUERIES, SQL

    d = "/root/testdata/sf0.01"
    same(QUERIES["op12_pair_maxscore"](spark, d), connection(d), SQL["op12_pair_maxscore"])


def test_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()] + [(9, "Alpha  ALPHA x1_y2 ünï"), (10, "alpha")] * 4
    items = [(1, "alpha beta"), (1, "alpha beta"), (1, "ünï y2 word"), (2, None), (3, ""), (4, "... !"), (None, "kappa é alpha"), (5, "nowhere"), (6, "é" * 5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", pm.F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string")
    for k in (2, 50):
        assert rows_of(pm.ranked_search(d, i, k)) == brute(docs, items, k)
    assert pm.ranked_search(none, i).count() == 0 and pm.ranked_search(d, i.limit(0)).count() == 0


def test_pair_bounds_tighten_and_lose_nothing():
    """Random shards: the result is that of full scoring, bounds hold for each document, and fewer documents are scored than
    with single terms' maxima."""
    rng = np.random.default_rng(11)
    fewer = []
    for _ in range(40):
        n, terms_ = 400, list(range(8))
        lists = {}
        for t in terms_:
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.03, 0.1, 0.5]))
            lists[t] = docs, rng.integers(1, 1000 * (t + 1), len(docs))
        lists = {t: x for t, x in lists.items() if len(x[0])}
        full = np.zeros(n, np.int64)
        for docs, x in lists.values():
            full[docs] += x
        order = sorted(lists, key=lambda t: (-t, t))
        paired, single = pm.Shard(n, lists, list(zip(order, order[1:], strict=False))), pm.Shard(n, lists, [])
        assert sum(u for u, _ in paired.units(order)) <= sum(u for u, _ in single.units(order))
        assert sorted(t for _, u in paired.units(order) for t in u) == sorted(order)
        for bound, unit in paired.units(order):
            assert sum(paired.at(t, np.arange(n)) for t in unit).max() <= bound
        floor = int(np.sort(full)[-10])
        for s in (paired, single):
            found, score = s.search(order, 10, floor)
            want = np.flatnonzero(full >= floor)
            assert set(want) <= set(found.tolist()) and (full[found] == score).all()
            assert set(np.flatnonzero(full >= max(1, floor))) == set(found[score >= floor].tolist())
        fewer.append(single.scored - paired.scored)
    assert sum(fewer) > 0 and sum(x > 0 for x in fewer) > 2 * sum(x < 0 for x in fewer)
