"""Collocations against a brute-force version over the whole tables, and the summaries' guarantee."""

import re
from collections import Counter

import numpy as np
import pytest
from conftest import D

from lattica.llm import phrases as ph

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        longest = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longest[p[i : i + k]] = max(longest[p[i : i + k]], a)
        kept = []
        for p, a in often.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("d", [D, "/root/testdata/sf0.01"])
def test_collocations_equal_brute_force(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = rows_of(ph.collocations(docs))
    assert len(got) >= 50 and got == brute([(r.lang, r.text) for r in docs.collect()])


def test_collocations_do_not_depend_on_slices_or_partitions(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    want = rows_of(ph.collocations(docs, least=3))
    monkeypatch.setattr(ph, "SLICE", 1 << 12)
    monkeypatch.setattr(ph, "HELD", 500)
    assert rows_of(ph.collocations(docs.repartition(7), least=3)) == want
    assert want == brute([(r.lang, r.text) for r in docs.collect()], least=3)


def test_collocations_of_odd_rows(spark, odd, none):
    more = [("A  b\tC", "en"), ("a b c, a b c; a\x0bb c", None), ("ab é é É É", "und"), ("", "fr"), (None, "fr"), ("x " * 5000, "de"), ("q" * 50_000 + " " + "q" * 50_000, "de")] * 3
    for rows in (more, [(r.text, r.lang) for r in odd.collect()]):
        docs = spark.createDataFrame(rows, "text string, lang string")
        assert rows_of(ph.collocations(docs, least=3)) == brute([(lang, t) for t, lang in rows], least=3)
    assert rows_of(ph.collocations(odd, least=2)) == brute([(r.lang, r.text) for r in odd.collect()], least=2)
    assert ph.collocations(none).count() == 0


def test_a_summary_loses_no_frequent_key_however_it_is_merged():
    rng = np.random.default_rng(5)
    stream = np.concatenate([rng.zipf(1.3, 40_000) % 100_000, np.repeat(np.arange(200_000, 200_040), 30)]).astype(np.uint64)
    rng.shuffle(stream)
    count = Counter(stream.tolist())
    for pieces in (1, 7, 300):
        s = ph.Summary(len(stream) // 30 + 1)
        for x in np.array_split(stream, pieces):
            s.merge(*np.unique(x, return_counts=True))
        left = set(s.survivors(30).tolist())
        assert {k for k, c in count.items() if c >= 30} <= left and s.lowered < 30
        assert len(s.h) <= s.capacity
    small = ph.Summary(500)  # too small for this mass: the bound on what counters lost still holds
    for x in np.array_split(stream, 50):
        small.merge(*np.unique(x, return_counts=True))
    assert 0 < small.lowered <= len(stream) / 501
    assert all(count[h] - small.lowered <= c <= count[h] for h, c in zip(small.h.tolist(), small.c.tolist(), strict=True))


def test_packed_counts_come_back_whole():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64)) << np.uint64(1)
    c = np.concatenate([rng.integers(1, 5, len(h) - 6), [254, 255, 256, 510, 511, 1_000_000]])
    part = ph.to_parts(h, 7)
    back = Counter()
    for _, x in ph.deal(*ph.packed(part, h, c, 7)):
        for k, v in zip(ph.unpacked(x["h"]).tolist(), np.frombuffer(x["c"], np.uint8).tolist(), strict=True):
            back[k] += v
    assert back == dict(zip((h >> np.uint64(16) << np.uint64(16)).tolist(), c.tolist(), strict=True))


def test_words_of_one_hash_stay_apart(monkeypatch):
    raw = np.frombuffer(b"aa bb aa cc dd bb", np.uint8)
    p = ph.Pieces(raw, np.array([0, len(raw)]))
    p.hash = np.zeros(len(p.hash), np.uint64)
    ids, n = p.words()
    assert len(set(ids.tolist())) == 4 and ids[0] == ids[2] and ids[1] == ids[5] and n >= 4


def test_query_equals_sql(spark):
    from compare import connection, same

    from lattica.llm.queries import QUERIES, SQL

    d = "/root/testdata/sf0.01"
    same(QUERIES["op13_phrases"](spark, d), connection(d), SQL["op13_phrases"])
