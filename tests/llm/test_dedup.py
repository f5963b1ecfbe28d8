import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lattica.llm import group_search, near_dup, paragraph_dedup, suffix_dedup
from lattica.llm.common import text_buffer

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def F_(expression):
    return corpus_pipeline.F.expr(expression)


def by_brute_force(rows, window):
    seen, out = set(), []
    for did, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            if s in seen:
                gone[p : p + window] = True
            seen.add(s)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((did, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(b) else 0)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 20])
def test_suffix_dedup_equals_brute_force(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in docs.limit(120).collect()]
    rows += [(10**6 + i, " ".join(rng.choice(["ab", "cd", "xyz é", "q" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 200)))) for i in range(30)]
    rows += [(2 * 10**6 + i, "abc" * rng.randint(20, 80)) for i in range(6)] + [(3 * 10**6, None), (3 * 10**6 + 1, "")]
    line = "a line of ninety bytes that stands in many texts, each time with other words before it, after"
    rows += [(4 * 10**6 + i, f"{rng.choice(['', f'own {i} words ' * 3])}{line} {rng.choice(['same end of some texts', f'{i} other'])}") for i in range(120)]
    rows += [(3 * 10**6 + 2 + i, "x" * n) for i, n in enumerate((99, 100, 101, 100))] + [(None, "abc" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", suffix_dedup.F.lit("clash")).repartition(5)
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str) == by_brute_force(rows, 100)


def test_suffix_dedup_odd_input(odd, none):
    out = suffix_dedup.remove_repeats(odd, keep_text=True).collect()
    assert len(out) == 10 and suffix_dedup.remove_repeats(none).count() == 0
    assert {r.doc_id: bytes(r.kept) for r in out if r.doc_id in (4, 5)} == {4: b"", 5: b" \n\t ... !!"}


def test_windows_with_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    """With a hash that is the same for all, only the bytes can decide."""
    s = suffix_dedup.Suffixes(100, 32)
    texts = [b"q" * 30 + b"anchor of thirty-two bytes, equal" + bytes([x]) * 120 for x in b"abca"]
    for i, t in enumerate(texts):
        s.add(np.frombuffer(t, np.uint8), np.array([30]), i, 0)
    row, did, dk, pos = s.take()
    want = [sorted(map(tuple, np.stack(suffix_dedup.repeated_windows(row, np.zeros(4, int), np.arange(4), pos, 100), 1).tolist()))]
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x * 0)
    got = sorted(map(tuple, np.stack(suffix_dedup.repeated_windows(row[[0, 1]], np.zeros(2, int), np.arange(2), pos[:2], 100), 1).tolist()))
    assert got == [] and [x[0] for x in want[0]] == [3]


def test_merge_never_compares_known_prefixes():
    rng = random.Random(2)
    rows = sorted({bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(400)})
    runs = [sorted(rng.sample(rows, 60)) for _ in range(5)] + [[]]
    coded = [(r, [0] + [suffix_dedup.shared(a, b, 0) for a, b in zip(r, r[1:], strict=False)]) for r in runs]
    got = list(suffix_dedup.merge_runs(coded))
    merged = [runs[r][i] for r, i, _ in got]
    assert merged == sorted(x for r in runs for x in r)
    assert all(n == suffix_dedup.shared(a, b, 0) for a, b, (_, _, n) in zip(merged, merged[1:], got[1:], strict=False))


def classes_by_brute_force(rows, k=5, threshold=0.8):
    rows = sorted(rows)
    raw, off = text_buffer(pa.array([t or "" for _, t in rows], pa.large_string()))
    h, doc = near_dup.labelled(raw, off, k)
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    s = [h[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or near_dup.similarity(s[i], s[j], threshold) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_duplicates_equal_brute_force_also_in_a_large_family(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 120)))) for i in range(60)]
    for i in range(80):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((1000 + i, " ".join(t)))
    rows += [(2000, rows[5][1].upper()), (2001, rows[5][1]), (2002, None), (2003, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    assert got == classes_by_brute_force(rows)
    kept = near_dup.keep_first(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_near_duplicates_search_a_large_group_whole(spark, monkeypatch):
    rng = random.Random(8)
    family = [[f"w{i}" for i in range(100)]]
    for i in range(299):  # each text is near one other and far from most
        t = list(rng.choice(family))
        for p in rng.sample(range(40, 100), 2):
            t[p] = f"x{i}-{p}"
        family.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(family)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # one band of one sketch; the groups, and the classes by comparing all pairs of a group
    raw, off = text_buffer(pa.array([t for _, t in rows], pa.large_string()))
    h, doc = near_dup.labelled(raw, off, 5)
    cut = np.searchsorted(doc, np.arange(len(rows) + 1))
    group = near_dup.order_sketches(h, doc, len(rows), 1)[1][:, 0]
    assert np.unique(group, return_counts=True)[1].max() > 40
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] == group[j] and root[i] != root[j] and near_dup.similarity(h[cut[i] : cut[i + 1]], h[cut[j] : cut[j + 1]], 0.8) >= 0.8 - 1e-9:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    for block in (400_000, 5_000):  # in one block, and in several
        monkeypatch.setattr(group_search, "BLOCK", block)
        assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df, bands=1, rows=1).collect()} == dict(enumerate(root))


def test_near_duplicates_near_the_threshold_whatever_the_partitions(spark):
    """300 texts, each 0.81 like one other and far from most, with the bands of the query: recall of the classes' links."""
    rows = list(enumerate(family(random.Random(12), 300)))
    want = classes_by_brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r.doc_id: r.class_id for r in near_dup.near_duplicates(df.repartition(n)).collect()} for n in (1, 6)]
    assert got[0] == got[1] and len(set(want.values())) < 20
    assert np.mean([got[0][d] == want[d] for d in want]) >= 0.98
    assert all(want[d] == want[c] for d, c in got[0].items())  # nothing is joined that brute force keeps apart


def test_near_duplicates_odd_input(odd, none):
    got = near_dup.near_duplicates(odd)
    rows = got.collect()
    assert len(rows) == 10 and {r.class_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.class_id for r in rows if r.doc_id in (3, 4)} == {3}
    kept = near_dup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.keep_first(none).count() == 0


def test_alignment_keeps_order():
    a = np.arange(100, dtype=np.uint64)
    assert near_dup.similarity(a, a, 0.8) == 1.0
    b = np.concatenate([a[50:], a[:50]])
    assert near_dup.similarity(a, b, 0.8) < 0.5 and near_dup.similarity(a, a[:0], 0.8) == 0.0
    c = np.delete(a, [3, 50, 51])
    assert abs(near_dup.similarity(a, c, 0.8) - 0.97) < 1e-9


def prose(rng, vocabulary, n):
    out = []
    while n > 0:
        k = rng.randint(2, 18)
        out.append(" ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + rng.choice([". ", ". ", ".\n"]))
        n -= k
    return "".join(out).strip()


def test_paragraph_dedup_finds_passages_and_spares_the_rest(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    passages = [prose(rng, vocabulary, rng.randint(50, 70)) for _ in range(10)]
    rows, holds = [], {}
    for i in range(150):
        t = prose(rng, vocabulary, rng.randint(30, 200))
        if i % 3 == 0:
            holds[i] = passages[(i // 3) % 10]
            w = t.split(" ")
            at = rng.randint(0, len(w))
            t = " ".join([*w[:at], holds[i], *w[at:]])
        rows.append((i, t))
    got = {r.doc_id: r for r in paragraph_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    seen: set = set()
    share = []
    for i, t in rows:
        if i in holds and holds[i] in seen:
            share.append(got[i].n_removed_words / len(holds[i].split()))
        else:
            seen.add(holds.get(i))
            assert got[i].n_removed_words == 0 and got[i].text == t
    assert np.mean(share) > 0.97 and min(share) > 0.7


def repeats_by_brute_force(rows, k=5, threshold=0.8, min_words=16, min_match=16):
    """doc_id -> set of word numbers to cut: lines of all pairs, windows of all blocks, equal texts."""
    cut = {did: set() for did, _ in rows}
    rows = sorted(rows)
    p = paragraph_dedup.Paragraphs(*text_buffer(pa.array([t for _, t in rows], pa.large_string())), k, 1, 1, min_words)
    seen, copies = {}, set()
    for did, t in rows:
        if t in seen and len(t.split()) >= min_match:
            copies.add(did)
        seen.setdefault(t, did)
    zero, words = p.words.first, [t.split() for _, t in rows]
    for i, (did, _) in enumerate(rows):
        if did in copies:
            cut[did] = set(range(len(words[i])))
    runs = [set(p.run[a:b].tolist()) for a, b in zip(*p.run_cut, strict=True)]
    live = [j for j in range(len(runs)) if rows[p.line_doc[j]][0] not in copies]
    root = {j: j for j in live}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in live:
        for i in live:
            if i < j and len(runs[i] & runs[j]) >= (threshold - 1e-9) * len(runs[i] | runs[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for j in live:
        if find(j) != j:  # lines are in order of document and place
            d = p.line_doc[j]
            cut[rows[d][0]] |= set(range(p.lines[j, 0] - zero[d], p.lines[j, 1] - zero[d]))
    known: dict = {}
    for again in (False, True):
        for j, (a, b) in enumerate(p.blocks.tolist()):
            d = p.block_doc[j]
            if rows[d][0] in copies:
                continue
            a, b = int(a - zero[d]), int(b - zero[d])
            for reach in range(0, 21, 2):
                least = max(0, min_match - (b - a) - reach)
                for x, y in ((a - reach, b + least), (a - least, b + reach)):
                    if x >= 0 and y <= len(words[d]):
                        key = (a - x, b - a, tuple(words[d][x:y]))
                        who = (rows[d][0], x)
                        if not again:
                            known[key] = min(known.get(key, who), who)
                        elif known[key] != who:
                            cut[rows[d][0]] |= set(range(x, y))
    return {d: len(x) for d, x in cut.items()}


def family(rng, n, changes=2):
    """Lines of 100 words, each near one other and far from most."""
    out = [[f"w{i}" for i in range(100)]]
    for i in range(n - 1):
        t = list(rng.choice(out))
        for p in rng.sample(range(40, 100), changes):
            t[p] = f"x{i}p{p}"
        out.append(t)
    return [" ".join(t) for t in out]


def test_paragraph_dedup_equals_brute_force_whatever_the_partitions(spark, monkeypatch):
    rng = random.Random(9)
    lines = family(rng, 200)
    passages = [" ".join(f"p{i}q{rng.randrange(400)}" for _ in range(rng.randint(12, 60))) for i in range(6)]
    rows = [(i, f"own{i} a b\n{t}\nc d own{i}") for i, t in enumerate(lines)]
    for i in range(200, 280):
        own = [f"o{rng.randrange(3000)}" for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(own))
        rows.append((i, " ".join([*own[:at], rng.choice(passages), *own[at:]])))
    rows += [(300, rows[5][1]), (301, rows[210][1]), (302, "short text"), (303, "short text")]
    want = repeats_by_brute_force(rows)
    assert sum(want[i] >= 100 for i in range(1, 200)) > 150
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # so many bands that every similar pair meets in one
    for parts, block in ((1, 400_000), (8, 5_000)):
        monkeypatch.setattr(group_search, "BLOCK", block)
        got = {r.doc_id: r.n_removed_words for r in paragraph_dedup.cut_repeats(df.repartition(parts), recall=1 - 1e-12).collect()}
        assert got == want, (parts, {d: (got[d], want[d]) for d in want if got[d] != want[d]})


def test_paragraph_dedup_recall_of_lines_near_the_threshold(spark):
    """With the bands of the query: nearly all of what brute force cuts, and nothing else."""
    rows = list(enumerate(family(random.Random(10), 300)))
    want = repeats_by_brute_force(rows)
    got = {r.doc_id: r.n_removed_words for r in paragraph_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = [d for d in want if want[d] == 100]
    assert len(whole) > 200 and np.mean([got[d] == 100 for d in whole]) >= 0.99 and all(got[d] <= want[d] for d in want)


def test_paragraph_dedup_near_lines(spark):
    rng = random.Random(4)
    line = [f"w{rng.randrange(5000)}" for _ in range(80)]
    other = list(line)
    other[40] = "changed"
    rows = [(1, "first own line of the first text here now\n" + " ".join(line)), (2, " ".join(other) + "\nand a second own line that stays in the text")]
    got = {r.doc_id: r for r in paragraph_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed_words == 0 and got[2].text.strip() == "and a second own line that stays in the text" and len(got[2].spans) == 1


def test_paragraph_dedup_searches_short_copies(spark):
    line = "a1 b2 c3 d4 e5 f6 g7 h8 i9 été"  # 10 words
    long = " ".join(f"l{i}" for i in range(16))
    rows = [(1, line), (2, line), (3, f"one two\n{line}"), (4, f"one two\n{line}"), (5, "x y z"), (6, "x y z"), (7, long), (8, long)]
    got = {r.doc_id: r.n_removed_words for r in paragraph_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_words=8).collect()}
    assert got == {1: 0, 2: 10, 3: 10, 4: 10, 5: 0, 6: 0, 7: 0, 8: 16}
    got = {r.doc_id: r.n_removed_words for r in paragraph_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 16}


def test_paragraph_dedup_odd_input(odd, none):
    out = paragraph_dedup.cut_repeats(odd)
    rows = out.collect()
    assert out.columns == [*odd.columns, "n_words", "n_removed_words", "spans"] and len(rows) == 10
    assert all(r.text is None for r in rows if r.doc_id == 3) and paragraph_dedup.cut_repeats(none).count() == 0
    assert paragraph_dedup.bands_for(0.8, 2, 0.99) == 5


def test_pipeline_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, now, D), "test")
        assert out.columns == docs.columns and 0 < out.count() <= now.count(), name
        now = out
    packed = corpus_pipeline.STAGES[-1][1](spark, now, D)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_pipeline_stages_keep_the_values_of_clashing_columns(spark, odd, none):
    """`odd` has columns named as results of operators; more of them here, each with a value of its own."""
    F = corpus_pipeline.F
    clash = ["times", "n_words", "items", "lang_pred", "_rest", "_words", "_hits", "spans", "keep_id", "full", "a b.c"]
    table = odd.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in clash})
    kept = {"language_id": [1, 1, 2, 6, None], "near_dedup": [1, 6], "substring_dedup": [1, 6], "decontamination": [1, 6]}
    now = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, D), "test")
        rows = now.collect()
        assert now.schema.names == table.schema.names
        assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == kept[name], name
        for r in rows:
            assert all(r[c] == f"{c}:{'null' if r.doc_id is None else r.doc_id}" for c in clash), name
            assert r.score == {1: 0.5, 6: 0.1}.get(r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, now, D).collect()} == {1, 6}
    now = none
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, D), "test")
        assert now.count() == 0 and (name == "packing" or now.columns == odd.columns)


def test_pipeline_equals_brute_force(spark, docs):
    """The stages that choose documents, one after the other, by all pairs and all windows; n_chars follows the text."""
    rows = docs.where("doc_id % 2 = 0").orderBy("doc_id").limit(90)
    rows = rows.union(rows.where("doc_id % 6 = 0").withColumn("doc_id", F_("doc_id + 100000"))).union(spark.createDataFrame([(200_000, None, "en", "x", 0), (200_001, " .. ", "en", "x", 0)], docs.schema))
    bench = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    found, now = {}, rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        now = corpus_pipeline.written(stage(spark, now, D), "test")
        found[name] = before, {r.doc_id: r.text for r in now.collect()}
    before, after = found["language_id"]
    assert set(before) - set(after) >= {200_000, 200_001} and len(after) > 0.9 * len(before)
    before, after = found["near_dedup"]
    assert set(after) == set(classes_by_brute_force(list(before.items())).values())
    before, after = found["substring_dedup"]
    plain = {d: " ".join(WORD.findall(t.lower())) for d, t in before.items()}
    lines = {d: "\n".join(" ".join(WORD.findall(x.lower())) for x in t.split("\n")) for d, t in before.items()}
    want = repeats_by_brute_force(list(lines.items()))
    size = {d: len(plain[d].split()) for d in plain}
    assert {d: len(WORD.findall(t.lower())) for d, t in after.items()} == {d: size[d] - want[d] for d in want if want[d] < size[d] or not want[d]}
    before, after = found["decontamination"]
    windows = {tuple(w[i : i + 10]) for t in bench for w in [WORD.findall(t.lower())] for i in range(max(1, len(w) - 9)) if w}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [WORD.findall(t.lower())] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert set(after) == {d for d, t in before.items() if not hit(t)}
    assert all(r.n_chars == len(r.text) for r in now.collect())
