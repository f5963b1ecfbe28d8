"""Ranked lexical search with MaxScore and bounds of term pairs.

The collection is cut into shards of documents. A shard holds the posting lists of all terms that the queries have, and, for
terms that are neighbours in a query's order of weights, the intersection list of the two with the joint impact of each
document and its maximum. A document's share from two terms is at most the greater of their joint maximum and either one's
own, which is mostly well under the sum of both. For each query the pairs are combined so that the bounds fall the most (a
dynamic program over the path of neighbours); units whose bounds together stay under the threshold don't propose documents,
and later units prune those proposed. The threshold starts at the k-th score that some shards searched first give for the
whole collection, and rises in a shard by the documents at the head of its pair lists.

Scores are whole numbers (see impacts); nothing is approximate."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import Words, discard, parts_for, slices, text_buffer, written

#: Bytes of text of a shard; queries, and bytes of their texts, that go through the collection together; shards searched first.
SHARD, QUERIES, QUERY_BYTES, FIRST = 1 << 25, 4096, 1 << 24, 8
LOWER = bytes(i + 0x20 if 0x41 <= i <= 0x5A else i for i in range(256))


def same_bytes(raw: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray, at: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Whether raw[start : start + size] equals flat[at : at + size], for each one; sizes are positive."""
    ok = np.ones(len(start), bool)
    for low in range(0, len(start), step):
        n = size[low : low + step]
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = raw[np.repeat(start[low : low + step], n) + run] == flat[np.repeat(at[low : low + step], n) + run]
        ok[low : low + step] = np.add.reduceat(equal, np.cumsum(n) - n) == n
    return ok


class Vocabulary:
    """The terms of some queries, numbered; and each query's terms."""

    def __init__(self, texts: list[str]):
        raw, off = text_buffer(pa.array(texts, pa.string()))
        w = Words(raw, off)
        low = np.frombuffer(raw.tobytes().translate(LOWER), np.uint8)
        words = [low[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        self.hash, rep = np.unique(w.hash, return_index=True)
        number = {words[i]: k for k, i in enumerate(rep.tolist())}
        if len(number) < len(set(words)):
            raise ValueError("two terms share a hash")
        self.queries: list[list[int]] = [[] for _ in texts]
        for d, x in zip(w.doc.tolist(), words, strict=True):
            self.queries[d].append(number[x])
        self.queries = [sorted(set(q)) for q in self.queries]
        self.flat = np.concatenate([low[w.start[i] : w.end[i]] for i in rep] or [np.zeros(0, np.uint8)])
        self.size = w.end[rep] - w.start[rep]
        self.at = np.cumsum(self.size) - self.size

    def find(self, w: Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, term numbers) of the words that are terms, by their bytes."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[t] == w.hash)
        t = t[hit]
        fits = w.end[hit] - w.start[hit] == self.size[t]
        hit, t = hit[fits], t[fits]
        low = np.frombuffer(raw.tobytes().translate(LOWER), np.uint8)
        ok = same_bytes(low, w.start[hit], self.size[t], self.flat, self.at[t])
        return hit[ok], t[ok]


def impacts(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to documents' scores: weight * ((10^9 tf) div (1000 tf + 20 m))."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Shard:
    """Posting lists (term -> local document numbers, ascending, and impacts) and pair lists of some documents."""

    def __init__(self, n_docs: int, lists: dict[int, tuple[np.ndarray, np.ndarray]], pairs: list[tuple[int, int]]):
        self.n_docs, self.lists = n_docs, lists
        self.top = {t: int(x.max(initial=0)) for t, (_, x) in lists.items()}
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        self.scored = 0  # documents proposed, over all searches
        for a, b in pairs:
            if a in lists and b in lists:
                docs, i, j = np.intersect1d(lists[a][0], lists[b][0], assume_unique=True, return_indices=True)
                joint = lists[a][1][i] + lists[b][1][j]
                best = np.argsort(-joint, kind="stable")
                self.pairs[a, b] = docs[best], joint[best], int(joint.max(initial=0))

    def units(self, terms: list[int]) -> list[tuple[int, tuple[int, ...]]]:
        """(bound, terms) of single terms and neighbouring pairs, each term once, with the least sum of bounds."""
        bound = lambda a, b: max(self.pairs[a, b][2], self.top[a], self.top[b])
        best: list[tuple[int, tuple]] = [(0, ())]  # of the first i terms: the sum, the last unit
        for i, t in enumerate(terms):
            new = (best[i][0] + self.top[t], (t,))
            if i and (terms[i - 1], t) in self.pairs:
                new = min(new, (best[i - 1][0] + bound(terms[i - 1], t), (terms[i - 1], t)))
            best.append(new)
        out, i = [], len(terms)
        while i:
            unit = best[i][1]
            out.append((best[i][0] - best[i - len(unit)][0], unit))
            i -= len(unit)
        return sorted(out)

    def at(self, t: int, docs: np.ndarray) -> np.ndarray:
        """The impacts of a term in some documents, 0 where it isn't."""
        own, x = self.lists[t]
        i = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[i] == docs, x[i], 0)

    def search(self, terms: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all that may be among the k best, with scores of `least` and more. terms: in the order whose
        neighbours have pair lists."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        here = [t for t in terms if t in self.lists]
        floor = max(1, least)
        if not here or sum(self.top[t] for t in here) < floor:
            return none
        units = self.units(here)
        if sum(u for u, _ in units) < floor:
            return none
        # the heads of the pair lists raise the threshold
        heads = [self.pairs[p][0][:4] for p in zip(here, here[1:], strict=False) if p in self.pairs]
        if heads and len(seeds := np.unique(np.concatenate(heads))) >= k:
            s = sum(self.at(t, seeds) for t in here)
            floor = max(floor, int(np.partition(s, len(s) - k)[len(s) - k]))
        choices = []
        for own in (units, sorted((self.top[t], (t,)) for t in here)):  # a pair can also tie a long list to a short one
            total = np.cumsum([u for u, _ in own])
            optional = int(np.searchsorted(total, floor))  # units whose sum of bounds is under the threshold
            choices.append((sum(len(self.lists[t][0]) for _, unit in own[optional:] for t in unit), len(choices), own, total, optional))
        _, _, units, total, optional = min(choices, key=lambda x: x[:2])
        if optional == len(units):
            return none
        score = np.zeros(self.n_docs, np.int64)
        for _, unit in units[optional:]:
            for t in unit:
                docs, x = self.lists[t]
                score[docs] += x
        found = np.flatnonzero(score)
        self.scored += len(found)
        for i in range(optional - 1, -1, -1):
            found = found[score[found] + total[i] >= floor]
            if len(found) >= k:
                s = score[found]
                floor = max(floor, int(np.partition(s, len(s) - k)[len(s) - k]))
            for t in units[i][1]:
                score[found] += self.at(t, found)
        found = found[score[found] >= floor]
        if len(found) >= k:
            s = score[found]
            found = found[s >= np.partition(s, len(s) - k)[len(s) - k]]
        return found, score[found]


def build_postings(docs: DataFrame, held) -> DataFrame:
    """docs (doc_id long, text) -> rows (shard, term, docs, tf, n, total), written. Of a term (>= 0): local document numbers
    and occurrences, packed, n documents. Of the shard (term -1): ids, null flags behind them, and lengths of its documents
    that have a query's term; n and total count all its documents with terms, and their terms."""

    def run(batches):
        vocabulary: Vocabulary = held.value
        v = max(1, len(vocabulary.hash))
        task, number = TaskContext.get().partitionId(), 0
        shard: dict = {}

        def fresh():
            shard.update(size=0, docs=0, n=0, total=0, ids=[], null=[], length=[], key=[], tf=[])

        def flush():
            nonlocal number
            key, tf = np.concatenate(shard["key"]), np.concatenate(shard["tf"])
            order = np.lexsort((key // v, key % v))
            term, doc, tf = (key % v)[order], (key // v)[order].astype(np.int32), tf[order].astype(np.int32)
            cut = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)) if len(term) else np.zeros(1, np.int64)
            ids = np.concatenate(shard["ids"]).tobytes() + np.concatenate(shard["null"]).astype(np.uint8).tobytes()
            rows = [(-1, ids, np.concatenate(shard["length"]).tobytes(), shard["n"], shard["total"])]
            rows += [(int(term[a]), doc[a:b].tobytes(), tf[a:b].tobytes(), int(b - a), 0) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            t, d, f, n, total = zip(*rows, strict=True)
            at = pa.array(np.full(len(rows), (task << 24) + number), pa.int64())
            number += 1
            fresh()
            return pa.RecordBatch.from_arrays([at, pa.array(t, pa.int32()), pa.array(d, pa.binary()), pa.array(f, pa.binary()), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=["shard", "term", "docs", "tf", "n", "total"])

        fresh()
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                raw, off = text_buffer(part.column("text"))
                w = Words(raw, off)
                hit, t = vocabulary.find(w, raw)
                key, tf = np.unique(w.doc[hit] * v + t, return_counts=True)
                own, local = np.unique(key // v, return_inverse=True)
                id_ = part.column("doc_id")
                shard["n"] += int((w.count > 0).sum())
                shard["total"] += int(w.count.sum())
                shard["key"].append((local + shard["docs"]) * v + key % v)
                shard["tf"].append(tf)
                shard["ids"].append(np.asarray(id_.fill_null(0).to_numpy(zero_copy_only=False), np.int64)[own])
                shard["null"].append(np.asarray(id_.is_null().to_numpy(zero_copy_only=False))[own])
                shard["length"].append(w.count[own].astype(np.int64))
                shard["docs"] += len(own)
                shard["size"] += len(raw)
                if shard["size"] >= SHARD:
                    yield flush()
        if shard["key"]:
            yield flush()

    return written(docs.select("doc_id", "text").mapInArrow(run, "shard long, term int, docs binary, tf binary, n long, total long"), "postings")


def search_shards(postings: DataFrame, parts: int, weights, queries, k: int, floors, n: int, total: int) -> DataFrame:
    """(query, doc_id, score): what may be among the k best of each query, shard by shard, written."""

    def run(batches):
        order, pairs = queries.value
        weight = weights.value
        now, rows = None, {}

        def search():
            head = rows.pop(-1)
            n_docs = len(head[1]) // 8
            ids = np.frombuffer(head[0][: 8 * n_docs], np.int64)
            null = np.frombuffer(head[0][8 * n_docs :], np.uint8) > 0
            m = 50 + (50 * np.frombuffer(head[1], np.int64) * n) // max(total, 1)
            lists = {}
            for t, (docs, tf) in rows.items():
                docs = np.frombuffer(docs, np.int32).astype(np.int64)
                lists[t] = docs, impacts(weight[t], np.frombuffer(tf, np.int32).astype(np.int64), m[docs])
            shard = Shard(n_docs, lists, pairs)
            out = []
            for q, terms in enumerate(order):
                found, score = shard.search(terms, k, floors.value[q])
                if len(found) > k:  # ties at the edge
                    found = (keep := np.lexsort((ids[found], null[found], -score))[:k], found[keep])[1]
                    score = score[keep]
                out.append((np.full(len(found), q), found, score))
            q, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids[found], pa.int64(), mask=null[found]), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

        for batch in batches:
            for s, t, docs, tf in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "docs", "tf")), strict=True):
                if s != now and rows:
                    yield search()
                    rows = {}
                now = s
                rows[t] = docs, tf
        if rows:
            yield search()

    dealt = postings.select("shard", "term", "docs", "tf").repartition(parts, "shard").sortWithinPartitions("shard")
    return written(dealt.mapInArrow(run, "query int, doc_id long, score long"), "ranked")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """docs (doc_id long, text), items (item_id, text) -> (item_id, rank from 1, doc_id, score): each item's k documents with
    the highest scores above 0, ties to the smaller doc_id, null ids last.

    A term is a run of letters, digits and non-ASCII characters, with A-Z lower-cased. A document's score sums over the
    item's terms weight * ((10^9 tf) div (1000 tf + 20 m)), with weight = floor(1000 ln((2N + 2) / (2 df + 1))) and
    m = 50 + (50 n N) div L. Null and empty texts have no terms: such documents are found by no item, such items find
    none. Repeated rows of docs are documents of their own, equal rows of items are one, and different texts of one
    item_id are ranked each on its own. Very long texts are read whole. No documents or no items: no rows. Items pass the
    driver, QUERIES at a time, and go to all tasks; each such group is one pass over docs."""
    spark = docs.sparkSession
    parts = parts_for(docs, mb=16)
    kind = items.schema["item_id"].dataType.simpleString()
    item_rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("length(text) > 0").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], f"item_id {kind}, rank long, doc_id long, score long")

    def some(group: list) -> DataFrame:
        vocabulary = Vocabulary([r.text for r in group])
        held = spark.sparkContext.broadcast(vocabulary)
        postings = build_postings(docs, held)
        counts = {r.term: (r.n, r.total) for r in postings.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}  # a row a term of these items
        n, total = counts.pop(-1, (0, 0))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, (df, _) in counts.items()}
        order = [sorted((t for t in q if t in weight), key=lambda t: (-weight[t], t)) for q in vocabulary.queries]
        pairs = sorted({p for q in order for p in zip(q, q[1:], strict=False)})
        weights, queries = spark.sparkContext.broadcast(weight), spark.sparkContext.broadcast((order, pairs))
        shards = postings.where("term = -1").select("shard").orderBy(F.xxhash64("shard")).limit(FIRST)
        first = [r.shard for r in shards.collect()]
        no_floor = spark.sparkContext.broadcast([0] * len(group))
        early = search_shards(postings.where(F.col("shard").isin(first)), FIRST, weights, queries, k, no_floor, n, total)
        floors = [0] * len(group)
        for r in best(early, k).where(F.col("rank") == k).select("query", "score").collect():  # a row a query
            floors[r["query"]] = r["score"]
        late = search_shards(postings.where(~F.col("shard").isin(first)), parts, weights, queries, k, spark.sparkContext.broadcast(floors), n, total)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(group)], f"query int, item_id {kind}")
        ranked = written(best(early.union(late), k).join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score"), "ranking")
        discard(postings, early, late)
        return ranked

    group, size = [], 0
    for r in item_rows.toLocalIterator():
        group.append(r)
        size += len(r.text)
        if len(group) >= QUERIES or size >= QUERY_BYTES:
            out, group, size = out.union(some(group)), [], 0
    return out.union(some(group)) if group else out
