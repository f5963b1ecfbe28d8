"""Near-duplicate documents by order min-hash.

A text is the sequence of its runs of `k` words (a shorter text: one run of all its words), each labelled with
its occurrence number, so that every element is met once. A sketch takes the two least elements under a hash and
keeps them in the order of the text: two texts agree in it with about the square of their similarity, less where
order differs, as edit similarity does. Bands of `rows` sketches propose pairs; a banded alignment of the two
sequences decides. With L elements aligned in order of n and m, the similarity is L / (n + m - L)."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import STEP, U64, Words, bundled, discard, mix, slices, text_buffer, unbundled, written
from lattica.llm.group_search import search_groups

TOP = U64((1 << 64) - 1)


def labelled(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-word runs of each text, in text order, and their text numbers."""
    h, doc = Words(raw, off).shingles(k)
    key = mix(h ^ (doc.astype(np.uint64) * STEP))
    by = np.argsort(key, kind="stable")
    s = key[by]
    new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    if new.all():
        return h, doc
    start = np.flatnonzero(new)
    number = np.empty(len(h), np.uint64)
    number[by] = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    again = number > 0
    h = h.copy()
    h[again] = mix(h[again] + number[again] * STEP)
    return h, doc


def order_sketches(h: np.ndarray, doc: np.ndarray, n: int, sketches: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts that have elements, their sketches)."""
    count = np.bincount(doc, minlength=n)
    some = np.flatnonzero(count)
    if not len(some):
        return some, np.zeros((0, sketches), np.uint64)
    size = count[some]
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    slot = np.repeat(np.arange(len(some)), size)
    rng = np.random.default_rng(0)
    out = np.empty((len(some), sketches), np.uint64)

    def least(v: np.ndarray) -> np.ndarray:
        low = np.minimum.reduceat(v, start)
        at = np.flatnonzero(v == low[slot])
        first = np.searchsorted(slot[at], np.arange(len(some)))
        return at[first]

    for s in range(sketches):
        v = (h ^ U64(rng.integers(1 << 63))) * U64(int(rng.integers(1 << 63)) * 2 + 1)
        a = least(v)
        v[a] = TOP
        b = np.where(size > 1, least(v), a)
        out[:, s] = mix(h[np.minimum(a, b)] * STEP + h[np.maximum(a, b)])
    return some, out


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Ordered similarity of two sequences of distinct elements by alignment within the band that the threshold
    allows; a value below it may be too small."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = threshold * (n + m) / (1 + threshold)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = n + m - 2 * need
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return len(i) / (n + m - len(i))
    j = j[np.argsort(i, kind="stable")]
    if (j[1:] > j[:-1]).all():
        length = len(j)
    else:  # the longest ascending run of partners
        ends: list[int] = []
        for x in j.tolist():
            at = bisect_left(ends, x)
            if at == len(ends):
                ends.append(x)
            else:
                ends[at] = x
        length = len(ends)
    return length / (n + m - length)


def with_key(docs: DataFrame) -> DataFrame:
    """docs with text not null and `full`, which equal texts share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn("full", F.unhex(F.md5("text")))


def find_links(docs: DataFrame, k: int, threshold: float, bands: int, rows: int, small: int = 12):
    """(features, texts, links, roots): doc_id and full of every row; one row for each different text (full, d: its
    least doc_id, n elements); verified pairs (a, b) of texts; and the component (node, root) of each text in a pair.

    A band's group is searched to the end, whatever its size (see search_groups); `small` only says from which size on
    in blocks."""

    def sketch(batches):
        for batch in batches:
            for part in slices(batch):
                h, doc = labelled(*text_buffer(part.column("text")), k)
                some, s = order_sketches(h, doc, part.num_rows, bands * rows)
                key = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    key = key * STEP + s[:, r::rows]
                key = mix(key + np.arange(1, bands + 1, dtype=np.uint64))
                size = np.bincount(doc, minlength=part.num_rows)
                lists = [None] * part.num_rows
                for i, x in zip(some.tolist(), key.view(np.int64).tolist(), strict=True):
                    lists[i] = x
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("full"), pa.array(size, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "full", "n", "bands"])

    base = with_key(docs.select("doc_id", "text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    features = written(base.mapInArrow(sketch, f"doc_id {id_type}, full binary, n int, bands array<long>"), "near-rows")
    texts = written(features.groupBy("full").agg(F.min("doc_id").alias("d"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-texts")
    each = texts.where("n > 0").select("full", "n", F.explode("bands").alias("key"))
    sizes = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = written(each.join(sizes, "key"), "near-met")

    def seq(batches):
        for batch in batches:
            for part in slices(batch):
                h, doc = labelled(*text_buffer(part.column("text")), k)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("full"), pa.array([h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["full", "seq"])

    # the elements of every text that met another one: texts are read and shuffled once, whatever follows
    wanted = met.select("full").distinct().join(texts.select("full", "d"), "full").withColumnRenamed("full", "w")
    own = base.join(wanted.hint("shuffle_hash"), (F.col("full") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("full", "text")
    sequences = written(own.mapInArrow(seq, "full binary, seq binary").dropDuplicates(["full"]), "near-sequences")

    links, roots = search_groups(met, sequences, lambda x, y: similarity(x, y, threshold), threshold, "near", small)
    discard(met, sequences)
    return features, texts, links, roots


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 3) -> DataFrame:
    """docs (doc_id, text) -> one row for each of its rows: doc_id, class_id, first (whether its text is
    the class's least by doc_id), full.

    Documents are in a class if a chain of pairs joins them, each equal or of similarity >= threshold and met in a band.
    class_id: the least doc_id of the class (nulls aside; null if there is no other). Words: runs of [0-9a-z] and
    non-ASCII after lower-casing A-Z. Null is the empty text; texts without words are only equal, not similar, to others.
    Repeated rows are copies. Texts are compared whole, however long. Ties: of runs with equal hashes in a sketch the first
    in the text. Other columns, whatever their names, are left out. An empty table gives none."""
    features, texts, _, roots = find_links(docs, k, threshold, bands, rows)
    own = texts.select("full", "d").join(roots.withColumnRenamed("node", "full"), "full", "left")
    own = written(own.select("full", "d", F.coalesce("root", "full").alias("root")), "near-classes")
    discard(texts, roots)
    least = own.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("none"), F.col("d"), F.col("full"))).alias("m"))
    own = own.join(least, "root").select("full", F.col("m.d").alias("class_id"), (F.col("m.full") == F.col("full")).alias("first"))
    return features.select("doc_id", "full").join(own, "full").select("doc_id", "class_id", "first", "full")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, in the columns of docs, whatever their names: the first by doc_id, of repeated rows any one;
    of a class without any doc_id one with a null id. Nulls, texts without words, long texts and empty tables are as in
    near_duplicates."""
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    keep = found.where("first").where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("full").agg(F.min("class_id").alias("keep_id"), F.count("*").alias("times"))
    keep = written(keep.withColumnRenamed("full", "keep_full"), "near-keep").hint("shuffle_hash")
    rows = bundled(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.join(keep, (F.unhex(F.md5(text)) == F.col("keep_full")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    once = rows.where("times = 1")
    several = rows.where("times > 1").dropDuplicates(["keep_full"])
    return unbundled(once.union(several), docs.columns, "doc_id", "text")
