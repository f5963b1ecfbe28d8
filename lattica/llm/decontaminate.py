"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is held against every
window of every training text; hits are verified word for word; spans or whole documents go.

Words: maximal runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A window: `n`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import WORD_CLASS, Words, slices, text_buffer, written

#: Windows that one broadcast set holds; a larger benchmark is scanned in blocks of whole items.
MAX_WINDOWS = 400_000


def _normal(raw: np.ndarray, words: Words, at: int, n: int) -> bytes:
    return b" ".join((WORD_CLASS[raw[words.start[i] : words.end[i]]] - np.uint64(1)).astype(np.uint8).tobytes() for i in range(at, at + n))


def _windows(items: list[tuple[str, str]], n: int) -> dict[int, dict[int, list[tuple[bytes, str]]]]:
    """length -> hash -> [(normalised words, item id)]."""
    out: dict = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        raw, off = text_buffer(pa.array([text], pa.large_string()))
        words = Words(raw, off)
        k = min(n, len(words.hash))
        if k:
            h, at = words.grams(k)
            for x, i in zip(h.tolist(), at.tolist(), strict=True):
                entry = (_normal(raw, words, i, k), item)
                if entry not in out[k][x]:
                    out[k][x].append(entry)
    return {k: dict(v) for k, v in out.items()}


def _pieces(text: str, n: int, most: int):
    """The text, or where it has more than `most` windows, stretches of it that have no more each and all together."""
    words = Words(*text_buffer(pa.array([text], pa.large_string())))
    last = len(words.hash) - n + 1  # windows
    if last <= most:
        yield text
        return
    raw = text.encode()
    for i in range(0, last, most):
        yield raw[words.start[i] : words.end[min(i + most, last) + n - 2]].decode()


def _scan(docs: DataFrame, items: list[tuple[str, str]], n: int, keep_text: bool = True) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(_windows(items, n))
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("_words", "_hits", "_items") and (keep_text or f.name != "text")])
    schema = schema.add("_words", T.LongType()).add("_hits", T.ArrayType(T.LongType())).add("_items", T.ArrayType(T.StringType()))
    again = "_hits" in docs.columns

    def scan(batches):
        sets = held.value
        keys = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in sets.items()}
        for batch in batches:
            for part in slices(batch):
                raw, off = text_buffer(part.column("text"))
                words = Words(raw, off)
                hits = [set(x or ()) for x in part.column("_hits").to_pylist()] if again else [set() for _ in range(part.num_rows)]
                found = [set(x or ()) for x in part.column("_items").to_pylist()] if again else [set() for _ in range(part.num_rows)]
                for k, known in keys.items():
                    h, at = words.grams(k)
                    slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    for i in np.flatnonzero(known[slot] == h):
                        first = int(at[i])
                        text = _normal(raw, words, first, k)
                        got = [item for w, item in sets[k][int(h[i])] if w == text]
                        if got:
                            d = words.doc[first]
                            found[d].update(got)
                            hits[d].update(range(first - int(words.first[d]), first - int(words.first[d]) + k))
                cols = [part.column(f.name) for f in schema.fields[:-3]]
                cols += [pa.array(words.count, pa.int64()), pa.array([sorted(x) for x in hits], pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(scan, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text; further columns ride along, but for those named as results) with n_words, hit_words (numbers,
    from 0, of the words inside an occurring window), items (ids, as strings, of items with occurring windows, distinct and
    sorted); without text unless keep_text.

    benchmark: (item_id, text). It is read to the driver in blocks of at most max_windows windows (a longer item in
    several); each block is one pass over the texts, so memory doesn't grow with the benchmark. A null or empty text has no
    words; very long ones are scanned whole; repeated rows are alike; an item whose id or text is null is no item;
    repeated items count once; an empty table hits nothing."""
    clash = {"_words", "_hits", "_items", "n_words", "hit_words", "items"} & set(docs.columns)
    docs = docs.drop(*clash).withColumn("text", F.col("text").cast("string"))
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).dropna().distinct()
    blocks: list[list] = [[]]
    size = 0
    for row in rows.toLocalIterator():  # one block is held at a time but the last: see below
        for text in _pieces(row[1], n, max_windows):
            more = max(1, len(text) // 2)  # no fewer than its windows
            if size + more > max_windows and blocks[-1]:
                docs = written(_scan(docs, blocks.pop(), n), "decontaminate")
                blocks.append([])
                size = 0
            blocks[-1].append((row[0], text))
            size += more
    out = _scan(docs, blocks[-1], n, keep_text)
    return out.withColumnsRenamed({"_words": "n_words", "_hits": "hit_words", "_items": "items"})


def digest(found: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without a hit, in the columns of docs."""
    found = find_contamination(docs, benchmark, n)
    return found.where(F.size("hit_words") == 0).select(docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All documents, hit words cut out of `text` (with what stands between words that are both hit)."""
    found = find_contamination(docs, benchmark, n)
    names = docs.columns

    def cut(batches):
        at = names.index("text")
        for batch in batches:
            for part in slices(batch):
                raw, off = text_buffer(part.column("text"))
                words = Words(raw, off)
                keep = np.ones(len(raw) + 1, np.int8)
                texts = part.column("text").to_pylist()
                for d, hits in enumerate(part.column("hit_words").to_pylist()):
                    if not hits:
                        continue
                    own = np.asarray(hits) + words.first[d]
                    for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                        keep[words.start[run[0]] : words.end[run[-1]]] = 0
                    a, b = off[d], off[d + 1]
                    texts[d] = raw[a:b][keep[a:b] > 0].tobytes().decode("utf-8", "replace")
                cols = [part.column(c) for c in names]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return found.mapInArrow(cut, docs.schema)
