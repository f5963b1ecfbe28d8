"""Shared pieces of the text operators: vectorised word splitting and hashing over Arrow buffers,
tables written to the shared checkpoint folder, evenly dealt record blobs, connected components."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the 64-bit hashes (fixed values, so that results repeat between runs).
BASE = U64(0x9E3779B97F4A7C15)
STEP = U64(0xD6E8FEB86659FD93)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))

# A byte's class: 0 outside words, else lower-cased byte + 1. Words are [0-9a-z] and all non-ASCII.
WORD_CLASS = np.zeros(256, np.uint64)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        WORD_CLASS[_b] = _b + 1
    elif 0x41 <= _b <= 0x5A:
        WORD_CLASS[_b] = _b + 0x20 + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all others."""
    x = x ^ (x >> U64(32))
    x = x * STEP
    x ^= x >> U64(29)
    x *= BASE
    x ^= x >> U64(32)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        m = 1 << max(12, (n - 1).bit_length())
        for name, b in (("up", BASE), ("down", BASE_INV)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 19):
    """Cut a batch so that each part holds about max_bytes of text (one row at least): the numpy
    temporaries of a part are a small multiple of it."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a run of texts: hash, byte range [start, end) and text number of each."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        n = len(raw)
        cls = WORD_CLASS[raw]
        inside = cls > 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = off[1:-1]
        if n:
            edge = edge[(edge > 0) & (edge < n)]
            first[edge] = inside[edge]  # words never cross texts
            last[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(cls * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(off) - 1))
        self.count = np.diff(np.append(self.first, len(self.start)))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k consecutive words of a text, and the number of each one's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[:n].copy()
        for j in range(1, k):
            h = h * STEP + self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        return mix(h[at]), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """grams(k); a text of fewer words, but not none, has one shingle of all its words.
        Returns hashes and text numbers, in text order."""
        h, at = self.grams(k)
        doc = self.doc[at]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = self.count[short] > j
                own[has] = own[has] * STEP + self.hash[self.first[short[has]] + j]
            h, doc = np.append(h, mix(own)), np.append(doc, short)
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        return h, doc


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, as in tests, a local one serves a local
    master; executors on other machines couldn't read each other's files there, so any other master is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lattica.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.lattica.dir", at)
    return at.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends there, and a lost executor costs no
    recomputation of what came before. Spark drops the shuffle files of the plan when it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `written` made and that no later plan reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(t.written_to)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def bundled(docs: DataFrame, *own: str) -> DataFrame:
    """docs with the named columns and all others in one struct, `_rest`, so that their names clash with nothing."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*rest, F.lit(True).alias("_")).alias("_rest"))


def unbundled(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The given columns again, after `bundled` with the same own ones; whatever else df has is left out."""
    return df.select(*(c if c in own else F.col("_rest").getField(c).alias(c) for c in columns))


def parts_for(df: DataFrame, mb: int = 8, least: int = 12) -> int:
    """How many parts to deal df's records into: in proportion to the bytes it scans, or to its text where the
    planner can't tell those."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 56:
        size = df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(least, min(1 << 16, math.ceil(size / (mb << 20))))


def to_parts(h: np.ndarray, n: int) -> np.ndarray:
    """Part numbers 0..n-1 from the high bits of well-mixed hashes."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)


def deal(part: np.ndarray, n: int, columns: dict[str, np.ndarray]):
    """Rows {part, <column>: packed bytes} of one task's records, one row for each part that gets any."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(cut)):
        own = order[cut[p] : cut[p + 1]]
        yield int(p), {k: v[own].tobytes() for k, v in columns.items()}


def first_of_each(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of window records (structured: hashes h and c, did, dk, begin, ...): the first of each different window, by did, dk
    and begin, and the others; a repeated row of a document is no other."""
    w = w[np.lexsort((w["begin"], w["dk"], w["did"], w["c"], w["h"]))]
    new = np.append(True, (w["h"][1:] != w["h"][:-1]) | (w["c"][1:] != w["c"][:-1])) if len(w) else np.zeros(0, bool)
    first = w[new]
    own = first[np.cumsum(new) - 1]
    return first, w[(w["did"] != own["did"]) | (w["dk"] != own["dk"]) | (w["begin"] != own["begin"])]


def connected_spans(did: np.ndarray, dk: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(dk, did, spans) of each document: its spans, united where they touch, packed as int64 pairs."""
    if not len(did):
        return []
    by = np.lexsort((start, dk, did))
    did, dk, start, end = did[by], dk[by], start[by], end[by]
    new = np.append(True, (did[1:] != did[:-1]) | (dk[1:] != dk[:-1]))
    doc = np.cumsum(new) - 1
    far = 1 << 40  # documents side by side, so that one running maximum does for all
    reach = np.maximum.accumulate(end + doc * far)
    first = np.append(True, (start + doc * far)[1:] > reach[:-1])
    at = np.flatnonzero(first)
    ends = np.append(reach[at[1:] - 1], reach[-1]) - doc[at] * far
    pair = np.stack([start[at], ends], 1).astype(np.int64)
    cut = np.append(np.flatnonzero(new[at]), len(at))
    own = at[cut[:-1]]
    return [(int(dk[i]), int(did[i]), pair[a:b].tobytes()) for i, a, b in zip(own, cut[:-1], cut[1:], strict=True)]


#: Edges of a graph whose minima (two nodes an edge at most) are broadcast.
FEW_EDGES = 100_000


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """Components of an undirected graph given as edges (a, b), any orderable type. Returns (node, root),
    root the least node of the component; nodes without edges don't appear.

    Alternating large-star and small-star steps (grouped minima and joins, no driver state); each round's edges are written
    to the shared folder. Minima are pre-aggregated before the shuffle. Of up to FEW_EDGES edges the minima are broadcast;
    else both sides of a join are read from files, so that the adaptive skew join can split a hot centre. Stops when the
    edges no longer change."""
    e = written(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), name)

    def mark(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = mark(e)
    while was[0]:
        kept = [e]

        def ready(d: DataFrame, few: bool = was[0] <= FEW_EDGES, kept: list = kept) -> DataFrame:
            if few:
                return F.broadcast(d)
            kept.append(written(d, name))
            return kept[-1]

        both = e.union(e.selectExpr("b", "a"))
        low = ready(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m"))
        large = both.join(low, "a").where("b > a").selectExpr("b AS u", "m AS v").where("u <> v").distinct()
        if was[0] > FEW_EDGES:
            large = ready(large)
        least = ready(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").selectExpr("explode(array(struct(u AS b, m AS a), struct(v AS b, m AS a))) AS x")
        new = written(small.select("x.a", "x.b").where("a <> b").distinct(), name)
        discard(*kept)
        e = new
        now = mark(e)
        if now == was:
            break
        was = now
    out = e.groupBy("b").agg(F.min("a").alias("root")).selectExpr("b AS node", "root")
    return out.union(e.selectExpr("a AS node", "a AS root")).groupBy("node").agg(F.min("root").alias("root"))
