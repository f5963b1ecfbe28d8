"""Exact substring deduplication by a common-prefix-aware distributed merge sort of suffixes.

A byte is removed if a `window`-byte string that covers it also starts earlier (smaller doc_id, or the same
document further left). Only one suffix in about forty has to be sorted: the anchors, picked by content so
that equal windows hold equal anchors at equal offsets (the least hash of the `gram`-byte strings in the
window). Steps:

1. Each task sends its anchors' hashes, as packed blobs, to parts dealt evenly by hash; a hash met twice
   names anchors whose string may repeat. A task sends one record for each hash it has, however often.
2. The suffixes at these anchors (right context to the window's length, then left context read backwards)
   are sorted in runs by the tasks that hold the texts. Equal suffixes of a run are merged into the first
   and the others' windows are repeats. Runs are front-coded (length of the prefix shared with the
   suffix before, then the rest) and exchanged.
3. A loser tree merges a part's runs. It keeps, for each run's head, the length of the prefix shared with
   the last winner: heads that differ in it are ordered without touching their bytes, and equal ones are
   compared from there on. Equal suffixes are merged as before.
4. Different suffixes with the same anchor string are compared window by window: of equal windows (hashes propose
   them, bytes decide) all but the first are repeats.
5. An anchor string met very often (a frequent line, say, whose contexts all differ) would put all its suffixes into one
   part. Its windows are dealt instead, evenly by their own hashes: a task sends one record for each different
   window, and of equal windows (128 bits) all but the first are repeats.
6. Each document's repeated windows are united and cut out."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import U64, connected_spans, deal, first_of_each, mix, parts_for, powers, slices, text_buffer, to_parts, written

NO_ID = (1 << 63) - 1
KNOWN = np.uint32(0xFFFFFFFF)
#: Suffixes a task sorts at once, and different suffixes compared window by window at once.
RUN, BLOCK = 60_000, 16_000
#: An anchor string met more often than this, or than once in HOT_BYTES bytes of the input, is one of step 5; so these are
#: 3 million at most, whatever the input.
HOT, HOT_BYTES = 4096, 100_000_000
SPAN = np.dtype([("did", "<i8"), ("dk", "<i4"), ("begin", "<i4"), ("end", "<i4")])
WINDOW = np.dtype([("h", "<u8"), ("c", "<u8"), ("did", "<i8"), ("dk", "<i4"), ("begin", "<i4")])


def rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of raw."""
    n = len(raw)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + U64(1)) * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def anchors(raw: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in raw of the anchors of all windows that lie in one text, and their hashes."""
    h = rolling(raw, gram)
    span = window - gram + 1
    n = len(raw) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), h[:0]
    key = (h & ~U64((1 << 31) - 1)) | np.arange(len(h), dtype=np.uint64)
    low, width = key, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low[:n] & U64((1 << 31) - 1)).astype(np.int64)
    inside = np.ones(n, bool)
    for b in off[1:-1]:
        inside[max(0, b - window + 1) : b] = False
    at = at[inside]
    if len(at):
        at = at[np.append(True, at[1:] != at[:-1])]
    return at, h[at]


def anchor_parts(h: np.ndarray, n: int) -> np.ndarray:
    """Parts of anchors: their hashes, the least of many, are small, so they are hashed again."""
    return to_parts(mix(h + U64(9)), n)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of equally long a and b, of which `known` bytes are known to be common."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[list[bytes], list[int]]]):
    """Merge ascending runs of equally long strings, each with the lengths of the prefixes shared with the string
    before. Yields (run, index, prefix shared with the string yielded before); never re-compares known prefixes."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    at = [0] * k
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    common = [0] * k  # of each head with the last winner
    loser = [0] * (2 * k)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); afterwards the loser's `common` is its prefix shared with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = common[a], common[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = shared(x, y, p)
        if n == len(x) or x[n] < y[n]:
            common[b] = n
            return a, b
        common[a] = n
        return b, a

    won = [0] * (2 * k)
    for i in range(k):
        won[k + i] = i
    for i in range(k - 1, 0, -1):
        won[i], loser[i] = play(won[2 * i], won[2 * i + 1])
    top = won[1] if k > 1 else 0
    while head[top] is not None:
        yield top, at[top], common[top]
        rows, lcp = runs[top]
        at[top] += 1
        if at[top] < len(rows):
            head[top], common[top] = rows[at[top]], lcp[at[top]]
        else:
            head[top] = None
        i = (k + top) >> 1
        while i:
            top, loser[i] = play(top, loser[i])
            i >>= 1


class Suffixes:
    """Suffixes at anchors as fixed-size rows: right context (zero-padded), its length, reversed left context
    (zero-padded), its length; and the document (did, dk) and position of each."""

    def __init__(self, window: int, gram: int):
        self.window, self.left = window, window - gram
        self.size = window + self.left + 2
        self.rows: list[np.ndarray] = []
        self.did: list[np.ndarray] = []
        self.dk: list[np.ndarray] = []
        self.pos: list[np.ndarray] = []
        self.n = 0

    def add(self, text: np.ndarray, pos: np.ndarray, did: int, dk: int) -> None:
        n, w, left = len(text), self.window, self.left
        padded = np.concatenate([np.zeros(left, np.uint8), text, np.zeros(w, np.uint8)])
        own = np.lib.stride_tricks.sliding_window_view(padded, left + w)[pos]
        row = np.empty((len(pos), self.size), np.uint8)
        row[:, :w] = own[:, left:]
        row[:, w] = np.minimum(w, n - pos)
        row[:, w + 1 : -1] = own[:, left - 1 :: -1] if left else own[:, :0]
        row[:, -1] = np.minimum(left, pos)
        self.rows.append(row)
        self.did.append(np.full(len(pos), did, np.int64))
        self.dk.append(np.full(len(pos), dk, np.int64))
        self.pos.append(pos)
        self.n += len(pos)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        out = tuple(np.concatenate(x) for x in (self.rows, self.did, self.dk, self.pos))
        self.rows, self.did, self.dk, self.pos, self.n = [], [], [], [], 0
        return out


def whole_span(row: np.ndarray, pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all windows around each suffix's anchor, and whether there are any."""
    right, left = row[:, window].astype(np.int64), row[:, -1].astype(np.int64)
    return pos - left, pos + right, left + right >= window


def repeated_windows(row: np.ndarray, group: np.ndarray, order: np.ndarray, pos: np.ndarray, window: int):
    """For different suffixes with equal anchors (group): which of their windows are not the first of their kind.
    Returns (row number, start, end) of the runs of such windows. order: ranks of the rows by document and position."""
    left = row.shape[1] - window - 2
    m = len(row)
    w = np.zeros((m, left + 1), np.uint64)
    up, down = powers(left + window + 1)
    for i in range(0, m, 4096):
        part = row[i : i + 4096]
        text = np.concatenate([part[:, window + 1 : -1][:, ::-1], part[:, :window]], axis=1).astype(np.uint64) + U64(1)
        total = np.zeros((len(part), left + window + 1), np.uint64)
        np.cumsum(text * up[: left + window], axis=1, out=total[:, 1:])
        for o in range(left + 1):
            w[i : i + 4096, o] = (total[:, left + window - o] - total[:, left - o]) * down[left - o]
    w = mix(w) ^ mix(group.astype(np.uint64) + U64(1))[:, None]
    again = np.zeros((m, left + 1), bool)
    for o in range(left + 1):
        fits = np.flatnonzero((row[:, -1] >= o) & (row[:, window].astype(np.int64) >= window - o))
        if len(fits) > 1:
            by = fits[np.lexsort((order[fits], w[fits, o]))]
            for at in np.array_split(np.flatnonzero(w[by[1:], o] == w[by[:-1], o]), -(-len(by) // 4096)):
                one, two = row[by[at + 1]], row[by[at]]
                same = (one[:, : window - o] == two[:, : window - o]).all(1) & (one[:, window + 1 : window + 1 + o] == two[:, window + 1 : window + 1 + o]).all(1)
                again[by[at + 1], o] = same
    edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)  # exclusive
    return i, pos[i] - (last - 1), pos[i] - first + window


def windows(row: np.ndarray, pos: np.ndarray, did: np.ndarray, dk: np.ndarray, window: int) -> np.ndarray:
    """Records of all windows around the suffixes' anchors."""
    left = row.shape[1] - window - 2
    text = np.concatenate([row[:, window + 1 : -1][:, ::-1], row[:, :window]], axis=1).astype(np.uint64)
    up, down = powers(left + window + 1)
    sums = []
    for t in (text + U64(1), mix(text + U64(300))):
        total = np.zeros((len(row), left + window + 1), np.uint64)
        np.cumsum(t * up[: left + window], axis=1, out=total[:, 1:])
        sums.append(total)
    out = []
    for o in range(left + 1):
        i = np.flatnonzero((row[:, -1] >= o) & (row[:, window].astype(np.int64) >= window - o))
        w = np.zeros(len(i), WINDOW)
        for c, total in zip(("h", "c"), sums, strict=True):
            w[c] = mix((total[i, left + window - o] - total[i, left - o]) * down[left - o])
        w["did"], w["dk"], w["begin"] = did[i], dk[i], pos[i] - o
        out.append(w)
    return np.concatenate(out)


def _spans(did: np.ndarray, dk: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """The spans of all documents, united, as records in one packed row for each of n buckets of documents."""
    if not len(did):
        return []
    w = np.zeros(len(did), SPAN)
    for c, v in (("did", did), ("dk", dk), ("begin", start), ("end", end)):
        w[c] = v
    w = united(w)
    return [(k, x["w"]) for k, x in deal(np.mod(w["dk"].astype(np.int64), n), n, {"w": w})]


def united(w: np.ndarray) -> np.ndarray:
    rows = connected_spans(w["did"], w["dk"].astype(np.int64), w["begin"].astype(np.int64), w["end"].astype(np.int64))
    out = []
    for dk, did, data in rows:
        pair = np.frombuffer(data, np.int64).reshape(-1, 2)
        own = np.zeros(len(pair), SPAN)
        own["did"], own["dk"], own["begin"], own["end"] = did, dk, pair[:, 0], pair[:, 1]
        out.append(own)
    return np.concatenate(out) if out else w[:0]


def unpack_spans(batches):
    """Packed rows of a bucket -> a row (dk, did, data: spans as int64 pairs) for each document."""
    held = [np.frombuffer(x.as_buffer(), SPAN) for batch in batches for x in batch.column("data")]
    if held:
        w = np.concatenate(held)
        rows = connected_spans(w["did"], w["dk"].astype(np.int64), w["begin"].astype(np.int64), w["end"].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["dk", "did", "data"])


def unpack_positions(batches):
    """Packed rows of a bucket -> a row (dk, did 0, data: positions as uint32) for each document."""
    held = []
    for batch in batches:
        for x in batch.column("data"):
            data = x.as_buffer()
            n = len(data) // 8
            held.append((np.frombuffer(data, np.int32, n), np.frombuffer(data, np.uint32, n, 4 * n)))
    if held:
        d, p = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(d, kind="stable")
        d, p = d[by], p[by]
        cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        data = [p[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(d)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(np.zeros(len(cut), np.int64)), pa.array(data, pa.binary())], names=["dk", "did", "data"])


def _front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the prefix each row shares with the row before, and the remaining bytes of all rows."""
    if not len(rows):
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    differ = rows[1:] != rows[:-1]
    lcp = np.append(0, np.where(differ.any(1), differ.argmax(1), rows.shape[1])).astype(np.uint8)
    keep = np.arange(rows.shape[1])[None, :] >= lcp[:, None]
    return lcp, rows[keep]


def _decode(lcp: list[int], rest: bytes, size: int) -> list[bytes]:
    out, last, at = [], b"", 0
    for n in lcp:
        last = last[:n] + rest[at : at + size - n]
        at += size - n
        out.append(last)
    return out


def _with_text(texts: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """texts with the packed lists of their documents (null: none). Both sides are dealt by dk."""
    own = lists.groupBy("dk").agg(F.collect_list(F.struct("did", "data")).alias(name))
    return texts.join(own.hint("shuffle_hash"), "dk", "left")


def remove_repeats(docs: DataFrame, window: int = 100, gram: int = 32, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text) -> one row for each of its rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    keep_text the remaining bytes as `kept` (binary).

    Texts are UTF-8 bytes, null is empty; texts shorter than window keep all; long ones are searched whole. A null doc_id
    comes after all others; different texts that share a doc_id, which the contract doesn't order, are ordered by a hash. Of
    equal texts the one with the smallest doc_id is searched for repeats, the others, repeated rows among them, are
    repeats as a whole. Other columns, whatever their names, are left out. An empty table gives none."""
    n_parts = parts_for(docs)
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumns({"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "full": F.unhex(F.md5("text"))})
    base = base.withColumn("dk", F.shiftright(F.xxhash64("did", "full"), 33).cast("int"))
    ids = base.select("doc_id", "did", "full", "dk", F.octet_length("text").cast("long").alias("n_bytes")).groupBy("doc_id", "did", "full", "dk", "n_bytes").agg(F.count("*").alias("times"))
    ids = written(ids, "suffix-ids")
    hot_from = max(HOT, (ids.agg(F.sum("n_bytes")).first()[0] or 0) // HOT_BYTES)
    first = written(ids.groupBy("full").agg(F.min("did").alias("first")), "suffix-first")  # read from files, so that the join of a text with many copies can be split
    marked = written(ids.join(first, "full").withColumn("own", F.col("did") == F.col("first")), "suffix-docs")
    searched = marked.where((F.col("n_bytes") >= window) & F.col("own")).groupBy("dk").agg(F.collect_list(F.struct("did", "full")).alias("searched"))
    texts = base.where(F.octet_length("text") >= window).select("dk", "did", "full", "text").join(searched.hint("shuffle_hash"), "dk")
    texts = texts.where(F.array_contains("searched", F.struct("did", "full"))).select("dk", "did", "full", "text")

    def find(batches):
        h_, d_, p_, n = [], [], [], 0

        def flush():
            h, d, p = np.concatenate(h_), np.concatenate(d_), np.concatenate(p_)
            by = np.argsort(h, kind="stable")
            h, d, p = h[by], d[by], p[by]
            new = np.append(True, h[1:] != h[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(h)))
            many = np.repeat(size > 1, size)
            if many.any():  # a string this task has several times is known to repeat
                yield from positions(d[many], p[many])
            one = np.flatnonzero(new)
            code = np.where(size > 1, KNOWN, p[one].astype(np.uint32))
            part, data = [], []
            times = np.minimum(size, 65_535).astype(np.uint16)
            for k, x in deal(anchor_parts(h[one], n_parts), n_parts, {"h": h[one].astype(np.uint32), "d": d[one].astype(np.uint32), "p": code, "n": times}):
                part.append(k)
                data.append(b"".join(x.values()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([0] * len(part), pa.int32()), pa.array(data, pa.binary())], names=["part", "dk", "data"])

        for batch in batches:
            for piece in slices(batch):
                raw, off = text_buffer(piece.column("text"))
                at, h = anchors(raw, off, window, gram)
                doc = np.searchsorted(off, at, side="right") - 1
                h_.append(h)
                d_.append(piece.column("dk").to_numpy()[doc])
                p_.append(at - off[doc])
                n += len(at)
                if n > 400_000:
                    yield from flush()
                    h_, d_, p_, n = [], [], [], 0
        if n:
            yield from flush()

    def positions(d, p):
        """Rows (-1, bucket, documents and positions): one for each bucket of documents, not for each document."""
        own = {"d": d.astype(np.int32), "p": p.astype(np.uint32)}
        dealt = [(k, x["d"] + x["p"]) for k, x in deal(np.mod(own["d"].astype(np.int64), n_parts), n_parts, own)]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(dealt), pa.int32()), pa.array([k for k, _ in dealt], pa.int32()), pa.array([x for _, x in dealt], pa.binary())], names=["part", "dk", "data"])

    def meet(batches):
        """Positions of anchors met twice; part -2: the keys of those met very often."""
        held: dict[int, list] = {}
        for batch in batches:
            own = batch.column("part").to_numpy() < 0
            if own.any():
                yield batch.filter(pa.array(own))
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if part >= 0:
                    data = data.as_buffer()
                    n = len(data) // 14
                    held.setdefault(part, []).append((*np.frombuffer(data, np.uint32, 3 * n).reshape(3, n), np.frombuffer(data, np.uint16, n, 12 * n)))
        for part, own in held.items():
            h, d, p, times = (np.concatenate(x) for x in zip(*own, strict=True))
            by = np.argsort(h, kind="stable")
            h, d, p, times = h[by], d[by], p[by], times[by]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(new, len(h)))
            some = np.repeat(size > 1, size) & (p != KNOWN)
            if some.any():
                yield from positions(d[some].astype(np.int32), p[some])
            hot = h[new[np.add.reduceat(times.astype(np.int64), new) > hot_from]]
            if len(hot):
                keys = (np.int64(part) << 32 | hot.astype(np.int64)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int32()), pa.array([0], pa.int32()), pa.array([keys], pa.binary())], names=["part", "dk", "data"])

    packed = "part int, dk int, data binary"
    sent = texts.select("dk", "text").mapInArrow(find, packed)
    # rows with part -1 are answers already; they are dealt along by document
    met = sent.repartitionById(n_parts, F.when(F.col("part") < 0, F.pmod("dk", F.lit(n_parts))).otherwise(F.col("part")).cast("int")).mapInArrow(meet, packed)
    met = written(met, "suffix-met")
    hot = [np.frombuffer(bytes(r[0]), np.int64) for r in met.where("part = -2").select("data").toLocalIterator()]  # see HOT_BYTES
    hot_keys = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.int64))
    lists = met.where("part = -1").repartitionById(n_parts, F.col("dk")).select("data").mapInArrow(unpack_positions, "dk int, did long, data binary")

    def cut_runs(batches):
        held, seen = Suffixes(window, gram), set()

        def flush():
            row, did, dk, pos = held.take()
            order = np.lexsort((pos, dk, did))
            row, did, dk, pos = row[order], did[order], dk[order], pos[order]
            by = np.argsort(np.ascontiguousarray(row).view(f"S{held.size}").ravel(), kind="stable")
            row, did, dk, pos = row[by], did[by], dk[by], pos[by]
            same = np.append(False, (row[1:] == row[:-1]).all(1))
            start, end, any_ = whole_span(row, pos, window)
            yield from answers(_spans(*(x[same & any_] for x in (did, dk, start, end)), n_parts))
            row, did, dk, pos = (x[~same] for x in (row, did, dk, pos))
            h = rolling_rows(row[:, :gram])
            part = anchor_parts(h, n_parts)
            hot = np.isin(part << 32 | h.astype(np.uint32).astype(np.int64), hot_keys.value)
            for at in np.array_split(np.flatnonzero(hot), -(-int(hot.sum()) // 4096) or 1):
                first, others = first_of_each(windows(row[at], pos[at], did[at], dk[at], window))
                yield from answers(_spans(others["did"], others["dk"], others["begin"], others["begin"] + window, n_parts))
                if len(first):
                    dealt = [(k, x["w"]) for k, x in deal(to_parts(first["h"], n_parts), n_parts, {"w": first})]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int32()), pa.array([1] * len(dealt), pa.int32()), pa.array([0] * len(dealt), pa.int64()), pa.array([x for _, x in dealt], pa.binary())], names=["part", "dk", "did", "data"])
            row, did, dk, pos, part = (x[~hot] for x in (row, did, dk, pos, part))
            ks, datas = [], []
            for k in np.unique(part):
                own = np.flatnonzero(part == k)
                lcp, rest = _front_code(row[own])
                ks.append(int(k))
                datas.append(np.array([len(own)], np.int64).tobytes() + did[own].tobytes() + dk[own].tobytes() + pos[own].astype(np.int64).tobytes() + lcp.tobytes() + rest.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array([0] * len(ks), pa.int32()), pa.array([0] * len(ks), pa.int64()), pa.array(datas, pa.binary())], names=["part", "dk", "did", "data"])

        for batch in batches:
            for piece in slices(batch):
                raw, off = text_buffer(piece.column("text"))
                cols = [piece.column(c).to_pylist() for c in ("dk", "did", "full", "lists")]
                for i, (dk, did, full, lists_) in enumerate(zip(*cols, strict=True)):
                    if not lists_ or (did, full) in seen:
                        continue
                    seen.add((did, full))
                    text = raw[off[i] : off[i + 1]]
                    pos = np.unique(np.concatenate([np.frombuffer(x["data"], np.uint32) for x in lists_])).astype(np.int64)
                    held.add(text, pos[pos + gram <= len(text)], did, dk)
                    if held.n >= RUN:
                        yield from flush()
        if held.n:
            yield from flush()

    def answers(spans):
        """Rows (-1, bucket, 0, spans), which the next step hands on."""
        if spans:
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(spans), pa.int32()), pa.array([k for k, _ in spans], pa.int32()), pa.array([0] * len(spans), pa.int64()), pa.array([x for _, x in spans], pa.binary())], names=["part", "dk", "did", "data"])

    def rolling_rows(x):
        up, _ = powers(64)
        return mix(((x.astype(np.uint64) + U64(1)) * up[: x.shape[1]]).sum(1, dtype=np.uint64))

    def merge(batches):
        def told(spans):
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in spans], pa.int32()), pa.array([x for _, x in spans], pa.binary())], names=["bucket", "data"])

        size = window + (window - gram) + 2
        runs, did_, dk_, pos_ = [], [], [], []
        hot = []
        for batch in batches:
            for part, dk, did, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([dk], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])
                    continue
                if dk:
                    hot.append(np.frombuffer(data, WINDOW))
                    continue
                n = int(np.frombuffer(data[:8], np.int64)[0])
                ints = np.frombuffer(data[8 : 8 + 24 * n], np.int64).reshape(3, n)
                lcp = np.frombuffer(data[8 + 24 * n : 8 + 25 * n], np.uint8).tolist()
                runs.append((_decode(lcp, data[8 + 25 * n :], size), lcp))
                did_.append(ints[0])
                dk_.append(ints[1])
                pos_.append(ints[2])
        if hot:
            others = first_of_each(np.concatenate(hot))[1]
            yield from told(_spans(others["did"], others["dk"], others["begin"], others["begin"] + window, n_parts))
        if not runs:
            return
        # merged: the different suffixes, each with its first holder; copies: the holders of the others
        group: list[tuple] = []
        todo: list[list[tuple]] = []
        n_todo = 0
        copies: list[tuple] = []

        def spans_of(items):
            row = np.frombuffer(b"".join(x[0] for x in items), np.uint8).reshape(len(items), size)
            did, dk, pos = (np.array([x[i] for x in items], np.int64) for i in (1, 2, 3))
            return row, did, dk, pos

        def flush_copies():
            row, did, dk, pos = spans_of(copies)
            start, end, any_ = whole_span(row, pos, window)
            return told(_spans(*(x[any_] for x in (did, dk, start, end)), n_parts))

        def flush_groups():
            row, did, dk, pos = spans_of([x for g in todo for x in g])
            number = np.repeat(np.arange(len(todo)), [len(g) for g in todo])
            rank = np.empty(len(row), np.int64)
            rank[np.lexsort((pos, dk, did))] = np.arange(len(row))
            i, start, end = repeated_windows(row, number, rank, pos, window)
            return told(_spans(did[i], dk[i], start, end, n_parts))

        last = None
        for r, i, lcp in merge_runs(runs):
            x = (runs[r][0][i], int(did_[r][i]), int(dk_[r][i]), int(pos_[r][i]))
            if last is not None and lcp == size:
                if x[1:] < last[1:]:
                    x, last = last, x
                    group[-1] = last
                copies.append(x)
                if len(copies) >= 50_000:
                    yield from flush_copies()
                    copies = []
                continue
            if last is not None and lcp < gram:
                if len(group) > 1:
                    todo.append(group)
                    n_todo += len(group)
                    if n_todo >= BLOCK:
                        yield from flush_groups()
                        todo, n_todo = [], 0
                group = []
            group.append(x)
            last = x
        if len(group) > 1:
            todo.append(group)
        for some, flush in ((copies, flush_copies), (todo, flush_groups)):
            if some:
                yield from flush()

    runs = _with_text(texts, lists, "lists").where("lists IS NOT NULL").mapInArrow(cut_runs, "part int, dk int, did long, data binary")
    spans = runs.repartitionById(n_parts, F.when(F.col("part") < 0, F.pmod("dk", F.lit(n_parts))).otherwise(F.col("part")).cast("int")).mapInArrow(merge, "bucket int, data binary")
    spans = spans.repartitionById(n_parts, F.col("bucket")).select("data").mapInArrow(unpack_spans, "dk int, did long, data binary")
    schema = "did long, full binary, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches):
        seen: set = set()
        for batch in batches:
            for piece in slices(batch):
                raw, off = text_buffer(piece.column("text"))
                out: list[tuple] = []
                for i, (did, full, spans_) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("did", "full", "spans")), strict=True)):
                    if (did, full) in seen:
                        continue
                    seen.add((did, full))
                    text = raw[off[i] : off[i + 1]]
                    own = [np.frombuffer(x["data"], np.int64).reshape(-1, 2) for x in spans_ or () if x["did"] == did]
                    edge = np.zeros(len(text) + 1, np.int64)
                    for pair in own:
                        np.add.at(edge, pair[:, 0], 1)
                        np.add.at(edge, pair[:, 1], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = text[~gone].tobytes()
                    n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    out.append((did, full, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
                if out:
                    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["did", "full", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = _with_text(texts, spans, "spans").mapInArrow(cut, schema).withColumn("copy", F.lit(0))
    long_ = marked.where(F.col("n_bytes") >= window)
    rows = long_.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1))).withColumn("copy", F.when(F.col("own") & (F.col("copy") == 0), 0).otherwise(1))
    empty = F.sha2(F.lit(""), 256)
    searched_rows = rows.where("copy = 0").drop("copy").join(done.drop("copy"), ["did", "full"])
    copy_rows = rows.where("copy = 1").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"), F.lit(b"" if keep_text else None).cast("binary").alias("kept"))
    short = base.where(F.octet_length("text") < window).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    out = searched_rows.select(*copy_rows.columns).union(copy_rows).union(short)
    return out if keep_text else out.drop("kept")
