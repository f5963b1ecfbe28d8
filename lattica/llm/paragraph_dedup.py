"""Substring deduplication by paragraph min-hash banding.

Two kinds of paragraphs: lines of at least `min_words` words, and blocks, which are cut by content (before a word
whose hash is the least within a few words), so that a passage set into other text holds the same blocks.

Lines get a min-hash signature over runs of `k` words in bands. Different lines that collide in a band are searched
for pairs whose run sets have an exact Jaccard index of `threshold` or more, whatever the size of the band; pairs are
clustered to connected components, and all of a component but its first line (by doc_id, then place) is cut out.

A block's one band is the hash of all its words. A block met twice is verified by windows around it: runs of words, of
at least `min_match`, that reach from the block up to AROUND words to one side (in steps of two) and as far to
the other as min_match asks for. Of equal windows all but the first are cut out.

Only keys that occur twice leave their task with more than 20 bytes: first the keys meet in parts dealt evenly by hash,
then the windows of the blocks and the run sets of the lines met. A task settles what it holds itself and sends one
record for each different window, so a passage that a third of all documents share costs one record a task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import STEP, U64, Words, connected_spans, deal, discard, first_of_each, mix, parts_for, powers, slices, text_buffer, to_parts, written
from lattica.llm.group_search import search_groups

TOP = U64((1 << 64) - 1)
KNOWN = np.uint32(0xFFFFFFFF)
#: Words to one side up to which a window reaches from its block, and half the width of the window that cuts blocks.
AROUND, HALF = 20, 5
NO_ID = (1 << 63) - 1
#: The end of a range over all words of a text, which counts for texts of min_match words at least.
WHOLE = 1 << 40


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands of `rows` values that propose a pair at the threshold with at least this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Paragraphs:
    """Lines and blocks of a run of texts. lines, blocks: (first word, end word) pairs; keys: their band hashes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, k: int, bands: int, rows: int, min_words: int):
        self.words = w = Words(raw, off)
        n = len(w.hash)
        # lines
        newline = np.concatenate([[0], np.cumsum(raw == 10)])
        line = newline[w.start]
        new = np.ones(n, bool)
        new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], n)[: len(begin)]
        fit = end - begin >= max(min_words, k)
        self.lines = np.stack([begin[fit], end[fit]], 1)
        number = np.cumsum(new) - 1
        h, at = w.grams(k)
        same = number[at] == number[at + k - 1] if len(at) else np.zeros(0, bool)
        self.run, at = h[same], at[same]
        self.run_cut = np.searchsorted(at, self.lines[:, 0]), np.searchsorted(at, self.lines[:, 1] - k + 1)
        # blocks
        pad = np.full(n + HALF * (len(off) + 1), TOP, np.uint64)
        place = np.arange(n) + HALF * (w.doc + 1)
        two = np.append(w.hash[1:], U64(0))[:n]
        last = np.append(w.doc[1:] != w.doc[:-1], True)[:n]
        pad[place] = mix(w.hash * STEP + np.where(last, U64(0), two)) >> U64(1)
        left = np.full(len(pad), TOP, np.uint64)
        right = left.copy()
        for s in range(1, HALF + 1):
            left[s:] = np.minimum(left[s:], pad[:-s])
            right[:-s] = np.minimum(right[:-s], pad[s:])
        cut = ((pad < left) & (pad <= right))[place] if n else np.zeros(0, bool)
        if n:
            cut[w.first[w.count > 0]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], n)[: len(begin)]
        fit = end - begin > HALF
        self.blocks = np.stack([begin[fit], end[fit]], 1)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(w.hash * up[:n], out=total[1:])
        whole = lambda x: mix((total[x[:, 1]] - total[x[:, 0]]) * down[x[:, 0]])
        self.block_key, self.line_key = whole(self.blocks), whole(self.lines)
        self.up_down, self.total = (up, down), total
        # other hashes of the words, so that equal words are told by more than 64 bits
        self.other = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(w.hash + U64(3)) * up[:n], out=self.other[1:])
        # bands of the lines
        keys = np.zeros((len(self.lines), bands), np.uint64)
        if len(self.lines):
            edge = np.stack(self.run_cut, 1).ravel()
            rng = np.random.default_rng(1)
            padded = np.append(self.run, TOP)
            for r in range(rows):
                for b in range(bands):
                    v = padded * U64(int(rng.integers(1 << 63)) * 2 + 1) ^ U64(rng.integers(1 << 63))
                    keys[:, b] = keys[:, b] * STEP + np.minimum.reduceat(v, edge)[::2]
        self.band_key = mix(keys + np.arange(1, bands + 1, dtype=np.uint64))
        self.line_doc = w.doc[self.lines[:, 0]] if n else np.zeros(0, np.int64)
        self.block_doc = w.doc[self.blocks[:, 0]] if n else np.zeros(0, np.int64)

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the words begin..end of each range."""
        down = self.up_down[1][begin]
        return tuple(mix((t[end] - t[begin]) * down) for t in (self.total, self.other))

    def windows(self, block: np.ndarray, min_match: int) -> tuple[np.ndarray, ...]:
        """Of the numbered blocks: (number in the argument, two hashes, first word, end word) of all windows around them."""
        a, b = self.blocks[block].T
        doc = self.block_doc[block]
        low, high = self.words.first[doc], self.words.first[doc] + self.words.count[doc]
        out = []
        for reach in range(0, AROUND + 1, 2):
            least = np.maximum(0, min_match - (b - a) - reach)
            for begin, end in ((a - reach, b + least), (a - least, b + reach)):
                i = np.flatnonzero((begin >= low) & (end <= high))
                one, two = self.ranges(begin[i], end[i])
                # the block's place in the window is part of its name
                place = ((a[i] - begin[i]) << 32 | (b[i] - a[i])).astype(np.uint64)
                out.append((i, mix(one + place * STEP), two, begin[i], end[i]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def local(self, doc: np.ndarray) -> np.ndarray:
        """Number of each paragraph within its document."""
        first = np.searchsorted(doc, doc)
        return np.arange(len(doc)) - first


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays of different values."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names=["part", "dk", "did", "data"])


#: A window's record: the low half of its first hash (the part holds of the high half), of its second, and its place.
WINDOW = np.dtype([("h", "<u4"), ("c", "<u4"), ("did", "<i8"), ("dk", "<i4"), ("begin", "<i4"), ("end", "<i4")])


def _spans(w: np.ndarray) -> list[pa.RecordBatch]:
    """Rows (-1, dk, did, ranges) of the windows' documents."""
    return [_rows([(-1, *x) for x in connected_spans(w["did"], w["dk"].astype(np.int64), w["begin"].astype(np.int64), w["end"].astype(np.int64))])] if len(w) else []


def find_repeats(docs: DataFrame, k: int = 5, threshold: float = 0.8, rows: int = 2, recall: float = 0.99, min_words: int = 16, min_match: int = 16) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): docs with their keys (_dk, _did) and `_text` (not null), and rows (dk, did, data, flat): word ranges to
    cut out of each, as packed int64 pairs or as flat pairs."""
    bands = bands_for(threshold, rows, recall)
    n_parts = parts_for(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # min_match words at least; shorter texts don't count as repeats as a whole, so they are searched
    inside = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    whole = docs.where(text.rlike(f"^(?:{inside.replace('[', '[^')}*+{inside}++){{{min_match}}}")).select(did.alias("did"), F.unhex(F.md5(text)).alias("full"), F.shiftright(F.xxhash64(did, F.md5(text)), 33).cast("int").alias("dk"))
    first = written(whole.groupBy("full").agg(F.min("did").alias("first")), "paragraph-first")  # read from files, so that the join of a text with many copies can be split
    copies = written(whole.join(first, "full").where("did <> first").select("dk", "did").distinct(), "paragraph-copies")
    texts = docs.withColumns({"_did": did, "_dk": F.shiftright(F.xxhash64(did, F.md5(text)), 33).cast("int"), "_text": text})

    # only one of equal texts of min_match words is searched; the others are repeats as a whole
    skipped = copies.groupBy(F.col("dk").alias("_dk")).agg(F.collect_set("did").alias("_copies"))
    searched = texts.select("_dk", "_did", "_text").join(skipped.hint("shuffle_hash"), "_dk", "left").where(F.col("_copies").isNull() | ~F.array_contains("_copies", F.col("_did"))).drop("_copies")

    def find(batches):
        held, n = [], 0

        def flush():
            for tagged in (0, 1):
                h, f, d, p = (np.concatenate(x) for x in zip(*(x[tagged] for x in held), strict=True))
                order = np.lexsort((f, h)) if tagged else np.argsort(h, kind="stable")
                h, f, d, p = h[order], f[order], d[order], p[order]
                again = several(h, f, tagged)
                if again.any():
                    yield answer(d[again], p[again])
                one, size = distinct(h, f)
                code = np.where((size > 1) & (tagged == 0), KNOWN, p[one])
                own = {"h": h[one].astype(np.uint32), "d": d[one].astype(np.uint32), "p": code.astype(np.uint32)} | ({"f": f[one]} if tagged else {})
                yield from (_rows([(q, 0, tagged, b"".join(x.values()))]) for q, x in deal(to_parts(h[one], n_parts), n_parts, own))

        for batch in batches:
            for piece in slices(batch, "_text"):
                p = Paragraphs(*text_buffer(piece.column("_text")), k, bands, rows, min_words)
                dk = piece.column("_dk").to_numpy()
                # kinds of references: blocks, whole lines (both by all their words), and lines by band, whose key tells a band's lines apart
                at = p.local(p.line_doc) * 3
                plain = np.concatenate([p.block_key, mix(p.line_key + U64(5))])
                ref = np.concatenate([p.local(p.block_doc) * 3, at + 1])
                banded = np.repeat(p.line_doc, bands)
                held.append((
                    (plain, np.zeros(len(plain), np.uint64), dk[np.concatenate([p.block_doc, p.line_doc])], ref.astype(np.uint32)),
                    (p.band_key.ravel(), np.repeat(p.line_key, bands), dk[banded], np.repeat(at + 2, bands).astype(np.uint32)),
                ))
                n += len(plain) + len(banded)
                if n > 400_000:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def distinct(h, f):
        """First of each (h, f) of sorted records, and how many each has."""
        one = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (f[1:] != f[:-1])) if len(h) else np.zeros(0, bool))
        return one, np.diff(np.append(one, len(h)))

    def several(h, f, tagged):
        """Which records share a key with another one: any other, or for tagged ones one of another tag."""
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool))
        size = np.diff(np.append(new, len(h)))
        return np.repeat(f[new + size - 1] != f[new] if tagged else size > 1, size)

    def answer(d, p):
        both = np.unique(d.astype(np.int64) << 32 | p.astype(np.int64))
        d, p = both >> 32, (both & 0xFFFFFFFF).astype(np.uint32)
        cut = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        return _rows([(-1, int(d[a]), 0, p[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(d)), strict=True)])

    def meet(batches):
        held: tuple[list, list] = ([], [])
        for batch in batches:
            own = batch.column("part").to_numpy() < 0
            if own.any():
                yield batch.filter(pa.array(own))
            for x, tagged, o in zip(batch.column("data"), batch.column("did").to_pylist(), own, strict=True):
                if not o:
                    data = x.as_buffer()
                    n = len(data) // (20 if tagged else 12)
                    f = np.frombuffer(data, np.uint64, n, 12 * n) if tagged else np.zeros(n, np.uint64)
                    held[tagged].append((*np.frombuffer(data, np.uint32, 3 * n).reshape(3, n), f))
        for tagged in (0, 1):
            if held[tagged]:
                h, d, p, f = (np.concatenate(x) for x in zip(*held[tagged], strict=True))
                order = np.lexsort((f, h)) if tagged else np.argsort(h, kind="stable")
                h, f, d, p = h[order], f[order], d[order], p[order]
                some = several(h, f, tagged) & (p != KNOWN)
                if some.any():
                    yield answer(d[some].astype(np.int32), p[some])

    packed = "part int, dk int, did long, data binary"
    dealt = F.when(F.col("part") < 0, F.pmod("dk", F.lit(n_parts))).otherwise(F.col("part")).cast("int")
    met = searched.select("_dk", "_text").mapInArrow(find, packed).repartitionById(n_parts, dealt).mapInArrow(meet, packed)
    lists = met.groupBy(F.col("dk").alias("_dk")).agg(F.collect_list("data").alias("lists"))

    def gather(batches):
        """Windows of the blocks met (dealt to parts), lines met (part -2: their places; part -3: their runs and bands)."""
        held, n = [], 0
        sent: set[bytes] = set()

        def flush():
            first, others = first_of_each(np.concatenate(held))
            yield from _spans(others)
            part = first["part"]
            plain = first[list(WINDOW.names)].astype(WINDOW)
            yield from (_rows([(q, 0, 0, x["w"])]) for q, x in deal(part, n_parts, {"w": plain}))

        for batch in batches:
            for piece in slices(batch, "_text"):
                p = Paragraphs(*text_buffer(piece.column("_text")), k, bands, rows, min_words)
                zero = p.words.first
                ids, keys = piece.column("_did").to_numpy(), piece.column("_dk").to_numpy()
                number = np.arange(piece.num_rows)
                firsts = [np.searchsorted(x, number) for x in (p.block_doc, p.line_doc)]
                ends = [np.searchsorted(x, number, side="right") for x in (p.block_doc, p.line_doc)]
                refs = [np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in data])).astype(np.int64) for data in piece.column("lists").to_pylist()]
                doc = np.repeat(number, [len(x) for x in refs])
                at, kind = np.divmod(np.concatenate(refs) if refs else np.zeros(0, np.int64), 3)
                for lines in (0, 1):
                    own = np.flatnonzero((kind > 0) == lines)
                    j = firsts[lines][doc[own]] + at[own]
                    fits = j < ends[lines][doc[own]]  # else an answer meant for another document of the same dk
                    own, j = own[fits], j[fits]
                    if not len(j):
                        continue
                    if not lines:
                        i, one, two, begin, end = p.windows(j, min_match)
                        d = doc[own][i]
                        w = np.zeros(len(i), [*WINDOW.descr, ("part", "<i4")])
                        for c, v in (("h", one.astype(np.uint32)), ("c", two.astype(np.uint32)), ("did", ids[d]), ("dk", keys[d]), ("begin", begin - zero[d]), ("end", end - zero[d]), ("part", to_parts(one, n_parts))):
                            w[c] = v
                        held.append(w)
                        n += len(w)
                        continue
                    one, two = p.ranges(p.lines[j, 0], p.lines[j, 1])
                    names = [x.tobytes() for x in np.stack([one, two], 1)]
                    place = np.stack([at[own], p.lines[j, 0] - zero[doc[own]], p.lines[j, 1] - zero[doc[own]]], 1).astype(np.int32)
                    yield _rows([(-2, int(keys[d]), int(ids[d]), x + y.tobytes()) for d, x, y in zip(doc[own], names, place, strict=True)])
                    near = [(-3, int(keys[d]), 0, x + p.band_key[y].tobytes() + np.unique(p.run[p.run_cut[0][y] : p.run_cut[1][y]]).tobytes()) for d, x, y, z in zip(doc[own], names, j, kind[own], strict=True) if z == 2 and x not in sent]
                    sent.update(x[3][:16] for x in near)
                    if len(sent) > 100_000:
                        sent.clear()
                    if near:
                        yield _rows(near)
                if n > 400_000:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def resolve(batches):
        held = []
        for batch in batches:
            own = batch.column("part").to_numpy() < 0
            if own.any():
                yield batch.filter(pa.array(own))
            held += [np.frombuffer(x.as_buffer(), WINDOW) for x, o in zip(batch.column("data"), own, strict=True) if not o]
        if held:
            yield from _spans(first_of_each(np.concatenate(held))[1])

    with_lists = searched.join(lists.hint("shuffle_hash"), "_dk")
    found = written(with_lists.mapInArrow(gather, packed).repartitionById(n_parts, dealt).mapInArrow(resolve, packed), "paragraph-found")
    lines = found.where("part = -3").select(F.substring("data", 1, 16).alias("full"), "data").dropDuplicates(["full"])
    lines = written(lines.mapInArrow(lambda batches: _line_runs(batches, bands), "full binary, n int, bands array<long>, seq binary"), "paragraph-lines")
    each = lines.where("n > 0").select("full", "n", F.explode("bands").alias("key"))
    sizes = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bands_met = written(each.join(sizes, "key"), "paragraph-met")
    _, roots = search_groups(bands_met, lines.select("full", "seq"), jaccard, threshold, "paragraph")
    holders = found.where("part = -2").select(F.substring("data", 1, 16).alias("full"), "did", "dk", F.substring("data", 17, 12).alias("place"))
    holders = holders.mapInArrow(_places, "full binary, did long, dk int, at int, w0 long, w1 long").distinct()
    holders = written(holders.join(roots.select(F.col("node").alias("full"), "root"), "full", "left").select(F.coalesce("root", "full").alias("root"), "did", "dk", "at", "w0", "w1"), "paragraph-holders")
    least = written(holders.groupBy("root").agg(F.min(F.struct("did", "dk", "at")).alias("least")), "paragraph-least")
    again = holders.join(least, "root").where(F.struct("did", "dk", "at") != F.col("least"))
    repeated = again.groupBy("dk", "did").agg(F.flatten(F.collect_list(F.array("w0", "w1"))).alias("flat"))
    discard(bands_met)
    ranges = found.where("part = -1").select("dk", "did", "data", F.lit(None).cast("array<long>").alias("flat"))
    ranges = ranges.unionByName(repeated.select("dk", "did", F.lit(None).cast("binary").alias("data"), "flat"))
    return texts, ranges.unionByName(copies.select("dk", "did", F.lit(None).cast("binary").alias("data"), F.array(F.lit(0).cast("long"), F.lit(WHOLE).cast("long")).alias("flat")))


def _line_runs(batches, bands: int):
    for batch in batches:
        data = [x.as_buffer() for x in batch.column("data")]
        key = [np.frombuffer(x, np.int64, bands, 16) for x in data]
        runs = [bytes(x[16 + 8 * bands :]) for x in data]
        yield pa.RecordBatch.from_arrays([batch.column("full"), pa.array([len(x) // 8 for x in runs], pa.int32()), pa.array(key, pa.list_(pa.int64())), pa.array(runs, pa.binary())], names=["full", "n", "bands", "seq"])


def _places(batches):
    for batch in batches:
        at = np.frombuffer(b"".join(x.as_py() for x in batch.column("place")), np.int32).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at[:, 0]), pa.array(at[:, 1].astype(np.int64)), pa.array(at[:, 2].astype(np.int64))], names=["full", "did", "dk", "at", "w0", "w1"])


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text) with the repeated paragraphs cut out of text, and n_words, n_removed_words, spans
    (array<struct<start, end>>: the bytes cut out of the text as it was, in order).

    Every row comes back, other columns ride along, but for those named n_words, n_removed_words or spans. A cut goes from
    the first word to the next word that stays, or to the text's end. Null texts stay null, empty ones empty; texts are
    searched whole, however long; an empty table gives none. The first of equal or similar paragraphs is the one with the
    least (doc_id, place), a null doc_id coming last; rows that repeat in doc_id and text are one document and stay
    alike. Of equal texts of min_match words or more all but the first are cut out as a whole. Lines of under
    min_words words and repeats of under min_match words stay. The result doesn't depend on partitions."""
    docs = docs.drop("n_words", "n_removed_words", "spans").withColumn("text", F.col("text").cast("string"))
    texts, ranges = find_repeats(docs, **options)
    names, min_match = docs.columns, options.get("min_match", 16)
    own = ranges.groupBy(F.col("dk").alias("_dk")).agg(F.collect_list(F.struct("did", "data", "flat")).alias("_ranges"))
    rows = texts.join(own.hint("shuffle_hash"), "_dk", "left").select(*names, "_did", "_ranges")
    spans_type = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    schema = T.StructType([*docs.schema.fields]).add("n_words", "long").add("n_removed_words", "long").add("spans", spans_type)

    def cut(batches):
        for batch in batches:
            for piece in slices(batch):
                raw, off = text_buffer(piece.column("text"))
                w = Words(raw, off)
                new, spans, gone = piece.column("text").to_pylist(), [], []
                for i, (did, ranges_) in enumerate(zip(piece.column("_did").to_pylist(), piece.column("_ranges").to_pylist(), strict=True)):
                    pairs = [np.frombuffer(x["data"], np.int64) if x["data"] is not None else np.array(x["flat"], np.int64) for x in ranges_ or () if x["did"] == did]
                    mine = sorted(set(map(tuple, np.concatenate(pairs).reshape(-1, 2).tolist()))) if pairs else []
                    zero, n, b0, b1 = int(w.first[i]), int(w.count[i]), int(off[i]), int(off[i + 1])
                    if n < min_match:
                        mine = [x for x in mine if x[1] < WHOLE]
                    joined: list[list[int]] = []
                    for a, b in mine:
                        if joined and a <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], b)
                        else:
                            joined.append([a, b])
                    own_spans, kept, at = [], [], b0
                    for a, b in joined:
                        b = min(b, n)
                        start = int(w.start[zero + a])
                        end = int(w.start[zero + b]) if b < n else b1
                        kept.append(raw[at:start].tobytes())
                        at = end
                        own_spans.append({"start": start - b0, "end": end - b0})
                    if joined:
                        kept.append(raw[at:b1].tobytes())
                        new[i] = b"".join(kept).decode("utf-8", "replace")
                    spans.append(own_spans)
                    gone.append(sum(min(b, n) - a for a, b in joined))
                cols = [pa.array(new, pa.string()) if c == "text" else piece.column(c) for c in names]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(w.count, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span)], names=[*names, "n_words", "n_removed_words", "spans"])

    return rows.mapInArrow(cut, schema)
