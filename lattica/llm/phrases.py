"""Phrase collocations: all phrases of 2 to 4 words that occur often enough in their language, scored and ranked.

A phrase is frequent only if all shorter phrases in it are. So the search goes by length: words; pairs of frequent words;
runs of 3 and 4 words whose pairs are all frequent. In each round the occurrences are dealt by hash into partitions, and a
partition is summed up by a mergeable Misra-Gries summary whose capacity exceeds the partition's mass over the threshold:
its counters are too low by less than the threshold, so every frequent phrase survives. What survives is marked in a bitmap
of bounded size (hashes that share a bit only let more through). Then one more pass counts what passes the bitmaps exactly,
by its words and not by hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import BASE_INV, STEP, U64, deal, discard, mix, parts_for, powers, slices, text_buffer, to_parts, written

# A byte's kind: 0 between words, 1 in a word, 2 between pieces.
KIND = np.ones(256, np.uint8)
KIND[[0x20, 0x09]] = 0
KIND[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

LONGEST = 4
#: Bytes of text cut into words at once; different phrases that a task holds before it deals them out.
SLICE, HELD = 1 << 20, 1 << 19
#: Bits of a round's bitmap: 16 for each survivor, up to this many (32 MB).
MOST_BITS = 28


class Pieces:
    """Words of a run of texts: byte range [start, end), hash, text number, and whether the next word follows in the same piece."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw = LOWER[raw]
        n = len(raw)
        kind = KIND[raw]
        inside = kind == 1
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        breaks = np.cumsum(kind == 2, dtype=np.int32)
        at = breaks[self.start] if n else np.zeros(0, np.int32)
        self.joined = (at[1:] == at[:-1]) & (self.doc[1:] == self.doc[:-1])
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(np.where(inside, self.raw.astype(np.uint64) + U64(1), U64(0)) * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def runs(self, k: int) -> np.ndarray:
        """The first words of all runs of k words within a piece."""
        ok = np.ones(max(0, len(self.start) - k + 1), bool)
        for j in range(k - 1):
            ok &= self.joined[j : j + len(ok)]
        return np.flatnonzero(ok)

    def hashes(self, at: np.ndarray, k: int, seed: np.ndarray) -> np.ndarray:
        """Hashes of the runs of k words from the words `at`; seed: of each text (its language)."""
        h = seed[self.doc[at]] + U64(k * int(BASE_INV) & (1 << 64) - 1)
        for j in range(k):
            h = h * STEP + self.hash[at + j]
        return mix(h)

    def words(self) -> tuple[np.ndarray, int]:
        """Numbers of the words, equal for equal words only, and how many there are."""
        _, rep, of = np.unique(self.hash, return_index=True, return_inverse=True)
        size = self.end - self.start
        mine, theirs = np.arange(len(size)), rep[of]
        ok = size == size[theirs]
        # the bytes are compared as well
        live = np.flatnonzero(ok & (mine != theirs))
        for low in range(0, len(live), 1 << 18):
            part = live[low : low + (1 << 18)]
            n = size[part]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = self.raw[np.repeat(self.start[part], n) + step] == self.raw[np.repeat(self.start[theirs[part]], n) + step]
            ok[part] = np.add.reduceat(equal, np.cumsum(n) - n) == n if len(n) else True
        ids, count = of.astype(np.int64), len(rep)
        odd: dict = {}
        for i in np.flatnonzero(~ok).tolist():  # two words of one hash
            ids[i] = odd.setdefault(self.raw[self.start[i] : self.end[i]].tobytes(), count + len(odd))
        return ids, count + len(odd)

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The runs of k words from the words `at`, joined by a space each."""
        size = np.stack([self.end[at + j] - self.start[at + j] for j in range(k)])
        off = np.concatenate([[0], np.cumsum(size.sum(0) + (k - 1))])
        out = np.full(off[-1], 0x20, np.uint8)
        to = off[:-1].copy()
        for j in range(k):
            n = size[j]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to, n) + step] = self.raw[np.repeat(self.start[at + j], n) + step]
            to += n + 1
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


class Sieve:
    """A bitmap over the high bits of hashes."""

    def __init__(self, bits: int):
        self.bits, self.map = bits, np.zeros(1 << (bits - 3), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> U64(64 - self.bits)
        return (self.map[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


def summed_up(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes and the sums of their counts."""
    if not len(h):
        return h, c
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], np.add.reduceat(c, first)


class Summary:
    """A Misra-Gries summary: at most `capacity` counters. A count is too low by `lowered` at most, and that is under the
    mass over the capacity, however many summaries were merged into one."""

    def __init__(self, capacity: int):
        self.capacity, self.lowered = capacity, 0
        self.h, self.c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, h: np.ndarray, c: np.ndarray) -> None:
        self.h, self.c = summed_up(np.concatenate([self.h, h]), np.concatenate([self.c, c]))
        if len(self.c) > self.capacity:
            cut = int(np.partition(self.c, len(self.c) - self.capacity - 1)[len(self.c) - self.capacity - 1])
            self.c = self.c - cut
            live = self.c > 0
            self.h, self.c, self.lowered = self.h[live], self.c[live], self.lowered + cut

    def survivors(self, least: int) -> np.ndarray:
        return self.h[self.c + self.lowered >= least]


def packed(part: np.ndarray, h: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, int, dict]:
    """Seven bytes for each of a task's counts: the upper 48 bits of a hash, and up to 255 of its count; a greater count comes
    in several."""
    times = -(-c // 255)
    last = np.cumsum(times) - 1
    of = np.repeat(np.arange(len(h)), times)
    count = np.full(len(of), 255, np.uint8)
    count[last] = c - 255 * (times - 1)
    return part[of], n, {"h": np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[of, 2:], "c": count}


def unpacked(data) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, 2:] = rows
    return out.view(np.uint64).ravel()


def passing(p: Pieces, k: int, seed: np.ndarray, sieves: dict) -> np.ndarray:
    """First words of the runs of k words whose parts all pass: single words, or pairs from 3 words on."""
    at = p.runs(k)
    part = 1 if k == 2 else 2
    if k > 1 and part in sieves:
        ok = np.zeros(len(p.start), bool)
        whole = p.runs(part)
        ok[whole] = sieves[part].has(p.hashes(whole, part, seed))
        for j in range(k - part + 1):
            at = at[ok[at + j]]
    return at


def search_round(docs: DataFrame, sizes: tuple[int, ...], sieves: dict, least: int) -> dict:
    """Sieves of the runs of `sizes` words (one for all, under each size) that occur `least` times or more, and of others."""
    spark = docs.sparkSession
    n = parts_for(docs, mb=4)
    known = spark.sparkContext.broadcast(sieves)

    def local(batches):
        held: list = []
        total = 0

        def flush():
            h, c = summed_up(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            return h, c  # a task's counts between two flushes stay under 2**32

        def rows(h, c):
            part = to_parts(h, n)
            mass = np.bincount(part, c, n)
            got = list(deal(*packed(part, h, c, n)))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([x["h"] for _, x in got], pa.binary()), pa.array([x["c"] for _, x in got], pa.binary()), pa.array([int(mass[p]) for p, _ in got], pa.int64())], names=["part", "h", "c", "mass"])

        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                p = Pieces(*text_buffer(part.column("text")))
                seed = part.column("seed").to_numpy().view(np.uint64)
                for k in sizes:
                    at = passing(p, k, seed, known.value)
                    h, c = np.unique(p.hashes(at, k, seed), return_counts=True)
                    held.append((h, c))
                    total += len(h)
                if total > HELD:
                    h, c = flush()
                    held, total = [(h, c)], len(h)
                    if total > HELD // 2:
                        yield rows(h, c)
                        held, total = [], 0
        if held:
            yield rows(*flush())

    dealt = written(docs.select("text", "seed").mapInArrow(local, "part int, h binary, c binary, mass long"), "phrase-counts")
    mass = spark.sparkContext.broadcast({r.part: r.m for r in dealt.groupBy("part").agg(F.sum("mass").alias("m")).collect()})  # a number for each of n parts

    def merged(batches):
        held: dict = {}
        waiting: dict = {}

        def settle(part):
            xs = waiting.pop(part, [])
            if xs:
                held[part].merge(np.concatenate([x[0] for x in xs]), np.concatenate([x[1] for x in xs]))

        sizes_: dict = {}
        for batch in batches:
            for part, h, c in zip(batch.column("part").to_pylist(), batch.column("h"), batch.column("c"), strict=True):
                if part not in held:
                    held[part] = Summary(mass.value[part] // least + 1)
                h = unpacked(h.as_buffer())
                waiting.setdefault(part, []).append((h, np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64)))
                sizes_[part] = sizes_.get(part, 0) + len(h)
                if sizes_[part] > max(1 << 17, held[part].capacity):
                    settle(part)
                    sizes_[part] = 0
        for part in list(held):
            settle(part)
            h = held.pop(part).survivors(least)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([len(h)], pa.int64())], names=["part", "h", "n"])

    left = written(dealt.select("part", "h", "c").repartitionById(n, F.col("part")).mapInArrow(merged, "part int, h binary, n long"), "phrase-survivors")
    discard(dealt)
    count = left.agg(F.sum("n")).first()[0] or 0
    sieve = Sieve(min(MOST_BITS, max(10, (16 * count).bit_length())))
    bits = sieve.bits

    def marked(batches):
        for batch in batches:
            for h in batch.column("h"):
                at = np.unique(np.frombuffer(h.as_buffer(), np.uint64) >> U64(64 - bits)).astype(np.int64)
                if len(at):
                    low = int(at[0] >> 3)
                    own = np.zeros((int(at[-1] >> 3) - low + 1) * 8, np.uint8)
                    own[at - (low << 3)] = 1
                    yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["low", "bits"])

    # a part's hashes lie side by side in the bitmap, so all rows together are its size
    for r in left.select("h").mapInArrow(marked, "low long, bits binary").toLocalIterator():
        own = np.frombuffer(bytes(r.bits), np.uint8)
        sieve.map[r.low : r.low + len(own)] |= own
    discard(left)
    return dict.fromkeys(sizes, sieve)


def frequent_phrases(docs: DataFrame, least: int = 30) -> DataFrame:
    """docs (text, lang) -> (lang, n words, phrase, f), exact: all phrases of up to 4 words that occur `least` times or more
    in their language, and for each language a row of 0 words whose f is the number of its words. A null lang is `und`,
    a null text is empty; repeated rows count as often as they come, very long texts are counted whole, other columns are
    not read; an empty table gives no rows. The table is written."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("seed")).where("length(text) > 0")
    sieves: dict = {}
    for sizes in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        sieves |= search_round(docs, sizes, sieves, least)
    known = spark.sparkContext.broadcast(sieves)

    def count(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=SLICE):
                p = Pieces(*text_buffer(part.column("text")))
                seed = part.column("seed").to_numpy().view(np.uint64)
                names = part.column("lang").dictionary_encode()
                lang_of = names.indices.to_numpy().astype(np.int64)[p.doc]
                ids, n_ids = p.words()
                n = np.bincount(lang_of, minlength=len(names.dictionary))
                yield pa.RecordBatch.from_arrays([names.dictionary, pa.array(np.zeros(len(n), np.int32)), pa.array([""] * len(n)), pa.array(n.astype(np.int64))], names=["lang", "n", "phrase", "f"])
                for k in range(1, LONGEST + 1):
                    at = passing(p, k, seed, known.value)
                    at = at[known.value[k].has(p.hashes(at, k, seed))]
                    key = lang_of[at] * n_ids + ids[at]
                    for j in range(1, k):
                        key = np.unique(key, return_inverse=True)[1].astype(np.int64) * n_ids + ids[at + j]
                    _, rep, c = np.unique(key, return_index=True, return_counts=True)
                    rep = at[rep]
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(lang_of[rep])), pa.array(np.full(len(rep), k, np.int32)), p.phrases(rep, k), pa.array(c.astype(np.int64))], names=["lang", "n", "phrase", "f"])

    counts = docs.mapInArrow(count, "lang string, n int, phrase string, f long").groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return written(counts.where((F.col("f") >= least) | (F.col("n") == 0)), "phrases")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to 4 words that occur a >= least times.

    A phrase is cut after its first k words; l and r are the counts of both parts; the score is 2,000,000 a over l + r,
    rounded down, of the cut where it is least (ties: the smallest k). Phrases that mostly occur within one longer phrase
    (100 f(longer) >= 80 a) are left out. Ties in score go by a, then by the phrase's bytes. n: the language's words. Nulls,
    long texts, repeated rows and empty tables: see frequent_phrases."""
    f = frequent_phrases(docs, least)
    known = f.where("n > 0").select("lang", "phrase", "f")
    words = f.where("n > 1").withColumn("w", F.split("phrase", " "))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = words.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    both = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST((CAST(a AS DECIMAL(27,0)) * CAST(2000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(27,0)) + CAST(r AS DECIMAL(27,0))) AS BIGINT)")
    scored = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.first("a").alias("a"))
    inner = words.where("n > 2").select("lang", F.col("f").alias("longer"), F.explode(F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR CAST(longer AS DECIMAL(27,0)) * 100 < CAST(a AS DECIMAL(27,0)) * 80")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = f.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
