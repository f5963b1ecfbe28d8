"""Language identification by language-bitmask n-gram filters.

Every learned language has a Bloom filter of its n-grams; the filters are bit-sliced: slot s holds one
bit for each language, so one n-gram's few slots, ANDed, give all languages that contain it. A text's
n-grams are looked up, each language's bits are counted, the counts are corrected for the filters'
false positives, and the highest corrected share decides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import U64, WORD_CLASS, mix, slices, text_buffer

#: Fixed parameters. A language's n-gram enters its filter with at least MIN_SHARE of the language's n-grams
#: (so a filter has 1 / MIN_SHARE entries at most) and at least RATIO of its highest share in any language.
GRAM, MIN_SHARE, RATIO, HASHES, SLOTS_PER_ENTRY = 4, 1e-5, 0.2, 3, 12


def gram_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the GRAM-byte grams of each text and their text numbers; bytes outside words count as one space,
    runs of them are skipped, and digits aren't letters."""
    cls = WORD_CLASS[raw]
    low = np.where((cls == 0) | ((cls > 0x30) & (cls <= 0x3A)), 0x20, cls - U64(1)).astype(np.uint32)
    keep = low != 0x20
    keep[1:] |= low[:-1] != 0x20
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[keep]
    low = low[keep]
    n = len(low) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = low[:n].copy()
    for j in range(1, GRAM):
        code = (code << np.uint32(8)) | low[j : j + n]
    same = doc[:n] == doc[GRAM - 1 :]
    return code[same], doc[:n][same]


class Filters:
    """Bit-sliced Bloom filters over `languages` (in natural order), 64 to a word."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        most = max([len(g) for g in grams.values()], default=1)
        self.slots = 1 << max(10, math.ceil(math.log2(max(1, most) * SLOTS_PER_ENTRY)))
        self.mask = np.zeros((math.ceil(max(1, len(languages)) / 64), self.slots), np.uint64)
        for i, lang in enumerate(languages):
            for at in self.where(grams[lang].astype(np.uint64)):
                np.bitwise_or.at(self.mask[i // 64], at, U64(1 << (i % 64)))
        fill = np.array([((self.mask[i // 64] >> U64(i % 64)) & U64(1)).mean() for i in range(len(languages))])
        self.false = fill**HASHES

    def where(self, code: np.ndarray):
        h = mix(code.astype(np.uint64) + U64(1))
        for j in range(HASHES):
            yield ((h >> U64(20 * j)) & U64((1 << 20) - 1)).astype(np.int64) % self.slots if self.slots <= 1 << 20 else (mix(h + U64(j)) % U64(self.slots)).astype(np.int64)

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language and the corrected shares (texts x languages)."""
        code, doc = gram_codes(raw, off)
        n = len(off) - 1
        first = np.searchsorted(doc, np.arange(n))
        size = np.diff(np.append(first, len(doc)))
        share = np.zeros((n, len(self.languages)))
        some = np.flatnonzero(size)
        if len(some):
            for w in range(len(self.mask)):
                got = None
                for at in self.where(code):
                    got = self.mask[w][at] if got is None else got & self.mask[w][at]
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    bits = ((got >> U64(i % 64)) & U64(1)).astype(np.int32)
                    share[some, i] = np.add.reduceat(bits, first[some]) / size[some]
        share = np.clip((share - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
        return (share.argmax(1) if len(self.languages) else np.zeros(n, int)), share


def learn(docs: DataFrame) -> Filters:
    """Filters from rows (text, lang); rows with a null lang or text teach nothing. The n-gram counts cover
    all rows: each task sums its own, Spark sums those, and only the grams above MIN_SHARE of a language
    reach the driver."""

    def count(batches):
        held: dict = {}
        for batch in batches:
            for part in slices(batch):
                raw, off = text_buffer(part.column("text"))
                code, doc = gram_codes(raw, off)
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs], np.uint64)
                key, n = np.unique((number[doc] << U64(32)) | code.astype(np.uint64), return_counts=True)
                for k, c in zip(key.tolist(), n.tolist(), strict=True):
                    at = (names[k >> 32], k & 0xFFFFFFFF)
                    held[at] = held.get(at, 0) + c
                if len(held) > 300_000:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["lang", "gram", "n"])

    some = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    counts = some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from lattica.llm.common import written

    counts = written(counts, "langid")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang").withColumn("share", F.col("n") / F.col("total"))
    best = share.groupBy("gram").agg(F.max("share").alias("best"))
    kept = share.where(F.col("share") >= MIN_SHARE).join(best, "gram").where(F.col("share") >= RATIO * F.col("best"))
    table = kept.select("lang", "gram").toArrow()
    languages = sorted({r["lang"] for r in total.select("lang").collect()} - {"und"})
    lang, gram = table.column("lang").to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, object), table.column("gram").to_numpy() if table.num_rows else np.zeros(0, np.int64)
    return Filters(languages, {x: gram[lang == x] for x in languages})


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs (text; further columns ride along, but for those named lang_pred or score) with lang_pred and score.

    score: the best language's corrected share of the text's n-grams, 0 to 1. `und` with score 0 for a text that
    is null or has no letter, or where nothing was learned; ties go to the first language in natural order. Very long texts
    are read whole, repeated rows are alike, an empty table gives none. Only the text is read. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    base = docs.drop("lang_pred", "score")
    own = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        f = held.value
        names = np.array([*f.languages, "und"], object)
        for batch in batches:
            for part in slices(batch):
                raw, off = text_buffer(part.column("text"))
                best, share = f.predict(raw, off)
                score = share.max(1) if share.shape[1] else np.zeros(len(best))
                ascii_letter = np.zeros(256, bool)
                ascii_letter[[*range(65, 91), *range(97, 123)]] = True
                sums = np.concatenate([[0], np.cumsum(ascii_letter[raw])])
                has = sums[off[1:]] > sums[off[:-1]]
                for i in np.flatnonzero(~has):
                    has[i] = any(c.isalpha() for c in raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
                best = np.where(has & (share.shape[1] > 0), best, len(f.languages))
                score = np.where(has, score, 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return base.mapInArrow(predict, schema)


def held_out(doc_id):
    """crc32 of doc_id as text leaves 2 modulo 4 (never for a null doc_id)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
