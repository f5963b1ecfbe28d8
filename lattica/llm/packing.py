"""Packing by optimal length buckets: dynamic programming over the global length histogram chooses the
bucket boundaries with the least padding; inside a bucket, batches are formed to a token budget."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import slices, written


def best_bounds(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` ascending upper bounds (the last is the greatest length) with the least total padding,
    a sequence being padded to the least bound that holds it. length: ascending and distinct."""
    n = len(length)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(count)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(count * length)]).astype(np.float64)
    # cost[i, j]: padding of the lengths i..j-1 in one bucket bounded by length[j-1]
    cost = length[None, :] * (rows[None, 1:] - rows[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    cost[np.tril_indices(n, -1)] = np.inf
    best = cost[0].copy()
    back = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        total = best[:-1, None] + cost[1:, :]  # the last bucket starts at 1..n-1
        at = total.argmin(0)
        now = total[at, np.arange(n)]
        worse = now >= best
        back.append(np.where(worse, -1, at + 1))
        best = np.where(worse, best, now)
    out, j, k = [], n - 1, len(back) - 1
    while True:
        out.append(int(length[j]))
        while k > 0 and back[k][j] < 0:
            k -= 1
        if k == 0:
            return out[::-1]
        j, k = int(back[k][j]) - 1, k - 1


#: Runs of at least 1,000 characters with the Unicode property White_Space.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


class Encoder:
    """Token ids by a public byte-pair vocabulary: a file of base64 tokens and their ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The library's ids of the whole text. Its pattern engine runs out of stack in very long runs of white space, so those are
        cut off where the pattern itself cuts: before a run, and before its last character if more text follows."""
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self.encoding.encode_ordinary(text[at : run.start()])
            out += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        out += self.encoding.encode_ordinary(text[at:])
        return np.array(out, np.int32)


_encoders: dict[tuple[str, str], Encoder] = {}


def pieces(docs: DataFrame, max_tokens: int, vocabulary: str | None, pattern: str | None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, ids, h): the pieces of each row of docs. h: a hash of doc_id, text and piece."""
    id_type = docs.schema["doc_id"].dataType
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
    if vocabulary is None:
        n = F.regexp_count("text", F.lit(r"\S+")).cast("long")
        each = rows.select("doc_id", "h", n.alias("n")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / max_tokens) - 1))))
        start = F.col("piece") * max_tokens
        size = F.least(F.lit(max_tokens), F.col("n") - start).cast("long")
        return each.select("doc_id", "piece", start.alias("start"), size.alias("n_tokens"), F.lit(None).cast("array<int>").alias("ids"), F.xxhash64("h", "piece").alias("h"))

    def encode(batches):
        encoder = _encoders.get((vocabulary, pattern))
        if encoder is None:
            encoder = _encoders[vocabulary, pattern] = Encoder(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [encoder.encode(t) for t in part.column("text").to_pylist()]
                of = np.array([max(1, -(-len(x) // max_tokens)) for x in ids])
                row = pa.array(np.repeat(np.arange(len(ids)), of))
                piece = np.concatenate([np.arange(k) for k in of])
                cut = [x[i : i + max_tokens] for x, k in zip(ids, of, strict=True) for i in range(0, k * max_tokens, max_tokens)]
                size = np.array([len(x) for x in cut])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(cut)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("h").take(row), pa.array(piece), pa.array(piece * max_tokens), pa.array(size), lists], names=["doc_id", "h", "piece", "start", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("doc_id", id_type)]).add("h", "long").add("piece", "long").add("start", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    return rows.select("doc_id", "text", "h").mapInArrow(encode, schema).withColumn("h", F.xxhash64("h", "piece"))


def pack(docs: DataFrame, max_tokens: int = 2048, buckets: int = 16, batch_tokens: int = 32_768, batches_per_shard: int = 64, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> one row for each piece of a document: doc_id, piece, start (first token), n_tokens, ids
    (array<int>, its tokens), bucket, bucket_len, shard, batch, slot.

    Tokens are those of a public byte-pair vocabulary (a file of ranks, read by each worker, and the pattern that splits
    text for it); without one they are runs of non-space characters, and ids is null.

    A document of over max_tokens is cut into pieces of max_tokens and a rest, so the histogram has max_tokens entries
    at most and can be planned on the driver; it counts all pieces. A batch is (bucket, shard, batch): up to
    batch_tokens / bucket_len pieces (one at least), all padded to bucket_len. Buckets are dealt into shards of about
    batches_per_shard batches by a hash of doc_id, text and piece, which also orders them: no task gets a whole bucket, also
    where ids are null or repeat, and each shard has one batch at most that isn't full. Ties are pieces of repeated rows,
    which are alike. Null and empty texts have one piece of 0 tokens, in no bucket (bucket, shard, batch, slot null).
    Repeated rows are packed each; texts are packed whole, however long; other columns, whatever their names, are left
    out; an empty table gives none."""
    each = written(pieces(docs, max_tokens, vocabulary, pattern), "pack")
    hist = sorted((r["n_tokens"], r["count"]) for r in each.where("n_tokens > 0").groupBy("n_tokens").count().collect())
    length, count = np.array([h[0] for h in hist], np.int64), np.array([h[1] for h in hist], np.int64)
    bounds = best_bounds(length, count, buckets)
    spec = []
    low = 0
    for b in bounds:
        rows = int(count[(length > low) & (length <= b)].sum())
        room = max(1, batch_tokens // b)
        spec.append((b, room, max(1, -(-rows // (room * batches_per_shard)))))
        low = b
    if not spec:
        none = F.lit(None)
        return each.select("doc_id", "piece", "start", "n_tokens", "ids", none.cast("int").alias("bucket"), *(none.cast("long").alias(c) for c in ("bucket_len", "shard", "batch", "slot")))
    of = [F.array(*(F.lit(x[i]).cast("long") for x in spec)) for i in range(3)]
    bucket = F.when(F.col("n_tokens") > 0, F.size(F.filter(of[0], lambda b: b < F.col("n_tokens"))))
    out = each.withColumn("bucket", bucket.cast("int"))
    bucket_len, room, shards = (F.get(a, F.col("bucket")) for a in of)
    # pieces of no tokens need no order; they are dealt by the hash alone
    shard = F.pmod(F.xxhash64("h"), F.coalesce(shards, F.lit(1 << 20).cast("long")))
    out = out.select("*", bucket_len.alias("bucket_len"), shard.alias("shard"), room.alias("room"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "doc_id")) - 1
    out = out.withColumn("rank", rank.cast("long"))
    return out.select(
        "doc_id", "piece", "start", "n_tokens", "ids", "bucket", "bucket_len", F.when(F.col("bucket").isNotNull(), F.col("shard")).alias("shard"),
        F.floor(F.col("rank") / F.col("room")).alias("batch"), F.when(F.col("bucket").isNotNull(), F.col("rank") % F.col("room")).alias("slot"),
    )
