"""Vectors linked by their cosine, found by spherical-cap filters.

A filter is a direction; a vector passes it if its product with the direction reaches a bound. The directions are random
product codes: the space is turned at random and cut into blocks, each block has some random unit vectors, and a direction is
one of them from every block. All directions that a vector passes are listed (list decoding) block by block: a choice of
some blocks goes on only while the best of the others could still reach the bound. Vectors that pass one filter meet and
their cosine is computed. Bound and number of filters follow from the number of vectors: a filter holds some dozen vectors
of even spread, and few pairs at the threshold are missed (the tests measure it).

Equal vectors are one class with a count, so copies cost nothing. A filter with many vectors (a family of near copies) is cut
into blocks, and pairs of blocks meet in different tasks; a pair is counted in the first filter that both pass. Tasks give
each vector's number of links and a spanning forest, never all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import connected_components, discard, written

#: Vectors of a block of a crowded filter, vectors that a filter should hold, code words of a block of dimensions at most, codes.
BLOCK, OCCUPANCY, CODE, TURNS = 1024, 48, 1024, 16


def tails(d: int, n: int = 20_001) -> tuple[np.ndarray, np.ndarray]:
    """Grid x in [-1, 1] and the probability that one coordinate of a random unit vector of d dimensions is at least x."""
    x = np.linspace(-1, 1, n)
    density = np.maximum(1 - x * x, 1e-300) ** ((d - 3) / 2)
    mass = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return x, 1 - mass / mass[-1]


class Code:
    """Filters for vectors of `dim` dimensions (few are filled up with zeros): TURNS product codes of `blocks` blocks with
    `size` code words each. A direction's number is its words' numbers in base `size`, after the number of its code."""

    def __init__(self, dim: int, n: int, cosine: float, miss: float, seed: int = 1):
        self.dim = max(dim, 8)
        x, tail = tails(self.dim)
        _, low = tails(self.dim - 1)
        one = min(0.05, OCCUPANCY / max(n, 1))
        self.bound = float(x[np.searchsorted(-tail, -one)])
        # both vectors of a pair at the threshold pass a filter: the first has x, the second passes given that
        inside = x >= self.bound
        sine = math.sqrt(1 - cosine**2)
        need = (self.bound - x[inside] * cosine) / np.maximum(np.sqrt(1 - x[inside] ** 2) * sine, 1e-12)
        mass = -np.diff(tail, append=0)[inside]
        both = float((mass * np.interp(need, x, low)).sum())
        # a vector whose length is spread unevenly over the blocks passes fewer filters: half as many again
        filters = 1.5 * math.log(1 / miss) / both / TURNS
        self.blocks = max(2, min(self.dim // 4, math.ceil(math.log(max(filters, 2)) / math.log(CODE))))
        self.size = math.ceil(filters ** (1 / self.blocks))
        rng = np.random.default_rng([seed, dim])
        self.cuts = np.linspace(0, self.dim, self.blocks + 1).astype(int)
        self.turns, self.words = [], []
        for _ in range(TURNS):
            self.turns.append(np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0])
            words = [rng.standard_normal((b - a, self.size)) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
            self.words.append([w / np.linalg.norm(w, axis=0) / math.sqrt(self.blocks) for w in words])

    def decode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, direction numbers) of all filters that unit rows u pass."""
        z = np.zeros((len(u), self.dim))
        z[:, : u.shape[1]] = u
        found = [self.listed(z @ turn, words) for turn, words in zip(self.turns, self.words, strict=True)]
        return np.concatenate([row for row, _ in found]), np.concatenate([i * self.size**self.blocks + code for i, (_, code) in enumerate(found)])

    def listed(self, z: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        value, order = [], []
        for w, a, b in zip(words, self.cuts[:-1], self.cuts[1:], strict=True):
            s = z[:, a:b] @ w
            by = np.argsort(-s, axis=1)
            order.append(by)
            value.append(np.take_along_axis(s, by, 1))
        rest = np.zeros((self.blocks + 1, len(z)))
        for b in range(self.blocks - 1, -1, -1):
            rest[b] = rest[b + 1] + value[b][:, 0]
        row, total, code = np.arange(len(z)), np.zeros(len(z)), np.zeros(len(z), np.int64)
        for b in range(self.blocks):
            # each row's values fall; those that can still reach the bound come first
            least = self.bound - total - rest[b + 1][row]
            flat = (-value[b] + 4.0 * np.arange(len(z))[:, None]).ravel()
            n = np.searchsorted(flat, np.clip(-least, -1.9, 1.9) + 4.0 * row, side="right") - row * self.size
            n = np.clip(n, 0, self.size)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, total, code = np.repeat(row, n), np.repeat(total, n), np.repeat(code, n)
            total = total + value[b][row, step]
            code = code * self.size + order[b][row, step]
        return row, code


def unit_rows(vec: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1 in doubles."""
    x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def lengths(vec: pa.Array) -> np.ndarray:
    return np.diff(vec.offsets.to_numpy())


def meet(u: np.ndarray, side: np.ndarray, filters: list[np.ndarray], own: int, cosine: float) -> np.ndarray | None:
    """Which members of a filter are linked, as a symmetric matrix, without pairs that pass a filter of a smaller number
    together; where there are two sides, only pairs across. None: no links."""
    ok = u @ u.T >= cosine
    np.fill_diagonal(ok, False)
    if side.any() and not side.all():
        ok &= side[:, None] != side[None]
    if not ok.any():
        return None
    live = np.flatnonzero(ok.any(1))
    earlier = [filters[i][: np.searchsorted(filters[i], own)] for i in live]
    code, n = np.unique(np.concatenate(earlier), return_counts=True)
    code = code[n > 1]
    if len(code):
        member = np.repeat(np.arange(len(live)), [len(x) for x in earlier])
        flat = np.concatenate(earlier)
        at = np.minimum(np.searchsorted(code, flat), len(code) - 1)
        hit = code[at] == flat
        for low in range(0, len(code), 4096):
            m = np.zeros((len(live), min(4096, len(code) - low)), np.float32)
            some = hit & (at >= low) & (at < low + 4096)
            m[member[some], at[some] - low] = 1
            ok[np.ix_(live, live)] &= m @ m.T < 0.5
    return ok if ok.any() else None


def forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix."""
    new, out = ok.any(1), []
    while new.any():
        front = [int(np.flatnonzero(new)[0])]
        new[front[0]] = False
        while front:
            i = front.pop()
            more = np.flatnonzero(ok[i] & new)
            new[more] = False
            out += [(i, int(j)) for j in more]
            front += more.tolist()
    return out


def similar_vectors(vectors: DataFrame, cosine: float = 0.9, miss: float = 1e-4) -> DataFrame:
    """vectors (vec_id, embedding array<float or double>) -> (vec_id, n_links, component_id, kept), a row for each row.

    n_links: other rows whose cosine, in doubles, is at least `cosine`; a pair at the threshold is missed with a probability
    of some tenths of a percent, a nearer one hardly ever, and none below is linked. component_id: the least vec_id reachable by links, itself
    included. kept: vec_id is that. Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing, and neither do vectors of different lengths. Rows that share a vec_id are vectors of their own; equal rows link
    with each other. A null vec_id counts as a row, but a component takes it as its id only if there is no other, and it is
    never kept. Other columns are left out; an empty table stays empty."""
    rows = vectors.select("vec_id", F.col("embedding").alias("vec"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("vec").isNotNull() & ~F.exists("vec", odd) & F.exists("vec", lambda x: x != 0)
    kind = rows.schema["vec"].dataType.simpleString()
    classes = written(rows.where(sound).groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    dims = {r.d: r.n for r in classes.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    codes = {d: Code(d, n, cosine, miss) for d, n in dims.items()}
    held = vectors.sparkSession.sparkContext.broadcast(codes)

    def decode(batches):
        for batch in batches:
            vec = batch.column("vec")
            size = lengths(vec)
            for d in np.unique(size).tolist():
                some = np.flatnonzero(size == d)
                for low in range(0, len(some), 512):
                    part = batch.take(pa.array(some[low : low + 512]))
                    row, code = held.value[d].decode(unit_rows(part.column("vec")))
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order]
                    cut = np.searchsorted(row, np.arange(part.num_rows + 1)) * 8
                    lists = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(code.astype(np.int64))])
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(code, pa.int64()), part.column("cls").take(at), part.column("copies").take(at), part.column("vec").take(at), lists.take(at)], names=["d", "f", "cls", "copies", "vec", "filters"])

    passed = written(classes.select("cls", "copies", "vec").mapInArrow(decode, f"d int, f long, cls long, copies long, vec {kind}, filters binary"), "cap-filters")
    crowded = passed.groupBy("d", "f").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("d", "f", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    crowded = written(crowded, "crowded-filters")
    alone = passed.select("*", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(False).alias("side"))
    if crowded.take(1):
        own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
        place = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
        places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: place(F.least(i, own), F.greatest(i, own), i < own))
        met = passed.join(crowded, ["d", "f"], "left").withColumn("at", F.explode(F.coalesce(F.when(F.col("blocks").isNotNull(), places), F.array(place(F.lit(0), F.lit(0), F.lit(False))))))
        alone = met.select(*passed.columns, "at.x", "at.y", "at.side")
    parts = max(12, min(1 << 16, math.ceil(sum(dims.values()) / 2000)))

    def verify(batches):
        now, got = None, []

        def links():
            t = pa.Table.from_batches(got).combine_chunks()
            if t.num_rows < 2:
                return None
            batch = t.to_batches()[0]
            cls = batch.column("cls").to_numpy()
            filters = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("filters")]
            ok = meet(unit_rows(batch.column("vec")), batch.column("side").to_numpy(zero_copy_only=False), filters, now[1], cosine)
            if ok is None:
                return None
            n = ok @ batch.column("copies").to_numpy()
            some = np.flatnonzero(n)
            edges = np.array(forest(ok))
            a = np.concatenate([cls[some], cls[edges[:, 0]]])
            b = pa.array(np.concatenate([np.zeros(len(some), np.int64), cls[edges[:, 1]]]), mask=np.arange(len(a)) < len(some))
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([n[some], np.zeros(len(edges), np.int64)]))], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("d", "f", "x", "y")])
            edge = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), batch.num_rows)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                own = tuple(key[:, a].tolist())
                if own != now:
                    if got and (out := links()) is not None:
                        yield out
                    now, got = own, []
                got.append(batch.slice(a, b - a))
        if got and (out := links()) is not None:
            yield out

    dealt = alone.repartition(parts, "d", "f", "x", "y").sortWithinPartitions("d", "f", "x", "y")
    links = written(dealt.mapInArrow(verify, "a long, b long, n long"), "cap-links")
    discard(passed, crowded)
    n_links = links.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cls")
    roots = connected_components(links.where("b IS NOT NULL").select("a", "b"), "cap-components").withColumnRenamed("node", "cls")
    known = written(classes.join(n_links, "cls", "left").join(roots, "cls", "left").select("vec", "first", F.coalesce("root", "cls").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-roots")
    least = written(known.groupBy("root").agg(F.min("first").alias("component_id")), "vector-components")
    named = written(known.join(least, "root").select("vec", "n_links", "component_id"), "vector-links")
    # equal vectors meet their class in a join that can be split: both sides are read from files
    out = rows.withColumn("vec", F.when(sound, F.col("vec"))).join(named, "vec", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
