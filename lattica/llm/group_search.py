"""Components of similar sets or sequences that share band keys, searched to the end in groups of any size.

Items are known by an id (`full`) and hold different elements each (`seq`, packed uint64). Two items whose similarity
reaches the threshold have at least the share `threshold` of their elements in common; that and a given function
of two element arrays decide. Of a small group all pairs are compared. The members of a larger group meet 4 leaders first;
then every two members that are not in one component yet meet in a pair of blocks, where the number of
common elements rules pairs out, so a large group is searched to the end as well. Groups are dealt into blocks by a
hash, so no task holds a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import connected_components, discard, written

#: Elements (and OVERHEAD for each item) of a block of a large group; a task holds two blocks.
BLOCK, OVERHEAD = 400_000, 256


def shared_elements(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each sequence of a has in common with each of b; the elements of one sequence are distinct."""
    out = np.zeros((len(a), len(b)), np.int64)
    both = np.intersect1d(*(np.unique(np.concatenate(x)) for x in (a, b)), assume_unique=True)
    if not len(both):
        return out
    cells = []
    for x in (a, b):
        e = np.concatenate(x)
        row = np.repeat(np.arange(len(x)), [len(y) for y in x])
        at = np.minimum(np.searchsorted(both, e), len(both) - 1)
        hit = both[at] == e
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        cells.append((row[order], at[order]))
    for low in range(0, len(both), width):
        dense = []
        for x, (row, at) in zip((a, b), cells, strict=True):
            i, j = np.searchsorted(at, (low, low + width))
            m = np.zeros((len(x), min(width, len(both) - low)), np.float32)
            m[row[i:j], at[i:j] - low] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def search_groups(met: DataFrame, sequences: DataFrame, similarity: Callable[[np.ndarray, np.ndarray], float], threshold: float, name: str, small: int = 12) -> tuple[DataFrame, DataFrame]:
    """met (key, full, n elements, size of the key's group) and sequences (full, seq), both written -> (links, roots):
    verified pairs (a, b), at least so many that they join all that is similar, and the component (node, root) of each
    item in a pair. The ids are binary. First each item is searched in its largest group only, which joins most of a
    family before all its groups are searched. No groups, or none with a similar pair, give empty tables."""

    def verify(p: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar."""

        def check(batches):
            for batch in batches:
                keep = []
                for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                    if similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= threshold - 1e-9:
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

        joined = p.join(sequences.select(F.col("full").alias("a"), F.col("seq").alias("x")), "a").join(sequences.select(F.col("full").alias("b"), F.col("seq").alias("y")), "b")
        return written(joined.select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary"), f"{name}-pairs")

    ratio = F.lit(threshold - 1e-9)
    lists = met.where(F.col("size") <= small).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("full", "n"))).alias("x"))
    fits = lambda a, b: F.least(a["n"], b["n"]) >= ratio * F.greatest(a["n"], b["n"])
    inner = F.transform("x", lambda a, i: F.transform(F.filter(F.slice("x", i + 2, F.size("x")), lambda b: fits(a, b)), lambda b: F.struct(a["full"].alias("a"), b["full"].alias("b"))))
    pairs = lists.select(F.explode(F.flatten(inner)).alias("p")).select("p.a", "p.b")
    left = met.where(F.col("size") > small).select("key", "full", "n", "size")
    any_large = bool(left.take(1))

    def led(members: DataFrame, leaders: int) -> DataFrame:
        """Pairs of members with the leaders of their groups."""
        who = F.struct(F.xxhash64("full", F.lit(0)).alias("h"), "full", "n")
        # the first of each of `leaders` hash buckets; the same texts lead wherever they are
        bucket = F.pmod(F.xxhash64("full", F.lit(1)), F.lit(leaders))
        first = members.groupBy("key", bucket.alias("bucket")).agg(F.min(who).alias("who"))
        lead = written(first.groupBy("key").agg(F.collect_list("who").alias("lead")), f"{name}-leaders")  # read from files, so that a hot key's join can be split
        # a member's leaders over all its bands, each once
        other = F.filter("lead", lambda x: (x["full"] != F.col("full")) & fits(x, {"n": F.col("n")}))
        wide = members.join(lead, "key").select("full", other.alias("other")).where(F.size("other") > 0)
        own = wide.groupBy("full").agg(F.array_distinct(F.flatten(F.collect_set("other"))).alias("other"))
        p = own.select("full", F.explode(F.transform("other", lambda x: x["full"])).alias("l")).select(F.least("full", "l").alias("a"), F.greatest("full", "l").alias("b"))
        return p.distinct()

    def rooted(d: DataFrame, name: str, roots: DataFrame) -> DataFrame:
        r = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        return d.join(r, F.col(name) == F.col("_n"), "left").withColumn("root", F.coalesce("_r", name)).drop("_n", "_r")

    def search(members: DataFrame, roots: DataFrame) -> DataFrame | None:
        """Links (a, b) between the components of a group, at least one wherever two of its members are similar (None: each
        group is one component). Members outside a group's largest component (side 0) meet all members (side 1), block by
        block."""
        m = written(rooted(members.select("key", "full", "n"), "full", roots), f"{name}-members")
        each = m.groupBy("key", "root").agg(F.sum(F.col("n") + OVERHEAD).alias("e"))
        parts = lambda e: F.ceil(e / BLOCK)
        groups = each.groupBy("key").agg(F.max(F.struct("e", "root")).alias("top"), F.sum("e").alias("e"), F.count("*").alias("roots")).where("roots > 1")
        groups = written(groups.select("key", F.col("top.root").alias("top"), parts(F.col("e")).alias("wide"), parts(F.col("e") - F.col("top.e")).alias("high")), f"{name}-groups")
        if not groups.take(1):
            return None
        h = F.xxhash64("full", F.lit(2))
        met = m.join(groups, "key").withColumn("rest", F.col("root") != F.col("top"))
        place = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.cast("long").alias("x"), y.cast("long").alias("y"))
        right = F.transform(F.sequence(F.lit(0).cast("long"), F.col("high") - 1), lambda y: place(1, F.pmod(h, F.col("wide")), y))
        left = F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda x: place(0, x, F.pmod(h, F.col("high"))))
        dealt = met.select("key", "full", "root", "rest", F.explode(F.when(F.col("rest"), F.concat(left, right)).otherwise(right)).alias("at"))
        dealt = dealt.select("key", "at.x", "at.y", "at.side", "full", "root", "rest").join(sequences, "full")

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("full")
            number = {r: i for i, r in enumerate(dict.fromkeys(t.column("root").to_pylist()))}
            sides = []
            for side in (0, 1):
                own = t.filter(pa.array(t.column("side").to_numpy() == side))
                seqs = [np.frombuffer(x.as_buffer(), np.uint64) for c in own.column("seq").chunks for x in c]
                sides.append((own.column("full").to_pylist(), np.array([number[r] for r in own.column("root").to_pylist()], np.int64), seqs, own.column("rest").to_numpy(zero_copy_only=False) if own.num_rows else np.zeros(0, bool)))
            (fa, ra, sa, _), (fb, rb, sb, rest) = sides
            a, b = [], []
            if fa and fb:
                # pairs in one component already are left out, pairs of two outside the largest one are met once
                rank = {f: i for i, f in enumerate(sorted({*fa, *fb}))}
                ia, ib = np.array([rank[f] for f in fa]), np.array([rank[f] for f in fb])
                may = (ra[:, None] != rb[None]) & (~rest[None] | (ia[:, None] < ib[None]))
                common = shared_elements(sa, sb)
                na, nb = (np.array([len(x) for x in y], np.int64) for y in (sa, sb))
                # in order or not, the share of common elements is no less than the similarity
                may &= common >= (threshold - 1e-9) * (na[:, None] + nb[None] - common)
                parent = list(range(len(number)))

                def find(x):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for i, j in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
                    u, v = find(ra[i]), find(rb[j])
                    if u != v and similarity(sa[i], sb[j]) >= threshold - 1e-9:
                        parent[u] = v
                        a.append(min(fa[i], fb[j]))
                        b.append(max(fa[i], fb[j]))
            return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        return written(dealt.groupBy("key", "x", "y").applyInArrow(run, "a binary, b binary").distinct(), f"{name}-links")

    if any_large:
        pairs = pairs.union(led(left, 4))
    found = verify(pairs.distinct())
    roots = written(connected_components(found, f"{name}-components"), f"{name}-roots")
    if any_large:
        largest = left.groupBy("full").agg(F.max(F.struct("size", "key", "n")).alias("g")).select("g.key", "full", "g.n")
        for members in (largest, left):
            new = search(members, roots)
            if new is None or not new.take(1):
                continue
            found = found.union(new)
            # new links join components: only their roots are clustered again
            joined = rooted(rooted(new, "a", roots).withColumnRenamed("root", "ra"), "b", roots).select(F.col("ra").alias("a"), F.col("root").alias("b"))
            again = connected_components(joined, f"{name}-components").select(F.col("node").alias("root"), F.col("root").alias("new_root"))
            nodes = roots.union(joined.select(F.explode(F.array("a", "b")).alias("node"), F.col("node").alias("root"))).distinct()
            roots = written(nodes.join(again, "root", "left").select("node", F.coalesce("new_root", "root").alias("root")), f"{name}-roots")
    return found.distinct(), roots
