"""Token counts by a compiled finite-state tokenizer.

A subword vocabulary with merge priorities (piece scores) is compiled, as far as texts need it, into a
deterministic transducer over characters: a state holds the longest suffix read that can still grow into
a piece together with the last piece of the segmentation of every prefix inside that suffix; a transition
is annotated with the change of the emitted-token count. States are made when first reached and kept in
dense tables, so a batch of text is stepped through the tables, all its runs side by side.

Runs: no piece joins a non-space to a following space mark, so the transducer returns to its start state before
every space that follows a non-space. Short runs are stepped from there, equal ones once. A longer run is cut into
chunks, which are stepped side by side from the start state. A chunk's state map sends an entry state to an exit state
and a count: it steps on from the entry state until it meets the chunk's own trace, as it does within a few characters,
and takes the rest from there. Maps of neighbours compose into a map; those of a run's chunks are composed pairwise,
as a parallel prefix scan does."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import mix, powers, slices, text_buffer

SPACE = "▁"
#: A worker that has compiled more states than this starts over, which bounds its memory.
MAX_STATES = 600_000
#: Longer runs are cut into chunks, about as many as each has characters; a scan takes in this many characters.
LONG, SCAN = 2048, 1 << 20


def load_pieces(path: str) -> dict[str, float]:
    """Normal pieces of a sentencepiece BPE model with byte fallback and the identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a BPE model with byte fallback and the identity normaliser is needed")
    return {p.piece: p.score for p in model.pieces if p.type == 1}


class Unsegmentable(ValueError):
    """The transducer found no segmentation of a suffix; the run is segmented by merges instead."""


class Transducer:
    """Lazily compiled; see the module's text. step() gives (state, count change) for a state and a class."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.names = ["", *pieces]
        self.number = {p: i for i, p in enumerate(self.names)}
        #: pending suffixes: everything that a piece begins with
        self.heads = {h: i for i, h in enumerate(dict.fromkeys(["", *(p[:i] for p in pieces for i in range(1, len(p) + 1))]))}
        self.head_names = list(self.heads)
        self.chars = sorted({c for p in pieces for c in p})
        if not all(c in pieces for c in self.chars):
            raise ValueError("each character of a piece must be a piece")
        if any(b == SPACE != a for p in pieces for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece joins a non-space to a space mark")
        self.class_of = {c: i for i, c in enumerate(self.chars)}
        # class len(chars): a character outside the vocabulary, which ends whatever was pending.
        self.width = len(self.chars) + 1
        self.fits: dict[int, bool] = {}
        # a state's key: the pending suffix's number, then a mark for each prefix that ends i characters before the
        # suffix's end (i = 0 .. its length): piece number * 64 + 32 + (count - count at the end), or -1
        self.states: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.state(struct.pack("2i", 0, 32))
        self.cap = 1 << 14
        self.slot_keys = np.zeros(self.cap, np.int64) - 1
        self.slot_vals = np.zeros(self.cap, np.int64)
        self.filled = 0

    def state(self, key: bytes) -> int:
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = len(self.keys)
            self.keys.append(key)
        return got

    def merged(self, text: str) -> list[str]:
        """The segmentation by merges: always the best-scored adjacent pair that makes a piece, the leftmost of equals."""
        parts: list[str | None] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.pieces.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if parts[i] != a or parts[j] != b or right[i] != j:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def fit(self, a: int, b: int) -> bool:
        """Whether piece b can follow piece a."""
        got = self.fits.get(a << 20 | b)
        if got is None:
            x, y = self.names[a], self.names[b]
            got = self.fits[a << 20 | b] = self.merged(x + y) == [x, y]
        return got

    def step(self, state: int, c: int) -> tuple[int, int]:
        """State and change of the count."""
        if c == self.width - 1:
            return 0, 0
        key = self.keys[state]
        head, *marks = struct.unpack(f"{len(key) // 4}i", key)
        grown = self.head_names[head] + self.chars[c]
        for n in range(len(grown), 0, -1):
            p = self.number.get(grown[-n:])
            mark = marks[n - 1]
            if p is not None and mark >= 0 and (mark < 64 or self.fit(mark >> 6, p)):
                break
        else:
            raise Unsegmentable(grown)
        delta = 1 + (mark & 63) - 32
        keep = len(grown)
        while grown[len(grown) - keep :] not in self.heads:
            keep -= 1
        now = [p * 64 + 32]
        for i in range(1, keep + 1):
            m = marks[i - 1]
            # a prefix is remembered only if what follows it can still begin a piece
            now.append(m - delta if m >= 0 and grown[-i:] in self.heads else -1)
        return self.state(struct.pack(f"{keep + 2}i", self.heads[grown[len(grown) - keep :]], *now)), delta

    def lookup(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """step() of many (state, class) pairs: a probe of the compiled table, then the missing ones are compiled."""
        key = state * self.width + c
        out = self._probe(key)
        missing = out == -(1 << 40)
        if missing.any():
            for k in np.unique(key[missing]).tolist():
                to, delta = self.step(k // self.width, k % self.width)
                self._put(k, to * 256 + (delta + 128))
            out = self._probe(key)
        return out >> 8, (out & 255) - 128

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) & (self.cap - 1)

    def _probe(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        out = np.full(len(key), -(1 << 40), np.int64)
        todo = np.arange(len(key))
        while len(todo):
            at = self.slot_keys[slot[todo]]
            hit = at == key[todo]
            out[todo[hit]] = self.slot_vals[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
            slot[todo] = (slot[todo] + 1) & (self.cap - 1)
        return out

    def _put(self, key: int, val: int) -> None:
        if self.filled * 3 > self.cap:
            old = self.slot_keys >= 0
            keys, vals = self.slot_keys[old], self.slot_vals[old]
            self.cap *= 4
            self.slot_keys = np.zeros(self.cap, np.int64) - 1
            self.slot_vals = np.zeros(self.cap, np.int64)
            self.filled = 0
            for k, v in zip(keys.tolist(), vals.tolist(), strict=True):
                self._put(k, v)
        i = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20 & self.cap - 1
        while self.slot_keys[i] >= 0:
            i = (i + 1) & (self.cap - 1)
        self.slot_keys[i], self.slot_vals[i] = key, val
        self.filled += 1

    def next(self, state: int, c: int) -> tuple[int, int]:
        """step(), remembered."""
        to = self.steps.get((state, c))
        if to is None:
            to = self.steps[state, c] = self.step(state, c)
        return to

    def run(self, classes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Counts of many runs of classes, side by side, each from the start state."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.zeros(len(order), np.int64)
        count = np.zeros(len(order), np.int64)
        live = len(order)
        for t in range(int(length[0]) if len(order) else 0):
            live = int(np.searchsorted(-length[:live], -t, side="left"))
            state[:live], d = self.lookup(state[:live], classes[start[:live] + t])
            count[:live] += d
        out = np.empty_like(count)
        out[order] = count
        return out

    def scan(self, windows: Iterable[np.ndarray], chunk: int) -> int:
        """Count of one long run, which comes in windows of classes, by the state maps of its chunks."""
        state = count = 0
        for classes in windows:
            maps = self.maps(classes, chunk or max(64, int(len(classes) ** 0.5)))
            while len(maps) > 1:
                maps = [Joined(self, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            state, more = maps[0].apply(self, state)
            count += more
        return count

    def maps(self, classes: np.ndarray, chunk: int) -> list[Chunk]:
        """State maps of the chunks, which are stepped side by side."""
        n = -(-len(classes) // chunk)
        whole = np.full(n * chunk, self.width - 1, np.int64)
        whole[: len(classes)] = classes
        whole = whole.reshape(n, chunk).T.copy()
        states, counts = np.zeros((chunk, n), np.int32), np.zeros((chunk, n), np.int32)
        state, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t in range(chunk):
            state, d = self.lookup(state, whole[t])
            count = count + d
            states[t], counts[t] = state, count
        size = [chunk] * (n - 1) + [len(classes) - chunk * (n - 1)]
        return [Chunk(whole[:m, i].tolist(), states[:m, i].tolist(), counts[:m, i].tolist()) for i, m in enumerate(size)]


class Chunk:
    """State map of a chunk. exit, count: those of the start state; trace: its states and counts after each character."""

    def __init__(self, classes: list[int], states: list[int], counts: list[int]):
        self.classes, self.states, self.counts, self.exit, self.count = classes, states, counts, states[-1], counts[-1]

    def apply(self, t: Transducer, state: int) -> tuple[int, int]:
        if state == 0:
            return self.exit, self.count
        n = 0
        for c, known, sofar in zip(self.classes, self.states, self.counts, strict=True):
            state, d = t.next(state, c)
            n += d
            if state == known:
                return self.exit, n + self.count - sofar
        return state, n


class Joined:
    """State map of two neighbours; composing is associative."""

    def __init__(self, t: Transducer, left: Chunk | Joined, right: Chunk | Joined):
        self.left, self.right = left, right
        self.exit, more = right.apply(t, left.exit)
        self.count = left.count + more

    def apply(self, t: Transducer, state: int) -> tuple[int, int]:
        to, n = self.left.apply(t, state)
        if to == self.left.exit:
            return self.exit, n + self.count - self.left.count
        to, more = self.right.apply(t, to)
        return to, n + more


class Counter:
    """Counts the tokens of texts with a Transducer."""

    def __init__(self, path: str):
        self.transducer = t = Transducer(load_pieces(path))
        self.lut = np.full(0x110000, t.width - 1, np.int32)
        for c, i in t.class_of.items():
            self.lut[ord(c)] = i
        if " " not in t.class_of:
            self.lut[ord(" ")] = t.class_of[SPACE]
        self.space = t.class_of[SPACE]

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Where the transducer is surely back at its start state: before a space after a non-space."""
        c = self.lut[points]
        here = c == self.space
        return np.flatnonzero(here[1:] & ~here[:-1]) + 1

    def count_runs(self, points: np.ndarray, start: np.ndarray, chunk: int = 0) -> np.ndarray:
        """Tokens of the runs of `points` that begin at `start` (ascending, the first at 0). chunk: of long runs, in
        characters; 0: about the root of a window's length."""
        if not len(start) or not len(points):
            return np.zeros(len(start), np.int64)
        t = self.transducer
        length = np.diff(np.append(start, len(points)))
        # equal runs are stepped once: a run's hash names it, within this call
        c = self.lut[points]
        up, down = powers(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
        h = mix((total[start + length] - total[start]) * down[start])
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        start, length = start[first], length[first]
        more = np.concatenate([[0], np.cumsum(self.foreign(points))])
        out = more[start + length] - more[start]
        brief = length <= LONG
        try:
            out[brief] += t.run(c, start[brief], length[brief])
        except Unsegmentable:
            for i in np.flatnonzero(brief).tolist():
                out[i] += self.by_merges(points[start[i] : start[i] + length[i]])
        for i in np.flatnonzero(~brief).tolist():
            out[i] += self.long_run(points[start[i] : start[i] + length[i]], chunk)
        return out[back]

    def long_run(self, points: np.ndarray, chunk: int) -> int:
        """Tokens of a run's characters in the vocabulary."""
        try:
            return self.transducer.scan((self.lut[points[at : at + SCAN]] for at in range(0, len(points), SCAN)), chunk)
        except Unsegmentable:
            return self.by_merges(points)

    def count_long(self, text: str, chunk: int) -> int:
        """Tokens of one long text, a window of whole runs at a time."""
        points = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
        total = at = 0
        while at < len(points):
            end = at + SCAN
            cut = self.cuts(points[at : end + 1])
            while not len(cut) and end < len(points):  # a run longer than the window
                cut = self.cuts(points[end - 1 : end + SCAN]) + (end - 1 - at)
                end += SCAN
            if end - at <= SCAN:
                stop = len(points) if end >= len(points) else at + int(cut[-1])
                start = np.append(0, cut)
                total += int(self.count_runs(points[at:stop].astype(np.int64), start[start < stop - at], chunk).sum())
            else:
                stop = at + int(cut[0]) if len(cut) else len(points)
                total += self.long_run(points[at:stop], chunk) + sum(int(self.foreign(points[x : min(x + SCAN, stop)]).sum()) for x in range(at, stop, SCAN))
            at = stop
        return total

    def foreign(self, points: np.ndarray) -> np.ndarray:
        """Tokens that each character emits by itself: one a byte if it is outside the vocabulary."""
        extra = np.zeros(len(points), np.int64)
        alien = self.lut[points] == self.transducer.width - 1
        p = points[alien]
        extra[alien] = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
        return extra

    def by_merges(self, points: np.ndarray) -> int:
        """Tokens of characters in the vocabulary in a run, by the merges themselves."""
        c = self.lut[points]
        edge = np.flatnonzero(c == self.transducer.width - 1)
        parts = np.split(c, edge)
        names = self.transducer.chars
        return sum(len(self.transducer.merged("".join(names[x] for x in p.tolist() if x < len(names)))) for p in parts if len(p))

    def count(self, raw: np.ndarray, off: np.ndarray, chunk: int = 0) -> np.ndarray:
        """Tokens of each text of a UTF-8 buffer."""
        out = np.zeros(len(off) - 1, np.int64)
        size = np.diff(off)
        for i in np.flatnonzero(size > 4 * SCAN):
            out[i] = self.count_long(raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"), chunk)
        some = np.flatnonzero((size > 0) & (size <= 4 * SCAN))
        if len(some):
            texts = [" " + raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace") for i in some]
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            begin = np.cumsum([0] + [len(t) for t in texts])
            cut = np.union1d(self.cuts(points), begin[:-1])
            n = self.count_runs(points, cut, chunk)
            out[some] = np.add.reduceat(n, np.searchsorted(cut, begin[:-1]))
        return out


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model_path: str, chunk_chars: int = 0, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs (doc_id, text).

    Tokens are those of the model's library for the whole text, without begin or end tokens; strings of special tokens
    inside a text are ordinary text. Null and empty texts have none; repeated rows are counted each; an empty table gives
    none; other columns, whatever their names, are left out. The model file is read from model_path by each worker. No
    shuffle: rows are independent. Runs of a text between spaces that are long are stepped in chunks of chunk_chars
    characters (0: about the root of the run's length)."""
    schema = T.StructType([docs.schema["doc_id"]]).add("n_bytes", T.LongType()).add("n_tokens", T.LongType()).add("over_limit", T.BooleanType())

    def count(batches):
        counter = _counters.get(model_path)
        if counter is None:
            counter = _counters[model_path] = Counter(model_path)
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                raw, off = text_buffer(part.column("text"))
                n = counter.count(raw, off, chunk_chars)
                if len(counter.transducer.keys) > MAX_STATES:
                    counter = _counters[model_path] = Counter(model_path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, schema)
