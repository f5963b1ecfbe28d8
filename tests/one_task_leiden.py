"""Communities of a graph held in memory, to compare with."""

import numpy as np


def leiden(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 0, rounds: int = 10) -> np.ndarray:
    """Communities of an undirected graph (each edge in both directions) by modularity: nodes move to the best
    neighbouring community, communities are refined into well-connected parts, parts become nodes, and again.
    Labels 0.. by falling size."""
    rng = np.random.default_rng(seed)
    member = np.arange(n)  # node of the current level for each original node
    start_from = None
    two_m = max(float(w.sum()), 1e-300)
    for _ in range(rounds):
        size = int(member.max()) + 1 if n else 0
        order = np.lexsort((dst, src))
        s, t, x = src[order], dst[order], w[order]
        at = np.searchsorted(s, np.arange(size + 1))
        degree = np.bincount(s, x, size)
        adj = [(t[at[i] : at[i + 1]].tolist(), x[at[i] : at[i + 1]].tolist()) for i in range(size)]

        def move(labels, allowed=None, size=size, degree=degree, adj=adj):
            total = np.bincount(labels, degree, size).tolist()
            labels = labels.tolist()
            queue, queued, any_move = rng.permutation(size).tolist(), [True] * size, False
            head = 0
            while head < len(queue):
                i = queue[head]
                head += 1
                queued[i] = False
                if allowed is not None and singles[i] > 1:
                    continue
                to: dict[int, float] = {}
                for j, v in zip(*adj[i], strict=True):
                    if j != i and (allowed is None or allowed[j] == allowed[i]):
                        to[labels[j]] = to.get(labels[j], 0.0) + v
                own, d = labels[i], degree[i]
                total[own] -= d
                best, gain = own, to.get(own, 0.0) - resolution * d * total[own] / two_m
                for c, v in to.items():
                    g = v - resolution * d * total[c] / two_m
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += d
                if best != own:
                    labels[i], any_move = best, True
                    if allowed is not None:
                        singles[i] = 2
                        for j in adj[i][0]:
                            if labels[j] == best:
                                singles[j] = 2
                    else:
                        for j in adj[i][0]:
                            if labels[j] != best and not queued[j]:
                                queue.append(j)
                                queued[j] = True
            return np.array(labels, np.int64), any_move

        labels, moved = move(np.arange(size) if start_from is None else start_from)
        _, labels = np.unique(labels, return_inverse=True)
        if not moved or labels.max(initial=-1) + 1 == size:
            member = labels[member]
            break
        singles = [1] * size
        parts, _ = move(np.arange(size), allowed=labels.tolist())
        _, parts = np.unique(parts, return_inverse=True)
        if parts.max() + 1 == size:
            parts = labels
        start_from = np.zeros(int(parts.max()) + 1, np.int64)
        start_from[parts] = labels
        _, start_from = np.unique(start_from, return_inverse=True)
        member = parts[member]
        key = parts[src] * (int(parts.max()) + 1) + parts[dst]
        u, back = np.unique(key, return_inverse=True)
        w = np.bincount(back, w)
        src, dst = u // (int(parts.max()) + 1), u % (int(parts.max()) + 1)
    else:
        member = start_from[member] if start_from is not None else member
    count = np.bincount(member) if n else np.zeros(0)
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count))
    return rank[member] if n else member
