"""Temporal communities of visibility graphs. A signal's graph is found and searched in one task, without a shuffle.

Graphs are lists of neighbours. Path lengths from all nodes are relaxed edge by edge, to and fro along time, and as edges
are short in time a few sweeps settle them. Betweenness counts shortest paths level by level, for a block of sources
at once; when an edge goes, only sources with that edge on a shortest path are counted again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import visibility

#: Pairs of source and node that are counted at once.
PAIRS = 1 << 20


class Graph:
    """An undirected graph of n nodes, with the length of each edge; a pair of nodes has one edge at most."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray):
        self.n, self.i, self.j, self.w = n, np.asarray(i, int), np.asarray(j, int), np.abs(np.asarray(w, float))
        tail, head = np.concatenate([self.i, self.j]), np.concatenate([self.j, self.i])
        by = np.lexsort((head, tail))
        self.head, self.length, self.edge = head[by], np.tile(self.w, 2)[by], np.tile(np.arange(len(self.i)), 2)[by]
        self.first = np.searchsorted(tail[by], np.arange(n + 1))

    def near(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        """(neighbours of v, ascending, lengths)."""
        a, b = self.first[v], self.first[v + 1]
        return self.head[a:b], self.length[a:b]

    def without(self, edge: int | None = None, node: int | None = None) -> Graph:
        keep = np.arange(len(self.i)) != edge
        if node is not None:
            keep &= (self.i != node) & (self.j != node)
        return Graph(self.n, self.i[keep], self.j[keep], self.w[keep])


def shortest(g: Graph) -> np.ndarray:
    """All path lengths."""
    d = np.full((g.n, g.n), np.inf)
    np.fill_diagonal(d, 0)
    forth = np.lexsort((g.i, g.j)).tolist()
    i, j, w = g.i.tolist(), g.j.tolist(), g.w.tolist()
    while True:
        before = d.copy()
        for e in forth:
            np.minimum(d[j[e]], d[i[e]] + w[e], out=d[j[e]])
        for e in reversed(forth):
            np.minimum(d[i[e]], d[j[e]] + w[e], out=d[i[e]])
        if np.array_equal(before, d):
            return np.minimum(d, d.T)


def backbone(g: Graph, d: np.ndarray) -> list[int]:
    """Nodes of the shortest path from first to last; of equal paths the one through the smallest nodes."""
    path, at, last = [0], 0, g.n - 1
    while at != last and np.isfinite(d[at, last]):
        near, length = g.near(at)
        gap = np.abs(length + d[near, last] - d[at, last])
        at = int(near[np.flatnonzero(gap <= 1e-9 * max(1.0, d[at, last]))[0]])
        path.append(at)
    return path


def _gap_cut(d: np.ndarray, hubs: list[int]) -> float | None:
    """The start of the widest gap in the hub distances that lies no higher than the median of all path lengths."""
    pairs = d[np.triu_indices(len(d), 1)]
    values = sorted([pairs.min(), *[d[a, b] for a, b in zip(hubs, hubs[1:], strict=False)], pairs.max()])
    gaps = np.diff(values)
    middle = float(np.median(pairs))
    while len(gaps):
        k = int(gaps.argmax())
        if values[k] <= middle:
            return float(values[k])
        gaps = gaps[:-1]
    return None


def by_path_length(g: Graph, direction: str | None = None, cutoff: float | str | None = "auto") -> np.ndarray:
    """A community for each node: hubs are the backbone, nodes join their nearest hub, close hubs merge."""
    n, d = g.n, shortest(g)
    hubs = backbone(g, d)
    own = np.zeros(n, int)
    for v in range(n):
        if v in hubs:
            own[v] = v
            continue
        allowed = [h for h in hubs if direction is None or (h < v if direction == "left" else h > v)] or hubs
        reach = [d[v, h] if d[v, h] > 0 else np.inf for h in allowed]
        own[v] = allowed[int(np.argmin(reach))]
    cut = None
    if n > 1 and len(hubs) > 1:
        pairs = d[np.triu_indices(n, 1)]
        cut = _gap_cut(d, hubs) if cutoff == "auto" else (float(np.percentile(pairs, cutoff)) if cutoff is not None else None)
    rest, lead = sorted(hubs), {}
    while rest:
        a, rest = rest[0], rest[1:]
        lead[a] = a
        if cut is not None:
            for b in [h for h in rest if d[a, h] <= cut]:
                lead[b] = a
            rest = [h for h in rest if d[a, h] > cut]
    names = {h: k for k, h in enumerate(sorted(set(lead.values())))}
    return np.array([names[lead[h]] for h in own])


def _paths(g: Graph, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paths through each node, through each edge, depth of each node from each source), each path counted from its source only."""
    n, b = g.n, len(sources)
    depth, count = np.full(b * n, -1), np.zeros(b * n)
    start = np.arange(b) * n + sources
    depth[start], count[start] = 0, 1

    def spread(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs at, pairs of the same source with a neighbour, edge between)."""
        v = at % n
        size = g.first[v + 1] - g.first[v]
        place = np.repeat(g.first[v] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(at, size), np.repeat(at - v, size) + g.head[place], g.edge[place]

    levels = [start]
    while len(levels[-1]):
        tail, head, _ = spread(levels[-1])
        fresh = depth[head] < 0
        tail, head = tail[fresh], head[fresh]
        np.add.at(count, head, count[tail])
        level = np.unique(head)
        depth[level] = len(levels)
        levels.append(level)
    share, edges = np.zeros(b * n), np.zeros(len(g.i))
    for k in range(len(levels) - 2, 0, -1):
        tail, head, edge = spread(levels[k])
        back = depth[head] == k - 1
        tail, head, edge = tail[back], head[back], edge[back]
        part = count[head] / count[tail] * (1 + share[tail])
        np.add.at(share, head, part)
        edges += np.bincount(edge, part, len(edges))
    share[start] = 0
    return share.reshape(b, n).sum(0), edges, depth.reshape(b, n)


def _counted(g: Graph, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_paths() a block of sources at a time."""
    nodes, edges, depth = np.zeros(g.n), np.zeros(len(g.i)), np.zeros((len(sources), g.n), np.int32)
    step = max(1, PAIRS // max(1, g.n + 2 * len(g.i)))
    for a in range(0, len(sources), step):
        x, y, depth[a : a + step] = _paths(g, sources[a : a + step])
        nodes, edges = nodes + x, edges + y
    return nodes, edges, depth


def betweenness(g: Graph, alive: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """Shortest paths, by number of edges, through nodes and edges, each pair of ends counted once (Brandes)."""
    nodes, edges, _ = _counted(g, np.flatnonzero(alive))
    return nodes / 2, {(min(a, b), max(a, b)): v / 2 for a, b, v in zip(g.i.tolist(), g.j.tolist(), edges.tolist(), strict=True)}


def by_betweenness(g: Graph, least: int = 2) -> np.ndarray:
    """Segments that start at node 0 and at the least - 1 nodes with the most shortest paths through them, removed one at a time.

    Of equal nodes the first goes; if that is node 0, there is a segment less.
    """
    n, alive, starts = g.n, np.ones(g.n, bool), {0}
    for _ in range(min(least - 1, n - 1)):
        node, _, _ = _counted(g, np.flatnonzero(alive))
        node = np.round(node / 2, 9)
        node[~alive] = -1
        top = int(node.argmax())
        starts.add(top)
        alive[top] = False
        g = g.without(node=top)
    cuts = sorted(starts)
    return np.searchsorted(cuts, np.arange(n), "right") - 1


def parts(g: Graph) -> np.ndarray:
    """Connected parts, numbered by their first nodes."""
    part, k = np.full(g.n, -1), 0
    for s in range(g.n):
        if part[s] < 0:
            stack = [s]
            part[s] = k
            while stack:
                near, _ = g.near(stack.pop())
                near = near[part[near] < 0]
                part[near] = k
                stack += near.tolist()
            k += 1
    return part


def by_edge_splits(g: Graph, least: int = 2) -> np.ndarray:
    """Connected parts after removing the edges with the most shortest paths, until there are enough parts.

    Of equal edges the first goes, by its nodes. A source on whose shortest paths the edge does not lie keeps its counts.
    """
    every = np.arange(g.n)
    part, found = parts(g), None
    while part.max(initial=-1) + 1 < min(least, g.n) and len(g.i):
        _, links, depth = _counted(g, every) if found is None else found
        lo, hi = np.minimum(g.i, g.j), np.maximum(g.i, g.j)
        e = int(np.lexsort((hi, lo, -np.round(links / 2, 9)))[0])
        changed = np.flatnonzero((depth[:, g.i[e]] != depth[:, g.j[e]]) & (depth[:, g.i[e]] >= 0))
        rest = g.without(edge=e)
        if 2 * len(changed) < g.n:
            new = depth.copy()
            _, old, _ = _counted(g, changed)
            _, more, new[changed] = _counted(rest, changed)
            found = None, np.delete(links - old, e) + more, new
        else:
            found = None
        g, part = rest, parts(rest)
    return part


METHODS = {"path": by_path_length, "betweenness": by_betweenness, "edges": by_edge_splits}


def of_series(points: DataFrame, method: str = "path", horizontal: bool = False, **options) -> DataFrame:
    """(id, node, community) of visibility points(id, t, x) by the graph that belongs to the method.

    path: the dual graph weighted by distance, nodes go to earlier hubs and hubs merge by the automatic cutoff. betweenness: the graph
    of -x. edges: the graph of x. In the last two, points that touch the line of sight don't block it.
    """
    kind = "horizontal" if horizontal else "natural"
    if method == "path":
        return communities(points, method, kind, "distance", two_sided=True, **({"direction": "left"} | options))
    return communities(points, method, kind, through=True, below=method == "betweenness", **options)


def communities(points: DataFrame, method: str = "path", kind: str = "natural", weight: str | None = None, through: bool = False, two_sided: bool = False, below: bool = False, **options) -> DataFrame:
    """(id, node, community) of every node of the graphs of points(id, t, x); two_sided takes dual graphs, below those of -x."""
    find = METHODS[method]

    def run(t: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        edges = (visibility.dual if two_sided else visibility.graph)(t, -x if below else x, kind, weight, through)
        return {"node": np.arange(len(x)), "community": find(Graph(len(x), *edges), **options) if len(x) else np.zeros(0, int)}

    return visibility.per_signal(points, run, "node int, community int")
