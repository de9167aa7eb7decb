"""Navigable small-world graphs over unit vectors, in numpy.

Vectors that lie within half the wanted angle of an earlier one join its ball instead of the graph:
any two of a ball are then within the angle, so a ball is linked throughout and one node of the
graph stands for it, however many copies it holds. Nodes have levels; those of a level and above
are joined to near ones in different directions. A search starts at the top, walks down, and keeps
a beam of the best nodes seen on the lowest level. Many queries walk in step, one matrix product
for all of them.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a node on upper levels, and twice as many on the lowest.
DEGREE = 16
BUILD_BEAM = 48
#: Nodes of the beam that are followed at once.
FOLLOWED = 4
#: Numbers in the tables a search holds at once.
CELLS = 1 << 22


class Graph:
    """``lead``: numbers of the vectors that are nodes; ``ball``: the node of each vector; ``near``:
    per level the neighbours of each node, -1 where there is none."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        self.vectors = vectors
        self.ball = np.full(n, -1, np.int64)
        self.lead = np.zeros(0, np.int64)
        self.level = np.zeros(0, np.int64)
        self.near: list[np.ndarray] = []
        self.nodes = np.empty((0, vectors.shape[1]))
        self.radius = np.zeros(0)

    # -- search ---------------------------------------------------------------------------------

    def _beam(self, level: int, q: np.ndarray, starts: np.ndarray, width: int):
        """The ``width`` best nodes of a level for each query, best first; -1 where there are less."""
        near, n = self.near[level], len(q)
        ids, sims = np.full((n, width), -1), np.full((n, width), -np.inf)
        seen = np.zeros((n, len(self.nodes) + 1), bool)  # the last column is for -1
        seen[:, -1] = True
        open_ = np.zeros((n, width), bool)

        def met(rows: np.ndarray, found: np.ndarray) -> None:
            found = np.sort(found, 1)
            twice = np.zeros(found.shape, bool)
            twice[:, 1:] = found[:, 1:] == found[:, :-1]
            new = ~twice & ~seen[rows[:, None], found]
            seen[rows[:, None], found] = True
            got = np.matmul(self.nodes[found], q[rows][:, :, None])[:, :, 0]
            got[~new] = -np.inf
            every = np.concatenate([sims[rows], got], 1)
            order = np.argsort(-every, 1, kind="stable")[:, :width]
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], found], 1), order, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], new], 1), order, 1)
            sims[rows] = np.take_along_axis(every, order, 1)

        met(np.arange(n), starts)
        step = min(FOLLOWED, width)
        while (active := np.flatnonzero(open_.any(1))).size:
            rank = np.argsort(~open_[active], 1, kind="stable")[:, :step]
            ok = np.take_along_axis(open_[active], rank, 1)
            node = np.where(ok, np.take_along_axis(ids[active], rank, 1), -1)
            open_[active[:, None], rank] = False
            around = near[node]
            around[~ok] = -1
            met(active, around.reshape(len(active), -1))
        ids[np.isneginf(sims)] = -1
        return ids, sims

    def search(self, q: np.ndarray, width: int):
        """Nodes and similarities of the ``width`` best found for each query."""
        width = max(1, min(width, len(self.nodes)))
        chunk = max(1, min(512, CELLS // (len(self.nodes) + FOLLOWED * 2 * DEGREE * q.shape[1] + width)))
        ids, sims = np.empty((len(q), width), np.int64), np.empty((len(q), width))
        top = int(np.argmax(self.level))
        for a in range(0, len(q), chunk):
            part = q[a : a + chunk]
            at = np.full((len(part), 1), top)
            for level in range(len(self.near) - 1, 0, -1):
                at, _ = self._beam(level, part, at, 4)
            ids[a : a + chunk], sims[a : a + chunk] = self._beam(0, part, at, width)
        return ids, sims

    # -- building -------------------------------------------------------------------------------

    def build(self, tight: float, seed: int = 0) -> Graph:
        """Add all vectors in order; those within the cosine ``tight`` of a node join its ball."""
        rng = np.random.default_rng(seed)
        at = 0
        while at < len(self.vectors):
            size = min(max(32, len(self.lead)), 1024)
            self._add(np.arange(at, min(at + size, len(self.vectors))), tight, rng)
            at += size
        angle = np.arccos(np.clip((self.vectors * self.nodes[self.ball]).sum(1), -1, 1))
        self.radius = np.zeros(len(self.lead))
        np.maximum.at(self.radius, self.ball, angle)
        self.radius[np.bincount(self.ball, minlength=len(self.lead)) == 1] = 0.0
        return self

    def _add(self, rows: np.ndarray, tight: float, rng: np.random.Generator) -> None:
        x = self.vectors[rows]
        old = len(self.lead)
        found = sims = None
        left = np.arange(len(rows))
        if old:
            found, sims = self.search(x, BUILD_BEAM)
            inside = sims[:, 0] >= tight
            self.ball[rows[inside]] = found[inside, 0]
            left = np.flatnonzero(~inside)
        among = x[left] @ x[left].T
        new: list[int] = []
        for i in range(len(left)):
            if new:
                own = among[i, new]
                j = int(np.argmax(own))
                if own[j] >= tight:
                    self.ball[rows[left[i]]] = old + j
                    continue
            self.ball[rows[left[i]]] = old + len(new)
            new.append(i)
        if not new:
            return
        self.lead = np.concatenate([self.lead, rows[left[new]]])
        self.nodes = np.concatenate([self.nodes, x[left[new]]])
        drawn = np.floor(-np.log(1 - rng.random(len(new))) / np.log(DEGREE)).astype(np.int64)
        self.level = np.concatenate([self.level, drawn])
        for level in range(int(self.level.max()) + 1):
            degree = DEGREE if level else 2 * DEGREE
            if level == len(self.near):
                self.near.append(np.full((0, degree), -1))
            more = np.full((len(self.lead) - len(self.near[level]), degree), -1)
            self.near[level] = np.concatenate([self.near[level], more])
        for level in range(len(self.near)):
            mine = np.flatnonzero(self.level[old:] >= level)
            if not len(mine):
                continue
            nodes = old + mine
            if level == 0 and old:
                own = among[np.ix_(new, new)]
                np.fill_diagonal(own, -np.inf)
                best = np.argsort(-own, 1)[:, :BUILD_BEAM]
                ids = np.concatenate([found[left[new]], old + best], 1)
                got = np.concatenate([sims[left[new]], np.take_along_axis(own, best, 1)], 1)
            else:  # few nodes: all are compared
                there = np.flatnonzero(self.level >= level)
                got = self.nodes[nodes] @ self.nodes[there].T
                got[nodes[:, None] == there[None, :]] = -np.inf
                best = np.argsort(-got, 1)[:, :BUILD_BEAM]
                ids, got = there[best], np.take_along_axis(got, best, 1)
            self._join(level, nodes, ids, got)

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """The best of each row that are not nearer to a better one; then the best of the rest."""
        order = np.argsort(-sims, 1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), degree), -1)
        chunk = max(1, CELLS // max(1, ids.shape[1] * (ids.shape[1] + self.nodes.shape[1])))
        for a in range(0, len(ids), chunk):
            i, s = ids[a : a + chunk], sims[a : a + chunk]
            v = self.nodes[i]
            pair = np.matmul(v, v.transpose(0, 2, 1))
            ok = np.isfinite(s)
            keep = np.zeros(i.shape, bool)
            for c in range(i.shape[1]):
                hidden = (keep[:, :c] & (pair[:, c, :c] >= s[:, c : c + 1])).any(1)
                keep[:, c] = ok[:, c] & ~hidden
            rank = np.argsort(np.where(keep, 0, np.where(ok, 1, 2)), 1, kind="stable")[:, :degree]
            out[a : a + chunk, : rank.shape[1]] = np.where(
                np.take_along_axis(ok, rank, 1), np.take_along_axis(i, rank, 1), -1
            )
        return out

    def _join(self, level: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        near = self.near[level]
        sims = np.where(ids >= 0, sims, -np.inf)
        near[nodes] = self._chosen(ids, sims, DEGREE if level else 2 * DEGREE)
        a, k = np.nonzero(near[nodes] >= 0)
        to, back = near[nodes][a, k], nodes[a]
        own = (self.nodes[to] * self.nodes[back]).sum(1)
        order = np.lexsort((-own, to))
        to, back, own = to[order], back[order], own[order]
        rank = np.arange(len(to)) - np.searchsorted(to, to)
        ok = rank < BUILD_BEAM
        to, back, own, rank = to[ok], back[ok], own[ok], rank[ok]
        touched, row = np.unique(to, return_inverse=True)
        more = np.full((len(touched), int(rank.max(initial=-1)) + 1), -1)
        more[row, rank] = back
        known = near[touched]
        more[(more[:, :, None] == known[:, None, :]).any(2)] = -1
        every = np.concatenate([known, more], 1)
        got = np.empty(every.shape)
        chunk = max(1, CELLS // (every.shape[1] * self.nodes.shape[1]))
        for a in range(0, len(every), chunk):
            part = every[a : a + chunk]
            got[a : a + chunk] = np.matmul(
                self.nodes[part], self.nodes[touched[a : a + chunk]][:, :, None]
            )[:, :, 0]
        got[every < 0] = -np.inf
        near[touched] = self._chosen(every, got, near.shape[1])


def _within(graph: Graph, q: np.ndarray, least: np.ndarray, width: int):
    """Pairs (query, node) found with at least the query's similarity; beams that are full of such
    nodes are widened."""
    rows, found = [], []
    left = np.arange(len(q))
    while len(left):
        ids, sims = graph.search(q[left], width)
        ok = (sims >= least[left][:, None]) & (ids >= 0)
        full = ok.all(1) & (ids.shape[1] < len(graph.nodes))
        i, k = np.nonzero(ok & ~full[:, None])
        rows.append(left[i])
        found.append(ids[i, k])
        left, width = left[full], 2 * width
    return np.concatenate(rows or [left]), np.concatenate(found or [left])


def near_balls(a: Graph, b: Graph, angle: float, width: int, audit: int, recall: float):
    """Pairs of balls (of ``a``, of ``b``) that may hold a link, and the width that sufficed.

    The nodes of each graph are looked up in the other. Some are also compared with all nodes; as
    long as too few of the pairs so found are among those from the graphs, beams are doubled. A beam
    as wide as the graph has seen all it can reach, so what is then missing is compared in full."""
    same = a is b
    widest = a.radius.max(initial=0.0), b.radius.max(initial=0.0)
    some = np.unique(np.linspace(0, len(a.lead) - 1, min(audit, len(a.lead))).astype(np.int64))
    reach = np.cos(np.minimum(np.pi, angle + a.radius[some][:, None] + b.radius[None, :] + 1e-6))
    exact = a.nodes[some] @ b.nodes.T >= reach
    if same:
        exact[np.arange(len(some)), some] = False
    i, k = np.nonzero(exact)
    true = set(zip(some[i].tolist(), k.tolist(), strict=True))
    while True:
        pairs: set[tuple[int, int]] = set()
        for one, other, most, turned in ((a, b, widest[1], False), (b, a, widest[0], True)):
            if turned and same:
                break
            least = np.cos(np.minimum(np.pi, angle + one.radius + most + 1e-6))
            i, k = _within(other, one.nodes, least, width)
            if turned:
                i, k = k, i
            pairs.update(zip(i.tolist(), k.tolist(), strict=True))
        if same:
            pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
            true = {(min(p), max(p)) for p in true}
        hit = len(true & pairs)
        if hit >= recall * len(true):
            return np.array(sorted(pairs | true), np.int64).reshape(-1, 2), width
        if width >= max(len(a.nodes), len(b.nodes)):
            return _all_pairs(a, b, angle), width
        width *= 2


def _all_pairs(a: Graph, b: Graph, angle: float) -> np.ndarray:
    out = []
    chunk = max(1, CELLS // max(1, len(b.nodes)))
    for at in range(0, len(a.nodes), chunk):
        reach = np.cos(np.minimum(np.pi, angle + a.radius[at : at + chunk, None] + b.radius + 1e-6))
        i, k = np.nonzero(a.nodes[at : at + chunk] @ b.nodes.T >= reach)
        out.append(np.stack([i + at, k], 1))
    found = np.concatenate(out or [np.zeros((0, 2), np.int64)])
    return found[found[:, 0] < found[:, 1]] if a is b else found


def links_between(a: Graph, b: Graph, pairs: np.ndarray, least: float, weights: tuple) -> tuple:
    """Links of each vector of ``a`` and of ``b`` over the pairs of balls, by weight, and which pairs
    hold a link. Balls that lie wholly within or wholly outside the angle are not taken apart."""
    angle = np.arccos(least)
    counts = np.zeros(len(a.vectors), np.int64), np.zeros(len(b.vectors), np.int64)
    members = [np.argsort(g.ball, kind="stable") for g in (a, b)]
    ends = [np.searchsorted(g.ball[m], np.arange(len(g.lead) + 1)) for g, m in zip((a, b), members)]
    whole = [np.bincount(g.ball, w, len(g.lead)).astype(np.int64) for g, w in zip((a, b), weights)]
    linked = np.zeros(len(pairs), bool)
    far = np.empty(0)
    if len(pairs):
        far = np.arccos(np.clip((a.nodes[pairs[:, 0]] * b.nodes[pairs[:, 1]]).sum(1), -1, 1))
    for n, (i, k) in enumerate(pairs.tolist()):
        rest = a.radius[i] + b.radius[k]
        if far[n] - rest > angle + 1e-6:
            continue
        x, y = members[0][ends[0][i] : ends[0][i + 1]], members[1][ends[1][k] : ends[1][k + 1]]
        if far[n] + rest <= angle - 1e-6:
            counts[0][x] += whole[1][k]
            counts[1][y] += whole[0][i]
            linked[n] = True
            continue
        for at in range(0, len(x), chunk := max(1, CELLS // len(y))):
            part = x[at : at + chunk]
            near = a.vectors[part] @ b.vectors[y].T >= least
            counts[0][part] += near @ weights[1][y]
            counts[1][y] += weights[0][part] @ near
            linked[n] |= bool(near.any())
    return counts, linked
