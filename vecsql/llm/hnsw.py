"""A hierarchical navigable small-world graph in numpy, built and searched in batches.

Levels thin out by a hash of the number; a level of up to ``EXHAUSTIVE`` vectors is the top and is
compared as a whole, which gives the entry points below. On each level a beam of the best vectors
seen is kept for every query of a batch, its best members not looked at yet are expanded together,
and the search of a query ends when all of its beam has been. Vectors are unit vectors in float32.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np

from .words import mix

LINKS = 12
#: Of them, outgoing ones of the insertion are kept for good; others share as many places again.
BEAM_BUILD = 40
EXPAND = 4
THIN = 8
EXHAUSTIVE = 1024
BATCH = 256


def select(base: np.ndarray, ids: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """For each row up to ``most`` of the ids (-1: none), best first, that are closer to it than to those selected
    before; free places go to the best of the others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    near = vectors[np.maximum(ids, 0)]
    among = near @ near.transpose(0, 2, 1)
    n, width = ids.shape
    closest = np.full((n, width), -2.0, np.float32)  # of each to those selected so far
    taken = np.zeros((n, width), bool)
    count = np.zeros(n, int)
    for j in range(width):
        ok = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (count < most)
        taken[:, j] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, among[:, j]), closest)
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, first, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


@dataclass
class Graph:
    vectors: np.ndarray
    links: list[np.ndarray] = field(default_factory=list)  # by level from 0: (n, 2 * LINKS), numbers of vectors or -1
    top: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def dumps(self, whole: bool = True) -> bytes:
        """whole: with the vectors; without them ``loads`` needs them."""
        return pickle.dumps((self.vectors if whole else None, [(np.flatnonzero((x >= 0).any(1)).astype(np.int32), x[(x >= 0).any(1)]) for x in self.links], self.top), 5)

    @classmethod
    def loads(cls, data: bytes, vectors: np.ndarray | None = None) -> Graph:
        own, links, top = pickle.loads(data)
        vectors = own if vectors is None else vectors
        out = []
        for own, x in links:
            full = np.full((len(vectors), 2 * LINKS), -1, np.int32)
            full[own] = x
            out.append(full)
        return cls(vectors, out, top)

    def search(self, queries: np.ndarray, beam: int, level: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), each (queries, beam), of the best found from the entry points (-1: none), best first."""
        n, links = len(queries), self.links[level]
        seen = np.zeros((n, len(self.vectors)), bool)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2.0, np.float32)
        open_ = np.zeros((n, beam), bool)
        active, fresh = np.arange(n), entry
        while True:
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[seen[active[:, None], np.maximum(fresh, 0)]] = -1
            r, c = np.nonzero(fresh >= 0)
            seen[active[r], fresh[r, c]] = True
            found = np.full(fresh.shape, -2.0, np.float32)
            found[r, c] = np.einsum("ij,ij->i", self.vectors[fresh[r, c]], queries[active[r]])
            all_ids = np.concatenate([ids[active], fresh], 1)
            all_sims = np.concatenate([sims[active], found], 1)
            all_open = np.concatenate([open_[active], fresh >= 0], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[active], sims[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
            left = np.take_along_axis(all_open, best, 1)
            active, left = active[left.any(1)], left[left.any(1)]
            if not len(active):
                return ids, sims
            pick = np.argsort(~left, axis=1, kind="stable")[:, :EXPAND]
            real = np.take_along_axis(left, pick, 1)
            left[np.arange(len(active))[:, None], pick] = False
            open_[active] = left
            at = np.take_along_axis(ids[active], pick, 1)
            fresh = np.where(real[:, :, None], links[np.maximum(at, 0)], -1).reshape(len(active), -1).astype(np.int64)

    def entries(self, queries: np.ndarray, beam: int, known: int | None = None, few: int = 8) -> np.ndarray:
        """Entry points of level 0, of vectors with numbers below ``known`` only."""
        top = self.top if known is None else self.top[self.top < known]
        if not len(top):
            return np.zeros((len(queries), 1), np.int64)
        sims = queries @ self.vectors[top].T
        at = top[np.argsort(-sims, axis=1, kind="stable")[:, :few]]
        for level in range(len(self.links) - 1, 0, -1):
            at = self.search(queries, max(few, beam // 2), level, at)[0][:, :few]
        return at

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return self.search(queries, beam, 0, self.entries(queries, beam))

    def _insert(self, level: int, new: np.ndarray, entry: np.ndarray) -> None:
        """Numbers ``new`` into a level whose other members have entry points for each."""
        links, own = self.links[level], self.vectors[new]
        ids, sims = self.search(own, BEAM_BUILD, level, entry)
        if len(new) > 1:
            each = own @ own.T
            np.fill_diagonal(each, -2)
            k = min(2 * LINKS, len(new) - 1)
            close = np.argpartition(-each, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, new[close]], 1)
            sims = np.concatenate([sims, np.take_along_axis(each, close, 1)], 1)
        chosen = select(own, ids, sims, self.vectors, LINKS)
        links[new, :LINKS] = chosen
        r, c = np.nonzero(chosen >= 0)
        to, back = chosen[r, c], new[r]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 128):
            some, k = nodes[a : a + 128], count[a : a + 128]
            more = np.full((len(some), k.max()), -1, np.int64)
            place = np.arange(k.max()) < k[:, None]
            more[place] = back[first[a] : first[a] + k.sum()]
            every = np.concatenate([links[some, LINKS:], more], 1).astype(np.int64)
            near = np.einsum("ijk,ik->ij", self.vectors[np.maximum(every, 0)], self.vectors[some])
            near[every < 0] = -2
            if every.shape[1] > 6 * LINKS:  # the closest of very many
                keep = np.argpartition(-near, 6 * LINKS - 1, axis=1)[:, : 6 * LINKS]
                every, near = np.take_along_axis(every, keep, 1), np.take_along_axis(near, keep, 1)
            links[some, LINKS:] = select(self.vectors[some], every, near, self.vectors, LINKS)


def build(vectors: np.ndarray) -> Graph:
    """Of unit vectors, in float32."""
    n = len(vectors)
    levels = [np.arange(n)]
    while len(levels[-1]) > EXHAUSTIVE:
        draw = mix(levels[-1].astype(np.uint64) + np.uint64(len(levels) << 40))
        levels.append(levels[-1][draw % np.uint64(THIN) == 0])
    graph = Graph(np.ascontiguousarray(vectors, np.float32), [np.full((n, 2 * LINKS), -1, np.int32) for _ in levels[: max(1, len(levels) - 1)]], levels[-1])
    if len(levels) == 1:
        graph.top = levels[0][:: max(1, n // 256)]
    at = 0
    while at < n:
        new = np.arange(at, min(n, at + max(16, min(BATCH, at // 2))))
        own = graph.vectors[new]
        top = graph.top[graph.top < at]
        if len(top):
            entry = top[np.argsort(-(own @ graph.vectors[top].T), axis=1, kind="stable")[:, :8]]
        else:
            entry = np.zeros((len(new), 1), np.int64) - (at == 0)
        for level in range(len(graph.links) - 1, -1, -1):
            member = np.isin(new, levels[level]) if level else np.ones(len(new), bool)
            if member.any():
                graph._insert(level, new[member], entry[member])
            if level:
                entry = graph.search(own, 16, level, entry)[0][:, :8]
                entry[np.isin(entry, new)] = -1
        at = int(new[-1]) + 1
    return graph
