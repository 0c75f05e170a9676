"""Hierarchical navigable small-world graphs over unit vectors, searched for many queries in step.

All searches of a batch advance together: each step expands every query's best unexpanded candidate, and the distances
of all their neighbours are one matrix operation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from skylattice.llm.storage import mixed

DEGREE = 16
CONSTRUCTION = 48
BATCH = 256


@dataclass
class Graph:
    """``levels[l]``: neighbours (rows padded with -1) of each vector of level ``l``; ``entry``: where searches begin."""

    vectors: np.ndarray
    levels: list[np.ndarray]
    entry: int

    @staticmethod
    def build(vectors: np.ndarray, seed: int = 1) -> Graph:
        """Inserts the vectors in their order, batch by batch; a batch also sees its own members."""
        n = len(vectors)
        uniform = (mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed << 40)) >> np.uint64(11)) / float(1 << 53)
        top = np.minimum(np.floor(-np.log(np.maximum(uniform, 1e-12)) / np.log(DEGREE)).astype(int), 6)
        if n:
            top[0] = top.max()
        graph = Graph(vectors, [np.full((n, 2 * DEGREE if level == 0 else DEGREE), -1, dtype=np.int32) for level in range(int(top.max()) + 1 if n else 1)], 0)
        start = 0
        while start < n:
            end = min(n, start + max(32, min(BATCH, start)))
            graph._insert(np.arange(start, end), start, top)
            start = end
        return graph

    def _insert(self, new: np.ndarray, before: int, top: np.ndarray) -> None:
        entry = np.zeros(len(new), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            here = top[new] >= level
            ids = new[here]
            found = np.full((len(new), CONSTRUCTION), -1, dtype=np.int64)
            if before:
                found, _ = self.search(self.vectors[new], level, CONSTRUCTION, entry)
                entry = np.maximum(found[:, 0], 0)
            if not len(ids):
                continue
            near = self.vectors[ids] @ self.vectors[ids].T
            np.fill_diagonal(near, -2)
            k = min(DEGREE, len(ids) - 1)
            own = ids[np.argpartition(-near, k - 1, axis=1)[:, :k]] if k > 0 else np.zeros((len(ids), 0), dtype=np.int64)
            reverse: dict[int, list[int]] = {}
            for u, candidates in zip(ids, np.concatenate([found[here], own], axis=1)):
                chosen = self._choose(u, candidates[candidates >= 0], DEGREE)
                self.levels[level][u, : len(chosen)] = chosen
                for v in chosen:
                    reverse.setdefault(int(v), []).append(int(u))
            links = self.levels[level]
            for v, sources in reverse.items():
                held = links[v][links[v] >= 0]
                joined = np.unique(np.concatenate([held, np.array(sources, dtype=held.dtype)]))
                if len(joined) > links.shape[1]:
                    joined = self._choose(v, joined, links.shape[1])
                links[v] = -1
                links[v, : len(joined)] = joined

    def _choose(self, u: int, candidates: np.ndarray, limit: int) -> np.ndarray:
        """Neighbours that are nearer to ``u`` than to a neighbour chosen before; the nearest of the rest fill up."""
        candidates = candidates[candidates != u]
        if len(candidates) <= limit // 2:
            return candidates
        X = self.vectors[candidates]
        to_u = X @ self.vectors[u]
        order = np.argsort(-to_u, kind="stable")
        between, blocked = X @ X.T, np.full(len(candidates), -2.0)
        chosen: list[int] = []
        for k in order:
            if blocked[k] < to_u[k]:
                chosen.append(k)
                np.maximum(blocked, between[k], out=blocked)
                if len(chosen) == limit:
                    break
        if len(chosen) < limit:
            chosen += [k for k in order if k not in set(chosen)][: limit - len(chosen)]
        return candidates[chosen]

    def search(self, queries: np.ndarray, level: int, beam: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best vectors found for each query on a level, best first (-1: none), with their similarities."""
        n, links, nq = len(self.vectors), self.levels[level], len(queries)
        ids, sims = np.full((nq, beam), -1, dtype=np.int64), np.full((nq, beam), -np.inf, dtype=np.float32)
        open_ = np.zeros((nq, beam), dtype=bool)
        seen = np.zeros((nq, n), dtype=bool)
        every = np.arange(nq)
        ids[:, 0], open_[:, 0] = entry, True
        sims[:, 0] = np.einsum("qd,qd->q", queries, self.vectors[entry])
        seen[every, entry] = True
        live = every
        while len(live):
            worth = np.where(open_[live], sims[live], -np.inf)
            k = worth.argmax(axis=1)
            more = worth[np.arange(len(live)), k] > -np.inf
            live, k = live[more], k[more]
            if not len(live):
                break
            open_[live, k] = False
            near = links[ids[live, k]].astype(np.int64)
            fresh = near >= 0
            near[~fresh] = 0
            fresh &= ~seen[live[:, None], near]
            at = np.nonzero(fresh)
            seen[live[at[0]], near[at]] = True
            found = np.full(near.shape, -np.inf, dtype=np.float32)
            found[at] = np.einsum("nd,nd->n", self.vectors[near[at]], queries[live[at[0]]])
            all_ids, all_sims = np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], found], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1) & (sims[live] > -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids[sims == -np.inf] = -1
        return ids, sims

    def query(self, queries: np.ndarray, beam: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``beam`` results on the lowest level. A query that is a vector of the graph (``own``: its number, else -1)
        begins at its own place, another one is led down from the top level."""
        entry = np.where(own >= 0, own, self.entry)
        led = np.flatnonzero(own < 0)
        for level in range(len(self.levels) - 1, 0, -1):
            if len(led):
                found, _ = self.search(queries[led], level, 4, entry[led])
                entry[led] = np.maximum(found[:, 0], 0)
        return self.search(queries, 0, min(beam, len(self.vectors)), entry)
