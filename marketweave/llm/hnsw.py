"""Hierarchical navigable small-world graphs over unit vectors in numpy, searched for many queries at a time.

Nodes are numbered from the top layer down, so that layer l holds the first of them. Vectors within a small angle of a
node become members of its ball instead of nodes: a crowd of near copies is a few nodes, whose links stay useful.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .common import mix

#: Links of a node in the base layer and above, and the beam while building.
WIDTH, UPPER, BUILD_BEAM = 32, 16, 48
#: A layer holds one in FAN nodes of the layer below.
FAN = 16
#: Nodes that a query of a beam search expands in one step, and vectors that are inserted together.
EXPAND, BATCH = 4, 1024
#: Marks of visited nodes that are held at a time, in bytes.
MARKS = 8_000_000


class Graph(NamedTuple):
    """vectors: of nodes, float32; layers: links of each layer's nodes, base first, -1 where there is none."""

    vectors: np.ndarray
    layers: list[np.ndarray]

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of the beam's nodes of each query, best first; -1 and -inf where it has fewer."""
        ids, sims, step = [], [], max(16, MARKS // max(len(self.vectors), 1))
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            found = beam_search(self.vectors, self.layers[0], some, descend(self.vectors, self.layers[1:], some), beam)
            ids.append(found[0])
            sims.append(found[1])
        return (np.concatenate(ids), np.concatenate(sims)) if ids else (np.zeros((0, beam), np.int32), np.zeros((0, beam), np.float32))


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """All queries step together: each expands its best open nodes, until none of its beam is open."""
    n, every = len(links), np.arange(len(queries))
    ids, sims = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -np.inf, np.float32)
    is_open, seen = np.zeros(ids.shape, bool), np.zeros((len(queries), n), bool)
    ids[:, 0], sims[:, 0] = entry, np.einsum("kd,kd->k", vectors[entry], queries)
    is_open[:, 0] = seen[every, entry] = True
    live = every
    while len(live):
        at = np.argsort(~is_open[live], axis=1, kind="stable")[:, :EXPAND]
        rows = live[:, None]
        parents = np.where(is_open[rows, at], ids[rows, at], -1)
        is_open[rows, at] = False
        near = np.where(parents[..., None] >= 0, links[parents], -1).reshape(len(live), -1)
        of, node = np.nonzero(near >= 0)[0], near[near >= 0]
        new = ~seen[live[of], node]
        of, node = np.divmod(np.unique(of[new] * n + node[new]), n)
        seen[live[of], node] = True
        sim = np.einsum("kd,kd->k", vectors[node], queries[live[of]])
        better = sim > sims[live[of], -1]
        of, node, sim = of[better], node[better], sim[better]
        if len(of):
            count = np.bincount(of, minlength=len(live))
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            more_ids, more_sims = np.full((len(live), count.max()), -1, np.int32), np.full((len(live), count.max()), -np.inf, np.float32)
            more_ids[of, place], more_sims[of, place] = node, sim
            both = np.concatenate([sims[live], more_sims], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(both, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], more_ids], axis=1), best, 1)
            is_open[live] = np.take_along_axis(np.concatenate([is_open[live], more_ids >= 0], axis=1), best, 1)
        live = live[is_open[live].any(axis=1)]
    return ids, sims


def descend(vectors: np.ndarray, upper: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The node of the lowest upper layer that a narrow search from the top ends at."""
    entry = np.zeros(len(queries), np.int64)
    for links in reversed(upper):
        entry = beam_search(vectors, links, queries, entry, 4)[0][:, 0].astype(np.int64)
    return entry


def _chosen(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first) up to `most`: first those nearer to the row's vector than to any chosen one, then the best of the rest."""
    among = vectors[ids] @ vectors[ids].transpose(0, 2, 1)
    nearest, keep = np.full(ids.shape, -np.inf, np.float32), np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        keep[:, j] = (nearest[:, j] < sims[:, j]) & (ids[:, j] >= 0) & (keep.sum(axis=1) < most)
        nearest = np.where(keep[:, j, None], np.maximum(nearest, among[:, j]), nearest)
    order = np.argsort(~keep * 2 + (ids < 0), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)


def _sorted(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _link_back(vectors: np.ndarray, links: np.ndarray, begin: int, end: int) -> None:
    """Adds each new node to the links of those that it links to; full lists are chosen anew."""
    width = links.shape[1]
    source, target = np.repeat(np.arange(begin, end), width), links[begin:end].ravel()
    source, target = source[target >= 0], target[target >= 0]
    fresh = ~(links[target] == source[:, None]).any(axis=1)
    source, target = source[fresh], target[fresh]
    sim = np.einsum("kd,kd->k", vectors[source], vectors[target])
    order = np.lexsort((source, -sim, target))
    source, target, sim = source[order], target[order], sim[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(source)) - np.repeat(first, count)
    some = place < width  # the best; the others would not be chosen
    more = np.full((len(nodes), min(count.max(initial=0), width)), -1, np.int64)
    more[np.searchsorted(nodes, target[some]), place[some]] = source[some]
    for at in range(0, len(nodes), BATCH):
        own = nodes[at : at + BATCH]
        ids = np.concatenate([links[own], more[at : at + BATCH]], axis=1)
        near = np.where(ids >= 0, np.einsum("qcd,qd->qc", vectors[ids], vectors[own]), -np.inf).astype(np.float32)
        ids, near = _sorted(ids, near, ids.shape[1])
        full = (ids >= 0).sum(axis=1) > width
        links[own[~full]] = ids[~full, :width]
        if full.any():
            links[own[full]] = _chosen(vectors, ids[full], near[full], width)


def levels(keys: np.ndarray) -> np.ndarray:
    """Layers above the base that a vector is in, by its key (unsigned 64 bits)."""
    share = (mix(keys) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum(-np.log1p(-share) / np.log(FAN), 12).astype(np.int64)


def build(unit: np.ndarray, level: np.ndarray, tight: float) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph, the vectors that are its nodes, and each vector's node: itself, or one at a similarity of at least tight."""
    order = np.argsort(-level, kind="stable")
    vectors, nodes, holder, size = np.zeros_like(unit), np.zeros(len(unit), np.int64), np.full(len(unit), -1, np.int64), 0
    layers: list[np.ndarray] = []  # top first
    for lv in range(int(level.max(initial=0)), -1, -1):
        fresh, above = order[level[order] == lv], size
        links = np.full((above + len(fresh), WIDTH if lv == 0 else UPPER), -1, np.int64)
        half, begin = links.shape[1] // 2, 0
        while begin < above or len(fresh):
            step = min(max(begin, 32), BATCH)
            if begin < above:  # nodes of the layers above
                batch, entry = vectors[begin : min(begin + step, above)], np.zeros(min(step, above - begin), np.int64)
            else:
                taken, fresh = fresh[:step], fresh[step:]
                batch = unit[taken]
                entry = descend(vectors, layers[::-1], batch)
            if begin:
                parts = max(16, MARKS // begin)
                found = [beam_search(vectors, links[:begin], batch[i : i + parts], entry[i : i + parts], BUILD_BEAM) for i in range(0, len(batch), parts)]
                ids, sims = (np.concatenate(x) for x in zip(*found, strict=True))
            else:
                ids, sims = np.full((len(batch), 1), -1, np.int32), np.full((len(batch), 1), -np.inf, np.float32)
            among = batch @ batch.T
            np.fill_diagonal(among, -np.inf)
            if begin >= above:
                # near a node: a member of its ball; near an earlier one of the batch: of that one's
                own = np.arange(len(batch))
                own[sims[:, 0] >= tight] = -1
                for i in np.flatnonzero((among >= tight).any(axis=1)):
                    if own[i] == i:
                        own[np.flatnonzero((among[i] >= tight) & (own == np.arange(len(batch))) & (np.arange(len(batch)) > i))] = i
                stays = own == np.arange(len(batch))
                number = size + np.cumsum(stays) - 1
                holder[taken] = np.where(own < 0, ids[:, 0], number[np.maximum(own, 0)])
                batch, ids, sims, among = batch[stays], ids[stays], sims[stays], among[stays][:, stays]
                nodes[size : size + len(batch)] = taken[stays]
                vectors[size : size + len(batch)] = batch
                size += len(batch)
            if not len(batch):
                continue
            best = np.argsort(-among, axis=1, kind="stable")[:, :half]
            ids = np.concatenate([ids, np.where(np.take_along_axis(among, best, 1) > -np.inf, best + begin, -1)], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(among, best, 1)], axis=1)
            ids, sims = _sorted(ids, sims, BUILD_BEAM)
            kept = _chosen(vectors, ids, sims, half)
            links[begin : begin + len(batch), : kept.shape[1]] = kept
            _link_back(vectors, links, begin, begin + len(batch))
            begin += len(batch)
        layers.append(links[:begin])
    return Graph(vectors[:size], layers[::-1]), nodes[:size], holder
