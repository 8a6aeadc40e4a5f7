"""Filter-aware proximity graph of one shard: build, insert, search.

A layered graph of nearest neighbours (HNSW) in numpy. Without payload edges and
diversification, shards of up to TOGETHER_NODES nodes are grown by all new rows
together: each row's neighbours are the nearest of the rows before it, by matrix
products, where otherwise it is a walk that looks for them, row by row. Layer 0
is wider by a second half, which with payload edges holds neighbours of the same
filter value. Rows that fail the filter are walked through but never returned.
A budget that reaches every node gives the exact answer: nodes that layer 0
doesn't reach from the entry are linked after each build or insert, and a search
starts from the entry too.
"""

from __future__ import annotations

import heapq
import math
from array import array

import numpy as np

from nearfield.operators.exact import PAIRS, distances, nearest_flat
from nearfield.plans.options import MAX_LEVEL, IndexOptions

COUNTERS = ("scans", "expansions", "cc_hits", "loads", "reranks", "emits")
TOGETHER_NODES = 65_536  # nodes of a shard up to which a build measures all pairs
TABLE_NODES = 1_024  # nodes of a shard up to which a build looks distances up
STEP_NODES = 8_192  # nodes of a shard up to which many queries walk in step
STEP_PAIRS = 1 << 17  # (query, node) pairs that walk at a time: they stay in a core's cache


class ShardGraph:
    def __init__(self, options: IndexOptions, dim: int, seed: int = 0):
        self.o, self.dim, self.rng = options, dim, np.random.default_rng(seed)
        self.vec = np.zeros((0, dim))
        self.ids: list[int] = []
        self.filter: list[int | None] = []
        self.level: list[int] = []
        self.deleted: list[bool] = []
        self.links: list[list[list[int]]] = []  # node -> layer -> neighbours, global half first
        self.extra: list[list[int]] = []  # node -> the second half of layer 0
        self.entry = -1
        self.members: dict[int, array] = {}  # part -> nodes, as long as the shard has them
        self.codes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.table: list[list[float]] | None = None  # while a small shard is built, all distances, each measured once
        self._n = 0

    # -- distances: squared for L2 (same order), unit vectors for cosine --------------------------------------------
    def prepare(self, v) -> np.ndarray:
        v = np.asarray(v, np.float64)
        if self.o.metric == "cosine":
            length = math.sqrt(float(v @ v))
            return v / length if length else v
        return v

    def near(self, q: np.ndarray, at, codes: bool = False) -> np.ndarray:
        x = self.vec[at] if not codes else self.codes[1][at][:, None] + self.codes[0][at][:, None] * self.codes[2][at]
        if self.o.metric in ("ip", "cosine"):
            return -(x @ q)
        if self.o.metric == "l1":
            return np.abs(x - q).sum(axis=1)
        d = x - q
        return np.einsum("ij,ij->i", d, d)

    def exact(self, q: np.ndarray, at) -> np.ndarray:
        """Distances as the metric defines them."""
        d = self.near(q, at)
        if self.o.metric == "l2":
            return np.sqrt(d)
        return 1 + d if self.o.metric == "cosine" else d

    # -- build ------------------------------------------------------------------------------------------------------
    def add(self, ids, filters, vectors, gated: set[int] | None = None) -> None:
        """Insert rows in order. gated: parts (value & 255) too small for payload edges."""
        first = self._n
        self.vec = np.concatenate([self.vec[: self._n], np.stack([self.prepare(v) for v in vectors]) if len(vectors) else np.zeros((0, self.dim))])
        if len(self.vec) <= TOGETHER_NODES and not self.o.payload_edges and not self.o.diversify:
            self._add_together(first, ids, filters)
            self.codes = None
            self.repair()
            return
        if len(self.vec) <= TABLE_NODES:
            self.table = [self.near(v, slice(None)).tolist() for v in self.vec]
        for i, (row, value) in enumerate(zip(ids, filters, strict=True)):
            self._insert(first + i, row, value, gated or set())
        self.codes = self.table = None
        self.repair()

    def _between(self, n: int, at: list[int]) -> list[float]:
        """Distances of a node from others."""
        if self.table is None:
            return self.near(self.vec[n], at).tolist()
        row = self.table[n]
        return [row[i] for i in at]

    def _draw(self) -> int:
        u = 1 - self.rng.random()
        return 0 if self.o.degree <= 1 else min(MAX_LEVEL, int(-math.log(u) / math.log(self.o.degree)))

    def _append(self, row: int, value: int | None, level: int) -> None:
        self.ids.append(int(row))
        self.filter.append(value)
        self.level.append(level)
        self.deleted.append(False)
        self.links.append([[] for _ in range(level + 1)])
        self.extra.append([])
        self._n += 1

    def _add_together(self, first: int, ids, filters) -> None:
        """Link all new rows at once. What `_insert` leaves of a node's links are
        the nearest of its own and of the later ones from other nodes, whatever
        the order they came in, so one sort gives them."""
        for n, (row, value) in enumerate(zip(ids, filters, strict=True), first):
            self._append(row, value, self._draw())
            if value is not None:
                self.members.setdefault(int(value) & 255, array("q")).append(n)
            if self.entry < 0 or self.level[n] > self.level[self.entry]:
                self.entry = n
        level = np.array(self.level, np.int64)
        for layer in range(int(level[first:].max(initial=0)), -1, -1):
            at = np.flatnonzero(level >= layer)
            new, near, d, place = self._before(at, int(np.searchsorted(at, first)))
            own = place < self.o.degree
            self._link([node[layer] if layer < len(node) else [] for node in self.links], new[own], near[own], d[own], self.o.degree, layer)
            if layer == 0:
                more = ~own & (place < self.o.degree + self.o.payload_degree)
                self._link(self.extra, new[more], near[more], d[more], self.o.payload_degree, None)

    def _before(self, at: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, near, distance, place): for each of at[first:], the
        ef_construction nearest of the nodes before it in at."""
        kind, wide = {"l2": "sql2", "cosine": "ip"}.get(self.o.metric, self.o.metric), self.o.ef_construction
        x = self.vec[at]
        if kind == "sql2" and first < len(at):
            x = x - x.mean(axis=0)  # the product form rounds less
        news, nears = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        i = first
        while i < len(at):
            to = min(len(at), i + max(64, min(1024, PAIRS // (i + 1))))
            d = distances(x[i:to], x[:to], kind)
            d[np.arange(to)[None, :] >= np.arange(i, to)[:, None]] = np.inf
            few = min(to, wide + 8)  # some more than needed, since it rounds
            places = np.argpartition(d, few - 1, axis=1)[:, :few] if few < to else np.broadcast_to(np.arange(to), d.shape)
            rows = np.repeat(np.arange(i, to), places.shape[1])
            before = places.ravel() < rows
            news.append(at[rows[before]])
            nears.append(at[places.ravel()[before]])
            i = to
        new, near = np.concatenate(news), np.concatenate(nears)
        d = self._apart(new, near)
        order = np.lexsort((near, d, new))
        new, near, d = new[order], near[order], d[order]
        place = np.arange(len(new)) - np.searchsorted(new, new)
        kept = place < wide
        return new[kept], near[kept], d[kept], place[kept]

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of pairs of nodes, as `near` has them."""
        out = np.empty(len(a))
        for at in range(0, len(a), 50_000):
            x, y = self.vec[a[at : at + 50_000]], self.vec[b[at : at + 50_000]]
            if self.o.metric in ("ip", "cosine"):
                out[at : at + 50_000] = -np.einsum("ij,ij->i", x, y)
            elif self.o.metric == "l1":
                out[at : at + 50_000] = np.abs(x - y).sum(axis=1)
            else:
                out[at : at + 50_000] = np.einsum("ij,ij->i", x - y, x - y)
        return out

    def _link(self, lists: list[list[int]], new: np.ndarray, near: np.ndarray, d: np.ndarray, width: int, layer: int | None) -> None:
        """Links from new to near and back; a node keeps its `width` nearest.
        lists: the links so far, of a layer, or (None) of the second half."""
        held = [(int(c), lists[c]) for c in np.unique(near) if lists[c]]
        had = np.repeat(np.array([c for c, _ in held], np.int64), [len(row) for _, row in held])
        to = np.array([i for _, row in held for i in row], np.int64)
        node, other, far = np.concatenate([new, near, had]), np.concatenate([near, new, to]), np.concatenate([d, d, self._apart(had, to)])
        order = np.lexsort((other, far, node))
        node, other = node[order], other[order]
        kept = np.arange(len(node)) - np.searchsorted(node, node) < width
        node, other = node[kept], other[kept]
        nodes, starts = np.unique(node, return_index=True)
        flat, ends = other.tolist(), [*starts[1:].tolist(), len(other)]
        for c, a, b in zip(nodes.tolist(), starts.tolist(), ends[: len(starts)], strict=True):
            if layer is None:
                self.extra[c] = flat[a:b]
            else:
                self.links[c][layer] = flat[a:b]

    def _insert(self, n: int, row: int, value: int | None, gated: set[int]) -> None:
        o, level = self.o, self._draw()
        self._append(row, value, level)
        q = self.vec[n]
        part = None if value is None else int(value) & 255
        payload = o.payload_edges and part is not None and part not in gated
        if self.entry >= 0:
            at = self.entry
            for layer in range(self.level[self.entry], level, -1):
                at = self._descend(q, at, layer)
            starts = [at]
            for layer in range(min(level, self.level[self.entry]), -1, -1):
                found = self._beam(n, starts, layer, o.ef_construction)
                starts = [i for _, i in found]
                chosen = self._select(n, found, o.degree)
                self.links[n][layer] = list(chosen)
                for c in chosen:
                    self._reverse(c, n, layer)
                if layer == 0:
                    taken = set(chosen)
                    rest = [(d, i) for d, i in found if i not in taken]
                    if payload:
                        rest = [(d, i) for d, i in self._same_part(q, part) if i not in taken] or rest
                    width = o.payload_degree
                    picked = self._select(n, rest, width)
                    if payload and len(picked) < width:  # fill up with what else is near
                        have = set(picked) | set(chosen)
                        picked += [i for _, i in found if i not in have][: width - len(picked)]
                    self.extra[n] = picked
                    for c in picked:
                        if not payload or self.filter[c] is not None and int(self.filter[c]) & 255 == part:
                            self._reverse_extra(c, n)
        if part is not None:
            self.members.setdefault(part, array("q")).append(n)
        if self.entry < 0 or level > self.level[self.entry]:
            self.entry = n

    def _same_part(self, q: np.ndarray, part: int) -> list[tuple[float, int]]:
        """The nearest members of a part, of all of them."""
        at = np.array(self.members.get(part, ()), np.int64)
        if not len(at):
            return []
        d, width = self.near(q, at), self.o.ef_construction
        few = np.argpartition(d, width - 1)[:width] if len(at) > width else np.arange(len(at))
        few = few[np.lexsort((few, d[few]))]
        return list(zip(d[few].tolist(), at[few].tolist(), strict=True))

    def _descend(self, q: np.ndarray, at: int, layer: int) -> int:
        best = float(self.near(q, [at])[0])
        while True:
            nbrs = self._layer(at, layer)
            if not len(nbrs):
                return at
            d = self.near(q, nbrs)
            i = int(np.argmin(d))
            if d[i] >= best:
                return at
            best, at = float(d[i]), int(nbrs[i])

    def _layer(self, n: int, layer: int) -> list[int]:
        return self.links[n][layer] if layer < len(self.links[n]) else []

    def _neighbours(self, n: int, layer: int) -> list[int]:
        near = self._layer(n, layer)
        return near + self.extra[n] if layer == 0 else near

    def _unseen(self, n: int, seen: np.ndarray) -> list[int]:
        return [i for i in self._neighbours(n, 0) if not seen[i]]

    def _beam(self, n: int, starts: list[int], layer: int, ef: int) -> list[tuple[float, int]]:
        seen = set(starts)
        heap = [(float(d), i) for d, i in zip(self._between(n, starts), starts, strict=True)]
        heapq.heapify(heap)
        best = [(-d, -i) for d, i in heap]
        heapq.heapify(best)
        while heap:
            d, at = heapq.heappop(heap)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [i for i in self._neighbours(at, layer) if i not in seen]
            if not new:
                continue
            seen.update(new)
            for dist, i in zip(self._between(n, new), new, strict=True):
                if len(best) < ef or dist < -best[0][0]:
                    heapq.heappush(heap, (dist, i))
                    heapq.heappush(best, (-dist, -i))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def _select(self, n: int, found: list[tuple[float, int]], width: int) -> list[int]:
        found = [(d, i) for d, i in found if i != n]
        if not self.o.diversify or len(found) <= width:
            return [i for _, i in found[:width]]
        kept: list[int] = []
        passed: list[int] = []
        for d, i in found:
            if len(kept) >= width:
                break
            if not kept or min(self._between(i, kept)) > d:
                kept.append(i)
            else:
                passed.append(i)
        return kept + passed[: width - len(kept)]

    def _reverse(self, n: int, new: int, layer: int) -> None:
        row = self.links[n][layer]
        if new in row or layer == 0 and new in self.extra[n]:
            return
        row.append(new)
        if len(row) > self.o.degree:
            self.links[n][layer] = self._select(n, sorted(zip(self._between(n, row), row, strict=True)), self.o.degree)

    def _reverse_extra(self, n: int, new: int) -> None:
        row = self.extra[n]
        if new in row or new in self.links[n][0]:
            return
        row.append(new)
        if len(row) > self.o.payload_degree:
            part = None if self.filter[n] is None else int(self.filter[n]) & 255
            other = [i for i in row if self.o.payload_edges and (self.filter[i] is None or int(self.filter[i]) & 255 != part)]
            if other:  # one that isn't of the same value goes first
                row.remove(other[-1])
            else:
                self.extra[n] = self._select(n, sorted(zip(self._between(n, row), row, strict=True)), self.o.payload_degree)

    def repair(self) -> int:
        """Link each node that layer 0 doesn't reach from its nearest reached one."""
        if self.entry < 0:
            return 0
        reached = np.zeros(self._n, bool)

        def walk(start: int) -> None:
            stack = [start]
            reached[start] = True
            while stack:
                for i in self._neighbours(stack.pop(), 0):
                    if not reached[i]:
                        reached[i] = True
                        stack.append(i)

        walk(self.entry)
        linked = 0
        while not reached.all():
            n = int(np.flatnonzero(~reached)[0])
            at = np.flatnonzero(reached)
            self.extra[int(at[np.argmin(self.near(self.vec[n], at))])].append(n)
            linked += 1
            walk(n)
        return linked

    def unreached(self) -> int:
        seen, stack = {self.entry}, [self.entry]
        while stack and self.entry >= 0:
            for i in self._neighbours(stack.pop(), 0):
                if i not in seen:
                    seen.add(i)
                    stack.append(i)
        return self._n - len(seen) if self.entry >= 0 else 0

    def encode(self) -> None:
        lo, hi = self.vec.min(axis=1).astype(np.float64), self.vec.max(axis=1).astype(np.float64)
        scale = (hi - lo) / 255
        codes = np.floor((self.vec - lo[:, None]) / np.where(scale > 0, scale, 1)[:, None] + 0.5)
        self.codes = (scale, lo, np.where(scale[:, None] > 0, codes, 0))

    # -- search -----------------------------------------------------------------------------------------------------
    def search(self, q, passes: np.ndarray, ef: int, k: int | None, member_first: bool = False, buffered: bool = True, codes: bool = False) -> tuple[list[tuple[float, int]], dict[str, int]]:
        """Up to ef expansions from the entry; the nearest k discovered nodes
        that pass and aren't deleted, by distance, then id. codes: discover by
        8-bit codes, then measure exactly."""
        count = dict.fromkeys(COUNTERS, 0) | {"scans": 1}
        if self.entry < 0:
            return [], count
        q = self.prepare(q)
        if codes and self.codes is None:
            self.encode()
        at = self.entry
        for layer in range(self.level[self.entry], 0, -1):
            at = self._descend(q, at, layer)
        starts = list(dict.fromkeys([at, self.entry]))
        live = passes & ~np.array(self.deleted, bool)
        seen = np.zeros(self._n, bool)
        seen[starts] = True
        heap: list[tuple[float, int]] = []
        members: list[tuple[float, int]] = []
        found: list[int] = []
        emitted: list[tuple[float, int]] = []
        waiting: list[tuple[float, int, int]] = []

        def discover(new: list[int]) -> None:
            count["loads"] += 0 if codes else len(new)
            count["cc_hits"] += len(new) if codes else 0
            for d, i in zip(self.near(q, new, codes).tolist(), new, strict=True):
                heapq.heappush(members if member_first and live[i] else heap, (d, i))
                if live[i]:
                    found.append(i)
                    if not buffered:
                        heapq.heappush(waiting, (d, self.ids[i], i))

        discover(starts)
        while (heap or members) and count["expansions"] < ef:
            if not buffered and k is not None:
                nearest = min(h[0][0] for h in (heap, members) if h)
                while waiting and waiting[0][0] <= nearest and len(emitted) < k:
                    d, _, i = heapq.heappop(waiting)
                    emitted.append((d, i))
                if len(emitted) >= k:
                    break
            _, n = heapq.heappop(members if members else heap)
            count["expansions"] += 1
            new = self._unseen(n, seen)
            if new:
                seen[new] = True
                discover(new)
        if not buffered:
            while waiting and (k is None or len(emitted) < k):
                d, _, i = heapq.heappop(waiting)
                emitted.append((d, i))
            found = [i for _, i in emitted]
        if not found:
            return [], count
        exact = self.exact(q, found)
        count["reranks"] = len(found) if codes else 0
        rows = [(float(d), self.ids[i]) for d, i in zip(exact, found, strict=True)]
        rows = rows if not buffered else sorted(rows)
        rows = rows if k is None else rows[:k]
        count["emits"] = len(rows)
        return rows, count


class PackedGraph(ShardGraph):
    """A shard's graph as it is stored, for searches: vectors, links and codes
    are arrays over the stored bytes, without a copy."""

    def __init__(self, options: IndexOptions, row: dict):
        self.o, self._n, self.entry = options, row["n"], row["entry"]
        n = self._n
        self.ids, self.deleted = row["row_id"], row["deleted"]
        self.vec = np.frombuffer(row["vec"], np.float32 if len(row["vec"]) == 4 * n * row["dim"] else np.float64).reshape(n, row["dim"])
        self.dim = row["dim"]
        self.level = np.frombuffer(row["level"], np.int8)
        self._first = np.cumsum(self.level.astype(np.int64) + 1) - self.level - 1  # of a node's layers
        self._links, self._at = _lists(row["links"], int(self._first[-1] + self.level[-1] + 1) if n else 0)
        self._extra, self._extra_at = _lists(row["extra"], n)
        self.codes = None
        if row["codes"]:
            ends = np.frombuffer(row["codes"], np.float64, 2 * n)
            self.codes = (ends[:n], ends[n:], np.frombuffer(row["codes"], np.uint8, n * self.dim, 16 * n).reshape(n, self.dim))

    def _layer(self, n: int, layer: int) -> np.ndarray:
        if layer > self.level[n]:
            return self._links[:0]
        i = self._first[n] + layer
        return self._links[self._at[i] : self._at[i + 1]]

    def _neighbours(self, n: int, layer: int) -> np.ndarray:
        near = self._layer(n, layer)
        return np.concatenate([near, self._extra[self._extra_at[n] : self._extra_at[n + 1]]]) if layer == 0 else near

    def _unseen(self, n: int, seen: np.ndarray) -> list[int]:
        near = self._neighbours(n, 0)
        return list(dict.fromkeys(near[~seen[near]].tolist()))

    def search_many(self, queries: np.ndarray, *args, **options) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[str, int]]:
        """`search` for each row of queries: (nodes, distances) of each, and the
        counters' sums."""
        row, node, far, count = self.search_flat(queries, *args, **options)
        ends = np.searchsorted(row, np.arange(1, len(queries)))
        return list(zip(np.split(node, ends), np.split(far, ends), strict=True)) if len(queries) else [], count

    def search_flat(self, queries: np.ndarray, passes: np.ndarray, ef: int, k: int | None, member_first: bool = False, buffered: bool = True, codes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
        """`search` for each row of queries: (row, node, distance) of all that
        were found, in the order of rows, and the counters' sums. A budget that no walk can exhaust finds all that the links
        reach, from wherever it starts: one walk serves every query. In small
        shards queries walk in step; elsewhere one after the other."""
        if self.entry >= 0 and buffered and len(queries):
            queries = np.stack([self.prepare(q) for q in queries])
            if ef >= self._n and self._reached(self.entry).all():
                return self._rank(queries, passes, None, np.full(len(queries), self._n), k, codes)
            if self._n <= STEP_NODES and not member_first:
                parts, total, step = [], dict.fromkeys(COUNTERS, 0), max(1, STEP_PAIRS // self._n)
                tables = [self._table(layer) for layer in range(self.level[self.entry] + 1)]
                linked = np.zeros((self._n, self._n), bool)
                linked[np.arange(self._n)[:, None], tables[0]] = True
                bits = _packed(linked), _packed(linked.T)
                for at in range(0, len(queries), step):
                    row, node, far, count = self._in_step(queries[at : at + step], passes, ef, k, codes, tables, bits)
                    parts.append((row + at, node, far))
                    total = {c: total[c] + count[c] for c in COUNTERS}
                return *map(np.concatenate, zip(*parts, strict=True)), total
        sizes, nodes, far, total = [], [], [], dict.fromkeys(COUNTERS, 0)
        place = {int(i): n for n, i in enumerate(self.ids)}
        for q in queries:
            found, count = self.search(q, passes, ef, k, member_first, buffered, codes)
            sizes.append(len(found))
            nodes += [place[i] for _, i in found]
            far += [d for d, _ in found]
            total = {c: total[c] + count[c] for c in COUNTERS}
        return np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64)), np.array(nodes, np.int64), np.array(far, np.float64), total

    def _reached(self, start: int) -> np.ndarray:
        """Which nodes layer 0 reaches."""
        seen = np.zeros(self._n, bool)
        front = np.array([start])
        while len(front):
            seen[front] = True
            near = np.concatenate([_picked(self._links, self._at, self._first[front]), _picked(self._extra, self._extra_at, front)])
            front = np.unique(near[~seen[near]])
        return seen

    def _table(self, layer: int) -> np.ndarray:
        """Neighbours of all nodes, filled up with the node itself."""
        lists = [self._neighbours(i, layer) for i in range(self._n)]
        out = np.repeat(np.arange(self._n)[:, None], max(1, max(map(len, lists))), axis=1)
        for i, near in enumerate(lists):
            out[i, : len(near)] = near
        return out

    def _in_step(self, q: np.ndarray, passes: np.ndarray, ef: int, k: int | None, codes: bool, tables: list[np.ndarray], bits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
        """Queries expand many nodes in a step, the same ones as one after the
        other. Of the nodes not expanded, let the near ones be the nearest, as
        many as the budget still allows. While one of them waits, no other is
        expanded, so all that wait are within the budget and go in one step. If
        none waits, the nearest other node goes. Queries that have found every
        node are done. Sets of nodes are bits of words; bits: what each node
        links, and what links it."""
        kind, n = {"l2": "sql2", "cosine": "ip"}.get(self.o.metric, self.o.metric), self._n
        d, rows = distances(q, self.vec.astype(np.float64), kind), np.arange(len(q))
        at = np.full(len(q), self.entry)
        for table in tables[:0:-1]:
            while True:
                near = table[at]
                far = np.take_along_axis(d, near, axis=1)
                best = far.argmin(axis=1)
                better = far[rows, best] < d[rows, at]
                if not better.any():
                    break
                at = np.where(better, near[rows, best], at)
        if codes:
            if self.codes is None:
                self.encode()
            d = distances(q, self.codes[1][:, None] + self.codes[0][:, None] * self.codes[2], kind)
        budget = min(ef, n)
        near, order = _packed(_lowest(d, budget)), None
        seen = np.zeros(near.shape, np.uint64)
        for start in (at, np.full(len(q), self.entry)):
            seen[rows, start >> 6] |= np.uint64(1) << (start & 63).astype(np.uint64)
        spread = np.zeros_like(seen)
        found, spent, live = np.empty_like(seen), np.full(len(q), budget), rows
        while len(live):
            new = seen & near & ~spread
            none = np.flatnonzero(~new.any(axis=1))
            if len(none):
                order = _order(d).astype(np.int16) if order is None else order
                waits = np.take_along_axis(_flags(seen[none] & ~spread[none], n), own := order[live[none]], axis=1)
                first = waits.argmax(axis=1)
                some = waits[np.arange(len(none)), first]  # else the links reach no more
                spent[live[none[~some]]] = _sizes(spread[none[~some]])
                none, own, first = none[some], own[some], first[some]
                node = own[np.arange(len(none)), first].astype(np.int64)
                new[none, node >> 6] |= np.uint64(1) << (node & 63).astype(np.uint64)
                # The budget allows one less of the near nodes: the farthest goes.
                last = n - 1 - np.take_along_axis(_flags(near[none] & ~spread[none], n), own, axis=1)[:, ::-1].argmax(axis=1)
                node = own[np.arange(len(none)), last].astype(np.int64)
                near[none, node >> 6] &= ~(np.uint64(1) << (node & 63).astype(np.uint64))
            spread |= new
            known, fresh = _sizes(seen), _sizes(new)
            if fresh.sum() <= (n - known).sum():  # what these nodes link, or which other nodes they link: whichever are fewer
                row, node = np.divmod(np.flatnonzero(_flags(new, n)), n)
                if len(row):
                    starts = np.flatnonzero(np.diff(row, prepend=-1))
                    seen[row[starts]] |= np.bitwise_or.reduceat(bits[0].take(node, axis=0), starts, axis=0)
            else:
                row, node = np.divmod(np.flatnonzero(_flags(~seen, n)), n)
                hit = np.bitwise_or.reduce(new.take(row, axis=0) & bits[1].take(node, axis=0), axis=1) > 0
                more = np.zeros((len(live), n), bool)
                more[row[hit], node[hit]] = True
                seen |= _packed(more)
            ends = (_sizes(spread) == budget) | (fresh == 0) | (_sizes(seen) == n)
            if ends.any():
                found[live[ends]] = seen[ends]
                live, near, seen, spread = (a[~ends] for a in (live, near, seen, spread))
        return self._rank(q, passes, _flags(found, n), spent, k, codes)

    def _rank(self, q: np.ndarray, passes: np.ndarray, found: np.ndarray | None, expansions: np.ndarray, k: int | None, codes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
        """The k nearest that pass and were found (None: all were), measured exactly."""
        at = np.flatnonzero(passes & ~np.asarray(self.deleted, bool))
        among = None if found is None else found[:, at]
        row, places, far = nearest_flat(q, self.vec[at].astype(np.float64), np.asarray(self.ids)[at], len(at) if k is None else k, self.o.metric, among)
        seen = self._n * len(q) if found is None else int(found.sum())
        passed = len(at) * len(q) if among is None else int(among.sum())
        count = dict(zip(COUNTERS, (len(q), int(expansions.sum()), seen if codes else 0, 0 if codes else seen, passed if codes else 0, len(row)), strict=True))
        return row, at[places], far, count

    def open(self, seed: int, filters: list[int | None]) -> ShardGraph:
        """The same graph in lists, to be grown."""
        g = ShardGraph(self.o, self.dim, seed)
        g.vec, g._n, g.entry = self.vec.astype(np.float64), self._n, self.entry
        g.ids, g.level, g.deleted, g.filter = [int(i) for i in self.ids], self.level.tolist(), [bool(x) for x in self.deleted], filters
        g.links = [[self._layer(i, layer).tolist() for layer in range(g.level[i] + 1)] for i in range(g._n)]
        g.extra = [self._extra[self._extra_at[i] : self._extra_at[i + 1]].tolist() for i in range(g._n)]
        for i, f in enumerate(filters):
            if f is not None:
                g.members.setdefault(f & 255, array("q")).append(i)
        return g


def _packed(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as bits of 64-bit words."""
    out = np.zeros((len(flags), -(-flags.shape[1] // 64) * 8), np.uint8)
    out[:, : -(-flags.shape[1] // 8)] = np.packbits(flags, axis=1, bitorder="little")
    return out.view("<u8")


def _flags(words: np.ndarray, n: int) -> np.ndarray:
    """The first n bits of each row of words."""
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8), axis=1, count=n, bitorder="little").view(bool)


def _sizes(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def _lowest(d: np.ndarray, k: int) -> np.ndarray:
    """Which are each row's first k places by distance, then place."""
    if k >= d.shape[1]:
        return np.ones(d.shape, bool)
    bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]  # NaN comes last
    out = d <= bound
    for i in np.flatnonzero(out.sum(axis=1) != k):  # ties, or NaN
        out[i] = False
        out[i, np.argsort(d[i], kind="stable")[:k]] = True
    return out


def _order(d: np.ndarray) -> np.ndarray:
    """Each row's places by distance, then place."""
    order = np.argsort(d, axis=1)
    far = np.take_along_axis(d, order, axis=1)
    equal = ~(far[:, 1:] > far[:, :-1]).all(axis=1)
    order[equal] = np.argsort(d[equal], axis=1, kind="stable")  # the quicker sort leaves ties in any order
    return order


def _bytes(lists: list[list[int]]) -> bytes:
    """Lists of node numbers: all lengths, then all numbers."""
    return np.fromiter((x for part in ([len(a) for a in lists], *lists) for x in part), np.int32).tobytes()


def _lists(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(data, np.int32)
    return whole[n:], np.concatenate([[0], np.cumsum(whole[:n], dtype=np.int64)])


def _picked(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbers of these lists, one after the other."""
    size = at[rows + 1] - at[rows]
    return flat[np.repeat(at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]


def packed_codes(g: ShardGraph) -> bytes:
    """Scales, lower ends and codes of all nodes."""
    g.encode()
    return g.codes[0].astype(np.float64).tobytes() + g.codes[1].astype(np.float64).tobytes() + g.codes[2].astype(np.uint8).tobytes()


def pack(g: ShardGraph) -> dict:
    """A graph as one row of arrays and bytes."""
    small = g.vec[: g._n].astype(np.float32)
    vec = small if (small == g.vec[: g._n]).all() else g.vec[: g._n]
    codes = packed_codes(g) if g.o.inline_codes and g._n else b""
    known = [f for f in g.filter if f is not None]
    return {
        "n": g._n, "dim": g.dim, "entry": g.entry, "lo": min(known, default=None), "hi": max(known, default=None), "row_id": list(g.ids), "filter_val": list(g.filter), "deleted": list(g.deleted),
        "vec": np.ascontiguousarray(vec).tobytes(), "level": np.array(g.level, np.int8).tobytes(), "links": _bytes([layer for node in g.links for layer in node]), "extra": _bytes(g.extra), "codes": codes,
    }
