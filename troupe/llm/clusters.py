"""Grouping set-valued records into clusters of mutually similar records, with mergeable cluster-feature trees.

1. Every partition feeds its distinct sets into cluster-feature trees. A leaf entry is a ball: its members share
   at least 1 - r/2 of their union with its medoid, so that any two of them share at least 1 - r (set distance is a
   metric). An entry keeps its weight, linear sum, square sum and radius, and only these leave the partition. A tree
   that is full leaves it too, and another begins, so that a task's memory doesn't grow with its rows.
2. The leaf summaries are reduced: they are brought together by a min-hash of their medoids and fed into further
   trees, which add up the features of entries whose balls fit into one; each round has another hash.
3. Ward agglomeration of the leaves: entries meet under one of the rarer terms of their medoids (two sets that share
   half of their union have one of those in common), and are merged by Ward's criterion as long as the medoids remain
   mutually similar.
4. One full pass assigns every record to the cluster of the medoid most similar to it; sizes and the members nearest
   to the centroid describe a cluster.
5. An exact check, by blocks, finds the pairs of a cluster that aren't similar, and its members are divided by these
   conflicts alone, those with fewest first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troupe.llm.graphs import connected_components
from troupe.llm.sets import Sets, blocked, classes, grouped, likely, likely_within, pairs_within, similar, term_sets
from troupe.runtime import materialize, width

#: Places of a set's vector, children of a node, entries of a tree, rounds of reducing, rows of a block, typical members.
DIM, FANOUT, ENTRIES, ROUNDS, BLOCK, TYPICAL = 64, 24, 20_000, 2, 2048, 3
#: Entries of a group whose similar pairs are held (beyond, the pairs in conflict are), and conflicts of a cluster that are solved in one task
#: (beyond, connected conflicts are). Results depend on neither. Entries of a token that meet in one group.
SMALL, PAIRS, SALT = 256, 200_000, 4096


def _vectors(sets: Sets) -> np.ndarray:
    """Unit vectors of the sets: each token adds a sign at each of DIM places, from a hash of the token."""
    raw = sets.flat.view(np.uint64)
    with np.errstate(over="ignore"):
        bits = (raw * np.uint64(0x9E3779B97F4A7C15)) ^ (raw >> np.uint64(32))
        bits = (bits ^ (bits >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bits ^= bits >> np.uint64(32)
    signs = ((bits[:, None] >> np.arange(DIM, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1
    sums = np.add.reduceat(signs, sets.starts, axis=0) if len(raw) else np.zeros((0, DIM), np.float32)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


class Tree:
    """A cluster-feature tree. A node is the list of its children's linear sums; leaf children are entries."""

    class Node:
        __slots__ = ("sums", "children", "leaf")

        def __init__(self, leaf: bool):
            self.sums = np.zeros((FANOUT + 1, DIM), np.float32)
            self.children: list = []
            self.leaf = leaf

    def __init__(self, radius: float):
        self.radius, self.root = radius, Tree.Node(True)
        # of every entry: medoid set, key of the medoid, weight, linear sum, square sum, radius
        self.sets: list[frozenset] = []
        self.keys: list[int] = []
        self.weights: list[int] = []
        self.linear: list[np.ndarray] = []
        self.square: list[float] = []
        self.radii: list[float] = []

    def add(self, key: int, members: frozenset, weight: int, linear: np.ndarray, square: float, radius: float = 0.0) -> int:
        """The entry that takes a record, or the features of another tree's entry, in."""
        direction = linear / max(float(np.sqrt(linear @ linear)), 1e-9)
        path, node = [], self.root
        while True:
            at = int(np.argmax(self._near(node, direction))) if node.children else -1
            path.append((node, at))
            if node.leaf:
                break
            node = node.children[at]
        entry = node.children[at] if at >= 0 else -1
        reach = self._distance(entry, members) + radius if entry >= 0 else np.inf
        if reach > self.radius + 1e-9:
            entry, reach = len(self.keys), radius
            self.sets.append(members)
            self.keys.append(key)
            self.weights.append(0)
            self.linear.append(np.zeros(DIM, np.float32))
            self.square.append(0.0)
            self.radii.append(0.0)
            path[-1] = (node, len(node.children))
            node.children.append(entry)
        self.weights[entry] += weight
        self.linear[entry] += linear
        self.square[entry] += square
        self.radii[entry] = max(self.radii[entry], reach)
        for node, at in path:
            node.sums[at] += linear
        self._split([n for n, _ in path])
        return entry

    def _near(self, node: Tree.Node, vector: np.ndarray) -> np.ndarray:
        sums = node.sums[: len(node.children)]
        return sums @ vector / np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-9)

    def _distance(self, entry: int, members: frozenset) -> float:
        medoid = self.sets[entry]
        shared = len(medoid & members)
        return 1 - shared / (len(medoid) + len(members) - shared)

    def _split(self, path: list[Tree.Node]) -> None:
        for depth in range(len(path) - 1, -1, -1):
            node = path[depth]
            n = len(node.children)
            if n <= FANOUT:
                return
            unit = node.sums[:n] / np.maximum(np.linalg.norm(node.sums[:n], axis=1, keepdims=True), 1e-9)
            alike = unit @ unit.T
            a, b = divmod(int(np.argmin(alike)), n)
            to_b = alike[b] > alike[a]
            to_b[[a, b]] = False, True
            parts = []
            for chosen in (np.flatnonzero(~to_b), np.flatnonzero(to_b)):
                part = Tree.Node(node.leaf)
                part.children = [node.children[k] for k in chosen]
                part.sums[: len(chosen)] = node.sums[chosen]
                parts.append(part)
            if depth == 0:
                self.root = Tree.Node(False)
                self.root.children = parts
                for k in (0, 1):
                    self.root.sums[k] = parts[k].sums[: len(parts[k].children)].sum(axis=0)
                return
            up = path[depth - 1]
            at = up.children.index(node)
            up.children[at] = parts[0]
            up.sums[at] = parts[0].sums[: len(parts[0].children)].sum(axis=0)
            up.children.append(parts[1])
            up.sums[len(up.children) - 1] = parts[1].sums[: len(parts[1].children)].sum(axis=0)


_ENTRY = "key bigint, weight bigint, linear array<float>, square double, radius double, tokens array<bigint>"


def _grow(radius: float):
    """Records (key, weight, tokens), or entries with the rest of their features, to the entries of the trees that take them in."""

    def entries(tree: Tree) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(tree.keys), 8192):
            part = slice(at, at + 8192)
            linear = np.stack(tree.linear[part])
            columns = [
                pa.array(tree.keys[part], pa.int64()), pa.array(tree.weights[part], pa.int64()), pa.ListArray.from_arrays(np.arange(len(linear) + 1, dtype=np.int32) * DIM, linear.ravel()),
                pa.array(tree.square[part], pa.float64()), pa.array(tree.radii[part], pa.float64()), pa.array([sorted(x) for x in tree.sets[part]], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "weight", "linear", "square", "radius", "tokens"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(radius)
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = Sets(batch.column("tokens"))
            keys, weights = batch.column("key").to_pylist(), batch.column("weight").to_pylist()
            if "linear" in batch.schema.names:
                linear = batch.column("linear").flatten().to_numpy().reshape(-1, DIM)
                square, radii = batch.column("square").to_pylist(), batch.column("radius").to_pylist()
            else:
                linear, square, radii = _vectors(sets) * np.array(weights, np.float32)[:, None], weights, [0.0] * len(keys)
            for i, key in enumerate(keys):
                tree.add(key, sets.members(i), weights[i], linear[i], square[i], radii[i])
                if len(tree.keys) >= ENTRIES:
                    yield from entries(tree)
                    tree = Tree(radius)
        yield from entries(tree)

    return kernel


def ward(edges: set[tuple[int, int]], n: int, weights: np.ndarray, centroids: np.ndarray) -> list[list[int]]:
    """Ward agglomeration of n entries: of the clusters that are linked throughout by `edges`, the two whose union adds
    least to the sum of squares are merged, until none are left."""
    linked: dict[int, set[int]] = {i: set() for i in range(n)}
    for i, j in edges:
        linked[i].add(j)
        linked[j].add(i)
    weight, centre, members = dict(enumerate(weights.astype(float))), dict(enumerate(centroids)), {i: [i] for i in range(n)}

    def cost(i: int, j: int) -> float:
        return weight[i] * weight[j] / (weight[i] + weight[j]) * float(((centre[i] - centre[j]) ** 2).sum())

    heap = [(cost(i, j), i, j) for i, j in edges]
    heapq.heapify(heap)
    new = n
    while heap:
        _, i, j = heapq.heappop(heap)
        if i not in members or j not in members:
            continue
        members[new] = members.pop(i) + members.pop(j)
        weight[new] = weight[i] + weight[j]
        centre[new] = (weight[i] * centre[i] + weight[j] * centre[j]) / weight[new]
        linked[new] = (linked[i] & linked[j]) - {i, j}
        for k in (linked[i] | linked[j]) - {i, j}:
            linked[k] -= {i, j}
            if k in linked[new]:
                linked[k].add(new)
                heapq.heappush(heap, (cost(k, new), k, new))
        new += 1
    return list(members.values())


def _components(i: np.ndarray, j: np.ndarray) -> dict[int, list[int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found: dict[int, list[int]] = {}
    for x in list(parent):
        found.setdefault(root(x), []).append(x)
    return found


def ward_dense(free: np.ndarray, weights: np.ndarray, centroids: np.ndarray) -> list[list[int]]:
    """What ward() finds, in the same order of merges, from the packed bits of `free`, row by row 1 for a pair that may merge (and for the
    diagonal). It holds these and of every cluster its cheapest older partner, and no list of pairs."""
    n = len(free)
    free, centre, weight = free.copy(), centroids.astype(float), weights.astype(float)
    # a cluster has the place of its first part; its number says how late it was made
    number, alive, members, place = np.arange(n), np.ones(n, bool), {i: [i] for i in range(n)}, {i: i for i in range(n)}
    heap: list[tuple[float, int, int]] = []

    def offer(own: int) -> None:
        at = place[own]
        others = np.flatnonzero(np.unpackbits(free[at], count=n).view(bool) & alive & (number < own))
        if len(others):
            costs = weight[at] * weight[others] / (weight[at] + weight[others]) * ((centre[others] - centre[at]) ** 2).sum(axis=1)
            cost = costs.min()
            heapq.heappush(heap, (float(cost), int(number[others[costs == cost]].min()), own))

    def column(at: int) -> np.ndarray:
        return (free[:, at >> 3] >> np.uint8(7 - (at & 7))) & np.uint8(1)

    for i in range(n):
        offer(i)
    new = n
    while heap:
        _, i, j = heapq.heappop(heap)
        if j not in members:
            continue
        if i not in members:
            offer(j)
            continue
        a, b = place.pop(i), place.pop(j)
        members[new] = members.pop(i) + members.pop(j)
        centre[a] = (weight[a] * centre[a] + weight[b] * centre[b]) / (weight[a] + weight[b])
        weight[a] += weight[b]
        both = column(a) & column(b)
        free[a] &= free[b]
        bit = np.uint8(1 << (7 - (a & 7)))
        free[:, a >> 3] = np.where(both.view(bool), free[:, a >> 3] | bit, free[:, a >> 3] & ~bit)
        alive[b], number[a], place[new] = False, new, a
        offer(new)
        new += 1
    return list(members.values())


def _large_group(table: pa.Table, sets: Sets, maps: np.ndarray, at: int, end: int, threshold: float) -> list[list[int]]:
    """What _small_groups() finds in one group, from its pairs that aren't similar."""
    n = end - at
    free = np.full((n, (n + 7) // 8), 255, np.uint8)
    for i, j in _uncertain(sets, at, end, threshold):
        good = similar(sets, maps, i, j, threshold)
        bad = np.setdiff1d(i * end + j, good[0] * end + good[1], assume_unique=True)
        i, j = bad // end - at, bad % end - at
        for a, b in ((i, j), (j, i)):
            np.bitwise_and.at(free, (a, b >> 3), ~(np.uint8(128) >> (b & 7).astype(np.uint8)))
    merged, unseen = [], np.ones(n, bool)
    for first in range(n):
        if not unseen[first]:
            continue
        unseen[first], found, sizes = False, [first], []
        for x in found:  # grows as it is read
            row = np.unpackbits(free[x], count=n).view(bool)
            sizes.append(int(row.sum()))
            new = np.flatnonzero(row & unseen)
            unseen[new] = False
            found += new.tolist()
        xs = np.sort(np.array(found))
        if min(sizes) == len(found):  # all merges are allowed
            merged.append((xs + at).tolist())
            continue
        part = table.take(pa.array(xs + at))
        weights = part.column("weight").to_numpy()
        centroids = np.array(part.column("linear").to_pylist()) / weights[:, None]
        own = np.stack([np.packbits(np.unpackbits(free[x], count=n)[xs]) for x in xs])
        merged += [(xs[m] + at).tolist() for m in ward_dense(own, weights, centroids)]
    return merged


def _agglomerate(threshold: float, salted: bool):
    """Entries (group, hot, token, entry, weight, linear, tokens) sorted by group to (token, hot, entry, label): what each merged
    cluster is called, its smallest entry. Entries that merge with none are kept where the group is one of several of its token."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in grouped(batches):
            sets = Sets(table.column("tokens"))
            maps, entries = sets.bitmaps(), table.column("entry").to_numpy()
            hot = table.column("hot").to_numpy(zero_copy_only=False)
            merged: list[list[int]] = []
            sizes = np.diff(bounds)
            for k in np.flatnonzero(sizes > SMALL).tolist():
                merged += _large_group(table, sets, maps, int(bounds[k]), int(bounds[k + 1]), threshold)
            small = np.flatnonzero(sizes <= SMALL)
            merged += _small_groups(table, sets, maps, np.stack([bounds[small], bounds[small + 1]], axis=1), threshold)
            alone = np.ones(len(entries), bool)
            rows, labels = [], []
            for group in merged:
                if len(group) > 1:
                    alone[group] = False
                    rows += group
                    labels += [int(entries[group].min())] * len(group)
            if salted:
                kept = np.flatnonzero(alone & hot).tolist()
                rows += kept
                labels += entries[kept].tolist()
            part = table.select(["token", "hot", "entry"]).take(pa.array(rows, pa.int64()))
            for batch in part.append_column("label", pa.array(labels, pa.int64())).combine_chunks().to_batches():
                yield batch

    return kernel


def _small_groups(table: pa.Table, sets: Sets, maps: np.ndarray, spans: np.ndarray, threshold: float) -> list[list[int]]:
    """Clusters of more than one entry in groups that are compared pair by pair."""
    found_i, found_j = [], []
    for i, j in likely_within(sets, spans, threshold):
        i, j, _ = similar(sets, maps, i, j, threshold)
        found_i.append(i)
        found_j.append(j)
    if not found_i:
        return []
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    where = _components(i, j)
    number = {x: c for c, xs in where.items() for x in xs}
    edges: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(i.tolist(), j.tolist()):
        edges.setdefault(number[a], []).append((a, b))
    merged: list[list[int]] = []
    for c, xs in where.items():
        if len(edges[c]) == len(xs) * (len(xs) - 1) // 2:
            merged.append(xs)  # all merges are allowed, so they end in one cluster in whatever order
            continue
        xs = sorted(xs)
        at_ = {x: k for k, x in enumerate(xs)}
        part = table.take(pa.array(xs))
        weights = part.column("weight").to_numpy()
        centroids = np.array(part.column("linear").to_pylist()) / weights[:, None]
        merged += [[xs[k] for k in m] for m in ward({(at_[a], at_[b]) for a, b in edges[c]}, len(xs), weights, centroids)]
    return merged


def _uncertain(sets: Sets, at: int, end: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group that its frequent tokens alone don't show to be similar, in portions."""
    n = end - at
    if n < 64:
        yield from pairs_within(np.array([at, end]))
        return
    lo, hi = sets.starts[at], sets.starts[end - 1] + sets.sizes[end - 1]
    token, place, count = np.unique(sets.flat[lo:hi], return_inverse=True, return_counts=True)
    core = np.flatnonzero(count >= max(2, n // 20))
    column = np.full(len(token), -1)
    column[core] = np.arange(len(core))
    row = np.repeat(np.arange(n), sets.sizes[at:end])
    kept = column[place] >= 0
    held = np.zeros((n, max(1, len(core))), np.float32)
    held[row[kept], column[place][kept]] = 1
    size = sets.sizes[at:end].astype(np.float32)
    share = np.float32(threshold / (1 + threshold))
    for top in range(0, n, 512):
        shared = held[top : top + 512] @ held[top:].T
        short = shared < share * (size[top : top + 512, None] + size[None, top:]) - 1e-4
        i, j = np.nonzero(np.triu(short, 1))
        yield i + top + at, j + top + at


def _assign(threshold: float):
    """Rows (group, home, key, cluster, tokens) sorted by group to (key, cluster, share): for each record the medoid of its group most similar
    to it, if any is similar; ties by the smaller cluster."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in grouped(batches):
            sets = Sets(table.column("tokens"))
            maps, keys, cluster = sets.bitmaps(), table.column("key").to_numpy(), table.column("cluster").to_numpy()
            home = table.column("home").to_numpy(zero_copy_only=False)
            held = sets.buckets()
            left, right = [np.empty(0, int)], [np.empty(0, int)]
            for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                for i, j in likely(sets, held, at + np.flatnonzero(~home[at:end]), at + np.flatnonzero(home[at:end]), threshold):
                    left.append(i)
                    right.append(j)
            left, right = np.concatenate(left), np.concatenate(right)
            for top in range(0, len(left), 1_000_000):
                i, j, share = similar(sets, maps, left[top : top + 1_000_000], right[top : top + 1_000_000], threshold)
                order = np.lexsort((cluster[j], -share, keys[i]))
                i, j, share = i[order], j[order], share[order]
                first = np.flatnonzero(np.concatenate([[True], keys[i][1:] != keys[i][:-1]])) if len(i) else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i[first]]), pa.array(cluster[j[first]]), pa.array(share[first])], ["key", "cluster", "share"])

    return kernel


def _conflicts(threshold: float):
    """Rows (cell, cluster, key, copies, tokens) sorted by cell to the pairs (cluster, a, copies_a, b, copies_b) that aren't similar."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in grouped(batches):
            sets = Sets(table.column("tokens"))
            maps = sets.bitmaps()
            cluster, keys, copies = (table.column(c).to_numpy() for c in ("cluster", "key", "copies"))
            for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                for i, j in _uncertain(sets, at, end, threshold):
                    differ = keys[i] != keys[j]
                    i, j = i[differ], j[differ]
                    good = similar(sets, maps, i, j, threshold)
                    bad = np.setdiff1d(i * np.int64(len(keys)) + j, good[0] * np.int64(len(keys)) + good[1], assume_unique=True)
                    i, j = bad // len(keys), bad % len(keys)
                    low = keys[i] < keys[j]
                    i, j = np.where(low, i, j), np.where(low, j, i)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cluster[i], keys[i], copies[i], keys[j], copies[j])], ["cluster", "a", "copies_a", "b", "copies_b"])

    return kernel


def levels_of(conflicts: dict[int, set[int]], copies: dict[int, int]) -> dict[int, int]:
    """The group, counted from 0, of every record that is in conflict with another: again and again a group takes in the record that fewest
    of those left are in conflict with (by their copies, ties by key), which bars these from the group."""
    left, found, level = set(conflicts), {}, 0
    while left:
        allowed = set(left)
        against = {x: sum(copies[y] for y in conflicts[x] & allowed) for x in allowed}
        heap = [(n, x) for x, n in against.items()]
        heapq.heapify(heap)
        while heap:
            n, x = heapq.heappop(heap)
            if x not in allowed or against[x] != n:
                continue
            allowed.remove(x)
            left.remove(x)
            found[x] = level
            for barred in conflicts[x] & allowed:
                allowed.remove(barred)
                for y in conflicts[barred] & allowed:
                    against[y] -= copies[barred]
                    heapq.heappush(heap, (against[y], y))
        level += 1
    return found


def _divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conflicts (unit, a, copies_a, b, copies_b) sorted by unit to (key, level)."""
    for table, bounds in grouped(batches):
        a, wa, b, wb = (table.column(c).to_pylist() for c in ("a", "copies_a", "b", "copies_b"))
        found: dict[int, int] = {}
        for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            conflicts: dict[int, set[int]] = {}
            copies: dict[int, int] = {}
            for x, n, y, m in zip(a[at:end], wa[at:end], b[at:end], wb[at:end]):
                conflicts.setdefault(x, set()).add(y)
                conflicts.setdefault(y, set()).add(x)
                copies[x], copies[y] = n, m
            found |= levels_of(conflicts, copies)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int32())], ["key", "level"])


def _levels(conflicts: DataFrame, parts: int) -> DataFrame:
    """(key, level) of every record in conflict. Records whose conflicts aren't connected don't decide about one another, so that a cluster of
    many conflicts is divided by its connected conflicts, in as many tasks."""
    sizes = conflicts.groupBy("cluster").agg((F.count("*") > PAIRS).alias("many"))
    known = conflicts.join(sizes, "cluster")
    units = known.where("not many").select(F.col("cluster").alias("unit"), "a", "copies_a", "b", "copies_b")
    if not sizes.where("many").isEmpty():
        wide = known.where("many")
        joined = connected_components(wide.select("a", "b")).select(F.col("node").alias("a"), F.col("component").alias("unit"))
        units = units.unionByName(wide.join(joined, "a").select("unit", "a", "copies_a", "b", "copies_b"))
    return units.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_divide, "key bigint, level int")


def similarity_clusters(df: DataFrame, identifier: str, terms: str, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """(cluster_id, id, size, closeness, typical): the records of every cluster of at least `least` records of which any
    two share at least `threshold` of the union of their terms. cluster_id is the smallest id in the cluster, size its
    number of records, closeness the cosine to the cluster's centroid in a fixed projection of the sets, and typical the
    rank of the record by closeness (ties by id) where it is among the first three, else null.

    Clusters don't overlap. Where similarity isn't transitive, records with fewest conflicts go first and ties fall to the
    smaller key of the set. Records without terms, with null arrays or null ids are in no cluster; a repeated id counts once; exact
    copies are one point of several records; an empty table gives an empty result."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets = materialize(term_sets(df, identifier, terms), "cluster-sets")
    parts = width(sets)
    # a set with its rarer terms, of which two similar sets have one in common
    distinct = classes(sets).select("key", "copies", "tokens")
    each = distinct.select("key", F.explode("tokens").alias("token"))
    ranked = each.join(each.groupBy("token").count(), "token").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("found"))
    radius = (1 - threshold) / 2
    some = lambda share: F.filter(F.slice("found", F.lit(1), F.size("found") - F.ceil(F.lit(share) * F.size("found") - 1e-9).cast("int") + 1), lambda x: x["count"] > 1)
    points = materialize(distinct.join(ranked.select("key", some(threshold).alias("rare"), some(1 - radius).alias("rarest")), "key"), "cluster-points")

    # 1. trees, and 2. their reduction
    grown = points.select("key", F.col("copies").alias("weight"), "tokens").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_grow(radius), _ENTRY)
    for k in range(ROUNDS):
        grown = materialize(grown, f"cluster-leaves-{k}")
        grown = grown.repartition(parts, F.array_min(F.transform("tokens", lambda x, k=k: F.xxhash64(x, F.lit(k))))).sortWithinPartitions("key").mapInArrow(_grow(radius), _ENTRY)
    entries = materialize(grown.select(F.col("key").alias("entry"), "weight", "linear", "tokens"), "cluster-entries")

    # 3. entries meet under the rarer terms of their medoids
    salts = F.ceil(F.col("x.count") / F.lit(SALT)).cast("int")
    terms_of = entries.select("entry").join(points.select(F.col("key").alias("entry"), F.explode("rare").alias("x")), "entry")
    meeting = terms_of.select("entry", F.col("x.token").alias("token"), (salts > 1).alias("hot"), F.pmod(F.xxhash64("entry"), salts).alias("salt"))
    kind = "token bigint, hot boolean, entry bigint, label bigint"

    def together(rows: DataFrame, group: Column, salted: bool) -> DataFrame:
        wide = rows.join(entries, "entry").select(group.alias("group"), "hot", "token", "entry", "weight", "linear", "tokens")
        return wide.repartition(parts, "group").sortWithinPartitions("group", "entry").mapInArrow(_agglomerate(threshold, salted), kind)

    # a token of many entries meets in several groups first, whose clusters then meet by one member of each
    first = materialize(together(meeting, F.xxhash64("token", "salt"), True), "cluster-first")
    heads = first.where("hot and entry = label").select("entry", "token", "hot")
    second = together(heads, F.col("token"), False).select("token", F.col("entry").alias("label"), F.col("label").alias("to"))
    met = first.join(second, ["token", "label"], "left").select("entry", F.coalesce("to", "label").alias("label"))
    labels = met.groupBy("entry").agg(F.min("label").alias("label"))
    medoids = entries.select("entry", "tokens").join(labels, "entry", "left").select(F.col("entry").alias("key"), F.coalesce("label", "entry").alias("cluster"), "tokens")

    # 4. every distinct set to the cluster of the medoid most similar to it; a medoid is the most similar one to itself, and any other set is within
    # the radius of one, so that it shares one of its rarest terms with the most similar
    every = F.explode(F.sequence(F.lit(0), salts - 1))
    homes = medoids.join(points.select("key", F.explode("rarest").alias("x")), "key").select(F.lit(True).alias("home"), "key", "cluster", "tokens", F.col("x.token").alias("token"), every.alias("salt"))
    rest = points.join(entries.select(F.col("entry").alias("key")), "key", "left_anti").select("key", "tokens", F.explode("rarest").alias("x"))
    homes = homes.join(rest.select(F.col("x.token").alias("token")).distinct(), "token", "left_semi")
    asking = rest.select(F.lit(False).alias("home"), "key", F.lit(0).cast("bigint").alias("cluster"), "tokens", F.col("x.token").alias("token"), F.pmod(F.xxhash64("key", F.lit(3)), salts).cast("int").alias("salt"))
    meet = homes.select(*asking.columns).unionByName(asking).select(F.xxhash64("token", "salt").alias("group"), "home", "key", "cluster", "tokens")
    near = meet.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_assign(1 - radius), "key bigint, cluster bigint, share double")
    placed = near.groupBy("key").agg(F.max_by("cluster", F.struct("share", -F.col("cluster"))).alias("cluster")).unionByName(medoids.select("key", "cluster"))
    sized = points.select("key", "copies", "tokens").join(placed, "key")
    counts = sized.groupBy("cluster").agg(F.sum("copies").alias("size"), F.count("*").alias("distinct"))
    member = materialize(sized.join(counts.where(F.col("size") >= least), "cluster"), "cluster-members")

    # 5. exact check
    cells = blocked(member.where("distinct > 1"), "cluster", "distinct", BLOCK).select("cell", "cluster", "key", "copies", "tokens")
    pair = "cluster bigint, a bigint, copies_a bigint, b bigint, copies_b bigint"
    conflicts = materialize(cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_conflicts(threshold), pair).distinct(), "cluster-conflicts")
    apart = _levels(conflicts, parts)
    again = member.join(apart, "key", "left").select(F.xxhash64("cluster", F.coalesce("level", F.lit(0))).alias("cluster"), "key", "tokens")
    settled = materialize(again, "cluster-settled").join(sets.select("id", "key"), "key")

    # description of every cluster
    vectors = settled.mapInArrow(_placed_vectors, "cluster bigint, id bigint, vector array<float>")
    sums = [F.sum(F.col("vector")[k].cast("double")).alias(f"s{k}") for k in range(DIM)]
    about = vectors.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size"), *sums).where(F.col("size") >= least)
    about = about.select("cluster", "cluster_id", "size", F.array(*[f"s{k}" for k in range(DIM)]).alias("sum"))
    near = F.aggregate(F.zip_with("vector", "sum", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("sum", F.lit(0.0), lambda s, x: s + x * x))
    scored = vectors.join(about, "cluster").select("cluster_id", "id", "size", F.round(near / F.greatest(norm, F.lit(1e-12)), 9).alias("closeness"))
    return _with_typical(scored)


def _placed_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vectors = _vectors(Sets(batch.column("tokens")))
            flat = pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * DIM, vectors.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("id"), flat], ["cluster", "id", "vector"])


def _with_typical(scored: DataFrame) -> DataFrame:
    """The members nearest to the centroid, found by a bounded aggregate that is combined before it is moved, so that
    no cluster is sorted as a whole."""
    from troupe.llm.top_n import top_n_per_group

    top = top_n_per_group(scored, ["cluster_id"], "closeness", "id", TYPICAL).select("cluster_id", "id", F.col("rank").alias("typical"))
    return scored.join(top, ["cluster_id", "id"], "left").select("cluster_id", "id", "size", "closeness", "typical")
