"""Most similar vectors for every vector, from randomly rotated one-bit codes.

A vector is coded relative to a centre: the signs of its rotated residual, packed into words, with the residual's
norm and the inner product between the residual and its code. From these and the other vector's residual in four-bit
steps, bit counts estimate the inner product without bias, and the code's quality bounds the error. Only pairs whose
estimate plus bound reaches the k-th best estimate less its bound (and what is asked for at least) are computed from
the vectors themselves.

Every vector lives in one cell: that of its nearest centre, divided by the leading signs of its code, as many as the
centre's number of vectors asks for, so that cells stay small however many vectors there are. A vector looks for
neighbours in its own cell and visits others in order of how far their borders are. How many it visits isn't a
constant: the true neighbours of a sample of vectors are found among all vectors first, and the number is the smallest
with which the stated share of them would have been met.

Vectors are moved once to find equal ones, and then written once with the numbers of their cells. The cells are gone
through in rounds, each of which copies no more than about ROUND rows for every vector and keeps only neighbours, so
that the disk needed is a small multiple of the vectors however many cells they visit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troupe.llm.sets import grouped
from troupe.llm.top_n import top_n_per_group
from troupe.runtime import TASK_BYTES, discard, materialize, shuffles_removed, spread, width

#: Bits of a code, bits of a query's steps, and the confidence of the error bound in standard deviations.
BITS, STEPS, SIGMAS = 128, 4, 3.0
#: Vectors per cell, most centres (beyond, cells are divided by signs), sampled vectors per centre to fit them.
PER_CELL, CENTRES, SAMPLE = 100, 4096, 16
#: Vectors whose true neighbours are found to choose the number of visits, and signs of which two at most differ in a visited cell.
MEASURED, NEAR_SIGNS = 1024, 12
BLOCK = 2048
#: Rows that a round copies into its cells, for each vector, and bytes up to which one round is enough.
ROUND, ROUND_BYTES = 2, 256 << 20


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """dim x bits: a random rotation of the vectors padded with zeros to the number of bits."""
    bits = max(BITS, 64 * -(-dim // 64))
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of unit vectors relative to a centre."""

    def __init__(self, unit: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        residual = unit - centre
        self.turned = residual @ turn
        self.norm = np.linalg.norm(residual, axis=1)
        self.bits = _packed(self.turned > 0)
        d = turn.shape[1]
        # inner product of the unit residual with its code
        self.fit = np.maximum(np.abs(self.turned).sum(axis=1) / np.sqrt(d) / np.maximum(self.norm, 1e-12), 1e-3)
        self.towards = unit @ centre
        self.centre2 = float(centre @ centre)
        self.spread = np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(d - 1)

    def planes(self, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The residuals of some rows in STEPS-bit steps: bit planes, lowest value, step and sum."""
        part = self.turned[rows]
        low = part.min(axis=1)
        step = np.maximum((part.max(axis=1) - low) / (2**STEPS - 1), 1e-12)
        units = np.rint((part - low[:, None]) / step[:, None]).astype(np.uint8)
        return np.stack([_packed((units >> j) & 1) for j in range(STEPS)], axis=1), low, step, units.sum(axis=1, dtype=np.float64)

    def estimates(self, rows: slice, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """For each of own `rows` as a query and each vector of `other`: the estimated inner product, and the bound of its error."""
        planes, low, step, total = self.planes(rows)
        d = self.turned.shape[1]
        hits = np.zeros((len(low), len(other.norm)), dtype=np.float32)
        for j in range(STEPS):
            count = np.zeros(hits.shape, dtype=np.uint8 if d < 256 else np.uint16)
            for w in range(planes.shape[2]):
                count += np.bitwise_count(planes[:, None, j, w] & other.bits[None, :, w])
            hits += count * np.float32(2**j)
        ones = np.bitwise_count(other.bits).sum(axis=1)
        signed = 2 * (step[:, None] * hits + low[:, None] * ones) - (step * total + low * d)[:, None]
        scale = other.norm / other.fit
        estimate = signed * (scale / np.sqrt(d)) + self.towards[rows, None] + other.towards - self.centre2
        bound = self.norm[rows, None] * (other.norm * other.spread) + (step / np.sqrt(12))[:, None] * scale
        return estimate, SIGMAS * bound


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1))


def usable_vectors(df: DataFrame, identifier: str, embedding: str, dim: int | None = None) -> DataFrame:
    """(id, vector array<float>): the usable vectors, as often as they are delivered. Null, all-zero, NaN, infinite and null-holding vectors,
    and those whose length isn't `dim` (null: the most common length), are not usable, nor are null identifiers."""
    rows = df.select(F.col(identifier).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("vector")).where("id is not null and vector is not null")
    if dim is None:
        lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head(1)
        dim = lengths[0]["n"] if lengths else 0
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where((F.size("vector") == dim) & finite & F.exists("vector", lambda x: x != 0))


def fit_centres(points: DataFrame, n: int, rounds: int = 5, seed: int = 5) -> np.ndarray:
    """Centres of spherical k-means on a sample: one for every PER_CELL vectors, CENTRES at most, from about SAMPLE for each centre
    (65,536 in all at most), chosen by a hash of their id. Only the centres come from a sample; every vector enters the cells."""
    k = min(CENTRES, max(1, n // PER_CELL))
    share = min(1.0, SAMPLE * k / max(n, 1))
    found = points.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "vector").toArrow()
    if not found.num_rows:
        found = points.orderBy("id").select("id", "vector").limit(1).toArrow()
    if not found.num_rows:
        return np.zeros((0, 1), np.float32)
    order = np.argsort(found.column("id").to_numpy())
    sample = _matrix(found.column("vector")).astype(np.float32)[order]
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), min(k, len(sample)), replace=False))]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[at : at + 4096] @ centres.T, axis=1) for at in range(0, len(sample), 4096)])
        order = np.argsort(own, kind="stable")
        held, starts = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        ok = norm[:, 0] > 1e-6
        centres[held[ok]] = (sums / np.maximum(norm, 1e-12))[ok]
    return centres


class Cells:
    """Where vectors live and which cells they visit. signs: of each centre, the number of leading signs that divide its vectors."""

    def __init__(self, centres: np.ndarray, turn: np.ndarray, signs: np.ndarray):
        self.centres, self.signs, self.most = centres, signs, int(signs.max(initial=0))
        self.turn = turn[:, : self.most]
        self.apart = np.maximum(2 - 2 * centres @ centres.T, 1e-6)
        near = min(self.most, NEAR_SIGNS)
        # sets of signs that may differ, of one or two of those nearest to their borders
        self.flips = [(), *((i,) for i in range(self.most)), *combinations(range(near), 2)]
        self.masks = np.zeros((len(self.flips), self.most), bool)
        for row, flip in enumerate(self.flips):
            self.masks[row, list(flip)] = True

    def _code(self, turned: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """The leading signs as a number, of rotated residuals to `centre`."""
        places = np.arange(self.most)
        own = (turned > 0) & (places < self.signs[centre][..., None])
        return (own * (np.int64(1) << places)).sum(axis=-1)

    def home(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        centre = np.argmax(unit @ self.centres.T, axis=1)
        return (centre.astype(np.int64) << 32) | self._code(unit @ self.turn - (self.centres @ self.turn)[centre], centre)

    def visits(self, unit: np.ndarray, many: int) -> np.ndarray:
        """For each vector its `many` nearest cells in order, its own first; -1 where there are fewer."""
        toward = unit @ self.centres.T
        own = np.argmax(toward, axis=1)
        away = np.maximum(toward[np.arange(len(unit)), own][:, None] - toward, 0) ** 2 / self.apart[own]
        tried = min(many, len(self.centres))
        centre = np.argpartition(away, tried - 1, axis=1)[:, :tried]
        far = np.take_along_axis(away, centre, axis=1)
        if not self.most:
            order = np.lexsort((centre, far))
            cells = np.take_along_axis(centre, order, axis=1).astype(np.int64) << 32
            return np.concatenate([cells, np.full((len(cells), many - tried), -1, np.int64)], axis=1)
        turned = (unit @ self.turn)[:, None, :] - (self.centres @ self.turn)[centre]
        code = self._code(turned, centre)
        used = np.arange(self.most) < self.signs[centre][..., None]
        # of the signs in use, those nearest to their border come first
        margin = np.where(used, turned**2, np.inf)
        by = np.argsort(margin, axis=-1)
        cost = np.sort(margin, axis=-1) @ self.masks.T.astype(np.float32) if not np.isinf(margin).any() else np.where(self.masks, np.sort(margin, axis=-1)[..., None, :], 0).sum(axis=-1)
        bit = np.int64(1) << by
        flipped = (np.where(self.masks, bit[..., None, :], 0)).sum(axis=-1)
        cells = (centre.astype(np.int64) << 32)[..., None] | (code[..., None] ^ flipped)
        cost = (far[..., None] + cost).reshape(len(unit), -1)
        cells = cells.reshape(len(unit), -1)
        cells = np.where(np.isfinite(cost), cells, -1)
        order = np.lexsort((cells, cost))[:, :many]
        cells = np.take_along_axis(cells, order, axis=1)
        return np.concatenate([cells, np.full((len(cells), many - cells.shape[1]), -1, np.int64)], axis=1)

    def count(self) -> int:
        return int((np.int64(1) << self.signs).sum())

    def offsets(self) -> np.ndarray:
        """Of each centre, the number of its first cell where all cells are numbered."""
        return np.concatenate([[0], np.cumsum(np.int64(1) << self.signs)])[:-1]


def _nearest_centre(centres: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.concatenate([np.argmax(_matrix(batch.column("vector").slice(at, 4096)).astype(np.float32) @ centres.T, axis=1) for at in range(0, batch.num_rows, 4096)])
                centre, count = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(centre.astype(np.int64)), pa.array(count.astype(np.int64))], ["centre", "n"])

    return kernel


def _find_cells(cells: Cells, visits: int, rounds: int):
    """Points (key, vector, asks) to (key, vector, asks, home, r0, r1 ...): the number of the cell where the vector lives, and for each round
    the numbers of those of its cells that the point enters in it, which are its home and, if it asks, those that it visits."""
    offsets = cells.offsets()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                unit = _matrix(part.column("vector")).astype(np.float32)
                asking = np.flatnonzero(part.column("asks").to_numpy(zero_copy_only=False))
                there = np.full((part.num_rows, 1 + (visits if len(asking) else 0)), -1, np.int64)
                there[:, 0] = cells.home(unit)
                if len(asking):
                    found = cells.visits(unit[asking], visits)
                    there[asking, 1:] = np.where(found == there[asking, :1], -1, found)
                places = np.where(there >= 0, offsets[there >> 32] + (there & 0xFFFFFFFF), -1).astype(np.int32)
                turns = np.where(there >= 0, ((places.astype(np.int64) * 2654435761) >> 12) % rounds, -1)
                lists = []
                for r in range(rounds):
                    bounds = np.concatenate([[0], np.cumsum((turns == r).sum(axis=1))]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(places[turns == r])))
                own = [part.column(c) for c in ("key", "vector", "asks")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(places[:, 0]), *lists], ["key", "vector", "asks", "home", *(f"r{r}" for r in range(rounds))])

    return kernel


def _top_k(query: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of every query: cosine descending, other ascending."""
    order = np.lexsort((other, -cosine, query))
    q = query[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(q)]])))
    return order[place < k]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row; -inf where there are fewer."""
    return -np.partition(-values, k - 1, axis=1)[:, k - 1] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _meet(centres: np.ndarray, offsets: np.ndarray, turn: np.ndarray, k: int, least: float):
    """Rows (cell, place, key, vector, lives, enters, asks) sorted by cell to (key, other, cosine): of every vector that enters, the k best of at
    least `least` that live there, and of those that live there and ask too, the k best of the guests."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in grouped(batches):
            keys, centre = table.column("key").to_numpy(), np.searchsorted(offsets, table.column("place").to_numpy(), side="right") - 1
            lives, enters, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("lives", "enters", "asks"))
            unit = _matrix(table.column("vector"))
            for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                hosts, guests = at + np.flatnonzero(lives[at:end]), at + np.flatnonzero(enters[at:end])
                if not len(hosts) or not len(guests):
                    continue
                there = Codes(unit[hosts].astype(np.float32), centres[centre[at]], turn)
                ours = Codes(unit[guests].astype(np.float32), centres[centre[at]], turn)
                for top in range(0, len(guests), 512):
                    part = slice(top, top + 512)
                    estimate, bound = ours.estimates(part, there)
                    itself = keys[guests[part]][:, None] == keys[hosts][None, :]
                    low = np.where(itself, -np.inf, estimate - bound)
                    enough = np.maximum(_kth(low, k), least)[:, None]
                    back = asks[hosts]
                    # a pair counts for either side that asks
                    wanted = estimate + bound >= np.where(back[None, :], np.minimum(enough, np.maximum(_kth(low.T, k), least)[None, :]), enough)
                    i, j = np.nonzero(wanted & ~itself)
                    g, h = guests[part][i], hosts[j]
                    cosine = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", unit[g[p : p + 65536]], unit[h[p : p + 65536]]) for p in range(0, len(g), 65536))])
                    keep = cosine >= least
                    g, h, cosine = g[keep], h[keep], cosine[keep]
                    for a, b, c in ((keys[g], keys[h], cosine), (keys[h][asks[h]], keys[g][asks[h]], cosine[asks[h]])):
                        best = _top_k(a, b, c, k)
                        yield pa.RecordBatch.from_arrays([pa.array(a[best]), pa.array(b[best]), pa.array(c[best])], ["key", "other", "cosine"])

    return kernel


def _points(usable: DataFrame, every: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (id, key) and points (key, vector, asks): equal vectors are one point, called by its smallest id. A point asks if one of its
    records has an id divisible by `every` (if that is None, all do). Of rows that repeat an id the same vector is expected; should it
    differ, the one whose hash is least counts. Vectors are moved once, since which are equal is found from hashes alone."""
    hashed = usable.withColumn("hash", F.xxhash64("vector"))
    owned = materialize(hashed.groupBy("id").agg(F.min("hash").alias("hash")), "vector-ids")
    asks = F.lit(True) if every is None else F.max(F.col("id") % every == 0)
    keys = owned.groupBy("hash").agg(F.min("id").alias("key"), asks.alias("asks"))
    points = materialize(hashed.groupBy("hash").agg(F.first("vector").alias("vector")).join(keys, "hash").select("key", "vector", "asks"), "vector-points")
    members = materialize(owned.join(keys.select("hash", "key"), "hash").select("id", "key"), "vector-members")
    return members, points


def _expand(members: DataFrame, near: DataFrame, k: int, asking: DataFrame | None = None) -> DataFrame:
    """The k nearest records of every record (or of those that ask) from the k nearest points (key, other, cosine) of every point. Of a
    point's records the first k + 1 are enough, so that many equal vectors are never paired with one another."""
    heads = top_n_per_group(members.withColumn("score", F.lit(0.0)), ["key"], "score", "id", k + 1).select(F.col("key").alias("other"), F.col("id").alias("neighbour"))
    links = near.unionByName(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.col("key").alias("other"), F.lit(1.0).alias("cosine")))
    wide = links.join(heads, "other").select("key", "neighbour", "cosine")
    ranked = top_n_per_group(wide, ["key"], "cosine", "neighbour", k + 1).select("key", "neighbour", "cosine")
    own = (members if asking is None else asking).join(ranked, "key").where("id <> neighbour").select("id", "neighbour", "cosine")
    return top_n_per_group(own, ["id"], "cosine", "neighbour", k)


def _ranked(members: DataFrame, near: DataFrame | None, k: int, asking: Column | None = None) -> DataFrame:
    """The k nearest records from the neighbours that the rounds of a search have found."""
    if near is None:
        return members.sparkSession.createDataFrame([], "id bigint, cosine double, neighbour bigint, rank int")
    best = top_n_per_group(near, ["key"], "cosine", "other", k).select("key", "other", "cosine")
    return _expand(members, best, k, None if asking is None else members.where(asking))


def _scan(queries: np.ndarray, ids: np.ndarray, k: int):
    """All vectors of a partition against some queries: the k best of every query, exactly."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_q, held_n, held_c = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = part.column("key").to_numpy()
                cosine = queries @ _matrix(part.column("vector")).T
                cosine[ids[:, None] == keys[None, :]] = -2
                most = min(k, len(keys))
                best = np.argpartition(-cosine, most - 1, axis=1)[:, :most]
                q = np.repeat(np.arange(len(ids)), most)
                q, n, c = np.concatenate([held_q, q]), np.concatenate([held_n, keys[best.ravel()]]), np.concatenate([held_c, np.take_along_axis(cosine, best, axis=1).ravel()])
                kept = _top_k(q, n, c, k)
                held_q, held_n, held_c = q[kept], n[kept], c[kept]
        fit = held_c > -2
        yield pa.RecordBatch.from_arrays([pa.array(ids[held_q[fit]]), pa.array(held_n[fit]), pa.array(held_c[fit])], ["key", "other", "cosine"])

    return kernel


def measured_visits(points: DataFrame, n: int, cells: Cells, k: int, least: float, recall: float, both: bool) -> int:
    """The number of cells that vectors must visit for `recall`, where all vectors visit (`both`) or only those that ask: of about MEASURED vectors, chosen by a hash, the true neighbours are found
    among all vectors, with the place that each one's cell has among those the other would visit; the number is a quantile of these."""
    share = min(1.0, MEASURED / max(n, 1))
    asked = points.where(F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("key", "vector").toArrow()
    if not asked.num_rows:
        return 1
    unit, ids = _matrix(asked.column("vector")), asked.column("key").to_numpy()
    scanned = spread(points.select("key", "vector")).mapInArrow(_scan(unit, ids, k), "key bigint, other bigint, cosine double")
    near = top_n_per_group(scanned, ["key"], "cosine", "other", k).where(F.col("cosine") >= least)
    # at most k rows for each of the sample, which the vectors needn't be moved for
    found = points.select(F.col("key").alias("other"), "vector").join(F.broadcast(near.select("key", "other")), "other").toArrow()
    if not found.num_rows:
        return 1
    place = {x: i for i, x in enumerate(ids.tolist())}
    mine = unit[[place[x] for x in found.column("key").to_pylist()]].astype(np.float32)
    theirs = _matrix(found.column("vector")).astype(np.float32)
    most = min(cells.count(), 4096)
    ranks = []
    for at in range(0, len(mine), 256):
        a, b = mine[at : at + 256], theirs[at : at + 256]
        hits = [cells.visits(x, most) == cells.home(y)[:, None] for x, y in ((a, b), (b, a))[: 1 + both]]
        ranks.append(np.min([np.where(h.any(axis=1), h.argmax(axis=1) + 1, most + 1) for h in hits], axis=0))
    return min(most, int(np.quantile(np.concatenate(ranks), recall, method="higher")))


def _dealt(entered: DataFrame) -> DataFrame:
    """Rows (key, vector, asks, home, place, hosts_in, guests_in) to (cell, place, key, vector, lives, enters, asks): the vectors that live in a place
    are dealt into `hosts_in` blocks and those that ask there into `guests_in`, and each block of the ones meets each of the others in a cell
    of its own; `lives` and `enters` say on which side of it a row is."""
    lives = F.col("place") == F.col("home")
    host = F.pmod(F.xxhash64("key", F.lit(7)), F.col("hosts_in")).cast("int")
    guest = F.pmod(F.xxhash64("key", F.lit(11)), F.col("guests_in")).cast("int")
    side = lambda h, g, lives, enters: F.struct(h.alias("h"), g.alias("g"), lives.alias("lives"), enters.alias("enters"))
    as_host = F.transform(F.sequence(F.lit(0), F.col("guests_in") - 1), lambda g: side(F.col("host"), g, F.lit(True), F.col("asks") & (g == F.col("guest"))))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("hosts_in") - 1), lambda h: side(h, F.col("guest"), F.lit(False), F.lit(True)))
    others = F.filter(as_guest, lambda x: ~F.col("at_home") | (x["h"] != F.col("host")))
    none = F.filter(as_guest, lambda x: F.lit(False))
    rows = entered.withColumns({"host": host, "guest": guest, "at_home": lives})
    sides = F.concat(F.when(F.col("at_home"), as_host).otherwise(none), F.when(F.col("asks"), others).otherwise(none))
    sides = F.when(~F.col("at_home") & F.col("asks") & (F.col("hosts_in") == 1), F.array(side(F.lit(0), F.col("guest"), F.lit(False), F.lit(True)))).otherwise(sides)
    dealt = rows.select("place", "key", "vector", "asks", F.explode(sides).alias("side"))
    return dealt.select(F.xxhash64("place", "side.h", "side.g").alias("cell"), "place", "key", "vector", "side.lives", "side.enters", "asks")


def _search(points: DataFrame, k: int, least: float, recall: float, both: bool) -> DataFrame | None:
    """(key, other, cosine): the k best points of every point that asks (`both`: all do); None if there are no points. The table of the points
    is removed."""
    n = points.count()
    centres = fit_centres(points.select(F.col("key").alias("id"), "vector"), n)
    if not len(centres):
        return None
    turn = rotation(centres.shape[1])
    sizes = np.zeros(len(centres), np.int64)
    counted = spread(points.select("vector")).mapInArrow(_nearest_centre(centres), "centre bigint, n bigint").groupBy("centre").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most CENTRES rows
        sizes[r["centre"]] = r["n"]
    # a centre of four times the intended number of vectors is divided by its first sign
    signs = np.clip(np.floor(np.log2(np.maximum(sizes, 1) / (2 * PER_CELL))), 0, 30).astype(np.int64)
    cells = Cells(centres, turn, signs)
    visits = measured_visits(points, n, cells, k, least, recall, both)
    # the most rows that may enter cells say how many rounds there are
    size = 4 * centres.shape[1] + 72
    most = max(int(ROUND * n * size), ROUND_BYTES)
    entries = n + visits * (n if both else points.where("asks").count())
    rounds = int(max(1, -(-entries * size // most)))
    lists = "".join(f", r{r} array<int>" for r in range(rounds))
    placed = materialize(spread(points.select("key", "vector", "asks")).mapInArrow(_find_cells(cells, visits, rounds), f"key bigint, vector array<float>, asks boolean, home int{lists}"), "vector-cells")
    discard(points)
    # cells where nobody lives, or nobody asks, are left out before anything is moved
    entering = placed.select("asks", "home", F.posexplode(F.array(*(f"r{r}" for r in range(rounds)))).alias("turn", "places")).select("asks", "home", "turn", F.explode("places").alias("place"))
    held = entering.groupBy("turn", "place").agg(F.count_if(F.col("place") == F.col("home")).alias("hosts"), F.count_if("asks").alias("guests")).where("hosts > 0 and guests > 0")
    blocks = [F.ceil(F.col(c) / BLOCK).cast("int").alias(f"{c}_in") for c in ("hosts", "guests")]
    held = materialize(held.select("turn", "place", "hosts", "guests", *blocks), "vector-counts")
    copies = dict(held.groupBy("turn").agg(F.sum(F.col("hosts") * F.col("guests_in") + F.col("guests") * F.col("hosts_in")).alias("n")).collect())  # one row for each round
    near = []
    for r in range(rounds):
        entered = placed.select("key", "vector", "asks", "home", F.explode(f"r{r}").alias("place")).join(F.broadcast(held.where(F.col("turn") == r).select("place", "hosts_in", "guests_in")), "place")
        dealt = _dealt(entered)
        total = copies.get(r, 0) * size
        # where large cells are copied for their blocks, a round is divided further
        parts = max(1, -(-total // (2 * most)))
        tasks = max(width(placed.select("key")), -(-total // parts // TASK_BYTES))
        for part in range(parts):
            met = (
                dealt.where(F.pmod(F.xxhash64("cell", F.lit(31)), F.lit(parts)) == part)
                .repartition(tasks, "cell")
                .sortWithinPartitions("cell")
                .mapInArrow(_meet(centres, cells.offsets(), turn, k, least), "key bigint, other bigint, cosine double")
            )
            near.append(materialize(top_n_per_group(met, ["key"], "cosine", "other", k).select("key", "other", "cosine"), "vector-near"))
    discard(placed)
    return reduce(DataFrame.unionByName, near)


def nearest_pairs(df: DataFrame, identifier: str, embedding: str, k: int = 10, least: float | None = 0.85, dim: int | None = None, recall: float = 0.998) -> DataFrame:
    """(id, cosine, neighbour, rank): for every usable vector the up to `k` most similar others, of cosine at least `least` if that is given,
    in order of similarity, ties by neighbour. The length of a vector doesn't matter. A repeated id counts once; an empty table, or one
    without usable vectors, gives an empty result. `recall` is the share of the true neighbours to be found, measured on a sample."""
    with shuffles_removed(df.sparkSession):
        members, points = _points(usable_vectors(df, identifier, embedding, dim))
        near = _search(points, k, -1.0 if least is None else least, recall, True)
    return _ranked(members, near, k)


def nearest_to(df: DataFrame, identifier: str, embedding: str, every: int = 100, k: int = 10, dim: int | None = None, recall: float = 0.93) -> DataFrame:
    """(id, cosine, neighbour, rank): the `k` most similar others of every usable vector whose id is divisible by `every`,
    against all usable vectors, in order of similarity, ties by neighbour. Rows, nulls, empty tables and `recall` are as in nearest_pairs()."""
    with shuffles_removed(df.sparkSession):
        members, points = _points(usable_vectors(df, identifier, embedding, dim), every)
        near = _search(points, k, -1.0, recall, False)
    return _ranked(members, near, k, F.col("id") % every == 0)
