"""Set-valued records: their canonical form, exact copies as one class, and exact overlap kernels.

A term is identified by its 64-bit hash, and a set by the sorted array of these. Records with the same set form a
class, whose key is a hash of the set, so that membership needs no join and no list of members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troupe.llm.terms import canonical_lists
from troupe.runtime import spread

WORDS = 4
#: Buckets of terms, and sets of a group whose pairs are first compared by these.
BUCKETS, DENSE = 256, 32
#: Terms of a set up to which sets are compared term by term.
SHORT = 24


def _canonical_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(x)) for x in canonical_lists(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["id", "terms"])


def term_sets(df: DataFrame, identifier: str, terms: str) -> DataFrame:
    """(id bigint, key bigint, tokens array<bigint>): each record with at least one canonical term, once.

    Null identifiers, null arrays and arrays without terms are left out. Of rows that repeat an identifier, the
    same content is expected; should it differ, the set that sorts first counts."""
    source = df.select(F.col(identifier).cast("bigint").alias("id"), F.col(terms).alias("terms")).where("id is not null and terms is not null")
    sets = spread(source).mapInArrow(_canonical_sets, "id bigint, terms array<string>").where(F.size("terms") > 0)
    hashed = sets.select("id", F.array_sort(F.transform("terms", lambda x: F.xxhash64(x))).alias("tokens"))
    once = hashed.groupBy("id").agg(F.min("tokens").alias("tokens"))
    return once.select("id", F.xxhash64("tokens").alias("key"), "tokens")


def classes(sets: DataFrame) -> DataFrame:
    """(key, id, copies, tokens): one row per distinct set, with its smallest record and number of records."""
    return sets.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"))


class Sets:
    """The sets of one Arrow batch as flat arrays."""

    def __init__(self, tokens: pa.Array):
        lists = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
        offsets = lists.offsets.to_numpy()
        self.flat = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        self.starts = (offsets[:-1] - offsets[0]).astype(np.int64)
        self.sizes = np.diff(offsets).astype(np.int64)
        self._made: dict[int, frozenset] = {}

    def part(self, rows: np.ndarray) -> Sets:
        """The sets of some rows, by position."""
        own = object.__new__(Sets)
        own.flat, own.starts, own.sizes, own._made = self.flat, self.starts[rows], self.sizes[rows], {}
        return own

    def bitmaps(self) -> np.ndarray:
        """A bitmap of every set; a bit set here and not there stands for at least one term that is here and not there."""
        maps = np.zeros((len(self.sizes), WORDS), dtype=np.uint64)
        if len(self.flat):
            raw = self.flat.view(np.uint64)
            bit = np.uint64(1) << (raw & np.uint64(63))
            word = (raw >> np.uint64(6)) % np.uint64(WORDS)
            for w in range(WORDS):
                maps[:, w] = np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), self.starts)
        return maps

    def buckets(self) -> np.ndarray:
        """How many terms of every set fall into each of BUCKETS: the product of two rows is at least the number of terms in common."""
        held = np.zeros((len(self.sizes), BUCKETS), np.float32)
        if len(self.flat):
            # sets follow one another in the flat array
            raw = self.flat[self.starts[0] :].view(np.uint64)
            np.add.at(held, (np.repeat(np.arange(len(self.sizes)), self.sizes), ((raw >> np.uint64(17)) % np.uint64(BUCKETS)).astype(np.int64)), 1)
        return held

    def _rows(self, at: np.ndarray, width: int, fill: int) -> np.ndarray:
        """The terms of some sets of at most `width` as rows, filled up with `fill`."""
        place = np.arange(width)
        inside = place < self.sizes[at][:, None]
        rows = self.flat[np.where(inside, self.starts[at][:, None] + place, 0)]
        return np.where(inside, rows, fill)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of terms in common of every pair, exactly: of short sets term by term for many pairs at once, of long ones as sets."""
        a, b = self.sizes[i], self.sizes[j]
        shared = np.zeros(len(i), np.int64)
        short = np.flatnonzero((a <= SHORT) & (b <= SHORT))
        for top in range(0, len(short), 8192):
            part = short[top : top + 8192]
            # no term is the least or the second least number
            left = np.ascontiguousarray(self._rows(i[part], int(a[part].max()), -(2**63)).T)
            right = np.ascontiguousarray(self._rows(j[part], int(b[part].max()), -(2**63) + 1).T)
            found = np.zeros(len(part), np.uint8)
            for own in left:
                for other in right:
                    found += own == other
            shared[part] = found
        for k in np.flatnonzero((a > SHORT) | (b > SHORT)).tolist():
            shared[k] = len(self.members(int(i[k])) & self.members(int(j[k])))
        return shared

    def members(self, i: int) -> frozenset:
        found = self._made.get(i)
        if found is None:
            at = self.starts[i]
            found = self._made[i] = frozenset(self.flat[at : at + self.sizes[i]].tolist())
        return found


def similar(sets: Sets, maps: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those whose sets share at least `threshold` of their union, with that share, exactly.
    Sizes and bitmaps only rule out pairs that cannot reach it."""
    a, b = sets.sizes[i], sets.sizes[j]
    keep = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
    i, j, a, b = i[keep], j[keep], a[keep], b[keep]
    need = np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)
    most = np.minimum(
        a - np.bitwise_count(maps[i] & ~maps[j]).sum(axis=1, dtype=np.int64), b - np.bitwise_count(maps[j] & ~maps[i]).sum(axis=1, dtype=np.int64)
    )
    keep = most >= need
    i, j, a, b, need = i[keep], j[keep], a[keep], b[keep], need[keep]
    shared = sets.common(i, j)
    keep = shared >= need
    return i[keep], j[keep], shared[keep] / (a + b - shared)[keep]


def likely(sets: Sets, held: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, above: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of all pairs of the sets at `left` and `right`, those that may share `threshold` of their union, in portions; all that do are among them.
    With `above`, left and right are the same, and each pair comes once. `held` are the buckets of all sets."""
    share = np.float32(threshold / (1 + threshold))
    size, other, column = sets.sizes[left].astype(np.float32), sets.sizes[right].astype(np.float32), held[right].T
    for top in range(0, len(left), 512):
        may = held[left[top : top + 512]] @ column >= share * (size[top : top + 512, None] + other) - 1e-3
        i, j = np.nonzero(np.triu(may, top + 1) if above else may)
        yield left[i + top], right[j]


def likely_within(sets: Sets, spans: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within each span (start, end) of neighbouring sets that may be similar; those of short spans are all taken."""
    sizes = spans[:, 1] - spans[:, 0]
    yield from pairs_within(spans[sizes < DENSE])
    if (sizes >= DENSE).any():
        held = sets.buckets()
        for at, end in spans[sizes >= DENSE].tolist():
            rows = np.arange(at, end)
            yield from likely(sets, held, rows, rows, threshold, True)


def grouped(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by column `key`, with the bounds of their groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = held[0].column(key)[0], batch.column(key)[batch.num_rows - 1]
        if first == last or sum(x.num_rows for x in held) < 4096:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        values = table.column(key).to_numpy()
        cut = int(np.searchsorted(values != values[-1], False)) if values[0] != values[-1] else 0
        if cut:
            held = table.slice(cut).to_batches()
            yield _with_bounds(table.slice(0, cut), values[:cut])
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield _with_bounds(table, table.column(key).to_numpy())


def _with_bounds(table: pa.Table, values: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    return table, np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def pairs_within(bounds: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of all pairs within each group, in portions of about `most` pairs. bounds are those of neighbouring groups, or (start, end) rows."""
    left, right, held = [], [], 0
    spans = bounds if bounds.ndim == 2 else np.stack([bounds[:-1], bounds[1:]], axis=1)
    for at, end in spans.tolist():
        m = end - at
        if m < 2:
            continue
        step = max(1, most // m)
        for top in range(0, m, step):
            rows = np.arange(top, min(m, top + step))
            counts = m - 1 - rows
            i = np.repeat(rows, counts)
            j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
            left.append(i + at)
            right.append(j + at)
            held += len(i)
            if held >= most:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def blocked(rows: DataFrame, node: str, count: str, block: int) -> DataFrame:
    """rows with a column `cell`: the rows of one node that are more than `block` are dealt into blocks, and every pair of
    blocks is a cell of its own, so that all pairs of the node meet in cells of bounded size."""
    blocks = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(7)), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    placed = rows.withColumn("_own", own).withColumn("_other", other)
    return placed.withColumn("cell", F.xxhash64(node, F.least("_own", "_other"), F.greatest("_own", "_other"))).drop("_own", "_other")


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
