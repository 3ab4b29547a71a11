"""Filling fixed-capacity containers, by linear grouping.

Items are dealt by chance into shards of about SHARD items, each of which is packed on its own: the share of space
a shard leaves unused doesn't depend on how many there are. In a shard, the large items are sorted by size and cut
into groups of equal cardinality, whose sizes are rounded up to the largest of the group. For the few sizes that
remain, the fractional optimum over container configurations is found by column generation and rounded down; the
actual items take the places of their group's size, which leaves some of the space; what the rounding left over and
the small items then go to the fullest container in which they fit.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troupe.runtime import materialize, width

#: Items of a shard, groups of large items, and the share of the capacity above which an item is large.
SHARD, GROUPS, LARGE = 20_000, 40, 0.12
#: Kinds of containers that the driver takes; more raise an error, none is left out.
KINDS = 10_000


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How often to take each size so that they fit into `capacity` with the most total value (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for k, (size, value) in enumerate(zip(sizes.tolist(), values.tolist())):
        if value <= 1e-12:
            continue
        for at in range(size, capacity + 1, size):
            end = min(at + size, capacity + 1)
            new = best[at - size : end - size] + value
            better = new > best[at:end] + 1e-12
            best[at:end][better] = new[better]
            taken[at:end][better] = k
    # an entry stands for "at most this much space", so the last size taken is found by walking down
    counts, left = np.zeros(len(sizes), int), int(np.argmax(best))
    while left > 0 and taken[left] >= 0:
        counts[taken[left]] += 1
        left -= sizes[taken[left]]
    return counts, float(counts @ values)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations of the few `sizes` and how often each is used: the fractional optimum of covering `demand`, by
    column generation with a basis of one configuration per size, rounded down."""
    n = len(sizes)
    if not n:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    used = demand / (capacity // sizes)
    for _ in range(rounds):
        try:
            prices = np.linalg.solve(basis.T, np.ones(n))
        except np.linalg.LinAlgError:
            break
        column, value = best_configuration(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column.astype(float))
        ratio = np.full(n, np.inf)
        up = way > 1e-9
        ratio[up] = used[up] / way[up]
        leaving = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaving]):
            break
        step = ratio[leaving]
        used = np.maximum(used - step * way, 0)
        used[leaving] = step
        basis[:, leaving] = column
    return [(basis[:, k].astype(int), int(used[k] + 1e-9)) for k in range(n) if used[k] >= 1]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes from 0 to `capacity`."""
    container = np.full(len(sizes), -1, dtype=np.int64)
    room: list[int] = []
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    large = order[sizes[order] > LARGE * capacity]
    rest = [int(x) for x in order[len(large) :]]
    if len(large):
        groups = np.array_split(large, min(GROUPS, len(large)))
        tops, demand, queues = [], [], []
        for group in groups:
            top = int(sizes[group[0]])
            if tops and tops[-1] == top:  # groups of one size are one
                demand[-1] += len(group)
                queues[-1] += group.tolist()
            else:
                tops.append(top)
                demand.append(len(group))
                queues.append(group.tolist())
        for pattern, times in configurations(np.array(tops), np.array(demand, float), capacity):
            for _ in range(times):
                free, placed = capacity, False
                for k in np.flatnonzero(pattern).tolist():
                    for _ in range(pattern[k]):
                        if queues[k]:
                            item = queues[k].pop(0)
                            container[item] = len(room)
                            free -= int(sizes[item])
                            placed = True
                if placed:
                    room.append(free)
        rest = sorted((x for q in queues for x in q), key=lambda x: (-sizes[x], x)) + rest
    # best fit: the fullest container that still takes the item; containers are held by the room they have left
    order_ = sorted((free, k) for k, free in enumerate(room))
    for item in rest:
        size = int(sizes[item])
        at = bisect.bisect_left(order_, (size, -1))
        if at < len(order_):
            free, k = order_.pop(at)
        else:
            free, k = capacity, len(room)
            room.append(capacity)
        container[item] = k
        room[k] = free - size
        bisect.insort(order_, (free - size, k))
    return container


_ROW = "bin string, container_id bigint, id bigint, part int, start bigint, size bigint"


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bin, capacity, shard, id, size) sorted by bin and shard; a shard is whole in its partition and bounded."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        name, capacity, shard = held[0][:3]
        ids, sizes = np.array([x[3] for x in held]), np.array([x[4] for x in held])
        order = np.lexsort((sizes, ids))
        ids, sizes = ids[order], sizes[order]
        full, left = sizes // capacity, sizes % capacity
        # an item is split only if it exceeds the capacity: into full containers and one remainder
        one = (full == 0) | ((full == 1) & (left == 0))
        left = np.where(one, sizes, left)
        full = np.where(one, 0, full)
        open_ = one | (left > 0)
        whole = np.repeat(np.arange(len(ids)), full)
        part = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        packed = pack(left[open_], int(capacity))
        base = int(shard) << 32
        count = int(packed.max()) + 1 if len(packed) else 0
        container = np.concatenate([packed, count + np.arange(len(whole))]) + base
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(container), pa.string()),
                pa.array(container, pa.int64()),
                pa.array(np.concatenate([ids[open_], ids[whole]]), pa.int64()),
                pa.array(np.concatenate([full[open_], part]), pa.int32()),
                pa.array(np.concatenate([full[open_] * capacity, part * capacity]), pa.int64()),
                pa.array(np.concatenate([left[open_], np.full(len(whole), capacity)]), pa.int64()),
            ],
            ["bin", "container_id", "id", "part", "start", "size"],
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:3] != row[:3]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


def fill_containers(items: DataFrame, identifier: str, size: str, bins: DataFrame, name: str, capacity: str) -> DataFrame:
    """(bin, container_id, id, part, start, size): every item of `items` in a container of every kind in `bins`.

    An item of at most the capacity is whole in one container (part 0, start 0). A larger one is split into parts
    that fill containers of their own and a remainder, if any, that is packed like an item; start is the part's first
    unit. Items of size 0 are packed too; a null or negative size counts as 0. Rows with null identifiers are left
    out, as are kinds whose capacity is null or not positive; more than KINDS kinds raise an error; rows that repeat an identifier are items of their own.
    Container ids are unique within a kind. Empty tables give an empty result."""
    found = bins.where(F.col(capacity) > 0).select(F.col(name).cast("string").alias("bin"), F.col(capacity).cast("bigint").alias("capacity")).distinct().orderBy("bin", "capacity").limit(KINDS + 1).collect()
    if len(found) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    kinds = F.array(*[F.struct(F.lit(r["bin"]).alias("bin"), F.lit(r["capacity"]).alias("capacity")) for r in found]) if found else F.array().cast("array<struct<bin:string,capacity:bigint>>")
    # rows are dealt by a hash of their place and not of what they hold, so that many equal rows don't meet in one shard
    deal = F.xxhash64(F.monotonically_increasing_id())
    rows = items.where(F.col(identifier).isNotNull()).select(F.col(identifier).cast("bigint").alias("id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"), deal.alias("deal"))
    rows = materialize(rows, "items")
    shards = max(1, -(-rows.count() // SHARD))
    dealt = rows.select(F.explode(kinds).alias("kind"), F.pmod("deal", F.lit(shards)).alias("shard"), "id", "size").select("kind.bin", "kind.capacity", "shard", "id", "size")
    # one task for each kind and shard while they are few: packing is CPU and not bytes
    parts = max(width(rows), min(shards * len(found), 100_000))
    return dealt.repartition(parts, "bin", "capacity", "shard").sortWithinPartitions("bin", "capacity", "shard").mapInArrow(_pack_shards, _ROW)


def fill_report(packed: DataFrame, bins: DataFrame, name: str, capacity: str) -> DataFrame:
    """(bin, items, containers, used, fewest, unused_share): per kind, the space used and the share left unused, next to the
    fewest containers that the total size would allow."""
    each = packed.groupBy("bin").agg(F.count_distinct("id").alias("items"), F.count_distinct("container_id").alias("containers"), F.sum("size").alias("used"))
    caps = bins.select(F.col(name).alias("bin"), F.col(capacity).cast("bigint").alias("capacity")).distinct()
    space = F.col("containers") * F.col("capacity")
    return each.join(caps, "bin").select("bin", "items", "containers", "used", F.ceil(F.col("used") / F.col("capacity")).alias("fewest"), F.round(1 - F.col("used") / space, 6).alias("unused_share"))
