"""Top N items within every group, by secondary sort.

Rows are sorted by group, score, tie-breaker and identifier within each partition, and Arrow batches stream
through a kernel that emits the first N of a group and skips the rest, so no group is ever buffered. The kernel
runs twice: over the partitions as they are read, which leaves at most N rows of a group in each of them however
large the group is, and again after hash-partitioning what is left by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troupe.runtime import width


def _starts(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """True where a row's group differs from that of the row before; the first row is left False."""
    differs = np.zeros(batch.num_rows, dtype=bool)
    for k in range(n_keys):
        a, b = batch.column(k)[1:], batch.column(k)[:-1]
        unequal = pc.fill_null(pc.not_equal(a, b), False)
        differs[1:] |= pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return differs


def _first_n(n_keys: int, n: int, ranked: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, taken = None, set()
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            cut = _starts(batch, n_keys)
            key = tuple(batch.column(k)[0].as_py() for k in range(n_keys))
            if key != last_key:
                cut[0] = True
            bounds = np.flatnonzero(cut).tolist()
            if not cut[0]:
                bounds.insert(0, 0)
            ids = batch.column(batch.num_columns - 1).to_pylist()
            keep, ranks = [], []
            for at, end in zip(bounds, [*bounds[1:], rows]):
                if at or cut[0]:
                    taken = set()
                while at < end and len(taken) < n:
                    if ids[at] not in taken:
                        taken.add(ids[at])
                        keep.append(at)
                        ranks.append(len(taken))
                    at += 1
            last_key = tuple(batch.column(k)[rows - 1].as_py() for k in range(n_keys))
            if keep:
                out = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(ranks, pa.int32())], [*out.schema.names, "rank"]
                ) if ranked else out

    return kernel


def top_n_per_group(df: DataFrame, groups: list[str], score: str, identifier: str, n: int, tie: str | None = None) -> DataFrame:
    """The `n` rows of every group with the highest `score`, equal scores ordered by `tie` descending and then
    `identifier` ascending: columns groups, score, tie, identifier, rank (from 1).

    Rows with null or NaN score or null identifier are left out; a null tie counts as 0, and a null group value is
    a group like any other. An identifier counts once in a group, with its best row, so repeated rows change
    nothing. Groups of fewer than `n` identifiers give what they have, empty tables an empty result. Other
    columns of the input are ignored whatever their names."""
    if n < 1:
        raise ValueError("n must be at least 1")
    value = F.col(score).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value) & F.col(identifier).isNotNull()).select(
        *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)],
        F.col(score).alias("score"),
        (F.coalesce(F.col(tie).cast("double"), F.lit(0.0)) if tie else F.lit(0.0)).alias("tie"),
        F.col(identifier).alias("item"),
    )
    keys = [f"g{i}" for i in range(len(groups))]
    order = [*keys, F.col("score").desc(), F.col("tie").desc(), F.col("item").asc()]
    local = rows.sortWithinPartitions(*order).mapInArrow(_first_n(len(keys), n, False), rows.schema)
    ranked = (
        local.repartition(width(df), *keys)
        .sortWithinPartitions(*order)
        .mapInArrow(_first_n(len(keys), n, True), f"{rows.schema.simpleString()[7:-1]}, rank int")
    )
    return ranked.select(
        *[F.col(f"g{i}").alias(g) for i, g in enumerate(groups)],
        F.col("score").alias(score),
        *([F.col("tie").alias(tie)] if tie else []),
        F.col("item").alias(identifier),
        "rank",
    )
