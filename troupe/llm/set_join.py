"""All similar pairs between set-valued records, by recursive chosen-path splitting.

Every tree branches a record on some of its tokens, chosen by a hash of the token and the node, each with
probability 1 / (threshold x size). Two records that are similar enough share at least one chosen token on
average, at every level, while dissimilar ones part. Nodes of few records are compared pair by pair and the rest
branch again; the number of trees follows from the recall asked for, and every pair is verified exactly. Nodes are
counted by identifiers alone, so that the rows of a large node branch again without being brought together. What
is still large at the last level is compared in blocks, so nothing is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troupe.llm.sets import Sets, blocked, classes, grouped, likely_within, similar, term_sets
from troupe.runtime import materialize, spread, width

#: Rows of a node that is compared, levels of branching, rows of a block at the last level, and the recall of the worst pair.
NODE, LEVELS, BLOCK, RECALL = 256, 4, 2048, 0.99

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def trees_for(threshold: float, recall: float = RECALL, levels: int = LEVELS) -> int:
    """Trees that find a pair of just the threshold with probability `recall` though all of its shared tokens lead to large nodes down to
    the last level. At each level a pair shares children in number like a Poisson variable; its mean is 1 at the least, for sets whose sizes
    are as unequal as the threshold allows, and the pair survives if one of these children leads on."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


def _branch(threshold: float, roots: int):
    """Rows (node, key, tokens) to the rows (node, key) of their children. roots > 0: the rows are (key, tokens), each of which enters so many trees."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.num_columns - 2)
            sets = Sets(batch.column(batch.num_columns - 1))
            row = np.repeat(np.arange(batch.num_rows), sets.sizes)
            chance = np.repeat(np.minimum(1.0, 1.0 / (threshold * sets.sizes)), sets.sizes)
            for tree in range(max(1, roots)):
                node = np.full(len(row), tree + 1, np.uint64) * _M1 if roots else batch.column(0).to_numpy().view(np.uint64)[row]
                child = _mix(sets.flat.view(np.uint64) ^ _mix(node))
                chosen = (_mix(child + np.uint64(1)) >> np.uint64(11)) * 2.0**-53 < chance
                yield pa.RecordBatch.from_arrays([pa.array(child[chosen].view(np.int64)), keys.take(pa.array(row[chosen]))], ["node", "key"])

    return kernel


def _compare(threshold: float):
    """Rows (node, key, tokens) sorted by node to the similar pairs of keys in each node."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in grouped(batches):
            sets = Sets(table.column("tokens"))
            maps, keys = sets.bitmaps(), table.column("key").to_numpy()
            for i, j in likely_within(sets, np.stack([bounds[:-1], bounds[1:]], axis=1), threshold):
                i, j, share = similar(sets, maps, i, j, threshold)
                a, b = keys[i], keys[j]
                differ = a != b
                low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(share[differ])], ["key_a", "key_b", "overlap"])

    return kernel


def class_pairs(records: DataFrame, threshold: float, trees: int | None = None) -> DataFrame:
    """(key_a, key_b, overlap): every pair of distinct sets of records (key, tokens) that share `threshold` of their union. Only (node, key)
    branches and is counted; the tokens join the rows of a node when they are compared or branch again."""
    own = records.select("key", "tokens")
    parts, row = width(own), "node bigint, key bigint"
    pair = "key_a bigint, key_b bigint, overlap double"
    level = spread(own).mapInArrow(_branch(threshold, trees or trees_for(threshold)), row)
    found = []
    for depth in range(1, LEVELS + 1):
        level = materialize(level, f"chosen-path-{depth}")
        # a node of one row has no pairs; those rows go before anything is moved
        sizes = materialize(level.groupBy("node").count().where("count > 1"), f"chosen-nodes-{depth}")
        small = level.join(sizes.where(F.col("count") <= NODE).select("node"), "node").join(own, "key").select("node", "key", "tokens")
        found.append(small.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_compare(threshold), pair))
        large = level.join(sizes.where(F.col("count") > NODE), "node").join(own, "key")
        if sizes.where(F.col("count") > NODE).isEmpty():
            break
        if depth == LEVELS:
            cells = blocked(large, "node", "count", BLOCK).select("cell", "key", "tokens")
            found.append(cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_compare(threshold), pair))
            break
        level = spread(large.select("node", "key", "tokens")).mapInArrow(_branch(threshold, 0), row)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.groupBy("key_a", "key_b").agg(F.max("overlap").alias("overlap"))


def similar_set_pairs(df: DataFrame, identifier: str, terms: str, threshold: float, trees: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Membership (id, key) of every record with terms, and the pairs (key_a, key_b, overlap) of classes whose sets
    share at least `threshold` of their union. Records of one class are exact copies, whose overlap is 1; they aren't
    expanded. Records without terms, with a null array or a null identifier are in no class; a repeated identifier
    counts once; an empty table gives two empty results."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets = materialize(term_sets(df, identifier, terms), "term-sets")
    return sets.select("id", "key"), class_pairs(materialize(classes(sets), "set-classes"), threshold, trees)


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, overlap), the smaller first: class pairs and the copies within classes as pairs of records. The records of a class of many
    copies are dealt, so that its pairs, which the result asks for, are made by many tasks."""
    sizes = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.lit(1)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    a = dealt.select(F.col("id").alias("x"), F.col("key").alias("key_a"), F.col("block").alias("block_a"))
    b = dealt.select(F.col("id").alias("y"), F.col("key").alias("key_b"), F.col("block").alias("block_b"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda k: sizes.select(F.col("key").alias(f"key_{k}"), F.col("blocks").alias(f"blocks_{k}"))
    cells = pairs.join(of("a"), "key_a").join(of("b"), "key_b").select("key_a", "key_b", "overlap", each("blocks_a").alias("block_a"), "blocks_b").select("key_a", "key_b", "overlap", "block_a", each("blocks_b").alias("block_b"))
    across = cells.join(a, ["key_a", "block_a"]).join(b, ["key_b", "block_b"]).select("x", "y", "overlap")
    own = sizes.select(F.col("key").alias("key_a"), each("blocks").alias("block_a"), "blocks").select("key_a", "block_a", each("blocks").alias("block_b"))
    copies = own.join(a, ["key_a", "block_a"]).join(b.withColumnRenamed("key_b", "key_a"), ["key_a", "block_b"]).where("x < y").select("x", "y", F.lit(1.0).alias("overlap"))
    return across.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "overlap")


def linked_records(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, key, class_id, links): one row per record with its class, called by its smallest record, and its number of similar records, copies
    included."""
    size = members.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("class_id"))
    both = pairs.select("key_a", "key_b").unionByName(pairs.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    others = both.join(size.select(F.col("key").alias("key_b"), "size"), "key_b").groupBy(F.col("key_a").alias("key")).agg(F.sum("size").alias("others"))
    links = size.join(others, "key", "left").select("key", "class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(links, "key").select("id", "key", "class_id", "links")
