"""Vectors as array columns: norms, centring, Gram entries, neighbours and distances between sets of vectors.

All-pairs operators work block by block: rows are dealt into blocks of bounded size, every pair of blocks is one
group of an Arrow function, and only the entries asked for leave it. No row is ever paired with another row in a
join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and blocks that a group of fewer rows is dealt into, so that there are pairs of blocks for several tasks.
BLOCK, LEAST, FEW = 4096, 256, 4


def _blocks(df: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, blocks): every row is copied as often as its group has blocks, so there are as few as their size allows."""
    n = F.count("*")
    return df.groupBy(*groups).agg(F.greatest(F.ceil(n / F.lit(BLOCK)), F.least(F.ceil(n / F.lit(LEAST)), F.lit(FEW)), F.lit(1)).cast("int").alias("blocks"))


def dot(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: str | Column) -> Column:
    """The vector at length 1; a vector of length 0 stays as it is."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def oriented(values: str | Column) -> Column:
    """The vector with the sign that makes its entry of largest amount positive; the first of equals decides."""
    v = F.col(values) if isinstance(values, str) else values
    largest = F.array_max(F.transform(v, lambda x, i: F.struct(F.abs(x).alias("size"), (-i).alias("place"), x.alias("x"))))
    return F.transform(v, lambda x: F.when(largest["x"] < 0, -x).otherwise(x))


def mean_vector(df: DataFrame, vector: str, weight: Column | None = None) -> DataFrame:
    """(mean): one row, the weighted mean of a column of vectors, by dimension."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    each = df.select(w.alias("w"), F.posexplode(vector).alias("k", "x")).groupBy("k").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return each.agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("m")).select(F.transform("m", lambda s: s["x"]).alias("mean"))


def centred(df: DataFrame, vector: str, kind: str = "mean", weight: Column | None = None) -> DataFrame:
    """df with `vector` less the mean ('mean'), less the weighted mean ('population'), or as it is ('none')."""
    if kind == "none":
        return df
    mean = mean_vector(df, vector, weight if kind == "population" else None)
    # one row of as many numbers as there are dimensions
    joined = df.join(F.broadcast(mean))
    return joined.withColumn(vector, F.zip_with(vector, "mean", lambda x, m: x.cast("double") - m)).drop("mean")


def row_sums(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, row_sum): the sum of each row of the Gram matrix without its diagonal, from the sum of all vectors."""
    each = df.select(F.posexplode(vector).alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("double")).alias("x"))
    total = each.agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("m")).select(F.transform("m", lambda s: s["x"]).alias("total"))
    return df.join(F.broadcast(total)).select(key, (dot(vector, "total") - dot(vector, vector)).alias("row_sum"))


def _dealt(df: DataFrame, key: str, blocks: Column, groups: list[str]) -> DataFrame:
    """Rows once for every other block of their group, with the pair of blocks and the own one."""
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    placed = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other").select(*groups, "low", "high", "own", *[c for c in df.columns if c not in groups])


def similar_pairs(df: DataFrame, key: str, vector: str, least: float, low: float = -1.0, groups: list[str] | None = None) -> DataFrame:
    """(groups, key_a, key_b, similarity): pairs of rows, the smaller key first, whose cosine, clipped to [low, 1], is at least
    `least`; of one group if groups are given. Vectors of length 0 have cosine 0 to all. The diagonal, which is 1, is left out."""
    groups = groups or []
    sizes = _blocks(df, groups)
    rows = df.select(*groups, F.col(key).alias("key"), unit(vector).alias("v"))
    rows = rows.join(sizes, groups) if groups else rows.join(F.broadcast(sizes))
    dealt = _dealt(rows, "key", F.col("blocks"), groups).drop("blocks")
    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join([*(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups), f"key_a {kind}", f"key_b {kind}", "similarity double"])

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["low"].iat[0], pdf["high"].iat[0]
        a, b = pdf[pdf["own"] == first], pdf[pdf["own"] == second]
        out = []
        if len(a) and len(b):
            va, vb = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
            ka, kb = a["key"].to_numpy(), b["key"].to_numpy()
            for at in range(0, len(va), 512):
                s = np.clip(va[at : at + 512] @ vb.T, low, 1.0)
                i, j = np.nonzero(s >= least)
                keep = ka[i + at] < kb[j] if first == second else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                x, y = ka[i + at], kb[j]
                out.append(pd.DataFrame({"key_a": np.minimum(x, y), "key_b": np.maximum(x, y), "similarity": s[i, j]}))
        found = pd.concat(out) if out else pd.DataFrame({"key_a": [], "key_b": [], "similarity": []})
        for g in reversed(groups):
            found.insert(0, g, pdf[g].iat[0])
        return found

    return dealt.groupBy(*groups, "low", "high").applyInPandas(pairs, schema)


def nearest(df: DataFrame, key: str, vector: str, k: int, groups: list[str]) -> DataFrame:
    """(groups, key, neighbour, similarity, place): the k rows of the same group nearest by cosine to each row, itself left out; ties by
    neighbour. Blocks keep the k best of each row, so that no more than that ever leaves them."""
    sizes = _blocks(df, groups)
    rows = df.select(*groups, F.col(key).alias("key"), unit(vector).alias("v")).join(sizes, groups)
    dealt = _dealt(rows, "key", F.col("blocks"), groups).drop("blocks")
    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join([*(f"{g} {df.schema[g].dataType.simpleString()}" for g in groups), f"key {kind}", f"neighbour {kind}", "similarity double"])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["low"].iat[0], pdf["high"].iat[0]
        sides = [(first, second)] if first == second else [(first, second), (second, first)]
        out = []
        for p, q in sides:
            a, b = pdf[pdf["own"] == p], pdf[pdf["own"] == q].sort_values("key")
            if not len(a) or not len(b):
                continue
            vb, kb = np.stack(b["v"].to_numpy()), b["key"].to_numpy()
            for at in range(0, len(a), 512):
                part = a.iloc[at : at + 512]
                s = np.stack(part["v"].to_numpy()) @ vb.T
                s[part["key"].to_numpy()[:, None] == kb[None, :]] = -np.inf
                # equal similarities are in order of the key, since b is
                order = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
                i = np.repeat(np.arange(len(part)), order.shape[1])
                j = order.ravel()
                fit = np.isfinite(s[i, j])
                out.append(pd.DataFrame({"key": part["key"].to_numpy()[i[fit]], "neighbour": kb[j[fit]], "similarity": s[i, j][fit]}))
        found = pd.concat(out) if out else pd.DataFrame({"key": [], "neighbour": [], "similarity": []})
        for g in reversed(groups):
            found.insert(0, g, pdf[g].iat[0])
        return found

    found = dealt.groupBy(*groups, "low", "high").applyInPandas(best, schema)
    place = F.row_number().over(Window.partitionBy(*groups, "key").orderBy(F.desc(F.round("similarity", 9)), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def top_weights(df: DataFrame, row: str, term: str, weight: str, top: int = 18, least: float = 1e-6) -> DataFrame:
    """(row, term, weight): per row the `top` weights above `least`, divided by their sum; ties by term."""
    place = F.row_number().over(Window.partitionBy(row).orderBy(F.desc(weight), term))
    kept = df.where(F.col(weight) > least).withColumn("place", place).where(F.col("place") <= top)
    return kept.select(row, term, (F.col(weight) / F.sum(weight).over(Window.partitionBy(row))).alias("weight"))


def soft_distance(wl: np.ndarray, vl: np.ndarray, wr: np.ndarray, vr: np.ndarray) -> float:
    """Half the weighted mean distance of each side's vectors to the nearest of the other; 0 for two empty sets, 1 if one is."""
    if not len(vl) and not len(vr):
        return 0.0
    if not len(vl) or not len(vr):
        return 1.0
    cost = np.clip(1.0 - vl @ vr.T, 0.0, 2.0)
    return 0.5 * float((wl * cost.min(axis=1)).sum() + (wr * cost.min(axis=0)).sum())


def set_distances(items: DataFrame, item: str, group: str, weighted: bool = True) -> DataFrame:
    """(group, item_a, item_b, distance) within each group of (group, item, weights array, vectors array<array>), each the distance
    between two sets of unit vectors: weighted, or the plain mean of best matches. Items are dealt into blocks of one group."""
    sizes = items.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / F.lit(256)), F.lit(1)).cast("int").alias("blocks"))
    dealt = _dealt(items.select(group, F.col(item).alias("key"), "weights", "vectors").join(sizes, group), "key", F.col("blocks"), [group]).drop("blocks")
    schema = f"{group} {items.schema[group].dataType.simpleString()}, item_a bigint, item_b bigint, distance double"

    def side(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys and sizes of the sets, and the weights and vectors of all of them, one after the other."""
        sizes = rows["vectors"].map(len).to_numpy(dtype=np.int64)
        flat = [x for v in rows["vectors"] for x in v]
        vectors = np.stack(flat).astype(float) if flat else np.zeros((0, 1))
        weights = np.concatenate([np.asarray(w, float) for w in rows["weights"]]) if weighted and flat else np.repeat(1 / np.maximum(sizes, 1), sizes)
        return rows["key"].to_numpy(), sizes, weights, vectors

    def one_way(cost: np.ndarray, weights: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """own x other: of every pair of sets, the weighted mean of the own vectors' least costs; 0 where either is empty."""
        out = np.zeros((len(own), len(other)))
        a, b = np.flatnonzero(own), np.flatnonzero(other)
        if len(a) and len(b):
            least = np.minimum.reduceat(cost, np.cumsum(other[b]) - other[b], axis=1)
            out[np.ix_(a, b)] = np.add.reduceat(weights[:, None] * least, np.cumsum(own[a]) - own[a], axis=0)
        return out

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf["low"].iat[0], pdf["high"].iat[0]
        (ka, na, wa, va), (kb, nb, wb, vb) = (side(pdf[pdf["own"] == x]) for x in (first, second))
        if not len(ka) or not len(kb):
            return pd.DataFrame({group: [], "item_a": [], "item_b": [], "distance": []})
        cost = np.clip(1.0 - va @ vb.T, 0.0, 2.0) if len(va) and len(vb) else np.zeros((len(va), len(vb)))
        distance = 0.5 * (one_way(cost, wa, na, nb) + one_way(cost.T, wb, nb, na).T)
        distance = np.where((na[:, None] == 0) != (nb[None, :] == 0), 1.0, distance)
        i, j = np.nonzero(ka[:, None] < kb[None, :]) if first == second else (x.ravel() for x in np.indices(distance.shape))
        return pd.DataFrame({group: pdf[group].iat[0], "item_a": np.minimum(ka[i], kb[j]), "item_b": np.maximum(ka[i], kb[j]), "distance": distance[i, j]})

    return dealt.groupBy(group, "low", "high").applyInPandas(pairs, schema)


def nearest_by_distance(distances: DataFrame, group: str, k: int = 8, itself: bool = True) -> DataFrame:
    """(group, item, place, neighbour, distance): the k items of least distance to each, from distances (group, item_a, item_b, distance) of one
    pair each; ties by neighbour. With `itself` an item is its own first neighbour, at distance 0."""
    turned = distances.select(group, F.col("item_a").alias("item"), F.col("item_b").alias("neighbour"), "distance").unionByName(distances.select(group, F.col("item_b").alias("item"), F.col("item_a").alias("neighbour"), "distance"))
    if itself:
        turned = turned.unionByName(turned.select(group, "item", F.col("item").alias("neighbour"), F.lit(0.0).alias("distance")).distinct())
    place = F.row_number().over(Window.partitionBy(group, "item").orderBy(F.round("distance", 9), F.col("item") != F.col("neighbour"), "neighbour"))
    return turned.withColumn("place", place).where(F.col("place") <= k).select(group, "item", "place", "neighbour", "distance")


def similarity_summary(df: DataFrame, vector: str, group: str, pairs: DataFrame) -> DataFrame:
    """(group, n, pairs, nonzero, density, mean_all, mean, most) of unit vectors' similarities: `pairs` (group, similarity) are those at or above
    the threshold, the matrix with both their entries and the diagonal is what counts as nonzero. mean_all is over all entries off the diagonal,
    from the sum of the vectors, so that no pair is looked at; `mean` leaves exact copies out."""
    rows = df.select(group, unit(vector).alias("v"))
    sums = rows.select(group, F.posexplode("v").alias("k", "x")).groupBy(group, "k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("d"), F.count("*").alias("n"))
    sums = sums.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("d").alias("diagonal"))
    kept = pairs.groupBy(group).agg(F.count("*").alias("pairs"), F.avg(F.when(F.col("similarity") < 0.999999, F.col("similarity"))).alias("mean"), F.max("similarity").alias("most"))
    both = sums.join(kept, group, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0))).withColumn("nonzero", F.col("n") + 2 * F.col("pairs"))
    off = F.when(F.col("n") > 1, (F.col("all") - F.col("diagonal")) / (F.col("n") * (F.col("n") - 1)))
    return both.select(group, "n", "pairs", "nonzero", (F.col("nonzero") / (F.col("n") * F.col("n"))).alias("density"), off.alias("mean_all"), "mean", "most")


def smoothed(rows: DataFrame, similarity: DataFrame, item: str, term: str) -> DataFrame:
    """(item, term, value): incidence (item, term, value) times a thresholded similarity (term_a < term_b, similarity) with its unit diagonal."""
    both = similarity.select(F.col("key_a").alias(term), F.col("key_b").alias("to"), "similarity").unionByName(similarity.select(F.col("key_b").alias(term), F.col("key_a").alias("to"), "similarity"))
    spread = rows.join(both, term).select(item, F.col("to").alias(term), (F.col("value") * F.col("similarity")).alias("value"))
    return rows.select(item, term, "value").unionByName(spread).groupBy(item, term).agg(F.sum("value").alias("value"))


def popularity_weights(df: DataFrame, value: str, kind: str = "log1p") -> DataFrame:
    """df with `weight`: 1, log1p or the root of log1p of a popularity (null as 0), divided by the mean of the positive ones."""
    v = F.coalesce(F.col(value), F.lit(0)).cast("double")
    makers: dict[str, Callable[[Column], Column]] = {"none": lambda x: F.lit(1.0), "log1p": F.log1p, "sqrt_log1p": lambda x: F.sqrt(F.log1p(x))}
    rows = df.withColumn("weight", makers[kind](v))
    mean = rows.agg(F.avg(F.when(F.col("weight") > 0, F.col("weight"))).alias("mean"))
    return rows.join(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.coalesce("mean", F.lit(1.0))).drop("mean")
