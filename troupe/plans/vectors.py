"""Vectors: similarity, neighbours, centring, smoothing. The embeddings table is small and fixed; label is the group."""

from __future__ import annotations

from pyspark.sql import functions as F

from troupe.operators import vectors as V
from troupe.plans import Query
from troupe.runtime import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


_E = "e as (select vec_id, label, embedding::double[] v, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) u from embeddings)"


def similar_vectors(spark, sf_dir):
    return V.similar_pairs(_emb(spark, sf_dir), "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 6))


SQL["similar_vectors"] = f"with {_E} select a.vec_id key_a, b.vec_id key_b, round(least(list_inner_product(a.u, b.u), 1), 6) similarity from e a join e b on a.vec_id < b.vec_id where list_inner_product(a.u, b.u) >= 0.3"


def similarity_summary(spark, sf_dir):
    """Per group: pairs at or above a threshold, nonzero entries, density, the mean of all and of the kept, exact copies left out."""
    pairs = V.similar_pairs(_emb(spark, sf_dir), "vec_id", "embedding", 0.2, 0.0, ["label"])
    found = V.similarity_summary(_emb(spark, sf_dir), "embedding", "label", pairs)
    return found.select("label", "n", "pairs", "nonzero", *[F.round(c, 6).alias(c) for c in ("density", "mean_all", "mean", "most")])


SQL["similarity_summary"] = f"""
  with {_E}, p as (select a.label, least(greatest(list_inner_product(a.u, b.u), 0), 1) s from e a join e b on a.vec_id < b.vec_id and a.label = b.label),
  c as (select label, count(*) n from e group by 1), q as (select a.label, avg(list_inner_product(a.u, b.u)) m from e a join e b on a.vec_id <> b.vec_id and a.label = b.label group by 1),
  k as (select label, count(*) pairs, avg(s) filter (where s < 0.999999) as mean, max(s) most from p where s >= 0.2 group by 1)
  select label, n, pairs, n + 2 * pairs nonzero, round((n + 2 * pairs) / (n * n), 6) density, round(m, 6) mean_all, round(mean, 6) mean, round(most, 6) most from c join q using (label) join k using (label)"""


def nearest_vectors(spark, sf_dir):
    """The 25 nearest vectors of the same label."""
    return V.nearest(_emb(spark, sf_dir), "vec_id", "embedding", 25, ["label"]).select("label", "key", "place", "neighbour", F.round("similarity", 6).alias("similarity"))


SQL["nearest_vectors"] = f"""
  with {_E}, p as (select a.label, a.vec_id as key, b.vec_id neighbour, list_inner_product(a.u, b.u) s from e a join e b on a.vec_id <> b.vec_id and a.label = b.label)
  select label, key, row_number() over (partition by key order by round(s, 9) desc, neighbour)::int place, neighbour, round(s, 6) similarity from p qualify place <= 25"""


def centred_norms(spark, sf_dir):
    """Squared length of every vector as it is, less the mean, and less the mean weighted by label."""
    raw = _emb(spark, sf_dir)
    mean, weighted = V.centred(raw, "embedding", "mean"), V.centred(raw, "embedding", "population", F.col("label") + 1)
    one = lambda df, name: df.select("vec_id", F.round(V.dot("embedding", "embedding"), 6).alias(name))
    return one(raw, "raw").join(one(mean, "centred"), "vec_id").join(one(weighted, "weighted"), "vec_id")


SQL["centred_norms"] = f"""
  with {_E}, x as (select vec_id, label, unnest(v) x, generate_subscripts(v, 1) k from e), m as (select k, avg(x) m, sum(x * (label + 1)) / sum(label + 1) w from x group by 1)
  select vec_id, round(sum(x * x), 6) raw, round(sum((x - m) * (x - m)), 6) centred, round(sum((x - w) * (x - w)), 6) weighted from x join m using (k) group by 1"""


def gram_row_sums(spark, sf_dir):
    return V.row_sums(_emb(spark, sf_dir), "vec_id", "embedding").select("vec_id", F.round("row_sum", 5).alias("row_sum"))


SQL["gram_row_sums"] = f"""
  with {_E}, x as (select vec_id, unnest(v) x, generate_subscripts(v, 1) k from e), t as (select k, sum(x) t from x group by 1)
  select vec_id, round(sum(x * t) - sum(x * x), 5) row_sum from x join t using (k) group by 1"""


def label_means(spark, sf_dir):
    """The mean vector of every label at length 1: its cosine to each of its members."""
    rows = _emb(spark, sf_dir)
    means = rows.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("m")).select("label", V.unit(F.transform("m", lambda s: s["x"])).alias("mean"))
    return rows.join(means, "label").select("vec_id", "label", F.round(V.dot(V.unit("embedding"), "mean"), 6).alias("cosine"))


SQL["label_means"] = f"""
  with {_E}, x as (select vec_id, label, unnest(u) ux, unnest(v) x, generate_subscripts(v, 1) k from e), m as (select label, k, avg(x) m from x group by 1, 2),
  n as (select label, sqrt(sum(m * m)) n from m group by 1)
  select vec_id, label, round(sum(ux * m) / any_value(n), 6) cosine from x join m using (label, k) join n using (label) group by 1, 2"""


def fixed_pairs(spark, sf_dir):
    """Cosines of a fixed list of pairs; a missing side is flagged."""
    pairs = spark.createDataFrame([(k, k, (k * 7 + 3) % 600) for k in range(0, 600, 50)], "pair int, a bigint, b bigint")
    side = lambda name: _emb(spark, sf_dir).select(F.col("vec_id").alias(name), V.unit("embedding").alias(f"v{name}"))
    found = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return found.select("pair", "a", "b", F.round(V.dot("va", "vb"), 6).alias("cosine"), (F.col("va").isNull() | F.col("vb").isNull()).alias("missing"))


SQL["fixed_pairs"] = f"""
  with {_E}, p as (select (k * 50)::int pair, k * 50 a, (k * 50 * 7 + 3) % 600 b from range(12) t(k))
  select pair, p.a, p.b, round(list_inner_product(x.u, y.u), 6) cosine, x.u is null or y.u is null missing from p left join e x on x.vec_id = p.a left join e y on y.vec_id = p.b"""


def smoothed_membership(spark, sf_dir):
    """Event counts by user and type spread to similar types, types being similar by their first letters."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("value"))
    kinds = counts.select("event_type").distinct()
    pairs = kinds.select(F.col("event_type").alias("key_a"), F.lit(1).alias("j")).join(kinds.select(F.col("event_type").alias("key_b"), F.lit(1).alias("j")), "j").where("key_a < key_b")
    similarity = pairs.select("key_a", "key_b", (1.0 / (1.0 + F.levenshtein("key_a", "key_b"))).alias("similarity")).where("similarity >= 0.15")
    return V.smoothed(counts, similarity, "user_id", "event_type").withColumn("value", F.round("value", 6))


SQL["smoothed_membership"] = """
  with c as (select user_id, event_type, count(*)::double as value from events group by 1, 2), k as (select distinct event_type from c),
  s as (select a.event_type a, b.event_type b, 1.0 / (1.0 + levenshtein(a.event_type, b.event_type)) s from k a, k b where a.event_type <> b.event_type and 1.0 / (1.0 + levenshtein(a.event_type, b.event_type)) >= 0.15),
  u as (select * from c union all select user_id, b, value * s from c join s on a = event_type)
  select user_id, event_type, round(sum(value), 6) as value from u group by 1, 2"""


def popularity_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "characters").groupBy("id").agg(F.max("favourites").alias("favourites"))
    return V.popularity_weights(rows, "favourites").select("id", "favourites", F.round("weight", 6).alias("weight"))


SQL["popularity_weights"] = """
  with r as (select id, max(favourites) favourites, ln(1 + coalesce(max(favourites), 0)) w from characters group by 1)
  select id, favourites, round(w / (select avg(w) from r where w > 0), 6) weight from r"""


def _label_sets(spark, sf_dir):
    """Vectors as sets: eight neighbouring ids of one label are an item, weighted by their first values."""
    rows = _emb(spark, sf_dir).select("label", F.floor(F.col("vec_id") / 8).alias("item"), "vec_id", V.unit("embedding").alias("v"), F.abs(F.element_at("embedding", 1).cast("double")).alias("weight"))
    kept = V.top_weights(rows.select(F.concat_ws(":", "label", "item").alias("row"), "vec_id", "weight"), "row", "vec_id", "weight", 6)
    joined = kept.join(rows.select("vec_id", "label", "item", "v"), "vec_id")
    each = F.array_sort(F.collect_list(F.struct("vec_id", "weight", "v")))
    packed = joined.groupBy("label", "item").agg(each.alias("x"))
    return packed.select("label", "item", F.transform("x", lambda s: s["weight"]).alias("weights"), F.transform("x", lambda s: s["v"]).alias("vectors"))


_SETS = f"""{_E}, w as (select label, vec_id // 8 item, vec_id, u, abs(v[1]) w from e where abs(v[1]) > 1e-6),
  k as (select * from w qualify row_number() over (partition by label, item order by w desc, vec_id) <= 6),
  s as (select label, item, vec_id, u, w / sum(w) over (partition by label, item) w, count(*) over (partition by label, item) n from k),
  c as (select a.label, a.item item_a, b.item item_b, a.vec_id va, b.vec_id vb, a.w wa, b.w wb, a.n na, b.n nb, least(greatest(1 - list_inner_product(a.u, b.u), 0), 2) c from s a join s b on a.label = b.label and a.item < b.item),
  l as (select label, item_a, item_b, va, any_value(wa) w, any_value(na) n, min(c) c from c group by 1, 2, 3, 4), r as (select label, item_a, item_b, vb, any_value(wb) w, any_value(nb) n, min(c) c from c group by 1, 2, 3, 4)"""


def soft_set_distances(spark, sf_dir):
    return V.set_distances(_label_sets(spark, sf_dir), "item", "label").withColumn("distance", F.round("distance", 6))


SQL["soft_set_distances"] = f"""
  with {_SETS} select label, item_a, item_b, round(0.5 * (x.d + y.d), 6) distance from (select label, item_a, item_b, sum(w * c) d from l group by 1, 2, 3) x join (select label, item_a, item_b, sum(w * c) d from r group by 1, 2, 3) y using (label, item_a, item_b)"""


def best_match_distances(spark, sf_dir):
    return V.set_distances(_label_sets(spark, sf_dir), "item", "label", weighted=False).withColumn("distance", F.round("distance", 6))


SQL["best_match_distances"] = f"""
  with {_SETS} select label, item_a, item_b, round(0.5 * (x.d + y.d), 6) distance from (select label, item_a, item_b, avg(c) d from l group by 1, 2, 3) x join (select label, item_a, item_b, avg(c) d from r group by 1, 2, 3) y using (label, item_a, item_b)"""


def nearest_sets(spark, sf_dir):
    """The 8 nearest sets of the same label to each set, itself first."""
    found = V.nearest_by_distance(V.set_distances(_label_sets(spark, sf_dir), "item", "label"), "label")
    return found.withColumn("distance", F.round("distance", 6))


SQL["nearest_sets"] = f"""
  with {_SETS}, d as (select label, item_a, item_b, 0.5 * (x.d + y.d) d from (select label, item_a, item_b, sum(w * c) d from l group by 1, 2, 3) x join (select label, item_a, item_b, sum(w * c) d from r group by 1, 2, 3) y using (label, item_a, item_b)),
  b as (select label, item_a item, item_b neighbour, d from d union all select label, item_b, item_a, d from d), z as (select * from b union all select distinct label, item, item, 0.0 from b)
  select label, item, row_number() over (partition by label, item order by round(d, 9), item <> neighbour, neighbour)::int place, neighbour, round(d, 6) distance from z qualify place <= 8"""


def affinities(spark, sf_dir):
    """Affinity exp(-d / median) between the sets of a label, with the label's degrees' smallest, median and largest."""
    d = V.set_distances(_label_sets(spark, sf_dir), "item", "label")
    median = d.where("distance > 0").groupBy("label").agg(F.percentile("distance", F.lit(0.5)).alias("median"))
    scale = F.greatest(F.coalesce("median", F.lit(1.0)), F.lit(1e-6))
    pairs = d.join(median, "label", "left").select("label", "item_a", "item_b", F.exp(-F.col("distance") / scale).alias("a"))
    degrees = pairs.select("label", F.col("item_a").alias("item"), "a").unionByName(pairs.select("label", F.col("item_b").alias("item"), "a")).groupBy("label", "item").agg(F.sum("a").alias("degree"))
    return degrees.groupBy("label").agg(*[F.round(f, 5).alias(n) for f, n in ((F.min("degree"), "least"), (F.percentile("degree", F.lit(0.5)), "median"), (F.max("degree"), "most"))])


SQL["affinities"] = f"""
  with {_SETS}, d as (select label, item_a, item_b, 0.5 * (x.d + y.d) d from (select label, item_a, item_b, sum(w * c) d from l group by 1, 2, 3) x join (select label, item_a, item_b, sum(w * c) d from r group by 1, 2, 3) y using (label, item_a, item_b)),
  m as (select label, greatest(quantile_cont(d, 0.5), 1e-6) m from d where d > 0 group by 1), a as (select label, item_a, item_b, exp(-d / m) a from d join m using (label)),
  g as (select label, item, sum(a) g from (select label, item_a item, a from a union all select label, item_b, a from a) group by 1, 2)
  select label, round(min(g), 5) least, round(quantile_cont(g, 0.5), 5) median, round(max(g), 5) most from g group by 1"""

QUERIES |= {
    "similar_vectors": similar_vectors, "similarity_summary": similarity_summary, "nearest_vectors": nearest_vectors, "centred_norms": centred_norms, "gram_row_sums": gram_row_sums,
    "label_means": label_means, "fixed_pairs": fixed_pairs, "smoothed_membership": smoothed_membership, "popularity_weights": popularity_weights,
    "soft_set_distances": soft_set_distances, "best_match_distances": best_match_distances, "nearest_sets": nearest_sets, "affinities": affinities,
}
