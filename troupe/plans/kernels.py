"""Factorisations, spectra, clusters and poles.

Spectra and factors have no closed form in SQL, but what must hold for them does: traces, squared norms, orthogonality, distances.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from troupe.operators import kernels as K
from troupe.operators import lanes as L
from troupe.operators import vectors as V
from troupe.plans import Query
from troupe.plans.vectors import _E, _SETS, _label_sets
from troupe.runtime import materialize, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _affinity(spark, sf_dir):
    d = materialize(V.set_distances(_label_sets(spark, sf_dir), "item", "label"), "set-distances")
    median = d.where("distance > 0").groupBy("label").agg(F.percentile("distance", F.lit(0.5)).alias("m"))
    return d.join(median, "label").select("label", "item_a", "item_b", F.exp(-F.col("distance") / F.greatest("m", F.lit(1e-6))).alias("value"))


_AFF = f"""{_SETS}, d as (select label, item_a, item_b, 0.5 * (x.d + y.d) d from (select label, item_a, item_b, sum(w * c) d from l group by 1, 2, 3) x join (select label, item_a, item_b, sum(w * c) d from r group by 1, 2, 3) y using (label, item_a, item_b)),
  m as (select label, greatest(quantile_cont(d, 0.5), 1e-6) m from d where d > 0 group by 1), a as (select label, item_a, item_b, exp(-d / m) a from d join m using (label)),
  g as (select label, item, sum(a) g from (select label, item_a item, a from a union all select label, item_b, a from a) group by 1, 2)"""


def spectral_clusters(spark, sf_dir):
    """Clusters of the sets of each label by their spectral coordinates: items, clusters, the largest label and the squared length of the first
    coordinate, which is that of an eigenvector."""
    found = K.spectral_clusters(_affinity(spark, sf_dir), "label")
    return found.groupBy("label").agg(F.count("*").alias("items"), F.count_distinct("cluster").alias("clusters"), F.max("cluster").alias("most"), F.round(F.sum(F.col("coordinate") * F.col("coordinate")), 6).alias("length"))


SQL["spectral_clusters"] = f"""
  with {_AFF}, n as (select label, count(*) n from g group by 1)
  select label, n items, case when n <= 2 then 1 else least(8, n) end clusters, case when n <= 2 then 1 else least(8, n) end::bigint most, 1.0::double length from n"""


def laplacian_spectrum(spark, sf_dir):
    """The spectrum of each label's normalised Laplacian: its size, sum, sum of squares and least value."""
    found = K.laplacian_spectrum(_affinity(spark, sf_dir), "label")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("eigenvalue"), 6).alias("total"), F.round(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), 6).alias("squares"), F.round(F.abs(F.min("eigenvalue")), 6).alias("least"))


SQL["laplacian_spectrum"] = f"""
  with {_AFF}, n as (select label, count(*) n from g group by 1), q as (select a.label, sum(2 * a.a * a.a / (x.g * y.g)) s from a join g x on x.label = a.label and x.item = a.item_a join g y on y.label = a.label and y.item = a.item_b group by 1)
  select label, n, n::double total, round(n + s, 6) squares, 0.0::double least from n join q using (label)"""


def vector_map(spark, sf_dir):
    """Coordinates of each label's vectors from their distances alone: the squared distance from the middle, over all axes."""
    rows = table(spark, sf_dir, "embeddings")
    pairs = V.similar_pairs(rows, "vec_id", "embedding", -1.0, groups=["label"])
    d = pairs.select("label", F.col("key_a").alias("item_a"), F.col("key_b").alias("item_b"), F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0))).alias("value"))
    found = K.mds(d, "label", None)
    return found.groupBy("label", F.col("item").alias("vec_id")).agg(F.round(F.sum(F.col("coordinate") * F.col("coordinate")), 5).alias("radius2"))


SQL["vector_map"] = f"""
  with {_E}, x as (select label, vec_id, unnest(u) x, generate_subscripts(u, 1) k from e), m as (select label, k, avg(x) m from x group by 1, 2)
  select label, vec_id, round(sum((x - m) * (x - m)), 5) radius2 from x join m using (label, k) group by 1, 2"""


def _units(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", V.unit("embedding").alias("v"))


def _pivots(spark, sf_dir, priority):
    found = K.pivot_basis(_units(spark, sf_dir), "label", "vec_id", "v", priority)
    return found.select("label", "vec_id", "rank", F.round("pivot", 6).alias("pivot"), F.round("trace_share", 6).alias("trace_share"), F.round("left", 6).alias("left"), "place")


def pivot_basis(spark, sf_dir):
    """The pivoted basis of each label's centred vectors, by what is left of them; pivots first, then the others."""
    return _pivots(spark, sf_dir, "residual")


def pivot_basis_by_sums(spark, sf_dir):
    """The same by what is left times the shifted row sums."""
    return _pivots(spark, sf_dir, "row_sum_residual")


def _pivot_sql(score: str) -> str:
    """Deflation step by step, the vectors of a label being one row."""
    return f"""{_E}, x as (select label, vec_id, unnest(u) x, generate_subscripts(u, 1) k from e), mk as (select label, k, avg(x) m, sum(x) t from x group by 1, 2),
  mv as (select label, list(m order by k) m, list(t order by k) t from mk group by 1),
  rs as (select label, vec_id, list_inner_product(u, t) - list_inner_product(u, u) s, list_transform(list_zip(u, m), lambda z: z[1] - z[2]) b from e join mv using (label)),
  sh as (select *, s - least(min(s) over (partition by label), 0) s0 from rs), sc as (select *, s0 / greatest(max(s0) over (partition by label), 1e-12) s1 from sh),
  st as (select label, list(vec_id order by vec_id) ids, list(s1 order by vec_id) s, list(b order by vec_id) r from sc group by 1),
  p as (
    select label, ids, s, r, list_transform(r, lambda v: list_inner_product(v, v)) n, 0 rank, null::bigint vec_id, null::double "pivot", null::double trace_share, list_sum(list_transform(r, lambda v: list_inner_product(v, v))) whole from st
    union all
    select label, ids, s, r2, list_transform(r2, lambda v: list_inner_product(v, v)), rank + 1, ids[best], n[best], list_sum(list_transform(r2, lambda v: list_inner_product(v, v))) / whole, whole
    from (select *, list_transform(r, lambda v: list_transform(list_zip(v, r[best]), lambda z: z[1] - z[2] * list_inner_product(v, r[best]) / n[best])) r2
      from (select *, list_position(score, list_max(score)) best from (select *, list_transform(list_zip(n, s), lambda z: case when z[1] > 1e-12 then round({score}, 9) else -1e300 end) score from p)))
    where n[best] > 1e-12 and list_sum(n) > 1e-6 * whole and rank < least(len(ids), 64)),
  fin as (select label, unnest(ids) vec_id, unnest(n) left_ from p qualify row_number() over (partition by label order by rank desc) = 1)"""


_PLACED = """select f.label, f.vec_id, p.rank::bigint rank, round(p."pivot", 6) "pivot", round(p.trace_share, 6) trace_share, round(f.left_, 6) as left,
    row_number() over (partition by f.label order by p.rank nulls last, round(f.left_, 9) desc, f.vec_id)::int place from fin f left join p on p.label = f.label and p.vec_id = f.vec_id"""
SQL["pivot_basis"] = f"with recursive {_pivot_sql('z[1]')} {_PLACED}"
SQL["pivot_basis_by_sums"] = f"with recursive {_pivot_sql('z[1] * z[2]')} {_PLACED}"


def nearest_pivots(spark, sf_dir):
    rows = _units(spark, sf_dir)
    pivots = K.pivot_basis(rows, "label", "vec_id", "v").where("rank is not null")
    return K.nearest_pivots(rows, pivots, "label", "vec_id", "v").withColumn("cosine", F.round("cosine", 6))


SQL["nearest_pivots"] = f"""
  with recursive {_pivot_sql("z[1]")}, c as (select a.label, a.vec_id, b.vec_id pivot_key, list_inner_product(a.u, b.u) cosine from e a join p on p.label = a.label and p.rank > 0 join e b on b.vec_id = p.vec_id)
  select label, vec_id, pivot_key, round(cosine, 6) cosine from c qualify row_number() over (partition by label, vec_id order by round(abs(cosine), 9) desc, pivot_key) = 1"""


def _variants(spark, sf_dir):
    """Four vectors of neighbouring ids as variants of one descriptor."""
    rows = table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 4)).alias("descriptor"), "label", "vec_id", V.unit("embedding").alias("v"))
    packed = rows.groupBy("descriptor").agg(F.min("label").alias("label"), F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("x"))
    return packed.where(F.size("x") == 4).select("label", "descriptor", F.transform("x", lambda s: s["v"]).alias("variants"))


# the largest eigenvalue of a 4 x 4 matrix m, by squaring it 30 times
_EIGEN = """
  pw as (select id, list_transform(m, lambda x: x / t) m, ln(t) s, 0 i from (select id, m, m[1] + m[6] + m[11] + m[16] t from mm)
    union all select id, list_transform(m2, lambda x: x / t), 2 * s + ln(t), i + 1 from (select id, m2, m2[1] + m2[6] + m2[11] + m2[16] t, s, i from
      (select id, list_transform(range(16), lambda j: list_sum(list_transform(range(4), lambda k: m[(j // 4) * 4 + k + 1] * m[k * 4 + (j % 4) + 1]))) m2, s, i from pw where i < 30))),
  ev as (select id, exp(s / pow(2, 30)) value from pw where i = 30)"""
_VARIANTS = f"""{_E}, va as (select vec_id // 4 descriptor, min(label) label, list(u order by vec_id) v from e group by 1 having count(*) = 4)"""


def variant_coherence(spark, sf_dir):
    """How much the variants of a descriptor agree, and the distance that it leaves."""
    found = _variants(spark, sf_dir).select("descriptor", K.coherence_of("variants").alias("c"))
    return found.select("descriptor", F.round("c", 6).alias("coherence"), F.round(1 - F.col("c"), 6).alias("distance"))


SQL["variant_coherence"] = f"""
  with recursive {_VARIANTS}, mm as (select descriptor id, list_transform(range(16), lambda j: list_inner_product(v[j // 4 + 1], v[j % 4 + 1])) m from va), {_EIGEN}
  select id descriptor, round(value / 4, 6) coherence, round(1 - value / 4, 6) distance from ev"""


def variant_overlaps(spark, sf_dir):
    """The overlap of all pairs of a label's descriptors by their variants, with the unit diagonal."""
    return K.variant_overlaps(_variants(spark, sf_dir), "label", "descriptor").withColumn("overlap", F.round("overlap", 6))


SQL["variant_overlaps"] = f"""
  with recursive {_VARIANTS}, cc as (select a.label, a.descriptor a, b.descriptor b, list_transform(range(16), lambda j: list_inner_product(a.v[j // 4 + 1], b.v[j % 4 + 1])) c from va a join va b on a.label = b.label and a.descriptor < b.descriptor),
  mm as (select struct_pack(label := label, a := a, b := b) id, list_transform(range(16), lambda j: list_sum(list_transform(range(4), lambda k: c[(j // 4) * 4 + k + 1] * c[(j % 4) * 4 + k + 1]))) m from cc), {_EIGEN}
  select id.label, id.a key_a, id.b key_b, round(sqrt(value) / 4, 6) overlap from ev union all select label, descriptor, descriptor, 1.0 from va"""


def local_components(spark, sf_dir):
    """All components of the labels' sets (eight neighbouring ids) in the basis of all their vectors, each a term: per label their number, the sum of
    their squared singular values, and the least and largest squared length of their sides of items."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 8).alias("item"), F.col("vec_id").alias("term"))
    basis = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("term"), F.col("embedding").alias("vector"))
    found = K.local_svd(rows, basis, "label", "item", "term", None)
    each = found.where("side = 'item' and singular > 1e-6").groupBy("label", "component").agg(F.first("singular").alias("s"), F.sum(F.col("amplitude") * F.col("amplitude")).alias("length"))
    return each.groupBy("label").agg(F.round(F.sum(F.col("s") * F.col("s")), 5).alias("energy"), F.round(F.min("length"), 6).alias("least"), F.round(F.max("length"), 6).alias("most"))


SQL["local_components"] = f"""
  with {_E}, x as (select label, vec_id // 8 item, unnest(u) x, generate_subscripts(u, 1) k from e), s as (select label, item, k, sum(x) s from x group by 1, 2, 3)
  select label, round(sum(s * s), 5) energy, 1.0::double least, 1.0::double most from s group by 1"""


def topic_factors(spark, sf_dir):
    """Topics of the characters' n-grams: the shares of 8 factors of the term weights, for every character."""
    from troupe.plans.text import tfidf_ngrams

    w, _, _ = K.factorise(tfidf_ngrams(spark, sf_dir), "character_id", "term", "value", 8, tolerance=1e-4)
    total = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x)
    return w.select("character_id", F.transform("weights", lambda x: F.when(total > 0, F.round(x / total, 4)).otherwise(0.0)).alias("shares"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))


def reconstruction_check(spark, sf_dir):
    """What the model of independence predicts of the users' counts by type of event: the cells, the share above 0.5, the largest prediction, the
    error and the density."""
    import pandas as pd

    cells = materialize(_events(spark, sf_dir), "event-cells")
    w = cells.groupBy("user_id").agg(F.array(F.sum("n")).alias("weights"))
    sums = {r["event_type"]: r["n"] for r in cells.groupBy("event_type").agg(F.sum("n").alias("n")).collect()}  # a row for each type
    h = pd.DataFrame({"event_type": list(sums), "weights": [[x / sum(sums.values())] for x in sums.values()]})
    got = K.reconstruction_diagnostics(cells, w, h, "user_id", "event_type", "n", 0.5)
    rows = [(part, int(got[f"{part}_n"]), round(got[f"{part}_above"], 6), round(got[f"{part}_most"], 6), round(got["error"], 6), round(got["density"], 6)) for part in ("zero", "nonzero")]
    return spark.createDataFrame(rows, "part string, n bigint, above double, most double, error double, density double").where("n > 0")


SQL["reconstruction_check"] = """
  with c as (select user_id, event_type, count(*)::double n from events group by 1, 2), w as (select user_id, sum(n) w from c group by 1), h as (select event_type, sum(n) / (select sum(n) from c) h from c group by 1),
  p as (select coalesce(n, 0) n, w * h p, n is not null seen from w cross join h left join c using (user_id, event_type))
  select case when seen then 'nonzero' else 'zero' end part, count(*) n, round(avg((p > 0.5)::int), 6) above, round(max(p), 6) most,
    (select round(sqrt(sum((n - p) * (n - p))) / sqrt(sum(n * n)), 6) from p) error, (select round(avg(seen::int), 6) from p) density from p group by 1"""


def factor_size(spark, sf_dir):
    """The number of factors that a sweep selects."""
    cells = materialize(_events(spark, sf_dir), "event-cells")
    rows = []
    for k in (2, 3, 4):
        w, h, errors = K.factorise(cells, "user_id", "event_type", "n", k, tolerance=1e-3)
        got = K.reconstruction_diagnostics(cells, w, h, "user_id", "event_type", "n")
        rows.append((k, got["zero_q99"], got["zero_above"], got["nonzero_above"], round(errors[-1], 6)))
    return K.select_size(spark.createDataFrame(rows, "k int, leakage double, zero_fraction double, recall double, error double"))


def _popularity(spark, sf_dir):
    """(character_id, loading): how far a character's popularity is from the mean, in logarithms."""
    rows = table(spark, sf_dir, "characters").where("id is not null").groupBy(F.col("id").alias("character_id")).agg(F.log1p(F.coalesce(F.max("favourites"), F.lit(0)).cast("double")).alias("p"))
    return rows.join(F.broadcast(rows.agg(F.avg("p").alias("m")))).select("character_id", (F.col("p") - F.col("m")).alias("loading"))


_POP = "po as (select id character_id, ln(1 + coalesce(max(favourites), 0)) p from characters where id is not null group by 1), pl as (select character_id, p - (select avg(p) from po) loading from po)"
_FEAT = """ff as (select distinct character_id, x.feature feature from (select character_id, unnest(fs) x from (select character_id, max(features) fs from semantic_features where character_id is not null group by 1)) where x.feature is not null and trim(x.feature) <> '')"""


def component_poles(spark, sf_dir):
    """Characters at either pole of popularity: a feature's loading is that of the characters who have it, on average."""
    from troupe.plans.text import _features

    member = _features(spark, sf_dir).select("character_id", "feature").distinct()
    loadings = member.join(_popularity(spark, sf_dir), "character_id").groupBy("feature").agg(F.round(F.avg("loading"), 9).alias("loading"))
    rows = [K.poles(member, loadings, "character_id", "feature", s).withColumn("sign", F.lit(s)) for s in (1, -1)]
    return rows[0].unionByName(rows[1]).select("sign", "place", "character_id", "support", *[F.round(c, 6).alias(c) for c in ("pole", "opposing", "purity", "score")])


SQL["component_poles"] = f"""
  with {_POP}, {_FEAT}, lo as (select feature, round(avg(loading), 9) loading from ff join pl using (character_id) group by 1), s as (select unnest([1, -1]) sign), r as (select sign, character_id, sign * loading v from ff join lo using (feature), s),
  p as (select sign, character_id, sum(greatest(v, 0)) pole, sum(greatest(-v, 0)) opposing, count(*) filter (where v > 0) support from r group by 1, 2 having support > 0),
  q as (select *, pole / (pole + opposing) purity, pole * sqrt(support) * pole / (pole + opposing) score from p)
  select sign, row_number() over (partition by sign order by round(score, 12) desc, character_id)::int place, character_id, support, round(pole, 6) pole, round(opposing, 6) opposing, round(purity, 6) purity, round(score, 6) score
  from q qualify place <= 12"""


def pooled_pole(spark, sf_dir):
    """The features that popular characters have most of, with the characters who give most."""
    from troupe.plans.text import _features

    weights = _features(spark, sf_dir).groupBy("character_id", "feature").agg(F.count("*").cast("double").alias("value"))
    found = K.pooled_pole(weights, _popularity(spark, sf_dir).withColumn("loading", F.round("loading", 9)), "character_id", "feature")
    return found.select("feature", F.round("pooled", 6).alias("pooled"), F.round("share", 6).alias("share"), "place", F.array_join(F.transform("contributors", lambda x: x["character_id"].cast("string")), ",").alias("contributors"))


SQL["pooled_pole"] = f"""
  with {_POP}, w as (select character_id, x.feature feature, count(*)::double v from (select character_id, unnest(fs) x from (select character_id, max(features) fs from semantic_features where character_id is not null group by 1)) where x.feature is not null and trim(x.feature) <> '' group by 1, 2),
  r as (select character_id, feature, v * round(loading, 9) part from w join pl using (character_id) where round(loading, 9) > 0), s as (select feature, sum(part) pooled from r group by 1),
  t as (select feature, pooled, pooled / (select sum(pooled) from s) share, row_number() over (order by round(pooled, 10) desc, feature)::int place from s where pooled > 0 qualify place <= 24),
  k as (select feature, character_id, row_number() over (partition by feature order by round(part, 10) desc, character_id) k from r qualify k <= 8)
  select feature, round(pooled, 6) pooled, round(share, 6) share, place, string_agg(character_id::varchar, ',' order by k) contributors from t join k using (feature) group by 1, 2, 3, 4"""


def loading_summary(spark, sf_dir):
    """The first value of the vectors by label: size, mean, least and most, by the amount of the mean."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.element_at("embedding", 1).cast("double").alias("loading"))
    return K.loading_summary(rows).select("cluster", "size", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most")], "place")


SQL["loading_summary"] = """
  with s as (select label as cluster, count(*) size, round(avg(embedding[1]::double), 8) mean, min(embedding[1]::double) least, max(embedding[1]::double) most from embeddings group by 1)
  select cluster, size, round(mean, 6) mean, round(least, 6) least, round(most, 6) most, row_number() over (order by abs(mean) desc, cluster)::int place from s"""


def signed_sides(spark, sf_dir):
    """Characters above and below the mean popularity, each side by how far."""
    genders = table(spark, sf_dir, "characters").groupBy(F.col("id").alias("character_id")).agg(F.coalesce(F.max("gender"), F.lit("")).alias("gender"))
    rows = _popularity(spark, sf_dir).join(genders, "character_id").withColumn("loading", F.round("loading", 9))
    return K.signed_sides(rows, "gender", "character_id", "loading").select("gender", "character_id", F.round("loading", 6).alias("loading"), "side", "place")


SQL["signed_sides"] = f"""
  with {_POP}, g as (select id character_id, coalesce(max(gender), '') gender from characters where id is not null group by 1), v as (select gender, character_id, round(loading, 9) loading from pl join g using (character_id))
  select gender, character_id, round(loading, 6) loading, case when loading >= 0 then 'positive' else 'negative' end side,
    row_number() over (partition by gender, loading >= 0 order by round(abs(loading), 10) desc, character_id)::int place from v"""


def lane_order(spark, sf_dir):
    """Topics by the sum of the weights of their 18 heaviest characters."""
    rows = table(spark, sf_dir, "lane_weights").where("topic_weight is not null and not isnan(topic_weight)").groupBy("topic", "character_id").agg(F.max("topic_weight").alias("loading"))
    return K.lane_order(L.top_positive(rows, "topic", "character_id", "loading", 18), "topic").withColumn("total", F.round("total", 6))


SQL["lane_order"] = """
  with r as (select topic, character_id, max(topic_weight) w from lane_weights where topic_weight is not null and not isnan(topic_weight) group by 1, 2),
  t as (select topic, w from r qualify row_number() over (partition by topic order by w desc, character_id) <= 18 and w > 0), s as (select topic, sum(w) total from t group by 1)
  select topic, round(total, 6) total, row_number() over (order by round(total, 9) desc, topic)::int place from s"""


def cluster_features(spark, sf_dir):
    """Heaviest terms of groups of characters, by the last digit of their id, over all, style and facet features."""
    from troupe.operators.ngrams import feature_channels
    from troupe.plans.text import _features

    rows = _features(spark, sf_dir)
    labels = rows.select("character_id").distinct().withColumn("cluster", F.pmod("character_id", F.lit(10)))
    weights = rows.groupBy("character_id", "feature").agg(F.count("*").cast("double").alias("value"))
    return K.cluster_features(labels, weights, feature_channels(rows), "character_id", "feature")


SQL["cluster_features"] = """
  with f as (select character_id, x.feature feature, x.kind kind, x.lexname lexname from (select character_id, unnest(fs) x from (select character_id, max(features) fs from semantic_features where character_id is not null group by 1)) where x.feature is not null and trim(x.feature) <> ''),
  c as (select feature, count(*) filter (where lexname like 'adj.%') + count(*) filter (where kind = 'attribute_modifier') + count(*) filter (where kind = 'morphological_like') style, count(*) filter (where lexname like 'noun.%' and lexname <> 'noun.attribute') noun from f group by 1),
  z as (select character_id % 10 as cluster, count(distinct character_id) size from f group by 1), w as (select character_id % 10 as cluster, feature, count(*)::double weight from f group by 1, 2),
  b as (select cluster, feature, weight, unnest(['all', case when style > 0 and style > noun then 'style' else 'facet' end]) channel from w join c using (feature))
  select cluster, size, channel, row_number() over (partition by cluster, channel order by weight desc, feature)::int place, feature, weight from b join z using (cluster) where size >= 2 qualify place <= 14"""

QUERIES |= {
    "spectral_clusters": spectral_clusters, "laplacian_spectrum": laplacian_spectrum, "vector_map": vector_map, "pivot_basis": pivot_basis, "pivot_basis_by_sums": pivot_basis_by_sums,
    "nearest_pivots": nearest_pivots, "variant_coherence": variant_coherence, "variant_overlaps": variant_overlaps, "local_components": local_components, "topic_factors": topic_factors,
    "reconstruction_check": reconstruction_check, "factor_size": factor_size, "component_poles": component_poles, "pooled_pole": pooled_pole, "loading_summary": loading_summary,
    "signed_sides": signed_sides, "lane_order": lane_order, "cluster_features": cluster_features,
}
