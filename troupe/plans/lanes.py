"""Lane profiles over the order tables: entity = supplier, item = order, topic = brand, term = type."""

from __future__ import annotations

from pyspark.sql import functions as F

from troupe.functions.text import informative
from troupe.operators import lanes
from troupe.operators.facts import latest_by
from troupe.plans import Query
from troupe.runtime import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _lines(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"), F.col("p_type").alias("term"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("item"), "l_partkey", "l_quantity").join(part, "l_partkey")


def _share(lines):
    return lanes.shares(lines, "item", "topic", "l_quantity")


LINES = "select l_suppkey entity, l_orderkey item, p_brand topic, p_type term, l_quantity qty from lineitem join part on p_partkey = l_partkey"
SHARE = "select item, topic, case when sum(v) over (partition by item) > 0 then v / sum(v) over (partition by item) else 0 end share from (select item, topic, sum(qty) v from l group by 1, 2)"
SCORES = f"""
  l as ({LINES}), sh as ({SHARE}), m as (select distinct entity, item from l),
  g as (select topic, sum(share) / (select count(distinct item) from sh) global_mean from sh group by 1),
  n as (select entity, count(*) n from m group by 1),
  lo as (select entity, topic, sum(share) s, count(*) filter (where share >= 0.03) support from m join sh using (item) group by 1, 2),
  sc as (select entity, topic, support, s / n as mean, global_mean, (s / n + 0.0025) / (global_mean + 0.0025) enrichment,
                (s / n + 0.0025) / (global_mean + 0.0025) * ln(1 + support) score from lo join n using (entity) join g using (topic) where support >= 2),
  pr as (select *, row_number() over (partition by entity order by score desc, topic) place from
         (select entity, topic, support, round(mean, 5) mean, round(global_mean, 5) global_mean, round(enrichment, 5) enrichment, round(score, 5) score from sc))"""


def lane_profiles(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lanes.lane_profiles(lanes.lane_scores(lines, _share(lines), "entity", "item", "topic"), "entity", "topic")


SQL["lane_profiles"] = f"with {SCORES} select entity, topic, support, mean, global_mean, enrichment, score, place from pr where place <= 16"


def lane_evidence(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lanes.lane_evidence(lines, _share(lines), "entity", "item", "topic").withColumn("share", F.round("share", 6))


SQL["lane_evidence"] = f"""
  with {SCORES}, e as (select entity, topic, item, share, row_number() over (partition by entity, topic order by share desc, item) place from m join sh using (item))
  select entity, topic, place, item, round(share, 6) share from e where place <= 16 and share >= 0.03"""


def lane_descriptors(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    terms = lines.groupBy("item", "term").agg(F.sum("l_quantity").alias("value"))
    components = lines.groupBy("topic", "term").agg(F.sum("l_quantity").alias("weight"))
    found = lanes.lane_descriptors(lines, _share(lines), terms, components, "entity", "item", "topic", "term")
    return found.withColumn("share", F.round("share", 5))


SQL["lane_descriptors"] = f"""
  with {SCORES}, it as (select item, term, sum(qty) value from l group by 1, 2), co as (select topic, term, sum(qty) weight from l group by 1, 2),
  su as (select entity, topic, item from m join sh using (item) where share >= 0.03),
  ct as (select entity, topic, term, sum(value) * any_value(weight) contribution from su join it using (item) join co using (topic, term) group by 1, 2, 3),
  rk as (select *, contribution / sum(contribution) over (partition by entity, topic) share, row_number() over (partition by entity, topic order by contribution desc, term) place from ct)
  select entity, topic, term, place, contribution, round(share, 5) share from rk where place <= 14"""


def sample_profiles(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    top = lanes.lane_profiles(lanes.lane_scores(lines, _share(lines), "entity", "item", "topic"), "entity", "topic").groupBy("entity").agg(F.count("*").alias("lanes"), F.max("score").alias("top_score"))
    sizes = lines.groupBy("entity").agg(F.count_distinct("item").alias("items"), F.count("*").alias("roles"))
    return lanes.sample_profiles(top.join(sizes, "entity"), "entity")


SQL["sample_profiles"] = f"""
  with {SCORES}, t as (select entity, count(*) lanes, max(score) top_score from pr where place <= 16 group by 1), z as (select entity, count(distinct item) items, count(*) roles from l group by 1)
  select entity, lanes, top_score, items, roles from t join z using (entity) where items >= 10 and roles >= 20 order by top_score desc, items desc, roles desc, entity limit 40"""


def _topic_terms(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("topic", "term").agg(F.sum("l_quantity").alias("weight"))


_TT = f"with l as ({LINES}), tt as (select topic, term, sum(qty) weight from l group by 1, 2)"


def topic_mass_terms(spark, sf_dir):
    found = lanes.mass_prefix(_topic_terms(spark, sf_dir), "topic", "term", "weight")
    return found.select("topic", "place", "term", F.round("share", 6).alias("share"), F.round("covered", 6).alias("covered"))


SQL["topic_mass_terms"] = f"""
  {_TT}, s as (select topic, term, weight / sum(weight) over (partition by topic) share, row_number() over (partition by topic order by weight desc, term) place, weight from tt),
  c as (select *, sum(share) over (partition by topic order by place) covered from s)
  select topic, place, term, round(share, 6) share, round(covered, 6) covered from c where weight > 0 and round(covered - share, 12) < 0.9"""


def topic_top_terms(spark, sf_dir):
    return lanes.top_positive(_topic_terms(spark, sf_dir), "topic", "term", "weight", 18)


SQL["topic_top_terms"] = f"{_TT} select topic, row_number() over (partition by topic order by weight desc, term) place, term, weight from tt qualify place <= 18 and weight > 0"


def topic_relative_terms(spark, sf_dir):
    found = lanes.relative_weights(_topic_terms(spark, sf_dir), "topic", "term", "weight", 18, informative("term", 6))
    return found.withColumn("relative", F.round("relative", 6))


SQL["topic_relative_terms"] = f"""
  {_TT}, r as (select topic, term, weight, weight / max(weight) over (partition by topic) relative from tt)
  select topic, row_number() over (partition by topic order by weight desc, term) place, term, round(relative, 6) relative from r
  where list_max(list_transform(string_split(term, ' '), lambda x: len(x))) >= 6 qualify place <= 18"""


def topic_gaps(spark, sf_dir):
    ranked = lanes.top_positive(_topic_terms(spark, sf_dir), "topic", "term", "weight", None)
    return lanes.gaps(ranked, "topic", "place", "weight").select("topic", "place", "weight", "gap")


SQL["topic_gaps"] = f"""
  {_TT}, p as (select topic, weight, row_number() over (partition by topic order by weight desc, term) place from tt qualify weight > 0)
  select topic, place, weight, lead(weight) over (partition by topic order by place) - weight gap from p"""


def amplitude_prefix(spark, sf_dir):
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return lanes.amplitude_prefix(values, "vec_id", "dim", "x").groupBy("vec_id").agg(F.count("*").alias("kept"), F.round(F.max("covered"), 6).alias("covered"))


SQL["amplitude_prefix"] = """
  with v as (select vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 dim from embeddings),
  s as (select vec_id, dim, x, x * x / sum(x * x) over (partition by vec_id) share, row_number() over (partition by vec_id order by abs(x) desc, dim) place from v),
  c as (select *, sum(share) over (partition by vec_id order by place) covered from s)
  select vec_id, count(*) kept, round(max(covered), 6) covered from c where round(covered - share, 12) < 0.99 group by 1"""


def lane_sizes(spark, sf_dir):
    """Lanes of the credit data: characters, total weight and the share of the heaviest, each delivery once."""
    rows = latest_by(table(spark, sf_dir, "lane_weights"), ["seiyuu_id", "topic", "character_id"], "loaded_at").where("topic_weight is not null and not isnan(topic_weight)")
    each = rows.groupBy("seiyuu_id", "topic").agg(F.count("*").alias("characters"), F.sum(F.col("topic_weight").cast("decimal(18,6)")).cast("double").alias("total"), F.max("topic_weight").alias("most"))
    # of a total of 0 the share is NaN or infinite, as IEEE division and the SQL have it; Spark's division would raise;
    # rounded as there, after the product
    most = F.col("most")
    share = F.when(F.col("total") != 0, most / F.col("total")).when(most == 0, float("nan")).otherwise(F.signum(most) * F.lit(float("inf")))
    return each.select("seiyuu_id", "topic", "characters", "total", (F.round(share * 1e6) / 1e6).alias("most_share"))


SQL["lane_sizes"] = """
  with r as (select distinct on (seiyuu_id, topic, character_id) * from lane_weights order by seiyuu_id, topic, character_id, loaded_at desc)
  select seiyuu_id, topic, count(*) characters, sum(topic_weight::decimal(18, 6))::double total, round(max(topic_weight) / sum(topic_weight::decimal(18, 6))::double, 6) most_share
  from r where topic_weight is not null and not isnan(topic_weight) group by 1, 2"""

def labelled_topics(spark, sf_dir):
    """The topics of the lanes with the labels that are known: nations stand for labels, delivered twice, of which the later counts."""
    topics = table(spark, sf_dir, "lane_weights").where("topic is not null").groupBy("topic").agg(F.count_distinct("character_id").alias("characters"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("topic"), "n_name", "n_regionkey")
    made = [nations.select("topic", F.lit(k).alias("seq"), label.alias("label"), F.lit(text).alias("description"), F.when(F.col("n_regionkey") > 1, "high").alias("confidence"), F.array(F.lower("n_name")).alias("evidence_terms")) for k, label, text in ((0, F.lit("older"), "x"), (1, F.col("n_name"), None))]
    found = lanes.labelled_topics(topics, made[0].unionByName(made[1]), "topic", "seq")
    return found.withColumn("evidence_terms", F.array_join("evidence_terms", ","))


SQL["labelled_topics"] = """
  with t as (select topic, count(distinct character_id) characters from lane_weights where topic is not null group by 1)
  select topic, characters, coalesce(n_name, '') as label, '' description, case when n_regionkey > 1 then 'high' else '' end confidence, coalesce(lower(n_name), '') evidence_terms from t left join nation on n_nationkey = topic"""

QUERIES |= {
    "labelled_topics": labelled_topics,
    "lane_profiles": lane_profiles, "lane_evidence": lane_evidence, "lane_descriptors": lane_descriptors, "sample_profiles": sample_profiles, "topic_mass_terms": topic_mass_terms,
    "topic_top_terms": topic_top_terms, "topic_relative_terms": topic_relative_terms, "topic_gaps": topic_gaps, "amplitude_prefix": amplitude_prefix, "lane_sizes": lane_sizes,
}
