"""The queries of the training-data operators, over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from troupe.llm import clusters, frequencies, languages, linkage, packing, set_join, tokens, top_n, vectors
from troupe.runtime import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def _tags(column: str = "llm_tags") -> Column:
    """All tags of a record over its categories."""
    return F.flatten(F.filter(F.map_values(column), lambda x: x.isNotNull())).getField("tag")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_n.top_n_per_group(table(spark, sf_dir, "lane_weights"), ["seiyuu_id", "topic"], "topic_weight", "character_id", 5, "favourites")
    return top.select("seiyuu_id", "topic", "character_id")


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n.top_n_per_group(table(spark, sf_dir, "lane_weights"), ["seiyuu_id", "topic"], "topic_weight", "character_id", 5, "favourites")


def p4_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tagged = table(spark, sf_dir, "tagged_characters").select("anilist_character_id", _tags().alias("tags"))
    return set_join.similar_set_pairs(tagged, "anilist_character_id", "tags", 0.6)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = set_join.expand_pairs(*p4_pairs(spark, sf_dir))
    return found.select(F.col("id_a").alias("character_id_a"), F.col("id_b").alias("character_id_b"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = set_join.linked_records(*p4_pairs(spark, sf_dir))
    return found.select(F.col("id").alias("character_id"), "class_id", "links")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = table(spark, sf_dir, "tagged_characters").select("anilist_character_id", _tags().alias("tags"))
    tags = frequencies.term_frequencies(tagged, "anilist_character_id", "tags")
    ngrams = frequencies.term_frequencies(table(spark, sf_dir, "ngram_documents"), "character_id", "ngrams", table(spark, sf_dir, "tfidf_vocabulary"))
    return tags.select(F.lit("tag").alias("kind"), "*").unionByName(ngrams.select(F.lit("ngram").alias("kind"), "*"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_counts(spark, sf_dir).where("mark is not null").select("kind", "term", "mark")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "p3_found": p3_found,
    "p3_top": p3_top,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p7_ids": p7_ids,
}

_WIDE = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
_NARROW = "abcdefghijklmnopqrstuvwxyz"


def _term_sql(x: str) -> str:
    """The canonical form, for text whose only compatibility characters are wide letters and special spaces."""
    return f"nullif(trim(regexp_replace(translate(lower({x}), '{_WIDE}', '{_NARROW}'), '[-_\\s\\x{{00a0}}\\x{{3000}}]+', ' ', 'g')), '')"


_TAG_TERMS = f"""
  select id, {_term_sql("t.tag")} term from (
    select id, unnest(tags) t from (select anilist_character_id id, any_value(flatten(map_values(llm_tags))) tags from tagged_characters group by 1))"""

_TOP_SQL = """
  select seiyuu_id, topic, character_id, topic_weight, coalesce(favourites, 0)::double favourites,
         row_number() over (partition by seiyuu_id, topic order by topic_weight desc, coalesce(favourites, 0) desc, character_id)::int rank
  from (select distinct seiyuu_id, topic, character_id, topic_weight, favourites from lane_weights)
  where topic_weight is not null and not isnan(topic_weight)
  qualify rank <= 5"""

_COUNTS_SQL = f"""
  with t as ({_TAG_TERMS}),
  g as (select id, {_term_sql("ngram")} term from (select id, unnest(ngrams) ngram from (select character_id id, any_value(ngrams) ngrams from ngram_documents group by 1))),
  u as (select 'tag' kind, id, term from t where term is not null union all select 'ngram', id, term from g where term is not null),
  n as (select kind, count(distinct id) total from u group by 1),
  c as (select kind, term, count(*) occurrences, count(distinct id) records from u group by 1, 2
        union all select distinct 'ngram', {_term_sql("ngram")}, 0, 0 from tfidf_vocabulary),
  s as (select kind, term, sum(occurrences)::bigint occurrences, sum(records)::bigint records from c where term is not null group by 1, 2)
  select kind, term, occurrences, records, case when records < 3 then 'rare' when records > 0.45 * total then 'common' end mark
  from s join n using (kind)"""

_PAIRS_SQL = f"""
  with s as (select distinct id, term from ({_TAG_TERMS}) where term is not null),
  n as (select id, count(*) n from s group by 1),
  p as (select a.id character_id_a, b.id character_id_b, count(*) shared from s a join s b on a.term = b.term and a.id < b.id group by 1, 2)
  select character_id_a, character_id_b from p join n x on x.id = character_id_a join n y on y.id = character_id_b
  where shared >= 0.6 * (x.n + y.n - shared) - 1e-9"""

_LINKS_SQL = f"""
  with s as (select distinct id, term from ({_TAG_TERMS}) where term is not null), n as (select id, count(*) n, list(term order by term) terms from s group by 1),
  c as (select id, min(id) over (partition by terms) class_id from n), p as ({_PAIRS_SQL}),
  l as (select id, count(*) links from (select character_id_a id from p union all select character_id_b from p) group by 1)
  select id character_id, class_id, coalesce(links, 0) links from c left join l using (id)"""

ORACLE_SQL: dict[str, str] = {
    "p4_links": _LINKS_SQL,
    "p3_found": f"select seiyuu_id, topic, character_id from ({_TOP_SQL})",
    "p3_top": _TOP_SQL,
    "p4_found": _PAIRS_SQL,
    "p6_found": f"select kind, term, mark from ({_COUNTS_SQL}) where mark is not null",
    "p6_counts": _COUNTS_SQL,
}


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "semantic_features").select("character_id", F.col("features.feature").alias("features"))
    return clusters.similarity_clusters(features, "character_id", "features", 0.5)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_clusters(spark, sf_dir).select("cluster_id", F.col("id").alias("character_id"))


def p5_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_clusters(spark, sf_dir).where("typical is not null").select("cluster_id", "size", "typical", F.col("id").alias("character_id"))


QUERIES |= {"p5_found": p5_found, "p5_typical": p5_typical}

# clusters as groups around the smallest id, which is the same wherever similarity is transitive, as in these data
ORACLE_SQL["p5_found"] = f"""
  with f as (select id, {_term_sql("t.feature")} term from (select id, unnest(fs) t from (select character_id id, any_value(features) fs from semantic_features group by 1))),
  s as (select distinct id, term from f where term is not null),
  n as (select id, count(*) n from s group by 1),
  p as (select a.id a, b.id b, count(*) shared from s a join s b on a.term = b.term group by 1, 2),
  l as (select a, min(b) cluster_id from p join n x on x.id = a join n y on y.id = b where shared >= 0.5 * (x.n + y.n - shared) - 1e-9 group by 1)
  select cluster_id, a character_id from l qualify count(*) over (partition by cluster_id) >= 3"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest_pairs(table(spark, sf_dir, "descriptor_vectors"), "vector_id", "embedding", 10, 0.85)
    return near.select(F.least("id", "neighbour").alias("vector_id"), F.greatest("id", "neighbour").alias("neighbour_id")).distinct()


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest_to(table(spark, sf_dir, "descriptor_vectors"), "vector_id", "embedding", 100, 10)
    return near.select(F.col("id").alias("vector_id"), "rank", F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"))


QUERIES |= {"p2_found": p2_found, "p2_nearest": p2_nearest}

_VECTORS_SQL = """
  select vector_id id, any_value(embedding)::double[] v from descriptor_vectors
  where len(embedding) = 64 and isfinite(list_sum(embedding::double[])) and list_max(embedding) > list_min(embedding)
  group by 1"""

ORACLE_SQL["p2_found"] = f"""
  with v as ({_VECTORS_SQL}),
  p as (select a.id, b.id neighbour, list_cosine_similarity(a.v, b.v) cosine from v a join v b on a.id <> b.id),
  t as (select * from p qualify row_number() over (partition by id order by cosine desc, neighbour) <= 10)
  select distinct least(id, neighbour) vector_id, greatest(id, neighbour) neighbour_id from t where cosine >= 0.85"""


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"))
    packed = packing.fill_containers(sizes, "doc_id", "tokens", table(spark, sf_dir, "context_windows"), "window_name", "capacity_tokens")
    return packed.select(F.col("bin").alias("window_name"), "container_id", F.col("id").alias("doc_id"), "part", F.col("start").alias("start_token"), F.col("size").alias("tokens"))


def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of container: documents, their parts that were split although they fit, documents of which a part is missing or twice, and
    containers that hold more than their capacity."""
    sizes = materialize(tokens.token_counts(table(spark, sf_dir, "documents")), "token-counts")
    windows = table(spark, sf_dir, "context_windows").select(F.col("window_name").alias("bin"), F.col("capacity_tokens").alias("capacity"))
    packed = materialize(packing.fill_containers(sizes, "doc_id", "tokens", table(spark, sf_dir, "context_windows"), "window_name", "capacity_tokens"), "packed")
    whole = packed.groupBy("bin", F.col("id").alias("doc_id")).agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max(F.col("start") + F.col("size")).alias("end"))
    each = whole.join(sizes, "doc_id").join(windows, "bin")
    wrong = (F.col("size") != F.col("tokens")) | (F.col("end") != F.col("tokens"))
    documents = each.groupBy("bin").agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("split"), F.count_if(wrong).alias("wrong"))
    full = packed.groupBy("bin", "container_id").agg(F.sum("size").alias("used")).join(windows, "bin").groupBy("bin").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    return documents.join(full, "bin").withColumnRenamed("bin", "window_name")


ORACLE_SQL["p8_rules"] = "select window_name, count(*) documents, 0::bigint split, 0::bigint wrong, 0::bigint overfull from context_windows, documents group by 1"

QUERIES |= {"p8_containers": p8_containers, "p8_rules": p8_rules}


def _codes(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The codes to answer with: a fixed small table, from which the model's columns are made; one of more than 1,000 languages is refused."""
    codes = [(r["lang"], r["language_name"]) for r in table(spark, sf_dir, "language_codes").where("lang is not null").distinct().orderBy("lang").limit(1001).collect()]
    if len(codes) > 1000:
        raise ValueError("more than 1,000 languages")
    return codes


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = languages.wrong_languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", _codes(spark, sf_dir))
    return wrong.select(F.col("id").alias("doc_id"), F.explode("languages").alias("lang")).distinct()


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = languages.fit_model(documents, "doc_id", "text", "lang", _codes(spark, sf_dir))
    return languages.language_segments(documents, "doc_id", "text", model).withColumnRenamed("id", "doc_id")


QUERIES |= {"p9_found": p9_found, "p9_segments": p9_segments}


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = linkage.link_entities(
        table(spark, sf_dir, "characters"), table(spark, sf_dir, "anidb_cast"), "id", "anidb_character_id", "name", "native_name", "gender",
        ["first_anime", "window_first_anime"], "anime_title", "anidb_anime_id", "updated_at",
    )
    return links.select(F.col("a").alias("character_id"), F.col("b").alias("anidb_character_id"), "confidence")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_links(spark, sf_dir).select("character_id", "anidb_character_id")


QUERIES |= {"p1_found": p1_found, "p1_links": p1_links}
