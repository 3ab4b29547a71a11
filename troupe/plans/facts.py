"""Fact table, totals, dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from troupe.operators import facts
from troupe.plans import Query
from troupe.runtime import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EDGES = """
  select split, seiyuu_id, character_id, character_name, character_role, anime_id, anime_title, min(ingested_at) ingested_at,
         coalesce(nullif(anime_start_year, 0), nullif(anime_year, 0), nullif(anime_season_year, 0)) as yr
  from credit_edges where seiyuu_id is not null and character_id is not null
  group by split, seiyuu_id, seiyuu_name, seiyuu_native_name, character_id, character_name, character_native_name, character_gender, character_role,
           anime_start_year, anime_year, anime_season_year, anime_id, mal_anime_id, anime_title"""

SEQ = "(ingested_at, coalesce(anime_id, 0), coalesce(anime_title, ''), coalesce(split, ''))"
PAIRS = f"""
  select seiyuu_id, character_id, coalesce(arg_min_null(character_role, {SEQ}), '') character_role, coalesce(arg_min_null(character_name, {SEQ}), '') edge_name,
         count(*) credit_count, min(yr) first_year, max(yr) latest_year, array_to_string(list_sort(list_distinct(list(split))), ',') splits
  from ({EDGES}) group by 1, 2"""


def _pairs(spark, sf_dir):
    return facts.role_pairs(table(spark, sf_dir, "credit_edges"))


def fact_roles(spark, sf_dir):
    works = F.array_join(F.transform("works", lambda w: F.concat_ws("@", w["title"], w["year"].cast("string"))), "|")
    return _pairs(spark, sf_dir).select("seiyuu_id", "character_id", "character_role", "credit_count", "first_year", "latest_year", F.array_join("splits", ",").alias("splits"), works.alias("works"))


SQL["fact_roles"] = f"""
  with e as ({EDGES}), p as ({PAIRS}),
  r as (select *, row_number() over (partition by seiyuu_id, character_id order by coalesce(yr, 9999), coalesce(anime_title, ''), coalesce(anime_id, 0), split, ingested_at) k from e),
  w as (select seiyuu_id, character_id, string_agg(concat_ws('@', coalesce(anime_title, ''), yr::varchar), '|' order by k) works from r where k <= 8 group by 1, 2)
  select seiyuu_id, character_id, character_role, credit_count, first_year, latest_year, splits, works from p join w using (seiyuu_id, character_id)"""


def entity_totals(spark, sf_dir):
    return facts.entity_totals(_pairs(spark, sf_dir))


SQL["entity_totals"] = f"select seiyuu_id, sum(credit_count)::bigint role_count, count(*) character_count, min(first_year) first_year from ({PAIRS}) group by 1"


def fact_counts(spark, sf_dir):
    return facts.fact_counts(table(spark, sf_dir, "credit_edges"), _pairs(spark, sf_dir))


SQL["fact_counts"] = f"""
  select sum(credit_count)::bigint credit_edges, count(*) pairs, count(distinct seiyuu_id) entities, count(distinct character_id) characters from ({PAIRS})"""

_NAME = "case when ltrim(name) like '{%' then coalesce(nullif(trim(name->>'$.full'), ''), nullif(trim(name->>'$.userPreferred'), ''), nullif(trim(name->>'$.romaji'), '')) else nullif(trim(name), '') end"
_TITLE = "case when ltrim({0}) like '{{%' then coalesce(nullif(trim({0}->>'$.english'), ''), nullif(trim({0}->>'$.romaji'), ''), nullif(trim({0}->>'$.native'), '')) else nullif(trim({0}), '') end"
DIMENSION = f"""
  select id character_id, coalesce({_NAME}, '') as name, coalesce(native_name, '') native_name, coalesce(gender, '') gender, coalesce(favourites, 0) favourites,
         coalesce(image, '') image, coalesce(site_url, '') site_url, coalesce({_TITLE.format("first_anime")}, {_TITLE.format("window_first_anime")}, '') first_anime
  from (select distinct on (id) * from characters where id is not null order by id, updated_at desc)"""


def character_dimension(spark, sf_dir):
    return facts.character_dimension(table(spark, sf_dir, "characters"))


SQL["character_dimension"] = DIMENSION


def named_roles(spark, sf_dir):
    return facts.named_roles(_pairs(spark, sf_dir), table(spark, sf_dir, "characters")).select("seiyuu_id", *facts.payload(), "credit_count")


SQL["named_roles"] = f"""
  with e as ({EDGES}), p as ({PAIRS}), d as ({DIMENSION}),
  f as (select distinct on (seiyuu_id, character_id) seiyuu_id, character_id, nullif(coalesce(anime_title, ''), '') title, anime_id from e
        order by seiyuu_id, character_id, coalesce(yr, 9999), coalesce(anime_title, ''), coalesce(anime_id, 0), split, ingested_at)
  select p.seiyuu_id, p.character_id, coalesce(d.name, p.edge_name) as name, coalesce(d.favourites, 0) favourites, p.character_role as role,
         coalesce(f.title, d.first_anime, '') anime_title, case when coalesce(f.anime_id, 0) <> 0 then 'https://example.org/anime/' || f.anime_id else '' end anime_url, credit_count
  from p join f using (seiyuu_id, character_id) left join d using (character_id)"""


def popular_characters(spark, sf_dir):
    """Characters of at least 50 favourites, by favourites and name, with the entities that have them."""
    pairs = _pairs(spark, sf_dir).groupBy("character_id").agg(F.count("*").alias("entities"), F.min("first_year").alias("first_year"))
    chars = facts.character_dimension(table(spark, sf_dir, "characters")).where(F.col("favourites") >= 50)
    return chars.join(pairs, "character_id", "left").select("character_id", "name", "favourites", F.coalesce("entities", F.lit(0)).alias("entities"), "first_year").orderBy(F.desc("favourites"), "name")


SQL["popular_characters"] = f"""
  select d.character_id, d.name, d.favourites, coalesce(n.entities, 0) entities, n.first_year from ({DIMENSION}) d
  left join (select character_id, count(*) entities, min(first_year) first_year from ({PAIRS}) group by 1) n using (character_id) where d.favourites >= 50"""


def unknown_characters(spark, sf_dir):
    """Characters of the edges that the dimension lacks: an anti join, for referential checks."""
    return _pairs(spark, sf_dir).select("character_id").distinct().join(table(spark, sf_dir, "characters").select(F.col("id").alias("character_id")), "character_id", "left_anti")


SQL["unknown_characters"] = "select distinct character_id from credit_edges where seiyuu_id is not null and character_id not in (select id from characters where id is not null)"

def ordered_roles(spark, sf_dir):
    """Every role with its place by the entity's name and the character's name, then their ids."""
    people = facts.first_by(facts.distinct_edges(table(spark, sf_dir, "credit_edges").where("seiyuu_id is not null")).select("seiyuu_id", F.coalesce("seiyuu_name", F.lit("")).alias("seiyuu_name")), ["seiyuu_id"], ["seiyuu_name"])
    roles = facts.named_roles(_pairs(spark, sf_dir), table(spark, sf_dir, "characters")).select("seiyuu_id", "character_id", "name").join(people, "seiyuu_id")
    return facts.in_order(roles, F.asc("seiyuu_name"), F.asc("name"), F.asc("seiyuu_id"), F.asc("character_id")).select("seiyuu_id", "character_id", "seiyuu_name", "name", "place")


SQL["ordered_roles"] = f"""
  with p as ({PAIRS}), d as ({DIMENSION}), s as (select seiyuu_id, min(coalesce(seiyuu_name, '')) seiyuu_name from credit_edges where seiyuu_id is not null group by 1),
  r as (select p.seiyuu_id, p.character_id, coalesce(d.name, p.edge_name) as name, seiyuu_name from p left join d using (character_id) join s using (seiyuu_id))
  select *, row_number() over (order by seiyuu_name, name, seiyuu_id, character_id) place from r"""

_ROLE = """select character_id, seiyuu_id, coalesce(seiyuu_name, '') sn, coalesce(seiyuu_native_name, '') nn, min((ingested_at, coalesce(anime_id, 0), coalesce(anime_title, ''), coalesce(split, ''))) seq
  from credit_edges where seiyuu_id is not null and character_id is not null group by 1, 2, 3, 4"""


def unique_characters(spark, sf_dir):
    """Characters of at least 5 favourites that are voiced, with their voice actors in the order in which they are met."""
    edges = facts.distinct_edges(table(spark, sf_dir, "credit_edges").where("seiyuu_id is not null and character_id is not null"))
    dims = facts.character_dimension(table(spark, sf_dir, "characters")).where("favourites >= 5")
    order = F.struct("ingested_at", F.coalesce("anime_id", F.lit(0)), F.coalesce("anime_title", F.lit("")), F.coalesce("split", F.lit("")))
    found = facts.unique_characters(edges.select("character_id", "seiyuu_id", "seiyuu_name", "seiyuu_native_name", "ingested_at", "anime_id", "anime_title", "split").join(dims, "character_id"), order)
    people = F.array_join(F.transform("people", lambda x: F.concat_ws("/", x["seiyuu_id"].cast("string"), x["name"], x["native_name"])), "|")
    return found.select("character_id", "name", "gender", "favourites", people.alias("people"), "place")


SQL["unique_characters"] = f"""
  with d as ({DIMENSION}), e as ({_ROLE}), p as (select character_id, string_agg(concat_ws('/', seiyuu_id::varchar, sn, nn), '|' order by seq, seiyuu_id, sn, nn) people from e group by 1)
  select character_id, name, gender, favourites, people, row_number() over (order by favourites desc, name, character_id) place from d join p using (character_id) where favourites >= 5"""


def roles_of_persons(spark, sf_dir):
    """Credits of the persons who are called like one of three wanted: the first by id, names turned round."""
    from troupe.operators.matching import of_persons

    edges = table(spark, sf_dir, "credit_edges").where("seiyuu_name is not null")
    first = edges.groupBy("seiyuu_id").agg(F.min("seiyuu_name").alias("name")).orderBy("seiyuu_id").limit(3)
    wanted = first.select(F.array_join(F.reverse(F.split("name", " ")), " ").alias("name"))
    return of_persons(edges, "seiyuu_name", wanted).groupBy("seiyuu_id").agg(F.count_distinct("character_id").alias("characters"), F.count("*").alias("credits"))


SQL["roles_of_persons"] = """
  with w as (select seiyuu_id, min(seiyuu_name) as name from credit_edges where seiyuu_name is not null group by 1 order by 1 limit 3),
  n as (select distinct seiyuu_name, list_sort(string_split(trim(regexp_replace(lower(regexp_replace(seiyuu_name, '[^A-Za-z0-9 ]+', ' ', 'g')), '\\s+', ' ', 'g')), ' ')) k from credit_edges where seiyuu_name is not null),
  k as (select list_sort(string_split(trim(regexp_replace(lower(regexp_replace(name, '[^A-Za-z0-9 ]+', ' ', 'g')), '\\s+', ' ', 'g')), ' ')) k from w)
  select seiyuu_id, count(distinct character_id) characters, count(*) credits from credit_edges where seiyuu_name in (select seiyuu_name from n where k in (select k from k)) group by 1"""

QUERIES |= {
    "ordered_roles": ordered_roles, "unique_characters": unique_characters, "roles_of_persons": roles_of_persons,
    "fact_roles": fact_roles, "entity_totals": entity_totals, "fact_counts": fact_counts, "character_dimension": character_dimension, "named_roles": named_roles,
    "popular_characters": popular_characters, "unknown_characters": unknown_characters,
}
