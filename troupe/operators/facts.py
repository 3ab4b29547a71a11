"""Credit records to a fact table of entity-item pairs, with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troupe.functions.names import address, display_name, display_title, first_year
from troupe.runtime import materialize

KEPT_TITLES = 8


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: that with the highest `order`. Ties are expected to be equal rows; of others the one that sorts last is taken.
    An aggregate and no window, so that a key of many rows is combined before it is moved."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*[F.to_json(F.struct(c)) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in rest])))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*df.columns)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Credit edges, each once however often it was delivered, with the time of its first delivery."""
    keys = [c for c in edges.columns if c != "ingested_at"]
    return edges.groupBy(*keys).agg(F.min("ingested_at").alias("ingested_at"))


def character_dimension(characters: DataFrame) -> DataFrame:
    """(character_id, name, native_name, gender, favourites, image, site_url, first_anime): the latest row of every id, names and
    titles as text, blanks for nulls and 0 for missing favourites."""
    rows = latest_by(characters.where("id is not null"), ["id"], "updated_at")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        F.col("id").alias("character_id"),
        display_name("name").alias("name"),
        blank("native_name"),
        blank("gender"),
        F.coalesce("favourites", F.lit(0)).alias("favourites"),
        blank("image"),
        blank("site_url"),
        F.coalesce(F.nullif(display_title("first_anime"), F.lit("")), display_title("window_first_anime")).alias("first_anime"),
    )


def role_pairs(edges: DataFrame) -> DataFrame:
    """Edges of one (seiyuu_id, character_id) as one row: the first role, number of credits, first and latest year, sorted splits,
    and the first KEPT_TITLES works by year (unknown last) and title. First means the earliest delivery, ties by work.

    Years of 0 count as missing; edges without either id are left out; repeated edges count once."""
    rows = distinct_edges(edges.where("seiyuu_id is not null and character_id is not null")).withColumn("year", first_year("anime_start_year", "anime_year", "anime_season_year"))
    key = ["seiyuu_id", "character_id"]
    seq = F.struct("ingested_at", F.coalesce("anime_id", F.lit(0)), F.coalesce("anime_title", F.lit("")), F.coalesce("split", F.lit("")))
    totals = rows.groupBy(*key).agg(
        F.coalesce(F.min_by("character_role", seq), F.lit("")).alias("character_role"),
        F.coalesce(F.min_by("character_name", seq), F.lit("")).alias("edge_name"),
        F.count("*").alias("credit_count"),
        F.min("year").alias("first_year"),
        F.max("year").alias("latest_year"),
        F.array_sort(F.collect_set("split")).alias("splits"),
    )
    # only the kept works of a pair are ever collected
    order = [F.coalesce("year", F.lit(9999)), F.coalesce("anime_title", F.lit("")), F.coalesce("anime_id", F.lit(0)), "split", "ingested_at"]
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= KEPT_TITLES)
    work = F.struct("place", F.coalesce("anime_title", F.lit("")).alias("title"), "anime_id", "year")
    works = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(work)).alias("works"))
    return totals.join(works, key)


def named_roles(pairs: DataFrame, characters: DataFrame) -> DataFrame:
    """role_pairs() with the character's fields; a character that is missing is made from its edges, without favourites."""
    joined = pairs.join(character_dimension(characters), "character_id", "left")
    known = F.col("name").isNotNull()
    return joined.withColumn("name", F.when(known, F.col("name")).otherwise(F.col("edge_name"))).withColumn("favourites", F.coalesce("favourites", F.lit(0))).drop("edge_name")


def entity_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("seiyuu_id").agg(F.sum("credit_count").alias("role_count"), F.count("*").alias("character_count"), F.min("first_year").alias("first_year"))


def fact_counts(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: credit edges, pairs, entities and characters."""
    return pairs.agg(
        F.sum("credit_count").alias("credit_edges"), F.count("*").alias("pairs"), F.count_distinct("seiyuu_id").alias("entities"), F.count_distinct("character_id").alias("characters")
    )


def payload(role: str = "character_role", score: Column | None = None) -> list[Column]:
    """The fields that a role shows: its first work with fallbacks, and a rounded score."""
    first = F.try_element_at("works", F.lit(1))
    return [
        F.col("character_id"),
        F.col("name"),
        F.col("favourites"),
        F.col(role).alias("role"),
        F.coalesce(F.nullif(first["title"], F.lit("")), F.col("first_anime"), F.lit("")).alias("anime_title"),
        address("https://example.org/anime/", first["anime_id"]).alias("anime_url"),
        *([F.round(score, 5).alias("score")] if score is not None else []),
    ]


def unique_characters(roles: DataFrame, order: Column) -> DataFrame:
    """(character_id, attributes, people, place) of roles (character_id, name, native_name, gender, first_anime, favourites, site_url, seiyuu_id,
    seiyuu_name, seiyuu_native_name): every character once with the attributes of its first role by `order`, and the distinct voice actors
    (seiyuu_id, name, native_name) in the order in which they are met; `place` is by favourites descending, then name, then id."""
    attributes = ["name", "native_name", "gender", "first_anime", "favourites", "site_url"]
    person = F.struct("seiyuu_id", F.coalesce("seiyuu_name", F.lit("")).alias("name"), F.coalesce("seiyuu_native_name", F.lit("")).alias("native_name"))
    each = roles.select("character_id", order.alias("_order"), F.struct(*attributes).alias("x"), person.alias("person")).groupBy("character_id", "person").agg(F.min("_order").alias("_order"), F.min_by("x", "_order").alias("x"))
    met = F.array_sort(F.collect_list(F.struct("_order", "person")))
    found = each.groupBy("character_id").agg(F.min_by("x", F.struct("_order", "person")).alias("x"), F.transform(met, lambda m: m["person"]).alias("people"))
    found = found.select("character_id", "x.*", "people").withColumn("favourites", F.coalesce("favourites", F.lit(0)))
    return in_order(found, F.desc("favourites"), F.asc("name"), F.asc("character_id"))


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """df with `place`, from 1, in the whole table's order. The rows are sorted over all partitions by range; only the partitions' sizes are
    brought together to number them."""
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    placed = materialize(placed, "ordered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before", "_first")
    return placed.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_before", "_first")
