"""Matching items across catalogues by normalised name keys.

Overlap of key sets is never tested pair by pair: keys are exploded on both sides and joined on equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troupe.functions.names import keys_b, norm_a, norm_b, title_tokens


def map_works(roles: DataFrame, ids: DataFrame) -> DataFrame:
    """(role_id, works array): the other catalogue's ids of a role's works, sorted and distinct. roles: (role_id, work_id, mal_id); ids:
    (work_id, mal_id, target_id), of which the highest target counts where an id repeats. A work's own id goes before its mal_id;
    ids that are null or 0 match nothing."""
    nonzero = lambda c: (F.coalesce(F.col(c), F.lit(0)) != 0) & (F.coalesce("target_id", F.lit(0)) != 0)
    own = ids.where(nonzero("work_id")).groupBy("work_id").agg(F.max("target_id").alias("own"))
    other = ids.where(nonzero("mal_id")).groupBy("mal_id").agg(F.max("target_id").alias("other"))
    found = roles.join(own, "work_id", "left").join(other, "mal_id", "left").select("role_id", F.coalesce("own", "other").alias("target"))
    return found.where("target is not null").groupBy("role_id").agg(F.array_sort(F.collect_set("target")).alias("works"))


def match_cast(roles: DataFrame, cast: DataFrame) -> DataFrame:
    """(role_id, work_id, cast_id, matched_by, candidates): the cast row of each role with a name key in common in the same work. Rows
    whose voice actor shares a key too go first, then by work and place in the cast; candidates counts all rows.

    roles: (role_id, works array, keys array, person_keys array); cast: (work_id, cast_id, place, keys array, person_keys array)."""
    left = roles.select("role_id", F.explode("works").alias("work_id"), "keys", "person_keys").select("role_id", "work_id", F.explode("keys").alias("key"), "person_keys")
    right = cast.select("work_id", "cast_id", "place", F.explode("keys").alias("key"), F.col("person_keys").alias("their_keys"))
    person = F.coalesce(F.arrays_overlap("person_keys", "their_keys"), F.lit(False))
    pairs = left.join(right, ["work_id", "key"]).groupBy("role_id", "work_id", "cast_id", "place").agg(F.max(person).alias("person"))
    return (
        pairs.groupBy("role_id")
        .agg(F.count("*").alias("candidates"), F.min_by(F.struct("work_id", "cast_id", "person"), F.struct(~F.col("person"), "work_id", "place", "cast_id")).alias("x"))
        .select("role_id", "x.work_id", "x.cast_id", F.when(F.col("x.person"), "name+person+work").otherwise("name+work").alias("matched_by"), "candidates")
    )


def filter_traits(traits, max_spoiler: int = 1, include_sexual: bool = False):
    """Traits that are no lies, not above the spoiler level and not sexual unless asked for."""
    return F.filter(
        traits,
        lambda t: ~F.coalesce(t["lie"], F.lit(False))
        & (F.coalesce(t["spoiler"], F.lit(0)) <= max_spoiler)
        & (F.lit(include_sexual) | ~F.coalesce(t["sexual"], F.lit(False))),
    )


def best_candidates(local: DataFrame, candidates: DataFrame) -> DataFrame:
    """(local_id, candidate_id, overlap, n_traits): for each local item the candidate that shares a name key: most traits, then most
    title words in common, then the smallest id. An item of one word, whose own title has words, needs a common title word.

    local: (local_id, name, title); candidates: (candidate_id, names array, titles array, n_traits)."""
    l = local.select("local_id", keys_b("name").alias("keys"), F.size(F.split(norm_b("name"), " ")).alias("n_words"), F.coalesce(title_tokens("title"), F.array().cast("array<string>")).alias("words"))  # noqa: E741
    c = candidates.select("candidate_id", "n_traits", F.explode("names").alias("name"), "titles").where("name is not null")
    c = c.select("candidate_id", "n_traits", F.explode(keys_b("name")).alias("key"), F.array_distinct(F.flatten(F.transform("titles", lambda t: title_tokens(t)))).alias("their_words"))
    pairs = l.select("local_id", F.explode("keys").alias("key"), "n_words", "words").join(c, "key")
    overlap = F.coalesce(F.size(F.array_intersect("words", "their_words")), F.lit(0))
    scored = pairs.withColumn("overlap", overlap).where(~((F.col("n_words") < 2) & (F.size("words") > 0) & (F.col("overlap") == 0)))
    best = F.min_by(F.struct("candidate_id", "overlap", "n_traits"), F.struct(-F.col("n_traits"), -F.col("overlap"), "candidate_id"))
    return scored.groupBy("local_id").agg(best.alias("x")).select("local_id", "x.*")


def of_persons(roles: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Roles of persons who share a name key with one of the `wanted` names (name)."""
    keys = wanted.select(F.explode(keys_b("name")).alias("_key")).distinct()
    persons = roles.select(name).distinct().withColumn("_key", F.explode(keys_b(name))).join(keys, "_key", "left_semi").select(name).distinct()
    return roles.join(persons, name, "left_semi")


def find_profiles(profiles: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Profiles (id, aliases array, place) that a search finds: an equal alias goes first, then one that contains the query or is
    contained in it, each in profile order; a blank query finds nothing. The query is brought into the form that aliases have."""
    wanted = norm_a(F.lit(query))
    alike = F.exists("aliases", lambda a: F.contains(a, wanted) | F.contains(wanted, a))
    rank = F.when(F.array_contains("aliases", wanted), 0).when(alike, 1)
    return profiles.withColumn("rank", F.when(wanted != "", rank)).where("rank is not null").orderBy("rank", "place").limit(limit)


def suggested_profiles(profiles: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """The first profiles with an alias that contains what has been typed; none for a blank query."""
    wanted = norm_a(F.lit(query))
    return profiles.where((wanted != "") & F.exists("aliases", lambda a: F.contains(a, wanted))).orderBy("place").limit(limit)


def order_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two row lists has, or that have another place in each: (key, place_left, place_right)."""
    both = left.select(key, F.col("place").alias("place_left")).join(right.select(key, F.col("place").alias("place_right")), key, "full_outer")
    return both.where(~F.col("place_left").eqNullSafe(F.col("place_right")))


def first_deliveries(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by `order`, the columns in their order; combined before it is moved."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_x")).select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in df.columns])
