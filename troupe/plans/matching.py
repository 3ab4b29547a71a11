"""Name keys, crosswalks, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from troupe.functions import names as N
from troupe.functions.text import slug
from troupe.operators import facts, matching
from troupe.plans import Query
from troupe.plans.facts import DIMENSION, EDGES, PAIRS
from troupe.runtime import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_B = "trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9 ]+', ' ', 'g')), '\\s+', ' ', 'g'))"
_A = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _keys_sql(norm: str, c: bool = False) -> str:
    p = f"string_split({norm}, ' ')"
    more = f", case when len({p}) > 2 then array_to_string({p}[1:2], ' ') end, case when len({p}) > 2 then array_to_string(list_sort({p}[1:2]), ' ') end" if c else ""
    return f"list_filter([{norm}, array_to_string(list_reverse({p}), ' '), array_to_string(list_sort({p}), ' '){more}], lambda x: x is not null and x <> '')"


def name_keys(spark, sf_dir):
    """The three normal forms of every character's name and their keys."""
    rows = facts.character_dimension(table(spark, sf_dir, "characters"))
    joined = lambda x: F.array_join(F.array_sort(x), "|")
    return rows.select(
        "character_id", N.norm_a("name").alias("norm_a"), N.norm_b("name").alias("norm_b"), joined(N.keys_a("name")).alias("keys_a"), joined(N.keys_b("name")).alias("keys_b"),
        joined(N.keys_c("name", decode=False)).alias("keys_c"), joined(N.search_aliases("name", "native_name")).alias("aliases"), slug("name").alias("slug"),
    )


def _joined(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), '|')"


_DIM_NORM = f"d as ({DIMENSION}), n as (select *, {_A.format('name')} na, {_B.format('name')} nb, {_A.format('native_name')} nn from d)"
SQL["name_keys"] = f"""
  with {_DIM_NORM}
  select character_id, na norm_a, nb norm_b,
    {_joined("list_filter([na, case when len(string_split(na, ' ')) >= 2 then array_to_string(list_reverse(string_split(na, ' ')), ' ') end], lambda x: x <> '')")} keys_a,
    {_joined(_keys_sql("nb"))} keys_b, {_joined(_keys_sql("nb", True))} keys_c,
    {_joined("list_filter([na, nn, case when len(string_split(na, ' ')) >= 2 then array_to_string(list_reverse(string_split(na, ' ')), ' ') end], lambda x: x <> '')")} aliases,
    coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'value') slug from n"""


def shared_names(spark, sf_dir):
    """Name keys that several characters share."""
    rows = facts.character_dimension(table(spark, sf_dir, "characters")).select("character_id", F.explode(N.keys_b("name")).alias("key"))
    return rows.groupBy("key").agg(F.count_distinct("character_id").alias("characters"), F.min("character_id").alias("first_id")).where("characters > 1")


SQL["shared_names"] = f"with {_DIM_NORM}, k as (select character_id, unnest({_keys_sql('nb')}) as key from n) select key, count(distinct character_id) characters, min(character_id) first_id from k group by 1 having characters > 1"


def _ids(spark, sf_dir):
    """Works of both catalogues with equal titles: the crosswalk of ids."""
    ours = table(spark, sf_dir, "credit_edges").select(F.col("anime_id").alias("work_id"), F.col("mal_anime_id").alias("mal_id"), F.lower(F.trim("anime_title")).alias("title")).distinct()
    theirs = table(spark, sf_dir, "anidb_cast").select(F.col("anidb_anime_id").alias("target_id"), F.lower(F.trim("anime_title")).alias("title")).distinct()
    return ours.where("title <> ''").join(theirs, "title").select("work_id", "mal_id", "target_id").distinct()


_IDS = """ids as (select distinct o.work_id, o.mal_id, t.target_id from (select distinct anime_id work_id, mal_anime_id mal_id, lower(trim(anime_title)) title from credit_edges) o
  join (select distinct anidb_anime_id target_id, lower(trim(anime_title)) title from anidb_cast) t using (title) where title <> ''),
  own as (select work_id, max(target_id) own from ids where coalesce(work_id, 0) <> 0 group by 1), oth as (select mal_id, max(target_id) other from ids where coalesce(mal_id, 0) <> 0 group by 1)"""
_ROLE_WORKS = f"""ro as (select distinct character_id role_id, anime_id work_id, mal_anime_id mal_id from credit_edges where character_id is not null),
  rw as (select distinct role_id, coalesce(own, other) target from ro left join own using (work_id) left join oth using (mal_id) where coalesce(own, other) is not null)"""


def _role_works(spark, sf_dir):
    roles = table(spark, sf_dir, "credit_edges").where("character_id is not null").select(F.col("character_id").alias("role_id"), F.col("anime_id").alias("work_id"), F.col("mal_anime_id").alias("mal_id")).distinct()
    return matching.map_works(roles, _ids(spark, sf_dir))


def work_crosswalk(spark, sf_dir):
    return _role_works(spark, sf_dir).select(F.col("role_id").alias("character_id"), F.array_join("works", ",").alias("works"))


SQL["work_crosswalk"] = f"with {_IDS}, {_ROLE_WORKS} select role_id character_id, string_agg(target::varchar, ',' order by target) works from rw group by 1"


def cast_matches(spark, sf_dir):
    """Characters to the other catalogue's cast by name keys within the same works, voice actors first."""
    edges = table(spark, sf_dir, "credit_edges").where("character_id is not null")
    people = edges.select(F.col("character_id").alias("role_id"), F.explode(N.keys_c(F.coalesce("seiyuu_name", F.lit("")), decode=False)).alias("k")).groupBy("role_id").agg(F.collect_set("k").alias("person_keys"))
    names = facts.character_dimension(table(spark, sf_dir, "characters")).select(F.col("character_id").alias("role_id"), N.keys_c("name", decode=False).alias("keys"))
    roles = _role_works(spark, sf_dir).join(names, "role_id").join(people, "role_id", "left")
    rows = table(spark, sf_dir, "anidb_cast").groupBy("anidb_anime_id", "anidb_character_id").agg(F.min("name").alias("name"), F.max("seiyuu").alias("seiyuu"))
    person = F.array_distinct(F.flatten(F.transform("seiyuu", lambda s: N.keys_c(F.coalesce(s["name"], F.lit("")), decode=False))))
    cast = rows.select(F.col("anidb_anime_id").alias("work_id"), F.col("anidb_character_id").alias("cast_id"), F.col("anidb_character_id").alias("place"), N.keys_c("name", decode=False).alias("keys"), person.alias("person_keys"))
    return matching.match_cast(roles, cast).withColumnRenamed("role_id", "character_id")


_BRACKETS = "regexp_replace({0}, '\\([^)]*\\)', ' ', 'g')"
SQL["cast_matches"] = f"""
  with {_IDS}, {_ROLE_WORKS}, d as ({DIMENSION}), n as (select character_id role_id, {_B.format(_BRACKETS.format("name"))} nb from d),
  rk as (select role_id, unnest({_keys_sql("nb", True)}) as key from n),
  pn as (select distinct character_id role_id, {_B.format(_BRACKETS.format("coalesce(seiyuu_name, '')"))} nb from credit_edges where character_id is not null),
  pk as (select distinct role_id, unnest({_keys_sql("nb", True)}) as pkey from pn),
  ca as (select anidb_anime_id target, anidb_character_id cast_id, {_B.format(_BRACKETS.format("min(name)"))} nb, max(seiyuu) s from anidb_cast group by 1, 2),
  ck as (select distinct target, cast_id, unnest({_keys_sql("nb", True)}) as key from ca),
  cp as (select target, cast_id, {_B.format(_BRACKETS.format("coalesce(x.name, '')"))} nb from (select target, cast_id, unnest(s) x from ca)),
  cpk as (select distinct target, cast_id, unnest({_keys_sql("nb", True)}) as pkey from cp),
  pa as (select distinct role_id, target, cast_id from rw join rk using (role_id) join ck using (target, key)),
  pp as (select pa.*, exists (select 1 from pk join cpk using (pkey) where pk.role_id = pa.role_id and cpk.target = pa.target and cpk.cast_id = pa.cast_id) person from pa)
  select role_id character_id, target work_id, cast_id, case when person then 'name+person+work' else 'name+work' end matched_by, count(*) over (partition by role_id) candidates
  from pp qualify row_number() over (partition by role_id order by person desc, target, cast_id) = 1"""


def best_candidates(spark, sf_dir):
    """Tagged characters to the cast entry that shares a name key; an entry's rows stand for its traits."""
    local = table(spark, sf_dir, "tagged_characters").groupBy("anilist_character_id").agg(F.min("name").alias("name"), F.min("first_anime").alias("title"))
    rows = table(spark, sf_dir, "anidb_cast").select("anidb_character_id", "name", "anime_title").distinct()
    cand = rows.groupBy(F.col("anidb_character_id").alias("candidate_id")).agg(F.collect_set("name").alias("names"), F.collect_set("anime_title").alias("titles"), F.count("*").alias("n_traits"))
    return matching.best_candidates(local.withColumnRenamed("anilist_character_id", "local_id"), cand)


def _title_words(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in N.TITLE_STOPWORDS)
    return f"list_filter(string_split({_B.format(x)}, ' '), lambda w: len(w) >= 3 and w not in ({stop}))"


SQL["best_candidates"] = f"""
  with lo as (select anilist_character_id local_id, min(name) as name, min(first_anime) title from tagged_characters group by 1),
  l as (select local_id, {_B.format("name")} nb, coalesce({_title_words("title")}, []) words from lo),
  lk as (select local_id, unnest({_keys_sql("nb")}) as key, len(string_split(nb, ' ')) n_words, list_distinct(words) words from l),
  r as (select distinct anidb_character_id candidate_id, name, anime_title from anidb_cast),
  ct as (select candidate_id, count(*) n_traits from r group by 1),
  tw as (select candidate_id, list(distinct w) tw from (select candidate_id, unnest({_title_words("anime_title")}) w from r) group by 1),
  cn as (select distinct candidate_id, {_B.format("name")} nb from r), ck as (select distinct candidate_id, unnest({_keys_sql("nb")}) as key from cn),
  s as (select distinct local_id, candidate_id, n_traits, len(list_intersect(words, coalesce(tw, []))) overlap, n_words, len(words) nw from lk join ck using (key) join ct using (candidate_id) left join tw using (candidate_id))
  select local_id, candidate_id, overlap::int overlap, n_traits from s where not (n_words < 2 and nw > 0 and overlap = 0)
  qualify row_number() over (partition by local_id order by n_traits desc, overlap desc, candidate_id) = 1"""


def _profiles(spark, sf_dir):
    rows = facts.character_dimension(table(spark, sf_dir, "characters"))
    return rows.select(F.col("character_id").alias("place"), N.search_aliases("name", "native_name").alias("aliases"), "name")


def _searches(spark, sf_dir):
    """What is searched for: the first names with an accented letter, typed as they are, the first without, a part of a name, and a blank."""
    rows = facts.character_dimension(table(spark, sf_dir, "characters")).where("name <> ''")
    accented = rows.where(F.col("name").rlike("[À-ſ]"))
    return [r["name"] for part in (accented, rows.where(~F.col("name").rlike("[^ -~]"))) for r in part.orderBy("character_id").select("name").limit(3).collect()] + ["Ruro", " ?! "]


def _searched(spark, sf_dir, find):
    found = None
    for text in _searches(spark, sf_dir):
        one = find(_profiles(spark, sf_dir), text).withColumn("search", F.lit(text))
        found = one if found is None else found.unionByName(one)
    return found


def person_search(spark, sf_dir):
    """Profiles that searches for names find: equal ones first."""
    return _searched(spark, sf_dir, matching.find_profiles).select("search", F.col("place").alias("character_id"), "name", "rank")


def person_suggestions(spark, sf_dir):
    """Profiles that are suggested while a name is typed."""
    return _searched(spark, sf_dir, matching.suggested_profiles).select("search", F.col("place").alias("character_id"), "name")


_SEARCH = f"""{_DIM_NORM}, al as (select character_id, name, list_distinct(list_filter([na, nn, array_to_string(list_reverse(string_split(na, ' ')), ' ')], lambda x: x <> '')) al from n),
  q0 as (select name search from (select * from d where regexp_matches(name, '[À-ſ]') order by character_id limit 3) union all select name from (select * from d where name <> '' and not regexp_matches(name, '[^ -~]') order by character_id limit 3)
    union all select 'Ruro' union all select ' ?! '), q as (select search, {_A.format("search")} q from q0)"""
SQL["person_search"] = f"""
  with {_SEARCH}, r as (select search, character_id, name, case when list_contains(al, q) then 0 when len(list_filter(al, lambda x: contains(x, q) or contains(q, x))) > 0 then 1 end rank from q, al where q <> '')
  select * from r where rank is not null qualify row_number() over (partition by search order by rank, character_id) <= 8"""
SQL["person_suggestions"] = f"""
  with {_SEARCH}, r as (select search, character_id, name from q, al where q <> '' and len(list_filter(al, lambda x: contains(x, q))) > 0)
  select * from r qualify row_number() over (partition by search order by character_id) <= 8"""


def name_order_check(spark, sf_dir):
    """Rows of two lists of the same characters whose places disagree: stored n-gram rows and tagged rows, each by id."""
    from pyspark.sql import Window

    place = lambda df, k: df.select(F.col(k).alias("character_id")).distinct().withColumn("bucket", F.pmod("character_id", F.lit(64))).withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("character_id")))
    left, right = place(table(spark, sf_dir, "ngram_documents"), "character_id"), place(table(spark, sf_dir, "tagged_characters"), "anilist_character_id")
    return matching.order_mismatches(left, right, "character_id")


SQL["name_order_check"] = """
  with l as (select character_id, row_number() over (partition by character_id % 64 order by character_id) place from (select distinct character_id from ngram_documents)),
  r as (select character_id, row_number() over (partition by character_id % 64 order by character_id) place from (select distinct anilist_character_id character_id from tagged_characters))
  select character_id, l.place::int place_left, r.place::int place_right from l full join r using (character_id) where l.place is distinct from r.place"""

QUERIES |= {
    "name_keys": name_keys, "shared_names": shared_names, "work_crosswalk": work_crosswalk, "cast_matches": cast_matches, "best_candidates": best_candidates, "person_search": person_search, "person_suggestions": person_suggestions,
    "name_order_check": name_order_check,
}
