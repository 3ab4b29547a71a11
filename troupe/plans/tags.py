"""Tags: counts, cleaning, validation, merging, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from troupe.functions.names import display_name
from troupe.functions.tagging import rule_tag
from troupe.functions.text import APOSTROPHE_WORD, evidence_in, normalize_source, tag_key, words
from troupe.operators import tags as T
from troupe.plans import Query
from troupe.plans.text import _RULE_TAG
from troupe.runtime import table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ITEM = "anilist_character_id"

_SRC = "select anilist_character_id, arg_max(llm_tags, coalesce(cardinality(llm_tags), -1)) t from tagged_characters where anilist_character_id is not null group by 1"
_LT = f"""lt as (select anilist_character_id, category, x.tag tag, x.evidence evidence, x.confidence confidence, place from (
  select anilist_character_id, category, unnest(t[category]) x, generate_subscripts(t[category], 1) - 1 place from (select anilist_character_id, t, unnest(map_keys(t)) category from ({_SRC}))))"""


def _tags(spark, sf_dir):
    return T.long_tags(table(spark, sf_dir, "tagged_characters"), ITEM, "llm_tags")


def tag_counts(spark, sf_dir):
    return T.tag_counts(_tags(spark, sf_dir), ITEM)


SQL["tag_counts"] = f"""
  with {_LT} select category, tag, count(*) occurrences, count(distinct anilist_character_id) items, row_number() over (partition by category order by count(*) desc, tag)::int place
  from lt where tag is not null group by 1, 2"""


def tag_categories(spark, sf_dir):
    return T.category_values(_tags(spark, sf_dir), ITEM)


SQL["tag_categories"] = f"with {_LT} select category, count(distinct tag) tags, count(distinct anilist_character_id) items, count(*) total from lt where tag is not null group by 1"


def tag_membership(spark, sf_dir):
    """Characters with their number of distinct tags, those without any included."""
    rows = T.membership(_tags(spark, sf_dir), table(spark, sf_dir, "tagged_characters").where(f"{ITEM} is not null"), ITEM)
    return rows.groupBy(ITEM).agg(F.count("tag").alias("tags"))


SQL["tag_membership"] = f"""
  with {_LT}, m as (select distinct anilist_character_id, tag from lt where tag is not null)
  select anilist_character_id, count(tag) tags from (select distinct anilist_character_id from tagged_characters where anilist_character_id is not null) left join m using (anilist_character_id) group by 1"""


def _verbs(spark):
    return spark.createDataFrame([("wears",), ("loves",), ("has",), ("is",), ("wanted",), ("hates",)], "token string")


def clean_tags(spark, sf_dir):
    """Descriptors of every character after cleaning: characters by descriptor."""
    return T.clean_tags(_tags(spark, sf_dir), ITEM, _verbs(spark)).groupBy("tag").agg(F.count("*").alias("characters"))


SQL["clean_tags"] = f"""
  with {_LT}, c as (select distinct anilist_character_id, lower(trim(tag)) tag from lt where tag is not null and not (category in ('personality', 'traits') and trim(coalesce(evidence, '')) <> ''
    and regexp_matches(trim(evidence), '(?i)^\\s*(?:_+)?\\s*(?:age|birthday|blood\\s*type|classification|gender|grade|height|occupation|race|rank|species|status|weight)\\s*:?\\s*(?:_+)?')))
  select tag, count(*) characters from c where tag <> '' and len(list_filter(regexp_extract_all(tag, '[a-z][a-z''’-]*'), lambda x: x like '%''s' or x like '%’s')) = 0
    and not (len(regexp_extract_all(tag, '[a-z][a-z''-]*')) >= 2 and regexp_extract_all(tag, '[a-z][a-z''-]*')[1] in ('wears', 'loves', 'has', 'is', 'wanted', 'hates')) group by 1"""


def _normal_documents(spark, sf_dir):
    """Each text of a character, normalised once."""
    docs = table(spark, sf_dir, "documents").where("character_id is not null and text is not null")
    return docs.select(F.col("character_id").alias(ITEM), "doc_id", F.lower(normalize_source("text")).alias("normal"))


def supported_tags(spark, sf_dir):
    """Tags whose evidence, or which themselves, are in one of the character's texts, with the confidence as read."""
    tags = _tags(spark, sf_dir)
    said = tags.select("*", F.explode(F.create_map(F.lit("evidence"), "evidence", F.lit("tag"), "tag")).alias("given_by", "given"))
    confidence = F.lower(F.trim(F.coalesce("confidence", F.lit("medium"))))
    found = said.join(_normal_documents(spark, sf_dir), ITEM).where(evidence_in("given", "normal"))
    return found.select(ITEM, "doc_id", "category", "tag", "given_by", F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("medium").alias("confidence")).distinct()


_SPACE = r"[\s\p{Z}\x0b\x{85}]+"


def _normal_sql(x: str) -> str:
    for pattern in ("<[^>]+>", r"\[[^\]]+\]\([^)]+\)", r"https?://\S+"):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def _evidence_sql(given: str) -> str:
    return f"trim(trim(regexp_replace({given}, '{_SPACE}', ' ', 'g')), '\"\'\'“”‘’')"


def _supported_sql(text: str, given: str) -> str:
    """The evidence in the text, or its pieces as one pattern."""
    e = f"lower({_evidence_sql(given)})"
    pieces = f"list_filter(list_transform(regexp_split_to_array({e}, '(?:\\.\\.\\.|…)+'), lambda x: trim({_normal_sql('x')}, ' .')), lambda x: length(x) >= 4)"
    pattern = f"'(?s)' || array_to_string(list_transform({pieces}, lambda x: regexp_escape(x)), '.*')"
    return f"(coalesce({given}, '') <> '' and (contains({text}, {e}) or (len({pieces}) > 0 and regexp_matches({text}, {pattern}))))"


SQL["supported_tags"] = f"""
  with {_LT}, d as (select character_id anilist_character_id, doc_id, lower({_normal_sql("text")}) dd from documents where character_id is not null and text is not null),
  g as (select *, 'evidence' given_by, evidence given from lt union all select *, 'tag', tag from lt)
  select distinct anilist_character_id, doc_id, category, tag, given_by, case when lower(trim(coalesce(confidence, 'medium'))) in ('high', 'medium', 'low') then lower(trim(coalesce(confidence, 'medium'))) else 'medium' end confidence
  from g join d using (anilist_character_id) where {_supported_sql("dd", "given")}"""


def valid_tags(spark, sf_dir):
    """Tags that are descriptors by rule-made tags, in their canonical form, and that their evidence, or else they themselves, support in a text
    of their character: the first of each."""
    tags = _tags(spark, sf_dir).where("tag is not null")
    tokens = tags.select(F.explode(words("tag", APOSTROPHE_WORD)).alias("token")).select(F.lower("token").alias("token")).distinct()
    pos = tokens.select("token", rule_tag(F.col("token"), F.lit(0)).alias("tag"))
    lexicon = tokens.select("token", F.col("token").rlike("(ing|ed)$").alias("adjective"), F.col("token").rlike("(es|ded)$").alias("verb")).where("adjective or verb")
    known = T.canonical_tags(tags, pos, lexicon).where("canonical is not null").withColumn("evidence", F.coalesce("evidence", "tag")).withColumn("tag", F.col("canonical"))
    return T.validated_tags(known, _normal_documents(spark, sf_dir), ITEM)


_TOKEN_OK = f"""({_RULE_TAG.format("w")} in ('NN', 'NNS', 'JJ') or ({_RULE_TAG.format("w")} = 'VBG' and regexp_matches(w, '(ing|ed)$'))) and not w like '%''s'"""
SQL["valid_tags"] = f"""
  with {_LT}, d as (select character_id anilist_character_id, doc_id, lower({_normal_sql("text")}) dd from documents where character_id is not null and text is not null),
  k as (select *, list_transform(regexp_extract_all(tag, '[A-Za-z][A-Za-z''-]*'), lambda w: lower(w)) ws, coalesce(evidence, tag) given from lt where tag is not null),
  c as (select *, array_to_string(ws, ' ') canonical from k where len(ws) between 1 and 4 and not regexp_matches(tag, '[0-9]') and len(list_filter(ws, lambda w: not ({_TOKEN_OK}))) = 0
    and not (len(ws) >= 2 and (ws[1] like '%s' or ws[1] like '%ed') and regexp_matches(ws[1], '(es|ded)$'))),
  v as (select *, {_evidence_sql("given")} e from c join d using (anilist_character_id) where {_supported_sql("dd", "given")})
  select anilist_character_id, category, canonical tag, e evidence, case when lower(trim(coalesce(confidence, 'medium'))) in ('high', 'medium', 'low') then lower(trim(coalesce(confidence, 'medium'))) else 'medium' end confidence
  from v qualify row_number() over (partition by anilist_character_id, category, canonical order by place, given, confidence) = 1"""


def evidence_fragments(spark, sf_dir):
    """Whether pieces of each text between ellipses support it: in their order, in the other, with a piece that isn't in it, and quoted alone."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", normalize_source("text").alias("n"))
    one, two = F.trim(F.substring("n", 3, 12)), F.trim(F.substring("n", 40, 15))
    ways = {"ordered": F.concat_ws(" ... ", one, two), "turned": F.concat_ws("…", two, one), "foreign": F.concat_ws("...", one, F.lit("zzzz qqqq")), "quoted": F.concat(F.lit("“"), two, F.lit("”"))}
    return rows.select("doc_id", *[evidence_in(given, F.lower("n")).alias(name) for name, given in ways.items()])


_W1, _W2 = "trim(substring(n, 3, 12))", "trim(substring(n, 40, 15))"
SQL["evidence_fragments"] = f"""
  with x as (select doc_id, {_normal_sql("text")} n from documents where text is not null), y as (select doc_id, lower(n) d, {_W1} || ' ... ' || {_W2} a, {_W2} || '…' || {_W1} b, {_W1} || '...' || 'zzzz qqqq' c, '“' || {_W2} || '”' e from x)
  select doc_id, {_supported_sql("d", "a")} ordered, {_supported_sql("d", "b")} turned, {_supported_sql("d", "c")} as foreign, {_supported_sql("d", "e")} quoted from y"""


def _merged(spark, sf_dir):
    tags = _tags(spark, sf_dir).where("tag is not null and trim(tag) <> ''")
    first = tags.select(ITEM, F.lit("traits").alias("category"), F.lower("tag").alias("tag"), "confidence", F.lit("llm").alias("source"), "evidence", F.lit(None).cast("string").alias("grp")).distinct()
    rows = table(spark, sf_dir, "semantic_features").where("character_id is not null").groupBy("character_id").agg(F.max("features").alias("f")).select("character_id", F.explode("f").alias("f"))
    second = rows.where("f.feature is not null and trim(f.feature) <> ''").select(
        F.col("character_id").alias(ITEM), F.lit("traits").alias("category"), F.lower("f.feature").alias("tag"), F.lit("features").alias("confidence"), F.lit("features").alias("source"), F.lit(None).cast("string").alias("evidence"), F.col("f.kind").alias("grp")
    )
    return T.merge_tags([first, second.distinct()], ITEM)


def merged_tags(spark, sf_dir):
    """Model-made tags merged with the features of the same characters; the first confidence is kept."""
    return _merged(spark, sf_dir).select(ITEM, "tag", "confidence", F.array_join("sources", ",").alias("sources"), F.size("evidence").alias("evidence"), F.array_join("groups", ",").alias("groups"))


_MERGE = f"""{_LT}, a as (select distinct anilist_character_id, lower(tag) tag, confidence, 'llm' source, evidence, null::varchar grp, 0 seq from lt where tag is not null and trim(tag) <> ''),
  b as (select distinct character_id, lower(x.feature), 'features', 'features', null::varchar, x.kind, 1 from (select character_id, unnest(f) x from (select character_id, max(features) f from semantic_features where character_id is not null group by 1)) where x.feature is not null and trim(x.feature) <> ''),
  u as (select * from a union all select * from b)"""
SQL["merged_tags"] = f"""
  with {_MERGE}
  select anilist_character_id, tag, arg_min_null(confidence, (seq, coalesce(confidence, ''))) confidence, string_agg(distinct source, ',' order by source) sources, count(distinct evidence)::int evidence,
         coalesce(string_agg(distinct grp, ',' order by grp), '') groups from u group by 1, 2"""


def merged_tag_counts(spark, sf_dir):
    """Merged tags by category, source and group."""
    return T.merged_counts(_merged(spark, sf_dir), ITEM)


SQL["merged_tag_counts"] = f"""
  with {_MERGE}, m as (select anilist_character_id, tag, list_distinct(list(source)) s, list_distinct(list(grp) filter (where grp is not null)) g from u group by 1, 2)
  select 'category' kind, 'traits' as name, count(*) tags from m union all select 'source', x, count(*) from (select unnest(s) x from m) group by 2 union all select 'group', x, count(*) from (select unnest(g) x from m) group by 2
  union all select 'descriptors', 'traits', count(distinct tag) from m"""


def category_union(spark, sf_dir):
    """Values of each category of tags together with those of the features' kinds: how many, and all of them as one hash."""
    tags = _tags(spark, sf_dir).select("category", F.lower("tag").alias("value"))
    rows = table(spark, sf_dir, "semantic_features").select(F.explode("features").alias("f")).select(F.col("f.kind").alias("category"), F.lower("f.feature").alias("value"))
    return T.value_union([tags, rows]).where("category is not null").select("category", F.size("values").alias("n"), F.md5(F.array_join("values", "|")).alias("hash"))


SQL["category_union"] = f"""
  with {_LT}, v as (select category, lower(tag) v from lt where tag is not null union select x.kind, lower(x.feature) from (select unnest(features) x from semantic_features) where x.feature is not null)
  select category, count(*)::int n, md5(string_agg(v, '|' order by v)) hash from v where category is not null group by 1"""


def _matched_traits(spark, sf_dir):
    rows = table(spark, sf_dir, "semantic_features").where("character_id is not null").groupBy("character_id").agg(F.max("features").alias("f"))
    return rows.select("character_id", F.transform("f", lambda x: F.struct(x["kind"].alias("grp"), x["feature"].alias("name"))).alias("traits"))


def trait_groups(spark, sf_dir):
    """Distinct features of every kind: how many, and all of them as one hash."""
    values, _ = T.group_values(_matched_traits(spark, sf_dir), "character_id", "traits")
    return values.select("grp", F.size("values").alias("n"), F.md5(F.array_join("values", "|")).alias("hash"))


def trait_counts(spark, sf_dir):
    """Characters with a row of features, and those with any."""
    return T.group_values(_matched_traits(spark, sf_dir), "character_id", "traits")[1]


_TR = "r as (select character_id, max(features) f from semantic_features where character_id is not null group by 1)"
SQL["trait_groups"] = f"with {_TR}, v as (select distinct x.kind grp, x.feature v from (select unnest(f) x from r) where x.feature is not null) select grp, count(*)::int n, md5(string_agg(v, '|' order by v)) hash from v group by 1"
SQL["trait_counts"] = f"with {_TR} select count(f) matched, count(*) filter (where len(f) > 0) with_traits from r"


def tags_with_characters(spark, sf_dir):
    """Tags of characters with what the crosswalk, of which the last delivery counts, says about each: tags and named characters by category."""
    cross = table(spark, sf_dir, "characters").where("id is not null").select(F.col("id").alias(ITEM), "updated_at", display_name("name").alias("name"), "favourites")
    rows = T.with_crosswalk(_tags(spark, sf_dir), cross, ITEM, "updated_at")
    return rows.groupBy("category").agg(F.count("*").alias("tags"), F.count_if(F.coalesce("name", F.lit("")) != "").alias("named"), F.sum(F.coalesce("favourites", F.lit(0))).alias("favourites"))


SQL["tags_with_characters"] = f"""
  with {_LT}, c as (select distinct on (id) id, name, favourites from characters where id is not null order by id, updated_at desc)
  select category, count(*) tags, count(*) filter (where coalesce(case when ltrim(name) like '{{%' then coalesce(nullif(trim(name->>'$.full'), ''), nullif(trim(name->>'$.userPreferred'), ''), nullif(trim(name->>'$.romaji'), '')) else nullif(trim(name), '') end, '') <> '') named,
    sum(coalesce(favourites, 0))::bigint favourites from lt left join c on id = anilist_character_id group by 1"""


def group_verdicts(spark, sf_dir):
    """Features accepted and rejected by their kind."""
    rows = table(spark, sf_dir, "semantic_features").where("character_id is not null").groupBy("character_id").agg(F.max("features").alias("f")).select("character_id", F.explode("f").alias("f")).select("f.kind")
    judged = T.group_verdicts(rows, "kind", ["role", "attribute_modifier", "morphological_like"], ["event"])
    return judged.groupBy("kind", "reason", "category").agg(F.count("*").alias("n"))


SQL["group_verdicts"] = """
  with k as (select x.kind kind from (select unnest(f) x from (select character_id, max(features) f from semantic_features where character_id is not null group by 1)))
  select kind, case when lower(coalesce(kind, '')) = 'event' then 'excluded_group' when lower(coalesce(kind, '')) not in ('role', 'attribute_modifier', 'morphological_like') then 'not_included_group' end reason,
         case when kind = 'Personality' then 'personality' else 'traits' end category, count(*) n from k group by 1, 2, 3"""


def tag_union(spark, sf_dir):
    """Tags of two sources by category:slug, the first name kept."""
    tags = _tags(spark, sf_dir).where("tag is not null")
    first = tags.select(tag_key("category", "tag").alias("key"), F.col("tag").alias("name"), F.lit(None).cast("bigint").alias("tag_id"), F.col(ITEM).alias("ref"))
    grams = table(spark, sf_dir, "tfidf_vocabulary").select(tag_key(F.lit("role"), "ngram").alias("key"), F.col("ngram").alias("name"), F.col("term_index").cast("bigint").alias("tag_id"), F.col("term_index").cast("bigint").alias("ref"))
    return T.tag_union([first, grams])


_KEY = "case when regexp_replace(regexp_replace(lower(trim(coalesce({1}, ''))), '\\s+', '_', 'g'), '[^a-z0-9_]+', '', 'g') <> '' then regexp_replace(lower(trim({0})), '\\s+', '_', 'g') || ':' || regexp_replace(regexp_replace(lower(trim({1})), '\\s+', '_', 'g'), '[^a-z0-9_]+', '', 'g') else '' end"
SQL["tag_union"] = f"""
  with {_LT}, u as (select {_KEY.format("category", "tag")} as key, tag as name, null::bigint tag_id, anilist_character_id ref, 0 seq from lt where tag is not null
    union all select {_KEY.format("'role'", "ngram")}, ngram, term_index::bigint, term_index, 1 from tfidf_vocabulary)
  select key, arg_min(name, (seq, name)) as name, arg_min(tag_id, (seq, name, tag_id)) filter (where tag_id is not null) tag_id,
    case when coalesce(arg_min(tag_id, (seq, name, tag_id)) filter (where tag_id is not null), 0) <> 0 then 'https://example.org/tag/' || (arg_min(tag_id, (seq, name, tag_id)) filter (where tag_id is not null)) else '' end url, count(distinct ref) refs, count(*) uses from u where key <> '' group by 1"""


def tag_taxonomy(spark, sf_dir):
    """Regions as parents and nations as children, every nation in the files of its customers' segments."""
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("tag_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("parent_id"), F.col("n_nationkey").alias("c_nationkey"))
    files = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("file")).distinct()
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("tag_id"), F.col("r_name").alias("name"), F.lit(None).cast("bigint").alias("parent_id"), F.lit("ALL").alias("file"))
    return T.children(nations.join(files, "c_nationkey").select("tag_id", "name", "parent_id", "file").unionByName(regions))


SQL["tag_taxonomy"] = """
  select r_name parent, n_name child, count(distinct c_mktsegment) child_files from nation join region on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1, 2"""


def pending_items(spark, sf_dir):
    """Wanted characters without a finished row, and finished rows nobody wants: an anti and a semi join."""
    wanted = table(spark, sf_dir, "characters").select(F.col("id").alias("item")).distinct()
    done = table(spark, sf_dir, "tagged_characters").where("error is null").select(F.col(ITEM).alias("item")).distinct()
    pending = wanted.join(done, "item", "left_anti").select("item", F.lit("pending").alias("state"))
    return pending.unionByName(done.join(wanted, "item", "left_semi").select("item", F.lit("done").alias("state"))).unionByName(done.join(wanted, "item", "left_anti").select("item", F.lit("unwanted").alias("state")))


SQL["pending_items"] = """
  with w as (select distinct id item from characters), d as (select distinct anilist_character_id item from tagged_characters where error is null)
  select item, 'pending' state from w where item not in (select item from d) union all select item, 'done' from d where item in (select item from w) union all select item, 'unwanted' from d where item not in (select item from w)"""


def missing_requests(spark, sf_dir):
    """Titles of the other catalogue that no credited work has: set difference, compared in lower case."""
    asked = table(spark, sf_dir, "anidb_cast").select(F.lower(F.trim("anime_title")).alias("title")).where("title <> ''").distinct()
    return asked.exceptAll(table(spark, sf_dir, "credit_edges").select(F.lower("anime_title").alias("title")).where("title is not null").distinct())


SQL["missing_requests"] = """
  select distinct lower(trim(anime_title)) title from anidb_cast where trim(coalesce(anime_title, '')) <> ''
  except select distinct lower(anime_title) from credit_edges where anime_title is not null"""

QUERIES |= {
    "tag_counts": tag_counts, "tag_categories": tag_categories, "tag_membership": tag_membership, "clean_tags": clean_tags, "supported_tags": supported_tags, "merged_tags": merged_tags,
    "merged_tag_counts": merged_tag_counts, "valid_tags": valid_tags, "evidence_fragments": evidence_fragments, "category_union": category_union, "trait_groups": trait_groups, "trait_counts": trait_counts,
    "tags_with_characters": tags_with_characters, "group_verdicts": group_verdicts, "tag_union": tag_union, "tag_taxonomy": tag_taxonomy, "pending_items": pending_items, "missing_requests": missing_requests,
}
