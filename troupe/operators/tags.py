"""Descriptive tags of items: cleaning, validation, merging and counting, in long form (item, category, tag, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troupe.functions.names import address
from troupe.functions.text import APOSTROPHE_WORD, evidence_in, normalize_evidence, words

# fixed values: field labels that alone are no evidence
METADATA_FIELD = r"(?i)^\s*(?:_+)?\s*(?:age|birthday|blood\s*type|classification|gender|grade|height|occupation|race|rank|species|status|weight)\s*:?\s*(?:_+)?"


def long_tags(df: DataFrame, item: str, tags: str) -> DataFrame:
    """(item, category, place, tag, evidence, confidence) of a map of arrays of structs, each item once."""
    once = df.where(F.col(item).isNotNull()).groupBy(item).agg(F.max_by(tags, F.struct(F.coalesce(F.size(tags), F.lit(-1)), F.xxhash64(F.to_json(tags)))).alias("t"))
    return once.select(item, F.explode("t").alias("category", "values")).select(item, "category", F.posexplode("values").alias("place", "x")).select(item, "category", "place", "x.tag", "x.evidence", "x.confidence")


def metadata_only(evidence: Column) -> Column:
    """Whether there is evidence and all of it is field labels."""
    kept = F.filter(F.transform(evidence, lambda e: F.trim(e)), lambda e: e.isNotNull() & (e != ""))
    return (F.size(kept) > 0) & F.forall(kept, lambda e: e.rlike(METADATA_FIELD))


def possessive(tag: Column) -> Column:
    return F.exists(words(F.lower(tag), r"[a-z][a-z'’-]*"), lambda t: t.endswith("'s") | t.endswith("’s"))


def clean_tags(tags: DataFrame, item: str, verbs: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """(item, tag), distinct: tags in lower case, without possessives, tags whose first of several words is a finite verb by `verbs`
    (token), and, in personality and traits, those that only field labels support."""
    t = F.lower(F.trim("tag"))
    rows = tags.where(F.col("category").isin(*categories)) if categories else tags
    only_fields = F.col("category").isin("personality", "traits") & metadata_only(F.array("evidence"))
    rows = rows.where(~F.coalesce(only_fields, F.lit(False))).select(item, t.alias("tag")).where("tag is not null and tag <> ''").where(~possessive(F.col("tag"))).distinct()
    tokens = words("tag", r"[a-z][a-z'-]*")
    head = F.try_element_at(tokens, F.lit(1))
    finite = (F.size(tokens) >= 2) & (head.endswith("s") | head.endswith("ed"))
    headed = rows.withColumn("head", F.when(finite, head))
    return headed.join(verbs.select(F.col("token").alias("head")).distinct(), "head", "left_anti").select(item, "tag")


def canonical_tags(tags: DataFrame, pos: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds `canonical` to rows with a `tag`: the words in lower case, or null where the tag isn't a descriptor: it has digits, more than 4
    words, a possessive or a finite verb at its head, or a word that is neither noun nor adjective, nor a participle that is a known
    adjective, nor an unknown foreign or adverb-like word. pos: (token, tag); lexicon: (token, adjective, verb booleans)."""
    tokens = F.transform(words("tag", APOSTROPHE_WORD), lambda x: F.lower(x))
    rows = tags.withColumn("_id", F.xxhash64("tag")).withColumn("_tokens", tokens)
    each = rows.select("_id", F.col("tag"), "_tokens").distinct().select("_id", "tag", F.size("_tokens").alias("n"), F.posexplode("_tokens").alias("k", "token"))
    known = pos.groupBy("token").agg(F.min(F.col("tag")).alias("pos"))
    lex = lexicon.groupBy("token").agg(F.max("adjective").alias("adjective"), F.max("verb").alias("verb"))
    each = each.join(known, "token", "left").join(lex, "token", "left")
    noun_or_adjective = F.col("pos").isin("NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS")
    participle = F.col("pos").isin("VBG", "VBN") & F.coalesce("adjective", F.lit(False))
    unknown = F.col("pos").isin("FW", "EX", "RB") & F.col("token").rlike("^[a-z][a-z-]*$") & ~F.col("token").endswith("ly") & F.col("verb").isNull()
    finite = (F.col("k") == 0) & (F.col("n") >= 2) & (F.col("token").endswith("s") | F.col("token").endswith("ed")) & F.coalesce("verb", F.lit(False))
    fine = F.coalesce(noun_or_adjective | participle | unknown, F.lit(False)) & ~finite & ~F.col("token").endswith("'s")
    good = each.groupBy("_id", "tag").agg(F.min(fine).alias("fine"), F.max("n").alias("n")).where("fine and n <= 4").where(~F.col("tag").rlike(r"\d")).select("_id", F.col("tag").alias("_tag"))
    joined = rows.join(good, (rows["_id"] == good["_id"]) & (rows["tag"] == good["_tag"]), "left")
    return joined.select(*tags.columns, F.when(F.col("_tag").isNotNull(), F.array_join("_tokens", " ")).alias("canonical"))


def validated_tags(tags: DataFrame, texts: DataFrame, item: str) -> DataFrame:
    """Tags (item, category, place, tag, evidence, confidence) whose evidence one of the item's texts (item, normal: normalised and in lower case)
    supports: the first of each (item, category, tag), the evidence normalised and an unknown confidence read as medium. Items without a
    text have no valid tags."""
    confidence = F.lower(F.trim(F.coalesce("confidence", F.lit("medium"))))
    rows = tags.join(texts.select(item, "normal"), item).where(evidence_in("evidence", "normal") & (F.trim(F.coalesce("tag", F.lit(""))) != ""))
    rows = rows.select(item, "category", "place", F.col("tag"), normalize_evidence("evidence").alias("evidence"), F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("medium").alias("confidence"))
    first = F.min_by(F.struct("evidence", "confidence"), F.struct("place", "evidence"))
    return rows.groupBy(item, "category", "tag").agg(first.alias("x")).select(item, "category", "tag", "x.evidence", "x.confidence")


def merge_tags(sources: list[DataFrame], item: str) -> DataFrame:
    """Tags of several sources (item, category, tag, confidence, source, evidence, grp), earlier sources first: one row per tag with the first
    confidence, all sources, groups and pieces of evidence, sorted, and the order of the first source."""
    rows = sources[0].withColumn("seq", F.lit(0))
    for k, more in enumerate(sources[1:], 1):
        rows = rows.unionByName(more.withColumn("seq", F.lit(k)))
    return rows.groupBy(item, "category", "tag").agg(
        F.min_by("confidence", F.struct("seq", F.coalesce("confidence", F.lit("")))).alias("confidence"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("evidence")).alias("evidence"),
        F.array_sort(F.collect_set("grp")).alias("groups"),
    )


def group_verdicts(rows: DataFrame, group: str, include: list[str] | None, exclude: list[str]) -> DataFrame:
    """Adds `reason`, why a row's group is rejected (compared in lower case), or null, and `category` by its group."""
    g = F.lower(F.coalesce(F.col(group), F.lit("")))
    reason = F.when(g.isin(*exclude), "excluded_group") if exclude else F.when(F.lit(False), "")
    if include is not None:
        reason = reason.when(~g.isin(*include), "not_included_group")
    return rows.withColumn("reason", reason).withColumn("category", F.when(F.col(group) == "Personality", "personality").otherwise("traits"))


def membership(tags: DataFrame, items: DataFrame | None, item: str) -> DataFrame:
    """(item, tag), distinct; with `items`, those without tags have one row with a null tag."""
    rows = tags.where("tag is not null").select(item, "tag").distinct()
    return rows if items is None else items.select(item).distinct().join(rows, item, "left")


def tag_counts(tags: DataFrame, item: str) -> DataFrame:
    """(category, tag, occurrences, items, place): per category by occurrences, ties by tag."""
    counts = tags.where("tag is not null").groupBy("category", "tag").agg(F.count("*").alias("occurrences"), F.count_distinct(item).alias("items"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("occurrences"), "tag")))


def category_values(tags: DataFrame, item: str) -> DataFrame:
    """(category, tags, items, total): distinct tags, tagged items and all tags of each category."""
    return tags.where("tag is not null").groupBy("category").agg(F.count_distinct("tag").alias("tags"), F.count_distinct(item).alias("items"), F.count("*").alias("total"))


def merged_counts(merged: DataFrame, item: str) -> DataFrame:
    """(kind, name, tags) of merge_tags(): tags by category, by source and by group, and the distinct descriptors of every category."""
    of = lambda kind, name: merged.select(name.alias("name")).groupBy("name").agg(F.count("*").alias("tags")).select(F.lit(kind).alias("kind"), "name", "tags")
    rows = of("category", F.col("category")).unionByName(of("source", F.explode("sources"))).unionByName(of("group", F.explode("groups")))
    return rows.unionByName(merged.groupBy(F.col("category").alias("name")).agg(F.count_distinct("tag").alias("tags")).select(F.lit("descriptors").alias("kind"), "name", "tags"))


def value_union(sources: list[DataFrame]) -> DataFrame:
    """(category, values) of sources (category, value): the distinct values of all of them, sorted."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    return rows.where("value is not null").distinct().groupBy("category").agg(F.array_sort(F.collect_list("value")).alias("values"))


def group_values(matches: DataFrame, item: str, traits: str) -> tuple[DataFrame, DataFrame]:
    """Of items with their match's traits (array of structs with grp and name, null without a match): (grp, values), the distinct names of each
    group, sorted; and one row (matched, with_traits)."""
    counts = matches.agg(F.count(F.col(traits)).alias("matched"), F.count_if(F.size(traits) > 0).alias("with_traits"))
    rows = matches.select(F.explode(traits).alias("x")).select(F.col("x.grp").alias("category"), F.col("x.name").alias("value"))
    return value_union([rows]).select(F.col("category").alias("grp"), "values"), counts


def with_crosswalk(tags: DataFrame, crosswalk: DataFrame, key: str, order: str) -> DataFrame:
    """Tags with the columns of the crosswalk's last row of their key by `order`; nulls where it has none."""
    rest = [c for c in crosswalk.columns if c not in (key, order)]
    last = crosswalk.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])
    return tags.join(last, key, "left")


def tag_union(sources: list[DataFrame], base: str = "https://example.org/tag/") -> DataFrame:
    """(key, name, tag_id, url, refs, uses) over sources (key, name, tag_id, ref): the first name and the first id of each key, the address made from
    the id, the number of distinct references and of uses."""
    rows = sources[0].withColumn("seq", F.lit(0))
    for k, more in enumerate(sources[1:], 1):
        rows = rows.unionByName(more.withColumn("seq", F.lit(k)))
    first_id = F.min_by(F.when(F.col("tag_id").isNotNull(), F.col("tag_id")), F.when(F.col("tag_id").isNotNull(), F.struct("seq", "name", "tag_id")))
    found = rows.where("key <> ''").groupBy("key").agg(F.min_by("name", F.struct("seq", "name")).alias("name"), first_id.alias("tag_id"), F.count_distinct("ref").alias("refs"), F.count("*").alias("uses"))
    return found.select("key", "name", "tag_id", address(base, "tag_id").alias("url"), "refs", "uses")


def children(taxonomy: DataFrame) -> DataFrame:
    """(parent, child, child_files) of (tag_id, name, parent_id, file): the last file's row of each tag counts; tags whose parent is
    unknown are dropped; child_files are the distinct files a child is in."""
    last = taxonomy.groupBy("tag_id").agg(F.max_by(F.struct("name", "parent_id"), "file").alias("x"), F.count_distinct("file").alias("files")).select("tag_id", "x.*", "files")
    links = taxonomy.where("parent_id is not null").select("parent_id", F.col("tag_id").alias("child_id")).distinct()
    named = links.join(last.select(F.col("tag_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id")
    return named.join(last.select(F.col("tag_id").alias("child_id"), F.col("name").alias("child"), F.col("files").alias("child_files")), "child_id").select("parent", "child", "child_files")
