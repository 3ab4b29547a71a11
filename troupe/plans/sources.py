"""Sources that are parsed: XML, HTML and JSON made from whole tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from troupe.functions.text import json_object
from troupe.operators.tags import children
from troupe.plans import Query
from troupe.sources import readers as R
from troupe import runtime
from troupe.runtime import shared_dir, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _xml(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _text(name, value):
    return F.concat(F.lit(f"<{name}>"), _xml(F.coalesce(value, F.lit(""))), F.lit(f"</{name}>"))


def xml_cast(spark, sf_dir):
    """Every row of the cast as an XML document, parsed again: fields and number of voice actors."""
    rows = table(spark, sf_dir, "anidb_cast").where("anidb_character_id is not null")
    people = F.array_join(F.transform(F.coalesce("seiyuu", F.array()), lambda s: F.concat(F.lit('<seiyuu id="'), s["anidb_seiyuu_id"].cast("string"), F.lit('">'), _xml(F.coalesce(s["name"], F.lit(""))), F.lit("</seiyuu>"))), "")
    rating = F.when(F.col("rating").isNotNull(), F.concat(F.lit('<rating votes="'), F.coalesce("rating_votes", F.lit(0)).cast("string"), F.lit('">'), F.col("rating").cast("string"), F.lit("</rating>"))).otherwise("")
    xml = F.concat(
        F.lit('<anime><characters><character id="'), F.col("anidb_character_id").cast("string"), F.lit('" type="'), _xml(F.coalesce("cast_type", F.lit(""))), F.lit('">'),
        _text("name", F.trim("name")), _text("gender", F.col("gender")), rating, people, F.lit("</character></characters></anime>"),
    )
    docs = rows.select("anidb_anime_id", xml.alias("xml")).unionByName(rows.limit(1).select("anidb_anime_id", F.lit("<anime><characters>").alias("xml")))
    found = R.cast_of(docs, "xml", "anidb_anime_id")
    return found.select("anidb_anime_id", "cast_id", "type", "gender", "rating", F.size("seiyuu").alias("people"))


SQL["xml_cast"] = """
  select anidb_anime_id, anidb_character_id cast_id, trim(coalesce(cast_type, '')) as type, trim(coalesce(gender, '')) gender, rating,
         coalesce(len(seiyuu), 0)::int people from anidb_cast where anidb_character_id is not null"""


def xml_taxonomy(spark, sf_dir):
    """A tag tree for every market segment as an XML file in a folder, which is read again: regions with their nations and the segments those are in."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    segments = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("file")).distinct()
    tag = F.concat(F.lit('<tag id="'), (F.col("n_nationkey") + 100).cast("string"), F.lit('" parentid="'), F.col("r_regionkey").cast("string"), F.lit('">'), _text("name", F.col("n_name")), F.lit("</tag>"))
    parent = F.concat(F.lit('<tag id="'), F.col("r_regionkey").cast("string"), F.lit('">'), _text("name", F.col("r_name")), F.lit("</tag>"))
    docs = nations.join(segments, "n_nationkey").groupBy("file").agg(F.concat(F.lit("<anime><tags>"), F.array_join(F.array_sort(F.collect_set(F.concat(tag, parent))), ""), F.lit("</tags></anime>")).alias("xml"))
    path = f"{shared_dir(spark)}/troupe/xml-{uuid.uuid4().hex}"
    runtime._written.append(path)
    docs.select(F.col("file"), F.col("xml").alias("value")).write.partitionBy("file").text(path)
    return children(R.tag_tree_of(R.read_texts(spark, f"{path}/*"), "text", "file"))


SQL["xml_taxonomy"] = "select r_name parent, n_name child, count(distinct c_mktsegment) child_files from nation join region on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1, 2"


KNOWN = ("role", "clothing", "abilities", "personality")


def html_tags(spark, sf_dir):
    """Every character with tags of the known categories as a tag page, parsed again: those tags. (Pages without any fall back to other links.)"""
    rows = table(spark, sf_dir, "tagged_characters").where("anilist_character_id is not null and llm_tags is not null").groupBy("anilist_character_id").agg(F.max_by("llm_tags", F.size("llm_tags")).alias("t"))
    each = rows.select("anilist_character_id", F.explode("t").alias("category", "v")).select(
        "anilist_character_id", "category", F.filter(F.transform("v", lambda x: x["tag"]), lambda x: x.isNotNull() & (F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " ")) != "")).alias("v")
    )
    anchors = F.array_join(F.transform("v", lambda x: F.concat(F.lit('<a href="/tag/'), F.length(x).cast("string"), F.lit('"><span class="tagname">'), _xml(x), F.lit("</span></a>"))), " ")
    row = F.concat(F.lit('<tr><th class="field">'), F.initcap("category"), F.lit('</th><td class="value">'), anchors, F.lit("</td></tr>"))
    pages = each.groupBy("anilist_character_id").agg(F.concat(F.lit("<html><body><table>"), F.array_join(F.array_sort(F.collect_list(row)), "\n"), F.lit("</table></body></html>")).alias("page"), F.sum(F.when(F.col("category").isin(*KNOWN), F.size("v")).otherwise(0)).alias("n")).where("n > 0")
    return R.tags_of_pages(pages, "anilist_character_id", "page").where(F.col("category").isin(*KNOWN)).groupBy("anilist_character_id", "category").agg(F.count("*").alias("tags"))


SQL["html_tags"] = r"""
  with r as (select anilist_character_id, arg_max(llm_tags, cardinality(llm_tags)) t from tagged_characters where anilist_character_id is not null and llm_tags is not null group by 1),
  e as (select anilist_character_id, category, unnest(t[category]).tag tag from (select anilist_character_id, t, unnest(map_keys(t)) category from r)),
  n as (select anilist_character_id, category, length(tag) id, lower(trim(regexp_replace(tag, '[\s\p{Z}]+', ' ', 'g'))) tag from e where tag is not null)
  select anilist_character_id, category, count(distinct (id, tag)) tags from n where tag <> '' and category in ('role', 'clothing', 'abilities', 'personality') group by 1, 2"""


def json_in_text(spark, sf_dir):
    """Objects inside free text, found by their outermost braces."""
    said = F.concat(F.when(F.col("event_id") % 2 == 0, "The answer is ").otherwise(""), F.col("props"), F.when(F.col("event_id") % 2 == 0, " as asked").otherwise(""))
    found = table(spark, sf_dir, "events").select("event_id", json_object(said, "k bigint").alias("o"))
    return found.select("event_id", F.col("o.k").alias("k"))


SQL["json_in_text"] = "select event_id, (props->>'$.k')::bigint k from events"

QUERIES |= {"xml_cast": xml_cast, "xml_taxonomy": xml_taxonomy, "html_tags": html_tags, "json_in_text": json_in_text}
