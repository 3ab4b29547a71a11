"""Scalar functions, stored inputs and resumable outputs, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from troupe.functions import names as N
from troupe.functions import text as T
from troupe.operators import matching
from troupe.operators.vectors import norm
from troupe.plans import Query
from troupe.plans.text import _ASCII, _ngram_rows
from troupe.runtime import shared_dir, table
from troupe.sources import readers as R
from troupe.sources import writers as W

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_SPACE = r"[\s\p{Z}\x0b\x{85}]+"


def _folder(spark) -> str:
    from troupe import runtime

    path = f"{shared_dir(spark)}/troupe/stored-{uuid.uuid4().hex}"
    runtime._written.append(path)
    return path


def semantic_texts(spark, sf_dir):
    """Texts in the form for features, and the number of their sentences as they are."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    form = T.normalize_semantic("text")
    return rows.select("doc_id", F.length(form).alias("chars"), F.md5(form).alias("hash"), F.size(T.sentences("text")).alias("sentences"))


SQL["semantic_texts"] = rf"""
  with n as (select doc_id, text, lower(trim(regexp_replace(regexp_replace({_ASCII}, '[_*`]+', ' ', 'g'), '\s+', ' ', 'g'))) f from (select doc_id, text from documents where text is not null))
  select doc_id, length(f)::int chars, md5(f) hash, len(string_split(regexp_replace(regexp_replace(text, '([.!?;])[\s\x0b]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)))::int sentences from n"""


def decoded_names(spark, sf_dir):
    """Names with remarks in brackets and entities, in the form that leaves both out, and what a stored result for each is called."""
    rows = table(spark, sf_dir, "characters").where("id is not null and name is not null").groupBy("id").agg(F.min("name").alias("name"))
    said = F.concat("name", F.lit(" (an alias) &quot;Ace&quot; &amp;"))
    return rows.select("id", N.norm_c(said).alias("norm"), F.size(N.keys_c(said)).alias("keys"), N.cache_key("name", F.lit("Ward, mean"), F.lit(7)).alias("cache_key"))


SQL["decoded_names"] = r"""
  with r as (select id, min(name) as name from characters where id is not null and name is not null group by 1),
  n as (select id, name, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(name || ' (an alias) "Ace" &', '\([^)]*\)', ' ', 'g'), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9 ]+', ' ', 'g')), '\s+', ' ', 'g')) norm from r), p as (select *, string_split(norm, ' ') p from n)
  select id, norm, len(list_distinct([norm, array_to_string(list_reverse(p), ' '), array_to_string(list_sort(p), ' ')] || case when len(p) > 2 then [array_to_string(p[1:2], ' '), array_to_string(list_sort(p[1:2]), ' ')] else [] end))::int keys,
    coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'value') || '_ward_mean_7' cache_key from p"""


def work_addresses(spark, sf_dir):
    """Addresses made from the works' ids, and the ids read back from them."""
    rows = table(spark, sf_dir, "credit_edges").select("mal_anime_id").distinct().withColumn("url", N.address("https://example.org/anime/", "mal_anime_id"))
    return rows.select("mal_anime_id", "url", N.id_in_address(F.concat("url", F.lit("/a-title?x=1"))).alias("back"))


SQL["work_addresses"] = """
  select distinct mal_anime_id, case when coalesce(mal_anime_id, 0) <> 0 then 'https://example.org/anime/' || mal_anime_id else '' end url, nullif(mal_anime_id, 0) back from credit_edges"""


def topic_labels(spark, sf_dir):
    """Labels that free text ends with, read and validated: the last object that has all fields counts, a blank message gives way to what was thought."""
    rows = table(spark, sf_dir, "tfidf_vocabulary")
    last = F.to_json(F.struct(F.concat(F.lit("  "), F.initcap("ngram")).alias("label"), F.repeat("ngram", F.lit(20)).alias("description"), F.when(F.col("term_index") % 3 == 0, "HIGH").otherwise("sure").alias("confidence"), F.array("ngram", F.lit("foreign"), "ngram").alias("evidence_terms")))
    thought = F.concat(F.lit('First {"label": "no", "description": "x", "confidence": "low", "evidence_terms": []} then {"label": 1} and '), last, F.lit(" {done}"))
    said = T.content_of(F.when(F.col("term_index") % 2 == 0, thought).otherwise(""), F.when(F.col("term_index") % 2 == 1, thought))
    found = rows.select("term_index", "ngram", said.alias("said")).select("term_index", T.valid_label(T.last_label("said"), F.array("ngram")).alias("x"))
    return found.select("term_index", "x.label", "x.description", "x.confidence", F.array_join("x.evidence_terms", "|").alias("evidence"))


SQL["topic_labels"] = """
  select term_index, substring(trim(array_to_string(list_transform(string_split(ngram, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')), 1, 80) as label, substring(trim(repeat(ngram, 20)), 1, 240) description, case when term_index % 3 = 0 then 'high' else 'medium' end confidence,
    ngram || '|' || ngram evidence from tfidf_vocabulary"""


def phrase_variants(spark, sf_dir):
    """The short ones of the characters' phrases, four of them: of 1 to 3 words, distinct in any case, the last repeated."""
    rows = table(spark, sf_dir, "semantic_features").where("character_id is not null").groupBy("character_id").agg(F.max("features").alias("f")).where("f is not null")
    return rows.select("character_id", F.array_join(T.padded(T.short_phrases(F.transform("f", lambda x: x["source_phrase"]), F.lit("none"), 3)), "|").alias("variants"))


SQL["phrase_variants"] = rf"""
  with r as (select character_id, max(features) f from semantic_features where character_id is not null group by 1), t as (select character_id, list_filter(list_transform(f, lambda x: trim(trim(regexp_replace(x.source_phrase, '{_SPACE}', ' ', 'g')), ' .。!?！？"''“”‘’')), lambda x: x is not null) v from r where f is not null),
  k as (select character_id, list_filter(list_transform(list_filter(v, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?')) between 1 and 3), lambda x: trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))), lambda x: x <> '') v from t),
  d as (select character_id, list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i) v from k), e as (select character_id, case when len(v) > 0 then v else ['none'] end v from d)
  select character_id, array_to_string((v || list_transform(range(4), lambda i: v[len(v)]))[1:4], '|') variants from e"""


def safe_traits(spark, sf_dir):
    """Features as traits, without those that are marked: lies, spoilers and what isn't asked for."""
    rows = table(spark, sf_dir, "semantic_features").where("character_id is not null").groupBy("character_id").agg(F.max("features").alias("f")).where("f is not null")
    trait = lambda x: F.struct(x["feature"].alias("name"), (x["kind"] == "event").alias("lie"), F.when(F.length(x["feature"]) % 4 > 0, F.length(x["feature"]) % 4).alias("spoiler"), x["lexname"].startswith("noun.body").alias("sexual"))
    traits = rows.select("character_id", F.transform("f", trait).alias("t"))
    return traits.select("character_id", F.size(matching.filter_traits("t")).alias("kept"), F.size(matching.filter_traits("t", 2, True)).alias("more"))


SQL["safe_traits"] = """
  with r as (select character_id, max(features) f from semantic_features where character_id is not null group by 1),
  t as (select character_id, list_transform(f, lambda x: {'lie': coalesce(x.kind = 'event', false), 's': coalesce(length(x.feature) % 4, 0), 'x': coalesce(x.lexname like 'noun.body%', false)}) t from r where f is not null)
  select character_id, len(list_filter(t, lambda x: not x.lie and x.s <= 1 and not x.x))::int kept, len(list_filter(t, lambda x: not x.lie and x.s <= 2))::int more from t"""


def first_events(spark, sf_dir):
    """The first event of each user and type."""
    return matching.first_deliveries(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


SQL["first_events"] = "select distinct on (user_id, event_type) user_id, event_type, event_id, value from events order by user_id, event_type, ts, event_id"


def json_descriptions(spark, sf_dir):
    """Texts written as JSON documents of a list and read back: the first filled one of each."""
    path = _folder(spark)
    rows = table(spark, sf_dir, "documents").select(F.array(F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("description"), F.lit(None).cast("string").alias("description_plain"), F.col("text").alias("description_text"))).alias("characters"))
    W.write_json(rows, path)
    df = R.read_json(spark, path, "characters array<struct<id: bigint, description: string, description_plain: string, description_text: string>>", lines=True)
    return R.descriptions(df, "list").select("character_id", F.length("description").alias("chars"), F.md5("description").alias("hash"))


SQL["json_descriptions"] = "select doc_id::varchar character_id, length(coalesce(text, ''))::int chars, md5(coalesce(text, '')) hash from documents"


def cached_vocabulary(spark, sf_dir):
    """Term counts that are built and stored where they aren't complete, and read where they are: here both, one after the other."""
    path, rows = _folder(spark), _ngram_rows(spark, sf_dir)

    def build():
        counts = rows.select("character_id", F.explode("ngrams").alias("term")).groupBy("term").agg(F.count("*").alias("uses"), F.count_distinct("character_id").alias("docs"))
        return {"terms": counts, "rows": rows.select("character_id", F.size("ngrams").alias("size"))}

    first, there = R.cached_tables(spark, path, build, ["terms", "rows"])
    found, again = R.cached_tables(spark, path, build, ["terms", "rows"])
    return found["terms"].withColumn("built", F.lit(not there and again))


SQL["cached_vocabulary"] = """
  with s as (select character_id, max(ngrams) g from ngram_documents where character_id is not null group by 1), t as (select character_id, unnest(g) term from s)
  select term, count(*) uses, count(distinct character_id) docs, true built from t where term is not null and trim(term) <> '' group by 1"""


def appended_rows(spark, sf_dir):
    """Wanted characters appended to a table in two runs, the first of which ends early: nobody twice, and complete at the end."""
    path = _folder(spark)
    wanted = table(spark, sf_dir, "characters").where("id is not null").select(F.col("id").alias("item")).distinct()
    W.append_pending(wanted, spark.createDataFrame([], "item bigint"), "item", path, 100)
    W.append_pending(wanted, spark.read.parquet(path), "item", path)
    return W.require_complete(spark.read.parquet(path), wanted, "item").groupBy("item").agg(F.count("*").alias("times"))


SQL["appended_rows"] = "select distinct id item, 1::bigint times from characters where id is not null"


def staged_descriptors(spark, sf_dir):
    """The stored vectors of texts that are asked for in other letters, at length 1, with what the model of a preset would be given; and whether
    the stored texts are those asked for."""
    rows = table(spark, sf_dir, "descriptor_vectors").where("embedding is not null and text is not null")
    wanted = rows.select(F.upper("text").alias("text")).distinct()
    found = R.preset_texts(R.staged_vectors(rows, wanted, fold=True), "text", "e5-large")
    placed = found.select("text", "model").withColumn("place", F.xxhash64("text"))
    same = R.same_vocabulary(placed, placed.select("place", "text"), R.PRESETS["e5-large"][0])
    finite = F.forall("vector", lambda x: ~F.isnan(x))
    return found.select("text", "input", F.size("vector").alias("size"), F.when(finite, F.round(norm("vector"), 5)).alias("norm"), F.lit(same).alias("same"))


SQL["staged_descriptors"] = """
  with v as (select lower(text) text, min(embedding) e from descriptor_vectors where embedding is not null and text is not null group by 1)
  select text, 'query: ' || text input, len(e)::int size, case when isfinite(list_sum(e::double[])) then case when list_max(list_transform(e, lambda x: abs(x))) > 0 then 1.0::double else 0.0 end end as norm, true same from v"""

QUERIES |= {
    "semantic_texts": semantic_texts, "decoded_names": decoded_names, "work_addresses": work_addresses, "topic_labels": topic_labels, "phrase_variants": phrase_variants, "safe_traits": safe_traits,
    "first_events": first_events, "json_descriptions": json_descriptions, "cached_vocabulary": cached_vocabulary, "appended_rows": appended_rows, "staged_descriptors": staged_descriptors,
}
