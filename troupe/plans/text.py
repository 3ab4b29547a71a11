"""Texts, n-grams, term weights, features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from troupe.functions import text as T
from troupe.functions.tagging import rule_tag, rule_tags
from troupe.operators import ngrams
from troupe.plans import Query
from troupe.runtime import materialize, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def normalized_descriptions(spark, sf_dir):
    """Corpus scan: descriptions of known characters with at least 5 words, left joined to their character."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "character_id", F.trim(F.regexp_replace(T.normalize_description("text"), r"\s+", " ")).alias("norm"))
    kept = docs.withColumn("n_words", F.size(F.split("norm", " "))).where((F.col("norm") != "") & (F.col("n_words") >= 5))
    chars = table(spark, sf_dir, "characters").select(F.col("id").alias("character_id"), "favourites").groupBy("character_id").agg(F.max("favourites").alias("favourites"))
    return kept.join(chars, "character_id", "left").select("doc_id", "character_id", F.coalesce("favourites", F.lit(0)).alias("favourites"), "n_words", F.sha2("norm", 256).alias("norm_hash"))


# the compatibility characters that these texts have, and the one entity
_COMPAT = [("&quot;", '"'), ("&QUOT;", '"')]
_MARKUP = [(r"\[([^\]]+)\]\(https?://[^)]+\)", r"\1"), (r"(?i)\[/?(?:b|i|u|s|center|spoiler|url(?:=[^\]]+)?)\]", " "), ("<[^>]+>", " "), (r"https?://\S+", " ")]
_WIDE = [("，", ","), ("：", ":"), ("\u00a0", " "), ("½", "12"), ("Ⅳ", "IV"), ("②", "2"), ("…", "..."), ("\u3000", " "), ("¼", "14"), ("³", "3"), ("¨", " "), ("ª", "a"), ("º", "o")]


def _ascii_sql() -> str:
    x = "coalesce(text, '')"
    for a, b in _COMPAT:
        x = f"replace({x}, '{a}', '{b}')"
    for a, b in _MARKUP:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    for a, b in _WIDE:
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"


_ASCII = _ascii_sql()
_F1 = f"regexp_replace({_ASCII}, '\\\\n|\\n|\\r', ' ', 'g')"
SQL["normalized_descriptions"] = f"""
  with n as (select doc_id, character_id, trim(regexp_replace(lower({_F1}), '\\s+', ' ', 'g')) norm from documents), c as (select id character_id, max(favourites) favourites from characters group by 1)
  select doc_id, character_id, coalesce(favourites, 0) favourites, len(string_split(norm, ' '))::int n_words, sha256(norm) norm_hash from n left join c using (character_id)
  where norm <> '' and len(string_split(norm, ' ')) >= 5"""


def source_texts(spark, sf_dir):
    """Texts without markup and links, as they are given to validation: length and number of plain words."""
    norm = T.normalize_source("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(norm).alias("chars"), F.size(T.words(norm)).alias("words"))


SQL["source_texts"] = r"""
  with n as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\[[^\]]+\]\([^)]+\)', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[\s\p{Z}\x0b\x{85}]+', ' ', 'g')) norm from documents)
  select doc_id, length(norm)::int chars, case when norm is null then null else len(regexp_extract_all(norm, '[A-Za-z][A-Za-z0-9]*'))::int end words from n"""


def _tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.filter(T.words(F.lower("text")), lambda x: F.length(x) >= 3).alias("tokens"))


_TOK = "t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9]*'), lambda x: len(x) >= 3) w from documents where text is not null)"
_GRAMS = """g as (select doc_id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) term from t where len(w) >= 2
  union all select doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from t where len(w) >= 3)"""


def ngram_counts(spark, sf_dir):
    """Windows of 2 and 3 words: documents and occurrences of those in at least 3 documents."""
    grams = _tokens(spark, sf_dir).select("doc_id", F.explode(T.windows("tokens", 2, 3)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("occurrences"))
    return ngrams.term_documents(grams).where("docs >= 3")


SQL["ngram_counts"] = f"with {_TOK}, {_GRAMS} select term, count(distinct doc_id) docs, count(*) occurrences from g group by 1 having docs >= 3"


def tfidf_words(spark, sf_dir):
    """Term weights of the words of all documents."""
    tokens = _tokens(spark, sf_dir)
    counts = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    found = ngrams.tf_idf(counts, "doc_id", "term", "n", tokens.agg(F.count("*").alias("n")).select(F.col("n").cast("double").alias("n")))
    return found.select("doc_id", "term", F.round("value", 6).alias("value"))


def _tfidf_sql(counts: str, n: str, key: str) -> str:
    return f"""
  c as ({counts}), n as ({n}), df as (select term, count(*) df, sum(n) total from c group by 1),
  k as (select term, ln((1 + nn) / (1 + df)) + 1 idf from df, n where df >= 3 and df <= 0.45 * nn order by total desc, term limit 30000),
  r as (select {key}, term, (1 + ln(n)) * idf raw from c join k using (term))
  select {key}, term, round(raw / sqrt(sum(raw * raw) over (partition by {key})), 6) as value from r"""


SQL["tfidf_words"] = f"with {_TOK}, " + _tfidf_sql("select doc_id, term, count(*) n from (select doc_id, unnest(w) term from t) group by 1, 2", "select count(*)::double nn from t", "doc_id").lstrip()


def _ngram_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "ngram_documents").where("character_id is not null").groupBy("character_id").agg(F.max("ngrams").alias("ngrams"))
    return rows.withColumn("ngrams", F.filter("ngrams", lambda x: x.isNotNull() & (F.trim(x) != "")))


def tfidf_ngrams(spark, sf_dir):
    """Term weights of the stored n-gram documents."""
    rows = _ngram_rows(spark, sf_dir)
    counts = rows.select("character_id", F.explode("ngrams").alias("term")).groupBy("character_id", "term").agg(F.count("*").alias("n"))
    n = rows.where("ngrams is not null").agg(F.count("*").cast("double").alias("n"))
    return ngrams.tf_idf(counts, "character_id", "term", "n", n).select("character_id", "term", F.round("value", 6).alias("value"))


_NG = "s as (select character_id, max(ngrams) g from ngram_documents where character_id is not null group by 1)"
SQL["tfidf_ngrams"] = f"with {_NG}, " + _tfidf_sql(
    "select character_id, term, count(*) n from (select character_id, unnest(g) term from s) where term is not null and trim(term) <> '' group by 1, 2", "select count(*)::double nn from s where g is not null", "character_id"
).lstrip()


def vocabulary_drift(spark, sf_dir):
    """Terms of an older vocabulary that no longer occur, and how far the weights of the others have moved."""
    rows = _ngram_rows(spark, sf_dir)
    counts = rows.select("character_id", F.explode("ngrams").alias("ngram")).distinct().groupBy("ngram").agg(F.count("*").alias("df"))
    n = rows.where("ngrams is not null").agg(F.count("*").cast("double").alias("n"))
    old = table(spark, sf_dir, "tfidf_vocabulary").join(counts, "ngram", "left").join(F.broadcast(n))
    now = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return old.select("term_index", "ngram", F.coalesce("df", F.lit(0)).alias("df"), F.round(now - F.col("idf"), 5).alias("moved"))


SQL["vocabulary_drift"] = f"""
  with {_NG}, d as (select term ngram, count(distinct character_id) df from (select character_id, unnest(g) term from s) where term is not null and trim(term) <> '' group by 1),
  n as (select count(*)::double nn from s where g is not null)
  select term_index, ngram, coalesce(df, 0) df, round(ln((1 + nn) / (1 + df)) + 1 - idf, 5) moved from tfidf_vocabulary left join d using (ngram), n"""


def _features(spark, sf_dir):
    rows = table(spark, sf_dir, "semantic_features").where("character_id is not null").groupBy("character_id").agg(F.max("features").alias("features"))
    return rows.select("character_id", F.explode("features").alias("f")).select("character_id", "f.*").where("feature is not null and trim(feature) <> ''")


_FT = """f as (select character_id, x.feature feature, x.kind kind, x.lexname lexname from (select character_id, unnest(fs) x from
  (select character_id, max(features) fs from semantic_features where character_id is not null group by 1)) where x.feature is not null and trim(x.feature) <> '')"""


def feature_channels(spark, sf_dir):
    return ngrams.feature_channels(_features(spark, sf_dir))


SQL["feature_channels"] = f"""
  with {_FT}, c as (select feature, count(*) filter (where lexname like 'adj.%') + count(*) filter (where kind = 'attribute_modifier') + count(*) filter (where kind = 'morphological_like') style,
    count(*) filter (where lexname like 'noun.%' and lexname <> 'noun.attribute') noun from f group by 1)
  select feature, style, noun, style > 0 and style > noun is_style from c"""


def feature_kinds(spark, sf_dir):
    """Assignments by kind and class of sense."""
    return _features(spark, sf_dir).groupBy("kind", "lexname").agg(F.count("*").alias("assignments"), F.count_distinct("character_id").alias("characters"))


SQL["feature_kinds"] = f"with {_FT} select kind, lexname, count(*) assignments, count(distinct character_id) characters from f group by 1, 2"


def clean_features(spark, sf_dir):
    """Features in their clean form, with the number of spellings."""
    rows = _features(spark, sf_dir).select(T.clean_feature("feature").alias("clean"), "feature").where("clean <> ''")
    return rows.groupBy("clean").agg(F.count_distinct("feature").alias("spellings"), F.count("*").alias("uses"))


SQL["clean_features"] = rf"""
  with {_FT}, c as (select trim(regexp_replace(regexp_replace(lower(replace(replace(feature, '-like', ''), '-', ' ')), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) clean, feature from f)
  select clean, count(distinct feature) spellings, count(*) uses from c where clean <> '' group by 1"""


def _tagged(spark, sf_dir):
    """All texts with tags made by rules."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return materialize(ngrams.tagged_tokens(rule_tags(rows, "doc_id", "text")), "tagged")


def suppressed_adjectives(spark, sf_dir):
    return ngrams.suppressed_adjectives(_tagged(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


def _in(values):
    return "(" + ", ".join(f"'{x}'" for x in sorted(values)) + ")"


# windows compared one by one: each of 2 to 6 tokens, and whether a longer one is around it
_WINDOWS = f"""
  n as (select doc_id, {_F1} norm from documents where text is not null),
  w as (select doc_id, unnest(ws) token, generate_subscripts(ws, 1) - 1 token_no from (select doc_id, regexp_extract_all(norm, '[A-Za-z][A-Za-z0-9]*') ws from n)),
  g as (select doc_id, token_no, token, lower(token) word, case when token_no > 0 and regexp_matches(token, '^[A-Z]') then 'NNP' when lower(token) in ('the', 'a', 'an', 'this', 'that', 'every') then 'DT'
    when lower(token) in ('of', 'in', 'on', 'at', 'by', 'with', 'for', 'to', 'from', 'near') then 'IN' when lower(token) in ('he', 'she', 'they', 'it', 'him', 'her', 'them') then 'PRP'
    when lower(token) like '%ing' then 'VBG' when lower(token) like '%ed' then 'VBD' when regexp_matches(lower(token), '(ous|ful|less|ive|able|ible|al|ic|ish|ern|ary)$') then 'JJ'
    when lower(token) like '%ly' then 'RB' when regexp_matches(lower(token), '[^s]s$') then 'NNS' else 'NN' end tag from w where len(token) >= 3),
  k as (select *, row_number() over (partition by doc_id order by token_no) k, word not in {_in(T.PHRASE_STOPWORDS | T.RESIDUES)} and tag in ('NN', 'NNS', 'JJ', 'VBG') ok,
    word not in {_in(T.PHRASE_STOPWORDS | T.RESIDUES)} and tag = 'JJ' adj from g),
  o as (select a.doc_id, a.k first, b.k as last, b.word, b.ok, b.adj, b.tag from k a join k b on a.doc_id = b.doc_id and b.k between a.k and a.k + 5 where a.ok),
  c as (select doc_id, first, last, last - first + 1 size, string_agg(word, ' ') over p term, bool_and(ok) over p ok, bool_or(adj) over p adj, bool_or(tag = 'VBG') over p gerund, bool_or(tag in ('NN', 'NNS')) over p noun,
    bool_or(word = before) over p again from (select *, lag(word) over (partition by doc_id, first order by last) before from o)
    window p as (partition by doc_id, first order by last rows unbounded preceding)),
  v as (select * from c where size >= 2 and ok and not coalesce(again, false) and (not gerund or noun)),
  s as (select k.doc_id, k.k, k.word, exists (select 1 from v where v.doc_id = k.doc_id and v.first <= k.k and k.k <= v.last) blocked from k where adj),
  sup as (select word adjective, count(distinct doc_id) filter (where not blocked) standalone_docs, count(distinct doc_id) filter (where blocked) blocked_docs from s group by 1)"""
SQL["suppressed_adjectives"] = f"""
  with {_WINDOWS} select adjective, standalone_docs, blocked_docs, round(blocked_docs / (standalone_docs + blocked_docs), 6) ratio from sup where blocked_docs / (standalone_docs + blocked_docs) >= 0.8"""


def descriptor_ngrams(spark, sf_dir):
    """Descriptors of all documents, with rule-made tags: terms by documents and occurrences."""
    tagged = _tagged(spark, sf_dir)
    return ngrams.term_documents(ngrams.descriptor_ngrams(tagged, ngrams.suppressed_adjectives(tagged)))


SQL["descriptor_ngrams"] = f"""
  with {_WINDOWS},
  f as (select doc_id, word term from s where not blocked and word not in (select adjective from sup where blocked_docs / (standalone_docs + blocked_docs) >= 0.8)
    union all select doc_id, term from v where not adj and not exists (select 1 from v u where u.doc_id = v.doc_id and u.size > v.size and u.first <= v.first and v.last <= u.last))
  select term, count(distinct doc_id) docs, count(*) occurrences from f group by 1"""


def _lexicon(spark, sf_dir):
    """Senses of the features' last words and of whole features, as the stored features have them; nouns in the plural as lemmas."""
    synsets = table(spark, sf_dir, "semantic_features").select(F.explode("features").alias("f")).select(F.lower("f.feature").alias("feature"), "f.lexname", "f.synset").where("lexname is not null and synset is not null")
    clean = T.clean_feature("feature")
    lemma = F.explode(F.array(clean, F.element_at(F.split(clean, " "), -1))).alias("lemma")
    each = synsets.select(lemma, "lexname", "synset").where("lemma <> ''").distinct().withColumn("pos", F.when(F.col("lexname").startswith("adj."), "a").otherwise("n"))
    rank = F.row_number().over(Window.partitionBy("lemma", "pos").orderBy("lexname", "synset"))
    return each.withColumn("rank", rank).withColumn("head_lemma", F.split("synset", r"\.")[0])


def semantic_features(spark, sf_dir):
    """Features of all documents by rule-made tags and the senses of the stored features: documents by feature, kind and class."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    each = docs.select("doc_id", F.posexplode(T.sentences(T.normalize_description("text"))).alias("sentence_no", "sentence"))
    tokens = F.transform(T.words("sentence"), lambda x, i: F.struct(i.alias("at"), x.alias("token"), rule_tag(x, F.lit(0)).alias("tag"), x.alias("word")))
    rows = materialize(each.select("doc_id", "sentence_no", tokens.alias("tokens")), "sentences")
    plural = rows.select(F.explode("tokens").alias("t")).where("t.tag = 'NNS'").select(F.col("t.word").alias("token"), F.lit("n").alias("pos")).distinct()
    lemmas = plural.withColumn("lemma", F.regexp_replace("token", "s$", ""))
    found = ngrams.semantic_features(rows, _lexicon(spark, sf_dir), lemmas)
    return found.groupBy("feature", "kind", "lexname", F.coalesce("synset", F.lit("")).alias("synset")).agg(F.count("*").alias("docs"))


_RULE_TAG = """case when {0} in ('the', 'a', 'an', 'this', 'that', 'every') then 'DT' when {0} in ('of', 'in', 'on', 'at', 'by', 'with', 'for', 'to', 'from', 'near') then 'IN' when {0} in ('he', 'she', 'they', 'it', 'him', 'her', 'them') then 'PRP'
    when {0} like '%ing' then 'VBG' when {0} like '%ed' then 'VBD' when regexp_matches({0}, '(ous|ful|less|ive|able|ible|al|ic|ish|ern|ary)$') then 'JJ' when {0} like '%ly' then 'RB' when regexp_matches({0}, '[^s]s$') then 'NNS' else 'NN' end"""
_CLEAN = r"trim(regexp_replace(regexp_replace(lower(replace(replace({0}, '-like', ''), '-', ' ')), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
SQL["semantic_features"] = rf"""
  with f as (select lower(x.feature) feature, x.lexname lexname, x.synset synset from (select unnest(features) x from semantic_features) where x.lexname is not null and x.synset is not null and x.feature is not null),
  l0 as (select distinct unnest([c, string_split(c, ' ')[-1]]) lemma, lexname, synset from (select {_CLEAN.format("feature")} c, lexname, synset from f)),
  l1 as (select *, case when lexname like 'adj.%' then 'a' else 'n' end pos from l0 where lemma <> ''),
  sn as (select *, row_number() over (partition by lemma, pos order by lexname, synset) rank, string_split(synset, '.')[1] head_lemma from l1),
  n as (select doc_id, lower({_F1}) norm from documents where text is not null),
  s as (select doc_id, unnest(p) sentence, generate_subscripts(p, 1) - 1 sentence_no from (select doc_id, string_split(regexp_replace(norm, '([.!?;])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)) p from n)),
  w as (select doc_id, sentence_no, unnest(ws) word, generate_subscripts(ws, 1) - 1 at_ from (select doc_id, sentence_no, regexp_extract_all(sentence, '[A-Za-z][A-Za-z0-9]*') ws from s)),
  t as (select *, {_RULE_TAG.format("word")} tag from w), c as (select *, len(word) >= 2 and word not in {_in(T.STOPWORDS | T.RESIDUES)} and tag in ('JJ', 'VBG', 'NN', 'NNS') ok, case when tag = 'NNS' then regexp_replace(word, 's$', '') else word end lemma from t),
  o as (select a.doc_id, a.sentence_no, a.at_ first, b.at_ last, b.tag, b.lemma, b.word, b.ok from c a join c b on a.doc_id = b.doc_id and a.sentence_no = b.sentence_no and b.at_ between a.at_ and a.at_ + 4 where a.ok),
  sp as (select *, last - first + 1 size, string_agg(lemma, ' ') over p phrase, coalesce(string_agg(lemma, ' ') over q, '') modifiers, bool_and(ok) over p fine, coalesce(bool_or(tag in ('JJ', 'VBG')) over q, false) modified from o
    window p as (partition by doc_id, sentence_no, first order by last rows unbounded preceding), q as (partition by doc_id, sentence_no, first order by last rows between unbounded preceding and 1 preceding)),
  v as (select * from sp where fine and case when size = 1 then tag in ('JJ', 'VBG') else tag in ('NN', 'NNS') end),
  ex as (select lemma, pos, arg_min(lexname, rank) xl, arg_min(synset, rank) xs from sn where lexname not in {_in(ngrams.NO_FEATURE)} group by 1, 2),
  ow as (select lemma, lexname ol, synset os, head_lemma oh from sn where pos = 'n' and rank = 1 and lexname not in {_in(ngrams.NO_FEATURE)}),
  aj as (select lemma, count(*) filter (where lexname like 'adj.%') adj, count(*) any_ from sn group by 1),
  j as (select v.*, xl, xs, ol, os, oh, coalesce(adj, 0) adj, any_ from v left join ex on ex.lemma = phrase and ex.pos = case when size = 1 then 'a' else 'n' end left join ow on ow.lemma = v.lemma left join aj on aj.lemma = phrase),
  r as (select doc_id, sentence_no, first, size, 0 seq, phrase feature, 'surface_wordnet_phrase' kind, xl lexname, xs synset from j where xl is not null and xl not like 'verb.%'
    union all select doc_id, sentence_no, first, size, 2, phrase, 'surface_modifier', 'adj_or_unknown', '' from j where size = 1 and tag in ('JJ', 'VBG') and (adj > 0 or any_ is null)
    union all select doc_id, sentence_no, first, size, 3, phrase, 'surface_role_phrase', ol, os from j where size > 1 and ol in {_in(ngrams.ROLE)}
    union all select doc_id, sentence_no, first, size, 4, replace(oh, '_', ' '), 'wordnet_role_head', ol, os from j where size > 1 and ol in {_in(ngrams.ROLE)}
    union all select doc_id, sentence_no, first, size, 5, modifiers, 'attribute_modifier', ol, os from j where size > 1 and ol in {_in(ngrams.ATTRIBUTE)} and modified
    union all select doc_id, sentence_no, first, size, 6, phrase, 'surface_attribute_phrase', ol, os from j where size > 1 and ol in {_in(ngrams.ATTRIBUTE)} and not modified
    union all select doc_id, sentence_no, first, size, 7, phrase, 'surface_event_phrase', ol, os from j where size > 1 and ol in {_in(ngrams.EVENT)}),
  z as (select doc_id, {_CLEAN.format("feature")} feature, kind, lexname, synset, sentence_no, first, size, seq from r),
  b as (select * from z where length(feature) >= 3 and feature not in {_in(T.STOPWORDS)} qualify row_number() over (partition by doc_id, feature order by sentence_no, first, size, seq) = 1)
  select feature, kind, lexname, coalesce(synset, '') synset, count(*) docs from b group by 1, 2, 3, 4"""


QUERIES |= {
    "normalized_descriptions": normalized_descriptions, "source_texts": source_texts, "ngram_counts": ngram_counts, "tfidf_words": tfidf_words, "tfidf_ngrams": tfidf_ngrams,
    "vocabulary_drift": vocabulary_drift, "feature_channels": feature_channels, "feature_kinds": feature_kinds, "clean_features": clean_features,
    "semantic_features": semantic_features, "suppressed_adjectives": suppressed_adjectives, "descriptor_ngrams": descriptor_ngrams,
}
