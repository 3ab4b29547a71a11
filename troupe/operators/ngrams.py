"""Descriptive phrases of part-of-speech tagged texts, and their weights.

Tags, senses and lemmas come as tables; nothing is looked up in a lexicon. Phrase extraction works on one array of
tagged tokens per document, inside built-in array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from troupe.functions.text import PHRASE_STOPWORDS, RESIDUES, STOPWORDS, clean_feature

# fixed values: part-of-speech tags
NOUNS = ("NN", "NNS")
ADJECTIVES = ("JJ", "JJR", "JJS")
ALLOWED = (*NOUNS, *ADJECTIVES, "VBG")
CHUNK = (*ADJECTIVES, "VBG", "VBN", *NOUNS)
# fixed values: classes of senses
NO_FEATURE = ("noun.animal", "noun.artifact", "noun.body", "noun.food", "noun.location", "noun.object", "noun.plant", "noun.quantity", "noun.shape", "noun.substance", "noun.time")
ATTRIBUTE = ("noun.attribute", "noun.cognition", "noun.feeling", "noun.Tops")
ROLE = ("noun.person", "noun.group")
EVENT = ("noun.act", "noun.communication", "noun.relation", "noun.state")

_BLOCKED_WORDS = sorted(STOPWORDS | RESIDUES)
_NO_PHRASE_WORDS = sorted(PHRASE_STOPWORDS | RESIDUES)


def _is(tag: Column, tags: tuple[str, ...]) -> Column:
    return tag.isin(*tags)


def tagged_tokens(pos_tags: DataFrame, doc: str = "doc_id", least_chars: int = 3, most: int = 6) -> DataFrame:
    """(doc_id, k, word, adjective, reach, before, phrases): the tokens of at least `least_chars` characters of every document, in order, so that
    windows bridge short words; `phrases` are the windows of 2 to `most` tokens that begin at a token and may be phrases, `reach` is the place
    of the last token of the longest of them (0 if there is none), and `before` the furthest reach of any earlier token.

    A window may be a phrase if it has no stop words and no equal neighbours, nouns, adjectives and gerunds only, and a noun if it has a gerund.
    All of it is one pass over tokens that are sorted within their document; no two windows are ever compared."""
    kept = pos_tags.where((F.length("token") >= least_chars) & ~F.col("token").rlike("^[0-9]+$"))
    word, known = F.lower("token"), ~F.lower("token").isin(*_NO_PHRASE_WORDS)
    rows = kept.select(
        doc, F.col("token_no").cast("int").alias("token_no"), word.alias("word"), (known & _is(F.col("tag"), ALLOWED)).alias("ok"),
        (known & _is(F.col("tag"), ADJECTIVES)).alias("adjective"), _is(F.col("tag"), NOUNS).alias("noun"), (F.col("tag") == "VBG").alias("gerund"),
    )
    order = Window.partitionBy(doc).orderBy("token_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # a run ends before a word that is no part of a phrase and before one that repeats its neighbour
    broken = ~F.col("ok") | F.coalesce(F.lag("word").over(order) == F.col("word"), F.lit(False))
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("run", F.when(F.col("ok"), F.sum(broken.cast("int")).over(so_far)))
    ahead = [(F.lead("run", n).over(order).alias(f"run{n}"), F.lead(F.struct("word", "adjective", "noun", "gerund"), n).over(order).alias(f"t{n}")) for n in range(1, most)]
    rows = rows.select("*", *[x for pair in ahead for x in pair])
    found, term, flags = [], F.col("word"), [F.col(c) for c in ("adjective", "noun", "gerund")]
    for n in range(1, most):
        term = F.concat_ws(" ", term, F.col(f"t{n}.word"))
        flags = [f | F.col(f"t{n}.{c}") for f, c in zip(flags, ("adjective", "noun", "gerund"))]
        fit = (F.col(f"run{n}") == F.col("run")) & (flags[1] | ~flags[2])
        found.append(F.when(fit, F.struct((F.col("k") + n).alias("last"), F.lit(n + 1).alias("size"), term.alias("term"), flags[0].alias("adjective"))))
    rows = rows.select(doc, "token_no", "k", "word", "adjective", F.array_compact(F.array(*found)).alias("phrases"))
    rows = rows.withColumn("reach", F.coalesce(F.try_element_at("phrases", F.lit(-1))["last"], F.lit(0)))
    before = F.coalesce(F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(doc, "k", "word", "adjective", "reach", before.alias("before"), "phrases")


def suppressed_adjectives(tokens: DataFrame, doc: str = "doc_id", threshold: float = 0.80) -> DataFrame:
    """(adjective, standalone_docs, blocked_docs, ratio) of tagged_tokens(): adjectives that mostly modify something. An occurrence is blocked if a
    phrase of two or more words covers it; a document may count on both sides."""
    blocked = F.greatest("reach", "before") >= F.col("k")
    each = tokens.where("adjective").groupBy(F.col("word").alias("adjective"), doc).agg(F.max((~blocked).cast("int")).alias("standalone"), F.max(blocked.cast("int")).alias("blocked"))
    counts = each.groupBy("adjective").agg(F.sum("standalone").alias("standalone_docs"), F.sum("blocked").alias("blocked_docs"))
    ratio = F.col("blocked_docs") / (F.col("standalone_docs") + F.col("blocked_docs"))
    return counts.withColumn("ratio", ratio).where(F.col("ratio") >= threshold)


def descriptor_ngrams(tokens: DataFrame, suppressed: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """(doc_id, term, occurrences) of tagged_tokens(): the descriptors of every document. Candidates are adjectives that aren't suppressed and
    phrases; one inside a longer candidate is dropped by its place, and phrases that hold an adjective suppress without being descriptors."""
    single = F.when(F.col("adjective"), F.struct(F.col("k").alias("last"), F.lit(1).alias("size"), F.col("word").alias("term"), F.lit(False).alias("adjective")))
    # a longer phrase around a candidate begins before it and reaches as far, or begins with it and reaches further
    alone = lambda c: ~c["adjective"] & (F.col("before") < c["last"]) & (F.col("reach") <= c["last"])
    terms = tokens.select(doc, F.explode(F.filter(F.concat(F.array_compact(F.array(single)), "phrases"), alone)).alias("c")).select(doc, "c.term", "c.size")
    if suppressed is not None:
        # the size of the table decides how it is joined
        terms = terms.join(suppressed.select(F.col("adjective").alias("term"), F.lit(1).alias("size")), ["term", "size"], "left_anti")
    return terms.groupBy(doc, "term").agg(F.count("*").alias("occurrences"))


def term_documents(ngrams: DataFrame) -> DataFrame:
    """(term, docs, occurrences) of (doc_id, term, occurrences), one row for each document and term."""
    return ngrams.groupBy("term").agg(F.count("*").alias("docs"), F.sum("occurrences").alias("occurrences"))


def tf_idf(counts: DataFrame, doc: str, term: str, count: str, n_docs: DataFrame, min_df: int = 3, max_df: float = 0.45, max_features: int = 30_000) -> DataFrame:
    """(doc, term, value): (1 + ln count) x (ln((1 + n) / (1 + df)) + 1), each document scaled to length 1.

    Terms of fewer than `min_df` documents or more than `max_df` of them are left out, then all but the `max_features` with most
    occurrences (ties by term). n_docs is one row (n) and also counts documents without terms."""
    stats = counts.groupBy(term).agg(F.count("*").alias("df"), F.sum(count).alias("total"))
    fit = stats.join(F.broadcast(n_docs)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    kept = fit.orderBy(F.desc("total"), term).limit(max_features).select(term, (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(kept, term).select(doc, term, ((1 + F.log(F.col(count).cast("double"))) * F.col("idf")).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return raw.select(doc, term, (F.col("raw") / length).alias("value"))


def feature_channels(features: DataFrame) -> DataFrame:
    """(feature, style, noun, is_style) of (feature, kind, lexname): whether a feature describes manner rather than things."""
    lex, kind = F.coalesce("lexname", F.lit("")), F.coalesce("kind", F.lit(""))
    style = F.count_if(lex.startswith("adj.")) + F.count_if(kind == "attribute_modifier") + F.count_if(kind == "morphological_like")
    noun = F.count_if(lex.startswith("noun.") & (lex != "noun.attribute"))
    return features.groupBy("feature").agg(style.alias("style"), noun.alias("noun")).withColumn("is_style", (F.col("style") > 0) & (F.col("style") > F.col("noun")))


def span_candidates(tokens: Column, most: int = 5) -> Column:
    """Windows of 1 to `most` tagged tokens of a sentence that may carry a feature."""

    def of(size: int) -> Column:
        starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - size + 1)).otherwise(F.array().cast("array<int>"))

        def fit(w: Column) -> Column:
            clean = F.forall(w, lambda t: (F.length(t["word"]) >= 2) & ~t["word"].isin(*_BLOCKED_WORDS) & _is(t["tag"], CHUNK))
            head = F.element_at(w, -1)
            alone = head["tag"].startswith("JJ") | (head["tag"] == "VBG") | head["word"].endswith("-like")
            return clean & (alone if size == 1 else _is(head["tag"], NOUNS))

        return F.filter(F.transform(starts, lambda i: F.slice(tokens, i, F.lit(size))), fit)

    return F.flatten(F.array(*[of(size) for size in range(1, most + 1)]))


def semantic_features(sentences: DataFrame, senses: DataFrame, lemmas: DataFrame, doc: str = "doc_id", most: int = 5) -> DataFrame:
    """(doc_id, feature, source_phrase, kind, lexname, synset): features of every document, the first of each by sentence and place.

    sentences: (doc_id, sentence_no, tokens array<struct<at, token, tag, word>>). senses: (lemma, pos, rank, lexname, synset, head_lemma),
    rank 1 the first sense. lemmas: (token, pos, lemma); a word without one is its own. A phrase has a sense of its own, or a feature by
    the first noun sense of its last word."""
    # every token gets its lemma once, before it is in several spans
    each = sentences.select(doc, "sentence_no", F.posexplode("tokens").alias("k", "t"))
    pos = F.when(F.col("t.tag").startswith("J"), "a").when(F.col("t.tag").startswith("V"), "v").otherwise("n")
    each = each.withColumn("pos", pos).withColumn("bare", F.regexp_replace("t.word", "-like$", "")).join(lemmas.select(F.col("token").alias("bare"), "pos", "lemma"), ["bare", "pos"], "left")
    word = F.struct("k", F.coalesce("lemma", "bare").alias("lemma"), F.col("t.at").alias("at"), F.col("t.token").alias("token"), F.col("t.tag").alias("tag"), F.col("t.word").alias("word"))
    known = each.groupBy(doc, "sentence_no").agg(F.array_sort(F.collect_list(word)).alias("tokens"))
    spans = known.select(doc, "sentence_no", F.explode(span_candidates(F.col("tokens"), most)).alias("w"))
    back = spans.select(doc, "sentence_no", F.element_at("w", 1)["at"].alias("first"), F.size("w").alias("size"), "w")
    lemma = F.transform("w", lambda t: t["lemma"])
    head = F.element_at("w", -1)
    rows = back.select(
        doc, "sentence_no", "first", "size", "w", head["tag"].alias("tag"), head["word"].alias("word"), F.element_at(lemma, -1).alias("head"),
        clean_feature(F.array_join(lemma, " ")).alias("phrase"),
        F.when(F.col("size") > 1, clean_feature(F.array_join(F.slice(lemma, 1, F.size(lemma) - 1), " "))).alias("modifiers"),
        F.array_join(F.transform("w", lambda t: t["token"]), " ").alias("source_phrase"),
        F.exists(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda t: t["tag"].startswith("JJ") | t["tag"].isin("VBG", "VBN")).alias("modified"),
    ).where("phrase <> ''")
    usable = senses.where(~F.col("lexname").isin(*NO_FEATURE))
    exact = usable.groupBy("lemma", "pos").agg(F.min_by(F.struct("lexname", "synset"), "rank").alias("exact"))
    first_noun = senses.where((F.col("pos") == "n") & (F.col("rank") == 1) & ~F.col("lexname").isin(*NO_FEATURE))
    heads = first_noun.select(F.col("lemma").alias("head"), F.struct("lexname", "synset", "head_lemma").alias("own"))
    adjectives = senses.groupBy("lemma").agg(F.count_if(F.col("lexname").startswith("adj.")).alias("adj"), F.count("*").alias("any"))
    phrase_pos = F.when((F.col("size") == 1) & (F.col("tag").startswith("JJ") | F.col("tag").isin("VBG", "VBN")), "a").otherwise("n")
    joined = (
        rows.withColumn("pos", phrase_pos)
        .join(exact.select(F.col("lemma").alias("phrase"), "pos", "exact"), ["phrase", "pos"], "left")
        .join(heads, "head", "left")
        .join(adjectives.select(F.col("lemma").alias("phrase"), "adj", "any"), "phrase", "left")
    )
    lex, many = F.col("own.lexname"), F.col("size") > 1

    def feature(seq: int, value: Column, kind: str, lexname: Column, synset: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), value.alias("feature"), F.lit(kind).alias("kind"), lexname.alias("lexname"), synset.alias("synset"))

    blank, like = F.lit(""), F.col("word").endswith("-like")
    own = lambda seq, value, kind: feature(seq, value, kind, lex, F.col("own.synset"))
    found = F.array(
        F.when(F.col("exact").isNotNull() & ~F.col("exact.lexname").startswith("verb."), feature(0, F.col("phrase"), "surface_wordnet_phrase", F.col("exact.lexname"), F.col("exact.synset"))),
        F.when(~many & like, feature(1, F.col("phrase"), "morphological_like", blank, blank)),
        F.when(
            ~many & ~like & (F.col("tag").startswith("JJ") | (F.col("tag") == "VBG")) & ((F.coalesce("adj", F.lit(0)) > 0) | F.col("any").isNull()),
            feature(2, F.col("phrase"), "surface_modifier", F.lit("adj_or_unknown"), blank),
        ),
        F.when(many & lex.isin(*ROLE), own(3, F.col("phrase"), "surface_role_phrase")),
        F.when(many & lex.isin(*ROLE), own(4, F.replace("own.head_lemma", F.lit("_"), F.lit(" ")), "wordnet_role_head")),
        F.when(many & lex.isin(*ATTRIBUTE) & F.col("modified"), own(5, F.col("modifiers"), "attribute_modifier")),
        F.when(many & lex.isin(*ATTRIBUTE) & ~F.col("modified"), own(6, F.col("phrase"), "surface_attribute_phrase")),
        F.when(many & lex.isin(*EVENT), own(7, F.col("phrase"), "surface_event_phrase")),
    )
    out = joined.select(doc, "sentence_no", "first", "size", "source_phrase", F.explode(F.array_compact(found)).alias("f"))
    out = out.select(doc, "sentence_no", "first", "size", "source_phrase", "f.seq", clean_feature("f.feature").alias("feature"), "f.kind", "f.lexname", "f.synset")
    out = out.where((F.length("feature") >= 3) & ~F.col("feature").isin(*sorted(STOPWORDS)))
    best = F.min_by(F.struct("source_phrase", "kind", "lexname", "synset"), F.struct("sentence_no", "first", "size", "seq"))
    return out.groupBy(doc, "feature").agg(best.alias("x")).select(doc, "feature", "x.*")
