"""Part-of-speech tags by rule, for data that comes without a table of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troupe.functions.text import WORD, normalize_description, words


def rule_tag(token: Column, at: Column) -> Column:
    """A tag from the form of an English word: capitals inside a text are proper nouns, endings give the rest."""
    low = F.lower(token)
    return (
        F.when((at > 0) & token.rlike("^[A-Z]"), "NNP")
        .when(low.isin("the", "a", "an", "this", "that", "every"), "DT")
        .when(low.isin("of", "in", "on", "at", "by", "with", "for", "to", "from", "near"), "IN")
        .when(low.isin("he", "she", "they", "it", "him", "her", "them"), "PRP")
        .when(low.rlike("ing$"), "VBG")
        .when(low.rlike("ed$"), "VBD")
        .when(low.rlike("(ous|ful|less|ive|able|ible|al|ic|ish|ern|ary)$"), "JJ")
        .when(low.rlike("ly$"), "RB")
        .when(low.rlike("[^s]s$"), "NNS")
        .otherwise("NN")
    )


def rule_tags(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc_id, token_no, token, tag) of every word of every text."""
    tokens = documents.select(doc, F.posexplode(words(normalize_description(text, lowercase=False), WORD)).alias("token_no", "token"))
    return tokens.withColumn("tag", rule_tag(F.col("token"), F.col("token_no")))
