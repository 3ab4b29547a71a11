"""Text normalisers, tokenisers and slugs as column expressions.

Only HTML entities and compatibility decomposition have no built-in function; decoded() does both in one Arrow
function, over the distinct values of a batch.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the patterns of markup that the normalisers remove
HTML_TAG = r"<[^>]+>"
MARKDOWN_LINK = r"\[([^\]]+)\]\(https?://[^)]+\)"
ANY_LINK = r"\[[^\]]+\]\([^)]+\)"
BBCODE = r"(?i)\[/?(?:b|i|u|s|center|spoiler|url(?:=[^\]]+)?)\]"
URL = r"https?://\S+"
WORD = r"[A-Za-z][A-Za-z0-9]*"
COMPOUND = r"[A-Za-z][A-Za-z]*(?:-[A-Za-z][A-Za-z]*)?"
APOSTROPHE_WORD = r"[A-Za-z][A-Za-z'-]*"

# fixed values: words that are no descriptors
STOPWORDS = frozenset(
    """
    a about above across after again against all almost alone along already also although
    always am among an and another any anyone anything anywhere are around as at back be
    because become been before being below between both but by can cannot could de do done
    down due during each either else enough etc even ever every everyone everything except
    few for former from full further get give go had has have he her here hers herself him
    himself his how i if in into is it its itself keep last least less made many may me
    might more most mostly much must my myself name neither never no nor not nothing now of
    off often on once one only or other our out over own perhaps put rather same see seem
    several she should since so some someone something still such take than that the their
    them themselves then there these they this those though through to together too under
    until up upon us very via was we well were what when where whether which while who whom
    whose why will with within without would yet you your yourself
    """.split()
)
# fixed values: further words that are no part of a phrase
PHRASE_STOPWORDS = STOPWORDS | frozenset(
    """
    afterwards amongst amount became becomes becoming beforehand besides beyond cant describe eg elsewhere empty
    everywhere formerly found hence latter meanwhile mine moreover move onto otherwise ours ourselves per seemed
    seeming seems serious show side theirs thereby therefore throughout toward towards un whatever whereas
    whoever whole yours yourselves
    """.split()
)
# fixed values: what tokenising leaves of contractions
RESIDUES = frozenset("aren couldn didn doesn don hadn hasn haven isn ll re shouldn ve wasn weren won wouldn".split())


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"), na_action="ignore")


def _without_markup(text: Column) -> Column:
    for pattern, to in ((MARKDOWN_LINK, "$1"), (BBCODE, " "), (HTML_TAG, " "), (URL, " ")):
        text = F.regexp_replace(text, pattern, to)
    return text


# white space of any script
SPACE = r"[\s\p{Z}\x0b\x85]+"


def collapse(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_description(text: str | Column, lowercase: bool = True) -> Column:
    """Entities decoded, links to their text, markup and addresses to spaces, ASCII only, line ends (also written ones) to
    spaces; white space isn't collapsed. Null gives ''."""
    out = _decomposed(_without_markup(_unescaped(F.coalesce(_col(text), F.lit("")))))
    out = F.regexp_replace(out, r"\\n|\n|\r", " ")
    return F.lower(out) if lowercase else out


def normalize_semantic(text: str | Column, lowercase: bool = True) -> Column:
    """As normalize_description(), and emphasis marks to spaces and white space collapsed."""
    out = _decomposed(_without_markup(_unescaped(F.coalesce(_col(text), F.lit("")))))
    out = collapse(F.regexp_replace(out, r"[_*`]+", " "))
    return F.lower(out) if lowercase else out


def normalize_source(text: str | Column) -> Column:
    """Tags, whole links and addresses to spaces, white space collapsed; nothing is decoded or lowered."""
    out = _col(text)
    for pattern in (HTML_TAG, ANY_LINK, URL):
        out = F.regexp_replace(out, pattern, " ")
    return collapse(out)


def normalize_evidence(text: str | Column) -> Column:
    """White space collapsed, quotation marks stripped at both ends."""
    return F.btrim(collapse(_col(text)), F.lit("\"'“”‘’"))


def words(text: str | Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(f"({pattern})"), F.lit(1))


def sentences(text: str | Column) -> Column:
    return F.split(_col(text), r"(?<=[.!?;])\s+|\n+")


def clean_feature(text: str | Column) -> Column:
    """'-like' dropped, hyphens to spaces, lower case, letters and digits only, white space collapsed."""
    out = F.replace(F.replace(_col(text), F.lit("-like"), F.lit("")), F.lit("-"), F.lit(" "))
    return collapse(F.regexp_replace(F.lower(out), r"[^a-z0-9 ]+", " "))


def slug(text: str | Column, fallback: str = "value") -> Column:
    """Lower case with each run of other characters as one underscore, none at the ends; `fallback` if nothing is left."""
    out = F.btrim(F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(fallback))


def tag_key(category: str | Column, name: str | Column) -> Column:
    """category:name in lower case with underscores; the name alone where either is empty."""
    c = F.regexp_replace(F.lower(F.trim(F.coalesce(_col(category), F.lit("")))), r"\s+", "_")
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(_col(name), F.lit("")))), r"\s+", "_"), r"[^a-z0-9_]+", "")
    return F.when((c != "") & (n != ""), F.concat_ws(":", c, n)).otherwise(n)


def windows(tokens: str | Column, least: int, most: int) -> Column:
    """All runs of `least` to `most` neighbouring tokens, joined by spaces; none where there are fewer tokens."""
    t = _col(tokens)

    def of(size: int) -> Column:
        starts = F.when(F.size(t) >= size, F.sequence(F.lit(1), F.size(t) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(size)), " "))

    return F.flatten(F.array(*[of(size) for size in range(least, most + 1)]))


def informative(term: str | Column, least: int = 3) -> Column:
    """Whether a term has a token of at least `least` characters."""
    return F.exists(F.split(_col(term), " "), lambda x: F.length(x) >= least)


def distinct_ignoring_case(values: str | Column) -> Column:
    """Values with white space collapsed, in order, without empty ones and those that equal an earlier one in any case."""
    tidy = F.filter(F.transform(_col(values), lambda x: collapse(x)), lambda x: x.isNotNull() & (x != ""))
    return F.filter(tidy, lambda x, i: ~F.exists(F.slice(tidy, 1, i), lambda y: F.lower(y) == F.lower(x)))


def short_phrases(values: str | Column, fallback: str | Column, most: int) -> Column:
    """The variants of 1 to `most` words, stripped of marks, distinct in order; the fallback alone if there are none."""
    tidy = F.transform(_col(values), lambda x: F.btrim(collapse(x), F.lit(" .。!?！？\"'“”‘’")))
    kept = distinct_ignoring_case(F.filter(tidy, lambda x: F.regexp_count(x, F.lit(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?")).between(1, most)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(_col(fallback)))


def padded(values: str | Column, size: int = 4) -> Column:
    """Exactly `size` values, the last repeated or the rest cut."""
    v = _col(values)
    return F.slice(F.concat(v, F.array_repeat(F.element_at(v, -1), size)), 1, size)


def evidence_supported(evidence: str | Column, description: str | Column) -> Column:
    """Whether the evidence is in the description, or all its fragments of 4 characters and more between ellipses are, in
    order and without overlap; both in lower case, the description normalised by normalize_source()."""
    return evidence_in(evidence, F.lower(normalize_source(description)))


def evidence_in(evidence: str | Column, normal: str | Column) -> Column:
    """evidence_supported() for a description that is normalised and in lower case already, which one of many tags is."""
    e, d = F.lower(normalize_evidence(evidence)), _col(normal)
    parts = F.transform(F.split(e, r"(?:\.\.\.|…)+"), lambda x: F.btrim(normalize_source(x), F.lit(" .")))
    parts = F.filter(parts, lambda x: F.length(x) >= 4)

    def step(cursor: Column, part: Column) -> Column:
        at = F.call_function("locate", part, d, cursor)
        return F.when((cursor < 1) | (at < 1), F.lit(0)).otherwise(at + F.length(part))

    ordered = (F.size(parts) > 0) & (F.aggregate(parts, F.lit(1), step) > 0)
    return F.coalesce((F.length(F.coalesce(_col(evidence), F.lit(""))) > 0) & (F.contains(d, e) | ordered), F.lit(False))


def json_object(text: str | Column, schema: str) -> Column:
    """The text as a JSON object of `schema`; failing that, what is between its outermost braces."""
    t = _col(text)
    bare = F.btrim(t)
    return F.coalesce(
        F.when(bare.startswith("{") & bare.endswith("}"), F.from_json(bare, schema)), F.from_json(F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")), schema)
    )


def content_of(message: str | Column, thinking: str | Column) -> Column:
    return F.coalesce(F.nullif(_col(message), F.lit("")), F.nullif(_col(thinking), F.lit("")))


_LABEL = T.StructType().add("label", "string").add("description", "string").add("confidence", "string").add("evidence_terms", T.ArrayType(T.StringType()))


@F.pandas_udf(_LABEL)
def last_label(values: pd.Series) -> pd.DataFrame:
    """The last JSON object in a free text that has the four fields of a label; null fields if there is none."""
    import json

    decoder, out = json.JSONDecoder(), []
    wanted = ("label", "description", "confidence", "evidence_terms")
    for text in values:
        found, at = None, -1
        while text is not None and (at := text.find("{", at + 1)) >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
            except ValueError:
                continue
            if isinstance(value, dict) and all(k in value for k in wanted):
                found = value
        row = found or dict.fromkeys(wanted)
        terms = row["evidence_terms"]
        out.append([None if row[k] is None else str(row[k]) for k in wanted[:3]] + [[str(x) for x in terms] if isinstance(terms, list) else None])
    return pd.DataFrame(out, columns=list(wanted))


def valid_label(label: Column, terms: Column) -> Column:
    """A label with evidence limited to the given terms (8 at most, repeats kept), a known confidence and bounded text."""
    confidence = F.lower(label["confidence"])
    return F.struct(
        F.substring(F.trim(F.coalesce(label["label"], F.lit(""))), 1, 80).alias("label"),
        F.substring(F.trim(F.coalesce(label["description"], F.lit(""))), 1, 240).alias("description"),
        F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("medium").alias("confidence"),
        F.slice(F.filter(label["evidence_terms"], lambda x: F.array_contains(terms, x)), 1, 8).alias("evidence_terms"),
    )
