"""Names, their comparable keys, titles, years and addresses as column expressions.

Three normal forms are kept apart on purpose: in A an accented letter becomes a space, in B it is dropped before
anything else, and C also decodes entities and drops what is in brackets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from troupe.functions.text import _col, _unescaped, collapse

# fixed values: words of a title that say nothing
TITLE_STOPWORDS = ("and", "the", "for", "with", "from", "season", "movie", "part")


def norm_a(name: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(name)), r"[^a-z0-9]+", " "))


def norm_b(name: str | Column) -> Column:
    ascii_only = F.regexp_replace(_col(name), r"[^\x00-\x7F]", "")
    return collapse(F.lower(F.regexp_replace(ascii_only, r"[^A-Za-z0-9 ]+", " ")))


def norm_c(name: str | Column) -> Column:
    return norm_b(F.regexp_replace(_unescaped(F.coalesce(_col(name), F.lit(""))), r"\([^)]*\)", " "))


def _parts(norm: Column) -> Column:
    return F.split(norm, " ")


def _keys(norm: Column, *more: Column) -> Column:
    return F.array_distinct(F.filter(F.array(norm, *more), lambda x: x.isNotNull() & (x != "")))


def keys_a(name: str | Column) -> Column:
    """The name and, of two words or more, the name reversed."""
    n = norm_a(name)
    return _keys(n, F.when(F.size(_parts(n)) >= 2, F.array_join(F.reverse(_parts(n)), " ")))


def keys_b(name: str | Column) -> Column:
    """The name, reversed, and with its words sorted."""
    n = norm_b(name)
    return _keys(n, F.array_join(F.reverse(_parts(n)), " "), F.array_join(F.array_sort(_parts(n)), " "))


def keys_c(name: str | Column, decode: bool = True) -> Column:
    """As keys_b() of the form C, and of more than two words also the first two, as they are and sorted."""
    n = norm_c(name) if decode else norm_b(F.regexp_replace(_col(name), r"\([^)]*\)", " "))
    two = F.slice(_parts(n), 1, 2)
    long = F.size(_parts(n)) > 2
    return _keys(
        n, F.array_join(F.reverse(_parts(n)), " "), F.array_join(F.array_sort(_parts(n)), " "), F.when(long, F.array_join(two, " ")), F.when(long, F.array_join(F.array_sort(two), " "))
    )


def search_aliases(name: str | Column, native: str | Column) -> Column:
    """Normal forms of the name, the native name and the name reversed, sorted, without empty ones."""
    n = norm_a(name)
    both = F.array(n, norm_a(native), F.when(F.size(_parts(n)) >= 2, F.array_join(F.reverse(_parts(n)), " ")))
    return F.array_sort(F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != ""))))


def title_tokens(title: str | Column) -> Column:
    """Distinct words of a title of 3 letters or more that aren't stop words."""
    return F.array_distinct(F.filter(_parts(norm_b(title)), lambda x: (F.length(x) >= 3) & ~x.isin(*TITLE_STOPWORDS)))


def _filled(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def first_of(value: str | Column, *fields: str) -> Column:
    """A value that is plain text or a JSON object as text: its first filled field of `fields`, or the text; '' if none."""
    v = _col(value)
    inside = [_filled(F.get_json_object(v, f"$.{f}")) for f in fields]
    return F.coalesce(F.when(F.ltrim(v).startswith("{"), F.coalesce(*inside)).otherwise(_filled(v)), F.lit(""))


def display_name(name: str | Column) -> Column:
    return first_of(name, "full", "userPreferred", "romaji")


def display_title(title: str | Column) -> Column:
    return first_of(title, "english", "romaji", "native")


def first_year(*years: str) -> Column:
    """The first year that is neither null nor 0."""
    return F.coalesce(*[F.nullif(F.col(y), F.lit(0)) for y in years])


def address(base: str, key: str | Column) -> Column:
    """base followed by the id; '' where the id is null or 0."""
    k = _col(key)
    return F.when(F.coalesce(k, F.lit(0)) != 0, F.concat(F.lit(base), k.cast("string"))).otherwise("")


def id_in_address(url: str | Column) -> Column:
    """The number after /anime/ in an address."""
    return F.nullif(F.regexp_extract(_col(url), r"/anime/(\d+)", 1), F.lit("")).try_cast("bigint")


def cache_key(*parts: str | Column) -> Column:
    """The slugs of names, numbers and settings, joined by underscores: what a stored result is called."""
    from troupe.functions.text import slug

    return F.concat_ws("_", *[slug(_col(p).cast("string")) for p in parts])
