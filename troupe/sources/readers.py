"""Sources: JSON documents, XML casts and tag trees, HTML tag pages, staged vectors, long matrices."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from troupe.operators.vectors import unit

CAST_XML = (
    "characters struct<character: array<struct<_id: bigint, _type: string, name: string, gender: string, picture: string, "
    "rating: struct<_VALUE: double, _votes: bigint>, seiyuu: array<struct<_VALUE: string, _id: bigint, _picture: string>>>>>"
)
TAGS_XML = "tags struct<tag: array<struct<_id: bigint, _parentid: bigint, name: string>>>"
# fixed values: categories of a tag page
CATEGORIES = ("abilities", "accessories", "age range", "clothing", "disability", "entity", "habits", "looks", "nationality", "personality", "role")


def read_json(spark: SparkSession, path: str, schema: str, records: str | None = None, lines: bool = False) -> DataFrame:
    """JSON documents of a given schema, one for each file or, with `lines`, for each line; with `records`, one row for each element of that array."""
    df = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return df.select(F.explode(records).alias("_r")).select("_r.*") if records else df


def descriptions(df: DataFrame, form: str) -> DataFrame:
    """(character_id string, description) of either form: 'list', an array `characters` with up to three fields of which the first filled
    one counts, or 'map', a map from id to text."""
    if form == "map":
        return df.select(F.explode("descriptions").alias("character_id", "description"))
    row = df.select(F.explode("characters").alias("c"))
    filled = lambda f: F.nullif(F.col(f"c.{f}"), F.lit(""))
    return row.select(F.col("c.id").cast("string").alias("character_id"), F.coalesce(filled("description"), filled("description_plain"), filled("description_text"), F.lit("")).alias("description"))


def cast_of(df: DataFrame, xml: str, *keep: str) -> DataFrame:
    """Cast rows of XML documents: (keep, cast_id, type, name, gender, picture, rating, votes, seiyuu); a malformed document gives no rows."""
    parsed = df.select(*keep, F.explode(F.from_xml(F.col(xml), CAST_XML, {"mode": "PERMISSIVE"})["characters"]["character"]).alias("c")).where("c._id is not null")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return parsed.select(
        *keep, F.col("c._id").alias("cast_id"), blank("c._type").alias("type"), blank("c.name").alias("name"), blank("c.gender").alias("gender"), blank("c.picture").alias("picture"),
        F.col("c.rating._VALUE").alias("rating"), F.coalesce("c.rating._votes", F.lit(0)).alias("votes"),
        F.transform(F.coalesce("c.seiyuu", F.array()), lambda s: F.struct(s["_id"].alias("id"), F.trim(F.coalesce(s["_VALUE"], F.lit(""))).alias("name"), F.coalesce(s["_picture"], F.lit("")).alias("picture"))).alias("seiyuu"),
    )


def tag_tree_of(df: DataFrame, xml: str, file: str) -> DataFrame:
    """(tag_id, name, parent_id, file) of XML documents; tags without id or name are left out."""
    parsed = df.select(F.col(file).alias("file"), F.explode(F.from_xml(F.col(xml), TAGS_XML, {"mode": "PERMISSIVE"})["tags"]["tag"]).alias("t"))
    return parsed.where("t._id is not null and trim(coalesce(t.name, '')) <> ''").select(F.col("t._id").alias("tag_id"), F.trim("t.name").alias("name"), F.col("t._parentid").alias("parent_id"), "file")


class _TagPage(HTMLParser):
    """Rows of a table with a header cell of class field and a value cell of class value; links to tags with the text around them."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.links: list[dict] = []
        self.stack: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        node = {"tag": tag, "class": a.get("class", "").split(), "text": [], "href": a.get("href", ""), "field": None, "anchors": []}
        self.stack.append(node)
        if tag == "tr":
            node["cells"] = {}

    def handle_data(self, data: str) -> None:
        for node in self.stack:
            node["text"].append(data)

    def handle_endtag(self, tag: str) -> None:
        if not any(n["tag"] == tag for n in self.stack):
            return
        while self.stack:
            node = self.stack.pop()
            self._close(node)
            if node["tag"] == tag:
                return

    def _close(self, node: dict) -> None:
        text = re.sub(r"\s+", " ", " ".join(node["text"])).strip()
        if node["tag"] == "a" and "/tag/" in node["href"]:
            found = re.search(r"/tag/(\d+)", node["href"])
            link = {"name": node.get("tagname") or text, "tag_id": int(found[1]) if found else None, "above": [], "open": True}
            for n in self.stack:
                n["anchors"].append(link)
            self.links.append(link)
        if "tagname" in node["class"]:
            for n in reversed(self.stack):
                if n["tag"] == "a":
                    n["tagname"] = text
                    break
        row = next((n for n in reversed(self.stack) if n["tag"] == "tr"), None)
        if row is not None and node["tag"] == "th" and "field" in node["class"]:
            row["cells"].setdefault("field", text.lower())
        if row is not None and node["tag"] == "td" and "value" in node["class"]:
            row["cells"].setdefault("value", list(node["anchors"]))
        if node["tag"] == "tr" and {"field", "value"} <= node["cells"].keys():
            self.rows.append(node["cells"])
        # the nearest surroundings of a link with a known category decide; tables, sections and the body end the search
        for link in node["anchors"]:
            if link["open"]:
                hits = [c for c in CATEGORIES if re.search(rf"\b{re.escape(c)}\b", text.lower())]
                if hits:
                    link["category"] = max(hits, key=len)
                if hits or node["tag"] in ("table", "section", "body"):
                    link["open"] = False


def page_tags(page: str) -> list[tuple[str, int | None, str]]:
    """(category, tag_id, name) of a tag page, each once; links elsewhere than in known rows only if there are none in those."""
    parser = _TagPage()
    parser.feed(page)
    parser.close()
    while parser.stack:
        parser._close(parser.stack.pop())
    found = [(r["field"], a["tag_id"], a["name"]) for r in parser.rows if r["field"] in CATEGORIES for a in r["value"]]
    found = found or [(a["category"], a["tag_id"], a["name"]) for a in parser.links if a.get("category")]
    seen, out = set(), []
    for category, tag_id, name in found:
        key = (category, tag_id, name.lower())
        if name and key not in seen:
            seen.add(key)
            out.append((category, tag_id, name))
    return out


def tags_of_pages(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, place, category, tag_id, name) of the tag pages of a column; pages are text, or gzip bytes whose bad UTF-8 is replaced."""
    kind = df.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p in zip(pdf["key"], pdf["page"]):
                if p is None:
                    continue
                text = gzip.decompress(p).decode("utf-8", "replace") if isinstance(p, (bytes, bytearray)) else p
                rows += [(k, i, *t) for i, t in enumerate(page_tags(text))]
            out = pd.DataFrame(rows, columns=[key, "place", "category", "tag_id", "name"])
            out["tag_id"] = out["tag_id"].astype("Int64")
            yield out

    return df.select(F.col(key).alias("key"), F.col(page).alias("page")).mapInPandas(read, f"{key} {kind}, place int, category string, tag_id bigint, name string")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the files of a folder, each whole; files that begin with _ or . are left out."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of gzip pages in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cached_tables(spark: SparkSession, folder: str, build: Callable[[], dict[str, DataFrame]], names: list[str]) -> tuple[dict[str, DataFrame], bool]:
    """The tables `names` of a folder, and whether they were there. Unless all of them are complete, all are built and written; a table is complete
    once its commit has left its mark."""
    at = {x: f"{folder}/{x}.parquet" for x in names}
    there = all(exists(spark, f"{p}/_SUCCESS") for p in at.values())
    if not there:
        for name, df in build().items():
            df.write.mode("overwrite").parquet(at[name])
    return {x: spark.read.parquet(p) for x, p in at.items()}, there


# fixed values: embedding models by their short names, with what goes before each text and what runs them
PRESETS = {
    "bge-large": ("BAAI/bge-large-en-v1.5", "", "sentence-transformers"),
    "e5-large": ("intfloat/e5-large-v2", "query: ", "sentence-transformers"),
    "gte-large": ("Alibaba-NLP/gte-large-en-v1.5", "", "sentence-transformers"),
    "bge-small": ("BAAI/bge-small-en-v1.5", "", "sentence-transformers"),
    "mxbai-embed-large": ("mxbai-embed-large", "", "ollama"),
    "nomic-embed-text": ("nomic-embed-text", "", "ollama"),
}


def preset_texts(df: DataFrame, text: str, preset: str) -> DataFrame:
    """df with `model` and `input`, the text as the preset's model is given it."""
    model, prefix, _ = PRESETS[preset]
    return df.withColumn("model", F.lit(model)).withColumn("input", F.concat(F.lit(prefix), F.col(text)))


def same_vocabulary(stored: DataFrame, wanted: DataFrame, model: str | None = None) -> bool:
    """Whether stored vectors (place, text, model) are of the wanted texts (place, text), in the same order, and of the model if one is given."""
    if model is not None and not stored.where(~F.col("model").eqNullSafe(F.lit(model))).isEmpty():
        return False
    both = stored.select("place", F.col("text").alias("have")).join(wanted.select("place", F.col("text").alias("want")), "place", "full_outer")
    return both.where(~F.col("have").eqNullSafe(F.col("want"))).isEmpty()


def staged_vectors(vectors: DataFrame, wanted: DataFrame, text: str = "text", vector: str = "embedding", fold: bool = False) -> DataFrame:
    """(text, vector) at length 1 of every wanted text; raises if one has no vector, since nothing is computed here. With `fold` case doesn't
    matter, and texts are in lower case."""
    if fold:
        vectors, wanted = (df.withColumn(text, F.lower(text)) for df in (vectors, wanted))
    have = vectors.where(F.col(vector).isNotNull()).groupBy(text).agg(F.min(vector).alias(vector))
    missing = wanted.select(text).distinct().join(have, text, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"texts without a vector: {[r[0] for r in missing]}")
    return wanted.select(text).distinct().join(have, text).select(text, unit(vector).alias("vector"))
