"""Matching entities of two sources without keys, by collective graph linkage.

1. Works. Titles that stand for the same work, by alternative titles of one record or by one work id, are joined into
   components of the title graph.
2. Candidate graph. Two entities are linked by the rare attributes they share: a word of the name (or its beginning)
   or the full name within the same work, the native name with such a word or the work. By a full name alone they meet
   where one is without a work and genders agree, and, once propagation has matched entities of two works, within
   these. An edge weighs the sum of its attributes' rarity.
3. Meta-blocking. An edge far lighter than the heaviest at both of its ends is dropped.
4. Similarity. Names, native names and genders give each edge its own evidence.
5. Propagation. Works are neighbours of the entities in them: how many of two works' entities are matched says how
   sure the two works are one, and that adds to the evidence of all pairs between them, until the matches are stable.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from troupe.llm.graphs import connected_components
from troupe.llm.names import field, is_kanji, name_similarity, name_tokens, native, reading, title_key
from troupe.runtime import materialize, spread

#: Evidence in units of log odds.
BIAS, PRUNE = -3.5, 0.25
WORK, WORK_SUPPORT, NO_WORK, OTHER_WORK = 2.2, 1.5, -0.5, -4.0
NATIVE_SAME, NATIVE_OTHER, GENDER_SAME, GENDER_OTHER = 4.5, -6.0, 0.7, -4.0
#: Pairs of one key that a task makes.
MEETING = 250_000
#: A further record of one entity must agree at least so well in its name.
SECOND = 0.85

_PARSED = "id bigint, tokens array<string>, native string, gender string, titles array<array<string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, name, native, gender, titles) to comparable forms."""
    for batch in batches:
        out = [[], [], [], [], []]
        for key, name, own, gender, titles in zip(*(c.to_pylist() for c in batch.columns)):
            names = field(name, ("full", "userPreferred", "romaji"))
            written = native(own) or next((native(x) for x in field(name, ("native",)) if name.lstrip().startswith("{")), None)
            out[0].append(key)
            out[1].append(name_tokens(names[0]) if names else reading(own))
            out[2].append(written)
            out[3].append(gender.strip().lower() if gender and gender.strip().lower() not in ("", "unknown", "none") else None)
            out[4].append([k for t in titles or [] if (k := [x for v in field(t, ("english", "romaji", "native")) if (x := title_key(v))])])
        kinds = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["id", "tokens", "native", "gender", "titles"])


def _entity_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tokens, native, works) to (id, key): the conjunctions of attributes by which entities meet."""
    for batch in batches:
        ids, keys = [], []
        for key, tokens, own, works in zip(*(c.to_pylist() for c in batch.columns)):
            words = {t for t in tokens if len(t) > 1}
            parts = {f"w{t}" for t in words} | {f"p{t[:3]}" for t in words if len(t) >= 3}
            found = {f"{w}|{p}" for w in works for p in parts}
            if own:
                found |= {f"n{own}|{p}" for p in parts} | {f"n{own}|{w}" for w in works}
            if len(words) > 1:
                full = "f" + "|".join(sorted(words))
                found |= {full, *(f"{w}|{full}" for w in works)}
            ids += [key] * len(found)
            keys += sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["id", "key"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, tokens_a, native_a, gender_a, tokens_b, native_b, gender_b) to (a, b, alike, same_native, own)."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        alike, same, own = [], [], []
        for _, _, ta, na, ga, tb, nb, gb in zip(*columns):
            s = name_similarity(ta, tb)
            for x, y, other in ((na, ta, tb), (nb, tb, ta)):
                # a name in kana can be read, and may be the fuller form
                if s < 0.99 and x and len(other) > 1 and (read := reading(x)) and len(y) < 2:
                    s = max(s, 0.97 * name_similarity(read, other))
            value = 4.0 if s >= 0.995 else 3.0 if s >= 0.87 else 1.5 if s >= 0.72 else -3.0 if s >= 0.45 else -6.0
            equal = bool(na and nb and na == nb)
            if equal:
                value += NATIVE_SAME
            elif na and nb and is_kanji(na) == is_kanji(nb):
                value += NATIVE_OTHER
            if ga and gb:
                value += GENDER_SAME if ga == gb else GENDER_OTHER
            alike.append(s)
            same.append(equal)
            own.append(value + BIAS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike), pa.array(same), pa.array(own)], ["a", "b", "alike", "same_native", "own"])


def _candidates(left: DataFrame, right: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """(a, b): the pruned candidate graph of two sides (id, tokens, native, gender, works); and the ids of either side (id, key) under full
    names that both have."""
    a = spread(left.select("id", "tokens", "native", "works")).mapInArrow(_entity_keys, "id bigint, key string").withColumnRenamed("id", "a")
    b = spread(right.select("id", "tokens", "native", "works")).mapInArrow(_entity_keys, "id bigint, key string").withColumnRenamed("id", "b")
    a, b = materialize(a, "link-keys"), materialize(b, "link-keys")
    rarity = (1 / (1 + F.log(F.col("na").cast("double") * F.col("nb")))).alias("rarity")
    # the pairs of a key that very many share are made by several tasks
    salts = F.greatest(F.ceil(F.col("na").cast("double") * F.col("nb") / F.lit(MEETING)), F.lit(1)).cast("int").alias("salts")
    shared = a.groupBy("key").agg(F.count("*").alias("na")).join(b.groupBy("key").agg(F.count("*").alias("nb")), "key")
    shared = materialize(shared.select("key", rarity, salts, F.col("key").startswith("f").alias("full")), "link-shared")

    def meeting(x: DataFrame, y: DataFrame) -> DataFrame:
        ours = x.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
        theirs = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "rarity")
        return ours.join(theirs, ["key", "salt"])

    met = meeting(a.join(shared.where("not full").drop("full"), "key"), b.join(shared.where("not full").drop("full"), "key")).select("a", "b", "rarity")
    # a full name is evidence enough only with a work in common, where the other keys or the matches of the works bring pairs together, or
    # where a work is unknown and genders agree
    known = lambda x, y: x.select(F.col("id").alias(y), F.col("gender").alias(f"gender_{y}"), (F.size("works") > 0).alias(f"known_{y}"))
    names = shared.where("full").drop("full")
    named_a, named_b = materialize(a.join(names, "key").join(known(left, "a"), "a"), "link-names"), materialize(b.join(names, "key").join(known(right, "b"), "b"), "link-names")
    for x, y in ((named_a.where("not known_a"), named_b), (named_a.where("known_a"), named_b.where("not known_b"))):
        met = met.unionByName(meeting(x, y).where("coalesce(gender_a = gender_b, true)").select("a", "b", "rarity"))
    edges = materialize(met.groupBy("a", "b").agg(F.sum("rarity").alias("weight")), "link-edges")
    most_a, most_b = (edges.groupBy(x).agg(F.max("weight").alias(f"most_{x}")) for x in "ab")
    weighed = edges.join(most_a, "a").join(most_b, "b")
    kept = weighed.where((F.col("weight") >= PRUNE * F.col("most_a")) | (F.col("weight") >= PRUNE * F.col("most_b"))).select("a", "b")
    return kept, (named_a.select(F.col("a").alias("id"), "key"), named_b.select(F.col("b").alias("id"), "key"))


def _supported(names: tuple[DataFrame, DataFrame], support: DataFrame, left_works: DataFrame, right_works: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): further candidates of one full name, in works that their matches show to be one."""
    works = support.where("x <> y and votes > 1 and share >= 0.5").select("x", "y")
    a, b = (own_names.join(own, "id").select(F.col("id").alias(i), "key", F.col("work").alias(w)) for own_names, own, i, w in ((names[0], left_works, "a", "x"), (names[1], right_works, "b", "y")))
    return materialize(a.join(works, "x").join(b, ["key", "y"]).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "link-supported")


def _with_sides(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the columns of both entities."""
    of = lambda x, y: x.select(F.col("id").alias(y), *[F.col(c).alias(f"{c}_{y}") for c in ("tokens", "native", "gender", "works")])
    return materialize(pairs.join(of(a, "a"), "a").join(of(b, "b"), "b"), "link-sides")


def _best(scored: DataFrame) -> DataFrame:
    """Of edges (a, b, alike, same_native, logit), the matches: each a with its best b, if the evidence is for it, and if a
    is the best of that b or agrees with it well enough to be a further record of the same entity."""
    fit = scored.where("logit >= 0")
    chosen = fit.groupBy("a").agg(F.max_by(F.struct("b", "alike", "same_native", "logit"), F.struct("logit", "alike", -F.col("b"))).alias("x")).select("a", "x.*")
    top = chosen.groupBy("b").agg(F.max_by("a", F.struct("logit", "alike", -F.col("a"))).alias("top"))
    return chosen.join(top, "b").where((F.col("a") == F.col("top")) | F.col("same_native") | (F.col("alike") >= SECOND)).select("a", "b", "logit")


def link_entities(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str, own: str, gender: str, left_titles: list[str], right_title: str, right_work: str, version: str | None = None, propagate: bool = True,
) -> DataFrame:
    """(a, b, confidence): pairs of `left_id` and `right_id` that are one entity, each pair once.

    left has one row per entity (repeated ids: the latest by `version`) with any number of title columns, right one
    row per entity and work. Names and titles are plain text or JSON objects as text. Nulls and blanks are no
    evidence; rows with a null id are left out; rows whose name and native name are both missing match nothing; an
    entity that is entered on the left under two ids gives two pairs; empty tables give an empty result. Without `propagate` the pairs are
    those of the first round, before the works have learnt from one another's entities. Confidence is the logistic of the summed evidence."""
    order = F.struct(F.col(version) if version else F.lit(0), F.xxhash64(F.col(name), F.col(own)))
    payload = F.struct(F.col(name).alias("name"), F.col(own).alias("own"), F.col(gender).alias("gender"), F.array(*left_titles).alias("titles"))
    ours = left.where(F.col(left_id).isNotNull()).groupBy(F.col(left_id).cast("bigint").alias("id")).agg(F.max_by(payload, order).alias("x")).select("id", "x.*")
    a = materialize(spread(ours).mapInArrow(_parse, _PARSED), "link-left")
    rows = right.where(F.col(right_id).isNotNull()).select(
        F.col(right_id).cast("bigint").alias("id"), F.col(name).alias("name"), F.col(own).alias("own"), F.col(gender).alias("gender"), F.array(F.col(right_title)).alias("titles"), F.col(right_work).cast("string").alias("work")
    ).distinct()
    named = rows.groupBy("id").agg(F.max_by(F.struct("name", "own", "gender"), F.struct(F.col("own").isNotNull(), F.col("name"))).alias("x"), F.flatten(F.collect_set("titles")).alias("titles"))
    b = materialize(spread(named.select("id", "x.*", "titles")).mapInArrow(_parse, _PARSED), "link-right")

    # works
    aliases = a.select(F.explode("titles").alias("t")).where(F.size("t") > 1).select(F.col("t")[0].alias("a"), F.explode("t").alias("b")).where("a <> b").distinct()
    work_titles = rows.where("work is not null").select(F.concat(F.lit("#"), "work").alias("name"), F.lit(None).cast("string").alias("own"), F.lit(None).cast("string").alias("gender"), "titles").distinct()
    keyed = work_titles.select(F.xxhash64("name").alias("id"), F.col("name"), "own", "gender", "titles").mapInArrow(_work_titles, "work string, title string")
    works = materialize(connected_components(aliases.unionByName(keyed.select(F.col("work").alias("a"), F.col("title").alias("b")))), "link-works")
    title_work = works.select(F.col("node").alias("title"), F.concat(F.lit("@"), "component").alias("component"))
    left_works = a.select("id", F.explode(F.flatten("titles")).alias("title")).distinct().join(title_work, "title", "left").select("id", F.coalesce("component", F.concat(F.lit("@"), "title")).alias("work")).distinct()
    ids = rows.where("work is not null").select("id", F.concat(F.lit("#"), "work").alias("title")).distinct()
    right_works = ids.join(title_work, "title", "left").select("id", F.coalesce("component", F.concat(F.lit("@"), "title")).alias("work")).distinct()
    left_works, right_works = materialize(left_works, "link-left-works"), materialize(right_works, "link-right-works")

    def with_works(x: DataFrame, own_works: DataFrame) -> DataFrame:
        lists = own_works.groupBy("id").agg(F.array_sort(F.collect_set("work")).alias("works"))
        return materialize(x.drop("titles").join(lists, "id", "left").withColumn("works", F.coalesce("works", F.array().cast("array<string>"))), "link-entities")

    a, b = with_works(a, left_works), with_works(b, right_works)
    pairs, names = _candidates(a, b)
    pairs = materialize(pairs, "link-pairs")

    def compared_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges with their own evidence, and (a, b, x, y) with the works of both ends."""
        sides = _with_sides(pairs, a, b)
        compared = sides.select("a", "b", "tokens_a", "native_a", "gender_a", "tokens_b", "native_b", "gender_b").mapInArrow(_compare, "a bigint, b bigint, alike double, same_native boolean, own double")
        edges = materialize(compared.join(sides.select("a", "b", "works_a", "works_b"), ["a", "b"]).where("own > -6"), "link-compared")
        # entities with works in common meet in these alone
        common = F.transform(F.array_intersect("works_a", "works_b"), lambda x: F.struct(x.alias("x"), x.alias("y")))
        cross = F.flatten(F.transform("works_a", lambda x: F.transform("works_b", lambda y: F.struct(x.alias("x"), y.alias("y")))))
        crossed = edges.select("a", "b", F.explode(F.when(F.size(common) > 0, common).otherwise(cross)).alias("w")).select("a", "b", "w.x", "w.y")
        return edges, materialize(crossed, "link-crossed")

    edges, crossed = compared_pairs(pairs)
    size_a = left_works.groupBy(F.col("work").alias("x")).agg(F.count("*").alias("size_a"))
    size_b = right_works.groupBy(F.col("work").alias("y")).agg(F.count("*").alias("size_b"))

    support, before, states = None, None, set()
    while True:
        matches = materialize(_best(_scored(edges, crossed, support)), "link-matches")
        if not propagate:
            break
        over = before is not None and matches.select("a", "b").exceptAll(before).isEmpty() and before.exceptAll(matches.select("a", "b")).isEmpty()
        state = tuple(matches.agg(F.count("*"), *[F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(20,0)")) for k in (0, 1)]).head())
        if not over and state in states:
            warnings.warn(f"link_entities: matches recur after {len(states)} rounds without being stable", stacklevel=2)
            over = True
        states.add(state)
        if over:
            break
        before = matches.select("a", "b")
        votes = crossed.join(before, ["a", "b"]).groupBy("x", "y").agg(F.count("*").alias("votes"))
        support = votes.join(size_a, "x").join(size_b, "y").select("x", "y", "votes", (F.col("votes") / F.least("size_a", "size_b")).alias("share"))
        support = materialize(support, "link-support")
        more = _supported(names, support, left_works, right_works, pairs)
        if not more.isEmpty():
            more_edges, more_crossed = compared_pairs(more)
            pairs = materialize(pairs.unionByName(more), "link-pairs")
            edges, crossed, states = edges.unionByName(more_edges), crossed.unionByName(more_crossed), set()
    return matches.select("a", "b", F.round(1 / (1 + F.exp(-F.col("logit"))), 6).alias("confidence"))


def _work_titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        works, titles = [], []
        for work, found in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
            for t in found or []:
                if k := title_key(t):
                    works.append(work)
                    titles.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(works, pa.string()), pa.array(titles, pa.string())], ["work", "title"])


def _scored(edges: DataFrame, crossed: DataFrame, support: DataFrame | None) -> DataFrame:
    """Edges with the evidence of their works: works of one title, more so the more of their entities are matched, and works
    of different titles of which at least two entities and half of the smaller cast are matched."""
    if support is None:
        each = crossed.where("x = y").select("a", "b", F.lit(WORK).alias("value"))
    else:
        value: Column = F.when(F.col("x") == F.col("y"), WORK + WORK_SUPPORT * F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).when(
            (F.col("votes") > 1) & (F.col("share") >= 0.5), (WORK + WORK_SUPPORT) * F.col("share")
        )
        each = crossed.join(support, ["x", "y"], "left").select("a", "b", value.alias("value")).where("value is not null")
    best = each.groupBy("a", "b").agg(F.max("value").alias("value"))
    known = (F.size("works_a") > 0) & (F.size("works_b") > 0)
    with_value = edges.join(best, ["a", "b"], "left")
    return with_value.select("a", "b", "alike", "same_native", (F.col("own") + F.coalesce("value", F.when(known, OTHER_WORK).otherwise(NO_WORK))).alias("logit"))
