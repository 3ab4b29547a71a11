"""Lanes: how over-represented a topic is among an entity's items, and what supports it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, column, share): values summed per cell and divided by their row's sum; 0 where that isn't positive."""
    cells = df.groupBy(row, column).agg(F.sum(value).alias("value"))
    total = F.sum("value").over(Window.partitionBy(row))
    return cells.select(row, column, F.when(total > 0, F.col("value") / total).otherwise(0.0).alias("share"))


def lane_scores(membership: DataFrame, share: DataFrame, entity: str, item: str, topic: str, least_share: float = 0.03, least_support: int = 2, smoothing: float = 0.0025) -> DataFrame:
    """(entity, topic, support, mean, global_mean, enrichment, score), unrounded, of every lane with enough support.

    membership has an entity's items, share (item, topic, share) the nonzero shares of items; items without a topic count
    as zeros in both means. Repeated membership counts once."""
    member = membership.select(entity, item).distinct()
    items = share.select(item).distinct().agg(F.count("*").alias("n_items"))
    overall = share.groupBy(topic).agg(F.sum("share").alias("sum")).join(F.broadcast(items)).select(topic, (F.col("sum") / F.col("n_items")).alias("global_mean"))
    vectorised = member.join(share.select(item).distinct(), item, "left_semi")
    sizes = vectorised.groupBy(entity).agg(F.count("*").alias("n"))
    local = member.join(share, item).groupBy(entity, topic).agg(F.sum("share").alias("sum"), F.count_if(F.col("share") >= least_share).alias("support"))
    lanes = local.where(F.col("support") >= least_support).join(sizes, entity).join(overall, topic).withColumn("mean", F.col("sum") / F.col("n"))
    enrichment = (F.col("mean") + smoothing) / (F.col("global_mean") + smoothing)
    return lanes.select(entity, topic, "support", "mean", "global_mean", enrichment.alias("enrichment"), (enrichment * F.log1p("support")).alias("score"))


def lane_profiles(scores: DataFrame, entity: str, topic: str, top: int = 16) -> DataFrame:
    """The `top` lanes of every entity by score, rounded to 5 places before they are ranked; ties by topic."""
    rounded = scores.select(entity, topic, "support", *[F.round(c, 5).alias(c) for c in ("mean", "global_mean", "enrichment", "score")])
    place = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("score"), topic))
    return rounded.withColumn("place", place).where(F.col("place") <= top)


def lane_evidence(membership: DataFrame, share: DataFrame, entity: str, item: str, topic: str, top: int = 16, least_share: float = 0.03) -> DataFrame:
    """The `top` items of every lane by share, then only those of at least `least_share`; ties by item."""
    rows = membership.select(entity, item).distinct().join(share, item)
    place = F.row_number().over(Window.partitionBy(entity, topic).orderBy(F.desc("share"), item))
    return rows.withColumn("place", place).where((F.col("place") <= top) & (F.col("share") >= least_share)).select(entity, topic, "place", item, "share")


def lane_descriptors(
    membership: DataFrame, share: DataFrame, item_terms: DataFrame, components: DataFrame, entity: str, item: str, topic: str, term: str, top: int = 14, least_share: float = 0.03
) -> DataFrame:
    """(entity, topic, term, contribution, share): the terms of a lane's supporting items, weighted by the topic; shares are of all
    terms, the cut comes afterwards."""
    support = membership.select(entity, item).distinct().join(share.where(F.col("share") >= least_share).select(item, topic), item)
    local = support.join(item_terms.select(item, term, "value"), item).groupBy(entity, topic, term).agg(F.sum("value").alias("local"))
    rows = local.join(components.where("weight > 0").select(topic, term, "weight"), [topic, term]).withColumn("contribution", F.col("weight") * F.col("local")).where("contribution > 0")
    lane = Window.partitionBy(entity, topic)
    ranked = rows.withColumn("share", F.col("contribution") / F.sum("contribution").over(lane)).withColumn("place", F.row_number().over(lane.orderBy(F.desc("contribution"), term)))
    return ranked.where(F.col("place") <= top).select(entity, topic, term, "place", "contribution", "share")


def mass_prefix(df: DataFrame, group: str, term: str, weight: str, mass: float = 0.90) -> DataFrame:
    """Per group the heaviest terms until their share of the weight reaches `mass`, the one that reaches it included; terms without
    positive weight never. The total includes negative weights, and groups whose total isn't positive give nothing."""
    by = Window.partitionBy(group)
    order = by.orderBy(F.desc(weight), term).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("total", F.sum(weight).over(by)).where("total > 0").withColumn("share", F.col(weight) / F.col("total"))
    rows = rows.withColumn("covered", F.sum("share").over(order)).withColumn("place", F.row_number().over(by.orderBy(F.desc(weight), term)))
    return rows.where((F.col(weight) > 0) & (F.round(F.col("covered") - F.col("share"), 12) < mass)).select(group, "place", term, "share", "covered")


def amplitude_prefix(df: DataFrame, group: str, index: str, value: str, mass: float = 0.99) -> DataFrame:
    """Per group the values of largest amount until their share of the squared length reaches `mass`, the one that reaches it
    included; where the length is 0 all shares are 0 and all values are kept."""
    by = Window.partitionBy(group)
    square = F.col(value) * F.col(value)
    rows = df.withColumn("norm2", F.sum(square).over(by)).withColumn("share", F.when(F.col("norm2") > 0, square / F.col("norm2")).otherwise(0.0))
    order = by.orderBy(F.desc(F.abs(value)), index)
    rows = rows.withColumn("covered", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    return rows.where(F.round(F.col("covered") - F.col("share"), 12) < mass).select(group, "place", index, value, "share", "covered")


def top_positive(df: DataFrame, group: str, term: str, weight: str, top: int | None) -> DataFrame:
    """The `top` terms of every group (or all), then only the positive ones; ties by term."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(weight), term))
    ranked = df.withColumn("place", place)
    return (ranked if top is None else ranked.where(F.col("place") <= top)).where(F.col(weight) > 0).select(group, "place", term, weight)


def relative_weights(df: DataFrame, group: str, term: str, weight: str, top: int, keep) -> DataFrame:
    """Weights relative to the heaviest term of the group, of which any may be; then the `top` of the terms that `keep` holds for."""
    rows = df.withColumn("relative", F.col(weight) / F.max(weight).over(Window.partitionBy(group))).where(keep)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(weight), term))
    return rows.withColumn("place", place).where(F.col("place") <= top).select(group, "place", term, "relative")


def gaps(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each value with the step to the next one; null at the end."""
    return df.withColumn("gap", F.lead(value).over(Window.partitionBy(group).orderBy(order)) - F.col(value))


def sample_profiles(profiles: DataFrame, entity: str, least_items: int = 10, least_roles: int = 20, limit: int = 40) -> DataFrame:
    """The first `limit` entities that have lanes and enough items and roles, by top score, items and roles; ties by entity."""
    fit = profiles.where((F.col("lanes") > 0) & (F.col("items") >= least_items) & (F.col("roles") >= least_roles))
    return fit.orderBy(F.desc("top_score"), F.desc("items"), F.desc("roles"), entity).limit(limit)


def labelled_topics(topics: DataFrame, labels: DataFrame, topic: str, order: str) -> DataFrame:
    """Topics with their label, description, confidence and evidence terms: of the labels of one topic the last by `order`; blanks and an empty list
    where there is none."""
    fields = ["label", "description", "confidence"]
    last = labels.groupBy(topic).agg(F.max_by(F.struct(*fields, "evidence_terms"), order).alias("_x"))
    blank = [F.coalesce(f"_x.{c}", F.lit("")).alias(c) for c in fields]
    return topics.join(last, topic, "left").select(*topics.columns, *blank, F.coalesce("_x.evidence_terms", F.array().cast("array<string>")).alias("evidence_terms"))
