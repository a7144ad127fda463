"""Implicit feedback: event feeds, decay, activity limits, user mapping."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.functions import columns as X
from stallrec.session import cut_lineage

EVENT_COLUMNS = ("event_type", "anonymous_id", "user_id", "item_id", "ts")


def union_feeds(sources: Iterable[Mapping]) -> DataFrame:
    """All feeds as one long table.

    A source names its item column (``item``) or a comma separated list (``id_list``);
    list entries that are no number are left out.
    """
    frames = []
    for s in sources:
        events = s["events"]
        if "id_list" in s:
            events = events.withColumn("_id", F.explode(F.split(s["id_list"], ",")))
            item = F.trim("_id").try_cast("bigint")
        else:
            item = F.col(s["item"]).cast("bigint")
        frames.append(
            events.select("event_type", "anonymous_id", "user_id", item.alias("item_id"), "ts")
            .filter(F.col("item_id").isNotNull())
        )
    return reduce(DataFrame.unionByName, frames)


def recent_events(events: DataFrame, as_of: dt.date) -> DataFrame:
    return events.filter(X.within_lookback(F.col("event_type"), F.col("ts"), as_of))


def actor_user_map(events: DataFrame) -> DataFrame:
    """Distinct (actor, user); before login an actor stands for itself."""
    return events.select(
        "anonymous_id", F.coalesce("user_id", "anonymous_id").alias("user_id")
    ).distinct()


def actor_item_feedback(
    events: DataFrame,
    as_of: dt.date,
    weights: Mapping[str, float] = C.EVENT_WEIGHTS,
    more_than: float = 1,
) -> DataFrame:
    """Decayed feedback per (actor, item), weak pairs dropped."""
    value = X.event_weight(F.col("event_type"), weights) * X.recency_factor(F.col("ts"), as_of)
    return (
        recent_events(events, as_of)
        .groupBy("anonymous_id", "item_id")
        .agg(F.sum(value).cast(C.FEEDBACK_TYPE).alias("feedback"))
        .filter(F.col("feedback") > more_than)
    )


def active_actors(
    feedback: DataFrame, least: int = C.MIN_ITEMS_PER_ACTOR, most: int = C.MAX_ITEMS_PER_ACTOR
) -> DataFrame:
    """Keep actors with an accepted number of items, with that number.

    Counting by aggregate and joining back drops over-active actors before any of their
    rows are moved; a window would bring all rows of one actor into one task.
    """
    counts = (
        feedback.groupBy("anonymous_id")
        .agg(F.count("*").alias("anonymous_id_cnt"))
        .filter(F.col("anonymous_id_cnt").between(least, most))
    )
    return feedback.join(counts, "anonymous_id")


def user_item_feedback(actors: DataFrame, mapping: DataFrame, listings: DataFrame, infos: DataFrame) -> DataFrame:
    """Feedback per (user, item) with coarse item features.

    An actor mapped to itself and to a user counts for both.
    """
    items = listings.join(infos, listings.id == infos.bike_id).select(
        listings.id.alias("item_id"),
        X.floor_to(listings.price, 200).alias("price"),
        listings.bike_type_id,
        listings.bike_category_id,
        listings.family_id,
        X.floor_to(infos.rider_height_min, 10).alias("rider_height_min"),
        X.floor_to(infos.rider_height_max, 10).alias("rider_height_max"),
    )
    features = [c for c in items.columns if c != "item_id"]
    return (
        actors.join(mapping, "anonymous_id", "left")
        .join(items, "item_id")
        .groupBy("user_id", F.col("item_id").alias("bike_id"))
        .agg(
            *[F.min(c).alias(c) for c in features],
            F.sum("feedback").cast(C.FEEDBACK_TYPE).alias("feedback"),
        )
    )


def regrouped(interactions: DataFrame) -> DataFrame:
    """The outer grouping by user, item, type and category."""
    return (
        interactions.groupBy("user_id", "bike_id", "bike_type_id", "bike_category_id")
        .agg(
            *[F.min(c).alias(c) for c in ("price", "family_id", "rider_height_min", "rider_height_max")],
            F.sum("feedback").cast(C.FEEDBACK_TYPE).alias("feedback"),
        )
    )


def interactions(
    events: DataFrame, catalog: Mapping[str, DataFrame], as_of: dt.date, all_events: DataFrame | None = None
) -> DataFrame:
    """Events to (user, item) feedback. The actor mapping reads all events, old ones too.

    The pairs are far fewer than the events. They are written once, since the activity
    limit reads them twice and the planner would otherwise scan the events twice.
    """
    actors = active_actors(cut_lineage(actor_item_feedback(events, as_of)))
    mapping = actor_user_map(events if all_events is None else all_events)
    return user_item_feedback(actors, mapping, catalog["listings"], catalog["infos"])
