"""Which items a request may show: region, stated preferences, active items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.functions import columns as X
from stallrec.operators import blocks as B

SIZE_SLACK = 3
ANY_SIZE = 1.0
#: Items whose preferences are tested together.
TILE = 1024
MASK_COLUMNS = ("continent_id", "prefs")
ITEM_MASK_COLUMNS = ("m_continent", "m_motor", "m_price", "m_size", "m_category")
PREFS_TYPE = "array<struct<max_price:double,category_id:bigint,size:double>>"


def in_region(wanted: Column, continent: Column, motor: Column) -> Column:
    """Own continent, or motorless items of the home continent for the wide ones."""
    return (continent == wanted) | (
        wanted.isin(*C.WIDE_CONTINENTS) & (continent == C.HOME_CONTINENT) & (motor == 0)
    )


def continents(continent: Column, motor: Column) -> Column:
    """Every continent that may show an item, once."""
    home = (continent == C.HOME_CONTINENT) & (motor == 0)
    wide = F.array(*[F.lit(c).cast("bigint") for c in C.WIDE_CONTINENTS])
    own = F.array(continent.cast("bigint"))
    return F.array_distinct(F.when(home, F.concat(own, wide)).otherwise(own))


def visible_items(items: DataFrame) -> DataFrame:
    """(continent_id, item_id): each item under every continent that may show it."""
    seen = continents(F.col("continent_id"), F.col("motor"))
    return items.select(F.explode(seen).alias("continent_id"), F.col("id").alias("item_id"))


def satisfies(prefs: Column, price: Column, category: Column, size: Column) -> Column:
    """Whether an item meets any of a user's preference entries."""
    return F.exists(
        prefs,
        lambda p: (price <= p["max_price"])
        & ((p["category_id"] == 0) | (category == p["category_id"]))
        & ((p["size"] == ANY_SIZE) | size.between(p["size"] - SIZE_SLACK, p["size"] + SIZE_SLACK)),
    )


def allowed(continent: Column, prefs: Column) -> Column:
    """The whole mask on a joined row; ``prefs`` null means no user mask."""
    return in_region(continent, F.col("m_continent"), F.col("m_motor")) & (
        prefs.isNull() | satisfies(prefs, F.col("m_price"), F.col("m_category"), F.col("m_size"))
    )


def item_mask_columns(items: DataFrame) -> DataFrame:
    """The preference projection of the catalog, under the names the mask reads."""
    return items.select(
        F.col("id").alias("item_id"),
        F.col("continent_id").cast("bigint").alias("m_continent"),
        F.col("motor").cast("double").alias("m_motor"),
        F.col("price").cast("double").alias("m_price"),
        F.col("frame_size_code").cast("double").alias("m_size"),
        F.col("bike_category_id").cast("bigint").alias("m_category"),
    )


def numeric_preferences(preferences: DataFrame) -> DataFrame:
    """Preference rows with the size as a number; no size given is ``ANY_SIZE``."""
    return preferences.select(
        "user_id",
        F.col("max_price").cast("double").alias("max_price"),
        "category_id",
        X.size_number(F.col("frame_size"), default=ANY_SIZE).alias("size"),
    ).distinct()


def live_preferences(preferences: DataFrame, items: DataFrame) -> DataFrame:
    """Per user: do the stated preferences match any item, with and without category?

    Items shrink to the least price per category and size. A preference row then looks
    up the few size steps around its own by equality instead of scanning items.
    """
    step = F.floor("m_size")
    facets = (
        item_mask_columns(items)
        .groupBy("m_category", "m_size")
        .agg(F.min("m_price").alias("m_price"))
        .withColumn("m_category", F.explode(F.array(F.col("m_category"), F.lit(0).cast("bigint"))))
        .groupBy("m_category", "m_size")
        .agg(F.min("m_price").alias("f_price"))
    )
    sized = facets.select("m_category", step.alias("f_step"), F.col("m_size").alias("f_size"), "f_price")
    unsized = facets.groupBy("m_category").agg(F.min("f_price").alias("f_price"))
    # Once with the stated category, once without it, which is what product pages use.
    own = preferences.withColumn("_kind", F.lit("own"))
    free = preferences.withColumn("category_id", F.lit(0).cast("bigint")).withColumn("_kind", F.lit("free"))
    rows = own.unionByName(free)
    around = F.sequence(F.floor(F.col("size") - SIZE_SLACK), F.floor(F.col("size") + SIZE_SLACK))
    with_size = (
        rows.filter(F.col("size") != ANY_SIZE)
        .withColumn("_step", F.explode(around))
        .join(sized, (F.col("category_id") == F.col("m_category")) & (F.col("_step") == F.col("f_step")))
        .filter(
            (F.col("f_price") <= F.col("max_price"))
            & F.col("f_size").between(F.col("size") - SIZE_SLACK, F.col("size") + SIZE_SLACK)
        )
        .select("user_id", "_kind")
    )
    without = (
        rows.filter(F.col("size") == ANY_SIZE)
        .join(unsized, F.col("category_id") == F.col("m_category"))
        .filter(F.col("f_price") <= F.col("max_price"))
        .select("user_id", "_kind")
    )
    return (
        with_size.unionByName(without)
        .groupBy("user_id")
        .agg(
            F.max(F.col("_kind") == "own").alias("live_own"),
            F.max(F.col("_kind") == "free").alias("live_free"),
        )
    )


def attach_masks(requests: DataFrame, preferences: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``prefs`` to requests: the user mask, null where there is none.

    Product pages do not test the category. A user mask that matches no item at all is
    ignored, so it becomes null too.
    """
    rows = numeric_preferences(preferences)
    stated = (
        rows.groupBy("user_id")
        .agg(F.sort_array(F.collect_set(F.struct("max_price", "category_id", "size"))).alias("_stated"))
        .join(live_preferences(rows, items), "user_id")
    )
    page = F.col("strategy") == "product_page"
    free = F.transform(
        "_stated",
        lambda p: F.struct(p["max_price"], F.lit(0).cast("bigint").alias("category_id"), p["size"]),
    )
    prefs = F.when(page & F.col("live_free"), free).when(~page & F.col("live_own"), F.col("_stated"))
    # Anonymous requests, often most of them, share user 0 and have no mask: they stay out of the join.
    named = F.coalesce(F.col("user_id") != 0, F.lit(False))
    known = stated.filter("user_id <> 0").withColumnRenamed("user_id", "_user")
    joined = requests.filter(named).join(known, F.col("user_id") == F.col("_user"), "left")
    masked = joined.withColumn("prefs", prefs.cast(PREFS_TYPE)).drop("_user", "_stated", "live_own", "live_free")
    return masked.unionByName(requests.filter(~named).withColumn("prefs", F.lit(None).cast(PREFS_TYPE)))


def flagged(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``ok`` to candidates that carry ``continent_id`` and ``prefs``: mask passed."""
    names = candidates.columns
    ok = F.coalesce(allowed(F.col("continent_id"), F.col("prefs")), F.lit(False))
    return candidates.join(item_mask_columns(items).hint("merge"), "item_id", "left").select(*names, ok.alias("ok"))


def permitted(candidates: DataFrame, requests: DataFrame, items: DataFrame) -> DataFrame:
    """The (request, item) candidates that pass the request's mask."""
    names = candidates.columns
    carried = candidates.join(requests.select("request_id", *MASK_COLUMNS).hint("merge"), "request_id")
    return flagged(carried, items).filter("ok").select(*names)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers among ``values``, and which of them each value is, -1 for none."""
    known, at = np.unique(values, return_inverse=True)
    known = known[~np.isnan(known)]
    at = at.reshape(-1)
    return known, np.where(at < len(known), at, -1).astype(np.int16 if len(known) < 1 << 15 else np.int32)


class Asked:
    """What a block of requests lets through: its continents, the preference entries of its users."""

    def __init__(self, req: dict[str, pa.Array]):
        self.continents, own = np.unique(B.numbers(req["continent_id"]), return_inverse=True)
        self.own = own.reshape(-1)
        prefs = req["prefs"]
        lengths = np.array([0 if n is None else n for n in prefs.value_lengths().to_pylist()], dtype=np.int64)
        self.nothing = ~B.numbers(prefs.is_null()) & (lengths == 0)
        self.first, self.lengths = np.cumsum(lengths) - lengths, lengths
        p = dict(zip([f.name for f in prefs.type.value_type], prefs.flatten().flatten()))
        self.stated = np.stack([B.numbers(p[c]).astype(np.float64) for c in ("max_price", "category_id", "size")], axis=1)


class Masks:
    """The mask of a block of items, asked for by any number of requests.

    Prices, sizes and categories are ranked once among the block's own, so that a test of a
    request and all items compares small whole numbers.
    """

    def __init__(self, item: dict[str, pa.Array]):
        cont, motor = B.numbers(item["m_continent"]), B.numbers(item["m_motor"])
        self.continent, self.home = cont, (cont == C.HOME_CONTINENT) & (motor == 0)
        (self.prices, self.price), (self.sizes, self.size), (self.categories, self.category) = (
            _ranked(B.numbers(item[c]).astype(np.float64)) for c in ("m_price", "m_size", "m_category")
        )

    def met(self, entries: np.ndarray, tile: slice) -> np.ndarray:
        """Which items meet which preference entries (max_price, category or 0, size or ``ANY_SIZE``)."""
        top, wanted, about = entries.T
        price, size, category = self.price[tile], self.size[tile], self.category[tile]
        known = ~np.isnan(top)
        # prices below this rank are paid; an item without a price is behind all
        most = np.where(known, np.searchsorted(self.prices, top, "right"), 0)
        ok = np.where(price < 0, np.iinfo(price.dtype).max, price)[None, :] < most.astype(price.dtype)[:, None]
        tested = np.flatnonzero(wanted != 0)
        if len(tested):
            at = np.searchsorted(self.categories, wanted[tested])
            same = self.categories[np.minimum(at, len(self.categories) - 1)] == wanted[tested] if len(self.categories) else np.zeros(len(tested), bool)
            ok[tested] &= category[None, :] == np.where(same, at, -2).astype(category.dtype)[:, None]
        tested = np.flatnonzero(about != ANY_SIZE)
        if len(tested):
            low, high = (np.searchsorted(self.sizes, about[tested] + d, side) for d, side in ((-SIZE_SLACK, "left"), (SIZE_SLACK, "right")))
            high = np.where(np.isnan(about[tested]), 0, high)
            ok[tested] &= (size[None, :] >= low.astype(size.dtype)[:, None]) & (size[None, :] < high.astype(size.dtype)[:, None])
        return ok

    def matrix(self, asked: Asked, tile: slice = slice(None), at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Requests ``at`` some places by items of ``tile``."""
        region = self.continent[None, tile] == asked.continents[:, None]
        region |= np.isin(asked.continents, C.WIDE_CONTINENTS)[:, None] & self.home[None, tile]
        ok = region[asked.own[at]]
        lengths, shift = asked.lengths[at], tile.start or 0
        users = np.flatnonzero(lengths)
        first, lengths = asked.first[at][users], lengths[users]
        for start in range(0, ok.shape[1] if len(users) else 0, TILE):
            # a user has what any of their entries has
            here = slice(start, min(start + TILE, ok.shape[1]))
            there = slice(shift + here.start, shift + here.stop)
            met = self.met(asked.stated[first], there)
            for n in range(1, int(lengths.max())):
                more = np.flatnonzero(lengths > n)
                met[more] |= self.met(asked.stated[first[more] + n], there)
            ok[users, here] &= met
        ok[asked.nothing[at]] = False
        return ok


def mask_matrix(req: dict[str, pa.Array], item: dict[str, pa.Array]) -> np.ndarray:
    """The mask of a block of requests over a block of items."""
    return Masks(item).matrix(Asked(req))
