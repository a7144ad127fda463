"""A table of requests answered in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.functions import columns as X
from stallrec.operators import content as K
from stallrec.operators import factors as CF
from stallrec.operators import lists as L
from stallrec.operators import masks as M
from stallrec.operators import quality as Q
from stallrec.operators import similarity as S
from stallrec.session import cut_lineage

LABELS = {name: label for name, (_, label) in C.STRATEGIES.items()}
COLUMNS = ("request_id", "position", "item_id", "slug", "strategy_used")


#: Whole-number fields. In the first three anything else reads as not given; in the others it
#: is refused.
LENIENT = ("user_id", "family_id", "bike_type")
STRICT = ("continent_id", "bike_id", "n", "price", "rider_height_min", "rider_height_max", "rider_height", "is_ebike", "is_frameset")


def checked(requests: DataFrame) -> DataFrame:
    """Add ``error``: why a request is refused, null if it is not.

    First what the request lacks for its strategy, then the first field that should be a
    whole number and is not. Reads the raw input: an omitted strategy is not checked, though
    it defaults later, and an omitted field is none that is wrong.
    """
    s = F.col("strategy")
    kinds = dict(requests.dtypes)
    no_item = F.col("bike_id").isNull() | F.trim(F.col("bike_id").cast("string")).isin("0", "NA")
    no_user = F.col("user_id").isNull() | (F.col("user_id").cast("string") == "0")
    no_device = F.col("distinct_id").isNull() | (F.col("distinct_id") == "NA")
    error = (
        F.when((s == "rerank") & F.col("bike_rerank_id").isNull(), "a rerank request needs bike_rerank_id")
        .when((s == "product_page") & no_item, "a product page request needs bike_id")
        .when(s.isin("homepage", "braze", "rerank") & no_user & no_device, "this strategy needs user_id or distinct_id")
    )
    for c in STRICT:
        if c in kinds:
            wrong = F.col(c).isNotNull() & X.whole_number(F.col(c), kinds[c]).isNull()
            error = F.coalesce(error, F.when(wrong, f"{c} is no whole number"))
    return requests.withColumn("error", error)


def with_defaults(requests: DataFrame, letters_by_type: Mapping | None = None) -> DataFrame:
    """Typed requests, of those that ``checked`` lets pass: integer fields parsed, gaps filled, the size as a number, the key
    collaborative filtering knows the sender by."""
    d = C.REQUEST_DEFAULTS
    whole = (*LENIENT, *STRICT)
    text = ("distinct_id", "strategy", "frame_size_code", "category", "brand")
    out = requests
    for c in (*whole, *text):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    kinds = dict(out.dtypes)
    for c in whole:
        read = X.integer_or(F.col(c), d[c]) if c in LENIENT else F.coalesce(X.whole_number(F.col(c), kinds[c]), F.lit(d[c]).cast("bigint"))
        out = out.withColumn(c, read)
    for c in text:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(d[c])))
    size = X.size_number(
        F.col("frame_size_code"), F.col("bike_type"), float(d["frame_size_code"]), letters_by_type=letters_by_type
    )
    return out.withColumn("frame_size_code", size).withColumn(
        "actor", X.actor_key(F.col("user_id"), F.col("distinct_id"))
    )


@dataclass(frozen=True)
class Store:
    """What the batch reads: content artifacts and factors."""

    items: DataFrame
    active: DataFrame
    quality: DataFrame
    preferences: DataFrame
    neighbors: DataFrame
    users: DataFrame
    factors: DataFrame


Branch = Callable[[DataFrame, Store, int], tuple[DataFrame, DataFrame | None]]


def _content(requests: DataFrame, s: Store, seed: int):
    return K.content_mixed(requests, s.neighbors, s.quality, s.items), S.unknown_items(requests, s.items)


def _collaborative(widen: int) -> Branch:
    def run(requests: DataFrame, s: Store, seed: int):
        return CF.collaborative(requests, s.users, s.factors, s.items, s.active, widen, seed), None

    return run


def _rerank(requests: DataFrame, s: Store, seed: int):
    return CF.reranked(requests, s.users, s.factors), None


def _quality(requests: DataFrame, s: Store, seed: int):
    picks = cut_lineage(Q.progressive_quality(requests, s.quality, s.items, Q.BUYER_TESTS, seed))
    return picks, Q.short_requests(requests, picks)


BRANCHES: dict[str, Branch] = {
    "content": _content,
    "collaborative": _collaborative(1),
    "collaborative_random": _collaborative(10),
    "rerank": _rerank,
    "quality": _quality,
}


def dispatched(requests: DataFrame) -> DataFrame:
    """Add the branch and label of each request's strategy; unknown names fall back."""
    branch, label = C.STRATEGIES[C.FALLBACK_STRATEGY]
    for name, (b, text) in C.STRATEGIES.items():
        if name != C.FALLBACK_STRATEGY:
            hit = F.col("strategy") == name
            branch = F.when(hit, b).otherwise(branch)
            label = F.when(hit, text).otherwise(label)
    return requests.withColumn("branch", branch).withColumn("strategy_used", label)


def second_chance(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(request_id): product pages whose result has not exactly ``n`` rows."""
    sizes = L.counts(results, requests)
    return (
        sizes.join(requests.select("request_id", "n", "strategy"), "request_id")
        .filter((F.col("strategy") == "product_page") & (F.col("size") != F.col("n")))
        .select("request_id")
    )


def answer(
    raw: DataFrame,
    store: Store,
    seed: int = 0,
    branches: Mapping[str, Branch] = BRANCHES,
    letters_by_type: Mapping | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All requests by their strategies.

    Returns (request_id, position, item_id, slug, strategy_used) and (request_id, error).
    A buyer-guide answer carries slugs, as its callers expect. A product page that comes
    out short is answered by the fallback; both run the same plan, so the rows stay and
    the label changes.
    """
    rows = checked(raw)
    refused = rows.filter(F.col("error").isNotNull()).select("request_id", "error")
    good = with_defaults(rows.filter(F.col("error").isNull()).drop("error"), letters_by_type)
    # Each branch reads these, so they are written once.
    ready = cut_lineage(dispatched(M.attach_masks(good, store.preferences, store.items)))
    results, errors = [], [refused]
    for name, branch in branches.items():
        got, failed = branch(ready.filter(F.col("branch") == name), store, seed)
        slug = F.col("slug") if "slug" in got.columns else F.lit(None).cast("string").alias("slug")
        results.append(got.select("request_id", "position", "item_id", slug))
        if failed is not None:
            errors.append(failed.select("request_id", "error"))
    everything = cut_lineage(reduce(DataFrame.unionByName, results))
    labels = ready.select("request_id", "strategy_used")
    short = second_chance(ready, everything).withColumn("_again", F.lit(LABELS[C.FALLBACK_STRATEGY]))
    labelled = (
        everything.join(labels, "request_id")
        .join(short, "request_id", "left")
        .withColumn("strategy_used", F.coalesce("_again", "strategy_used"))
        .select(*COLUMNS)
    )
    return labelled, reduce(DataFrame.unionByName, errors)
