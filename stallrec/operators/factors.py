"""Collaborative filtering: id maps, fit, scores, top-n, rerank, ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec.functions import columns as X
from stallrec.operators import blocks as B
from stallrec.operators import lists as L
from stallrec.operators import masks as M
from stallrec.operators import skew
from stallrec.operators.catalog import with_rank
from stallrec.session import cut_lineage

DIGITS = 6


# ------------------------------------------------------------------ vocabularies


def dense_ids(df: DataFrame, column: str, index: str = "idx") -> DataFrame:
    """Distinct values with dense integer ids from 0, without a global sort.

    Values fall into 4096 digest buckets; a bucket's offset is the count before it, and
    only the values of one bucket are numbered together.
    """
    values = df.select(column).distinct().withColumn(
        "_b", F.substring(F.md5(F.col(column).cast("string")), 1, 3)
    )
    counts = values.groupBy("_b").agg(F.count("*").alias("_n"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    at = F.row_number().over(W.partitionBy("_b").orderBy(column))
    return values.join(F.broadcast(offsets), "_b").select(
        column, (F.col("_o") + at - 1).cast("int").alias(index)
    )


def feature_rows(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, features): each row's feature values as 'column=value' texts.

    The column name keeps equal values of two columns apart.
    """
    texts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in features]
    none = F.array().cast("array<string>")
    return df.select(key, (F.array(*texts) if texts else none).alias("features")).distinct()


def feature_vocabulary(rows: DataFrame) -> DataFrame:
    return dense_ids(rows.select(F.explode("features").alias("feature")), "feature")


def split(interactions: DataFrame, user: str, item: str, test: float = 0.05, seed: int = 3):
    """A repeatable train/test split; values and weights fall on the same side."""
    held = X.in_fraction([F.col(user), F.col(item)], test, seed)
    return interactions.filter(~held), interactions.filter(held)


# ------------------------------------------------------------------ fit


def fit(
    train: DataFrame,
    users: DataFrame,
    items: DataFrame,
    user: str = "user_id",
    item: str = "bike_id",
    value: str = "feedback",
    rank: int = 30,
    iterations: int = 10,
    seed: int = 1,
    blocks: int = 10,
) -> ALSModel:
    """Implicit-feedback factors over dense ids, fitted in ``blocks`` tasks per side."""
    indexed = (
        train.join(users.withColumnRenamed("idx", "u"), user)
        .join(items.withColumnRenamed("idx", "i"), item)
        .select("u", "i", F.col(value).cast("float").alias("r"))
    )
    als = ALS(
        userCol="u",
        itemCol="i",
        ratingCol="r",
        implicitPrefs=True,
        rank=rank,
        maxIter=iterations,
        seed=seed,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        coldStartStrategy="drop",
    )
    return als.fit(indexed)


def user_factors(model: ALSModel, users: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, vector) with outer ids."""
    return model.userFactors.join(users, F.col("id") == F.col("idx")).select(
        F.col(user).cast("string").alias("user"), F.col("features").cast("array<double>").alias("vector")
    )


def item_factors(model: ALSModel, items: DataFrame, item: str = "bike_id") -> DataFrame:
    return model.itemFactors.join(items, F.col("id") == F.col("idx")).select(
        F.col(item).cast("bigint").alias("item_id"), F.col("features").cast("array<double>").alias("vector")
    )


def cold_factors(known: DataFrame, features: DataFrame) -> DataFrame:
    """Factors for items without interactions: the mean factor of each of their feature
    values' known items, averaged over the values. Whole vectors are summed, and both steps
    combine before the shuffle; a value that many cold items share is dealt out.

    ``known``: (item_id, vector). ``features``: (item_id, features) of all items.
    """
    long = features.select("item_id", F.explode("features").alias("feature"))
    mean = Summarizer.mean(F.col("_v"))
    per_feature = (
        long.join(known, "item_id")
        .select("feature", array_to_vector("vector").alias("_v"))
        .groupBy("feature")
        .agg(mean.alias("_v"))
    )
    cold = long.join(known, "item_id", "left_anti")
    return (
        skew.join(cold, per_feature, "feature", "item_id")
        .groupBy("item_id")
        .agg(mean.alias("_v"))
        .select("item_id", vector_to_array("_v").alias("vector"))
    )


# ------------------------------------------------------------------ scores


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Cells a side of the grid in which users meet items: rows carry whole vectors.
GRID = 8
#: Requests that travel in one block, and how many are scored at once.
USER_BLOCK = 2048
SLICE = 256
#: Items that a slice of requests meets first, and how many at a time afterwards.
FIRST = 256
WIDTH = 2048


def _matrix(rows: dict[str, pa.Array]) -> np.ndarray:
    return B.numbers(rows["vector"].flatten()).astype(float).reshape(len(rows["vector"]), -1)


def _rows_at(rows: dict[str, pa.Array], at: np.ndarray) -> dict[str, pa.Array]:
    index = pa.array(at)
    return {c: v.take(index) for c, v in rows.items() if c != "vector"}


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.round(x, DIGITS) + 0.0


def _reach(floor: np.ndarray, long: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """How long an item's vector must be to reach each request's last score."""
    return np.where(long > 0, (floor - slack) / np.where(long > 0, long, 1), np.where(floor - slack > 0, np.inf, -np.inf))


@dataclass(frozen=True)
class _TopKernel:
    """The best ``_m`` items of each request.

    Items come longest vector first, a few and then up to ``WIDTH`` at a time, and a request whose
    list is full leaves when no item left is long enough to reach its last score (|u||v| >= u.v).
    Scores are screened in single precision with a bound of its error; what may be among the
    best is scored in double precision. Of items that tie with the last one only those with a
    smaller id are looked at.
    """

    schema: pa.Schema = field(
        default_factory=lambda: pa.schema(
            [("request_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("_m", pa.int64())]
        )
    )

    def __call__(self, batch: pa.RecordBatch, row: int, held: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
        users, items = B.fields(batch, "users", row), B.fields(batch, "items", row)
        u, v = _matrix(users), _matrix(items)
        ids, other, m = B.numbers(users["request_id"]), B.numbers(items["item_id"]), B.numbers(users["_m"])
        with np.errstate(all="ignore"):
            long, far = np.linalg.norm(u, axis=1), np.linalg.norm(v, axis=1)
            offered = np.argsort(-far, kind="stable")
            v, far, other = v[offered], far[offered], other[offered]
            most = far[0] if len(far) else 0.0
            # a bound needs numbers that single precision holds
            plain = not (long.max(initial=0) < 1e15 and most < 1e15)
            floor, behind = self.lasts(ids, m, None if plain else held)
            inexact = np.zeros(len(ids)) if plain else (u.shape[1] + 4) * 1.2e-7 * long * most + 1e-12 * long * most
            # scores are rounded to 1e-6: below ``floor - error`` they are less, up to ``floor + tied`` no more
            error, tied = (inexact, inexact) if plain else (inexact + 5.1e-7, 4.9e-7 - inexact)
            shown, asked = M.Masks(_rows_at(items, offered)), M.Asked(users)
            a, b = (u, v) if plain else (u.astype(np.float32), v.astype(np.float32))
            best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            start, width = 0, FIRST
            while start < len(far):
                here = slice(start, min(start + width, len(far)))
                left = np.arange(len(ids)) if plain else np.flatnonzero(~(_reach(floor, long, error) * (1 - 1e-9) > far[start]))
                if not len(left):
                    break
                found = [best]
                for first in range(0, len(left), SLICE):
                    at = left[first : first + SLICE]
                    s = a[at] @ b[here].T
                    if plain:
                        s = _rounded(s)
                    hit = ~(s < (floor - error)[at, None])
                    if plain:
                        hit &= s > -np.inf
                    if not hit.any():
                        continue
                    hit &= shown.matrix(asked, here, at)
                    k, above = int(m[at].max()), floor[at] + tied[at]
                    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > k)
                    if len(many):
                        hit[many] &= (s[many] > above[many, None]) | (other[here][None, :] < behind[at][many, None])
                        many = many[np.count_nonzero(hit[many], axis=1) > k]
                    if len(many):
                        masked = np.where(hit[many], s[many], -np.inf)
                        kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
                        hit[many] &= masked >= (kth - 2 * error[at][many])[:, None]
                    r, c = np.divmod(np.flatnonzero(hit), hit.shape[1])
                    near = (s[r, c] > above[r]) | (other[here][c] < behind[at][r])
                    r, c = r[near], c[near]
                    score = s[r, c] if plain else _rounded(np.einsum("ij,ij->i", u[at[r]], v[here][c]))
                    found.append((at[r], score, other[here][c]))
                if len(found) > 1:
                    new = np.zeros(len(ids), bool)
                    for rows, _, _ in found[1:]:
                        new[rows] = True
                    old = new[best[0]]
                    found[0] = tuple(x[old] for x in best)
                    row, score, near = (np.concatenate(x) for x in zip(*found))
                    kept = B.best_rows(row, (-score, near), m[row])
                    row, score, near = row[kept], score[kept], near[kept]
                    # the last of each list that is full
                    last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else np.zeros(0, np.int64)
                    last = last[np.bincount(row, minlength=len(ids))[row[last]] >= m[row[last]]]
                    at = row[last]
                    better = (score[last] > floor[at]) | ((score[last] == floor[at]) & (near[last] < behind[at]))
                    last, at = last[better], at[better]
                    floor[at], behind[at] = score[last], near[last]
                    best = tuple(np.concatenate([x[~old], y]) for x, y in zip(best, (row, score, near)))
                start, width = here.stop, min(2 * width, WIDTH)
        out = {"request_id": ids[best[0]], "item_id": best[2], "score": best[1], "_m": m[best[0]]}
        return self.trim(out if held is None else {c: np.concatenate([held[c], out[c]]) for c in self.schema.names})

    @staticmethod
    def lasts(ids: np.ndarray, m: np.ndarray, held: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the last of each request's list so far; minus infinity where it is not full."""
        floor, behind = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
        if held is None or not len(held["request_id"]):
            return floor, behind
        # rows are grouped by request, in order
        known, first, count = np.unique(held["request_id"], return_index=True, return_counts=True)
        last = first + count - 1
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        full = (known[at] == ids) & (count[at] >= held["_m"][last][at]) & (count[at] >= m)
        floor[full], behind[full] = held["score"][last[at[full]]], held["item_id"][last[at[full]]]
        return floor, behind

    @staticmethod
    def trim(out: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at = B.best_rows(out["request_id"], (-out["score"], out["item_id"]), out["_m"])
        return {c: v[at] for c, v in out.items()}


def _packed_factors(factors: DataFrame, items: DataFrame | None, active: DataFrame | None) -> DataFrame:
    """Items in blocks; with ``items`` on a shelf of every continent that may show them."""
    cols = ["item_id", "vector"]
    df, shelf = factors, None
    if active is not None:
        df = df.join(active.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    if items is not None:
        shown = M.continents(F.col("m_continent"), F.col("m_motor"))
        df, shelf = df.join(M.item_mask_columns(items), "item_id").withColumn("_region", F.explode(shown)), "_region"
        cols += list(M.ITEM_MASK_COLUMNS)
    return B.pack(df, shelf, "item_id", B.ITEM_BLOCK, cols, "items")


def best_for_users(
    requests: DataFrame, users: DataFrame, factors: DataFrame, items: DataFrame, active: DataFrame, limit: str = "_m"
) -> DataFrame:
    """(request_id, item_id, score, place): the best ``limit`` active, permitted items.

    The mask is applied before the cut, so the result is exact for any mask. Requests
    whose user has no factors are absent, and so are those that ask for less than one item.
    """
    req = requests.filter(F.col(limit) >= 1).join(users, F.col("actor") == F.col("user")).select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("continent_id").cast("bigint").alias("continent_id"),
        "prefs",
        F.col(limit).cast("bigint").alias("_m"),
        "vector",
    )
    # a request meets the items of its continent's shelf
    packed = B.pack(req, "continent_id", "request_id", USER_BLOCK, req.columns, "users").withColumn(
        "_run", F.concat_ws("|", "_shelf", "_bucket")
    )
    kernel = _TopKernel()
    found = B.meet(packed, _packed_factors(factors, items, active), GRID).mapInArrow(
        B.carried_mapper("_run", kernel, kernel.schema),
        "request_id bigint, item_id bigint, score double, _m bigint",
    )
    best = W.partitionBy("request_id").orderBy(F.desc("score"), "item_id")
    return (
        found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= F.col("_m")).drop("_m")
    )


def collaborative(
    requests: DataFrame,
    users: DataFrame,
    factors: DataFrame,
    items: DataFrame,
    active: DataFrame,
    widen: int = 1,
    seed: int = 0,
) -> DataFrame:
    """``n`` drawn in seeded order from the best ``widen * n``.

    ``widen=1`` is the plain strategy (a shuffled top n), 10 the randomised one.
    """
    req = requests.withColumn("_m", F.col("n") * widen)
    best = best_for_users(req, users, factors, items, active)
    drawn = W.partitionBy("request_id").orderBy("_draw", "item_id")
    ranked = best.withColumn(
        "_draw", X.seeded_order(F.col("request_id"), F.col("item_id"), seed=seed)
    ).withColumn("position", F.row_number().over(drawn))
    return L.cut(ranked, requests).select("request_id", "position", "item_id")


def unknown_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    return requests.join(users, requests.actor == users.user, "left_anti")


def reranked(requests: DataFrame, users: DataFrame, factors: DataFrame) -> DataFrame:
    """The given list by model order; unknown items last in given order, repeats kept.

    Only listed items are scored: order among them needs no rank over all items.
    Unknown users get their list back unchanged.
    """
    given = requests.select(
        "request_id", "actor", F.posexplode("bike_rerank_id").alias("given", "item_id")
    )
    wanted = users.withColumnRenamed("vector", "_user")
    scored = (
        given.join(wanted, given.actor == wanted.user, "left")
        .join(factors, "item_id", "left")
        .withColumn("score", F.round(dot(F.col("_user"), F.col("vector")), DIGITS))
    )
    # Equal items of one list stay together, ordered by where they were given.
    key = F.when(F.col("score").isNotNull(), F.col("item_id"))
    w = W.partitionBy("request_id").orderBy(F.desc_nulls_last("score"), key.asc_nulls_last(), "given")
    return scored.select("request_id", F.row_number().over(w).alias("position"), "item_id")


def collaborative_or_quality(served: DataFrame, quality_picks: DataFrame) -> DataFrame:
    """Quality picks for the requests collaborative filtering left empty."""
    rest = quality_picks.join(served.select("request_id").distinct(), "request_id", "left_anti")
    return served.select("request_id", "position", "item_id").unionByName(
        rest.select("request_id", "position", "item_id")
    )


# ------------------------------------------------------------------ metrics

#: Wanted items of one user that travel together, and how many are ranked at once.
LOT = 256
POSITIVES = 32
#: With more wanted items than these a user's scores are sorted once instead of read once for each.
SORTED_FROM = 12
#: Scores farther apart than this are rounded to other numbers, or one apart.
HALF = 5.1e-7


@dataclass(frozen=True)
class _RankKernel:
    """For each (user, wanted item): how many items of the block score higher, or equal.

    Only scores around a wanted one are rounded; the others are sorted in single precision.
    """

    schema: pa.Schema = field(
        default_factory=lambda: pa.schema(
            [("user", pa.string()), ("item_id", pa.int64()), ("above", pa.int64()), ("equal", pa.int64()), ("equal_before", pa.int64())]
        )
    )

    def __call__(self, batch: pa.RecordBatch, row: int, held: dict[str, np.ndarray] | None) -> dict[str, np.ndarray] | None:
        users, items = B.fields(batch, "users", row), B.fields(batch, "items", row)
        u, v, other = _matrix(users), _matrix(items), B.numbers(items["item_id"])
        wanted = users["wanted"]
        lengths = np.array(wanted.value_lengths().to_pylist(), dtype=np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        w = dict(zip([f.name for f in wanted.type.value_type], wanted.flatten().flatten()))
        ids, score = B.numbers(w["item_id"]), B.numbers(w["score"])
        names = np.array(users["user"].to_pylist(), dtype=object)[owner]
        if held is not None and not (np.array_equal(held["item_id"], ids) and np.array_equal(held["user"], names)):
            return None
        above, equal, tied = (np.zeros(len(ids), np.int64) for _ in range(3))
        ends = np.cumsum(lengths)
        with np.errstate(all="ignore"):
            # single precision must hold the scores
            most = np.linalg.norm(u, axis=1).max(initial=0) * np.linalg.norm(v, axis=1).max(initial=0)
            plain = not most < 1e30 or np.isnan(score).any()
            reach = HALF + 2e-7 * np.abs(score)
            low, high = ((score + d).astype(np.float32) for d in (-reach, reach))
            for start in range(0, len(lengths), SLICE):
                s = u[start : start + SLICE] @ v.T
                if plain:
                    s = _rounded(s)
                for n, line in enumerate(s, start):
                    mine = slice(ends[n] - lengths[n], ends[n])
                    counts = above[mine], equal[mine], tied[mine]
                    if plain:
                        self.count(line, other, score[mine], ids[mine], *counts)
                    else:
                        self.screened(line, low[mine], high[mine], other, score[mine], ids[mine], *counts)
        if held is not None:
            above, equal, tied = above + held["above"], equal + held["equal"], tied + held["equal_before"]
        return {"user": names, "item_id": ids, "above": above, "equal": equal, "equal_before": tied}

    @staticmethod
    def screened(line, low, high, other, value, ids, above, equal, tied) -> None:
        """The same from scores that are not rounded: in single precision those outside of ``low`` to
        ``high`` count at once, only the few around a wanted value are rounded and compared."""
        short = line.astype(np.float32)
        if len(value) > SORTED_FROM:
            ordered = np.sort(short)
            first, last = np.searchsorted(ordered, low, "left"), np.searchsorted(ordered, high, "right")
            above[:] = len(line) - last
            some = np.flatnonzero(last > first)
        else:
            above[:] = [np.count_nonzero(short > y) for y in high]
            some = np.flatnonzero([np.count_nonzero(short >= x) for x in low] > above)
        for i in some:
            # those beyond ``high`` are counted
            at = np.flatnonzero((short >= low[i]) & (short <= high[i]))
            near = _rounded(line[at])
            same = near == value[i]
            above[i] += np.count_nonzero(near > value[i])
            equal[i] = np.count_nonzero(same)
            tied[i] = np.count_nonzero(same & (other[at] < ids[i]))

    @staticmethod
    def count(line, other, value, ids, above, equal, tied) -> None:
        """Counts of one user's scores ``line`` for the wanted ``value``s, written to the last three."""
        if len(value) > SORTED_FROM:
            line_sorted = np.sort(line)
            known = len(line) - int(np.isnan(line).sum())
            low, high = (np.searchsorted(line_sorted[:known], value, side) for side in ("left", "right"))
            given = ~np.isnan(value)
            above[given], equal[given] = (known - high)[given], (high - low)[given]
        else:
            above[:] = (line[None, :] > value[:, None]).sum(axis=1)
            equal[:] = (line[None, :] == value[:, None]).sum(axis=1)
        some = np.flatnonzero(equal)
        for start in range(0, len(some), POSITIVES):
            part = some[start : start + POSITIVES]
            tied[part] = ((line[None, :] == value[part, None]) & (other[None, :] < ids[part, None])).sum(axis=1)


def positive_ranks(positives: DataFrame, users: DataFrame, factors: DataFrame) -> DataFrame:
    """(user, item_id, above, equal, equal_before) over all items with factors.

    ``above`` counts items with a higher score, ``equal`` those with the same score, the
    item itself included, ``equal_before`` those of them with a smaller id. Counts add up
    over item blocks, so no user's full ranking is ever built.
    """
    vectors = users.withColumnRenamed("vector", "_user")
    wanted = (
        positives.join(vectors, "user")
        .join(factors, "item_id")
        .select("user", "item_id", F.round(dot(F.col("_user"), F.col("vector")), DIGITS).alias("score"))
    )
    # A user's wanted items travel in lots of bounded size, for most users a single one; the
    # vector joins the lot, not each item.
    lots_of = positives.groupBy("user").agg(F.ceil(F.count("*") / LOT).alias("_lots"))
    lots = wanted.join(lots_of, "user").withColumn("_lot", F.pmod(F.xxhash64("item_id"), F.col("_lots")))
    rows = lots.groupBy("user", "_lot").agg(F.collect_list(F.struct("item_id", "score")).alias("wanted"))
    rows = rows.join(users.groupBy("user").agg(F.any_value("vector").alias("vector")), "user")
    rows = rows.withColumn("_key", F.concat_ws("|", "user", "_lot"))
    packed = B.pack(rows, None, "_key", B.QUERY_BLOCK, ["user", "vector", "wanted"], "users").withColumn(
        "_run", F.col("_bucket").cast("string")
    )
    kernel = _RankKernel()
    found = B.meet(packed, _packed_factors(factors, None, None), GRID).mapInArrow(
        B.carried_mapper("_run", kernel, kernel.schema),
        "user string, item_id bigint, above bigint, equal bigint, equal_before bigint",
    )
    return found.groupBy("user", "item_id").agg(*[F.sum(c).alias(c) for c in ("above", "equal", "equal_before")])


def _listed(test: DataFrame, train: DataFrame) -> DataFrame:
    """(user, item_id, is_test, _train) of users with a test item; the others have no share."""
    both = test.withColumn("_test", F.lit(1)).unionByName(train.withColumn("_test", F.lit(0)))
    both = both.join(test.select("user").distinct(), "user", "left_semi")
    return both.groupBy("user", "item_id").agg(F.max("_test").alias("is_test"), (1 - F.min("_test")).alias("_train"))


def _share_of_k(placed: DataFrame, k: int) -> DataFrame:
    """(user, value) from the places, from 0, of each user's items among all items."""
    # Training items ranked ahead of a test item do not take up one of the k places.
    order = W.partitionBy("user").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("_skip", F.coalesce(F.sum("_train").over(order), F.lit(0)))
    hit = (F.col("is_test") == 1) & (F.col("_place") - F.col("_skip") < k) & (F.col("_train") == 0)
    return (
        numbered.groupBy("user")
        .agg(F.sum(hit.cast("int")).alias("hits"), F.max("is_test").alias("_any"))
        .filter("_any = 1")
        .select("user", (F.col("hits") / F.lit(k)).alias("value"))
    )


def precision_at_k(test: DataFrame, train: DataFrame, users: DataFrame, factors: DataFrame, k: int) -> DataFrame:
    """Per user: the share of the first ``k`` items, training items left out, that are in
    the test set. Frames of (user, item_id). Averaged by ``mean_metric``."""
    seen = _listed(test, train)
    ranks = positive_ranks(seen.select("user", "item_id"), users, factors).join(seen, ["user", "item_id"])
    return _share_of_k(ranks.withColumn("_place", F.col("above") + F.col("equal_before")), k)


def popular_precision_at_k(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """The same for the plain baseline: the items with the most training rows for everyone."""
    counts = train.groupBy("item_id").agg(F.count("*").alias("_n"))
    order = with_rank(counts, "_n", "item_id", "_rank").select("item_id", (F.col("_rank") - 1).alias("_place"))
    return _share_of_k(skew.join(cut_lineage(_listed(test, train)), order, "item_id", "user"), k)


def auc(test: DataFrame, users: DataFrame, factors: DataFrame) -> DataFrame:
    """Per user: the chance that a test item outscores another item, ties counting half."""
    ranks = positive_ranks(test.select("user", "item_id").distinct(), users, factors)
    total = factors.agg(F.count("*").alias("n")).scalar()
    # Ascending mean rank of a positive among all items.
    rank = total - F.col("above") - (F.col("equal") - 1) / 2
    sums = ranks.groupBy("user").agg(F.sum(rank).alias("r"), F.count("*").alias("p"))
    q = total - F.col("p")
    return sums.filter(q > 0).select(
        "user", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * q)).alias("value")
    )


def mean_metric(per_user: DataFrame, name: str) -> DataFrame:
    return per_user.agg(F.round(F.avg("value"), DIGITS).alias(name), F.count("*").alias("users"))
