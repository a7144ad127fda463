"""Quality-ordered picks under progressively tested predicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallrec import config as C
from stallrec.functions import columns as X
from stallrec.operators import blocks as B
from stallrec.operators import masks as M
from stallrec.session import cut_lineage


@dataclass(frozen=True)
class Test:
    """One named predicate between an item column and a request column.

    ``kind``: ``same``, ``at_least`` (item >= request), ``at_most`` (item <= request),
    ``near`` (item within the price band around the request), or ``same_unless`` (equal,
    or passed over where the request holds ``skip``).
    """

    item: str
    request: str
    kind: str = "same"
    skip: str = "null"

    def matrix(self, req: dict[str, pa.Array], item: dict[str, pa.Array]) -> np.ndarray:
        a, b = req["r_" + self.request], item["i_" + self.item]
        if self.kind in ("same", "same_unless"):
            code_b, known = B.codes(b)
            hit = B.recode(a, known)[:, None] == code_b[None, :]
            if self.kind == "same_unless":
                hit |= np.array([v == self.skip for v in a.to_pylist()])[:, None]
            return hit
        x, y = B.numbers(a)[:, None], B.numbers(b)[None, :]
        if self.kind == "at_least":
            return y >= x
        if self.kind == "at_most":
            return y <= x
        return (y >= x * C.PRICE_BAND[0]) & (y <= x * C.PRICE_BAND[1])


BUYER_TESTS = (
    Test("category", "category"),
    Test("rider_height_max", "rider_height", "at_least"),
    Test("rider_height_min", "rider_height", "at_most"),
    Test("price", "price", "near"),
    Test("is_ebike", "is_ebike"),
    Test("is_frameset", "is_frameset"),
    Test("brand", "brand", "same_unless"),
)


@dataclass(frozen=True)
class _ListKernel:
    """Best items per request and list. Lists are nested conjunctions of the tests.

    ``mode='ladder'``: list 0 is the mask, list j adds the first j tests.
    ``mode='sampled'``: list 0 is the mask, list 1 the sampled masked items.
    ``mode='half'``: of the sampled masked items and of those that meet the first tests, the lists
    that ``numbers`` gives a number, none where it is None. ``mode='whole'``: the same of all items.
    """

    tests: tuple[Test, ...]
    mode: str
    numbers: tuple[int | None, ...] = ()
    schema: pa.Schema = field(
        default_factory=lambda: pa.schema(
            [("request_id", pa.int64()), ("list", pa.int64()), ("item_id", pa.int64()),
             ("order_key", pa.int64()), ("_m", pa.int64())]
        )
    )

    def lists(self, req: dict, item: dict):
        steps = (t.matrix(req, item) for t in self.tests)
        if self.mode in ("half", "whole"):
            if self.mode == "whole":
                held = np.ones((len(req["request_id"]), len(item["item_id"])), bool)
            else:
                held = M.mask_matrix(req, item) & B.numbers(item["sampled"])[None, :]
            if self.numbers[0] is not None:
                yield self.numbers[0], held
            for number, step in zip(self.numbers[1:], steps):
                held = held & step
                if number is not None:
                    yield number, held
            return
        mask = M.mask_matrix(req, item)
        if "exclude" in req:
            mask &= B.numbers(req["exclude"])[:, None] != B.numbers(item["item_id"])[None, :]
        if self.mode == "sampled":
            yield 0, mask
            yield 1, mask & B.numbers(item["sampled"])[None, :]
            return
        yield 0, mask
        held = mask
        for j, step in enumerate(steps, 1):
            held = held & step
            yield j, held

    def __call__(self, batch: pa.RecordBatch, row: int) -> dict[str, np.ndarray]:
        req, item = B.fields(batch, "requests", row), B.fields(batch, "items", row)
        ids, m = B.numbers(req["request_id"]), B.numbers(req["_m"])
        at = np.lexsort((B.numbers(item["item_id"]), B.numbers(item["order_key"])))
        item = {c: v.take(pa.array(at)) for c, v in item.items()}
        other, order = B.numbers(item["item_id"]), B.numbers(item["order_key"])
        parts = []
        for name, hit in self.lists(req, item):
            r, c = B.first_hits(hit, m)
            parts.append((ids[r], np.full(len(r), name), other[c], order[c], m[r]))
        names = self.schema.names
        return {n: np.concatenate([p[i] for p in parts]).astype(np.int64) for i, n in enumerate(names)}

    @staticmethod
    def trim(out: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        # One number per (request, list); list numbers are small.
        _, request = np.unique(out["request_id"], return_inverse=True)
        group = request.astype(np.int64) * 1024 + out["list"] + 512
        at = B.best_rows(group, (out["order_key"], out["item_id"]), out["_m"])
        return {c: v[at] for c, v in out.items()}


#: Columns a request may bring to a search; what it reads of them makes up its signature.
BASE = ("continent_id", "prefs", "_m")
#: Items that the first wave of a search reads, and how much the next ones grow.
WAVE = 2 * B.ITEM_BLOCK
GROWTH = 8
#: Width of a price step, as a factor: that of the band, so a band touches two or three.
PRICE_STEP = C.PRICE_BAND[1] / C.PRICE_BAND[0]


def on_shelves(df: DataFrame, columns: Sequence[str]):
    """Equality of several columns as one text, null where a column is."""
    kinds = dict(df.dtypes)
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean")

    def text(c: str):
        column = F.col(c)
        return (column.cast("double") if kinds[c] in numeric or kinds[c].startswith("decimal") else column).cast("string")

    parts = [text(c) for c in columns]
    known = reduce(lambda x, y: x & y, [p.isNotNull() for p in parts])
    return F.when(known, F.concat_ws("\u0001", *parts))


def price_step(price, margin: float = 0.0):
    """The step of a price; ``margin`` is more than what rounding of the logarithm can amount to."""
    return F.floor(F.log(F.greatest(price.cast("double"), F.lit(0.01))) / F.log(F.lit(PRICE_STEP)) + margin)


def listed_items(quality: DataFrame, items: DataFrame, columns: Sequence[str], order_key: str, sampled=None) -> DataFrame:
    """Items with their order, mask columns and what the tests read. The mask is drawn from the
    catalog: a quality row without a catalog row fails it."""
    listed = quality.select(
        F.col("id").alias("item_id"),
        F.col(order_key).cast("bigint").alias("order_key"),
        (sampled if sampled is not None else F.lit(True)).alias("sampled"),
        *[F.col(c).alias("i_" + c) for c in columns],
    ).join(M.item_mask_columns(items).hint("merge"), "item_id", "left")
    return listed.fillna({"m_continent": -1, "m_motor": -1.0, "m_price": float("inf"), "m_size": -1.0, "m_category": -1})


def best_per_list(
    requests: DataFrame,
    listed: DataFrame,
    tests: Sequence[Test],
    mode: str,
    shelf: Sequence[tuple[str, str]] = (),
    price: bool = False,
    exclude: str | None = None,
    region: bool = False,
    numbers: Sequence[int | None] = (),
) -> DataFrame:
    """(request_id, list, item_id, order_key, _m, place): the first ``_m`` of each list.

    ``requests`` carry ``_m`` and the mask columns, ``listed`` is ``listed_items``. ``shelf`` names
    equality tests, (item column, request column), by which both sides are split beforehand.
    With ``price`` they are split by steps of the price too: an item lies in one step, a
    request asks the few steps its band touches. With ``region`` an item lies on the shelf of every
    continent that may show it. ``numbers`` as in the kernel.
    """
    tests, shelf = tuple(tests), list(shelf)
    if region:
        shelf.append(("region", "continent_id"))
        listed = listed.withColumn("i_region", F.explode(M.continents(F.col("m_continent"), F.col("m_motor"))))
    req = requests.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        F.col("continent_id").cast("bigint").alias("continent_id"),
        "prefs",
        F.col("_m").cast("bigint").alias("_m"),
        *([F.col(exclude).cast("bigint").alias("exclude")] if exclude else []),
        *[F.col(c).alias("r_" + c) for c in sorted({t.request for t in tests} | {r for _, r in shelf} | ({"price"} if price else set()))],
    )
    on = None
    if shelf:
        on = "_on"
        listed = listed.withColumn("_on", on_shelves(listed, ["i_" + i for i, _ in shelf]))
        req = req.withColumn("_on", on_shelves(req, ["r_" + r for _, r in shelf]))
        if price:
            low, high = (price_step(F.col("r_price") * f, m) for f, m in zip(C.PRICE_BAND, (-1e-9, 1e-9)))
            req = req.withColumn("_step", F.explode(F.sequence(low, F.greatest(low, high))))
            listed = listed.withColumn("_step", price_step(F.col("i_price")))
            req, listed = (df.withColumn("_on", F.concat("_on", F.lit("\u0001"), F.col("_step"))).drop("_step") for df in (req, listed))
        # only shelves that somebody asks for are packed
        listed = listed.join(req.select("_on").distinct(), "_on", "left_semi")
    columns = [c for c in listed.columns if c != "_on" and (not c.startswith("i_") or c[2:] in {t.item for t in tests})]
    packed_items = B.pack(listed, on, "item_id", B.ITEM_BLOCK, columns, "items")
    packed = B.pack(req, on, "request_id", B.QUERY_BLOCK, [c for c in req.columns if c != "_on"], "requests").withColumn(
        "_run", F.concat_ws("|", "_shelf", "_bucket")
    )
    kernel = _ListKernel(tests, mode, tuple(numbers))
    found = B.meet(packed, packed_items).mapInArrow(
        B.block_mapper("_run", kernel, kernel.trim, kernel.schema),
        "request_id bigint, list bigint, item_id bigint, order_key bigint, _m bigint",
    )
    return first_places(found)


def first_places(found: DataFrame) -> DataFrame:
    """The first ``_m`` of each list. One shuffle by request serves this and what callers add."""
    best = W.partitionBy("request_id", "list").orderBy("order_key", "item_id")
    return (
        found.repartition("request_id").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= F.col("_m"))
    )


def in_waves(requests: DataFrame, listed: DataFrame, search, lists: Sequence[int], wave: int | None = None) -> DataFrame:
    """``search(requests, items)`` over items in order, the first few, about ``wave``, first.

    A request stays until all its ``lists`` are full; each wave reads ``GROWTH`` times the
    items of the one before, so there are few waves, and a request reads at most about
    ``GROWTH`` times the items that its lists reach down to.
    """
    size = listed.agg(F.count("*").alias("n"), F.min("order_key").alias("lo"), F.max("order_key").alias("hi")).first()
    if not size["n"]:
        return search(requests, listed)
    low, step = size["lo"] - 1, max((size["hi"] - size["lo"] + 1) * (wave or WAVE) // size["n"], 1)
    waves: list[DataFrame] = []
    while True:
        high = min(low + step, size["hi"])
        here = listed.filter((F.col("order_key") > low) & (F.col("order_key") <= high))
        waves.append(cut_lineage(search(requests, here).drop("place")))
        if high >= size["hi"]:
            break
        sizes = reduce(DataFrame.unionByName, waves).filter(F.col("list").isin(*lists)).groupBy("request_id", "list").agg(
            F.count("*").alias("n"), F.max("_m").alias("_m")
        )
        full = sizes.filter("n >= _m").groupBy("request_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(lists))
        requests = cut_lineage(requests.join(full.select("request_id"), "request_id", "left_anti"))
        if requests.isEmpty():
            break
        low, step = high, step * GROWTH
    return first_places(reduce(DataFrame.unionByName, waves))


def signatures(requests: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(one request per distinct signature, (request_id, _as): the request that stands for each).

    Requests that agree in all ``columns`` get the same lists, which are made once.
    """
    ones = cut_lineage(requests.groupBy(*columns).agg(F.min("request_id").alias("request_id")))
    keys = ones.select(*[F.col(c).alias(f"_{n}") for n, c in enumerate(columns)], F.col("request_id").alias("_as"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{n}")) for n, c in enumerate(columns)])
    return ones, requests.join(keys, same).select("request_id", "_as")


def spread(lists: DataFrame, stands_for: DataFrame) -> DataFrame:
    """Lists of the signatures as lists of all requests."""
    return lists.withColumnRenamed("request_id", "_as").join(stands_for, "_as").drop("_as")


def _per_request():
    return W.partitionBy("request_id")


def _per_list():
    return W.partitionBy("request_id", "list")


LADDER = (
    Test("price", "price", "near"),
    Test("frame_size_code", "frame_size_code"),
    Test("family_id", "family_id"),
)


def relaxed_quality(
    requests: DataFrame, quality: DataFrame, items: DataFrame, strict_mask: bool = False
) -> DataFrame:
    """The first ``n`` by quality under the deepest rung that holds at least ``n``.

    Rungs: type + price band + size + family, then without family, without size, without
    price, and at last all items without the mask (all masked items with
    ``strict_mask``). A request with ``n`` below 1 gets nothing. Returns (request_id,
    position, item_id, rung), rung 4 the strictest.

    The rungs with a size read the items of the request's type and size in the price steps of
    its band. Only requests they leave short go on to all sizes and then to all prices, in
    order of quality, until their list is full. Equal requests are answered once.
    """
    req = requests.filter(F.col("n") >= 1).withColumn("_m", F.col("n").cast("bigint"))
    tested = ("bike_type", "price", "frame_size_code", "family_id")
    ones, stands_for = signatures(req, (*BASE, *tested))
    listed = cut_lineage(listed_items(quality, items, tested, "quality_rank"))
    kind = [("bike_type", "bike_type")]
    enough = F.when(F.col("_size") >= F.col("_m"), F.col("list"))
    band, size, family = LADDER
    sized = best_per_list(ones, listed, (band, family), "ladder", [*kind, (size.item, size.request)], price=True)
    sized = cut_lineage(
        sized.filter("list >= 1")
        .withColumn("_size", F.count("*").over(_per_list()))
        .withColumn("_deepest", F.max(enough).over(_per_request()))
        .filter(F.col("list") == F.col("_deepest"))
        .select("request_id", "place", "item_id", (F.col("list") + 2).alias("rung"))
    )
    left = cut_lineage(ones.join(sized.select("request_id").distinct(), "request_id", "left_anti"))
    banded = in_waves(left, listed, lambda some, here: best_per_list(some, here, (band,), "ladder", kind, price=True), (1,))
    banded = cut_lineage(
        banded.filter("list = 1")
        .withColumn("_size", F.count("*").over(_per_request()))
        .filter(F.col("_size") >= F.col("_m"))
        .select("request_id", "place", "item_id", F.lit(2).cast("bigint").alias("rung"))
    )
    left = cut_lineage(left.join(banded.select("request_id").distinct(), "request_id", "left_anti"))
    typed = in_waves(left, listed, lambda some, here: best_per_list(some, here, (), "ladder", kind), (0,))
    typed = cut_lineage(typed.withColumn("_size", F.count("*").over(_per_request())).filter(F.col("_size") >= F.col("_m")))
    left = left.join(typed.select("request_id").distinct(), "request_id", "left_anti")
    done = [sized, banded, typed.select("request_id", "place", "item_id", F.lit(1).cast("bigint").alias("rung"))]
    if strict_mask:
        last = in_waves(left, listed, lambda some, here: best_per_list(some, here, (), "ladder"), (0,))
        last = last.select("request_id", "place", "item_id")
    else:
        # Places 1..n are quality ranks, so the last rung is an equality join.
        last = (
            left.select("request_id", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("place"))
            .join(quality.select("id", "quality_rank"), F.col("place") == F.col("quality_rank"))
            .select("request_id", "place", F.col("id").alias("item_id"))
        )
    done.append(last.withColumn("rung", F.lit(0).cast("bigint")))
    lists = spread(reduce(DataFrame.unionByName, done), stands_for)
    return lists.select("request_id", F.col("place").cast("int").alias("position"), "item_id", "rung")


#: Equality columns up to which a shelf is split by region too, so that shelves do not get too small.
FINE = 4


def shelf_columns(tests: Sequence[Test]) -> tuple[tuple[tuple[str, str], ...], bool]:
    """The equality tests among ``tests``, and whether the price band is one of them."""
    equal = tuple((t.item, t.request) for t in tests if t.kind in ("same", "same_unless"))
    return equal, any((t.item, t.request, t.kind) == ("price", "price", "near") for t in tests)


def deepest_lists(asked: DataFrame, listed: DataFrame, tests: Sequence[Test], side: int) -> list[DataFrame]:
    """For each request its deepest full list, as list ``side * (tests applied + 1)``.

    A list that holds ``_m`` items makes all with fewer tests needless, so the one with all tests
    is made first, from the items on the shelf that its equality tests and price band name;
    requests it leaves short go on to the next with another shelf. Lists of one shelf are made together.
    """
    tests, mode, out = tuple(tests), "half" if side > 0 else "whole", []
    listed = listed.filter("sampled") if side > 0 else listed
    depth = len(tests)
    while depth and not asked.isEmpty():
        equal, price = shelf_columns(tests[:depth])
        least = depth
        while least > 1 and shelf_columns(tests[: least - 1]) == (equal, price):
            least -= 1
        last = tests[depth - 1]
        if last.kind == "same_unless":
            # who passes this test over has the same items one test earlier
            passed = asked.filter(F.col(last.request).eqNullSafe(last.skip))
            asked = asked.filter(~F.col(last.request).eqNullSafe(last.skip))
        # an earlier test that may be passed over is no column of the shelf
        loose = [(t.item, t.request) for t in tests[: depth - 1] if t.kind == "same_unless"]
        shelf = [c for c in equal if c not in loose]
        further = [t for t in tests[:depth] if (t.item, t.request) not in shelf]
        numbers: list[int | None] = [None] * (len(further) + 1)
        for d in range(least, depth + 1):
            numbers[sum((t.item, t.request) not in shelf for t in tests[:d])] = side * (d + 1)
        columns = len(shelf) + price
        region = side > 0 and columns <= FINE

        def search(some, here, further=further, numbers=numbers, shelf=shelf, price=price, region=region):
            return best_per_list(some, here, further, mode, shelf, price and bool(shelf or region), region=region, numbers=numbers)

        found = cut_lineage(in_waves(asked, listed, search, (side * (depth + 1),), WAVE * GROWTH ** min(max(columns - 1, 0), 2)).drop("place"))
        out.append(found)
        full = found.groupBy("request_id", "list").agg(F.count("*").alias("_n"), F.max("_m").alias("_m")).filter("_n >= _m")
        asked = cut_lineage(asked.join(full.select("request_id").distinct(), "request_id", "left_anti"))
        if last.kind == "same_unless":
            asked = asked.unionByName(passed)
        depth = least - 1
    return out


def progressive_quality(
    requests: DataFrame,
    quality: DataFrame,
    items: DataFrame,
    tests: Sequence[Test] = (),
    seed: int = 0,
    fraction: float = 0.5,
    order: str = "quality",
    strict_mask: bool = False,
) -> DataFrame:
    """Sampled picks under tests applied one after the other.

    With at least ``n`` masked items a seeded half of them is used, else all items
    without the mask (``strict_mask`` keeps the masked half). Tests are added while at
    least ``2n`` items remain; of the first ``2n`` of what is left, ``n`` are drawn in
    seeded order. A request left with fewer than ``n`` gets nothing, see
    ``short_requests``; so does one with ``n`` below 1. Returns (request_id, position,
    item_id, slug).

    Without a test, items are read in order until the list is full. With tests, the list under all
    of them comes first, see ``deepest_lists``. Equal requests are answered once up to the
    drawing.
    """
    if order == "random":
        digest = F.conv(F.substring(X.seeded_order(F.col("id"), seed=seed + 1), 1, 15), 16, 10)
        quality = quality.withColumn("_order", digest.cast("bigint"))
    else:
        quality = quality.withColumn("_order", F.col("quality_rank"))
    tests = tuple(tests)
    req = requests.filter(F.col("n") >= 1).withColumn("_m", (2 * F.col("n")).cast("bigint"))
    ones, stands_for = signatures(req, (*BASE, *sorted({t.request for t in tests})))
    sampled = X.in_fraction([F.col("id")], fraction, seed)
    listed = cut_lineage(listed_items(quality, items, sorted({t.item for t in tests}), "_order", sampled))

    shallow = in_waves(ones, listed, lambda some, here: best_per_list(some, here, (), "sampled", region=True), (0, 1))
    n = F.col("_m") / 2
    masked = shallow.filter(F.col("list") == 0).groupBy("request_id").agg(F.count("*").alias("_masked"))
    sided = ones.join(masked, "request_id", "left").withColumn(
        "_side", F.lit(1) if strict_mask else F.when(F.coalesce("_masked", F.lit(0)) >= n, 1).otherwise(-1)
    )
    sided = cut_lineage(sided.drop("_masked"))
    # the first items of all, for requests whose mask leaves too few
    first = sided.filter("_side < 0").agg(F.max("_m")).first()[0] or 0
    top = listed.orderBy("order_key", "item_id").limit(int(first))
    top = top.withColumn("place", F.row_number().over(W.orderBy("order_key", "item_id"))).select("place", "item_id", "order_key")
    whole = (
        sided.filter("_side < 0")
        .select("request_id", "_m", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("place"))
        .join(top, "place")
        .withColumn("list", F.lit(-1).cast("bigint"))
    )
    lists = shallow.filter(F.col("list") == 1).unionByName(whole).drop("place")
    for side in (1, -1) if tests else ():
        asked = sided.filter(F.col("_side") == side).drop("_side")
        lists = reduce(DataFrame.unionByName, deepest_lists(asked, listed, tests, side), lists)
    depth = F.abs("list")
    # The first list of a side always holds; a deeper one needs 2n items.
    valid = (depth == 1) | (F.col("_size") >= F.col("_m"))
    chosen = (
        lists.join(sided.select("request_id", "_side"), "request_id")
        .filter(F.signum("list") == F.col("_side"))
        .withColumn("_size", F.count("*").over(_per_list()))
        .withColumn("_depth", F.max(F.when(valid, depth)).over(_per_request()))
        .filter((depth == F.col("_depth")) & (F.col("_size") >= n))
        .select("request_id", "item_id", "_m")
    )
    draw = _per_request().orderBy("_draw", "item_id")
    return (
        spread(chosen, stands_for)
        .withColumn("_draw", X.seeded_order(F.col("request_id"), F.col("item_id"), seed=seed))
        .withColumn("position", F.row_number().over(draw))
        .filter(F.col("position") <= n)
        .join(quality.select(F.col("id").alias("item_id"), "slug"), "item_id")
        .select("request_id", "position", "item_id", "slug")
    )


def short_requests(requests: DataFrame, picks: DataFrame) -> DataFrame:
    """(request_id, error) for the requests that got no picks."""
    return requests.join(picks.select("request_id").distinct(), "request_id", "left_anti").select(
        "request_id", F.lit("fewer items left than asked for").alias("error")
    )


def sampled_quality(
    requests: DataFrame, quality: DataFrame, items: DataFrame, sample: int = 100, seed: int = 0
) -> DataFrame:
    """``n`` drawn in seeded order from the relaxed top ``sample``; nothing if it is short."""
    top = relaxed_quality(requests.withColumn("n", F.lit(sample)), quality, items)
    n = F.col("n")
    return (
        top.join(requests.select("request_id", "n"), "request_id")
        .withColumn("_draw", X.seeded_order(F.col("request_id"), F.col("item_id"), seed=seed))
        .withColumn("position", F.row_number().over(_per_request().orderBy("_draw", "item_id")))
        .withColumn("_left", F.count("*").over(_per_request()))
        .filter((F.col("_left") >= n) & (F.col("position") <= n))
        .select("request_id", "position", "item_id")
    )
