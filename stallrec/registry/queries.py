"""Every operator as a query over the driver's tables, with its oracle where SQL can say it."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from stallrec import config as C
from stallrec.functions import columns as X
from stallrec.operators import catalog as G
from stallrec.operators import content as K
from stallrec.operators import export as E
from stallrec.operators import factors as CF
from stallrec.operators import feedback as FB
from stallrec.operators import lists as L
from stallrec.operators import masks as M
from stallrec.operators import preferences as P
from stallrec.operators import quality as Q
from stallrec.operators import similarity as S
from stallrec.plans import batch as BT
from stallrec.plans import jobs as J
from stallrec.registry import sql
from stallrec.session import cut_lineage, shared_folder
from stallrec.sources import standins as D
from stallrec.sources import tables as T

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines hand out one number type."""
    return df.select(
        *[F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes]
    )


class Parts:
    """The inputs most queries share, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.tables = D.catalog_tables(spark, sf_dir)
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def items(self) -> DataFrame:
        return self._once("items", lambda: cut_lineage(G.clean_items(G.listing_catalog(self.tables, D.CATALOG_AS_OF))))

    @property
    def active(self) -> DataFrame:
        return G.status_masked(self.items)

    @property
    def quality(self) -> DataFrame:
        return self._once("quality", lambda: cut_lineage(G.quality_table(self.tables)))

    @property
    def preferences(self) -> DataFrame:
        return P.user_preferences(D.stated_preferences(self.spark, self.dir), self.tables["categories"])

    @property
    def neighbors(self) -> DataFrame:
        return self._once("neighbors", lambda: cut_lineage(S.nearest_items(self.items, self.active)))

    @property
    def near(self) -> DataFrame:
        """Of the neighbors those that the requests can use."""
        return self._once("near", lambda: cut_lineage(K.request_neighbors(self.requests, self.items, self.active)))

    def alike(self, match: str = "any") -> DataFrame:
        return self._once(f"alike_{match}", lambda: cut_lineage(K.alike_neighbors(self.requests, self.items, self.active, match=match)))

    @property
    def requests(self) -> DataFrame:
        def make():
            rows = BT.checked(D.requests(self.spark, self.dir))
            good = BT.with_defaults(rows.filter(F.col("error").isNull()).drop("error"))
            return cut_lineage(M.attach_masks(good, self.preferences, self.items))

        return self._once("requests", make)

    @property
    def vectors(self) -> DataFrame:
        return D.table(self.spark, self.dir, "embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
        )

    @property
    def users(self) -> DataFrame:
        return self.vectors.select(F.col("id").cast("string").alias("user"), "vector")

    @property
    def factors(self) -> DataFrame:
        return self.vectors.select(F.col("id").alias("item_id"), "vector")

    @property
    def pairs(self) -> DataFrame:
        """Distinct (user, item_id) of the raw events."""
        return (
            D.table(self.spark, self.dir, "events")
            .select(F.col("user_id").cast("string").alias("user"), F.from_json("props", "k bigint")["k"].alias("item_id"))
            .distinct()
        )

    def store(self) -> BT.Store:
        return BT.Store(
            self.items, self.active, self.quality, self.preferences, self.near, self.users, self.factors
        )


_PARTS: dict[tuple[str, str], Parts] = {}


def parts(spark: SparkSession, sf_dir: str) -> Parts:
    """The shared inputs of one application and folder: written once, read by all queries,
    as the request handlers read the artifacts of the content job."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PARTS:
        _PARTS[key] = Parts(spark, sf_dir)
    return _PARTS[key]


def items_out(df: DataFrame) -> DataFrame:
    return df.select("request_id", F.col("position").cast("bigint").alias("position"), "item_id")


POSITIONS = "SELECT request_id, CAST(position AS BIGINT) AS position, item_id FROM "

# ------------------------------------------------------------------ catalog


@register("catalog_listing", sql.query("SELECT * FROM catalog", "catalog"))
def _(spark, d):
    return G.listing_catalog(D.catalog_tables(spark, d), D.CATALOG_AS_OF)


@register("catalog_clean", sql.query("SELECT * FROM items", "items"))
def _(spark, d):
    return G.clean_items(G.listing_catalog(D.catalog_tables(spark, d), D.CATALOG_AS_OF))


@register("catalog_active", sql.query("SELECT id, family_id, bike_type, brand FROM active", "active"))
def _(spark, d):
    items = G.clean_items(G.listing_catalog(D.catalog_tables(spark, d), D.CATALOG_AS_OF))
    return G.status_masked(items).select("id", *C.PREFILTER_FEATURES)


@register(
    "preference_projection",
    sql.query("SELECT id, continent_id, motor, price, frame_size_code, bike_category_id FROM items", "items"),
)
def _(spark, d):
    items = G.clean_items(G.listing_catalog(D.catalog_tables(spark, d), D.CATALOG_AS_OF))
    return items.select("id", *C.PREFERENCE_FEATURES)


@register("quality_ranked", sql.query("SELECT * FROM quality", "quality"))
def _(spark, d):
    return G.quality_table(D.catalog_tables(spark, d))


@register(
    "latest_line_per_part",
    """SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, l_quantity, l_returnflag FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC,
                   l_linenumber DESC, l_quantity DESC, l_returnflag DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(spark, d):
    rows = D.table(spark, d, "lineitem").select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    return G.keep_last(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])


@register(
    "median_filled",
    sql.query(
        "SELECT id, CAST(coalesce(motor, (SELECT median(motor) FROM catalog)) AS DOUBLE) AS motor FROM catalog", "catalog"
    ),
)
def _(spark, d):
    catalog = G.listing_catalog(D.catalog_tables(spark, d), D.CATALOG_AS_OF)
    return G.fill_with_median(catalog, "motor").select("id", "motor")


@register(
    "size_as_number",
    f"""SELECT p_partkey, {sql.size_text('p_size')} AS size, {sql.size_number(sql.size_text('p_size'), '56')} AS request_size,
        {sql.size_number("p_type", '1')} AS preference_size FROM part""",
)
def _(spark, d):
    return D.table(spark, d, "part").select(
        "p_partkey",
        D.frame_size_text(F.col("p_size")).alias("size"),
        X.size_number(D.frame_size_text(F.col("p_size")), default=56.0).alias("request_size"),
        X.size_number(F.col("p_type"), default=1.0).alias("preference_size"),
    )


# ------------------------------------------------------------------ feedback


@register("event_feeds", sql.query("SELECT * FROM feeds", "feeds"))
def _(spark, d):
    return FB.union_feeds(D.event_sources(spark, d))


@register(
    "event_value",
    sql.query(
        f"""SELECT event_id, CAST({sql.weight('event_type')} AS DOUBLE) AS weight,
            CAST({sql.weight('event_type', C.EXPORT_EVENT_WEIGHTS, 'NULL')} AS DOUBLE) AS export_weight,
            CAST({sql.decay('ts', '2024-01-31')} AS DOUBLE) AS near_factor,
            CAST({sql.decay('ts', '2024-03-31')} AS DOUBLE) AS far_factor FROM named""",
        "named",
    ),
)
def _(spark, d):
    ev = D.named_events(spark, d)
    return doubles(
        ev.select(
            "event_id",
            X.event_weight(F.col("event_type")).alias("weight"),
            X.event_weight(F.col("event_type"), C.EXPORT_EVENT_WEIGHTS, None).alias("export_weight"),
            X.recency_factor(F.col("ts"), D.EVENTS_AS_OF).alias("near_factor"),
            X.recency_factor(F.col("ts"), dt.date(2024, 3, 31)).alias("far_factor"),
        )
    )


@register(
    "event_lookback",
    sql.query(f"SELECT event_type, count(*) AS events FROM ordered WHERE {sql.lookback('event_type', 'ts', '2001-11-06')} GROUP BY 1", "ordered"),
)
def _(spark, d):
    return FB.recent_events(D.order_events(spark, d), D.ORDERS_AS_OF).groupBy("event_type").agg(F.count("*").alias("events"))


@register("actor_users", sql.query("SELECT * FROM ev_map", "ev_map"))
def _(spark, d):
    return FB.actor_user_map(FB.union_feeds(D.event_sources(spark, d)))


@register(
    "feedback_actor_item",
    sql.query("SELECT anonymous_id, item_id, CAST(feedback AS DOUBLE) AS feedback FROM ev_pairs", "ev_pairs"),
)
def _(spark, d):
    return doubles(FB.actor_item_feedback(FB.union_feeds(D.event_sources(spark, d)), D.EVENTS_AS_OF))


@register(
    "feedback_active_actors",
    sql.query(
        "SELECT anonymous_id, item_id, CAST(feedback AS DOUBLE) AS feedback, anonymous_id_cnt FROM od_actors", "od_actors"
    ),
)
def _(spark, d):
    pairs = cut_lineage(FB.actor_item_feedback(D.order_events(spark, d), D.ORDERS_AS_OF))
    return doubles(FB.active_actors(pairs))


@register("feedback_user_item", sql.query("SELECT * FROM ev_interactions", "ev_interactions"))
def feedback_user_item(spark, d):
    feeds = FB.union_feeds(D.event_sources(spark, d))
    return doubles(FB.interactions(feeds, D.catalog_tables(spark, d), D.EVENTS_AS_OF))


@register("feedback_orders", sql.query("SELECT * FROM od_interactions", "od_interactions"))
def _(spark, d):
    return doubles(FB.interactions(D.order_events(spark, d), D.catalog_tables(spark, d), D.ORDERS_AS_OF))


@register(
    "feedback_regrouped",
    sql.query(
        """SELECT user_id, bike_id, bike_type_id, bike_category_id, min(price) AS price, min(family_id) AS family_id,
           min(rider_height_min) AS rider_height_min, min(rider_height_max) AS rider_height_max, sum(feedback) AS feedback
           FROM ev_interactions GROUP BY 1, 2, 3, 4""",
        "ev_interactions",
    ),
)
def _(spark, d):
    feeds = FB.union_feeds(D.event_sources(spark, d))
    return doubles(FB.regrouped(FB.interactions(feeds, D.catalog_tables(spark, d), D.EVENTS_AS_OF)))


# ------------------------------------------------------------------ preferences


@register("user_preferences", sql.query("SELECT * FROM stated", "stated"))
def _(spark, d):
    return P.user_preferences(D.stated_preferences(spark, d), D.catalog_tables(spark, d)["categories"])


@register(
    "stated_budget",
    sql.query(
        """
WITH b AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
         CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'More than €' || (c_custkey % 9 + 1) || '000'
              WHEN 2 THEN 'More than €' || (c_custkey % 9 + 1) || '.500'
              ELSE '€' || (c_custkey % 9 + 1) || '.000-€' || (c_custkey % 9 + 3) || '.500' END AS budget,
         ['Promo', 'Small', 'small', 'Unknown', 'Medium'][c_custkey % 5 + 1] AS rider_style
  FROM customer)
SELECT user_id, c.id AS bike_category_id,
       CASE WHEN budget LIKE 'More than%' THEN round(CAST(replace(replace(budget, '€', ''), 'More than ', '') AS DECIMAL(18,3)), 0)
            ELSE CAST(replace(replace(split_part(budget, '-', 1), '€', ''), '.', '') AS DOUBLE) END::DOUBLE AS budget_min,
       CASE WHEN budget LIKE 'More than%' THEN 20000
            ELSE CAST(replace(replace(split_part(budget, '-', 2), '€', ''), '.', '') AS DOUBLE) END::DOUBLE AS budget_max
FROM b LEFT JOIN categories c ON b.rider_style = c.name""",
        "categories",
    ).replace("\nWITH b AS (", ", b AS (", 1).replace(")\n, b AS", "),\nb AS", 1),
)
def _(spark, d):
    return P.stated_budget(D.stated_budgets(spark, d), D.catalog_tables(spark, d)["categories"])


# ------------------------------------------------------------------ similarity


@register(
    "weighted_features",
    sql.query(
        "SELECT id, z_price AS price, z_frame_size_code AS frame_size_code, z_year AS year, color, brand, suspension FROM feats",
        "feats",
    ),
)
def _(spark, d):
    feats = S.feature_frame(parts(spark, d).items, S.item_features())
    return feats.select("id", "price", "frame_size_code", "year", "color", "brand", "suspension")


@register("neighbors_tenth", sql.query("SELECT * FROM neighbors", "neighbors"))
def _(spark, d):
    p = parts(spark, d)
    return S.nearest_items(p.items, p.active)


@register("neighbors_50", sql.query(sql.neighbors_sql("50"), "feats"))
def _(spark, d):
    p = parts(spark, d)
    return S.nearest_items(p.items, p.active, k=50)


@register("neighbors_by_heap", sql.query(sql.neighbors_sql("20"), "feats"))
def _(spark, d):
    p = parts(spark, d)
    return S.nearest_items(p.items, p.active, k=20, select="heap")


def _features_metric(name: str, distance: str) -> None:
    @register(f"neighbors_{name}", sql.query(sql.neighbors_sql("20", distance), "feats"))
    def _(spark, d):
        p = parts(spark, d)
        return S.nearest_items(p.items, p.active, S.item_features(name), k=20)


_cats = C.CATEGORICAL_FEATURES
_w = {c: 20 if c in C.HEAVY_CATEGORIES else 1 for c in _cats}
_l1 = " + ".join(f"CASE WHEN a.{c} = b.{c} THEN 0 ELSE {2 * _w[c]} END" for c in _cats)
_l1n = " + ".join(f"abs(a.z_{c} - b.z_{c})" for c in C.NUMERICAL_FEATURES)
_dot = " + ".join(f"CASE WHEN a.{c} = b.{c} THEN {_w[c] ** 2} ELSE 0 END" for c in _cats)
_dotn = " + ".join(f"a.z_{c} * b.z_{c}" for c in C.NUMERICAL_FEATURES)
_norm = {
    t: f"({sum(v * v for v in _w.values())}::DOUBLE + " + " + ".join(f"{t}.z_{c} * {t}.z_{c}" for c in C.NUMERICAL_FEATURES) + ")"
    for t in ("a", "b")
}
_features_metric("cityblock", f"CAST({_l1} AS DOUBLE) + {_l1n}")
_features_metric("cosine", f"1 - (CAST({_dot} AS DOUBLE) + {_dotn}) / sqrt({_norm['a']} * {_norm['b']})")

_VECTOR_DISTANCE = {
    "euclidean": "list_distance(a.vector, b.vector)",
    "sqeuclidean": "list_sum(list_transform(list_zip(a.vector, b.vector), lambda x: (x[1] - x[2]) * (x[1] - x[2])))",
    "cityblock": "list_sum(list_transform(list_zip(a.vector, b.vector), lambda x: abs(x[1] - x[2])))",
    "cosine": "list_cosine_distance(a.vector, b.vector)",
}


def _vector_metric(metric: str, distance: str) -> None:
    body = f"""
SELECT item_id, neighbor_id, distance, CAST(rank AS INTEGER) AS rank, {sql.PLACE} AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, neighbor_id) AS rank
  FROM (SELECT a.vec_id AS item_id, b.vec_id AS neighbor_id, round({distance}, 6) AS distance
        FROM vectors a JOIN vectors b ON b.label < 5)) WHERE rank <= 20"""

    @register(f"vector_neighbors_{metric}", sql.query(body, "vectors"))
    def _(spark, d):
        v = parts(spark, d).vectors
        return S.nearest_vectors(v, v.filter("label < 5"), metric, k=20)


for _metric, _distance in _VECTOR_DISTANCE.items():
    _vector_metric(_metric, _distance)


@register("neighbor_lookup", sql.query("SELECT request_id, bike_id, item_id, distance, CAST(position AS INTEGER) AS position FROM near", "near"))
def _(spark, d):
    p = parts(spark, d)
    return S.lookup(p.requests, p.neighbors)


@register(
    "unknown_items",
    sql.query("SELECT request_id, 'unknown item ' || bike_id AS error FROM good WHERE bike_id NOT IN (SELECT id FROM items)", "good", "items"),
)
def _(spark, d):
    p = parts(spark, d)
    return S.unknown_items(p.requests, p.items)


@register(
    "content_artifact_sizes",
    sql.query(
        """SELECT 'items' AS artifact, count(*) AS n FROM items UNION ALL SELECT 'items_preference', count(*) FROM items
           UNION ALL SELECT 'user_preferences', count(*) FROM stated UNION ALL SELECT 'items_active', count(*) FROM active
           UNION ALL SELECT 'items_quality', count(*) FROM quality UNION ALL SELECT 'neighbors', count(*) FROM neighbors""",
        "items", "stated", "active", "quality", "neighbors",
    ),
)
def _(spark, d):
    """The whole content job, its artifacts counted."""
    made = J.content_artifacts(D.catalog_tables(spark, d), D.stated_preferences(spark, d), D.CATALOG_AS_OF)
    sizes = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "n") for name, df in made.items()]
    return reduce(DataFrame.unionByName, sizes)


# ------------------------------------------------------------------ masks


@register(
    "visible_by_continent",
    sql.query(
        """SELECT DISTINCT c.continent_id, i.id AS item_id FROM (SELECT unnest([1, 2, 3, 4, 7])::BIGINT AS continent_id) c
           JOIN items i ON i.continent_id = c.continent_id
             OR (c.continent_id IN (4, 7) AND i.continent_id = 1 AND i.motor = 0)""",
        "items",
    ),
)
def _(spark, d):
    return M.visible_items(parts(spark, d).items)


@register(
    "live_user_masks",
    sql.query(
        """SELECT DISTINCT r.request_id, CAST(p.max_price AS DOUBLE) AS max_price,
                  CASE WHEN r.strategy = 'product_page' THEN 0 ELSE p.category_id END AS category_id, CAST(p.size AS DOUBLE) AS size
           FROM good r JOIN wishes p ON p.user_id = r.user_id AND r.user_id <> 0
           WHERE r.request_id IN (SELECT request_id FROM user_mask)""",
        "good", "wishes", "user_mask",
    ),
)
def _(spark, d):
    stated = parts(spark, d).requests.select("request_id", F.explode("prefs").alias("p"))
    return stated.select("request_id", "p.max_price", "p.category_id", "p.size").distinct()


@register(
    "masked_rerank_candidates",
    sql.query(
        """SELECT l.request_id, l.item_id FROM (SELECT request_id, unnest(bike_rerank_id) AS item_id FROM good) l
           JOIN allowed a USING (request_id, item_id)""",
        "allowed",
    ),
)
def _(spark, d):
    p = parts(spark, d)
    given = p.requests.select("request_id", F.explode("bike_rerank_id").alias("item_id"))
    return M.permitted(given, p.requests, p.items)


@register(
    "masked_active_neighbors",
    sql.query(
        """SELECT k.request_id, k.item_id, CAST(k.position AS INTEGER) AS position FROM near k
           JOIN allowed USING (request_id, item_id) WHERE k.item_id IN (SELECT id FROM active)""",
        "near", "allowed", "active",
    ),
)
def _(spark, d):
    p = parts(spark, d)
    near = S.lookup(p.requests, p.neighbors).select("request_id", "item_id", "position")
    return M.permitted(near, p.requests, p.items).join(
        p.active.select(F.col("id").alias("item_id")), "item_id", "left_semi"
    )


# ------------------------------------------------------------------ sources


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/stallrec/{name}-{uuid.uuid4().hex}"


@register(
    "event_export_lines",
    sql.query(
        """SELECT CASE WHEN event_id % 50 <> 0 THEN event_type END AS event, count(*) AS n,
             count(CASE WHEN event_id % 50 <> 0 AND event_id % 7 <> 0 THEN user_id END) AS with_user,
             sum(CASE WHEN event_id % 50 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END)::BIGINT AS k
           FROM events GROUP BY 1"""
    ),
)
def _(spark, d):
    """Events as gzip JSON lines and back: every 50th line is broken, every 7th lacks a field."""
    events = D.table(spark, d, "events")
    inner = F.struct(F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.from_json("props", "k bigint").alias("item"), F.lit(1).alias("noise"))
    line = F.to_json(F.struct(F.col("event_type").alias("event"), inner.alias("properties")))
    path = _place(spark, "export")
    events.select(F.when(F.col("event_id") % 50 != 0, line).otherwise(F.concat(F.lit("{broken "), line)).alias("value")).write.option(
        "compression", "gzip"
    ).text(path)
    known = TY.StructType([TY.StructField("user_id", TY.LongType()), TY.StructField("item", TY.StructType([TY.StructField("k", TY.LongType())]))])
    rows = T.read_event_export(spark, path, known)
    return rows.groupBy("event").agg(
        F.count("*").alias("n"), F.count("properties.user_id").alias("with_user"), F.sum("properties.item.k").alias("k")
    )


@register(
    "content_round_trip",
    sql.query(
        """SELECT 'items' AS artifact, count(*) AS n, sum(id)::BIGINT AS ids FROM items UNION ALL
           SELECT 'items_preference', count(*), sum(id)::BIGINT FROM items UNION ALL
           SELECT 'user_preferences', count(*), sum(user_id)::BIGINT FROM stated UNION ALL
           SELECT 'items_active', count(*), sum(id)::BIGINT FROM active UNION ALL
           SELECT 'items_quality', count(*), sum(id * quality_rank)::BIGINT FROM quality UNION ALL
           SELECT 'neighbors', count(*), sum(neighbor_id)::BIGINT FROM neighbors""",
        "items", "stated", "active", "quality", "neighbors",
    ),
)
def _(spark, d):
    """The six artifacts of the content job written, read back and added up."""
    p = parts(spark, d)
    path = _place(spark, "content")
    made = {
        "items": p.items.select("id", *C.PREFILTER_FEATURES),
        "items_preference": p.items.select("id", *C.PREFERENCE_FEATURES),
        "user_preferences": p.preferences,
        "items_active": p.active.select("id", *C.PREFILTER_FEATURES),
        "items_quality": p.quality,
        "neighbors": p.neighbors,
    }
    T.write_content(made, path)
    sums = {"user_preferences": F.col("user_id"), "items_quality": F.col("id") * F.col("quality_rank"), "neighbors": F.col("neighbor_id")}
    back = T.read_content(spark, path)
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count("*").alias("n"), F.sum(sums.get(name, F.col("id"))).cast("bigint").alias("ids")).select(F.lit(name).alias("artifact"), "n", "ids")
            for name, df in back.items()
        ],
    )


@register(
    "interactions_round_trip",
    sql.query(
        """SELECT user_id, bike_id, round(CAST(feedback AS DOUBLE), 6) AS feedback, 'orders until ' || DATE '1998-08-02' AS metadata
           FROM od_interactions""".replace("DATE '1998-08-02'", "'" + str(D.ORDERS_AS_OF) + "'"),
        "od_interactions",
    ),
)
def _(spark, d):
    """Interactions and their metadata written and read back."""
    path = _place(spark, "interactions")
    T.write_interactions(FB.interactions(D.order_events(spark, d), parts(spark, d).tables, D.ORDERS_AS_OF), f"orders until {D.ORDERS_AS_OF}", path)
    rows, metadata = T.read_interactions(spark, path)
    feedback = F.round(F.col("feedback").cast("double"), 6).alias("feedback")
    return rows.select("user_id", "bike_id", feedback).join(metadata)


@register(
    "model_round_trip",
    sql.query(
        """SELECT 'user' AS side, count(DISTINCT user_id) AS known, (SELECT count(DISTINCT user_id) FROM od_split WHERE NOT held) AS fitted, true AS same FROM od_split
           UNION ALL SELECT 'item', count(DISTINCT bike_id), (SELECT count(DISTINCT bike_id) FROM od_split WHERE NOT held), true FROM od_split""",
        "od_split",
    ),
)
def _(spark, d):
    """A fitted model and its id maps written and read back: the factors are the same."""
    rows = cut_lineage(FB.interactions(D.order_events(spark, d), parts(spark, d).tables, D.ORDERS_AS_OF).na.drop("any"))
    users, items = CF.dense_ids(rows, "user_id"), CF.dense_ids(rows, "bike_id")
    model = CF.fit(CF.split(rows, "user_id", "bike_id")[0], users, items, rank=4, iterations=2)
    path = _place(spark, "model")
    T.write_model(model, users, items, path)
    again, users_back, items_back = T.read_model(spark, path)
    sides = []
    for side, index, first, second in (
        ("user", users_back, CF.user_factors(model, users), CF.user_factors(again, users_back)),
        ("item", items_back, CF.item_factors(model, items), CF.item_factors(again, items_back)),
    ):
        other = first.exceptAll(second).agg((F.count("*") == 0).alias("same"))
        counts = index.agg(F.count("*").alias("known")).join(second.agg(F.count("*").alias("fitted"))).join(other)
        sides.append(counts.select(F.lit(side).alias("side"), "known", "fitted", "same"))
    return sides[0].unionByName(sides[1])


@register(
    "declared_types",
    sql.query(
        """SELECT TRY_CAST(p_partkey AS BIGINT) AS id, p_retailprice::DOUBLE AS price, CAST(p_size AS VARCHAR) AS frame_size_code,
             TRY_CAST(p_type AS BIGINT) AS family_id, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END AS BIGINT) AS quality_score
           FROM part"""
    ),
)
def _(spark, d):
    """A relational scan read by declared names and types; what does not fit is null."""
    source = D.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.col("p_size").alias("frame_size_code"),
        F.col("p_type").alias("family_id"),
        F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("quality_score"),
        F.lit(1).alias("not_declared"),
    )
    path = _place(spark, "part")
    source.write.parquet(path)
    wanted = ("id", "price", "frame_size_code", "family_id", "quality_score")
    schema = TY.StructType([f for f in T.QUALITY_SCHEMA.fields if f.name in wanted])
    return T.read_relational(spark, path, schema=schema)


# ------------------------------------------------------------------ content strategies


@register("similar_items", sql.query(POSITIONS + "lookalikes", "lookalikes"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(K.similar_items(p.requests, p.near, p.items))


@register("prefiltered_items", sql.query(POSITIONS + "special", "special"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(K.prefiltered_items(p.requests, p.alike(), p.items))


@register("prefiltered_items_all", sql.query(POSITIONS + "special_all", "special_all"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(K.prefiltered_items(p.requests, p.alike("all"), p.items))


@register("relaxed_quality", sql.query("SELECT request_id, CAST(position AS BIGINT) AS position, item_id, rung FROM relaxed", "relaxed"))
def _(spark, d):
    p = parts(spark, d)
    out = Q.relaxed_quality(p.requests, p.quality, p.items)
    return out.withColumn("position", F.col("position").cast("bigint"))


@register("sampled_quality", sql.query(POSITIONS + "sampled_quality", "sampled_quality"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(Q.sampled_quality(p.requests, p.quality, p.items))


@register("mixed_interleaved", sql.query(sql.mixed_sql("special_75", "position, source").replace("\nWITH u AS (", ", u AS (", 1), "good", "items", "special_75", "lookalikes", "sampled_quality"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(K.mixed(p.requests, p.near, p.alike(), p.quality, p.items))


@register("mixed_appended", sql.query(sql.mixed_sql("special_90", "source, position").replace("\nWITH u AS (", ", u AS (", 1), "good", "items", "special_90", "lookalikes", "sampled_quality"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(K.mixed(p.requests, p.near, p.alike(), p.quality, p.items, ratio=0.9, interleave=False))


@register("family_first", sql.query("SELECT request_id, CAST(position AS BIGINT) AS position, item_id, source, family_count FROM family", "family"))
def _(spark, d):
    p = parts(spark, d)
    out = K.family_first(p.requests, p.near, p.quality, p.items)
    return out.withColumn("position", F.col("position").cast("bigint"))


@register("content_mixed", sql.query("SELECT request_id, CAST(position AS BIGINT) AS position, item_id, source, family_count FROM content", "content"))
def _(spark, d):
    p = parts(spark, d)
    out = K.content_mixed(p.requests, p.near, p.quality, p.items)
    return out.withColumn("position", F.col("position").cast("bigint"))


@register("buyer_quality_slugs", sql.query("SELECT request_id, CAST(position AS BIGINT) AS position, slug FROM buyer", "buyer"))
def _(spark, d):
    p = parts(spark, d)
    picks = Q.progressive_quality(p.requests, p.quality, p.items, Q.BUYER_TESTS)
    return picks.select("request_id", F.col("position").cast("bigint").alias("position"), "slug")


@register(
    "buyer_quality_errors",
    sql.query(
        "SELECT request_id, 'fewer items left than asked for' AS error FROM good WHERE request_id NOT IN (SELECT request_id FROM buyer)",
        "good", "buyer",
    ),
)
def _(spark, d):
    p = parts(spark, d)
    return Q.short_requests(p.requests, Q.progressive_quality(p.requests, p.quality, p.items, Q.BUYER_TESTS))


@register("plain_quality_ids", sql.query(POSITIONS + "plain_quality", "plain_quality"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(Q.progressive_quality(p.requests, p.quality, p.items))


# ------------------------------------------------------------------ list combinators


def _two_lists(spark, d):
    lines = D.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    w = W.partitionBy("l_orderkey").orderBy("l_partkey")

    def pick(flag):
        return lines.filter(F.col("l_returnflag") == flag).select(
            F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("item_id"),
            F.row_number().over(w).alias("position"),
        )

    return pick("R"), pick("N")


_LISTS = """
WITH x AS (SELECT DISTINCT l_orderkey AS request_id, l_partkey AS item_id, l_returnflag AS f FROM lineitem WHERE l_returnflag IN ('R', 'N')),
u AS (SELECT request_id, item_id, CASE f WHEN 'R' THEN 0 ELSE 1 END AS source,
             row_number() OVER (PARTITION BY request_id, f ORDER BY item_id) AS position FROM x),
s AS (SELECT *, row_number() OVER (PARTITION BY request_id, item_id ORDER BY {order}) AS seen FROM u)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY {order}) AS position, item_id FROM s WHERE seen = 1"""


@register("lists_interleaved", _LISTS.format(order="position, source"))
def _(spark, d):
    return items_out(L.first_seen(L.interleaved(*_two_lists(spark, d))))


@register("lists_appended", _LISTS.format(order="source, position"))
def _(spark, d):
    return items_out(L.first_seen(L.appended(*_two_lists(spark, d))))


# ------------------------------------------------------------------ collaborative filtering


@register("collaborative_top", sql.query(POSITIONS + "personal", "personal"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(CF.collaborative(p.requests, p.users, p.factors, p.items, p.active))


@register("collaborative_randomised", sql.query(POSITIONS + "personal_10", "personal_10"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(CF.collaborative(p.requests, p.users, p.factors, p.items, p.active, widen=10))


@register(
    "collaborative_scores",
    sql.query(
        """SELECT request_id, item_id, score, CAST(place AS INTEGER) AS place FROM (
             SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS place FROM user_scores)
           WHERE place <= n""",
        "user_scores",
    ),
)
def _(spark, d):
    p = parts(spark, d)
    return CF.best_for_users(p.requests, p.users, p.factors, p.items, p.active, limit="n")


@register(
    "collaborative_or_quality",
    sql.query(
        POSITIONS + "personal_10 UNION ALL SELECT request_id, position, item_id FROM plain_quality "
        "WHERE request_id NOT IN (SELECT request_id FROM personal_10)",
        "personal_10", "plain_quality",
    ),
)
def _(spark, d):
    p = parts(spark, d)
    served = CF.collaborative(p.requests, p.users, p.factors, p.items, p.active, widen=10)
    return items_out(CF.collaborative_or_quality(served, Q.progressive_quality(p.requests, p.quality, p.items)))


@register(
    "unknown_users",
    sql.query(
        "SELECT request_id, actor FROM good WHERE actor NOT IN (SELECT CAST(vec_id AS VARCHAR) FROM vectors)", "good", "vectors"
    ),
)
def _(spark, d):
    p = parts(spark, d)
    return CF.unknown_users(p.requests, p.users).select("request_id", "actor")


@register("reranked", sql.query(POSITIONS + "reranked", "reranked"))
def _(spark, d):
    p = parts(spark, d)
    return items_out(CF.reranked(p.requests, p.users, p.factors))


def _index_sql(value: str, source: str) -> str:
    return f"""SELECT {value}, CAST(row_number() OVER (ORDER BY substr(md5(CAST({value} AS VARCHAR)), 1, 3), {value}) - 1 AS INTEGER) AS idx
               FROM (SELECT DISTINCT {value} FROM {source})"""


@register("user_index", sql.query(_index_sql("user_id", "ev_interactions"), "ev_interactions"))
def _(spark, d):
    feeds = FB.union_feeds(D.event_sources(spark, d))
    return CF.dense_ids(FB.interactions(feeds, D.catalog_tables(spark, d), D.EVENTS_AS_OF), "user_id")


@register("item_index", sql.query(_index_sql("bike_id", "od_interactions"), "od_interactions"))
def _(spark, d):
    rows = FB.interactions(D.order_events(spark, d), D.catalog_tables(spark, d), D.ORDERS_AS_OF)
    return CF.dense_ids(rows, "bike_id")


@register(
    "item_feature_values",
    sql.query(
        """SELECT bike_id, unnest(['family_id=' || family_id, 'bike_category_id=' || bike_category_id]) AS feature
           FROM (SELECT DISTINCT bike_id, family_id, bike_category_id FROM od_interactions)""",
        "od_interactions",
    ),
)
def _(spark, d):
    rows = FB.interactions(D.order_events(spark, d), D.catalog_tables(spark, d), D.ORDERS_AS_OF)
    feats = CF.feature_rows(rows, "bike_id", ["family_id", "bike_category_id"])
    return feats.select("bike_id", F.explode("features").alias("feature"))


@register(
    "feature_vocabulary",
    sql.query(
        _index_sql("feature", "(SELECT unnest(['family_id=' || family_id, 'bike_category_id=' || bike_category_id]) AS feature FROM listings)"),
        "listings",
    ),
)
def _(spark, d):
    rows = CF.feature_rows(D.catalog_tables(spark, d)["listings"], "id", ["family_id", "bike_category_id"])
    return CF.feature_vocabulary(rows)


@register("user_features_empty", sql.query("SELECT DISTINCT user_id, 0 AS features FROM ev_interactions", "ev_interactions"))
def _(spark, d):
    feeds = FB.union_feeds(D.event_sources(spark, d))
    rows = FB.interactions(feeds, D.catalog_tables(spark, d), D.EVENTS_AS_OF)
    return CF.feature_rows(rows, "user_id", []).select("user_id", F.size("features").alias("features"))


@register(
    "train_test_split",
    sql.query("SELECT u AS user, item_id, CASE WHEN held THEN 'test' ELSE 'train' END AS side FROM pairs", "pairs"),
)
def _(spark, d):
    train, test = CF.split(parts(spark, d).pairs, "user", "item_id")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@register(
    "positive_ranks",
    sql.query(
        """SELECT p.u AS user, p.item_id, count(*) FILTER (o.score > s.score) AS above,
                  count(*) FILTER (o.score = s.score) AS equal,
                  count(*) FILTER (o.score = s.score AND o.item_id < s.item_id) AS equal_before
           FROM pairs p JOIN all_scores s ON p.u = s.u AND p.item_id = s.item_id JOIN all_scores o ON o.u = p.u
           GROUP BY 1, 2""",
        "all_scores",
    ),
)
def _(spark, d):
    p = parts(spark, d)
    return CF.positive_ranks(p.pairs, p.users, p.factors)


def _precision_sql(k: int) -> str:
    return f"""
SELECT round(avg(hits / {k}), 6) AS precision_at_k, count(*) AS users FROM (
  SELECT u, sum(CASE WHEN held AND place <= {k} THEN 1 ELSE 0 END)::DOUBLE AS hits FROM (
    SELECT s.u, coalesce(p.held, false) AS held, row_number() OVER (PARTITION BY s.u ORDER BY s.score DESC, s.item_id) AS place
    FROM all_scores s LEFT JOIN pairs p ON p.u = s.u AND p.item_id = s.item_id WHERE p.held IS NULL OR p.held)
  GROUP BY u HAVING bool_or(held))"""


def _precision(k: int):
    def run(spark, d):
        p = parts(spark, d)
        train, test = CF.split(p.pairs, "user", "item_id")
        return CF.mean_metric(CF.precision_at_k(test, train, p.users, p.factors, k), "precision_at_k")

    return run


register("precision_at_100", sql.query(_precision_sql(100), "all_scores"))(_precision(100))
register("precision_at_4", sql.query(_precision_sql(4), "all_scores"))(_precision(4))


@register(
    "auc_score",
    sql.query(
        """SELECT round(avg(v), 6) AS auc, count(*) AS users FROM (
             SELECT a.u, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS v
             FROM (SELECT s.* FROM all_scores s JOIN pairs p ON p.u = s.u AND p.item_id = s.item_id WHERE p.held) a
             JOIN (SELECT s.* FROM all_scores s LEFT JOIN pairs p ON p.u = s.u AND p.item_id = s.item_id AND p.held
                   WHERE p.u IS NULL) b ON a.u = b.u GROUP BY a.u)""",
        "all_scores",
    ),
)
def _(spark, d):
    p = parts(spark, d)
    _, test = CF.split(p.pairs, "user", "item_id")
    return CF.mean_metric(CF.auc(test, p.users, p.factors), "auc")


@register(
    "cold_item_factors",
    sql.query(
        """
SELECT item_id, dim, round(avg(x), 6) AS x FROM (
  SELECT f.item_id, p.dim, p.x FROM (SELECT id AS item_id, unnest(['family_id=' || family_id, 'bike_type_id=' || bike_type_id]) AS feature FROM listings
                                     WHERE id NOT IN (SELECT vec_id FROM vectors)) f
  JOIN (SELECT feature, dim, avg(x) AS x FROM (
          SELECT unnest(['family_id=' || family_id, 'bike_type_id=' || bike_type_id]) AS feature, v.dim, v.x
          FROM listings JOIN (SELECT vec_id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim FROM vectors) v
            ON v.vec_id = id) GROUP BY 1, 2) p ON p.feature = f.feature)
GROUP BY 1, 2""",
        "listings", "vectors",
    ),
)
def _(spark, d):
    p = parts(spark, d)
    rows = CF.feature_rows(p.tables["listings"], "id", ["family_id", "bike_type_id"]).withColumnRenamed("id", "item_id")
    cold = CF.cold_factors(p.factors, rows)
    return cold.select("item_id", F.posexplode("vector").alias("dim", "x")).select(
        "item_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x")
    )


@register("als_top_items")
def _(spark, d):
    """Fitted factors have no closed form: rows only."""
    p = parts(spark, d)
    rows = cut_lineage(FB.interactions(D.order_events(spark, d), p.tables, D.ORDERS_AS_OF).na.drop("any"))
    users, items = CF.dense_ids(rows, "user_id"), CF.dense_ids(rows, "bike_id")
    train, _ = CF.split(rows, "user_id", "bike_id")
    model = CF.fit(train, users, items)
    factors = CF.user_factors(model, users)
    asks = p.requests.withColumn("actor", F.concat(F.lit("c"), F.col("request_id").cast("string")))
    return items_out(CF.collaborative(asks, factors, CF.item_factors(model, items), p.items, p.active))


@register(
    "als_item_counts",
    sql.query(
        """SELECT r.request_id, count(*) AS items, true AS permitted FROM (
             SELECT r.request_id, r.n, row_number() OVER (PARTITION BY r.request_id ORDER BY i.id) AS nth FROM good r
             JOIN (SELECT DISTINCT user_id FROM od_split WHERE NOT held) u ON u.user_id = 'c' || r.request_id
             JOIN allowed a USING (request_id) JOIN active i ON i.id = a.item_id
             WHERE i.id IN (SELECT bike_id FROM od_split WHERE NOT held)) r WHERE nth <= n GROUP BY 1""",
        "good", "allowed", "active", "od_split",
    ),
)
def _(spark, d):
    """What must hold for a fitted list whatever the factors: as many distinct, permitted items as there can be."""
    p = parts(spark, d)
    got = QUERIES["als_top_items"](spark, d).select("request_id", "item_id").distinct()
    fit = M.permitted(got, p.requests, p.items).withColumn("_ok", F.lit(True))
    both = got.join(fit, ["request_id", "item_id"], "left")
    return both.groupBy("request_id").agg(F.count("*").alias("items"), F.min(F.coalesce("_ok", F.lit(False))).alias("permitted"))


@register(
    "collaborative_model_job",
    sql.query(
        """
SELECT (SELECT count(DISTINCT user_id) FROM od_split WHERE held AND bike_id IN (SELECT bike_id FROM od_split WHERE NOT held)
          AND user_id IN (SELECT user_id FROM od_split WHERE NOT held)) AS users,
  true AS precision_in_range,
  (SELECT round(avg(hits / 100), 6) FROM popular) AS baseline_at_k, (SELECT count(*) FROM popular) AS baseline_users,
  (SELECT count(*) FROM listings WHERE id NOT IN (SELECT bike_id FROM od_split WHERE NOT held)
     AND (family_id IN (SELECT l.family_id FROM listings l JOIN od_split s ON s.bike_id = l.id AND NOT s.held)
       OR bike_category_id IN (SELECT l.bike_category_id FROM listings l JOIN od_split s ON s.bike_id = l.id AND NOT s.held))) AS cold_items""",
        "od_split", "popular", "listings",
    ),
)
def _(spark, d):
    """The whole job. The fitted precision has no closed form: what is compared is whose it is and that it is a share."""
    made = J.collaborative_job(D.order_events(spark, d), D.catalog_tables(spark, d), D.ORDERS_AS_OF)
    fits = F.col("precision_at_k").between(0, 1).alias("precision_in_range")
    return made.select("users", fits, "baseline_at_k", "baseline_users", "cold_items")


# ------------------------------------------------------------------ requests


@register("request_errors", sql.query("SELECT request_id, error FROM judged WHERE error IS NOT NULL", "judged"))
def _(spark, d):
    return BT.checked(D.requests(spark, d)).filter(F.col("error").isNotNull()).select("request_id", "error")


_BADLY_TYPED = """
SELECT request_id, strategy, bike_id, bike_rerank_id, user_id, distinct_id,
  CASE request_id % 8 WHEN 0 THEN 'twelve' WHEN 1 THEN '12.0' WHEN 2 THEN ' 7 ' WHEN 3 THEN '12.5' WHEN 4 THEN NULL
    ELSE CAST(request_id % 30 AS VARCHAR(20)) END AS n,
  CASE request_id % 6 WHEN 0 THEN price + 0.5 ELSE price + 0.0 END AS price,
  CASE request_id % 5 WHEN 0 THEN '' ELSE '+1' END AS continent_id, family_id, 'n/a' AS bike_type
FROM {}"""


@register(
    "request_refusals",
    sql.query(
        f"""
SELECT request_id, CASE
  WHEN strategy = 'rerank' AND bike_rerank_id IS NULL THEN 'a rerank request needs bike_rerank_id'
  WHEN strategy = 'product_page' AND (bike_id IS NULL OR bike_id = 0) THEN 'a product page request needs bike_id'
  WHEN strategy IN ('homepage', 'braze', 'rerank') AND (user_id IS NULL OR user_id = '0') AND (distinct_id IS NULL OR distinct_id = 'NA')
    THEN 'this strategy needs user_id or distinct_id'
  WHEN NOT continent_fits THEN 'continent_id is no whole number'
  WHEN n IS NOT NULL AND NOT n_fits THEN 'n is no whole number'
  WHEN NOT price_fits THEN 'price is no whole number' END AS error,
  CASE WHEN n IS NULL THEN 12 WHEN n_fits THEN CAST(CAST(trim(n) AS DOUBLE) AS BIGINT) END AS n
FROM (SELECT *, regexp_matches(trim(n), '^[+-]?[0-9]+([.]0*)?$') AS n_fits, price = floor(price) AS price_fits,
        regexp_matches(trim(continent_id), '^[+-]?[0-9]+([.]0*)?$') AS continent_fits
      FROM ({_BADLY_TYPED.format("raw_requests")}))""",
        "raw_requests",
    ),
)
def _(spark, d):
    """Requests with badly typed fields: refused with the reason, or read with n as a number."""
    D.requests(spark, d).createOrReplaceTempView("stallrec_raw_requests")
    rows = BT.checked(spark.sql(_BADLY_TYPED.format("stallrec_raw_requests")))
    good = BT.with_defaults(rows.filter(F.col("error").isNull())).select("request_id", F.col("n").alias("_n"))
    met = rows.select("request_id", "error", "n").join(good, "request_id", "left")
    # of a refused request n is shown as far as it can be read
    shown = F.coalesce("_n", F.when(F.col("n").isNull(), 12).otherwise(X.whole_number(F.col("n"))))
    return met.select("request_id", "error", shown.cast("bigint").alias("n"))


@register(
    "request_defaults",
    sql.query(
        """SELECT request_id, user_id, distinct_id, continent_id, bike_id, n, strategy, bike_type, family_id, price,
                  frame_size_code, rider_height, category, is_ebike, is_frameset, brand, actor FROM good""",
        "good",
    ),
)
def _(spark, d):
    rows = BT.checked(D.requests(spark, d))
    good = BT.with_defaults(rows.filter(F.col("error").isNull()))
    return good.select(
        "request_id", "user_id", "distinct_id", "continent_id", "bike_id", "n", "strategy", "bike_type", "family_id",
        "price", "frame_size_code", "rider_height", "category", "is_ebike", "is_frameset", "brand", "actor",
    )


_LABEL = "CASE r.strategy " + " ".join(
    f"WHEN '{k}' THEN '{v[1]}'" for k, v in C.STRATEGIES.items()
) + f" ELSE '{C.STRATEGIES[C.FALLBACK_STRATEGY][1]}' END"
_ANSWERS = f"""
, a AS (
  SELECT c.request_id, c.position, c.item_id, NULL AS slug FROM content c JOIN good r USING (request_id)
  WHERE r.strategy NOT IN ('braze', 'homepage', 'rerank', 'bot')
  UNION ALL SELECT c.request_id, c.position, c.item_id, NULL FROM personal c JOIN good r USING (request_id) WHERE r.strategy = 'braze'
  UNION ALL SELECT c.request_id, c.position, c.item_id, NULL FROM personal_10 c JOIN good r USING (request_id) WHERE r.strategy = 'homepage'
  UNION ALL SELECT c.request_id, c.position, c.item_id, NULL FROM reranked c JOIN good r USING (request_id) WHERE r.strategy = 'rerank'
  UNION ALL SELECT c.request_id, c.position, c.item_id, c.slug FROM buyer c JOIN good r USING (request_id) WHERE r.strategy = 'bot'),
s AS (SELECT request_id, count(*) AS size FROM a GROUP BY 1)
SELECT a.request_id, CAST(a.position AS BIGINT) AS position, a.item_id, a.slug,
       CASE WHEN r.strategy = 'product_page' AND s.size <> r.n THEN 'FallbackContentMixed' ELSE {_LABEL} END AS strategy_used
FROM a JOIN s USING (request_id) JOIN good r USING (request_id)"""


@register("batch_answers", sql.query(_ANSWERS, "content", "personal", "personal_10", "reranked", "buyer"))
def _(spark, d):
    rows, _ = BT.answer(D.requests(spark, d), parts(spark, d).store())
    return rows.withColumn("position", F.col("position").cast("bigint"))


@register(
    "batch_errors",
    sql.query(
        """SELECT request_id, error FROM judged WHERE error IS NOT NULL
           UNION ALL SELECT request_id, 'unknown item ' || bike_id FROM good
           WHERE strategy NOT IN ('braze', 'homepage', 'rerank', 'bot') AND bike_id NOT IN (SELECT id FROM items)
           UNION ALL SELECT request_id, 'fewer items left than asked for' FROM good
           WHERE strategy = 'bot' AND request_id NOT IN (SELECT request_id FROM buyer)""",
        "judged", "good", "buyer", "items",
    ),
)
def _(spark, d):
    return BT.answer(D.requests(spark, d), parts(spark, d).store())[1]


@register(
    "second_chance",
    sql.query(
        """SELECT r.request_id FROM good r LEFT JOIN (SELECT request_id, count(*) AS size FROM content GROUP BY 1) s USING (request_id)
           WHERE r.strategy = 'product_page' AND coalesce(s.size, 0) <> r.n""",
        "content",
    ),
)
def _(spark, d):
    p = parts(spark, d)
    return BT.second_chance(p.requests, K.content_mixed(p.requests, p.near, p.quality, p.items))


# ------------------------------------------------------------------ export route


def _export(spark, d):
    ev = D.table(spark, d, "events")
    return D.named_events(spark, d).join(
        ev.select("event_id", "user_id").withColumnRenamed("user_id", "device"), "event_id"
    ).select(
        "event_id",
        "ts",
        F.col("event_type").alias("event"),
        F.struct(
            F.col("anonymous_id").alias("distinct_id"),
            F.struct(
                F.col("item_id").alias("id"),
                F.when(F.col("event_id") % 50 != 0, F.col("item_id") % 7).alias("family_id"),
                (F.col("event_id") % 3).alias("kind"),
            ).alias("bike"),
        ).alias("properties"),
    )


_EXPORT_FEATURES = ["bike.family_id", "bike.kind"]


def _export_ctes(name: str, where: str) -> str:
    return f"""
{name}_w AS (
  SELECT anonymous_id AS distinct_id, item_id AS bike_id, CAST(item_id % 7 AS VARCHAR) AS bike_family_id,
         CAST(event_id % 3 AS VARCHAR) AS bike_kind, {sql.weight('event_type', C.EXPORT_EVENT_WEIGHTS, 'NULL')} AS feedback
  FROM named WHERE event_id % 50 <> 0 AND {sql.in_fraction('event_id', fraction=0.8, seed=1)} AND {where}),
{name}_l AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY distinct_id) AS c FROM {name}_w) WHERE c <= 55),
{name} AS (
  SELECT g.*, f.bike_family_id, k.bike_kind FROM (
    SELECT distinct_id, bike_id, CAST(sum(feedback) AS DOUBLE) AS feedback FROM {name}_l GROUP BY 1, 2) g
  JOIN (SELECT * FROM (SELECT distinct_id, bike_id, bike_family_id, row_number() OVER (PARTITION BY distinct_id, bike_id
          ORDER BY count(*) DESC, bike_family_id) AS rn FROM {name}_l GROUP BY 1, 2, 3) WHERE rn = 1) f USING (distinct_id, bike_id)
  JOIN (SELECT * FROM (SELECT distinct_id, bike_id, bike_kind, row_number() OVER (PARTITION BY distinct_id, bike_id
          ORDER BY count(*) DESC, bike_kind) AS rn FROM {name}_l GROUP BY 1, 2, 3) WHERE rn = 1) k USING (distinct_id, bike_id))"""


@register(
    "export_interactions",
    sql.query("," + _export_ctes("x", "true") + "\nSELECT distinct_id, bike_id, feedback, bike_family_id, bike_kind FROM x", "named"),
)
def _(spark, d):
    rows = E.export_interactions(
        _export(spark, d), "distinct_id", "bike.id", _EXPORT_FEATURES, key="event_id", limit=55
    )
    return doubles(rows)


@register(
    "export_periods_merged",
    sql.query(
        ","
        + _export_ctes("x", "ts < TIMESTAMP '2024-01-16'")
        + ","
        + _export_ctes("y", "ts >= TIMESTAMP '2024-01-16'")
        + """,
m AS (SELECT distinct_id, bike_id, feedback, bike_family_id, bike_kind FROM x
      UNION ALL SELECT distinct_id, bike_id, feedback, bike_family_id, bike_kind FROM y)
SELECT distinct_id, bike_id, round(sum(feedback), 4) AS feedback, min(bike_family_id) AS bike_family_id, min(bike_kind) AS bike_kind
FROM m GROUP BY 1, 2""",
        "named",
    ),
)
def _(spark, d):
    raw = _export(spark, d)
    edge = F.lit("2024-01-16").cast("timestamp")
    first, second = (
        E.export_interactions(part, "distinct_id", "bike.id", _EXPORT_FEATURES, key="event_id", limit=55)
        for part in (raw.filter(F.col("ts") < edge), raw.filter(F.col("ts") >= edge))
    )
    return doubles(E.merged(first, second, "distinct_id", "bike_id", ["bike_family_id", "bike_kind"]))


@register(
    "users_within_limit",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, count FROM (
         SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS count FROM lineitem) WHERE count <= 600""",
)
def _(spark, d):
    rows = D.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return E.within_limit(rows, "l_suppkey", 600)
