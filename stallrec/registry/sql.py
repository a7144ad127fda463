"""The oracle: every query once more, as SQL over the driver's tables.

Written from the definitions, not from the Spark plans: where the plans avoid pairs,
windows or scans, the SQL states the plain meaning.
"""

from __future__ import annotations

from stallrec import config as C
from stallrec.sources.standins import EVENT_NAMES, LETTERS

NAMES = "[" + ",".join(f"'{n}'" for n in EVENT_NAMES) + "]"


def hexid(text: str, digits: int) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def pick(values, index: str) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + f"][CAST({index} AS BIGINT) + 1]"


def size_text(s: str) -> str:
    return (
        f"CASE WHEN {s} % 5 = 0 THEN {pick(LETTERS, f'({s} // 5) % 5')} "
        f"WHEN {s} % 5 = 1 THEN CAST(44 + {s} % 20 AS VARCHAR) || ',5' "
        f"ELSE CAST(44 + {s} % 20 AS VARCHAR) END"
    )


def size_number(t: str, default: str = "NULL") -> str:
    letters = " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.LETTER_SIZES.items())
    return (
        f"COALESCE(TRY_CAST(replace(upper(trim({t})), ',', '.') AS DOUBLE), "
        f"CASE upper(trim({t})) {letters} END, CAST({default} AS DOUBLE))"
    )


def order_of(*parts: str, seed: int = 0) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + f", '{seed}'))"


def in_fraction(*parts: str, fraction: float, seed: int) -> str:
    return f"CAST('0x' || substr({order_of(*parts, seed=seed)}, 1, 8) AS BIGINT) < {int(round(fraction * 2**32))}"


def weight(event: str, table=C.EVENT_WEIGHTS, rest: str = "0") -> str:
    rows = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CAST(CASE {event} {rows} ELSE {rest} END AS DECIMAL(10,4))"


def decay(ts: str, as_of: str) -> str:
    rows = " ".join(
        f"WHEN {ts} >= DATE '{as_of}' - INTERVAL {n} {unit} THEN {f}" for unit, n, f in C.DECAY_STEPS
    )
    return f"CAST(CASE {rows} ELSE {C.DECAY_REST} END AS DECIMAL(6,4))"


def lookback(event: str, ts: str, as_of: str) -> str:
    rows = " ".join(f"WHEN '{k}' THEN DATE '{as_of}' - INTERVAL {m} months" for k, m in C.EVENT_MONTHS.items())
    return f"{ts} >= CASE {event} {rows} ELSE DATE '{as_of}' - INTERVAL {C.DEFAULT_MONTHS} months END"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


CATALOG_NOW = "TIMESTAMP '2001-11-06'"

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, *needs: str, sql: str) -> None:
    CTE[name] = (needs, sql)


def query(body: str, *needs: str) -> str:
    """``body`` behind the named CTEs and all they need, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for n in CTE[name][0]:
            add(n)
        done.append(name)

    for n in needs:
        add(n)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in done) + "\n" + body


# ------------------------------------------------------------------ catalog

cte(
    "lines",
    sql="""
SELECT l_partkey, count(*) AS n_lines,
       sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS n_open,
       sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_back,
       max(l_shipdate) AS updated_at, min(l_suppkey) AS l_suppkey,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM lineitem GROUP BY l_partkey""",
)
cte(
    "listings",
    "lines",
    sql=f"""
SELECT p_partkey AS id, p_partkey // 2 AS bike_template_id,
       CASE WHEN 2 * n_open >= n_lines THEN 'active' WHEN 3 * n_back >= n_lines THEN 'inactive' ELSE 'sold' END AS status,
       CAST(1 + p_size % 3 AS BIGINT) AS bike_type_id,
       {hexid('p_type', 3)} + 1 AS bike_category_id,
       CAST(CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 <= 2 THEN 1 ELSE 0 END AS BIGINT) AS motor,
       CAST(floor(p_retailprice * p_size / 10) AS DOUBLE) AS price,
       'brake' || (p_partkey % 3) AS brake_type_code, 'mat' || (p_partkey % 4) AS frame_material_code,
       'shift' || (p_partkey % 2) AS shifting_code, 2005 + p_partkey % 20 AS year,
       1 + p_partkey % 10 AS bike_component_id, split_part(p_name, ' ', 1) AS color,
       {hexid('p_name', 4)} AS family_id, s_nationkey AS country_id,
       CAST(substr(p_brand, 7) AS BIGINT) AS brand_id, 'listing-' || p_partkey AS slug, updated_at
FROM part JOIN lines ON p_partkey = l_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""",
)
cte(
    "infos",
    sql=f"""
SELECT p_partkey AS bike_id, {size_text('p_size')} AS frame_size,
       CAST(CASE WHEN p_size % 11 <> 0 THEN 150 + 5 * (p_size % 6) END AS DOUBLE) AS rider_height_min,
       CAST(150 + 5 * (p_size % 6) + 10 + p_size % 15 AS DOUBLE) AS rider_height_max
FROM part""",
)
cte(
    "templates",
    sql="""
SELECT t + 5 AS id, t AS bike_template_id,
       CASE WHEN t % 4 = 1 THEN 'full' WHEN t % 4 > 1 THEN 'front' END AS suspension,
       CASE WHEN t % 5 = 0 THEN 1 WHEN t % 5 > 1 THEN 0 END AS is_ebike,
       CASE WHEN t % 6 = 0 THEN 1 WHEN t % 6 > 1 THEN 0 END AS is_frameset
FROM (SELECT DISTINCT p_partkey // 2 AS t FROM part)""",
)
cte(
    "countries",
    sql="""
SELECT n_nationkey AS id,
       CAST(CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 2 ELSE 3 END AS BIGINT) AS continent_id
FROM nation WHERE n_nationkey <> 24""",
)
cte("scores", "lines", sql="SELECT l_partkey AS bike_id, qty % 101 AS score FROM lines")
cte(
    "brands",
    sql="SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, lower(replace(p_brand, '#', '-')) AS slug FROM part",
)
cte(
    "categories",
    sql=f"""SELECT DISTINCT {hexid('p_type', 3)} + 1 AS id, lower(p_type) AS slug,
       upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS name FROM part""",
)
cte(
    "catalog",
    "listings", "infos", "templates", "countries", "scores", "brands",
    sql=f"""
SELECT l.id, l.bike_template_id AS template_id, s.score AS quality_score, l.status, l.bike_type_id AS bike_type,
       l.bike_category_id, l.motor, c.continent_id, i.frame_size AS frame_size_code, l.price, l.brake_type_code,
       l.frame_material_code, l.shifting_code, l.year, l.bike_component_id, l.color,
       coalesce(t.suspension, 'NULL') AS suspension, l.family_id, b.slug AS brand
FROM listings l JOIN infos i ON l.id = i.bike_id
LEFT JOIN templates t ON l.bike_template_id = t.id
LEFT JOIN countries c ON l.country_id = c.id
JOIN scores s ON l.id = s.bike_id JOIN brands b ON l.brand_id = b.id
WHERE l.status = 'active'
   OR l.status NOT IN {in_list(C.HIDDEN_STATUSES)}
      AND date_diff('second', l.updated_at, {CATALOG_NOW}) // 604800 <= {C.MAX_IDLE_WEEKS}
      AND l.bike_template_id <> {C.EXCLUDED_TEMPLATE} AND s.score > {C.MIN_SCORE}""",
)
cte(
    "items",
    "catalog",
    sql=f"""
SELECT * REPLACE (CAST(coalesce(motor, (SELECT median(motor) FROM catalog)) AS DOUBLE) AS motor,
                  {size_number('frame_size_code')} AS frame_size_code)
FROM catalog WHERE continent_id IS NOT NULL AND {size_number('frame_size_code')} IS NOT NULL""",
)
cte("active", "items", sql="SELECT * FROM items WHERE status = 'active'")
cte(
    "quality",
    "listings", "infos", "templates", "scores", "brands", "categories",
    sql=f"""
SELECT id, price, {size_number('frame_size_code')} AS frame_size_code, family_id, bike_type, slug, category,
       bike_category_id, CAST(rider_height_min AS BIGINT) AS rider_height_min,
       CAST(rider_height_max AS BIGINT) AS rider_height_max, quality_score, is_ebike, is_frameset, brand,
       row_number() OVER (ORDER BY quality_score DESC, id) AS quality_rank
FROM (
  SELECT l.id, l.price, i.frame_size AS frame_size_code, l.family_id, l.bike_type_id AS bike_type, l.slug,
         c.slug AS category, l.bike_category_id, i.rider_height_min, i.rider_height_max,
         max(s.score) AS quality_score, CAST(max(coalesce(t.is_ebike, 0)) AS BIGINT) AS is_ebike,
         CAST(max(coalesce(t.is_frameset, 0)) AS BIGINT) AS is_frameset, min(b.slug) AS brand
  FROM listings l JOIN scores s ON l.id = s.bike_id JOIN categories c ON l.bike_category_id = c.id
  JOIN infos i ON l.id = i.bike_id JOIN templates t ON l.bike_template_id = t.bike_template_id
  JOIN brands b ON l.brand_id = b.id
  WHERE l.status = 'active' GROUP BY ALL)
WHERE rider_height_min IS NOT NULL AND {size_number('frame_size_code')} IS NOT NULL""",
)

# ------------------------------------------------------------------ events

cte(
    "named",
    sql=f"""
SELECT event_id, {NAMES}[event_id % {len(EVENT_NAMES)} + 1] AS event_type, 'a' || user_id AS anonymous_id,
       CASE WHEN event_type = 'signup' THEN 'u' || (user_id // 2) END AS user_id,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts
FROM events""",
)
cte(
    "feeds",
    "named",
    sql="""
SELECT event_type, anonymous_id, user_id, item_id, ts FROM named WHERE event_type <> 'show_recommendation'
UNION ALL
SELECT event_type, anonymous_id, user_id, x AS item_id, ts
FROM (SELECT *, unnest([item_id, (item_id + 7) % 100]) AS x FROM named WHERE event_type = 'show_recommendation')""",
)
cte(
    "ordered",
    sql=f"""
SELECT {NAMES}[(CAST(l_quantity AS BIGINT) + l_linenumber) % {len(EVENT_NAMES)} + 1] AS event_type,
       'c' || o_custkey AS anonymous_id, CASE WHEN l_returnflag = 'R' THEN 'u' || o_custkey END AS user_id,
       l_partkey AS item_id, l_shipdate AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)


def feedback_ctes(prefix: str, source: str, as_of: str) -> None:
    cte(
        f"{prefix}_pairs",
        source,
        sql=f"""
SELECT anonymous_id, item_id, CAST(sum({weight('event_type')} * {decay('ts', as_of)}) AS DECIMAL(18,4)) AS feedback
FROM {source} WHERE {lookback('event_type', 'ts', as_of)}
GROUP BY anonymous_id, item_id HAVING feedback > 1""",
    )
    cte(
        f"{prefix}_actors",
        f"{prefix}_pairs",
        sql=f"""
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY anonymous_id) AS anonymous_id_cnt FROM {prefix}_pairs)
WHERE anonymous_id_cnt BETWEEN {C.MIN_ITEMS_PER_ACTOR} AND {C.MAX_ITEMS_PER_ACTOR}""",
    )
    cte(
        f"{prefix}_map",
        source,
        sql=f"SELECT DISTINCT anonymous_id, coalesce(user_id, anonymous_id) AS user_id FROM {source}",
    )
    cte(
        f"{prefix}_interactions",
        f"{prefix}_actors", f"{prefix}_map", "listings", "infos",
        sql=f"""
SELECT m.user_id, f.item_id AS bike_id, min(floor(l.price / 200) * 200) AS price, min(l.bike_type_id) AS bike_type_id,
       min(l.bike_category_id) AS bike_category_id, min(l.family_id) AS family_id,
       min(floor(i.rider_height_min / 10) * 10) AS rider_height_min,
       min(floor(i.rider_height_max / 10) * 10) AS rider_height_max, CAST(sum(f.feedback) AS DOUBLE) AS feedback
FROM {prefix}_actors f LEFT JOIN {prefix}_map m ON f.anonymous_id = m.anonymous_id
JOIN listings l ON f.item_id = l.id JOIN infos i ON f.item_id = i.bike_id
GROUP BY m.user_id, f.item_id""",
    )


feedback_ctes("ev", "feeds", "2024-01-31")
feedback_ctes("od", "ordered", "2001-11-06")

# ------------------------------------------------------------------ preferences

cte(
    "answers",
    sql=f"""
SELECT c_custkey AS user_id,
       '{{' || concat_ws(',',
         CASE WHEN c_custkey % 3 <> 0 THEN '"max_price":' || (300 + (c_custkey * 37) % 4000) END,
         CASE WHEN c_custkey % 4 <> 0 THEN '"categories":["' || lower(p_type) ||
              CASE WHEN c_custkey % 4 = 1 THEN '","PROMO' ELSE '' END || '"]' END,
         CASE WHEN c_custkey % 5 <> 0 THEN '"frame_sizes":[' ||
              CASE WHEN c_custkey % 5 = 1 THEN '"' || {size_text('p_size')} || '","L"'
                   WHEN c_custkey % 5 = 2 THEN '' ELSE '"' || {size_text('p_size')} || '"' END || ']' END) || '}}'
       AS preferences
FROM customer JOIN part ON c_custkey = p_partkey WHERE c_custkey % 2 = 1""",
)
cte(
    "stated",
    "answers", "categories",
    sql="""
SELECT a.user_id, coalesce(CAST(json_extract_string(preferences, '$.max_price') AS BIGINT), 20000) AS max_price,
       coalesce(c.id, 0) AS category_id, coalesce(z.s, 'none') AS frame_size
FROM answers a
LEFT JOIN (SELECT user_id, unnest(from_json(json_extract(preferences, '$.categories'), '["VARCHAR"]')) AS g FROM answers) g
  ON a.user_id = g.user_id
LEFT JOIN (SELECT user_id, unnest(from_json(json_extract(preferences, '$.frame_sizes'), '["VARCHAR"]')) AS s FROM answers) z
  ON a.user_id = z.user_id
LEFT JOIN categories c ON lower(g.g) = lower(c.name)""",
)
cte(
    "wishes",
    "stated",
    sql=f"""SELECT DISTINCT user_id, CAST(max_price AS DOUBLE) AS max_price, category_id,
       {size_number('frame_size', '1')} AS size FROM stated""",
)

# ------------------------------------------------------------------ requests

STRATEGY_CYCLE = ("product_page", "braze", "homepage", "rerank", "FallbackContentMixed", "bot", "valentine")
cte(
    "raw_requests",
    sql=f"""
SELECT c_custkey AS request_id, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'x1' END AS user_id,
       CASE WHEN c_custkey % 12 <> 0 THEN 'd' || c_custkey END AS distinct_id,
       CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 7 WHEN 3 THEN 2 ELSE 1 END AS continent_id,
       CASE WHEN c_custkey % 35 <> 0 THEN c_custkey END AS bike_id,
       CASE WHEN c_custkey % 7 = 3 THEN [c_custkey, c_custkey + 3, c_custkey + 1, c_custkey, c_custkey % 50,
                                         c_custkey % 20, 188941086120] END AS bike_rerank_id,
       CASE WHEN c_custkey % 5 <> 0 THEN 8 + 4 * (c_custkey % 4) END AS n,
       CASE WHEN c_custkey % 40 <> 0 THEN {pick(STRATEGY_CYCLE, 'c_custkey % 7')} END AS strategy,
       CASE WHEN c_custkey % 9 <> 0 THEN CAST(1 + p_size % 3 AS VARCHAR) ELSE 'n/a' END AS bike_type,
       {hexid('p_name', 4)} AS family_id, CAST(floor(p_retailprice * p_size / 10) AS BIGINT) AS price,
       {size_text('p_size')} AS frame_size_code, 150 + 5 * (p_size % 6) + 8 AS rider_height, lower(p_type) AS category,
       CAST(c_custkey % 5 = 0 AS BIGINT) AS is_ebike, CAST(c_custkey % 6 = 0 AS BIGINT) AS is_frameset,
       CASE WHEN c_custkey % 3 = 0 THEN lower(replace(p_brand, '#', '-')) ELSE 'null' END AS brand
FROM customer JOIN part ON c_custkey = p_partkey JOIN nation ON c_nationkey = n_nationkey""",
)
cte(
    "judged",
    "raw_requests",
    sql="""
SELECT *, CASE
  WHEN strategy = 'rerank' AND bike_rerank_id IS NULL THEN 'a rerank request needs bike_rerank_id'
  WHEN strategy = 'product_page' AND (bike_id IS NULL OR bike_id = 0) THEN 'a product page request needs bike_id'
  WHEN strategy IN ('homepage', 'braze', 'rerank') AND (user_id IS NULL OR user_id = '0')
       AND (distinct_id IS NULL OR distinct_id = 'NA')
       THEN 'this strategy needs user_id or distinct_id' END AS error
FROM raw_requests""",
)
cte(
    "good",
    "judged",
    sql=f"""
SELECT request_id, coalesce(TRY_CAST(user_id AS BIGINT), 0) AS user_id, coalesce(distinct_id, 'NA') AS distinct_id,
       CAST(continent_id AS BIGINT) AS continent_id, coalesce(bike_id, 0) AS bike_id, bike_rerank_id,
       CAST(coalesce(n, 12) AS BIGINT) AS n, coalesce(strategy, 'product_page') AS strategy,
       coalesce(TRY_CAST(bike_type AS BIGINT), 1) AS bike_type, family_id, price,
       {size_number('frame_size_code', '56')} AS frame_size_code, rider_height, category, is_ebike, is_frameset, brand,
       CASE WHEN coalesce(TRY_CAST(user_id AS BIGINT), 0) = 0 THEN coalesce(distinct_id, 'NA')
            ELSE CAST(TRY_CAST(user_id AS BIGINT) AS VARCHAR) END AS actor
FROM judged WHERE error IS NULL""",
)
cte(
    "user_mask",
    "good", "wishes", "items",
    sql="""
SELECT DISTINCT r.request_id, i.id AS item_id
FROM good r JOIN wishes p ON p.user_id = r.user_id AND r.user_id <> 0
JOIN items i ON i.price <= p.max_price
 AND (r.strategy = 'product_page' OR p.category_id = 0 OR i.bike_category_id = p.category_id)
 AND (p.size = 1 OR i.frame_size_code BETWEEN p.size - 3 AND p.size + 3)""",
)
cte(
    "allowed",
    "good", "items", "user_mask",
    sql="""
SELECT r.request_id, i.id AS item_id
FROM good r JOIN items i ON i.continent_id = r.continent_id
  OR (r.continent_id IN (4, 7) AND i.continent_id = 1 AND i.motor = 0)
LEFT JOIN (SELECT DISTINCT request_id FROM user_mask) h ON h.request_id = r.request_id
LEFT JOIN user_mask u ON u.request_id = r.request_id AND u.item_id = i.id
WHERE h.request_id IS NULL OR u.item_id IS NOT NULL""",
)

# ------------------------------------------------------------------ neighbors

_heavy = " + ".join(
    f"CASE WHEN a.{c} = b.{c} THEN 0 ELSE {800 if c in C.HEAVY_CATEGORIES else 2} END" for c in C.CATEGORICAL_FEATURES
)
_gaps = " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in C.NUMERICAL_FEATURES)
cte(
    "feats",
    "items",
    sql="SELECT id, status, "
    + ", ".join(C.CATEGORICAL_FEATURES)
    + ", "
    + ", ".join(
        f"{C.HEAVY_NUMBER_FACTOR if c in C.HEAVY_NUMBERS else 1.0}::DOUBLE * (({c}::DOUBLE - (SELECT min({c})::DOUBLE FROM items)) / "
        f"((SELECT max({c})::DOUBLE FROM items) - (SELECT min({c})::DOUBLE FROM items))) AS z_{c}"
        for c in C.NUMERICAL_FEATURES
    )
    + " FROM items",
)


PLACE = """CASE WHEN neighbor_id <> item_id THEN CAST(row_number() OVER (PARTITION BY item_id ORDER BY
  neighbor_id = item_id, CASE WHEN distance = 0 THEN CAST('inf' AS DOUBLE) ELSE distance END, neighbor_id) AS INTEGER) END"""


DISTANCE = f"sqrt(CAST({_heavy} AS DOUBLE) + {_gaps})"


def neighbors_sql(limit: str, distance: str | None = None) -> str:
    d = distance or DISTANCE
    return f"""
SELECT item_id, neighbor_id, distance, CAST(rank AS INTEGER) AS rank, {PLACE} AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, neighbor_id) AS rank
  FROM (SELECT a.id AS item_id, b.id AS neighbor_id, round({d}, 6) AS distance
        FROM feats a JOIN feats b ON b.status = 'active'))
WHERE rank <= {limit}"""


PERCENT_10 = "greatest((SELECT count(*) FROM items) // 10, 1)"
cte("neighbors", "feats", sql=neighbors_sql(PERCENT_10))
cte(
    "near",
    "neighbors", "good",
    sql="""
SELECT r.request_id, r.bike_id, k.neighbor_id AS item_id,
       CASE WHEN distance = 0 THEN CAST('inf' AS DOUBLE) ELSE distance END AS distance,
       row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN distance = 0 THEN CAST('inf' AS DOUBLE) ELSE distance END,
                          k.neighbor_id) AS position
FROM good r JOIN neighbors k ON r.bike_id = k.item_id WHERE k.neighbor_id <> r.bike_id""",
)

# ------------------------------------------------------------------ strategies

cte(
    "lookalikes",
    "near", "good", "allowed",
    sql="""
WITH m AS (
  SELECT k.request_id, k.item_id, r.n, row_number() OVER (PARTITION BY k.request_id ORDER BY k.position) AS position
  FROM near k JOIN good r USING (request_id) JOIN allowed a USING (request_id, item_id) WHERE k.position <= 10 * r.n + 1),
s AS (SELECT r.request_id, count(m.item_id) AS size FROM good r LEFT JOIN m USING (request_id) GROUP BY 1)
SELECT m.request_id, m.position, m.item_id FROM m JOIN s USING (request_id) WHERE s.size >= m.n AND m.position <= m.n
UNION ALL
SELECT k.request_id, k.position, k.item_id FROM near k JOIN good r USING (request_id) JOIN s USING (request_id)
WHERE s.size < r.n AND k.position <= r.n + 1""",
)


cte(
    "all_pairs",
    "feats",
    sql=f"SELECT a.id AS item_id, b.id AS neighbor_id, round({DISTANCE}, 6) AS distance FROM feats a JOIN feats b ON b.status = 'active'",
)


def prefiltered_sql(size: str, match: str = "OR") -> str:
    test = f" {match} ".join(f"o.{f} = i.{f}" for f in C.PREFILTER_FEATURES)
    return f"""
WITH m AS (
  SELECT r.request_id, r.bike_id, k.neighbor_id AS item_id, CAST(floor({size}) AS BIGINT) AS n,
         CASE WHEN k.distance = 0 THEN CAST('inf' AS DOUBLE) ELSE k.distance END AS distance,
         count(*) OVER (PARTITION BY r.request_id) AS matched
  FROM good r JOIN items o ON o.id = r.bike_id JOIN all_pairs k ON k.item_id = r.bike_id
  JOIN items i ON i.id = k.neighbor_id WHERE {test}),
t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, item_id) AS place
      FROM m WHERE matched > 1 AND item_id <> bike_id),
p AS (SELECT t.*, row_number() OVER (PARTITION BY request_id ORDER BY place) AS position
      FROM t JOIN allowed USING (request_id, item_id) WHERE place <= 10 * n)
SELECT request_id, position, item_id FROM p WHERE position <= n"""


for _name, _size, _match in (
    ("special", "r.n", "OR"),
    ("special_75", "r.n * CAST(0.75 AS DOUBLE)", "OR"),
    ("special_90", "r.n * CAST(0.9 AS DOUBLE)", "OR"),
    ("special_all", "r.n", "AND"),
):
    cte(_name, "good", "items", "all_pairs", "allowed", sql=prefiltered_sql(_size, _match))

cte(
    "relaxed_base",
    "good", "quality", "allowed",
    sql="""
SELECT r.request_id, q.id AS item_id, q.quality_rank,
       CASE WHEN a.item_id IS NULL OR q.bike_type <> r.bike_type THEN 0
            WHEN NOT (q.price >= r.price * 0.8::DOUBLE AND q.price <= r.price * 1.2::DOUBLE) THEN 1
            WHEN q.frame_size_code <> r.frame_size_code THEN 2
            WHEN q.family_id <> r.family_id THEN 3 ELSE 4 END AS depth
FROM good r CROSS JOIN quality q LEFT JOIN allowed a ON a.request_id = r.request_id AND a.item_id = q.id""",
)


def relaxed_sql(size: str) -> str:
    return f"""
WITH c AS (
  SELECT request_id, rung, count(*) AS size FROM relaxed_base, (SELECT unnest([1, 2, 3, 4]) AS rung) WHERE depth >= rung
  GROUP BY 1, 2),
g AS (SELECT r.request_id, r.n, coalesce(max(c.rung), 0) AS rung FROM good r
      LEFT JOIN c ON c.request_id = r.request_id AND c.size >= {size} GROUP BY 1, 2),
p AS (SELECT b.request_id, b.item_id, g.rung, {size} AS size,
             row_number() OVER (PARTITION BY b.request_id ORDER BY b.quality_rank) AS position
      FROM relaxed_base b JOIN g ON g.request_id = b.request_id AND b.depth >= g.rung JOIN good r ON r.request_id = b.request_id)
SELECT request_id, position, item_id, CAST(rung AS BIGINT) AS rung FROM p WHERE position <= size"""


cte("relaxed", "relaxed_base", sql=relaxed_sql("r.n"))
cte("relaxed_100", "relaxed_base", sql=relaxed_sql("100"))
cte(
    "sampled_quality",
    "relaxed_100", "good",
    sql=f"""
SELECT request_id, position, item_id FROM (
  SELECT t.request_id, t.item_id, r.n, count(*) OVER (PARTITION BY t.request_id) AS size,
         row_number() OVER (PARTITION BY t.request_id ORDER BY {order_of('t.request_id', 't.item_id')}, t.item_id) AS position
  FROM relaxed_100 t JOIN good r USING (request_id))
WHERE size >= n AND position <= n""",
)


def mixed_sql(special: str, order: str) -> str:
    return f"""
WITH u AS (
  SELECT request_id, position, item_id, 0 AS source FROM {special}
  UNION ALL SELECT request_id, position, item_id, 1 FROM lookalikes),
f AS (SELECT *, row_number() OVER (PARTITION BY request_id, item_id ORDER BY {order}) AS seen FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {order}) AS place FROM f WHERE seen = 1)
SELECT k.request_id, k.place AS position, k.item_id FROM k JOIN good r USING (request_id)
WHERE k.place <= r.n AND r.bike_id IN (SELECT id FROM items)
UNION ALL
SELECT s.request_id, s.position, s.item_id FROM sampled_quality s JOIN good r USING (request_id)
WHERE r.bike_id NOT IN (SELECT id FROM items)"""


cte(
    "family",
    "good", "items", "quality", "allowed", "near",
    sql="""
WITH known AS (SELECT * FROM good WHERE bike_id IN (SELECT id FROM items)),
f AS (SELECT r.request_id, q.id AS item_id, row_number() OVER (PARTITION BY r.request_id ORDER BY q.quality_rank) AS position, r.n
      FROM known r JOIN quality q ON q.family_id = r.family_id AND q.id <> r.bike_id
      JOIN allowed a ON a.request_id = r.request_id AND a.item_id = q.id),
ft AS (SELECT * FROM f WHERE position <= n),
fc AS (SELECT r.request_id, count(ft.item_id) AS family_count FROM known r LEFT JOIN ft USING (request_id) GROUP BY 1),
s AS (SELECT k.request_id, k.item_id, k.position FROM near k JOIN known r USING (request_id) JOIN fc USING (request_id)
      JOIN allowed a ON a.request_id = k.request_id AND a.item_id = k.item_id
      WHERE k.position <= 3 * r.n AND family_count < r.n
        AND NOT EXISTS (SELECT 1 FROM ft WHERE ft.request_id = k.request_id AND ft.item_id = k.item_id)),
u AS (SELECT request_id, item_id, 0 AS o, position FROM ft UNION ALL SELECT request_id, item_id, 1, position FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY o, position) AS place FROM u)
SELECT p.request_id, p.place AS position, p.item_id, CASE WHEN o = 0 THEN 'family' ELSE 'similar' END AS source,
       fc.family_count
FROM p JOIN fc USING (request_id) JOIN known r USING (request_id) WHERE p.place <= r.n""",
)
cte(
    "content",
    "family", "good", "quality",
    sql="""
SELECT f.request_id, row_number() OVER (PARTITION BY f.request_id ORDER BY
         CASE WHEN w.wanted IS NULL OR coalesce(q.brand = w.wanted, false) THEN 0 ELSE 1 END, f.position) AS position,
       f.item_id, f.source, f.family_count
FROM family f
JOIN (SELECT r.request_id, coalesce(nullif(nullif(r.brand, 'null'), ''), o.brand) AS wanted
      FROM good r LEFT JOIN quality o ON o.id = r.bike_id) w USING (request_id)
LEFT JOIN quality q ON q.id = f.item_id""",
)

BUYER = (
    "q.category = r.category",
    "q.rider_height_max >= r.rider_height",
    "q.rider_height_min <= r.rider_height",
    "(q.price >= r.price * 0.8::DOUBLE AND q.price <= r.price * 1.2::DOUBLE)",
    "q.is_ebike = r.is_ebike",
    "q.is_frameset = r.is_frameset",
    "(r.brand = 'null' OR q.brand = r.brand)",
)


def progressive_sql(tests, columns: str) -> str:
    depth = "CASE " + " ".join(f"WHEN NOT ({t}) THEN {i}" for i, t in enumerate(tests)) + f" ELSE {len(tests)} END" if tests else "0"
    steps = ", ".join(str(i) for i in range(len(tests) + 1))
    return f"""
WITH mc AS (SELECT r.request_id, r.n, count(q.id) AS masked FROM good r LEFT JOIN allowed a USING (request_id)
            LEFT JOIN quality q ON q.id = a.item_id GROUP BY 1, 2),
b AS (SELECT r.request_id, r.n, q.id AS item_id, q.quality_rank, {depth} AS depth
      FROM good r JOIN mc USING (request_id) CROSS JOIN quality q
      LEFT JOIN allowed a ON a.request_id = r.request_id AND a.item_id = q.id
      WHERE mc.masked < r.n OR (a.item_id IS NOT NULL AND {in_fraction('q.id', fraction=0.5, seed=0)})),
c AS (SELECT request_id, n, s.step, count(*) AS size FROM b, (SELECT unnest([{steps}]) AS step) s WHERE depth >= s.step GROUP BY 1, 2, 3),
g AS (SELECT request_id, n, max(step) AS step FROM c WHERE step = 0 OR size >= 2 * n GROUP BY 1, 2),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.request_id ORDER BY quality_rank) AS place FROM b JOIN g USING (request_id)
      WHERE b.depth >= g.step),
d AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS kept,
             row_number() OVER (PARTITION BY request_id ORDER BY {order_of('request_id', 'item_id')}, item_id) AS position
      FROM t WHERE place <= 2 * n)
SELECT {columns} FROM d JOIN quality q ON q.id = d.item_id WHERE d.kept >= d.n AND d.position <= d.n"""


cte("buyer", "good", "allowed", "quality", sql=progressive_sql(BUYER, "d.request_id, d.position, d.item_id, q.slug"))
cte("plain_quality", "good", "allowed", "quality", sql=progressive_sql((), "d.request_id, d.position, d.item_id"))

# ------------------------------------------------------------------ factors

cte(
    "vectors",
    sql="SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings",
)
cte(
    "user_scores",
    "vectors", "good", "allowed", "active",
    sql="""
SELECT r.request_id, r.n, i.vec_id AS item_id, round(list_dot_product(u.vector, i.vector), 6) AS score
FROM good r JOIN vectors u ON r.actor = CAST(u.vec_id AS VARCHAR) CROSS JOIN vectors i
JOIN allowed a ON a.request_id = r.request_id AND a.item_id = i.vec_id
WHERE i.vec_id IN (SELECT id FROM active)""",
)


def collaborative_sql(widen: int) -> str:
    return f"""
SELECT request_id, position, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {order_of('request_id', 'item_id')}, item_id) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS place FROM user_scores)
  WHERE place <= {widen} * n)
WHERE position <= n"""


cte("personal", "user_scores", sql=collaborative_sql(1))
cte("personal_10", "user_scores", sql=collaborative_sql(10))
cte(
    "reranked",
    "good", "vectors",
    sql="""
WITH l AS (SELECT request_id, actor, unnest(bike_rerank_id) AS item_id, generate_subscripts(bike_rerank_id, 1) AS given
           FROM good WHERE bike_rerank_id IS NOT NULL),
s AS (SELECT l.*, round(list_dot_product(u.vector, i.vector), 6) AS score FROM l
      LEFT JOIN vectors u ON l.actor = CAST(u.vec_id AS VARCHAR) LEFT JOIN vectors i ON i.vec_id = l.item_id)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST,
         CASE WHEN score IS NOT NULL THEN item_id END NULLS LAST, given) AS position, item_id FROM s""",
)
cte(
    "user_items",
    sql="""SELECT DISTINCT CAST(user_id AS VARCHAR) AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events""",
)
cte(
    "pairs",
    "user_items",
    sql=f"SELECT u, item_id, {in_fraction('u', 'item_id', fraction=0.05, seed=3)} AS held FROM user_items",
)
cte(
    "all_scores",
    "vectors", "pairs",
    sql="""
SELECT p.u, i.vec_id AS item_id, round(list_dot_product(v.vector, i.vector), 6) AS score
FROM (SELECT DISTINCT u FROM pairs) p JOIN vectors v ON p.u = CAST(v.vec_id AS VARCHAR) CROSS JOIN vectors i""",
)
cte(
    "od_split",
    "od_interactions",
    sql=f"""SELECT CAST(user_id AS VARCHAR) AS user_id, bike_id, {in_fraction('user_id', 'bike_id', fraction=0.05, seed=3)} AS held
FROM od_interactions WHERE COLUMNS(*) IS NOT NULL""",
)
cte(
    "popular",
    "od_split",
    sql="""
WITH pop AS (SELECT bike_id, row_number() OVER (ORDER BY count(*) DESC, bike_id) - 1 AS place FROM od_split WHERE NOT held GROUP BY bike_id),
s AS (SELECT user_id, held, place FROM od_split JOIN pop USING (bike_id)
      WHERE user_id IN (SELECT user_id FROM od_split WHERE held)),
p AS (SELECT *, coalesce(sum(CASE WHEN held THEN 0 ELSE 1 END) OVER
        (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skipped FROM s)
SELECT user_id, sum(CASE WHEN held AND place - skipped < 100 THEN 1 ELSE 0 END)::DOUBLE AS hits
FROM p GROUP BY user_id HAVING bool_or(held)""",
)
