"""Fixed values and defaults shared by the operators."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# They must equal the agreed ones for right results.
# ---------------------------------------------------------------------------

# Feedback weight per event, as used by the warehouse aggregation. Unknown -> 0.
EVENT_WEIGHTS = {
    "product_viewed": 1,
    "product_added": 2,
    "choose_service": 5,
    "add_discount": 10,
    "payment_info_entered": 20,
    "choose_shipping_method": 20,
    "add_to_favorite": 10,
    "ask_question": 10,
    "checkout_step_completed": 12,
    "comment_show_original": 3,
    "counter_offer": 10,
    "bike_matcher_favorite": 30,
    "bike_matcher_dislike": -30,
    "delete_from_favourites": -5,
    "order_completed": 50,
    "recom_bike_view": 5,
    "request_leasing": 20,
    "share_bike": 10,
    "show_recommendation": 0,
    "engaged_bike": 1,
}

# The export route uses its own table; it differs in three entries. Unknown -> null.
EXPORT_EVENT_WEIGHTS = {
    **EVENT_WEIGHTS,
    "recom_bike_view": 3,
    "show_recommendation": -0.01,
    "engaged_bike": 2,
}

# Look-back in months per event; every other event looks back DEFAULT_MONTHS.
EVENT_MONTHS = {
    "product_viewed": 4,
    "recom_bike_view": 4,
    "engaged_bike": 4,
    "show_recommendation": 1,
}
DEFAULT_MONTHS = 12

# Recency factor: first row whose age limit holds. (unit, count, factor)
DECAY_STEPS = (
    ("days", 1, "2"),
    ("days", 3, "1.5"),
    ("days", 7, "1.25"),
    ("days", 14, "1"),
    ("days", 21, "0.75"),
    ("months", 1, "0.5"),
    ("months", 2, "0.25"),
)
DECAY_REST = "0.1"

MIN_ITEMS_PER_ACTOR = 3
MAX_ITEMS_PER_ACTOR = 4000

HIDDEN_STATUSES = (
    "new",
    "deleted",
    "deleted_by_admin",
    "rejected",
    "deleted_draft",
    "inactive",
    "blocked",
)
EXCLUDED_TEMPLATE = 79204
MIN_SCORE = 30
MAX_IDLE_WEEKS = 2

CATEGORICAL_FEATURES = (
    "motor",
    "bike_component_id",
    "bike_category_id",
    "bike_type",
    "brake_type_code",
    "frame_material_code",
    "shifting_code",
    "color",
    "suspension",
    "continent_id",
    "brand",
    "family_id",
)
NUMERICAL_FEATURES = ("price", "frame_size_code", "year")
HEAVY_CATEGORIES = ("family_id", "bike_component_id", "bike_category_id", "bike_type", "brand")
HEAVY_CATEGORY_FACTOR = 20.0
HEAVY_NUMBERS = ("price", "frame_size_code")
HEAVY_NUMBER_FACTOR = 4.0
PREFERENCE_FEATURES = ("continent_id", "motor", "price", "frame_size_code", "bike_category_id")
PREFILTER_FEATURES = ("family_id", "bike_type", "brand")
INTERACTION_FEATURES = (
    "family_id",
    "bike_category_id",
    "rider_height_min",
    "rider_height_max",
    "price",
)

# Continents that also see motorless items of the home continent.
WIDE_CONTINENTS = (4, 7)
HOME_CONTINENT = 1

REQUEST_DEFAULTS = {
    "user_id": 0,
    "distinct_id": "NA",
    "continent_id": 1,
    "bike_id": 0,
    "n": 12,
    "strategy": "product_page",
    "bike_type": 1,
    "family_id": 1101,
    "price": 1200,
    "frame_size_code": "56",
    "rider_height_min": 150,
    "rider_height_max": 195,
    "rider_height": 180,
    "category": "road",
    "is_ebike": 0,
    "is_frameset": 0,
    "brand": "null",
}

# strategy name -> (operator family, label reported with the result)
STRATEGIES = {
    "product_page": ("content", "ContentMixed"),
    "braze": ("collaborative", "CollaborativeStrategyRandomized"),
    "homepage": ("collaborative_random", "CollaborativeStrategyRandomized"),
    "rerank": ("rerank", "CollaborativeRerank"),
    "FallbackContentMixed": ("content", "FallbackContentMixed"),
    "bot": ("quality", "QualityFilter"),
}
FALLBACK_STRATEGY = "FallbackContentMixed"

MAX_PRICE_DEFAULT = 20000
PRICE_BAND = (0.8, 1.2)

# ---------------------------------------------------------------------------
# Own choices
# ---------------------------------------------------------------------------

# Letter sizes as centimetres; a table per item type may replace it.
LETTER_SIZES = {"XS": 48.0, "S": 51.0, "M": 54.0, "L": 57.0, "XL": 60.0}

FEEDBACK_TYPE = "decimal(18,4)"
