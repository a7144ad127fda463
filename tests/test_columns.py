import datetime as dt

from pyspark.sql import functions as F

from stallrec.functions import columns as X


def values(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()[0]


def ts(text):
    return F.lit(text).cast("timestamp")


def test_decay_edges(spark):
    as_of = dt.date(2024, 3, 31)
    cases = {
        "2024-03-30 00:00:00": "2",
        "2024-03-29 23:59:59": "1.5",
        "2024-03-28": "1.5",
        "2024-03-24": "1.25",
        "2024-03-17": "1",
        "2024-03-10": "0.75",
        "2024-02-29": "0.5",
        "2024-02-28": "0.25",
        "2024-01-31": "0.25",
        "2024-01-30": "0.1",
    }
    for text, factor in cases.items():
        assert float(values(spark, X.recency_factor(ts(text), as_of))) == float(factor), text


def test_weights(spark):
    assert float(values(spark, X.event_weight(F.lit("bike_matcher_dislike")))) == -30
    assert float(values(spark, X.event_weight(F.lit("nothing")))) == 0
    assert values(spark, X.event_weight(F.lit("nothing"), unknown=None)) is None


def test_lookback(spark):
    as_of = dt.date(2024, 3, 31)
    keep = lambda e, t: values(spark, X.within_lookback(F.lit(e), ts(t), as_of))
    assert keep("product_viewed", "2023-11-30") and not keep("product_viewed", "2023-11-29")
    assert keep("order_completed", "2023-03-31") and not keep("order_completed", "2023-03-30")
    assert keep("show_recommendation", "2024-02-29") and not keep("show_recommendation", "2024-02-28")


def test_whole_weeks(spark):
    assert values(spark, X.whole_weeks(ts("2024-01-01 01:00:00"), ts("2024-01-22 00:00:00"))) == 2
    assert values(spark, X.whole_weeks(ts("2024-01-01"), ts("2024-01-22"))) == 3


def test_sizes(spark):
    size = lambda t, **k: values(spark, X.size_number(F.lit(t), **k))
    assert size("52,5") == 52.5
    assert size("xl") == 60.0
    assert size("none", default=1.0) == 1.0
    assert size("odd") is None
    table = {3: {"M": 17.0}}
    assert size("M", item_type=F.lit(3), letters_by_type=table) == 17.0
    assert size("M", item_type=F.lit(1), letters_by_type=table) == 54.0


def test_budgets(spark):
    def bounds(text, clean=False):
        low, high = X.budget_bounds(F.lit(text).cast("string"), clean)
        return tuple(spark.range(1).select(low, high).first())

    assert bounds("€1.000-€2.500") == (1000.0, 2500.0)
    assert bounds("More than €5000") == (5000.0, 20000.0)
    assert bounds("More than €5.000") == (5.0, 20000.0)
    assert bounds("More than €5.000", clean=True) == (5000.0, 20000.0)
    assert bounds(None) == (None, None)


def test_fraction_ignores_layout(spark):
    ids = spark.range(2000)
    pick = X.in_fraction([F.col("id")], 0.5, 7)
    sets = [{r[0] for r in ids.repartition(n).filter(pick).collect()} for n in (1, 2, 8)]
    assert sets[0] == sets[1] == sets[2]
    assert 900 < len(sets[0]) < 1100


def test_whole_numbers(spark):
    from stallrec.functions import columns as X

    given = {"12": 12, " 7 ": 7, "+3": 3, "-4": -4, "12.0": 12, "5.": 5, "12.5": None, "twelve": None, "": None, "1e3": None, "9" * 30: None, None: None}
    rows = spark.createDataFrame([(t,) for t in given], "t string")
    assert {r.t: r.n for r in rows.withColumn("n", X.whole_number(rows.t)).collect()} == given
    rows = spark.createDataFrame([(1.0,), (1.5,), (None,), (float("nan"),)], "t double")
    assert [r.n for r in rows.withColumn("n", X.whole_number(rows.t, "double")).collect()][:3] == [1, None, None]
