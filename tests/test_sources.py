import gzip
import json
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from stallrec.operators import export as E
from stallrec.operators import factors as CF
from stallrec.registry.queries import ORACLES, QUERIES
from stallrec.sources import tables as S
from stallrec.streaming import refresh as R

ROOT = Path(__file__).resolve().parents[1]
PROPERTIES = T.StructType(
    [
        T.StructField("distinct_id", T.StringType()),
        T.StructField("bike", T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])),
    ]
)
EXPORT = T.StructType([T.StructField("event", T.StringType()), T.StructField("properties", PROPERTIES)])


def write_export(path, rows):
    with gzip.open(path, "wt") as f:
        for event, user, item, kind in rows:
            f.write(json.dumps({"event": event, "properties": {"distinct_id": user, "bike": {"id": item, "kind": kind}, "noise": 1}}) + "\n")


def extract(raw):
    return E.export_interactions(raw, "distinct_id", "bike.id", ["bike.kind"], fraction=1.0)


def test_gzip_export(spark, tmp_path):
    write_export(tmp_path / "a.json.gz", [("share_bike", "u", 1, "x"), ("product_viewed", "u", 1, "x"), ("search", "u", 1, "x"), ("share_bike", None, 1, "x")])
    raw = S.read_event_export(spark, str(tmp_path), PROPERTIES)
    got = [(r.distinct_id, r.bike_id, float(r.feedback), r.bike_kind) for r in extract(raw).collect()]
    assert got == [("u", 1, 11.0, "x")]


def test_refresh_merges_new_files(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    run = lambda: R.refresh(spark, str(src), EXPORT, str(out), extract, "distinct_id", "bike_id", ["bike_kind"])
    write_export(src / "a.json.gz", [("share_bike", "u", 1, "x")])
    assert run() == 0
    write_export(src / "b.json.gz", [("share_bike", "u", 1, "x"), ("ask_question", "v", 2, "y")])
    assert run() == 1
    assert run() is None
    got = sorted((r.distinct_id, float(r.feedback)) for r in R.stored(spark, str(out), 1).collect())
    assert got == [("u", 20.0), ("v", 10.0)]


def test_refresh_touches_only_its_buckets(spark, tmp_path):
    from pathlib import Path

    def rows(pairs):
        return spark.createDataFrame([(u, i, Decimal(f), "x") for u, i, f in pairs], "distinct_id string, bike_id bigint, feedback decimal(20,2), bike_kind string")

    def merge(pairs, number):
        R.merge_batch(rows(pairs), number, str(tmp_path), "distinct_id", "bike_id", ["bike_kind"])

    def files():
        return {p: p.stat().st_mtime_ns for p in Path(tmp_path, "data").rglob("*.parquet")}

    def table():
        return {(r.distinct_id, r.bike_id): float(r.feedback) for r in R.stored(spark, str(tmp_path)).collect()}

    first = [(f"u{n}", n, 1) for n in range(40)]
    merge(first, 0)
    before = files()
    merge([("u3", 3, 5), ("new", 99, 2)], 1)
    after = files()
    want = {(u, i): float(f) for u, i, f in first} | {("u3", 3): 6.0, ("new", 99): 2.0}
    assert table() == want
    # the other buckets keep their files, and the first commit can still be read
    assert set(before) <= set(after) and all(after[p] == t for p, t in before.items())
    assert R.stored(spark, str(tmp_path), 0).count() == 40
    merge([("u3", 3, 5), ("new", 99, 2)], 1)
    assert files() == after and table() == want
    # a batch that failed before its commit is not read; the next commit drops what none reads
    (tmp_path / "data" / "2" / "_bucket=0").mkdir(parents=True)
    assert table() == want
    merge([("u3", 3, 1)], 2)
    assert table()["u3", 3] == 7.0 and R.stored(spark, str(tmp_path), 1).count() == 41
    old = [p for p in before if p not in files()]
    assert len(old) == 1 or len({p.parent for p in old}) == 1


def test_declared_types_and_limit(spark):
    df = spark.createDataFrame([("1", "x")], "id string, price string")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("price", T.DoubleType())])
    assert tuple(S.declared(df, schema).first()) == (1, None)
    assert S.limited(spark.range(10), 3).count() == 3 and S.limited(spark.range(10), None).count() == 10


def test_artifacts_and_interactions(spark, tmp_path):
    frames = {n: spark.range(3).select("id") for n in S.CONTENT_ARTIFACTS}
    frames["neighbors"] = spark.range(4).select(F.col("id").alias("item_id"), F.lit(1).alias("rank"))
    S.write_content(frames, str(tmp_path))
    back = S.read_content(spark, str(tmp_path))
    assert set(back) == set(S.CONTENT_ARTIFACTS) and back["neighbors"].count() == 4
    S.write_interactions(spark.range(2), "made today", str(tmp_path))
    rows, meta = S.read_interactions(spark, str(tmp_path))
    assert rows.count() == 2 and meta.first().metadata == "made today"


def test_model_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{u}", i, float(1 + (u + i) % 3)) for u in range(6) for i in range(5) if (u + i) % 2], "user_id string, bike_id bigint, feedback double")
    users, items = CF.dense_ids(rows, "user_id"), CF.dense_ids(rows, "bike_id")
    assert sorted(r.idx for r in users.collect()) == list(range(6))
    model = CF.fit(rows, users, items, rank=3, iterations=2)
    S.write_model(model, users, items, str(tmp_path))
    again, u2, i2 = S.read_model(spark, str(tmp_path))
    first = {r.user: r.vector for r in CF.user_factors(model, users).collect()}
    assert {r.user: r.vector for r in CF.user_factors(again, u2).collect()} == first and CF.item_factors(again, i2).count() == 5


def test_cold_items_take_the_mean_of_their_features(spark):
    known = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 2.0])], "item_id bigint, vector array<double>")
    feats = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "b"])], "item_id bigint, features array<string>")
    assert [(r.item_id, r.vector) for r in CF.cold_factors(known, feats).collect()] == [(3, [1.5, 0.5])]


def test_registry():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {"als_top_items"}


def test_package_reaches_workers_from_any_folder(tmp_path):
    """A session started elsewhere, with the package only on the driver's own path."""
    import os
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.warehouse.dir", {str(tmp_path / "warehouse")!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as entry
from stallrec.registry.queries import ORACLES, QUERIES
print("rows", entry.queries()["vector_neighbors_euclidean"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
