import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_blocks(monkeypatch):
    from stallrec.operators import blocks, nearest

    monkeypatch.setattr(blocks, "QUERY_BLOCK", 16)
    monkeypatch.setattr(blocks, "ITEM_BLOCK", 32)
    monkeypatch.setattr(blocks, "CELL_QUERIES", 2)
    monkeypatch.setattr(blocks, "CELL_ITEMS", 2)
    monkeypatch.setattr(nearest, "ROWS", 8)
    monkeypatch.setattr(nearest, "ITEMS", 8)
    monkeypatch.setattr(nearest, "BLOCKS_A_PART", 4)
    monkeypatch.setattr(nearest, "FAN", 3)
