"""Session helpers."""

from __future__ import annotations

import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def is_local_path(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def _probe():
    """A function that says whether a worker finds the package; built inside another one so that it
    travels by value."""

    def run(batches):
        import importlib.util

        import pyarrow

        for _ in batches:
            yield pyarrow.RecordBatch.from_arrays([pyarrow.array([importlib.util.find_spec("stallrec") is not None])], names=["found"])

    return run


def ship_package(spark: SparkSession) -> None:
    """Hand the package to the executors' Python unless it is installed there, so that kernels can
    import it. Asks once per application."""
    import shutil
    import tempfile

    context = spark.sparkContext
    if getattr(context, "_stallrec_shipped", False):
        return
    if not spark.range(1).mapInArrow(_probe(), "found boolean").first()["found"]:
        # a scratch folder of the driver; Spark itself brings the file to the executors
        folder = Path(tempfile.mkdtemp(prefix="stallrec-"))
        context.addPyFile(shutil.make_archive(str(folder / "stallrec"), "zip", Path(__file__).resolve().parents[1], "stallrec"))
    context._stallrec_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, else the warehouse folder.

    A local warehouse path is refused unless the master is local: each executor would
    write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is not None:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if is_local_path(warehouse) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, packed with ``codec``, and go on from the written table.

    Survives lost executors like a checkpoint does; as parquet it also keeps column
    pruning and gives the planner true sizes.
    """
    path = f"{shared_folder(df.sparkSession)}/stallrec/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
