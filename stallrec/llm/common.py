"""What the operators share: words, row mappers over Arrow batches, a sized broadcast check."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates words, for the regular expressions of Spark and of SQL.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split_words(text: str | None) -> list[bytes]:
    """Runs of characters other than the six ASCII spaces, which is what bytes.split() gives."""
    return text.encode().split() if text else []


def words_column(text: Column) -> Column:
    """The same words as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A column used inside a lambda would be put in
    its place by the optimizer and computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_rows(df: DataFrame, start: Callable[[], Callable[[dict], dict]], added: dict[str, str]) -> DataFrame:
    """Add columns made from each Arrow batch of ``df``.

    ``start`` runs once in each task and returns a function from {column: pyarrow array} to
    {added column: values}. Batches are handed on one by one, so memory stays at one batch.
    """
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in added.items())).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            new = make({name: batch.column(n) for n, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(as_arrow(new[n], t) for n, t in added.items())], names=[*batch.schema.names, *added]
            )

    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def as_arrow(values, kind: str) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    return pa.array(values, type=_ARROW[kind])


def arrow_schema(fields: dict[str, str]) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in fields.items()])


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())


def int_lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Flat values and a length per row as a list array."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
