"""Shared plumbing: Arrow batches of bounded size, word splitting, tables of the given folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from merchlake.session import configure

#: Rows of one Arrow batch. Texts may be long, so a batch is kept to a few hundred of them.
BATCH_ROWS = 256

#: Words of ASCII-lowered text: letters, digits and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators of this package rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(rows: DataFrame, hashed: Column, limit: int) -> DataFrame:
    """The ``limit`` rows of the least hashes, ties by all columns; few more than that are ever brought together."""
    count = rows.count()
    if count > 2 * limit:
        # Twice as many are expected below this bound as are wanted.
        rows = rows.filter(hashed < F.lit(int((2 * limit / count - 0.5) * 2**64)))
    return rows.orderBy(hashed, *rows.columns).limit(limit)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words(text: str | None) -> list[str]:
    """ASCII-lowered words of a text; none for null."""
    return WORD.findall(ascii_lower(text)) if text else []


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """``make()`` runs once per task and yields a function from a row's values to output tuples."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            out = [row for values in zip(*(c.to_pylist() for c in batch.columns)) for row in apply(*values)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*out), fields)], schema=fields
                )

    return df.mapInArrow(run, schema)
