"""What the corpus operators share: written tables, row functions over Arrow batches, text helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import again, forget, saved, shared_dir  # noqa: F401  for the operators
from ..shipping import ship

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

#: Rows, and bytes of their texts, that a row function sees at once; texts may be long, so batches are cut further than Arrow's.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 2 << 20


#: At most so many keys are hot, whatever the table: those that hold more than one row in so many.
MOST_HOT = 5000


def join_hot(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, rest: str = "inner") -> DataFrame:
    """rows joined with counted(keys, n, ...) on keys, where n is at most the number of rows of a key and total of all.

    Keys with n over total / MOST_HOT are fewer than MOST_HOT, so they are broadcast and their rows, which may be a
    third of all, stay where they are; the others are shuffled, with so few rows each. rest says how these join:
    `inner`, or `left` to keep rows without a key in counted. n is not in the result. Keys are not null.
    """
    hot = F.col("n") * MOST_HOT > total
    first = rows.join(F.broadcast(counted.where(hot).drop("n")), keys)
    others = rows.join(F.broadcast(counted.where(hot).select(*keys)), keys, "left_anti")
    return first.unionByName(others.join(counted.where(~hot).drop("n"), keys, rest))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ROWS_AT_ONCE rows and about BYTES_AT_ONCE bytes of text; a longer text is alone."""
    import numpy as np

    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + ROWS_AT_ONCE, int(np.searchsorted(ends, before + BYTES_AT_ONCE, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def map_rows(df: DataFrame, schema: str, rows: Callable[[list[tuple]], Iterator[tuple]]) -> DataFrame:
    """Run rows() over lists of input tuples, as slices() cuts them; it yields output tuples of the schema."""
    ship(df.sparkSession)
    fields = T._parse_datatype_string(schema)
    target = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = list(rows(list(zip(*(c.to_pylist() for c in part.columns)))))
                columns = list(zip(*out)) if out else [()] * len(target)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, fields)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_of_id(column: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_per(spark: SparkSession, n: int, each: int) -> int:
    """How many parts of about `each` rows n rows make."""
    return max(1, -(-n // each))
