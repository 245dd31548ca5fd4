"""What the corpus operators have in common: columns, samples, bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kvlog.sources.storage import fresh_path  # noqa: F401
from kvlog.sources.storage import stored as staged  # noqa: F401


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator adds itself (compared as Spark does, without case)."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone])


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"{name}_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(spark: SparkSession, schema: StructType) -> pa.Schema:
    """The Arrow schema that mapInArrow has to return for a Spark schema."""
    return to_arrow_schema(schema, timestamp_utc=True, prefers_large_types=False)


def hashed_lowest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """At most n rows, those whose columns `by` hash lowest.

    Rows beyond a bound that leaves some more than n are passed over where they
    are read, so what meets in the last task doesn't grow with the table.
    """
    key = F.xxhash64(*by)
    return df.where(key <= hash_bound(df.count(), n)).orderBy(key, *by).limit(n)


def hash_bound(rows: int, n: int) -> int:
    """A 64-bit hash that leaves some more than n of so many distinct rows below it."""
    return min((1 << 63) - 1, -(1 << 63) + int(min(1.0, (1.5 * n + 100) / max(1, rows)) * ((1 << 64) - 1)))


#: Bits of the bitmaps that are sent to tasks: 2 MB, whatever the number of keys.
FILTER_BITS = 24


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the bit of every key set (keys are longs that are evenly spread hashes)."""
    bit = keys.select(F.col(column).bitwiseAND((1 << FILTER_BITS) - 1).cast("int").alias("at"))
    words = bit.groupBy(F.expr("at div 32").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, at % 32))").alias("b"))
    found = words.toArrow()  # 2**19 rows at most
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the bitmap; the others are not for certain."""
    at = keys & ((1 << FILTER_BITS) - 1)
    return bits[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1) == 1


def left_out(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is in gone. Only rows that a bitmap doesn't clear are shuffled and compared."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(gone.select(F.xxhash64(key).alias("h")), "h"))
    own = unused(docs, "gone")
    marked = docs.select("*", F.xxhash64(key).alias(unused(docs, "hash")))
    arrow = arrow_schema(spark, docs.schema)

    def pick(batches: Iterator[pa.RecordBatch], on: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = in_bitmap(bits.value, batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=arrow).filter(pa.array(some == on))

    clear = marked.mapInArrow(lambda it: pick(it, False), docs.schema)
    rest = marked.mapInArrow(lambda it: pick(it, True), docs.schema)
    other = gone.select(F.col(key).alias(own)).hint("merge")
    return clear.unionAll(rest.join(other, rest[key] == F.col(own), "left_anti"))
