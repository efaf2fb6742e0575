"""Places of rows within groups of any size, without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from kinweave.lineage import cut


def name_of(column: Column) -> Column:
    """A group's name as text that is never null and sorts as the values do: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def with_places(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``place``: 0, 1, ... within each value of ``group`` (never null), in the given order.

    Rows are laid out by ranges of group and order; rows equal in both are dealt out too, in any order.
    Each partition numbers the rows of its groups. Only the first group of a partition can have begun
    in an earlier one, so what is added to its places is one row per partition. The rows are written
    to the shared folder.
    """
    rows = df.withColumn("salt", F.monotonically_increasing_id())
    laid = rows.repartitionByRange(group, *order, "salt").sortWithinPartitions(group, *order, "salt").drop("salt")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run = None, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            names = rows[group]
            first = np.ones(len(names), bool)
            first[0] = names[0].as_py() != last
            first[1:] = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
            at = np.arange(len(names))
            begin = np.maximum.accumulate(np.where(first, at, -1))
            place = np.where(begin >= 0, at - begin, at + run)
            last, run = names[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(place, pa.int64())], [*rows.schema.names, "place"])

    schema = StructType(list(laid.schema.fields)).add("place", LongType())
    placed = cut(laid.mapInArrow(work, schema).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = (placed.groupBy(group, "part").agg(F.count("*").alias("n"))
             .select(group, "part", F.sum("n").over(before).alias("base")).filter("base > 0"))
    return (placed.join(F.broadcast(begun), [group, "part"], "left")
            .select(*df.columns, (F.col("place") + F.coalesce("base", F.lit(0))).alias("place")))
