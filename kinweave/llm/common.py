"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 500
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: hand Python few of them at a time, so that its memory stays small.

    A session that asks for fewer still keeps its own setting.
    """
    if int(spark.conf.get(BATCH_KEY)) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names, so that no other column can clash."""
    return docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast way, which does the same there."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slices(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of texts of about ``most`` characters; every text is in one of them."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes ``starts[i], starts[i] + 1, ...`` of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
         "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def batch(schema: str, **columns) -> pa.RecordBatch:
    """A record batch of the given columns, typed like the Spark schema ``name type, ...``."""
    fields = [pa.field(*(n, TYPES[t])) for n, t in (f.split(" ") for f in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=pa.schema(fields))
