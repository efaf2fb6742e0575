"""Token ids in ORC files: stripes, integer run lengths, row indexes, Bloom filters on document ids.

Documents lie in ascending order of their id over the files and within each, so the statistics of
files, stripes and row groups prune ranges of ids, and the Bloom filters single ids. Stripes are
read in parallel, each on its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.bpe import LETTERS, SPACE
from kinweave.llm.common import batch, id_and_text, small_batches
from kinweave.llm.word_table import LineCoder

STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000


#: A plain word; stops after it; any other word. Unicode's white space ends all of them.
WORDS = re.compile(f"[{LETTERS}]++(?![^\\x00-\\x7f])|[,.!?]++(?![^{SPACE}])|[^{SPACE}]+")


def simple_word(word: str) -> bool:
    """A word of letters, or of stops, is one pre-token, and so ends with the only word end among its tokens."""
    return word.isalpha() or not word.strip(",.!?")


def words_of(text: str) -> list[str]:
    """Words in lower case, unless that could matter: added tokens are found before lower case is made,
    and two letters have more than one lower-case form."""
    if not ("<|" in text or "\u0130" in text or "\u03a3" in text):
        text = text.lower()
    return WORDS.findall(text)


@lru_cache(maxsize=2)
def coder(path: str) -> LineCoder:
    """A tokenizer file of the tokenizers library that drops white space, fed with each different word once.

    Its normalizer only turns white space into single blanks, composes characters and makes them lower
    case, and its pre-tokenizer leaves blanks out and never looks back. So the ids of a text are those
    of its words, and of a plain word and the stops after it.
    """
    return LineCoder(path, simple_word, " ", lambda token: token.endswith("</w>"), True)


def write_token_ids(docs: DataFrame, tokenizer: str, to: str, end_id: int | None = 2,
                    id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode each whole text, append ``end_id``, and write ``doc_id, ids, part`` as ORC to ``to``.

    A null text counts as empty: it has the end id alone. Rows of equal ids lie next to each other;
    null ids come first. The texts are dealt out by ranges of ids before they are encoded, so that
    each is encoded once.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, ids array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(tokenizer)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for rows in batches:
            ids = [np.concatenate([x, end]) for x in tool.table.texts(rows["text"].to_pylist(), words_of)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)
            yield batch(schema, doc_id=rows["doc_id"], ids=pa.ListArray.from_arrays(ends, flat))

    ordered = id_and_text(docs, id_column, text_column).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (ordered.mapInArrow(work, schema).withColumn("part", F.spark_partition_id())
     .write.option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_ROWS)
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", "0.01").option("orc.compress", "ZSTD").orc(to))


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, ids`` of the files at ``path``; with ``doc_ids``, only these documents.

    The filter reaches the ORC reader, which leaves out stripes and row groups by their statistics
    and Bloom filters.
    """
    stored = spark.read.schema("doc_id long, ids array<int>, part int").orc(path)
    return (stored if doc_ids is None else stored.filter(F.col("doc_id").isin(doc_ids))).select("doc_id", "ids")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files alone; ``start`` counts the ids of all
    documents before this one in the order of the files.

    The sums of the files come from the lengths of the lists alone and are a row per file; the running
    sum within a file starts from there.
    """
    small_batches(spark)
    schema = "doc_id long, part int, n_tokens long, ids_crc32 long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows["ids"]
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield batch(schema, doc_id=rows["doc_id"], part=rows["part"], n_tokens=np.diff(ends), ids_crc32=sums)

    stored = spark.read.schema("doc_id long, ids array<int>, part int").orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (stored.groupBy("part").agg(F.sum(F.size("ids")).alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    within = (Window.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (stored.mapInArrow(work, schema).join(parts, "part")
            .select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"),
                    "n_tokens", "ids_crc32"))
