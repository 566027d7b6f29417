"""Token ids in Parquet list columns: encoded, paged and indexed so that tokens and metadata are read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.common import new_path, small, table, tidy

#: The end of a document in the contract's files.
END_ID = 2
#: How files are laid out: row groups of 32 MB; pages of 256 KB or 4096 rows, so the page index (which the writer always
#: adds) leads to a few documents; ids dictionary-encoded with pages of up to 4 MB for the dictionary (49,408 ids of 4
#: bytes fit), and what grows steadily (doc_id, n_tokens) delta-encoded.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "4096",
    "parquet.dictionary.page.size": str(4 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def encoded(docs: DataFrame, keep: list[str], text: str = "text", end: int | None = END_ID, tokenizer: str | None = None) -> DataFrame:
    """keep and ids (array<int>) of each row; a null text is an empty one, and so its end alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestream.llm.tokens import encoder

        e = encoder(tokenizer)
        for b in small(batches, len(keep), 4 << 20):
            ids, offsets = e.encode(b.column(len(keep)), end)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[*keep, "ids"])

    picked = docs.select(*keep, F.col(text).alias("__text"))
    return picked.mapInArrow(tidy(run), picked.select(*keep, F.array(F.lit(0)).alias("ids")).schema)


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int | None = END_ID, tokenizer: str | None = None) -> None:
    """Token files of docs at path: doc_id, n_tokens, ids in ascending doc_id order, within and across files.

    Rows are dealt and sorted before they are tokenized, so that only texts move. Rows with a null doc_id come last, rows
    of the same doc_id in the order of their texts. Empty docs give files without rows.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("__text")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ids = encoded(rows, ["doc_id"], "__text", end, tokenizer)
    ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of token files; select what is needed, other columns aren't read."""
    return spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").parquet(path)


def digest(rows: DataFrame, keep: list[str], ids: str = "ids") -> DataFrame:
    """keep, and ids_crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keep))
            flat, off = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = np.fromiter((zlib.crc32(flat[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(crc)], names=[*keep, "ids_crc32"])

    picked = rows.select(*keep, F.col(ids).alias("__ids"))
    return picked.mapInArrow(tidy(run), picked.select(*keep, F.lit(0).cast("bigint").alias("ids_crc32")).schema)


def _number() -> F.Column:
    """A file's number in the order of the ranges, from its name."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")


def with_start(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with start: the ids of all documents before. rows: what was made of each row of the token files, with its
    n_tokens, __file (see _number) and __row.

    Sums of files come first, one row a file, from the metadata columns alone; then sums within each file in its own
    order. A file is what one task wrote, so no task sees more rows than that.
    """
    sums = tokens.groupBy(_number().alias("__file")).agg(F.sum("n_tokens").alias("__sum"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = sums.select("__file", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__file").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "__file")
    return out.withColumn("start", F.col("__before") + F.col("__within")).drop("__before", "__within", "__file", "__row")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the token files at path."""
    tokens = read_tokens(spark, path)
    keyed = tokens.select("doc_id", "n_tokens", _number().alias("__file"), F.col("_metadata.row_index").alias("__row"), "ids")
    return with_start(tokens, digest(keyed, ["doc_id", "n_tokens", "__file", "__row"])).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
