"""Token ids in Parquet: list columns, dictionary or delta encoded, in files of ascending ids.

Rows (id, n_tokens, crc32, ids) are ranged and sorted by id, so every file holds a closed range of ids and the page
index (min and max per page, written by default) lets a reader fetch a few documents, or only their sizes, without
touching other pages. Row groups are bounded in bytes. With dictionary encoding, a row group's ids are stored as
dictionary places of 16 bits at most for a vocabulary of 50,000; delta encoding uses format version 2.

Null text is empty and holds the end id alone; null ids sort first; rows with the same id are all kept, ordered by a hash
of their text, and may lie in several files. Other columns are ignored; an empty table gives empty files.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared_folder
from .common import arrow_rows, written
from .encoding import encoder, no_collections, vocabulary


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids) with the end id appended."""

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for part in range(0, b.num_rows, 256):  # bounded ids in memory
                rows = b.slice(part, 256)
                with no_collections():
                    ids = [enc.ids(t) + end if t else end for t in rows.column(1).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield arrow_rows([id_col, "n_tokens", "ids"], [b.schema.field(0).type, pa.int64(), lists.type], [rows.column(0), sizes, lists])

    kept = docs.select(id_col, text_col)
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, files: int | None = None):
    """Write the ids of `docs` below `path` in ascending id order. Only texts are shuffled, never ids."""
    parts = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col), F.xxhash64(text_col)]
    ordered = docs.select(id_col, text_col).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "compression": "snappy",
               "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20}
    if encoding == "delta":
        options |= {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}
    token_rows(ordered, tokenizer or vocabulary("byte_bpe_50k.json"), end_id, id_col, text_col).write.options(**options).parquet(path)


def read_tokens(spark, path: str, first=None, last=None, columns=None, id_col: str = "doc_id") -> DataFrame:
    """Selective read: an id range (pruned by row group and page statistics) and a choice of columns."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col(id_col) >= first)
    if last is not None:
        df = df.where(F.col(id_col) <= last)
    return df.select(*columns) if columns else df


def checksums(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(file, block, id_col, before, n_tokens, ids_crc32) of read ids, as unsigned little-endian 32-bit numbers.

    `before` counts the ids that come earlier in the same block of the same file; a task reads a block from its first row to its last."""

    def run(batches):
        here, before = None, 0
        for b in batches:
            lists = b.column(1)
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[x:y].astype("<u4").tobytes()) for x, y in zip(at, at[1:])]
            starts = []
            for place, n in zip(zip(b.column(2).to_pylist(), b.column(3).to_pylist()), np.diff(at)):
                if place != here:
                    here, before = place, 0
                starts.append(before)
                before += int(n)
            yield arrow_rows(["file", "block", id_col, "before", "n_tokens", "ids_crc32"], [pa.string(), pa.int64(), b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64()],
                             [b.column(2), b.column(3), b.column(0), starts, np.diff(at), crc])

    kept = tokens.select(id_col, "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return kept.mapInArrow(run, f"file string, block long, `{id_col}` {dict(kept.dtypes)[id_col]}, before long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write `docs`, read the files back once: (id_col, start, n_tokens, ids_crc32). File names ascend with the ids, so one total per block is all that is summed."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, id_col=id_col, text_col=text_col, **options)
    back = written(checksums(docs.sparkSession.read.parquet(path), id_col), "index")
    totals = back.groupBy("file", "block").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    return back.join(F.broadcast(offsets), ["file", "block"]).select(  # one row per block of a file
        id_col, (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
