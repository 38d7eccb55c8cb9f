"""Records that run over line ends, read by byte ranges.

Spark deals a file to tasks by byte ranges and hands lines on in file order. A streaming pass joins the lines of a range to
records; what a range holds before its first record start is the range's lead, its last record is marked, and both are put
together here, at the cost of two small rows per range. So one file of any size is read by many tasks.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = ["file_name", "file_path", "block", "kind", "content"]
PARTS_SCHEMA = "file_name string, file_path string, block long, kind string, content binary"  # kind: lead, whole, last


def whole_records(parts: DataFrame) -> DataFrame:
    """(file_name, file_path, content): whole records, and every last record with the leads of the ranges after it."""
    ends = parts.where("kind <> 'whole'").withColumn("opens", F.when(F.col("kind") == "last", F.col("block")))
    before = Window.partitionBy("file_path").orderBy("block", F.col("opens").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    owned = ends.withColumn("owner", F.last("opens", ignorenulls=True).over(before))  # two rows per byte range of a file
    pieces = F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "last", -1).otherwise(F.col("block")).alias("at"), "content")))  # one record
    joined = owned.groupBy("file_name", "file_path", "owner").agg(pieces.alias("l")).select(
        "file_name", "file_path", F.aggregate("l", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["content"])).alias("content"))
    return parts.where("kind = 'whole'").select("file_name", "file_path", "content").unionByName(joined)


def file_lines(spark: SparkSession, path, separator: str = "\n") -> DataFrame:
    """(file_name, file_path, block, value): lines as bytes, `block` the start of the byte range they were read in."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def quoted_records(spark: SparkSession, path, header: bool = True) -> DataFrame:
    """(file_name, file_path, content): the records of CSV files whose quoted fields may hold line breaks.

    With `header` the first record of every file is a heading and left out; it must lie in the file's first byte range.
    Quotes inside a field are doubled, so a line ends a record if and only if the quotes up to it are even. One pass counts the
    quotes of every byte range; a running sum over ranges (not over rows) says whether a range starts inside a field."""
    lines = file_lines(spark, path)
    text = F.col("value").cast("string")
    counts = lines.groupBy("file_path", "block").agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))).alias("quotes"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.select("file_path", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    marked = lines.join(F.broadcast(inside), ["file_path", "block"]).select("file_name", "file_path", "block", "value", "inside")  # one row per byte range

    def join_lines(batches):
        place, kind, open_quotes, pieces, first = None, None, False, [], False
        for batch in batches:
            out = []
            for name, path, block, value, starts_inside in zip(*(batch[c].tolist() for c in ("file_name", "file_path", "block", "value", "inside"))):
                if (name, path, block) != place:
                    if pieces and not (header and first and kind == "last"):
                        out.append((*place, kind, b"\n".join(pieces)))
                    place, open_quotes, pieces = (name, path, block), bool(starts_inside), []
                    kind = "lead" if open_quotes else None
                    first = block == 0
                elif not open_quotes:  # the line before ended a record
                    if kind is not None and not (header and first and kind != "lead"):
                        out.append((*place, "whole" if kind == "last" else kind, b"\n".join(pieces)))
                    first = first and kind is None
                    kind, pieces = None, []
                if kind is None:
                    kind = "last"
                pieces.append(b"\n" + value if kind == "lead" and not pieces else value)
                if value.count(b'"') % 2:
                    open_quotes = not open_quotes
            yield pd.DataFrame(out, columns=PARTS)
        if pieces and not (header and first and kind == "last"):
            yield pd.DataFrame([(*place, kind, b"\n".join(pieces))], columns=PARTS)

    return whole_records(marked.mapInPandas(join_lines, PARTS_SCHEMA))


def csv_columns(records: DataFrame, columns) -> DataFrame:
    """Fields of records by position, every one a string; an empty unquoted field is null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    text = F.rtrim(F.col("content").cast("string"), F.lit("\r"))
    parsed: Column = F.from_csv(text, schema, options)
    return records.where(F.length("content") > 0).select(parsed.alias("r")).select("r.*")
