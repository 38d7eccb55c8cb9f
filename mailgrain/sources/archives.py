"""Raw mail: mbox archives and message files to model text.

Spark splits the archives and the files. One Arrow-batched pass takes messages apart with the standard library and hands on
headers and text parts as they are; which parts make the body, what the subject is and whether it is mail at all are columns.
"""

import re
from email import message_from_bytes, policy
from email.headerregistry import HeaderRegistry
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.base import collapse, literal_array, settled, strip
from ..functions.html import html_text
from ..functions.text import clean_whitespace, cut, source_from_file_name
from .records import PARTS, PARTS_SCHEMA, whole_records

TASKS_PER_SLOT = 8
BYTES_AT_ONCE = 4_000_000  # raw mail that is taken apart before the pieces leave the worker
PIECES = "headers array<struct<name:string,value:string>>, parts array<struct<kind:string,attached:boolean,content:string>>"
_ARROW_PIECES = (pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])),
                 pa.list_(pa.struct([("kind", pa.string()), ("attached", pa.bool_()), ("content", pa.string())])))


_STRUCTURED = frozenset(n for n, kind in HeaderRegistry().registry.items() if n != "subject")
_PLAIN = re.compile(r"[ -~]*")
_ADDRESS_HEADERS = frozenset(("from", "to", "cc", "bcc", "sender", "reply-to"))
_ADDRESS = re.compile(r"(?:[A-Za-z0-9]+(?: [A-Za-z0-9]+)* <)?[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*@[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*>?")


class _Headers(HeaderRegistry):
    """The library's header values without its grammar where the text is already the value.

    That holds for unstructured headers in printable ASCII without encoded words and for one simple address. The library asks for
    the content headers again and again, so what it parsed last is kept (a bounded number of them)."""

    def __init__(self):
        super().__init__()
        self.parsed = lru_cache(1024)(super().__call__)

    def __call__(self, name, value):
        low = name.lower()
        if low not in _STRUCTURED:
            if _PLAIN.fullmatch(value) and "=?" not in value:
                return value
        elif low in _ADDRESS_HEADERS and _ADDRESS.fullmatch(value) and ("<" in value) == value.endswith(">"):
            return value
        return self.parsed(name, value)


MAIL_POLICY = policy.default.clone(header_factory=_Headers())


def _characters(part) -> str:
    """Characters of one part; bytes that its charset cannot read are replaced, an unknown charset is taken as UTF-8."""
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset("ascii"), "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def take_apart(raw: bytes):
    """(headers, text parts) of one message, or None where the library gives up on it."""
    try:
        message = message_from_bytes(raw, policy=MAIL_POLICY)
        headers = [{"name": n, "value": str(v)} for n, v in message.items()]
        texts = [(p.get_content_type(), p.get_content_disposition() == "attachment", _characters(p)) for p in message.walk() if p.get_content_maintype() == "text"]
    except Exception:
        return None
    return headers, [{"kind": k, "attached": a, "content": c} for k, a, c in texts]


def _bounded(batch, content: str):
    """Slices of a batch with a bounded number of raw bytes, one mail at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(content)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + BYTES_AT_ONCE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def decode_messages(raw: DataFrame, content: str = "content") -> DataFrame:
    """Replace the binary column by is_mail, subject, body, header_block, html, plain; unreadable messages are skipped."""
    keys = [f for f in raw.schema if f.name != content]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + [PIECES])
    names = [f.name for f in keys]

    def run(batches):
        for batch in batches:
            for part in _bounded(batch, content):
                taken = [take_apart(raw) for raw in part.column(content).to_pylist()]
                there = pa.array([i for i, t in enumerate(taken) if t is not None], pa.int64())
                pieces = [pa.array([t[i] for t in taken if t is not None], kind) for i, kind in enumerate(_ARROW_PIECES)]
                yield pa.RecordBatch.from_arrays([part.column(n).take(there) for n in names] + pieces, [*names, "headers", "parts"])

    def shown(kind):
        return F.transform(F.filter("parts", lambda p: (p["kind"] == kind) & ~p["attached"]), lambda p: p["content"])

    name = F.transform("headers", lambda h: F.lower(h["name"]))
    subjects = F.filter("headers", lambda h: F.lower(h["name"]) == "subject")
    plain, html = shown("text/plain"), shown("text/html")
    body = F.when(F.exists(plain, lambda t: strip(t) != ""), plain).otherwise(F.transform(html, html_text))
    return raw.mapInArrow(run, schema).select(
        *names,
        F.arrays_overlap(name, literal_array(lx.MAIL_HEADER_NAMES)).alias("is_mail"),
        F.coalesce(collapse(F.get(subjects, F.lit(0))["value"]), F.lit("")).alias("subject"),
        F.array_join(body, "\n").alias("body"),
        F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\n"))), "").alias("header_block"),
        F.array_join(html, "\n").alias("html"),
        F.array_join(plain, "\n").alias("plain"))


def message_text(subject: Column, body: Column) -> Column:
    return cut(F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), clean_whitespace(body)))


def model_text(decoded: DataFrame, raw_text: Column | None = None) -> DataFrame:
    """Column `text`: message text for raw mail, cleaned text for anything pasted (`raw_text`)."""
    text = message_text(F.col("subject"), F.col("body"))
    if raw_text is not None:
        text = F.when(F.col("is_mail"), text).otherwise(cut(clean_whitespace(raw_text)))
    return decoded.withColumn("text", text)


def _finish(decoded: DataFrame, label, source: Column, scrub, hooks) -> DataFrame:
    rows = model_text(decoded).withColumns({"label": F.lit(label), "source": source})
    if scrub is not None:
        rows = rows.withColumn("text", scrub(F.col("text")))
    for hook in hooks:  # user functions DataFrame -> DataFrame, e.g. header signals per message
        rows = rows.transform(hook)
    return settled(rows, "text").where(F.length("text") >= lx.MIN_TEXT_CHARS)


HEADER_LINE = re.compile(rb"[^\n]*\n[!-9;-~]+:")  # the rest of an envelope line, then a header


def _stitched(batches):
    """Records between `From ` lines to messages: a record not followed by a header line goes on with the message before it.

    Rows of a block come in file order. What a block holds before its first envelope leaves as its lead, its last message is
    marked, and everything between is whole."""
    place, kind, pieces = None, None, []
    for batch in batches:
        out = []

        def leave(kind):
            if pieces:
                out.append((*place, kind, b"".join(pieces)))

        for name, path, block, value in zip(*(batch[c].tolist() for c in PARTS[:3] + ["value"])):
            opens = HEADER_LINE.match(value)
            if (name, path, block) != place:
                leave(kind)
                place, kind, pieces = (name, path, block), "lead", []
                opens = opens or block == 0
            if opens:
                leave("whole" if kind == "last" else kind)
                kind, pieces = "last", [value.partition(b"\n")[2]]  # without its envelope line
            else:
                pieces.append(b"\nFrom " + value)
        yield pd.DataFrame(out, columns=PARTS)
    if pieces:
        yield pd.DataFrame([(*place, kind, b"".join(pieces))], columns=PARTS)


def _scan_mbox(spark: SparkSession, path, recursive=False) -> DataFrame:
    """One row per message. Spark reads byte ranges and hands the bytes through undecoded, so charsets stay intact.

    A `From ` line opens a message only before a header line; other such lines are body. A message that a byte range cuts is
    put together from the last message of one range and the leads of those after it (two small rows per range); the files
    are scanned once more for these."""
    reader = spark.read.option("lineSep", "\nFrom ")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    records = reader.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"),
                                       F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    parts = records.mapInPandas(_stitched, PARTS_SCHEMA)
    return whole_records(parts).where(F.length("content") > 0)


def read_mbox(spark: SparkSession, path, label: int, source: str, scrub=None, hooks=()) -> DataFrame:
    return _finish(decode_messages(_scan_mbox(spark, path)), label, F.lit(source), scrub, hooks)


def read_mbox_folder(spark: SparkSession, path, label: int, prefix: str = "", scrub=None, hooks=()) -> DataFrame:
    """A folder of archives; the source name comes from the file name."""
    scan = _scan_mbox(spark, f"{path}/*.mbox")
    return _finish(decode_messages(scan), label, source_from_file_name(F.col("file_name"), prefix), scrub, hooks)


def read_message_files(spark: SparkSession, path, label: int, source: str | Column, pattern: str = "*", skip=("cmds",), scrub=None, hooks=()) -> DataFrame:
    """One message per file; `source` is a name, or a column made of `file_path` and `file_name`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.substring_index("path", "/", -1)
    scan = files.where(~name.isin(list(skip))).select(F.col("path").alias("file_path"), name.alias("file_name"), "content")
    scan = scan.coalesce(TASKS_PER_SLOT * max(spark.sparkContext.defaultParallelism, 1))  # Spark plans a task per handful of small files
    return _finish(decode_messages(scan), label, source if isinstance(source, Column) else F.lit(source), scrub, hooks)


def write_message_files(mails: DataFrame, folder: str) -> int:
    """One file per row of `mails` (`place`: its path below `folder`; `content`: bytes), written by the tasks; returns their number.

    A task that runs again writes the same files again. `folder` must be one that `pyarrow.fs` opens. Spark's own writer with a
    partition per mail makes a folder per mail, which the driver then moves one by one."""
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder.replace("file:///", "/") if folder.startswith("file:") else folder)
        made = set()
        for batch in batches:
            for place, content in zip(batch.column("place"), batch.column("content")):
                path = f"{root}/{place.as_py()}"
                above = path.rpartition("/")[0]
                if above not in made:
                    store.create_dir(above, recursive=True)
                    made.add(above)
                with store.open_output_stream(path) as out:
                    out.write(content.as_py() or b"")
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    return mails.select("place", "content").mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


def read_export(spark: SparkSession, path, label: int, source: str, scrub=None, hooks=()) -> DataFrame:
    """Finished exports: plain archives and package folders (`x.mbox/mbox`), partial ones left out."""
    p = F.col("file_path")
    scan = _scan_mbox(spark, path, recursive=True)
    scan = scan.where((p.endswith(".mbox") | p.endswith(".mbox/mbox")) & ~p.contains(".partial.mbox"))
    return _finish(decode_messages(scan), label, F.lit(source), scrub, hooks)
