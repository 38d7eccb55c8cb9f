"""WARC archives, index first.

Writing: payload digests are grouped (one row per different payload, whatever its number of copies) to find the first
page of each; then pages are dealt by id and every task writes gzip members, one per record, into files of bounded size
in the shared folder. A task hands on one index row per record (file, offset, length, url, digest, ...), and the index
is written as a table. Only that table makes records count: files of lost or repeated task attempts are never named
in it, so a lost executor costs its tasks and nothing else.

Reading: index rows of the wanted records are ranged by (file, offset); each task joins neighbouring byte ranges
(gaps up to `gap` bytes, blocks up to `block` bytes), reads them in order, opens the members and checks the digest.

Payloads are the html in UTF-8 (null: empty). Of records with equal payloads of at least `least` bytes the smallest
page_id is a response, the others are revisits that refer to it; rows that repeat both page_id and payload keep one
response. A null page_id can revisit, but nothing refers to it: copies that only null ids have are all responses. A null url is
written as an empty one. Other columns are ignored; an empty table gives an empty index.
"""

import base64
import hashlib
import time
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder
from .common import arrow_rows, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "file string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page))}>"


def record(page, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: an HTTP response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", _record_id(page) if page is not None else f"<urn:uuid:{uuid.uuid4()}>"),
              ("WARC-Date", date), ("WARC-Target-URI", urllib.parse.quote(url or "", safe="".join(map(chr, range(33, 127))))),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to)), ("Page-Refers-To", refers_to)]
    if page is not None:
        fields.append(("Page-ID", page))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes):
    """(fields, payload) of one record; payload None for a revisit. Raises if the digest does not match."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_bytes"] = int(http.decode().rpartition("Content-Length: ")[2])
    fields["digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return fields, None
    if len(payload) != fields["payload_bytes"] or digest32(payload) != fields["digest"]:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return fields, payload


def _filesystem(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder.replace("file:///", "/") if folder.startswith("file:") else folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0,
                   file_bytes: int = 256 << 20, date: str | None = None) -> DataFrame:
    """Write every page below `folder`; the index, one row per record."""
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    kind = dict(pages.dtypes)[id_col]
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    key = F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("key")
    sized = rows.select("id", key, "sha", F.octet_length("html").alias("bytes")).where(F.col("bytes") >= least)
    first = sized.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    later = sized.join(first, "sha").where("id IS NULL OR id <> first").select("key", "sha", "first").distinct()
    dealt = rows.select(key, "*").repartition("key").join(later, ["key", "sha"], "left")
    ordered = dealt.sortWithinPartitions("key", "sha").select("id", "url", "html", "sha", "first")

    def run(batches):
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        out, name, at, before = None, None, 0, None
        try:
            for b in batches:
                made = []
                for page, url, html, sha, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    payload = html.encode("utf-8", "surrogatepass")
                    if refers_to is None and page is not None and (page, sha) == before and len(payload) >= least:
                        refers_to = page
                    before = page, sha
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = member.compress(record(page, url, payload, digest, refers_to, date)) + member.flush()
                    out.write(data)
                    made.append((name, at, len(data), url, digest, len(payload), "response" if refers_to is None else "revisit", refers_to, page))
                    at += len(data)
                if made:
                    id_type = b.schema.field(0).type
                    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), id_type, id_type]
                    yield arrow_rows(["file", "offset", "length", "url", "digest", "payload_bytes", "record_type", "refers_to", "id"], types, list(zip(*made)))
        finally:
            if out is not None:
                out.close()

    return written(ordered.mapInArrow(run, f"{_INDEX} {kind}, id {kind}"), "warc-index")


def read_archives(index: DataFrame, folder: str, gap: int = 64 << 10, block: int = 8 << 20, task_bytes: int = 16 << 20,
                  payloads: bool = False) -> DataFrame:
    """The records of the index rows (a selection of the index): id, payload_bytes, payload_digest, record_type,
    refers_to, and the payload if asked for (null for revisits), all from the archives themselves."""
    kind = dict(index.dtypes)["id"]
    total = index.agg(F.sum("length").alias("total")).first()["total"] or 0  # index rows are small; what they point at is not
    wanted = index.select("file", "offset", "length", "id").repartitionByRange(-(-total // task_bytes) or 1, "file", "offset").sortWithinPartitions("file", "offset")
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def run(batches):
        files, root = _filesystem(folder)
        for b in batches:
            name, offset, length = (b.column(i).to_pylist() for i in range(3))
            i, source, opened = 0, None, None
            while i < len(name):
                j, end = i + 1, offset[i] + length[i]
                while j < len(name) and name[j] == name[i] and offset[j] - end <= gap and offset[j] + length[j] - offset[i] <= block:
                    end = max(end, offset[j] + length[j])
                    j += 1
                if opened != name[i]:
                    source, opened = files.open_input_file(f"{root}/{name[i]}"), name[i]
                data = source.read_at(end - offset[i], offset[i])
                made = []
                for k in range(i, j):
                    start = offset[k] - offset[i]
                    fields, payload = parse_record(zlib.decompress(data[start:start + length[k]], 31))
                    row = (fields.get("Page-ID"), fields["payload_bytes"], fields["digest"], fields["WARC-Type"], fields.get("Page-Refers-To"))
                    made.append(row + (payload,) * payloads)
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payloads
                yield arrow_rows(names, types, list(zip(*made)))
                i = j

    schema = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    return wanted.mapInArrow(run, schema).withColumns({c: F.col(c).cast(kind) for c in ("id", "refers_to")})


def archived(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write `pages`, read every record back: (id_col, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = shared_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder, id_col=id_col, **options)
    return read_archives(index, folder).withColumnRenamed("id", id_col)
