r"""WARC files: a writer with revisit records, and a splittable reader of gzip members.

Writing: each task writes a file of its own, one gzip member per record, under a name that no other attempt uses, and
returns its path; only files named by a finished task are read. Of records with equal payloads of at least
MIN_REVISIT bytes the one with the smallest id is the response, the others revisit it. The join that finds them is on
the payload's digest with one row per repeated digest, so that a hot payload can be split over tasks.

Reading: files are cut into byte ranges. A task looks for gzip's magic number in its range, takes a candidate for a
record's start only if it decodes to the head of a WARC record and the member ends with a right checksum before
another member or the end of the file, and from there follows the chain of members; it owns the records that start in
its range.

Defined results: a null payload is empty; a null url is empty; control characters in a url are percent-encoded; a null
id stays null, orders last and is never named by a revisit if another id exists; rows that share the smallest id of
their payload are all responses; an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import filesystem, read, shared_dir

MIN_REVISIT = 100
SPLIT_BYTES = 8 << 20
FILE_BYTES = 512 << 20
_MAGIC = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to and refers_url (null for a response)."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest")
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    first = first.agg(least.alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("digest").alias("__key"), "__first")
    # payloads that are too small for a revisit have keys that no payload has, each its own
    own = F.when(F.octet_length("html") >= min_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    revisit = F.coalesce(F.col("page_id") != F.col("__first.page_id"), F.col("page_id").isNull() & F.col("__first").isNotNull())
    joined = rows.withColumn("__key", own).join(first, "__key", "left").withColumn("__first", F.when(revisit, F.col("__first")))
    return joined.select("page_id", "url", "html", "digest", F.col("__first.page_id").alias("refers_to"), F.col("__first.url").alias("refers_url"))


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _record(page_id, url: str, html: bytes, digest: str, refers_to, refers_url: str | None) -> bytes:
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {_escaped(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(html)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_escaped(refers_url)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT, level: int = 4) -> DataFrame:
    """Writes the rows of pages (page_id, url, html) below folder; returns (path, bytes, records) of the files."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        out, done, n, size = None, [], 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(_record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"], row["refers_url"])) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    out = done.append((f"{folder}/{name}", size, n))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "bytes", "records"])

    files = with_revisits(pages, min_bytes).mapInArrow(save, "path string, bytes bigint, records bigint")
    listing = f"{folder}/_files"
    files.write.parquet(listing)
    return pages.sparkSession.read.schema("path string, bytes bigint, records bigint").parquet(listing)


class _Window:
    """Bytes of a file from an offset on, read as needed; what lies before `keep` is let go."""

    def __init__(self, file, at: int, step: int = 1 << 20):
        self.file, self.base, self.data, self.step = file, at, b"", step
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(self.step)
        self.data += got
        return bool(got)

    def get(self, at: int, n: int) -> bytes:
        while at + n > self.base + len(self.data) and self.more():
            pass
        return self.data[at - self.base : at - self.base + n]

    def keep(self, at: int) -> None:
        if at - self.base > self.step:
            self.data, self.base = self.data[at - self.base :], at

    def find(self, mark: bytes, at: int, end: int) -> int:
        """The first place of mark in [at, end), or -1."""
        while True:
            k = self.data.find(mark, max(0, at - self.base))
            if k >= 0:
                return self.base + k if self.base + k < end else -1
            at = max(at, self.base + len(self.data) - len(mark) + 1)
            if at >= end or not self.more():
                return -1
            self.keep(at)


def _member(window: _Window, at: int, head_only: bool = False) -> tuple[bytes, int] | None:
    """What the gzip member at `at` holds, and where it ends; None if there is none, or if it is no WARC record."""
    inflate, out, pos, checked = zlib.decompressobj(31), [], at, False
    while not inflate.eof:
        piece = window.get(pos, 1 << 16)
        if not piece:
            return None
        try:
            out.append(inflate.decompress(piece))
        except zlib.error:
            return None
        pos += len(piece) - len(inflate.unused_data)
        if not checked and (inflate.eof or len(out[0]) >= 7 or len(out) > 1):
            checked = b"".join(out)[:7] == b"WARC/1."
            if not checked:
                return None
    return b"".join(out), pos


def _begins(window: _Window, at: int) -> tuple[bytes, int] | None:
    found = _member(window, at)
    if found and b"\r\n\r\n" in found[0] and window.get(found[1], 3) in (b"", _MAGIC):
        return found
    return None


def records_in(file, start: int, end: int) -> Iterator[bytes]:
    """The records that start in [start, end) of an open file, each as the bytes of its member."""
    window, at, found = _Window(file, start), start, None
    while (at := window.find(_MAGIC, at, end)) >= 0:
        if found := _begins(window, at):
            break
        at += 1
    if not found:
        return
    while True:
        yield found[0]
        at = found[1]
        window.keep(at)
        if at >= end:
            return
        found = _member(window, at)
        if found is None:
            if window.get(at, 1):
                raise ValueError(f"damaged WARC record at byte {at}")
            return


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each record of files (path, bytes); payload is null for revisits."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("bytes") - 1), F.lit(split_bytes).cast("long")))
    tasks = files.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    tasks = tasks.repartition(max(1, files.selectExpr(f"sum(ceil(bytes / {split_bytes}))").first()[0] or 1))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for task in batch.to_pylist():
                store, path = filesystem(task["path"])
                rows, size = [], 0
                with store.open_input_file(path) as file:
                    for raw in records_in(file, task["start"], min(task["bytes"], task["start"] + split_bytes)):
                        fields, block = parse_record(raw)
                        kind, digest, payload = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
                        length = int(fields["X-Payload-Length"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                            length, payload = len(payload), payload.decode()
                        rows.append((number(fields.get("X-Page-ID")), fields["WARC-Target-URI"], length, digest, kind, number(fields.get("X-Refers-To-Page-ID")), payload))
                        size += length
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return tasks.mapInArrow(load, _RECORDS)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written as WARC records and read back."""
    files = write_warc(read(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op4_warc": f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CAST(strlen(html) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > first THEN first END AS refers_to FROM f"""
}
QUERIES = {"op4_warc": op4_warc}
