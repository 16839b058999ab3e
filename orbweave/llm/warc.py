"""WARC archives: a writer, and a sequential reader.

The writer puts each page into its own gzip member: a ``response`` record with the payload, or a ``revisit`` record
that names an equal payload written elsewhere. Each writing task makes files of its own in the shared folder and
returns a row for each, kept as a Parquet manifest; only files in the manifest count, so a repeated task leaves
nothing behind that is read. The reader goes through a file member by member with an incremental zlib decompressor,
frames the block by Content-Length and verifies the block digest and the payload digest.

Null payloads are empty. A null url gives a record without target. A null page_id gives a record without an id of its
own, read back as null; among equal payloads it is smaller than any id. Pages that share the largest page_id of equal
payloads are all responses. Very long payloads are one record each. Extra columns are not archived. An empty table
gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.plans.shared import materialize, new_path, splittable_join

#: Payloads shorter than this are never revisits.
MIN_REVISIT = 1000
#: A new file is begun beyond this size.
FILE_BYTES = 64_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
CHUNK = 1 << 16


class WarcError(ValueError):
    """A record that is cut off, malformed or fails its digest."""


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:x-page:{page_id}>"


def _page(urn: str | None) -> int | None:
    return int(urn[12:-1]) if urn and urn.startswith("<urn:x-page:") else None


def member(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """``digest`` (hex) and ``size`` are of the full payload, which a revisit leaves out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(33, 127))))
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    headers |= {"WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "WARC-Block-Digest": _digest(block), "Content-Type": "application/http; msgtype=response"}
    return member(headers, block)


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class Reader:
    """Records of one archive in order: (offset, headers, block)."""

    def __init__(self, stream: BinaryIO):
        self.stream = stream
        self.rest = b""
        self.offset = 0

    def _fill(self) -> bytes:
        out, self.rest = self.rest or self.stream.read(CHUNK), b""
        return bytes(out)

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        while raw := self._fill():
            z, at, text, head, need = zlib.decompressobj(31), self.offset, bytearray(), None, 0
            while True:
                text += z.decompress(raw)
                self.offset += len(raw) - len(z.unused_data)
                if head is None and (end := text.find(b"\r\n\r\n")) >= 0:
                    version, head = _headers(bytes(text[:end]))
                    if not version.startswith("WARC/") or not head.get("content-length", "").isdigit():
                        raise WarcError(f"no WARC record at {at}")
                    need = int(head["content-length"])
                    del text[: end + 4]
                if head is not None and len(text) > need + 4:
                    raise WarcError(f"the record at {at} is longer than its Content-Length")
                if z.eof:
                    break
                if not (raw := self._fill()):
                    raise WarcError(f"the record at {at} is cut off")
            self.rest = z.unused_data
            if head is None or len(text) != need + 4 or text[need:] != b"\r\n\r\n":
                raise WarcError(f"the record at {at} does not fit its Content-Length")
            block = bytes(text[:need])
            if head.get("warc-block-digest", _digest(block)) != _digest(block):
                raise WarcError(f"block digest of the record at {at}")
            yield at, head, block


def read_page(headers: dict[str, str], block: bytes, at: int) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page_id, payload size, payload digest (hex), record type, refers_to, stored payload; the digest of a stored payload is verified."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    size = int(_headers(http)[1]["content-length"])
    if kind == "response" and (len(payload) != size or _digest(payload) != headers["warc-payload-digest"]):
        raise WarcError(f"payload digest of the record at {at}")
    return _page(headers.get("warc-record-id")), size, base64.b32decode(headers["warc-payload-digest"][5:]).hex(), kind, _page(headers.get("warc-refers-to")), payload


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, size, record_type, refers_to for each page: the largest page_id of equal payloads is the response."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    # Only payloads that occur more than once, without the payloads themselves: the counts combine before the shuffle.
    equal = p.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    p = splittable_join(p, equal, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.select("page_id", "url", "payload", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows of :func:`plan_records` as archives under ``folder``; path, records and bytes of each."""
    folder = folder or new_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(path, compression=None), 0, 0
                    size += out.write(member({"WARC-Type": "warcinfo", "WARC-Record-ID": _urn(None), "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(r["page_id"], r["url"], r["payload"], r["digest"], r["size"], r["refers_to"], r["record_type"] == "revisit"))
                n += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return materialize(records.mapInArrow(run, MANIFEST), "warc-manifest").withColumn("folder", F.lit(folder))


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, offset long"


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each response or revisit record of the archives; ``with_payload`` adds the stored payload (empty for revisits)."""
    schema = PAGES + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

        for batch in batches:
            for r in batch.to_pylist():
                fs, _ = pyarrow.fs.FileSystem.from_uri(r["folder"])
                rows, held = [], 0
                with fs.open_input_stream(r["path"], compression=None) as stream:
                    for at, headers, block in Reader(stream):
                        if headers.get("warc-type") not in ("response", "revisit"):
                            continue
                        page_id, size, digest, kind, refers_to, payload = read_page(headers, block, at)
                        rows.append((page_id, size, digest, kind, refers_to, headers.get("warc-target-uri"), r["path"], at) + (payload,) * with_payload)
                        held += len(payload) * with_payload + 200
                        if held > 4_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = manifest.count()
    return manifest.repartition(max(1, min(files, 100_000))).mapInArrow(run, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
d AS (SELECT page_id, strlen(html) payload_bytes, sha1(html) payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) first_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN first_id <> page_id THEN first_id END refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
