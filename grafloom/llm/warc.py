"""WARC archives: deduplicated writing, an index, and coalesced range reads.

Archives are written by the executors into a shared folder, one gzip member a record, and
every record leaves a row in the index: file, offset, length, URL and digest.  Reading
starts from the index: the selected rows are dealt out by file and stretch of bytes,
sorted by offset, and neighbouring ranges are fetched in one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit holds the HTTP head only."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict:
    """Fields of RECORD from a gzip member; the digest of a response is taken from its payload."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length")))
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda x: None if x in (None, "<urn:page:none>") else int(x[len("<urn:page:") : -1])
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != length or hashlib.sha1(payload).hexdigest() != named):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": named, "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"), "payload": payload if response else None,
    }


def with_roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    copies = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).where(F.octet_length("payload") >= least)
    large = F.octet_length("payload") >= least
    last = copies.groupBy(F.sha1("payload").alias("digest")).agg(F.max("page_id").cast("long").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last")
    other = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("last")), F.col("last"))
    names = ["page_id", "url", "payload", "digest"]
    # small payloads, empty ones first of all, would only crowd one key of the join
    return rows.where(large).join(last, "digest", "left").select(*names, other.alias("refers_to")).unionByName(rows.where(~large).select(*names, F.lit(None).cast("long").alias("refers_to")))


def write_warc(rows: DataFrame, folder: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Write the rows of with_roles() as archives under a shared folder; returns the index.

    A task that runs again writes files of its own, and the index names the files of
    the attempt that counted.
    """

    def run(batches):
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record_bytes(page_id, url, payload, digest, refers_to)
                out.write(data)
                index.append((page_id, name, at, len(data), url, digest, "response" if refers_to is None else "revisit"))
                at += len(data)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = list(zip(*index, strict=True)) if index else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return materialize(rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX))


def read_warc(index: DataFrame, folder: str, stretch: int = 4 << 20, gap: int = 64 << 10, payloads: bool = True) -> DataFrame:
    """The records that rows of an index name, as RECORD; without ``payloads`` those are null.

    Tasks are dealt by the bytes that they will fetch, not by the size of the index, and
    records are handed on read by read.
    """

    def run(batches):
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            files, offsets, lengths = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            i = 0
            while i < len(files):
                j, end = i + 1, offsets[i] + lengths[i]
                while j < len(files) and files[j] == files[i] and offsets[j] - end <= gap and offsets[j] + lengths[j] - offsets[i] <= 2 * stretch:
                    end, j = max(end, offsets[j] + lengths[j]), j + 1
                with store.open_input_file(f"{path}/{files[i]}") as f:
                    data = f.read_at(int(end - offsets[i]), int(offsets[i]))
                rows = []
                for k in range(i, j):
                    a = int(offsets[k] - offsets[i])
                    row = parse_record(data[a : a + int(lengths[k])])
                    rows.append(row if payloads else row | {"payload": None})
                i = j
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    part = F.floor(F.col("offset") / stretch)
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 1) // (2 * stretch))
    return index.select("file", "offset", "length").repartition(tasks, "file", part).sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload.  Of equal payloads of 1000 bytes or more the row with
    the largest page_id is the response and the others revisit it; rows that repeat that
    page_id are responses too.  A null page_id is never referred to: equal payloads under
    null ids only are all responses.  Extra columns are not read; an empty table gives an
    empty result.
    """
    folder = shared_dir(pages.sparkSession)
    index = write_warc(with_roles(pages), folder)
    return read_warc(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


