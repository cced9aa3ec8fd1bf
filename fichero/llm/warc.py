"""WARC archives with an index written first and coalesced byte-range reads.

Pages are compressed where they are read; only compressed records move, to learn which of equal payloads is the
response. Each task appends its records to one archive in the shared folder and returns their places, which become
the index. Reading starts from the index: the places wanted are grouped by archive and stretch, near ones are joined
to one read, and the records are parsed and checked against their digests.

An archive has a name of its own for every attempt, and the index only names archives of attempts that succeeded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from fichero.llm.common import partitions, prepared, shared_folder, staged

#: Smallest payload that is stored once; bytes between two records that are read rather than skipped; bytes of a stretch.
LEAST, GAP, STRETCH = 1000, 64 << 10, 4 << 20
_INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(location: str):
    return fs.FileSystem.from_uri(location) if "://" in location or location.startswith("file:") else (fs.LocalFileSystem(), location)


def _deflated(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, page_id, url, digest: str, size: int, payload: bytes, refers_to=None) -> bytes:
    """One WARC record, compressed as a gzip member of its own. A revisit has HTTP headers only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _deflated("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parsed(data: bytes) -> dict:
    """The fields of one compressed record; a response's size and digest are those of the payload that was read."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda name: int(name[10:-1]) if len(name) > 11 else None
    digest, size = fields["WARC-Payload-Digest"][5:], int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": None if url is None else re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), url),
        "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To", "")),
    }


def _compressed(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload")))
        out = []
        for page_id, url, payload in rows:
            digest = hashlib.sha1(payload).digest()
            out.append((page_id, url, digest, len(payload), record("response", page_id, url, digest.hex(), len(payload), payload)))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["page_id", "url", "digest", "size", "data"])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write a record per row and return the index: file, offset, length, url, digest, page_id, record_type.

    Null html is the empty payload; a null url is left out of its record; rows without an id are named by an empty
    number. Of equal payloads of at least ``least`` bytes the row with the largest id is the response (of
    several such rows that with the largest url); rows that repeat in id, url and payload are all responses, so nothing
    hangs on the order or number of rows and every row that is referred to is written. An empty table writes no archive.
    """
    spark = prepared(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    kept = rows.where(F.octet_length("payload") >= least).groupBy(digest.alias("digest")).agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("last.page_id").alias("to"), F.col("last.url").alias("to_url"), "n")
    moved = rows.mapInArrow(_compressed, "page_id long, url string, digest binary, size long, data binary").join(kept, "digest", "left")
    again = F.col("n").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("to")) & F.col("url").eqNullSafe(F.col("to_url")))
    moved = moved.select("page_id", "url", "digest", "size", F.when(~again, F.col("data")).alias("data"), F.when(again, F.col("to")).alias("to"), again.alias("again"))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches):
        out = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    location = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, path = _open(location)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out, at = store.open_output_stream(path, compression=None), 0
                places = []
                for page_id, url, digest, size, data, to, again in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "data", "to", "again"))):
                    kind = "revisit" if again else "response"
                    data = record(kind, page_id, url, digest.hex(), size, b"", to) if again else data
                    out.write(data)
                    places.append((location, at, len(data), url, digest.hex(), page_id, kind))
                    at += len(data)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*places), kinds)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return staged(moved.mapInArrow(write, _INDEX), "index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, read in order of their places with near places in one read.

    Columns: page_id, url, payload (null for revisits, or where ``payloads`` is false), payload_bytes, payload_digest,
    record_type, refers_to. A record named twice is read twice; an empty index gives an empty table.
    """
    prepared(index.sparkSession)
    stretches = index.select("file", F.floor(F.col("offset") / STRETCH).alias("stretch"), F.struct("offset", "length").alias("place"))
    # as many tasks as asked for: the few bytes of an index say nothing about the bytes that will be read
    stretches = stretches.repartition(partitions(index.sparkSession), "file", "stretch").groupBy("file", "stretch").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def read(batches):
        for batch in batches:
            for file, places in zip(batch.column("file").to_pylist(), batch.column("places").to_pylist()):
                store, path = _open(file)
                found = []
                with store.open_input_file(path) as source:
                    i = 0
                    while i < len(places):
                        start, j = places[i]["offset"], i + 1
                        end = start + places[i]["length"]
                        while j < len(places) and places[j]["offset"] - end <= GAP:
                            end = max(end, places[j]["offset"] + places[j]["length"])
                            j += 1
                        source.seek(start)
                        data = source.read(end - start)
                        for p in places[i:j]:
                            at = p["offset"] - start
                            found.append(parsed(data[at : at + p["length"]]))
                            if not payloads:
                                found[-1]["payload"] = None
                        i = j
                kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in kinds.items()], names=list(kinds))

    return stretches.mapInArrow(read, _READ)
