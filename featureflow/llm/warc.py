"""WARC archives: a writer with one gzip member per record and a splittable reader.

Files are reached from tasks through pyarrow's filesystems, so the folder may be in any store they open
(file, hdfs, s3, ...). The writer names each file after its task attempt and reports it in a checkpointed
manifest: a lost task writes a new file, and only files of the manifest are read.

The reader deals out byte ranges. A task searches its range for gzip magic, accepts a member only if its
first decoded bytes begin a WARC record, and owns the records that start inside the range, reading past
its end to finish the last. Magic inside a compressed member does not decode to a record head; the
writer checks each member for that, and compresses it with fixed codes if bytes inside would pass.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featureflow.sources.storage import checkpointed

MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes a member may need before its first decoded bytes appear.
_PROBE = 1 << 16
_READ = 1 << 20
# Up to so many tasks read one range each; beyond, each reads several.
TASKS = 20_000
# Decoded bytes handed on in one batch.
_BATCH = 8 << 20

RECORDS = (
    "file string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, "
    "fields map<string,string>, payload_bytes long, payload_digest string, payload binary, error string"
)


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1, 32 characters."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + key).urn}>"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path; Hadoop's file:/x is spelled file:///x here."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def is_head(data: bytes) -> bool:
    """Whether a gzip member that decodes to the start of a WARC record begins here."""
    try:
        return zlib.decompressobj(31).decompress(data, len(HEAD)) == HEAD
    except zlib.error:
        return False


def member(record: bytes, level: int = 6) -> bytes:
    """One gzip member that holds no other acceptable start of a record."""
    data = b""
    for strength, strategy in ((level, zlib.Z_DEFAULT_STRATEGY), (level or 1, zlib.Z_FIXED)):
        packer = zlib.compressobj(strength, zlib.DEFLATED, 31, 9, strategy)
        data = packer.compress(record) + packer.flush()
        at = data.find(MAGIC, 1)
        while at > 0 and not is_head(data[at : at + _PROBE]):
            at = data.find(MAGIC, at + 1)
        if at < 0:
            break
    return data


def record(page: str | None, url: str | None, payload: bytes, digest: str, revisit_of: str | None, refers_to_key: str | None,
           key: str, date: str) -> bytes:
    """A response, or a revisit that keeps the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to_key is not None else head + payload
    fields = {"WARC-Type": "response" if refers_to_key is None else "revisit", "WARC-Record-ID": record_id(key), "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    fields["WARC-Payload-Digest"] = f"sha1:{digest}"
    if refers_to_key is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to_key)}
        if revisit_of is not None:
            fields["Refers-To-Page"] = revisit_of
    if page is not None:
        fields["Page"] = page
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
               min_bytes: int = 0, file_bytes: int = 1 << 30, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row below `folder`; return the manifest (file, bytes, records), already written.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at least `min_bytes`
    bytes the one with the largest id is a response and the others are revisits of it; rows that share
    that largest id are all responses. A null id is smaller than any other: a row without id revisits
    a row that has one, and is a response where no equal row has one. Smaller payloads are all
    responses. A null url is left out. Other columns are ignored; an empty table writes no file.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("id"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("body"),
    ).withColumn("sha", F.sha1("body"))
    keepers = rows.where(F.length("body") >= min_bytes).groupBy("sha").agg(F.max("id").alias("keeper"))
    decided = rows.join(keepers, "sha", "left").select(
        "id", "url", "body", "keeper", (F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")) & (F.length("body") >= min_bytes)).alias("again")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, top = _open(folder)
        store.create_dir(top, recursive=True)
        out, name, size, count, files = None, "", 0, 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                page, link, body, keeper, again = (batch.column(i)[row].as_py() for i in range(5))
                digest = payload_digest(body)
                target = f"{keeper}:{digest}" if again else None
                data = member(record(None if page is None else str(page), link, body, digest, str(keeper) if again else None,
                                     target, f"{page}:{digest}", date), level)
                if out is not None and size + len(data) > file_bytes:
                    out.close()
                    files.append((name, size, count))
                    out = None
                if out is None:
                    tail = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files)}.warc.gz"
                    name, size, count = f"{folder}/{tail}", 0, 0
                    out = store.open_output_stream(f"{top}/{tail}", compression=None)
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            files.append((name, size, count))
        if files:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in files]), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())],
                names=["file", "bytes", "records"],
            )

    return checkpointed(decided.mapInArrow(write, "file string, bytes long, records long"))


def parse(data: bytes) -> dict:
    """Fields and payload of one decoded record; the digest is computed where the payload is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if colon:
            fields[k.strip().lower()] = v.strip()
    size = int(fields.get("content-length", len(rest)))
    if len(rest) < size:
        raise ValueError("the block is shorter than its Content-Length")
    block, kind = rest[:size], fields.get("warc-type")
    payload, length = block, size
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if kind == "revisit":
            told = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            length = int(told[0]) if told else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None if kind == "revisit" else payload_digest(payload)
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "fields": list(fields.items()), "payload_bytes": length,
        "payload_digest": digest, "payload": None if kind == "revisit" else payload, "error": None,
    }


_EMPTY = dict.fromkeys(
    ("record_type", "record_id", "target_uri", "refers_to", "fields", "payload_bytes", "payload_digest", "payload", "error")
)


def _records(handle, start: int, end: int) -> Iterator[dict]:
    """The members that start in [start, end); one that cannot be decoded is a row with its error."""
    handle.seek(start)
    base, data = start, bytearray()

    def fill() -> bool:
        more = handle.read(_READ)
        data.extend(more)
        return bool(more)

    while True:
        at = data.find(MAGIC)
        skip = at if at >= 0 else max(0, len(data) - len(MAGIC) + 1)
        base += skip
        del data[:skip]
        if base >= end:
            return
        if at < 0:
            if not fill():
                return
            continue
        while len(data) < _PROBE and fill():
            pass
        length, row = 1, {}
        if is_head(bytes(data[:_PROBE])):
            unzip, parts, fed = zlib.decompressobj(31), [], 0
            try:
                while not unzip.eof:
                    if fed == len(data) and not fill():
                        raise ValueError("the file ends inside the member")
                    parts.append(unzip.decompress(data[fed:]))
                    fed = len(data)
                length = len(data) - len(unzip.unused_data)
                row = parse(b"".join(parts))
            except (zlib.error, ValueError) as problem:
                row = {"error": str(problem)}
            yield _EMPTY | {"offset": base, "length": length} | row
        base += length
        del data[:length]


def read_warc(files: DataFrame, file: str = "file", size: str = "bytes", range_bytes: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """Every record of the listed files (see RECORDS), whatever ranges they are cut into.

    `files` has a path and a length per row: a manifest of `write_warc`, or `archives` of a folder.
    Digest and length of a response are computed from its decoded payload; a revisit has those of the
    payload it refers to, from its own fields. A member that begins as a record but cannot be decoded is a row with `error` set;
    reading goes on behind its head. Fields keep the last of repeated names, in lower case. Without
    `payloads` that column is null. Empty files and an empty list give no rows; a null length counts as empty.
    """
    full = files.where(F.col(size) > 0)
    starts = F.explode(F.expr(f"sequence(0L, {size} - 1, {int(range_bytes)}L)"))
    listed = full.select(F.col(file).alias("file"), starts.alias("start"))
    # By number: ranges are rows of a few bytes, which the planner would otherwise put into one task.
    ranges = full.agg(F.sum(F.ceil(F.col(size) / range_bytes))).first()[0] or 1
    listed = listed.repartition(int(min(ranges, TASKS)))
    names = [part.split()[0] for part in RECORDS.replace("map<string,string>", "map").split(", ")]
    schema = pa.schema(
        [(n, {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary(),
              "fields": pa.map_(pa.string(), pa.string())}.get(n, pa.string())) for n in names]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner = _open(path)
                with store.open_input_file(inner) as handle:
                    for row in _records(handle, start, start + range_bytes):
                        held += len(row["payload"] or b"") + 1000
                        rows.append(row | {"file": path} | ({} if payloads else {"payload": None}))
                        if held > _BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return listed.mapInArrow(read, RECORDS)


def archives(spark, folder: str) -> DataFrame:
    """(file, bytes) of the archives below a folder, listed by Spark without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))
