"""Operator 10: WARC archives of Zstandard frames, with a dictionary in the leading skippable frame.

Writing: the pages' payload digests are grouped (digest and id only); every page joins the smallest
id of its digest, and tasks write archives of about ``ARCHIVE_BYTES``, record by record: the dictionary
frame, then one frame a record.  Names are unique to the attempt, and the list of archives goes through
Spark's own commit; archives that are not on it (of lost or repeated tasks) are deleted before the folder is
read, so no record is read twice.  Neither pages nor paths pass through the driver.

Reading: Spark's binary file source hands archives to tasks; a task loads the dictionary, walks the
frames by their block headers, decodes one record at a time and validates version, mandatory headers,
block length, HTTP length and payload digest.  ``strict`` raises at the first fault, otherwise
``error`` tells it and the rest of the archive is read.

The dictionary is trained on ``SAMPLE`` pages at most (least hashes, ``SAMPLE_CHARS`` of each); it
changes the size of the archives only.  Null html is an empty payload; a null url leaves out the
target header; rows with equal ids and payloads are all written (ties: each is a response if the id is the
least); a null id is never referred to.  A very long payload is one record in one frame, held whole by one
task.  An empty table writes nothing and reads as no records.  Extra columns are not read, so no name can clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE, SAMPLE_CHARS = 64 << 20, 64 << 10, 256, 16 << 10
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

RECORD = "path string, offset bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, payload_bytes bigint, payload binary, error string"


# ---------------------------------------------------------------- one record


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, first, revisit: bool, date: str = DATE) -> bytes:
    """A response record, or a revisit of the response of page ``first``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{first}>")]
    head += [("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}


def parse(raw: bytes) -> dict:
    """The fields of a record; ``error`` says what is wrong with it."""
    out: dict = dict.fromkeys(["record_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_digest", "payload_bytes", "payload", "error"])
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, h = _headers(head)
    bare = lambda k: h[k].strip("<>") if k in h else None
    out |= {"record_type": h.get("warc-type"), "record_id": bare("warc-record-id"), "refers_to": bare("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date")}
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "no WARC header"}
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in h]:
        return out | {"error": f"missing {missing[0]}"}
    if not h["content-length"].isdigit() or int(h["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "Content-Length does not match the block"}
    block = rest[:-4]
    out["payload_digest"] = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    out["payload"], told = block, None
    if h.get("content-type", "").startswith("application/http"):
        http, found, body = block.partition(b"\r\n\r\n")
        told = _headers(http)[1].get("content-length")
        if not found or told is None or not told.isdigit():
            return out | {"error": "no HTTP header"}
        out["payload"] = body
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(told) if told is not None else None}
    out["payload_bytes"] = len(out["payload"])
    if told is not None and int(told) != len(out["payload"]):
        return out | {"error": "HTTP Content-Length does not match the payload"}
    if out["payload_digest"] and digest32(out["payload"]) != out["payload_digest"]:
        return out | {"error": "payload digest does not match"}
    return out


# ---------------------------------------------------------------- one archive


def frame_bytes(data: memoryview, at: int) -> int:
    """The compressed size of the Zstandard frame at ``at``, from its header and block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if pos + 3 > len(data):
            raise ValueError("frame is cut short")
        head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise ValueError("frame is cut short")
    return pos - at


def records(content: bytes) -> Iterator[tuple[int, dict]]:
    """(offset, fields) of every record of an archive."""
    data, at = memoryview(content), 0
    codec = zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            yield at, {"error": "archive is cut short"}
            return
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at == 0 and magic == DICTIONARY_MAGIC:
                held = bytes(data[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            yield at, {"error": "no Zstandard frame"}
            return
        try:
            size = frame_bytes(data, at)
        except (ValueError, IndexError) as e:
            yield at, {"error": str(e) or "frame is cut short"}
            return
        try:
            yield at, parse(codec.decompressobj().decompress(data[at : at + size]))
        except zstandard.ZstdError as e:
            yield at, {"error": f"frame: {e}"}
        at += size


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


# ---------------------------------------------------------------- Spark


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: without one it is of Spark's default file system, which a worker's library doesn't know."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/+", "file:///", full)


def write_archives(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives below ``path`` (default: the shared folder); returns (path, records) of each."""
    spark = pages.sparkSession
    path = qualified(spark, path or f"{C.shared_dir(spark)}/priceloom/warc-{uuid.uuid4().hex}")
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    sample = C.sample(rows.select("id", "digest", F.substring("payload", 1, SAMPLE_CHARS).alias("start")), SAMPLE, "id", "digest")
    trained = dictionary([bytes(r.start) for r in sample.collect() if r.start])
    same = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    told = rows.join(C.materialize(same, "payloads"), "digest", "left").select("id", "url", "payload", "first", F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)).alias("revisit"))

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))  # Hadoop's names of the same store
        store.create_dir(root, recursive=True)
        codec = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained if trained else b""
        out, name, n = None, "", 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64())], names=["path", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(lead)
                out.write(codec.compress(record(*(batch.column(k)[i].as_py() for k in range(5)))))
                n += 1
                if out.tell() >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return C.materialize(told.mapInArrow(write, "path string, records bigint"), "archives")


def read_archives(spark: SparkSession, paths: str | list[str], strict: bool = True, payload: bool = True) -> DataFrame:
    """The records of ``.warc.zst`` files (columns RECORD; ``payload`` null if it isn't asked for)."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    names = [c.split()[0] for c in RECORD.split(", ")]

    def read(batches):
        kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size = [], 0
                for offset, fields in records(content.as_py()):
                    if strict and fields.get("error"):
                        raise ValueError(f"{path} at {offset}: {fields['error']}")
                    size += len(fields.get("payload") or b"")
                    held.append(fields | {"path": path, "offset": offset} | ({} if payload else {"payload": None}))
                    if size > C.CHUNK_BYTES * 8:
                        yield pa.RecordBatch.from_arrays([pa.array([x.get(k) for x in held], kinds.get(k, pa.string())) for k in names], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([x.get(k) for x in held], kinds.get(k, pa.string())) for k in names], names=names)

    return files.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` and read the archives back."""
    spark = pages.sparkSession
    folder = f"{C.shared_dir(spark)}/priceloom/warc-{uuid.uuid4().hex}"
    told = write_archives(pages, folder, **options)
    if told.isEmpty():
        return spark.createDataFrame([], RECORD)
    drop_strays(spark, folder, told)
    return read_archives(spark, folder, payload=False)


def drop_strays(spark: SparkSession, folder: str, told: DataFrame) -> None:
    """Delete the archives of ``folder`` that are not in the committed list ``told``: those of lost or repeated tasks."""
    name = lambda c: F.element_at(F.split(c, "/"), -1).alias("name")
    found = spark.read.format("binaryFile").load(folder).select("path")
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    for row in found.select("path", name("path")).join(told.select(name("path")), "name", "left_anti").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(row.path)
        path.getFileSystem(conf).delete(path, False)
