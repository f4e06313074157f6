"""WARC archives of pages, each record a Zstandard frame of its own, all with one dictionary per archive.

Which record holds a payload and which only refer to it is decided on digests, before anything is written. Each task
then writes its pages as archives of bounded size into the shared folder: a skippable frame with the dictionary,
which is built from blocks spread evenly over the records of that archive, a warcinfo record, and one frame a page.
The manifest, a table written with Spark's commit, lists the archives of the attempts that succeeded; what lost or
repeated attempts have left is in no manifest and goes with the folder. Archives are read back record by record by
their path alone: the frames' own block headers tell where each ends.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialize
from quillon.session import shared_dir

#: Fixed values of the formats: magic numbers of a dictionary's skippable frame and of a frame; the profile of a revisit.
DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Raw bytes of an archive's records, bytes of its dictionary, of the blocks it is built from, and of one block.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_BLOCK = 32 << 20, 32 << 10, 2 << 20, 8 << 10
LEVEL = 3
CAPTURED = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, raw_bytes long, stored_bytes long, dictionary_bytes int"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def plan_records(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, html as bytes, digest, response_id, revisit) of pages (page_id, url, html), and the stored table they are joined with.

    Of equal payloads of ``least_bytes`` or more, the one of largest page_id is the response, a null id being
    the least; rows that tie there are responses all. Payloads count as equal by SHA-1 and length. A digest is
    counted before it is shuffled; only repeated ones are joined, against one row each, so a hot one splits.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    repeated = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("response_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    repeated = materialize(repeated.withColumn("known", F.lit(True)), "warc-repeated")
    planned = rows.join(repeated, ["digest", "size"], "left")
    revisit = F.coalesce("known", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return planned.select("page_id", "url", "payload", "digest", "size", F.when(revisit, F.col("response_id")).alias("response_id"), revisit.alias("revisit")), repeated


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}'.encode()).digest())}>"


def _target(url: str | None) -> str:
    """A URL as a header may hold it: bytes that are no visible ASCII are percent-encoded."""
    return quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")


def record(page_id, url: str | None, payload: bytes, digest: bytes, response_id, revisit: bool, captured: str = CAPTURED) -> bytes:
    """One WARC record. A revisit has the HTTP head of its payload, and no payload."""
    said = base64.b32encode(digest).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # a JSON string holds any URL in one line, so it can be read back as it was
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id, said), "WARC-Date": captured, "WARC-Target-URI": _target(url),
        "WARC-Payload-Digest": f"sha1:{said}", "WARC-Block-Digest": f"sha1:{payload_digest(block)}", "Content-Type": "application/http; msgtype=response",
        "Page": json.dumps([page_id, url]), **({"WARC-Refers-To": _record_id(response_id, said), "WARC-Profile": REVISIT_PROFILE, "Refers-To-Page": json.dumps(response_id)} if revisit else {}),
        "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:20]!r}")
    headers = dict(x.split(": ", 1) for x in lines)
    return headers, rest[: int(headers["Content-Length"])]


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES, block: int = SAMPLE_BLOCK) -> bytes:
    """A dictionary from blocks spread evenly over all bytes of the records; none (b"") where they are too few or too small to build one."""
    total = sum(-(-len(r) // block) for r in records)
    step = max(1, -(-total * block // sample))
    taken, at = [], 0
    for r in records:
        count = -(-len(r) // block)
        taken += [r[k * block : (k + 1) * block] for k in range(-at % step, count, step)]
        at += count
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, taken)) // 8)), taken, k=512, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes]) -> tuple[bytes, int]:
    """The bytes of one archive, and of its dictionary: the dictionary's frame first, then a frame for each record."""
    dictionary = build_dictionary(records)
    info = "".join(("software: quillon\r\n", "format: WARC File Format 1.1\r\n")).encode()
    first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(b''.join(hashlib.md5(r).digest() for r in records)).digest())}>\r\nWARC-Date: {CAPTURED}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
    parts = [struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary] if dictionary else []
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)
    parts += [compressor.compress(r) for r in (first + info + b"\r\n\r\n", *records)]
    return b"".join(parts), len(dictionary)


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame that begins at a byte ends, by its block headers; nothing is decompressed."""
    start = at
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME:
        raise ValueError(f"no frame at byte {start}")
    told = data[at + 4]
    single, checksum = told >> 5 & 1, told >> 2 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[told & 3] + ((1 if single else 0), 2, 4, 8)[told >> 6]
    last = 0
    while not last:
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        last, kind = head & 1, head >> 1 & 3
        at += 3 + (1 if kind == 1 else head >> 3)  # a run-length block has one byte
    return at + 4 * checksum


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at, decompressor = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        if struct.unpack_from("<I", data, at)[0] == DICTIONARY_FRAME:
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : end]))
        elif struct.unpack_from("<I", data, at)[0] == FRAME:
            yield parsed(decompressor.decompress(data[at:end]))
        at = end


def _write(folder: str, archive_bytes: int):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("raw_bytes", pa.int64()), ("stored_bytes", pa.int64()), ("dictionary_bytes", pa.int32())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def stored() -> pa.RecordBatch:
            system, place = filesystem(folder)
            system.create_dir(place, recursive=True)
            data, dictionary = archive(held)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(f"{place}/{name}") as out:
                out.write(data)
            row = [f"{folder}/{name}"], [len(held)], [size], [len(data)], [dictionary]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "response_id", "revisit")]
            for i in range(batch.num_rows):
                made = record(*[c[i].as_py() for c in columns])
                if held and size + len(made) > archive_bytes:
                    yield stored()
                    held, size = [], 0
                held.append(made)
                size += len(made)
        if held:
            yield stored()

    return write


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives below ``folder``; returns the manifest, a table in the shared folder.

    Null html is an empty payload, a null url ``about:blank``, a null page_id the least id. Repeated rows are records of
    their own. An empty table writes no archive and gives an empty manifest. Other columns are left out. A record
    larger than ``archive_bytes`` makes an archive of its own.
    """
    planned, repeated = plan_records(pages, least_bytes)
    manifest = materialize(planned.mapInArrow(_write(folder, archive_bytes), MANIFEST), "warc-manifest")
    discard(repeated)
    return manifest


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = filesystem(path)
                with system.open_input_stream(place) as f:
                    data = f.read()
                rows, size = [], 0
                for headers, block in read_archive(data):
                    if headers["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    whole = headers["WARC-Type"] == "response"
                    if whole and (length != len(payload) or stated != payload_digest(payload)):
                        raise ValueError(f"{path}: payload of {headers['WARC-Record-ID']} differs from its digest")
                    page_id, url = json.loads(headers["Page"])
                    rows.append((page_id, url, headers["WARC-Type"], json.loads(headers.get("Refers-To-Page", "null")), stated, length, payload if whole and with_payload else None))
                    size += len(payload) if with_payload else 0
                    if size > 4 << 20 or len(rows) >= 10_000:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return read


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every page record of the archives of a manifest: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    Payloads of responses are held against their digest and length; a revisit's payload is null, its length that of its
    HTTP head. An archive is one task's work, as it is bounded in size.
    """
    spark = manifest.sparkSession
    paths = manifest.select("path").repartition(max(1, 4 * spark.sparkContext.defaultParallelism), "path")
    return paths.mapInArrow(_read(with_payload), RECORDS)


def delete_archives(spark: SparkSession, folder: str) -> None:
    """Delete the folder of some archives, with what unsuccessful attempts have left there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as archives and read back: one row a record without its payload; the archives are gone afterwards."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/quillon/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, folder, least_bytes)
    back = materialize(read_archives(manifest, with_payload=False).drop("payload"), "warc-records")
    delete_archives(spark, folder)
    discard(manifest)
    return back
