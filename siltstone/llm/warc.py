"""WARC archives in Zstandard, written and read with a shared dictionary.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself perhaps compressed; then
each record is one frame of its own. Between records this writer leaves an empty skippable frame (magic 0x184D2A50),
as its eight bytes are what Spark's text writer puts after a row: archives go through Spark's own committed writes
to whatever store the path names, and no executor writes files by itself. Reading takes whole files (one a task of the writing, so of a
shuffle partition's size) through Spark's binary reader, a frame at a time.

Null payloads count as empty. A payload of at least `least` bytes that equals another is kept once, as the response
of the smallest id (nulls last; of rows that repeat id and payload one is the response); the others are revisits
that name it. A frame or record that breaks the format gives one row with its error, and the rest of the file is
read on. An empty table makes an archive without records. Columns other than id, url and payload are not read."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Fixed values of the formats.
DICTIONARY_FRAME, EMPTY_FRAME = 0x184D2A5D, 0x184D2A50
FRAME, DICTIONARY = 0xFD2FB528, 0xEC30A437
BETWEEN = struct.pack("<II", EMPTY_FRAME, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"

STEP = 16_384
#: Payloads that the dictionary is trained on at most, and bytes of each; a bounded sample by design.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 4_000, 32_768


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; where they are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def leading_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


def record(page_id: int | None, url: str | None, payload: bytes, name: str, revisit: bool, first: int | None, date: str) -> bytes:
    """One record; a revisit names `first`, the response's id, and its block has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http + (b"" if revisit else payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{name}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head[3:3] = [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, least: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", level: int = 3) -> None:
    """Write the rows as an archive of .warc.zst parts under `path`."""
    spark = pages.sparkSession
    rows = pages.select(pages[page_id].cast("long").alias("id"), pages[url].cast("string").alias("url"), F.coalesce(pages[payload].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("hash", F.unhex(F.sha1("payload")))
    some = [bytes(r[0]) for r in rows.where("length(payload) > 0").select(F.substring("payload", 1, SAMPLE_BYTES).alias("s")).limit(SAMPLE_ROWS).collect()]
    dictionary = train(some)
    # Sums over the digests alone; equal digests meet in part sums before they travel.
    same = rows.where(F.length("payload") >= least).groupBy("hash").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"), F.count("*").alias("n"))
    same = same.where("n > 1").select(F.col("hash").alias("s_hash"), F.col("least.id").alias("first"), F.lit(True).alias("shared"))
    marked = rows.join(same, (rows["hash"] == F.col("s_hash")) & (F.length("payload") >= least), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
        out = [leading_frame(dictionary)]
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                name = base64.b32encode(r["hash"]).decode("ascii")
                out.append(packer.compress(record(r["id"], r["url"], r["payload"], name, not r["alone"], r["first"], date)))
                size += len(out[-1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    # The response of a shared payload is its least id; where rows repeat that id with it, the one of them that comes first.
    lead = F.col("shared") & F.col("id").eqNullSafe(F.col("first"))
    ids = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if ids.limit(1).count():
        nth = F.row_number().over(W.partitionBy("hash", "id", "lead").orderBy("url"))
        marked = marked.withColumn("lead", F.coalesce(lead, F.lit(False))).withColumn("alone", F.col("shared").isNull() | (F.col("lead") & (nth == 1)))
    else:
        marked = marked.withColumn("alone", F.col("shared").isNull() | lead)
    frames = marked.select("id", "url", "payload", "hash", "first", "alone").mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.mode("overwrite").option("lineSep", BETWEEN).text(path)


def frames_of(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The record frames of a file, each decoded on its own with the file's dictionary, or what is wrong."""
    at, unpacker, limit = 0, zstandard.ZstdDecompressor(), len(data)
    while at + 8 <= limit:
        magic, size = struct.unpack_from("<II", data, at)
        if magic >> 4 == EMPTY_FRAME >> 4:
            if at + 8 + size > limit:
                yield None, "a skippable frame is cut off"
                return
            if magic == DICTIONARY_FRAME and at == 0:
                body = data[8 : 8 + size]
                try:
                    if struct.unpack_from("<I", body)[0] == FRAME:
                        body = zstandard.ZstdDecompressor().decompress(body)
                    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                except (zstandard.ZstdError, struct.error) as e:
                    yield None, f"the dictionary can't be read: {e}"
                    return
            at += 8 + size
        elif magic == FRAME:
            one, parts, to = unpacker.decompressobj(), [], at
            try:
                while not one.eof and to < limit:  # in steps, as what follows the frame is copied back
                    parts.append(one.decompress(data[to : to + STEP]))
                    to = min(to + STEP, limit)
            except zstandard.ZstdError as e:
                yield None, f"a frame can't be decoded: {e}"
                at = data.find(struct.pack("<II", EMPTY_FRAME, 0), at)  # on at the next record
                if at < 0:
                    return
                continue
            if not one.eof:
                yield None, "a frame is cut off"
                return
            at = to - len(one.unused_data)
            yield b"".join(parts), None
        else:
            yield None, "no Zstandard frame"
            return
    if at != limit:
        yield None, "bytes after the last frame"


def parse(raw: bytes) -> tuple:
    """A record's row in the order of SCHEMA; ValueError for headers or lengths that don't hold."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in fields:
            raise ValueError(f"a header that is malformed or given twice: {name[:40]}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdecimal() or int(fields["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as its header says")
    block, kind = rest[:-4], fields["warc-type"]
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http.replace(b"\r\n", b"\n"))
    if kind in ("response", "revisit") and (not sep or not length):
        raise ValueError("the HTTP head is missing or gives no length")
    size, name = int(length[1]) if length else len(payload), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and size != len(payload):
        raise ValueError("the payload is not as long as its head says")
    if kind == "response" and name != digest(payload):
        raise ValueError("the payload doesn't fit its digest")
    if kind == "revisit" and "warc-refers-to" not in fields:
        raise ValueError("a revisit that refers to nothing")
    number = lambda text: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", text)) else None
    return fields["warc-record-id"], number(fields["warc-record-id"]), kind, fields.get("warc-target-uri"), number(fields.get("warc-refers-to", "")), size, name, payload if kind == "response" else None, None


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all .warc.zst parts under `path`, columns of SCHEMA; payload is null for revisits, and for all if not asked for."""
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw, wrong in frames_of(content.as_buffer().to_pybytes()):
                    if wrong is None:
                        try:
                            r = parse(raw)
                            rows.append(r if payloads else (*r[:7], None, None))
                        except ValueError as e:
                            wrong = str(e)
                    if wrong is not None:
                        rows.append((None,) * 8 + (wrong,))
                    size += len(raw or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, SCHEMA)
