"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are written and read through Spark's own file formats, so any store that Spark reaches will do.  The text
sink writes a separator after each row; here that is an empty skippable frame, which the format allows anywhere.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import new_folder

# Fixed values of the formats (Zstandard frame format, RFC 8878; Zstandard in WARC, version 1.0).
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 8_000_000
DICTIONARY_BYTES = 16_384
_SAMPLE_BYTES = 2_000_000


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record, or a revisit record if refers_to is not None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>", f"WARC-Date: {date}"]
    head += [f"WARC-Page-ID: {page_id}"] * (page_id is not None)
    head += ["WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A")] * bool(url)
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary trained on some records; where they are too few, the records themselves."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def frame_size(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame that begins at a place, from its header and block headers."""
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        size = 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        while True:
            a = at + size
            block = data[a] | data[a + 1] << 8 | data[a + 2] << 16
            size += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
    except IndexError:
        raise WarcError(f"frame at {at} is cut off") from None
    size += 4 * (flags >> 2 & 1)
    if at + size > len(data):
        raise WarcError(f"frame at {at} is cut off")
    return size


def frames(archive: bytes):
    """Decoded records of an archive, frame by frame."""
    data = memoryview(archive)
    at, reader = 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("dictionary is cut off")
        raw = bytes(data[8 : 8 + size])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw:
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        at = 8 + size
    while at < len(data):
        if at + 8 > len(data):
            raise WarcError(f"{len(data) - at} bytes are left over")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            at += 8 + size
            if at > len(data):
                raise WarcError("skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at {at}")
        n = frame_size(data, at)
        try:
            yield reader.decompressobj().decompress(data[at : at + n])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from None
        at += n


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; checks version, headers and lengths."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"block has {len(rest) - 4} bytes, not {fields['content-length']}")
    return fields, rest[:-4]


def payload(fields: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Length of the full payload, and the payload where the record holds it; checks both against the headers."""
    http, mark, body = block.partition(b"\r\n\r\n")
    size = next((line.partition(b":")[2].strip() for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), b"")
    if not mark or not size.isdigit():
        raise WarcError("no HTTP response")
    if fields["warc-type"] == "revisit":
        if body:
            raise WarcError("a revisit has a payload")
        return int(size), None
    if len(body) != int(size):
        raise WarcError(f"payload has {len(body)} bytes, not {int(size)}")
    if "sha256:" + hashlib.sha256(body).hexdigest() != fields.get("warc-payload-digest"):
        raise WarcError("payload digest differs")
    return len(body), body


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record per row into archives of about eight megabytes of payload in a new folder.

    Null payloads are empty.  Of equal payloads of 100 bytes or more the row with the smallest id is the response
    and the others refer to it (rows that share that id are all responses); null ids come last.  An empty table
    gives a folder without records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    slim = rows.select("id", "digest", F.octet_length("payload").alias("n"))
    first = slim.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1 and first is not null").select("digest", "first")
    refers = slim.join(first, "digest").where("id is null or id <> first").select("id", "digest", "first").distinct()
    total = int(pages.agg(F.sum(F.octet_length(F.col(html_col).cast("string")))).first()[0] or 0)
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ARCHIVE_BYTES))
    key = F.coalesce("id", F.lit(-(1 << 63)))
    refers = refers.select(key.alias("k"), "digest", "first")
    dealt = rows.withColumn("k", key).repartition(n, "k", "digest").join(refers, ["k", "digest"], "left").select("id", "url", "payload", "digest", "first")

    def compress(batches):
        held: list[bytes] = []
        size, packer = 0, None

        def flush():
            nonlocal packer
            dictionary = train(held)
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True) if dictionary else zstandard.ZstdCompressor(level=3, write_checksum=True)
            return [dictionary_frame(dictionary), *(packer.compress(r) for r in held)]

        for b in batches:
            out = []
            for i, u, p, d, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = record(i, u, p, d, f, date)
                if packer is None:
                    held.append(r)
                    size += len(r)
                    if size >= _SAMPLE_BYTES:
                        out += flush()
                else:
                    out.append(packer.compress(r))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
        if packer is None and held:
            yield pa.RecordBatch.from_arrays([pa.array(flush(), pa.binary())], names=["frame"])

    dealt.mapInArrow(compress, "frame binary").select(F.col("frame").cast("string").alias("frame")).write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(path)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives in a folder; an archive or record that breaks the format is an error."""

    def decode(batches):
        for b in batches:
            for k in range(b.num_rows):
                cols: list[list] = [[] for _ in range(7)]
                for raw in frames(b.column(0)[k].as_buffer().to_pybytes()):
                    fields, block = parse(raw)
                    n, body = payload(fields, block)
                    number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                    row = (number("warc-page-id"), fields.get("warc-target-uri"), n, fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"], number("warc-refers-to-page-id"), body if with_payload else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(decode, RECORDS)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Writes archives of all pages to the shared folder and reads them back."""
    path = new_folder(spark, "tabsieve-warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
