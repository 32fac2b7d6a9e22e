"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are written to the shared folder by the executors and listed in a manifest that Spark
commits with the stage: files that a lost or repeated attempt left behind are in no manifest and
are never read. The reader takes an archive's dictionary from its first frame, decodes one frame
at a time and checks the version line, the mandatory headers, the lengths and the digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.work import folder, passing, probed, stored

#: Magic of the skippable frame that holds a dictionary, as the format's description has it.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_BYTES = 16_384
SAMPLES = 64
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class InvalidRecord(ValueError):
    """A record or frame breaks the format."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def one_line(value: str) -> str:
    """A header value without line breaks or control characters, which would end the header."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def http_block(size: int, payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the response's headers, with the full payload's length, and no payload."""
    block = http_block(size, b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {one_line(url)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Headers and payload of one record; raises InvalidRecord where a header, a length or the digest doesn't hold."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not cut or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise InvalidRecord("no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise InvalidRecord(f"not a header: {line[:60]}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise InvalidRecord(f"header {name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise InvalidRecord("the block's length is not what its header says")
    http, cut, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not cut or len(sizes) != 1 or not sizes[0].isdigit():
        raise InvalidRecord("no HTTP head in the block")
    size, revisit, digest = int(sizes[0]), fields["warc-type"] == "revisit", fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise InvalidRecord("the payload is not what its headers say")
    if revisit and (payload or "warc-refers-to" not in fields):
        raise InvalidRecord("a revisit with a payload or without a record that it refers to")
    return {"fields": fields, "payload": payload, "size": size, "digest": digest, "revisit": revisit}


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the first sample's bytes as raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(16, b"\x00")


class Writer:
    """Archives below a folder, a new one whenever ARCHIVE_BYTES are reached."""

    def __init__(self, uri: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(uri)
        self.uri, self.out, self.done, self.waiting = uri.rstrip("/"), None, [], []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.waiting.append(data)
            if len(self.waiting) >= SAMPLES or sum(map(len, self.waiting)) > ARCHIVE_BYTES // 8:
                self.open()
            return
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.bytes += len(frame)
        self.records += 1
        if self.bytes >= ARCHIVE_BYTES:
            self.close()

    def open(self) -> None:
        dictionary = dictionary_of([x[:32_768] for x in self.waiting])
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.fs.create_dir(self.path, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)  # else the name's ending has it compressed again
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
        self.bytes, self.records, waiting, self.waiting = 8 + len(packed), 0, self.waiting, []
        for x in waiting:
            self.add(x)

    def close(self) -> None:
        if self.waiting:
            self.open()
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.uri}/{self.name}", self.records, self.bytes))
            self.out = None


def read_dictionary(stream) -> bytes:
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise InvalidRecord("the archive does not begin with a dictionary's frame")
    size = struct.unpack("<I", head[4:])[0]
    data = stream.read(size)
    if len(data) != size:
        raise InvalidRecord("the dictionary is cut off")
    return zstandard.ZstdDecompressor().decompress(data) if data[:4] == struct.pack("<I", FRAME_MAGIC) else data


def frames(stream, dictionary: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of one frame after the other; at most a piece and the record at hand are held."""
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    left = stream.read(piece)
    while left:
        one, out = decompressor.decompressobj(), []
        while not one.eof:
            if not left and not (left := stream.read(piece)):
                raise InvalidRecord("the last frame is cut off")
            out.append(one.decompress(left))
            left = one.unused_data if one.eof else b""
        yield b"".join(out)
        left = left or stream.read(piece)


def records_of(uri: str) -> Iterator[dict]:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        for data in frames(stream, read_dictionary(stream)):
            yield parsed(data)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1), response_id of every page: the smallest page_id among equal payloads.

    Payloads are equal if their SHA-256 and lengths are. Rows with the smallest page_id of a payload,
    more than one if rows repeat, are responses. A null page_id is smallest only among nulls. Only payloads that may
    occur more than once are moved.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("h", F.xxhash64("payload"))
    named = lambda df: df.withColumns({"key": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload")})
    first = named(rows).groupBy("key", "size", "h").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = stored(first, "warc-responses")
    again = named(passing(rows, "h", first)).join(first.drop("h"), ["key", "size"], "left")
    once = probed(rows, "h", first, "left_anti").select("page_id", "url", "payload", F.col("page_id").alias("response_id"))
    return once.union(again.select("page_id", "url", "payload", F.coalesce("response_id", "page_id")))


def write(pages: DataFrame) -> DataFrame:
    """Write a record per page to archives in the shared folder: the manifest (path, records, bytes) of what was committed."""
    uri = folder(pages.sparkSession, "warc")

    def run(batches):
        writer = Writer(uri)
        for batch in batches:
            for page_id, url, payload, response in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "response_id")), strict=True):
                revisit = page_id != response
                writer.add(record(page_id, url, payload, len(payload), base32_sha1(payload), response if revisit else None, revisit))
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in writer.done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return stored(planned(pages).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the manifest's archives, payload if asked for."""
    number = lambda urn: int(n) if (n := urn.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches):
        for batch in batches:
            for uri, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows: list[tuple] = []
                count = held = 0
                for r in records_of(uri):
                    f = r["fields"]
                    rows.append((number(f["warc-record-id"]), f.get("warc-target-uri"), r["size"], r["digest"], f["warc-type"], number(f["warc-refers-to"]) if r["revisit"] else None, r["payload"] if payloads else None))
                    count, held = count + 1, held + (len(r["payload"]) if payloads else 0)
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if count != expected:
                    raise InvalidRecord(f"{uri} holds {count} records, not {expected}")
                yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    spread = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism, "path")
    out = spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) to archives and read them back: a row per page.

    A null html is an empty payload, and empty payloads are revisits of the smallest page_id among
    them like any other; a null url leaves the target out; repeated rows of the response are
    responses too. An empty table writes no archive and gives an empty result.
    """
    return read(write(pages)).drop("url")
