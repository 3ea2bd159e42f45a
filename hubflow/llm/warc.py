"""WARC archives compressed by Zstandard with a dictionary: one frame a record, the dictionary in a skippable frame at the start."""

import hashlib
import re
import struct
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.memory import give_back
from hubflow.llm.scratch import release, written
from hubflow.llm.tokens import sc_broadcast

#: Fixed values of the formats: the skippable frame that holds a dictionary, a Zstandard frame, a Zstandard dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records, before compression, after which an archive ends.
ARCHIVE = 16 << 20
#: Payloads of at least so many bytes are stored once.
LEAST = 1000
#: The sample that the dictionary is trained on: pages, the bytes of each, and the dictionary's size. It bears on the archives' size alone.
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 2000, 8192, 112_640
LEVEL = 3
#: Groups of copies with more than one in so many of all copied rows: there are at most so many of them.
HOT = 1000
#: The pages have no time of capture.
DATE = "1970-01-01T00:00:00Z"
#: Bytes of an archive that the reader decodes at once.
STEP = 1 << 14

_ID = re.compile(r"<urn:x-page:(-?\d*):(\d+)>")
_FIELD = re.compile(rb"([!#-'*+\-.^-z|~A-Z0-9]+):[ \t]*(.*?)[ \t]*")
RECORDS = "page_id long, url string, record_type string, refers_to long, record_id string, refers_to_record string, payload_bytes long, payload_digest string, payload binary, path string, offset long, length long"


@dataclass(frozen=True)
class Record:
    """A decoded record and where its frame lies in its archive."""

    fields: dict[str, str]
    block: bytes
    offset: int
    length: int


class BadArchive(ValueError):
    """An archive that doesn't keep to its format."""


def head(lines: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"


def safe(url: str) -> str:
    """url without control characters and spaces, which would end its header: they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0], safe=""), url)


def record(kind: str, number: str, payload: bytes, size: int, digest: str, url: str | None, refers_to: str | None = None) -> bytes:
    """A response with its payload, or a revisit with the headers of the answer alone."""
    block = b"HTTP/1.1 200 OK\r\n" + head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))])
    block += payload if kind == "response" else b""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", number), ("WARC-Date", DATE)]
    lines += [("WARC-Target-URI", safe(url))] if url is not None else []
    lines += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)] if refers_to else []
    lines += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + head(lines) + block + b"\r\n\r\n"


def dictionary_frame(data: bytes) -> bytes:
    """The skippable frame at an archive's start; without a dictionary nothing."""
    if not data:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(data)
    packed = packed if len(packed) < len(data) else data
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def leading_dictionary(data: memoryview) -> tuple[bytes, int]:
    """The dictionary of an archive, and where its records begin. Archives without one begin with a record."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return b"", 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise BadArchive("the dictionary's frame is cut off")
    load = bytes(data[8 : 8 + size])
    magic = struct.unpack_from("<I", load)[0] if size >= 4 else 0
    if magic == FRAME:
        try:
            load = zstandard.ZstdDecompressor().decompress(load)
        except zstandard.ZstdError as e:
            raise BadArchive(f"the dictionary can't be decoded: {e}") from None
        magic = struct.unpack_from("<I", load)[0] if len(load) >= 4 else 0
    if magic != DICTIONARY:
        raise BadArchive("the leading frame holds no dictionary")
    return load, 8 + size


def frames(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each frame after the dictionary; other skippable frames are passed over."""
    load, at = leading_dictionary(data)
    made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(load)) if load else zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        frame, end, out = made.decompressobj(), at, []
        try:
            while not frame.eof and end < len(data):
                out.append(frame.decompress(data[end : end + STEP]))
                end = min(end + STEP, len(data))
        except zstandard.ZstdError as e:
            raise BadArchive(f"the frame at {at} can't be decoded: {e}") from None
        if not frame.eof:
            raise BadArchive(f"the frame at {at} is cut off")
        end -= len(frame.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def fields(lines: bytes, at: int) -> dict[str, str]:
    """Header fields by lower-case name; the lines end in CRLF and each is used once."""
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        m = _FIELD.fullmatch(line)
        if not m or (name := m[1].decode().lower()) in out:
            raise BadArchive(f"record at {at}: not a header, or a second one: {line[:80]!r}")
        out[name] = m[2].decode("utf-8", "replace")
    return out


def whole(text: str | None, name: str, at: int) -> int:
    if not re.fullmatch(r"\d{1,18}", text or "", re.ASCII):
        raise BadArchive(f"record at {at}: {name} is {text!r}")
    return int(text)


def parsed(content: bytes, offset: int, length: int) -> Record:
    """The one record of a frame: version, headers, a block of just the stated length, two line ends."""
    split = content.find(b"\r\n\r\n")
    version, _, lines = content[: max(split, 0)].partition(b"\r\n")
    if split < 0 or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise BadArchive(f"record at {offset}: no WARC header")
    found = fields(lines, offset)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not found.get(name):
            raise BadArchive(f"record at {offset}: no {name}")
    size = whole(found["content-length"], "Content-Length", offset)
    block, tail = content[split + 4 : split + 4 + size], content[split + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise BadArchive(f"record at {offset}: its block isn't of {size} bytes and two line ends")
    digest = found.get("warc-block-digest")
    if digest and digest != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise BadArchive(f"record at {offset}: its block has another digest")
    return Record(found, block, offset, length)


def records(data: bytes) -> Iterator[Record]:
    for at, size, content in frames(memoryview(data)):
        yield parsed(content, at, size)


def answer(r: Record) -> tuple[int, str, bytes | None]:
    """Bytes and digest of the whole payload, and, of a response, the payload; held against the headers."""
    top, found, payload = r.block.partition(b"\r\n\r\n")
    status, _, lines = top.partition(b"\r\n")
    if not found or not status.startswith(b"HTTP/"):
        raise BadArchive(f"record at {r.offset}: its block is no HTTP answer")
    size = whole(fields(lines, r.offset).get("content-length"), "the answer's Content-Length", r.offset)
    algorithm, _, digest = r.fields.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1" or not re.fullmatch("[0-9a-f]{40}", digest):
        raise BadArchive(f"record at {r.offset}: no payload digest")
    if r.fields["warc-type"] == "revisit":
        if payload or r.fields.get("warc-profile") != PROFILE or not r.fields.get("warc-refers-to"):
            raise BadArchive(f"record at {r.offset}: not a revisit of an identical payload")
        return size, digest, None
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise BadArchive(f"record at {r.offset}: its payload isn't of the stated length and digest")
    return size, digest, payload


def page_of(record_id: str) -> tuple[int | None, int]:
    m = _ID.fullmatch(record_id)
    if not m:
        raise BadArchive(f"not the id of a page's record: {record_id}")
    return int(m[1]) if m[1] else None, int(m[2])


def train(pages: DataFrame, sample: int = SAMPLE) -> bytes:
    """A dictionary of at most DICT_BYTES from the first SAMPLE_BYTES of at most so many pages, dealt by a hash of their numbers; empty if they are too few or too alike. Only rows whose hash is under twice the sample's share are looked at, so tasks send few, however many there are."""
    full = pages.where("bytes > 0")
    space, n = 1 << 40, full.count()
    draw = F.pmod(F.xxhash64("number"), F.lit(space))
    chosen = full.where(draw < F.lit(min(space, 2 * sample * space // max(n, 1)))).select(draw.alias("draw"), "number", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")).orderBy("draw", "number").limit(sample)
    try:
        return zstandard.train_dictionary(DICT_BYTES, [bytes(r.payload) for r in chosen.collect()]).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_keepers(pages: DataFrame, least: int) -> DataFrame:
    """pages with keeper (page_id, number): of the rows with an equal payload of at least so many bytes the one with the largest page_id, of equal ones the last; null where it is the row itself or there are no copies.

    Groups that hold more than one in HOT of the copied rows, at most HOT, are broadcast; only rows of other groups have
    to meet theirs, and rows in no such group are dealt by their own number.
    """
    own = F.struct("page_id", "number")
    groups = written(pages.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max(own).alias("keeper"), F.count("*").alias("copies")).where("copies > 1"), "warc-copies")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    hot = groups.where(F.col("copies") * HOT > total).select(F.col("digest").alias("hot_digest"), F.col("bytes").alias("hot_bytes"), F.col("keeper").alias("hot"))
    some = groups.where(F.col("copies") * HOT <= total).select(F.col("digest").alias("key"), F.col("bytes").alias("size"), "keeper")
    met = pages.join(F.broadcast(hot), (pages["digest"] == hot["hot_digest"]) & (pages["bytes"] == hot["hot_bytes"]), "left")
    alone = F.col("hot").isNotNull() | (F.col("bytes") < least)
    met = met.withColumn("key", F.when(alone, F.concat(F.lit("-"), F.col("number").cast("string"))).otherwise(F.col("digest"))).withColumn("size", F.col("bytes"))
    out = met.join(some, ["key", "size"], "left").withColumn("keeper", F.coalesce("hot", "keeper"))
    return out.withColumn("keeper", F.when(F.col("keeper.number") != F.col("number"), F.col("keeper"))).select(*pages.columns, "keeper")


def _urn(page_id: Column, number: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), number.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, least: int = LEAST, archive: int = ARCHIVE) -> DataFrame:
    """Archives (path, content) of all pages (page_id, url, html), written in the shared folder: one record a row.

    Of rows with equal payloads (html in UTF-8, null as empty) of at least `least` bytes that with the largest page_id is a
    response and the others revisit it; of rows that share this page_id too, one is. Null page_ids are smaller
    than all others. Smaller payloads are all responses. An archive ends with the record that takes it to `archive`
    bytes, so a longer record is the last of its archive. Other columns are ignored; an empty table gives no archives.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # written first: a row's number and its text must stay together
    rows = written(given.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long"), "number": F.monotonically_increasing_id()}), "warc-pages")
    shared = sc_broadcast(pages, train(rows))
    kept = with_keepers(rows, least)
    kept = kept.select("url", "digest", "bytes", F.when(F.col("keeper").isNull(), F.col("payload")).alias("payload"), _urn(F.col("page_id"), F.col("number")).alias("id"), F.when(F.col("keeper").isNotNull(), _urn(F.col("keeper.page_id"), F.col("keeper.number"))).alias("refers_to"))

    def write(batches):
        load = shared.value
        start, task = dictionary_frame(load), TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(load)) if load else zstandard.ZstdCompressor(level=LEVEL)
        out, total, number = [], 0, 0

        def done():
            return pa.record_batch([pa.array([f"pages-{task:06d}-{number:06d}.warc.zst"]), pa.array([b"".join((start, *out))], pa.binary())], names=["path", "content"])

        for batch in batches:
            for url, digest, size, payload, name, refers_to in zip(*(batch[c].to_pylist() for c in ("url", "digest", "bytes", "payload", "id", "refers_to")), strict=True):
                made = record("revisit" if refers_to else "response", name, payload or b"", size, digest, url, refers_to)
                out.append(packer.compress(made))
                total += len(made)
                if total >= archive:
                    yield done()
                    out, total, number = [], 0, number + 1
            give_back()
        if out:
            yield done()

    made = written(kept.mapInArrow(write, "path string, content binary"), "warc-archives")
    release(rows)
    return made


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each response and revisit in archives (path, content; spark.read.format("binaryFile") gives these): RECORDS.

    payload_bytes and payload_digest are those of the full payload; payload is null for a revisit. offset and length tell
    where the record's frame lies. An archive whose dictionary, frames, headers, lengths or digests don't hold is an error
    that names it. Records of other types are passed over. An archive is in one task's memory as
    a whole, with one record decoded at a time; those that write_archives makes hold some 16 MB of records.
    """

    def read(batches):
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows, held = [], 0
                try:
                    for r in records(memoryview(content.as_buffer())):
                        if r.fields["warc-type"] not in ("response", "revisit"):
                            continue
                        size, digest, payload = answer(r)
                        page, _ = page_of(r.fields["warc-record-id"])
                        other = r.fields.get("warc-refers-to")
                        rows.append((page, r.fields.get("warc-target-uri"), r.fields["warc-type"], page_of(other)[0] if other else None, r.fields["warc-record-id"], other, size, digest, payload, path, r.offset, r.length))
                        held += len(payload or b"")
                        if held >= 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                except BadArchive as e:
                    raise BadArchive(f"{path}: {e}") from None
                yield made(rows)
            give_back()

    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(", ")]

    def made(rows):
        columns = zip(*rows, strict=True) if rows else ((),) * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return archives.select("path", "content").mapInArrow(read, RECORDS)


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files in folder (a URI that pyarrow.fs knows), each under another name first and then renamed, so a task that runs again does no harm. Gives path and bytes of each once it is run."""

    def export(batches):
        from pyarrow.fs import FileSystem

        fs, top = FileSystem.from_uri(folder)
        fs.create_dir(top)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                part = f"{top}/.{path}.{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                fs.move(part, f"{top}/{path}")
                yield pa.record_batch([pa.array([f"{folder}/{path}"]), pa.array([content.as_buffer().size])], names=["path", "bytes"])

    return archives.select("path", "content").mapInArrow(export, "path string, bytes long")


def op12_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM k"""
