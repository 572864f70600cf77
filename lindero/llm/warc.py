"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

Reading takes a table with a binary column content, a whole archive per row: Spark's binaryFile
source over *.warc.zst files, or the table that write_archives makes. The dictionary is loaded from
the skippable frame with magic number 0x184D2A5D (itself raw or compressed), then each frame is
decoded by itself and must be exactly one record, whose headers, block length, HTTP length and
digests are checked. A record that fails gives a row with its error, and the records after it are
still read; where the archive itself is cut off, the last row says so.

Cases: a null or empty payload is an empty response. Null ids are written as "-" and read as null.
Payloads with equal bytes: the one with the largest id is the response, the others revisits of it;
rows that share both id and payload are all responses. A null or cut archive gives an error row; an
empty table none. Very long payloads are single frames. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import likely, table, written

DICT_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: Payload bytes of an archive, about; a longer payload is an archive's only or last one.
ARCHIVE_BYTES = 4 << 20
DICT_BYTES = 16 << 10
DICT_SAMPLES = 128
LEVEL = 3

ROW = "archive string, offset long, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary, error string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or where refers_to is given a revisit, which keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(uri or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = LEVEL, dict_bytes: int = DICT_BYTES) -> bytes:
    """One frame per record behind the dictionary's skippable frame; without one if too few records share text."""
    import zstandard

    trained = None
    if len(records) >= 16:
        try:
            trained = zstandard.train_dictionary(dict_bytes, [r[: 16 << 10] for r in records[:: max(1, len(records) // DICT_SAMPLES)]], level=level)
        except zstandard.ZstdError:
            pass
    out = []
    if trained is not None:
        raw = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
        out += [DICT_MAGIC, len(raw).to_bytes(4, "little"), raw]
    pack = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    return b"".join(out + [pack.compress(r) for r in records])


def frame_end(data: bytes, at: int) -> int:
    """The end of the frame that begins at at, from its header and block headers; ValueError if it is cut off."""
    if data[at : at + 4] != FRAME_MAGIC or at + 5 > len(data):
        raise ValueError("no frame here")
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = (0, 1, 2, 4)[flags & 3] + (flags >> 6 and 1 << (flags >> 6) or single) + (1 - single)
    pos = at + 5 + size
    while True:
        if pos + 3 > len(data):
            raise ValueError("frame is cut off")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise ValueError("frame is cut off")
    return pos


def parse(raw: bytes) -> dict:
    """The fields of one record; ValueError says what is wrong with it."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise ValueError("malformed header line")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit():
        raise ValueError("content-length is no number")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) < length or rest[length:] != b"\r\n\r\n":
        raise ValueError("content-length does not match the record")
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{digest(block)}":
        raise ValueError("block digest does not match")
    out = {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"].strip("<>"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload": None, "payload_bytes": None}
    if fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if not found or not http.startswith(b"HTTP/"):
            raise ValueError("malformed HTTP header")
        out["payload_bytes"] = int(told[1]) if told else len(payload)
        if out["record_type"] == "response":
            if told and len(payload) != int(told[1]):
                raise ValueError("HTTP content-length does not match the payload")
            if out["payload_digest"] and out["payload_digest"] != digest(payload):
                raise ValueError("payload digest does not match")
            out["payload"] = payload
    else:
        out["payload"], out["payload_bytes"] = block, length
    return out


def records_of(data: bytes | None) -> Iterator[tuple[int, dict]]:
    """Offset and fields (or error) of each record of an archive."""
    import zstandard

    if data is None:
        yield 0, {"error": "no archive"}
        return
    at, known = 0, None
    if data[:4] == DICT_MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        raw = data[8:at]
        try:
            if len(raw) < at - 8:
                raise ValueError("dictionary frame is cut off")
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompressobj().decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
        except (zstandard.ZstdError, ValueError) as e:
            yield 0, {"error": str(e)}
            return
    unpack = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        if data[at + 1 : at + 4] == b"\x2a\x4d\x18" and data[at] >> 4 == 5:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        try:
            end = frame_end(data, at)
        except ValueError as e:
            yield at, {"error": str(e)}
            return
        try:
            yield at, parse(unpack.decompressobj().decompress(data[at:end]))
        except (zstandard.ZstdError, ValueError) as e:
            yield at, {"error": str(e)}
        at = end


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in the column content (name: path or archive), as ROW."""
    name = next((c for c in ("path", "archive") if c in archives.columns), None)
    schema = ROW if payloads else ROW.replace("payload binary, ", "")
    fields = [x.split()[0] for x in schema.split(", ")]
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for at, got in records_of(batch.column(1)[k].as_py()):
                    rows.append(got | {"archive": batch.column(0)[k].as_py(), "offset": at})
                    size += len(got.get("payload") or b"")
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in fields})
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in fields})

    return archives.select((F.col(name) if name else F.lit(None)).cast("string").alias("archive"), "content").mapInArrow(read, schema)


def archives_of(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, content) with a record for each row of pages (page_id, url, html).

    Which row of equal payloads is the response is found on their digests alone, summed before they
    travel. Pages whose digest cannot occur twice, by a bitmap of those that do, are written where
    they are read; the others are joined, in a join whose large keys Spark can split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    first = written(rows.groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1 and response_id is not null").select(F.col("sha").alias("same"), "response_id"), "responses")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": pa.array([f"{part:06d}-{made:06d}.warc.zst"]), "content": pa.array([archive(held)], pa.binary())})

        for batch in batches:
            for page_id, url, html, response in zip(*(batch.column(k) for k in range(4))):
                page_id, response, payload = page_id.as_py(), response.as_py(), html.as_buffer().to_pybytes()
                held.append(record(page_id, url.as_py(), payload, None if response == page_id else response))
                size += len(payload)
                if size >= archive_bytes:
                    yield out()
                    made, held, size = made + 1, [], 0
        if held:
            yield out()

    tested = likely(rows, "sha", first.select("same"), first.count(), "twice")
    alone = tested.where(~F.col("twice")).select("page_id", "url", "html", F.lit(None).cast("long").alias("response_id"))
    joined = tested.where("twice").join(first, F.col("sha") == F.col("same"), "left").select("page_id", "url", "html", "response_id")
    return alone.unionByName(joined).mapInArrow(write, "archive string, content binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_archives(written(archives_of(table(spark, sf_dir, "pages")), "warc"), payloads=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(-?[0-9]+)$', 1) as bigint)")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "error")
