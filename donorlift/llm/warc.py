"""WARC archives in Zstandard (operator 4): writer and reader.

An archive starts with a skippable frame that carries a dictionary trained from
its own first records, followed by one Zstandard frame per record.  Archives are
cut at a size, made in the tasks and written by Spark's own writer, one row per
file: the committed files are all there or none, on any store, and survive lost
executors.  The writer ends a row with an empty skippable frame, which readers
of Zstandard pass over.

The reader takes whole archive files, loads the dictionary, decodes one frame
per record and checks each one: version line, required headers, Content-Length
against what is there, the two line ends behind it, and the digests of block
and payload.  A record that fails stops the read with its place.

Equal payloads are stored once: the smallest page_id is the response, the
others are revisits that refer to it and hold HTTP headers only.  Who is first
is found by an aggregation of digests.

Defined results: a null html is an empty payload and like others subject to
revisits; payloads below ``least_bytes`` are all responses; pages of any length
are one record; each repeated row is a record, and all rows of the smallest
page_id of a payload are responses; a null page_id is the first of its payload
only if no other row has it, and comes back as null; a null url is written as
``urn:null``; no pages give no archive and no records; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlift.llm.common import batch, materialise, shared_path, table, tidy
from donorlift.llm.queries import query

LEAST_BYTES = 0
#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 16 << 20
#: Records and bytes of an archive that its dictionary is trained from, and the
#: dictionary's own size.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 200, 1 << 20, 32 << 10
LEVEL = 3
# Magic numbers of the formats.
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # skippable frame 0x184D2A50 of length 0
ZSTD_FRAME = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record(page_id, url, payload: bytes, digest: str, row: int, refers_to=None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http + (payload if refers_to is None else b"")
    target = "urn:null" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{row}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, "", ""]).encode("utf-8") + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """An archive of the records, with a dictionary if one can be trained."""
    samples, size = [], 0
    for r in records[:TRAIN_RECORDS]:
        samples.append(r[:TRAIN_BYTES])
        size += len(samples[-1])
        if size >= TRAIN_BYTES:
            break
    out, dictionary = [], None
    if len(samples) >= 8 and size >= 8 * DICTIONARY_BYTES:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:  # too little variety: frames stand alone
            dictionary = None
    if dictionary is not None:
        raw = dictionary.as_bytes()
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return b"".join([*out, *(packer.compress(r) for r in records)])


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, decoded record) of every data frame of an archive."""
    at, dictionary = 0, None
    unpacker = zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError(f"broken frame at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic == DICTIONARY_FRAME and at == 0:
            raw = data[8 : 8 + size]
            if raw[:4] == struct.pack("<I", ZSTD_FRAME):  # the dictionary may be compressed itself
                raw = unpacker.decompress(raw)
            dictionary = zstandard.ZstdCompressionDict(raw)
            unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
        elif magic in SKIPPABLE:
            at += 8 + size
        elif magic == ZSTD_FRAME:
            one, text, fed, step = unpacker.decompressobj(), [], at, 1 << 14
            while not one.eof and fed < len(data):  # in steps: what lies behind the frame is not copied
                text.append(one.decompress(data[fed : fed + step]))
                fed, step = min(len(data), fed + step), 2 * step
            if not one.eof:
                raise ValueError(f"broken frame at {at}")
            yield at, b"".join(text)
            at = fed - len(one.unused_data)
        else:
            raise ValueError(f"no Zstandard frame at {at}")
        if at > len(data):
            raise ValueError("the last frame is cut off")


def parse(raw: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, checked."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[: max(end, 0)].decode("utf-8").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record at {at}")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"broken header at {at}: {line[:80]!r}")
        head[name.strip()] = value.strip()
    missing = [n for n in REQUIRED if n not in head]
    if missing:
        raise ValueError(f"record at {at} lacks {missing}")
    size = int(head["Content-Length"])
    block, tail = raw[end + 4 : end + 4 + size], raw[end + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError(f"record at {at}: Content-Length is {size}, the record holds {len(raw) - end - 8}")
    if "WARC-Block-Digest" in head and head["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
        raise ValueError(f"record at {at}: wrong block digest")
    return head, block


def payload_of(head: dict[str, str], block: bytes, at: int) -> bytes:
    """The HTTP body of a response, checked against its digest and length."""
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError(f"record at {at}: no HTTP headers")
    body = block[cut + 4 :]
    if head["WARC-Type"] == "response":
        if head["WARC-Payload-Digest"] != "sha1:" + base32_sha1(body) or int(head["WARC-Payload-Length"]) != len(body):
            raise ValueError(f"record at {at}: wrong payload digest or length")
    elif body:
        raise ValueError(f"record at {at}: a revisit holds a payload")
    return body


def with_first(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the page with the same
    payload that is the response, null for responses.

    Digests that occur once are told by an aggregation; only the table of
    repeated ones is joined back."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"))
    key = rows.select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("d"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    firsts = key.groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1 and first is not null")
    firsts = materialise(firsts.select("d", "first"), "digests", compact=True)
    return rows.withColumn("d", F.sha1(F.col("html").cast("binary"))).join(firsts, "d", "left").withColumn("refers_to", F.when(F.octet_length("html") >= least_bytes, F.col("first"))).select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to")), F.col("refers_to")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the pages (page_id, url, html) as archives under ``path``."""

    def run(it):
        held, size, n = [], 0, 0
        for b in it:
            for page_id, url, html, refers in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                payload = html.encode("utf-8")
                held.append(record(page_id, url, payload, base32_sha1(payload), n, refers))
                size += len(held[-1])
                n += 1
                if size >= archive_bytes:
                    yield pa.record_batch([pa.array([archive(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([archive(held)], pa.binary())], ["archive"])

    made = with_first(pages, least_bytes).mapInArrow(tidy(run), "archive binary")
    # raw bytes through the text writer, one archive per file
    made.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME).text(path)
    return path


RECORD = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``; ``payload`` is null for
    revisits and if ``payloads`` is off."""

    def run(it):
        for b in it:
            for j in range(b.num_rows):
                cols: list[list] = [[] for _ in _RECORD]
                size = 0
                for at, raw in frames(b.column(0)[j].as_py()):
                    head, block = parse(raw, at)
                    body = payload_of(head, block, at)
                    page = head["WARC-Record-ID"].split(":")[2]
                    refers = head.get("WARC-Refers-To")
                    response = head["WARC-Type"] == "response"
                    uri = head.get("WARC-Target-URI")
                    row = (int(page) if page else None, None if uri == "urn:null" else uri, head["WARC-Type"], int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(refers.strip("<>").split(":")[2]) if refers else None, body if payloads and response else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    size += len(raw)
                    if size >= 4 << 20:
                        yield batch(_RECORD, *cols)
                        cols, size = [[] for _ in _RECORD], 0
                if cols[0]:
                    yield batch(_RECORD, *cols)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(tidy(run), RECORD)


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(CAST(encode(h) AS BLOB)) AS n, sha1(h) AS x FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(x, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform([1, 2, 3, 4, 5], lambda j: CAST(substr(bits, CAST(5 * k + j AS BIGINT), 1) AS INTEGER) * (1 << (5 - j)))) AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM b
"""


@query("op4_warc", SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), shared_path(spark, "warc"))
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
