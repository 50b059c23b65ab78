"""Operator 4: WARC archives compressed record by record with a dictionary of their own.

``write`` deals pages into archives of about ``ARCHIVE_BYTES`` of payload.  An
archive is one file of the ``.warc.zst`` layout: a leading skippable frame (magic
0x184D2A5D) that embeds a Zstandard dictionary built from records of that archive,
then one frame for each record, so any record can be read alone.  Archives are
rows (archive, records, data) of a table in the shared folder, as a cluster's
store may be one that only Spark writes to; ``export`` has the executors write them out as
files of a folder that is mounted on all of them, and ``load`` reads such files by Spark.

Of pages with equal payloads of at least ``LEAST`` bytes, the one with the smallest
page_id is a response and the others revisit it, without the payload; smaller
payloads are all responses.  The smallest id of a payload is a minimum combined
before the shuffle, and only payloads that occur twice meet the pages, so a payload
that a third of all pages share stays cheap.

Null html is an empty payload.  Pages with a null page_id are responses that nothing
refers to.  Repeated rows are records of their own; all that hold the smallest id
of their payload are responses.  Line breaks in a url are written as %0D and %0A.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.textkit import partitions, settle

LEAST, ARCHIVE_BYTES, LEVEL = 100, 16 << 20, 3
#: The dictionary: its size at most, and the bytes of records spread evenly over
#: the archive that it is built from.
DICT_BYTES, DICT_SAMPLE = 112640, 4 << 20
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Tasks that write archives at most, unless the session has more shuffle partitions.
MOST_TASKS = 10_000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TABLE = "archive long, records long, data binary"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit of refers_to."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = http
    else:
        body = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, body) of a WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """An archive: the dictionary in a skippable frame, then a frame a record."""
    total = sum(map(len, records))
    step = max(1, -(-total // DICT_SAMPLE))
    sample = records[::step]
    dictionary = b""
    try:
        size = min(DICT_BYTES, max(256, sum(map(len, sample)) // 10))
        dictionary = zstandard.train_dictionary(size, sample, k=256, d=8, f=18, level=level).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few records for one
        pass
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    one = zstandard.ZstdCompressor(level=level, write_checksum=True, **shared)
    return b"".join([struct.pack("<II", SKIPPABLE, len(dictionary)), dictionary, *map(one.compress, records)])


def _frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at a place ends."""
    if struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError("not a Zstandard frame")
    checked = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a run-length block holds one byte
        if block & 1:
            return at + 4 * checked


def records(data: bytes):
    """The records of an archive, one after another."""
    magic, size = struct.unpack_from("<II", data, 0)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    shared = {"dict_data": zstandard.ZstdCompressionDict(data[8 : 8 + size])} if size else {}
    one = zstandard.ZstdDecompressor(**shared)
    at = 8 + size
    while at < len(data):
        end = _frame_end(data, at)
        yield one.decompress(data[at:end])
        at = end


def plan(pages: DataFrame) -> DataFrame:
    """Pages with payload_bytes, payload_digest and refers_to (null for responses); html is null for revisits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    known = pages.select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2(F.encode("html", "utf-8"), 256).alias("payload_digest"))
    first = known.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = settle(first, "warc-first")  # its size is known then: where it is small, the join moves no page
    met = known.join(first, "payload_digest", "left")
    again = (F.col("page_id") > F.col("first")) & (F.col("payload_bytes") >= LEAST)
    return met.withColumn("refers_to", F.when(again, F.col("first"))).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html"))).drop("first")


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The archives of all pages as a table (archive, records, data), written to the shared folder."""
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    total = pages.agg(F.sum(size.cast("long") + 512)).first()[0] or 0
    count = max(1, -(-total // archive_bytes))
    dealt = plan(pages).withColumn("archive", F.pmod(F.xxhash64("page_id", "url", "payload_digest"), F.lit(count)))

    def build(key, table):
        table = table.sort_by([("page_id", "ascending")])
        rows = zip(*(table[c].to_pylist() for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")))
        made = [record(i, url, None if html is None else html.encode(), n, digest, to) for i, url, html, n, digest, to in rows]
        return pa.table({"archive": pa.array([key[0].as_py()], pa.int64()), "records": pa.array([len(made)], pa.int64()), "data": pa.array([archive(made)], pa.binary())})

    # a task an archive, or a few where there are very many, however small the archives are
    dealt = dealt.repartition(min(count, max(partitions(pages.sparkSession), MOST_TASKS)), "archive")
    return settle(dealt.groupBy("archive").applyInArrow(build, _TABLE), "warc")


def read(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; digests are checked."""

    def number(uri: str | None) -> int | None:
        return int(x) if uri and (x := uri.removeprefix("<urn:page:").rstrip(">")) else None

    def rows(data):
        for r in records(data):
            headers, body = parse(r)
            kind, size = headers["WARC-Type"], int(headers["X-Payload-Length"])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response":
                payload = body.partition(b"\r\n\r\n")[2]
                found = hashlib.sha256(payload).hexdigest()
                if found != digest or len(payload) != size:
                    raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
            yield number(headers["WARC-Record-ID"]), size, digest, kind, number(headers.get("WARC-Refers-To"))

    def run(batches):
        for b in batches:
            for data in b.column(0):
                cols = list(zip(*rows(data.as_py()))) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("data").mapInArrow(run, _READ)


def export(archives: DataFrame, folder: str) -> int:
    """Write the archives as files part-N.warc.zst of a folder that all executors have mounted; how many there are.

    A file appears under its name when it is whole, so a task that runs again does no harm.
    """

    def run(batches):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            names = []
            for number, data in zip(b.column(0).to_pylist(), b.column(1)):
                names.append(f"part-{number:06d}.warc.zst")
                part = f"{folder}/.{names[-1]}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data.as_py())
                os.replace(part, f"{folder}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return archives.select("archive", "data").mapInArrow(run, "name string").count()


def load(spark: SparkSession, folder: str) -> DataFrame:
    """Archives (archive, data) from files of a folder, for read()."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("archive"), F.col("content").alias("data"))
