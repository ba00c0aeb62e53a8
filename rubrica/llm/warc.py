"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing (`write_archives`): payload digests find equal payloads; of each group the record with the largest page id is the
response and the others become revisits of it. Digests meet in an aggregate and an equi-join that splits when one payload is
very common. Each partition becomes one archive, or several: a new one is begun when one holds `archive_bytes`, so that a
reader can take it as one value. Each has a dictionary trained on a bounded number of its own first records. An archive is
written under a temporary name and renamed, and its name depends on the partition and the number in it alone, so a repeated
task replaces what an earlier attempt left. Archives go through a file-system client for the folder's scheme.

Reading (`read_archives`): Spark lists and reads the archives as binary files, a task each; the dictionary is loaded from
the skippable frame (plain or itself compressed), frames are found by walking their block headers and decoded one at a
time, and every record's version line, headers, lengths and payload digest are validated. A record that fails is returned
with its `error`; damage in a frame ends that archive with one row that says so.

Null or missing html is an empty payload. Rows that repeat a page id with the same payload all stay responses when that id
is the largest of its group. Null page ids are written and come back as null. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain, islice
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.llm.common import pick
from rubrica.session import cut_lineage, shared_dir

#: Fixed values of the format: the dictionary's skippable frame and the magic numbers of frames and dictionaries.
DICT_FRAME, FRAME, DICT = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "archive string, page_id bigint, record_type string, target_uri string, payload_bytes bigint, payload_digest string,"
    " refers_to bigint, payload binary, error string"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, original: int | None) -> bytes:
    """One record; a revisit (with `original`) keeps the HTTP head, which states the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if original is not None else head + payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original is not None:
        lines += [f"WARC-Refers-To: <urn:page:{original}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Frames of one archive: the dictionary first, then a frame per record."""

    def __init__(self, samples: list[bytes], level: int, dict_bytes: int):
        import zstandard

        try:
            self.dictionary = zstandard.train_dictionary(dict_bytes, samples)
        except zstandard.ZstdError:  # too few or too small samples to train on
            self.dictionary = None
        extra = {"dict_data": self.dictionary} if self.dictionary else {}
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, **extra).compress

    def head(self) -> bytes:
        raw = self.dictionary.as_bytes() if self.dictionary else b""
        return struct.pack("<II", DICT_FRAME, len(raw)) + raw


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends; raises on a cut or reserved block."""
    import zstandard

    head = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    last = 0
    while not last:
        if at + 3 > len(data):
            raise ValueError("cut frame")
        word = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise ValueError("reserved block")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * head.has_checksum
    if at > len(data):
        raise ValueError("cut frame")
    return at


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def parse(raw: bytes) -> tuple:
    """(page_id, type, uri, payload bytes, digest, refers_to, payload, error) of one decoded record."""
    error, payload, n = None, None, None
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            error = error or "header without a colon"
        fields[name.strip().lower()] = value.strip()
    if lines[0] != VERSION.decode():
        error = "unknown version"
    missing = [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in fields]
    if missing:
        error = error or "missing " + ", ".join(missing)
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        error = error or "content length"
    else:
        head, gap, body = rest[:-4].partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        n = int(stated[1]) if stated else None
        if not gap or n is None:
            error = error or "HTTP head"
        elif fields.get("warc-type") == "revisit":
            error = error or ("revisit with a payload" if body else None)
        else:
            payload = body
            if len(body) != n:
                error = error or "payload length"
            elif fields.get("warc-payload-digest") != "sha1:" + digest(body):
                error = error or "payload digest"
    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (
        _page(fields.get("warc-record-id")), fields.get("warc-type"), fields.get("warc-target-uri"), n, sha,
        _page(fields.get("warc-refers-to")), payload, error,
    )


def decode(data: bytes) -> Iterator[tuple]:
    """Parsed records of one archive."""
    import zstandard

    view, at, known = memoryview(data), 0, None
    try:
        while at < len(view):
            magic = int.from_bytes(view[at : at + 4], "little")
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                size = int.from_bytes(view[at + 4 : at + 8], "little")
                body = bytes(view[at + 8 : at + 8 + size])
                if len(body) != size:
                    raise ValueError("cut skippable frame")
                if magic == DICT_FRAME and at == 0 and body:
                    if body[:4] == FRAME:
                        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                    known = zstandard.ZstdCompressionDict(body)
                at += 8 + size
                continue
            end = frame_end(view, at)
            # a new reader per frame: a record may be of any length, stated in the frame or not
            raw = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(bytes(view[at:end]))
            yield parse(raw)
            at = end
    except (ValueError, zstandard.ZstdError) as fault:
        yield None, None, None, None, None, None, None, f"frame at byte {at}: {fault}"


def linked(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, original): `original` is the response's page for revisits, else null."""
    p = pick(pages, page_id="page_id", url="url", html="html")
    p = p.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= least
    firsts = p.filter(long_enough).groupBy("sha").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select(F.col("sha").alias("_sha"), "original")
    joined = p.join(firsts, (p["sha"] == F.col("_sha")) & long_enough, "left")
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("original")).alias("original"))


def write_archives(
    pages: DataFrame, folder: str, least: int = 0, level: int = 3, dict_bytes: int = 65536, dict_records: int = 200,
    archive_bytes: int = 64 << 20,
) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives into `folder`; returns (archive, records, bytes), already computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, payload, original in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    yield record(page, url, payload, digest(payload), original)

        system, root = fs.FileSystem.from_uri(folder)
        stream, part = records(), 0
        while first := list(islice(stream, dict_records)):
            stream = chain(first, stream)
            system.create_dir(root, recursive=True)
            name = f"part-{TaskContext.get().partitionId():06d}-{part:04d}.warc.zst"
            draft = f"{root}/_draft-{uuid.uuid4().hex}"
            archive, n = Archive([r[:4096] for r in first], level, dict_bytes), 0
            with system.open_output_stream(draft) as out:
                out.write(archive.head())
                for raw in stream:
                    out.write(archive.compress(raw))
                    n += 1
                    if out.tell() >= archive_bytes:
                        break
                size = out.tell()
            system.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [n], "bytes": [size]})
            part += 1

    return cut_lineage(linked(pages, least).mapInArrow(run, "archive string, records bigint, bytes bigint"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all *.warc.zst files of a folder, in the columns of RECORDS."""
    schema = pa.schema(
        [("archive", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
         ("error", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for parsed in decode(content.as_py()):
                    held.append((path.as_py(), *parsed))
                    size += len(parsed[6] or b"")
                    if size > 8 << 20 or len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    )
    return files.load(folder).select("path", "content").mapInArrow(run, RECORDS)


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write and read back: one row per page."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    if "://" not in folder and ":/" not in folder:
        folder = "file://" + folder
    if write_archives(pages, folder).count() == 0:
        return spark.createDataFrame([], RECORDS).drop("archive", "target_uri", "payload")
    return read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    )


def base32(hex40: str) -> str:
    """DuckDB text: bare base32 of 40 hexadecimal digits, 20 bits at a time."""
    digits = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    group = f"('0x' || substr({hex40}, 5 * g + 1, 5))::BIGINT"
    parts = " || ".join(f"substr({digits}, ((({group}) >> {b}) & 31)::INTEGER + 1, 1)" for b in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda g: {parts}), '')"


DIGEST_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT html, max(page_id) AS original FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {base32('sha')} AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to,
       NULL::VARCHAR AS error
FROM p JOIN g USING (html)
"""
