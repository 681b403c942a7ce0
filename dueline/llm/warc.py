"""Deterministic, sharded WARC files of pages, and their reader.

Pages are cut into ranges of page_id and sorted; each task writes its range as
gzip members, one per record, rolls files by compressed size and regenerates all
headers and digests. A file is written under a temporary name and moved to its
final name, which depends on the range and the file's number alone: a rerun or
speculative task writes the same bytes to the same name. The rows that tasks
return become the manifest; an archive without a finished manifest is none, and
the reader refuses files that differ from it.

Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the
smallest page_id is a response and the others are revisits of it. A null payload
is an empty one; rows with a null page_id come first, as responses or as
revisits like others. Rows that repeat a page_id and its payload share their
record type. An empty table gives an archive without files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.llm._support import in_blocks, map_batches, partitions
from dueline.llm.files import MANIFEST, RollingFiles, checked_files, new_folder, read_manifest

REVISIT_BYTES = 100
ROLL_BYTES = 16 << 20
#: All records carry this date unless another is given, so that runs are alike.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, payload binary"
)


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages that repeat an earlier payload.

    Slim rows only: digests that occur once leave after one aggregate with
    map-side combine, and a hot digest is spread by the join's skew handling.
    """
    slim = pages.select("page_id", "digest", F.octet_length("html").alias("bytes")).filter(
        F.col("bytes") >= REVISIT_BYTES
    )
    first = (
        slim.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
        .filter((F.col("copies") > 1) & F.col("refers_to").isNotNull())
        .drop("copies")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return slim.join(first, "digest").filter(other).select("page_id", "digest", "refers_to")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC/1.1 record. Lengths and digests are those of ``payload``."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_archive(
    pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = DATE
) -> DataFrame:
    """Write pages (page_id, url, html) below ``folder``; returns the manifest.

    ``folder`` is an absolute path or URI that all executors reach.
    """
    spark = pages.sparkSession
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    none = F.lit(None)
    # Decisions travel to their pages in the shuffle that sorts these.
    both = slim.select("page_id", "url", "html", "digest", none.cast("long").alias("refers_to")).unionByName(
        revisits(slim).distinct().select(
            "page_id", none.cast("string").alias("url"), none.cast("string").alias("html"), "digest", "refers_to"
        )
    )
    parts = partitions(spark)
    blocks = in_blocks(both, "page_id", parts, known=pages)
    sorted_rows = blocks.repartitionById(parts, "_block").sortWithinPartitions(
        "_block", "page_id", "digest", F.desc_nulls_last("refers_to"), "url"
    )

    def run(batches):
        files, current, last = None, None, (None, None, None)
        for batch in batches:
            for page_id, url, html, digest, refers_to, block in zip(
                *[c.to_pylist() for c in batch.columns], strict=True
            ):
                if block != current:
                    if files:
                        yield from files.finish()
                    files, current = RollingFiles(folder, block, ".warc.gz", roll_bytes), block
                if html is None:
                    last = (page_id, digest, refers_to)
                    continue
                target = last[2] if last[:2] == (page_id, digest) else None
                raw = record(page_id, url, html.encode(), digest, target, date)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                files.add(packer.compress(raw) + packer.flush(), 1, len(raw))
        if files:
            yield from files.finish()

    map_batches(sorted_rows, run, MANIFEST).write.parquet(f"{folder.rstrip('/')}/_manifest")
    return read_manifest(spark, folder)


def members(data: bytes) -> Iterator[bytes]:
    """Records of a file, one gzip member at a time."""
    while data:
        opener = zlib.decompressobj(31)
        yield opener.decompress(data) + opener.flush()
        data = opener.unused_data


def parse(raw: bytes) -> dict:
    """Fields of a record; its lengths and digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    response = fields["WARC-Type"] == "response"
    payload = block.partition(b"\r\n\r\n")[2] if response else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if response and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return {
        "page_id": None if page is None else int(page),
        "payload_bytes": len(payload) if response else int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
        "url": fields["WARC-Target-URI"],
        "payload": payload,
    }


def read_archive(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Records of an archive, whose files must be those of its manifest."""
    names = columns or [re.split(r"\s", c.strip())[0] for c in _READ.split(",")]
    found = checked_files(spark, folder, ".warc.gz")
    if found is None:
        return spark.createDataFrame([], _READ).select(*names)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [parse(m) for m in members(content.as_py())]
                yield {n: [r[n] for r in rows] for n in names}

    schema = ", ".join(c.strip() for c in _READ.split(",") if c.split()[0] in names)
    return map_batches(found.select("content"), run, schema).select(*names)


def written_and_read(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Pages written to a new archive in the shared folder, read back from it."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archive(pages, folder, roll_bytes)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read_archive(pages.sparkSession, folder, names)
